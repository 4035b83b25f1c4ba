"""What is asked for: aggregates over an inner equi-join of relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Bail(Exception):
    """The query is left to plain Spark; the message says why."""


@dataclass
class Relation:
    """A bag of rows. Column names may repeat in other relations. unique: sets of columns that are known to identify a row."""

    name: str
    df: DataFrame
    unique: list[frozenset[str]] = field(default_factory=list)


@dataclass(frozen=True)
class Edge:
    """left.columns[i] = right.columns[i] for all i."""

    left: str
    right: str
    columns: tuple[tuple[str, str], ...]

    def end(self, name: str) -> tuple[str, ...]:
        return tuple(p[0 if name == self.left else 1] for p in self.columns)

    def other(self, name: str) -> str:
        return self.right if name == self.left else self.left


@dataclass(frozen=True)
class Aggregate:
    """fn over a column of a relation; count_star needs neither."""

    fn: str
    relation: str | None
    column: str | None
    alias: str


@dataclass
class AggOverJoin:
    relations: dict[str, Relation]
    edges: list[Edge]
    groups: list[tuple[str, str, str]]  # relation, column, alias
    aggregates: list[Aggregate]
    conditions: int = 0  # equalities as the query has them
    #: For relations of the same rows: (one, other) to the columns of one's df under which it has those of the other.
    twins: dict[tuple[str, str], dict[str, str]] = field(default_factory=dict)
    wide: bool = False  # rows are counted as DECIMAL(38, 0) instead of BIGINT; no other aggregates


@dataclass
class Decision:
    """What was done with an aggregate and why. family: shape of the rewrite."""

    rewritten: bool
    reasons: list[str]
    family: str | None = None
    relations: int = 0
    estimate: dict | None = None
