"""Aggregates over joins from DataFrames, without SQL and without reading plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sumweave.plans.ir import Aggregate, AggOverJoin, Bail, Relation
from sumweave.plans.joingraph import edges_of

from .propagate import aggregate_over_join


def _split(name: str) -> tuple[str, str]:
    relation, _, column = name.partition(".")
    if not column:
        raise ValueError(f"{name!r} is not relation.column")
    return relation, column


def agg_over_join(
    relations: Mapping[str, DataFrame],
    on: Sequence[tuple[str, str]],
    group_by: Sequence[str] | Mapping[str, str],
    aggregates: Mapping[str, tuple[str, str | None]],
    unique: Mapping[str, Sequence[Sequence[str]]] | None = None,
    root: str | None = None,
    wide: bool = False,
) -> DataFrame:
    """Groups and aggregates of an inner equi-join of any acyclic shape.

    on: pairs ("a.x", "b.y") of equal columns. group_by: "a.x" names, or alias to name. aggregates: alias to (function, "a.x"), function one of
    sum, count, avg, min, max; ("count", None) counts rows. unique: columns that identify the rows of a relation, which then isn't condensed.
    wide: counts of rows, and no other aggregates, as DECIMAL(38, 0), on the way too.
    Bail if summaries by key can't answer it.

        agg_over_join({"o": orders, "l": lineitem}, [("o.o_orderkey", "l.l_orderkey")], ["o.o_custkey"], {"q": ("sum", "l.l_quantity"), "n": ("count", None)})
    """
    groups = [(*_split(n), a) for a, n in (group_by.items() if isinstance(group_by, Mapping) else ((_split(g)[1], g) for g in group_by))]
    made = [Aggregate("count_star", None, None, a) if arg is None else Aggregate(fn, *_split(arg), a) for a, (fn, arg) in aggregates.items()]
    if any(arg is None and fn != "count" for fn, arg in aggregates.values()):
        raise Bail("only count needs no argument")
    keys = {r: [frozenset(u) for u in (unique or {}).get(r, [])] for r in relations}
    q = AggOverJoin({r: Relation(r, df, keys[r]) for r, df in relations.items()}, edges_of([(_split(a), _split(b)) for a, b in on]), groups, made, wide=wide)
    return aggregate_over_join(q, root)


def one_sided(left: DataFrame, right: DataFrame, keys: Sequence[str], group_by: Sequence[str], aggregates: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Arguments on the left side alone, joined by columns of equal names, grouped by any of them or by nothing."""
    both = {a: (fn, arg and f"l.{arg}") for a, (fn, arg) in aggregates.items()}
    return agg_over_join({"l": left, "r": right}, [(f"l.{k}", f"r.{k}") for k in keys], [f"l.{g}" for g in group_by], both)


def head_bridge_tail(head: DataFrame, bridge: DataFrame, tail: DataFrame, x: str, y: str, aggregates: Mapping[str, tuple[str, str | None]], grouped: bool = True) -> DataFrame:
    """head(x) - bridge(x, y) - tail(y), grouped by x or by nothing; arguments on any of the three."""
    return agg_over_join({"head": head, "bridge": bridge, "tail": tail}, [(f"head.{x}", f"bridge.{x}"), (f"bridge.{y}", f"tail.{y}")], [f"head.{x}"] if grouped else [], aggregates)
