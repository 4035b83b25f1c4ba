"""Aggregates over acyclic joins by messages: every relation sends its parent one row for each join key."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumweave.functions import algebra as A
from sumweave.plans.ir import Aggregate, AggOverJoin, Bail
from sumweave.plans.joingraph import Node, kept_columns, tree


class _Summary:
    """A relation with its children's messages: columns that are kept, multiplicities, and parts of aggregates by owner."""

    def __init__(self, q: AggOverJoin, loose: frozenset[str] = frozenset()):
        self.q = q
        self.loose = loose
        self.inside: dict[str, list[Node]] = {}
        self.kinds = {}
        for a in q.aggregates:
            if a.relation is not None:
                kind = q.relations[a.relation].df.schema[a.column].dataType
                if (why := A.supported(a.fn, kind)) is not None:
                    raise Bail(why)
                self.kinds[a] = kind

    def column(self, relation: str, column: str) -> str:
        return f"{relation}__{column}"

    def part(self, a: Aggregate, part: str) -> str:
        return f"_{self.q.aggregates.index(a)}_{part}"

    def rows(self, node: Node) -> DataFrame:
        """The columns of a relation that matter here, under names of their own."""
        name, r = node.name, self.q.relations[node.name]
        edges = [c.up for c in node.children] + ([node.up] if node.up else [])
        wanted = [*(c for e in edges for c in e.end(name)), *(g[1] for g in self.q.groups if g[0] == name), *(a.column for a in self.q.aggregates if a.relation == name)]
        columns = [F.col(f"`{c}`").alias(self.column(name, c)) for c in dict.fromkeys(wanted)]
        for c in self.absorbed(node):
            its = dict.fromkeys(a.column for a in self.q.aggregates if a.relation == c.name)
            columns += [F.col(f"`{self.q.twins[name, c.name][x]}`").alias(self.column(c.name, x)) for x in its]
        return r.df.select(*columns)

    def absorbed(self, node: Node) -> list[Node]:
        """Children that are the node's own rows again, joined by all that it is condensed by: their summaries are its own, without a second scan or a join."""
        if node.name not in self.inside:
            q, by = self.q, set(kept_columns(self.q, node))
            self.inside[node.name] = []
            if not self.plain(node):
                for c in node.children:
                    its = q.twins.get((node.name, c.name))
                    if its is None or c.children or any(g[0] == c.name for g in q.groups) or set(c.up.end(node.name)) != by:
                        continue
                    if all(self.equal(node.name, x, its[y]) for x, y in zip(c.up.end(node.name), c.up.end(c.name), strict=True)):
                        self.inside[node.name].append(c)
        return self.inside[node.name]

    def equal(self, relation: str, x: str, y: str) -> bool:
        """Whether two columns of a relation are one expression."""
        df = self.q.relations[relation].df
        if x == y:
            return True
        one, other = (df.select(F.col(f"`{c}`").alias("c"))._jdf.queryExecution().optimizedPlan() for c in (x, y))
        return one.sameResult(other)

    def plain(self, node: Node) -> bool:
        """Whether a relation goes into the join as it is."""
        by = [self.column(node.name, c) for c in kept_columns(self.q, node)]
        return self.is_unique(node, by) or bool(node.children) and node.name in self.loose

    def keys(self, node: Node) -> list[str]:
        return [self.column(node.name, c) for c in node.up.end(node.name)] if node.up else []

    def own_groups(self, node: Node) -> list[str]:
        return [self.column(g[0], g[1]) for g in self.q.groups if g[0] == node.name]

    def groups_below(self, node: Node) -> list[str]:
        inside = set(node.below())
        return [self.column(g[0], g[1]) for g in self.q.groups if g[0] in inside]

    def aggregates_below(self, node: Node) -> list[Aggregate]:
        inside = set(node.below())
        return [a for a in self.q.aggregates if a.relation in inside]

    def is_unique(self, node: Node, columns: list[str]) -> bool:
        have = {c.split("__", 1)[1] for c in columns if c.startswith(f"{node.name}__")}
        return any(u <= have for u in self.q.relations[node.name].unique)

    def multiplicity(self, name: str) -> Column:
        n = F.col(f"_n_{name}")
        return n.cast(A.WIDE) if self.q.wide else n

    def stands_for(self, weights: dict[str, Column]) -> Column | None:
        """How many rows of the join a row stands for; None: 1."""
        out = A.product(list(weights.values()))
        return A.held(out) if self.q.wide and out is not None else out

    def condensed(self, node: Node) -> tuple[DataFrame, Column | None]:
        """The relation, one row for each combination of its join keys and groups; its own multiplicity (None: 1)."""
        rows = self.rows(node)
        by = [self.column(node.name, c) for c in kept_columns(self.q, node)]
        if self.plain(node):
            return rows, None
        same = [c.name for c in self.absorbed(node)]
        for x in by if same else []:
            rows = rows.where(F.col(x).isNotNull())  # the join has no others
        own = [a for a in self.q.aggregates if a.relation in (node.name, *same)]
        parts = {self.part(a, p): x for a in own for p, x in A.own_parts(a.fn, F.col(self.column(a.relation, a.column)), self.kinds[a], None).items()}
        n = f"_n_{node.name}"
        out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(n), *(x.alias(p) for p, x in parts.items()))
        return out, self.multiplicity(node.name)

    def joined(self, node: Node) -> tuple[DataFrame, dict[str, Column], bool]:
        """A relation with the messages of its children; multiplicities by sender; whether its own rows are condensed."""
        df, own = self.condensed(node)
        weights = {} if own is None else {node.name: own}
        same = self.absorbed(node)
        for c in node.children:
            if c in same:
                weights[c.name] = own
                continue
            message = self.message(c)
            on = [F.col(a) == F.col(b) for a, b in zip((self.column(node.name, x) for x in c.up.end(node.name)), self.keys(c), strict=True)]
            condition = on[0]
            for x in on[1:]:
                condition = condition & x
            df = df.join(message, condition, "inner")
            weights[c.name] = self.multiplicity(c.name)
        return df, weights, own is not None

    def totals(self, node: Node, weights: dict[str, Column], condensed: bool) -> dict[str, Column]:
        """Aggregate expressions for the multiplicity and all parts of aggregates in the relation and below it."""
        everything = self.stands_for(weights)
        out = {f"_n_{node.name}": F.count(F.lit(1)) if everything is None else A.wide_total(everything) if self.q.wide else F.sum(everything)}
        for a in self.aggregates_below(node):
            sender = node.name if a.relation == node.name else next(c.name for c in node.children if a.relation in c.below())
            others = A.product([w for s, w in weights.items() if s != sender])
            if a.relation == node.name and not condensed:
                made = A.own_parts(a.fn, F.col(self.column(node.name, a.column)), self.kinds[a], others)
            else:
                made = A.inherited_parts(a.fn, {p: F.col(self.part(a, p)) for p in A.PARTS[a.fn]}, self.kinds[a], others)
            out |= {self.part(a, p): x for p, x in made.items()}
        return out

    def products(self, node: Node, weights: dict[str, Column]) -> dict[str, Column]:
        """What totals would give where every group is one row of condensed relations."""
        everything = self.stands_for(weights)
        out = {f"_n_{node.name}": F.lit(1).cast("bigint") if everything is None else everything}
        for a in self.aggregates_below(node):
            sender = node.name if a.relation == node.name else next(c.name for c in node.children if a.relation in c.below())
            others = A.product([w for s, w in weights.items() if s != sender])
            out |= {self.part(a, p): x for p, x in A.single_parts(a.fn, {p: F.col(self.part(a, p)) for p in A.PARTS[a.fn]}, self.kinds[a], others).items()}
        return out

    def message(self, node: Node) -> DataFrame:
        """One row for each key to the parent and each combination of group columns from below."""
        by = list(dict.fromkeys([*self.keys(node), *self.groups_below(node)]))
        if not node.children:
            df, own = self.condensed(node)
            if own is None:  # already one row for each key: parts of single rows
                parts = {self.part(a, p): x for a in self.aggregates_below(node) for p, x in self._single(a, node).items()}
                return df.select(*by, F.lit(1).cast("bigint").alias(f"_n_{node.name}"), *(x.alias(p) for p, x in parts.items()))
            return df
        df, weights, condensed = self.joined(node)
        return df.groupBy(*by).agg(*(x.alias(p) for p, x in self.totals(node, weights, condensed).items()))

    def _single(self, a: Aggregate, node: Node) -> dict[str, Column]:
        x = F.col(self.column(node.name, a.column))
        return {p: x.isNotNull().cast("bigint") if p == "c" else x.cast(A.sum_type(self.kinds[a])) if p == "s" else x for p in A.PARTS[a.fn]}


def aggregate_over_join(q: AggOverJoin, root: str | None = None, loose: frozenset[str] = frozenset()) -> DataFrame:
    """The groups and aggregates of q, grouped by nothing: one row.

    Each relation is condensed to one row for each combination of join keys and groups before it meets another, so a join never makes more rows
    than its sides have distinct keys, and Spark combines before every shuffle. Where a relation is condensed by its only
    join key and that is the group, the exchange serves the condensing, the join and the result. loose: relations whose rows hardly
    repeat; unless they are leaves they go into the join as they are.
    """
    if q.wide and any(a.fn != "count_star" for a in q.aggregates):
        raise Bail("only rows are counted wide")
    top = tree(q, root)
    if not q.twins:  # relations given as one DataFrame
        names = list(q.relations)
        pairs = [(a, b) for a in names for b in names if a != b and q.relations[a].df is q.relations[b].df]
        q = replace(q, twins={(a, b): {c: c for c in q.relations[b].df.columns} for a, b in pairs})
    s = _Summary(q, loose)
    df, weights, condensed = s.joined(top)
    groups = list(dict.fromkeys(s.column(g[0], g[1]) for g in q.groups))
    n, own = F.col(f"_n_{top.name}"), {s.column(top.name, c) for c in kept_columns(q, top)}
    results = [F.col(s.column(g[0], g[1])).alias(g[2]) for g in q.groups]
    if groups and condensed and own <= set(groups):  # one row for each group already
        made = s.products(top, weights)
        return df.select(*results, *(A.finish(a.fn, {p: made[s.part(a, p)] for p in A.PARTS[a.fn]}, made[f"_n_{top.name}"], True, s.kinds.get(a)).alias(a.alias) for a in q.aggregates))
    totals = s.totals(top, weights, condensed)
    out = df.groupBy(*groups).agg(*(x.alias(p) for p, x in totals.items())) if groups else df.agg(*(x.alias(p) for p, x in totals.items()))
    results += [A.finish(a.fn, {p: F.col(s.part(a, p)) for p in A.PARTS[a.fn]}, n, bool(groups), s.kinds.get(a)).alias(a.alias) for a in q.aggregates]
    return out.select(*results)
