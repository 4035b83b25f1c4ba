"""Random join trees with nulls, empty tables and repeated keys: from summaries and directly."""

import random

import pytest

from sumweave.operators.explicit import agg_over_join
from sumweave.plans.ir import Bail


@pytest.mark.parametrize("seed", range(12))
def test_same_as_direct(spark, seed, monkeypatch):
    r = random.Random(seed)
    n = r.randint(2, 5)
    up = {k: r.randrange(k) for k in range(1, n)}
    names = [f"t{k}" for k in range(n)]
    for k, name in enumerate(names):
        rows = [tuple(r.choice([None, 0, 1, 2]) for _ in range(n)) + (r.choice([None, 1.0, 2.5, 4.0]), r.choice([None, "a", "b"])) for _ in range(r.choice([0, 3, 8, 15]))]
        spark.createDataFrame(rows, ", ".join(f"k{j} int" for j in range(n)) + ", v double, g string").createOrReplaceTempView(f"tree_{name}")
    on = [(f"t{k}.k{k}", f"t{p}.k{k}") for k, p in up.items()]
    groups = [f"{r.choice(names)}.g" for _ in range(r.randint(0, 2))]
    groups = {f"g{i}": g for i, g in enumerate(dict.fromkeys(groups))}
    aggregates = {"n": ("count", None)}
    for i, fn in enumerate(["sum", "avg", "count", "min", "max"]):
        aggregates[f"a{i}"] = (fn, f"{r.choice(names)}.v")
    ours = agg_over_join({x: spark.table(f"tree_{x}") for x in names}, on, groups, aggregates)
    select = [f"{g} as {a}" for a, g in groups.items()] + [f"{fn}({c or '*'}) as {a}" for a, (fn, c) in aggregates.items()]
    text = f"select {', '.join(select)} from {', '.join(f'tree_{x} {x}' for x in names)} where {' and '.join(f'{a} = {b}' for a, b in on)}"
    direct = spark.sql(text + (f" group by {', '.join(groups.values())}" if groups else ""))
    show = lambda df: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in row)) for row in df.collect())
    assert show(ours) == show(direct)
    from sumweave.operators import propagate

    whole = propagate.aggregate_over_join
    monkeypatch.setattr("sumweave.operators.explicit.aggregate_over_join", lambda q, root=None: whole(q, root, frozenset(r.choice([names, names[:1], names[1:]]))))
    assert show(agg_over_join({x: spark.table(f"tree_{x}") for x in names}, on, groups, aggregates)) == show(direct)


def test_shapes_that_bail(spark):
    t = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(Bail, match="no equality"):
        agg_over_join({"x": t, "y": t}, [], [], {"n": ("count", None)})
    with pytest.raises(Bail, match="cycle"):
        agg_over_join({"x": t, "y": t, "z": t}, [("x.a", "y.a"), ("y.b", "z.a"), ("z.b", "x.b")], [], {"n": ("count", None)})
    with pytest.raises(Bail, match="sum of string"):
        agg_over_join({"x": t.selectExpr("a", "'q' as s"), "y": t}, [("x.a", "y.a")], [], {"n": ("sum", "x.s")})
