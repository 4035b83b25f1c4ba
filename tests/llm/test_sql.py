"""Queries of the corpus operators against their SQL on DuckDB."""

import duckdb
import pytest

from sumweave.llm import chat, decontaminate
from sumweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def show(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, found = QUERIES[name](spark, FOLDER), con.execute(ORACLES[name])
    assert show(df.collect(), df.columns) == show(found.fetchall(), [d[0] for d in found.description])


def test_pairs(spark):
    turns = []
    for c in range(30):
        said = [("system", f"s{c % 3}"), ("user", f"u{c % 5}"), ("assistant", f"ä{c % 7}"), ("user", "more"), ("assistant", f"b{c % 2}")][: 1 + c % 5]
        turns += [(c, k, r, t) for k, (r, t) in enumerate(said)]
    turns += [(99, 0, "assistant", "alone")]
    for c, said in {
        40: ["q one", "yes"], 41: ["q one", "yes"], 42: ["q one", "no", "why", "so"],  # equal, and an alternative
        50: ["q two", "well", "go on", "fine"], 51: ["q two", "well", "stop", "fine"],  # they part at a user's turn
        60: ["q three", "same", "next"], 61: ["q three", "same"],  # one goes on
        70: ["q four", ""], 71: ["q five", "x"], 72: ["q six", "é🙂ab"],
    }.items():
        turns += [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(said)]
    turns += [(None, 0, "assistant", "no id"), (None, 0, "assistant", "no id"), (None, 3, "user", None), (80, 0, None, None), (80, None, "assistant", "y"), (80, None, "assistant", "y")]
    df = chat.preference_rows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    found = con.execute(chat.SQL)
    rows = df.collect()
    assert {r["status"] for r in rows} == {"single", "equal", "pair", "derived"}
    assert show(rows, df.columns) == show(found.fetchall(), [d[0] for d in found.description])
    by = {(r["chosen_id"], r["rejected_id"]): r for r in rows}
    assert by[40, 41]["status"] == "equal" and by[40, 42]["status"] == "pair"
    assert all(by[k, None]["status"] == "derived" for k in (50, 51, 60, 61, 71, 72, 99)) and by[70, None]["status"] == "single"
    r = by[72, None]
    assert (r["chosen"], r["rejected"]) == ("<|im_start|>assistant\né🙂ab<|im_end|>\n", "<|im_start|>assistant\né🙂<|im_end|>\n")


def test_prompts_end_before_an_answer(spark):
    """Every observed pair parts at a turn of the assistant, and every row of the whole table has its prompt once and both completions masked."""
    whole = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    more = whole.where("turn <= 2").selectExpr("conv_id + 100000 AS conv_id", "turn", "role", "CASE WHEN role = 'assistant' THEN concat(text, ' or not') ELSE text END AS text")
    rows = chat.preference_rows(whole.unionByName(more)).collect() + chat.preference_rows(whole).collect()
    kinds = {k: [r for r in rows if r["status"] == k] for k in ("pair", "derived", "single")}
    assert len(kinds["pair"]) >= 5 and len(kinds["derived"]) >= 5 and not [r for r in rows if r["status"] == "equal"]
    for r in kinds["pair"] + kinds["derived"]:
        assert r["chosen"].startswith("<|im_start|>assistant\n") and r["rejected"].startswith("<|im_start|>assistant\n") and r["chosen"] != r["rejected"]
        for text, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
            for s, e in (map(int, x.split(":")) for x in mask.split(",")):
                assert text[:s].endswith("<|im_start|>assistant\n") and text[:e].endswith("<|im_end|>") and "<|im_start|>" not in text[s:e]


def test_scores_choose(spark):
    turns = [(1, 0, "user", "q", 0.1), (1, 1, "assistant", "a", None), (2, 0, "user", "q", 0.9), (2, 1, "assistant", "b", 0.2), (3, 0, "user", "q", None), (3, 1, "assistant", "c", None)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, grade double")
    assert {(r["chosen_id"], r["rejected_id"]) for r in chat.preference_rows(t, score="grade").collect()} == {(2, 1), (2, 3)}


def test_pairs_of_odd_rows(spark):
    turn = "array<struct<turn:long,role:string,text:string>>"
    long = "word " * 400_000
    pairs = spark.createDataFrame([(1, None, None, None, 5), (None, 2, [(0, "user", None)], [], 5), (3, 4, [(0, "user", "q"), (1, "assistant", long)], [(0, "user", "q"), (1, "assistant", long + "x")], 5)] * 2, f"chosen_id long, rejected_id long, chosen_turns {turn}, rejected_turns {turn}, status int")
    rows = chat.format_pairs(pairs.where("chosen_id is not null")).collect()
    assert sorted(r["status"] for r in rows) == ["pair", "pair", "single", "single"] and chat.format_pairs(pairs.limit(0)).count() == 0
    assert {len(r["chosen"]) for r in rows} == {0, len("<|im_start|>assistant\n<|im_end|>\n") + len(long)}


def test_short_items(spark):
    docs = [(1, "one two three four five six"), (2, "Two  Three"), (3, "three two"), (4, None), (5, " ")]
    items = [(1, "two three"), (2, "six"), (3, "two three four five six"), (4, ""), (5, "one two three four five seven")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    df = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = con.execute(decontaminate.SQL)
    assert show(df.collect(), df.columns) == show(found.fetchall(), [d[0] for d in found.description])
    assert {(r["doc_id"], r["item_id"]) for r in df.collect()} == {(1, 1), (2, 1), (1, 2), (1, 3)}
