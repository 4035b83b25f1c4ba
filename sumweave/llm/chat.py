"""Preference formatting of conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, broadcast_if_small, load, save

#: Marks around a turn.
START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def conversations_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", score: str | None = None) -> DataFrame:
    """(conv_id, score, turns) with the turns (turn, role, text) in order, null turn numbers first; equal ones by role, then text; repeated rows stay.

    Each row without an id is a conversation of its own, so these rows meet in no task. score is the largest of a conversation's, null without a column for it.
    """
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), (F.lit(None) if score is None else F.col(score)).cast("double").alias("score"), t.alias("t"))
    known = rows.where("conv_id is not null").groupBy("conv_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_list("t")).alias("turns"))
    return known.unionByName(rows.where("conv_id is null").select("conv_id", "score", F.array("t").alias("turns")))


def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns, and the spans of it, in code points, that the assistant's turns fill with their end marks."""
    out, at, spans = [], 0, []
    for t in turns:
        head = f"{START}{t['role']}\n"
        whole = f"{head}{t['text']}{END}"
        if t["role"] == LEARNED:
            spans.append((at + len(head), at + len(whole) - 1))
        out.append(whole)
        at += len(whole)
    return "".join(out), spans


def common_prefix(a: list[dict], b: list[dict]) -> int:
    """Turns at the start that have equal roles and texts."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if (x["role"], x["text"]) != (y["role"], y["text"]):
            break
        n += 1
    return n


def _row(chosen: list[dict], rejected: list[dict] | None, observed: bool) -> tuple:
    if rejected is None:  # alone: all before the last turn of the assistant is the prompt
        last = [k for k, t in enumerate(chosen) if t["role"] == LEARNED]
        n = last[-1] if last else len(chosen)
    else:
        n = common_prefix(chosen, rejected)
    prompt, _ = render(chosen[:n])
    good, good_mask = render(chosen[n:])
    bad, bad_mask = (None, None) if rejected is None else render(rejected[n:])
    write = lambda m: None if m is None else ",".join(f"{s}:{e}" for s, e in m)
    status = "single" if rejected is None else "equal" if not good and not bad else "pair" if observed else "derived"
    return n, prompt, good, write(good_mask), bad, write(bad_mask), status


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), *[pa.string()] * 6]
    names = ["chosen_id", "rejected_id", "prefix_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask", "status"]
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            b = whole.slice(k, ROWS)
            rows = [_row(*x) for x in zip(b.column("chosen_turns").to_pylist(), b.column("rejected_turns").to_pylist(), b.column("observed").to_pylist(), strict=True)]
            made = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("chosen_id"), b.column("rejected_id"), *made], names)


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (chosen_id, rejected_id, chosen_turns, rejected_turns, and optionally observed) as training rows.

    The longest common prefix of turns is rendered once, as prompt; chosen and rejected are what follows it, with masks: start:end of the
    assistant's spans in them, in code points. Status: 'pair', or 'derived' where `observed` is false; two equal conversations
    ('equal') have empty completions; without rejected turns ('single') the prompt ends before the last turn of the assistant.

    No turns render as empty; ids may be null; repeated rows stay; conversations are rendered whole, however long; an empty table gives an empty result;
    further columns are ignored, whatever their names.
    """
    kind = pairs.schema["chosen_id"].dataType.simpleString()
    seen = F.coalesce("observed", F.lit(True)) if "observed" in pairs.columns else F.lit(True)
    p = pairs.select("chosen_id", "rejected_id", F.coalesce("chosen_turns", F.array().cast(pairs.schema["chosen_turns"].dataType)).alias("chosen_turns"), "rejected_turns", seen.alias("observed"))
    return p.mapInArrow(_format, f"chosen_id {kind}, rejected_id {kind}, prefix_turns int, prompt string, chosen string, chosen_mask string, rejected string, rejected_mask string, status string")


def _before_answer(turns: Column) -> Column:
    """128 bits that stand for the roles and texts before the assistant's first turn; null where none comes before, or no such turn."""
    answers = F.array_position(F.transform(turns, lambda t: t["role"]), LEARNED)
    before = F.transform(F.slice(turns, F.lit(1), F.greatest(answers - 1, F.lit(0)).cast("int")), lambda t: F.struct(t["role"], t["text"]))
    return F.when(answers > 1, F.struct(F.xxhash64(before).alias("x"), F.xxhash64(F.lit(1), before).alias("y")))


def _agree(a: Column, b: Column) -> Column:
    """Whether two conversations are alternatives: equal, or alike up to a turn that in both is the assistant's."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    at = F.array_position(same, False).cast("int")  # the first turn that differs, from 1; 0 if none does
    answer = lambda c: F.coalesce(F.get(c, at - 1)["role"] == LEARNED, F.lit(False))
    return (at == 0) | answer(a) & answer(b)


def unfinished(turns: Column) -> Column:
    """The turns with the assistant's last one cut after half its characters, rounded down; null where there is none or it is empty."""
    last = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == LEARNED, i)))
    cut = F.transform(turns, lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == last, F.left(t["text"], F.floor(F.length(t["text"]) / 2).cast("int"))).otherwise(t["text"]).alias("text")))
    return F.when(F.get(turns, last)["text"] != "", cut)


def preference_rows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", score: str | None = None) -> DataFrame:
    """Preference rows from a table of turns.

    Conversations that share all turns before the assistant's first one are tried as alternatives: the one with the highest score (a column of the
    turns, if named; else, and among equal ones, the smallest id) is chosen, and each other one is rejected against it if their
    longest common prefix ends before a turn that is the assistant's in both ('pair'), or if they are equal ('equal'); where
    it ends before a turn of the user they answer different questions. Every conversation in no such pair is set against a
    variant of itself, whose last answer breaks off after half its characters ('derived', rejected_id null); without an answer it is a
    'single' row. So every conversation is in the result, which has at most as many rows as there are conversations. The
    chosen one of a group is found by partial aggregation, and its join to a large group can be split anywhere.

    Null roles and texts count as empty; each row without an id is a conversation of its own; repeated rows are further turns; a conversation is
    one row of the result and is rendered whole, however long; empty tables give an empty result; further columns are ignored, whatever their names.
    """
    c = conversations_of(turns, conv_id, turn, role, text, score)
    rank = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("s"), "conv_id")
    c = save(c.select("conv_id", "turns", rank.alias("rank"), F.when(F.col("conv_id").isNotNull(), _before_answer(F.col("turns"))).alias("prompt")))
    groups = c.where("prompt is not null").groupBy("prompt").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = save(groups.where("n > 1").select(F.col("prompt").alias("of"), F.col("first.conv_id").alias("chosen_id")))
    grouped = c.join(broadcast_if_small(shared), F.expr("prompt = of"))
    chosen = grouped.where("conv_id = chosen_id").select("of", "chosen_id", F.col("turns").alias("chosen_turns"))
    tried = grouped.where("conv_id <> chosen_id").select("of", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected_turns")).join(chosen, "of")
    pair = tried.where(_agree(F.col("chosen_turns"), F.col("rejected_turns"))).select("chosen_id", "rejected_id", "chosen_turns", "rejected_turns", F.lit(True).alias("observed"))
    found = save(pair.select("chosen_id", "rejected_id"))
    taken = found.select(F.col("rejected_id").alias("id")).union(found.select("chosen_id")).distinct()
    alone = c.join(broadcast_if_small(save(taken)), F.expr("conv_id = id"), "left_anti")
    alone = alone.select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast(c.schema["conv_id"].dataType).alias("rejected_id"), F.col("turns").alias("chosen_turns"), unfinished(F.col("turns")).alias("rejected_turns"), F.lit(False).alias("observed"))
    return format_pairs(pair.unionByName(alone))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_rows(load(spark, sf_dir, "conversations"))


_WRITE = "concat('<|im_start|>', x.role, chr(10), x.text, '<|im_end|>', chr(10))"


def _shown(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda x: {_WRITE}), '')"


def _masks(turns: str) -> str:
    upto = lambda n: f"CAST(coalesce(list_sum(list_transform({turns}[1:{n}], lambda x: length({_WRITE}))), 0) AS BIGINT)"
    span = f"concat({upto('i - 1')} + length('<|im_start|>') + length({turns}[i].role) + 1, ':', {upto('i')} - 1)"
    return f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = '{LEARNED}'), lambda i: {span}), ',')"


_TURN = "{'at': coalesce(turn, -9223372036854775808), 'role': coalesce(role, ''), 'text': coalesce(text, '')}"
_SAID = "lambda x: {'role': x.role, 'text': x.text}"
#: The same rows from DuckDB.
SQL = f"""
WITH c AS (SELECT conv_id, list_sort(list({_TURN})) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id UNION ALL SELECT conv_id, [{_TURN}] FROM conversations WHERE conv_id IS NULL),
l AS (SELECT *, list_filter(range(1, len(ts) + 1), lambda i: ts[i].role = '{LEARNED}') AS answers FROM c),
o AS (SELECT *, CASE WHEN conv_id IS NOT NULL AND answers[1] > 1 THEN list_transform(ts[1:answers[1] - 1], {_SAID}) END AS k FROM l),
g AS (SELECT k, min(conv_id) AS first_id FROM o WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
t AS (SELECT f.conv_id AS chosen_id, o.conv_id AS rejected_id, f.ts AS a, o.ts AS b FROM o JOIN g ON o.k = g.k JOIN o f ON f.conv_id = first_id WHERE o.conv_id <> first_id),
n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: list_transform(a[1:i], {_SAID}) = list_transform(b[1:i], {_SAID}))) AS n FROM t),
p AS (SELECT *, n = len(a) AND n = len(b) AS equal FROM n WHERE n = len(a) AND n = len(b) OR n < least(len(a), len(b)) AND a[n + 1].role = '{LEARNED}' AND b[n + 1].role = '{LEARNED}'),
alone AS (SELECT conv_id, ts, answers, len(answers) > 0 AND ts[answers[-1]].text <> '' AS answered FROM o WHERE conv_id IS NULL OR conv_id NOT IN (SELECT chosen_id FROM p) AND conv_id NOT IN (SELECT rejected_id FROM p)),
r AS (SELECT chosen_id, rejected_id, a, b, n, CASE WHEN equal THEN 'equal' ELSE 'pair' END AS status FROM p UNION ALL
  SELECT conv_id, NULL, ts, CASE WHEN answered THEN list_transform(ts, lambda x, i: {{'at': x.at, 'role': x.role, 'text': CASE WHEN i = answers[-1] THEN left(x.text, length(x.text) // 2) ELSE x.text END}}) END,
    coalesce(answers[-1] - 1, len(ts)), CASE WHEN answered THEN 'derived' ELSE 'single' END FROM alone),
s AS (SELECT *, a[1:n] AS head, a[n + 1:] AS good, b[n + 1:] AS bad FROM r)
SELECT chosen_id, rejected_id, CAST(n AS INTEGER) AS prefix_turns, {_shown('head')} AS prompt, {_shown('good')} AS chosen, {_masks('good')} AS chosen_mask,
  CASE WHEN b IS NOT NULL THEN {_shown('bad')} END AS rejected, CASE WHEN b IS NOT NULL THEN {_masks('bad')} END AS rejected_mask, status
FROM s
"""
