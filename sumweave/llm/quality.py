"""Quality rules by weak supervision, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CLASS, let, load, save, window_hashes, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
EM_ROUNDS = 25
#: The rules, and the kind of junk that each looks for. They vote 1 for good, 0 for bad, null for no opinion.
RULES = {
    "length": "form", "word_length": "form", "capitals": "form", "line_ends": "form", "short_lines": "form",
    "symbols": "symbols", "symbol_words": "symbols",
    "duplicate_lines": "repetition", "repetition": "repetition", "echoes": "repetition", "variety": "repetition",
}
KINDS = ("form", "symbols", "repetition")
VOTES = [f"_vote_{x}" for x in RULES]
#: Where EM starts: share of good documents, how often a rule votes bad in its own kind of junk, and elsewhere. PSEUDO documents vote so beforehand.
GOOD, HIT, ERROR, PSEUDO = 0.85, 0.6, 0.05, 2.0


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice in the text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == e["h"])))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
            merge = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).cast("long").alias("n"), p.alias("at"))
            return F.aggregate(F.sort_array(F.transform(same, lambda e: e["i"])), start, merge, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, spans))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(window_hashes(words, WINDOW), covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column `_q`: the base measures and those that only rules use. A null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        of_lines = lambda x: F.struct(
            F.size(x).alias("all"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            F.size(F.filter(x, lambda y: ~y.rlike(rf"[^\x20\x09-\x0D](?:{BLANK_CLASS}+[^\x20\x09-\x0D]+){{3}}"))).alias("short"),
            F.size(F.filter(x, lambda y: y.rlike(rf"[.!?][\"')\]]*{BLANK_CLASS}*\z"))).alias("ended"),
        )
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(t) - F.regexp_count(t, F.lit(BLANK_CLASS))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, of_lines).alias("lines"),
            _repeated_words(words).alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
            F.regexp_count(t, F.lit(rf"[#*$%&|<>](?={BLANK_CLASS}|\z)")).cast("long").alias("n_symbol_words"),
            F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))).cast("long").alias("n_echoes"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    return docs.withColumn("_q", let(words_of(t), of))


def conditions() -> dict[str, tuple[str, str]]:
    """For each rule the condition of a bad vote, and otherwise that of a good one, in SQL over the measures; with neither it abstains."""
    return {
        "length": (f"n_words < {MIN_WORDS}", "n_words >= 50"),
        "word_length": ("word_chars < 2 * n_words OR word_chars > 20 * n_words", "2 * word_chars >= 5 * n_words AND word_chars <= 12 * n_words AND n_words > 0"),
        "capitals": ("10 * n_capitals > 4 * word_chars", "10 * n_capitals < 2 * word_chars"),
        "line_ends": ("2 * n_ended < n_lines", "10 * n_ended >= 9 * n_lines"),
        "short_lines": ("5 * n_short > n_lines", "10 * n_short <= n_lines"),
        "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
        "symbol_words": ("10 * n_symbol_words > n_words", "50 * n_symbol_words <= n_words"),
        "duplicate_lines": ("10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 1", "10 * n_dup_lines <= n_lines"),
        "repetition": (f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words", "10 * n_repeat_words <= n_words"),
        "echoes": ("10 * n_echoes > n_words", "50 * n_echoes <= n_words"),
        "variety": (f"2 * n_distinct < n_words AND n_words >= {MIN_WORDS}", f"10 * n_distinct >= 6 * n_words OR n_words < {MIN_WORDS}"),
    }


@dataclass
class Model:
    """What EM has found: shares of good documents and of each kind of junk; for each rule how often it votes bad in its kind, and elsewhere."""

    shares: np.ndarray
    hits: np.ndarray
    errors: np.ndarray

    def rates(self, c: int) -> np.ndarray:
        """Bad votes of each rule in a class: 0 is good, then KINDS."""
        own = np.array([c > 0 and k == KINDS[c - 1] for k in RULES.values()])
        return np.where(own, self.hits, self.errors)


def estimate(patterns: dict[tuple, int], rounds: int = EM_ROUNDS) -> Model:
    """EM for the accuracies of rules that vote independently, given the class of a document: good, or one kind of junk.

    Kinds of junk exclude each other, so two classes would follow the commonest kind alone. A rule votes bad at one rate in its own kind and
    at another, its error rate, in good documents and all other kinds alike; whether it abstains says nothing. Rules are told apart
    by their agreement: a rule whose bad votes no other rule of its kind shares gets an error rate as high as they are frequent, and
    a lone bad vote of it is overruled. No rule is taken to do worse than chance: its hit rate is at least its error rate.
    PSEUDO documents are all that is believed beforehand. patterns counts documents by their votes, at most
    3 ** len(RULES) entries, whatever the size of the corpus; of the same counts in another order come the same rates.
    """
    keys = sorted(patterns, key=str)
    n = np.array([patterns[k] for k in keys], float)
    bad = np.array([[v == 0 for v in k] for k in keys], float).reshape(len(keys), len(RULES))
    voted = np.array([[v is not None for v in k] for k in keys], float).reshape(bad.shape)
    first = np.array([GOOD] + [(1 - GOOD) / len(KINDS)] * len(KINDS))
    own_class = [KINDS.index(k) + 1 for k in RULES.values()]
    model = Model(first, np.full(len(RULES), HIT), np.full(len(RULES), ERROR))
    for _ in range(rounds):
        odds = np.empty((len(keys), len(first)))
        for c in range(len(first)):
            r = model.rates(c)
            odds[:, c] = model.shares[c] * np.exp(bad @ np.log(r) + (voted - bad) @ np.log(1 - r))
        mass = odds / odds.sum(axis=1, keepdims=True) * n[:, None]
        own = mass[:, own_class]
        rest = n[:, None] - own
        hits = ((own * bad).sum(axis=0) + PSEUDO * HIT) / ((own * voted).sum(axis=0) + PSEUDO)
        errors = ((rest * bad).sum(axis=0) + PSEUDO * ERROR) / ((rest * voted).sum(axis=0) + PSEUDO)
        model = Model((mass.sum(axis=0) + PSEUDO * first) / (n.sum() + PSEUDO), np.maximum(hits, errors), errors)
    return model


def _judged(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, the base measures, and one column for each vote."""
    q = measure(docs).select(*keep, "_q.*")
    of_lines = {"n_dup_lines": "dup", "n_lines": "all", "n_short": "short", "n_ended": "ended"}
    base = ("n_words", "word_chars", "n_symbols", "n_repeat_words")
    q = q.select(*keep, *base, "n_capitals", "n_symbol_words", "n_echoes", "n_distinct", *(F.col(f"lines.{x}").cast("long").alias(n) for n, x in of_lines.items()))
    votes = (F.when(F.expr(b), 0).when(F.expr(g), 1).cast("int").alias(f"_vote_{r}") for r, (b, g) in conditions().items())
    return q.select(*keep, *base, "n_dup_lines", *votes)


def learn(judged: DataFrame) -> Model:
    """The model of a judged table's votes; only counts by vote pattern reach the driver."""
    return estimate({tuple(r[:-1]): r[-1] for r in judged.groupBy(*VOTES).agg(F.count(F.lit(1))).collect()})  # 3 ** 11 rows at most


def _with_verdict(q: DataFrame, model: Model) -> DataFrame:
    odds = []
    for c, share in enumerate(model.shares):
        log = F.lit(math.log(share))
        for name, r in zip(VOTES, model.rates(c), strict=True):
            log = log + F.when(F.col(name) == 0, math.log(r)).when(F.col(name) == 1, math.log(1 - r)).otherwise(0.0)
        odds.append(F.exp(log))
    good = odds[0] / sum(odds[1:], odds[0])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    q = q.withColumn("probability", good).withColumn("base_failed", failed)
    return q.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Posterior probability that each document is good, from rules that vote or abstain.

    EM estimates from the votes of all documents how reliable each rule is (`estimate`); documents are kept at a
    probability of 0.5 or more unless the base rules fail. Only counts by vote pattern reach the driver.

    Returns a row for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    probability. Null, empty and blank texts have no words and fail; texts are measured whole, however long; a probability of just 0.5
    keeps; repeated rows get equal rows; a null id stays null; an empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    q = save(_judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id"))
    return _with_verdict(q, learn(q)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps.

    The row travels beside its votes through one saved table, so that measures are computed once, no join is needed and the second plan is small. Null and
    blank texts go; repeated rows go or stay together; columns of any name stay as they are; an empty table gives an empty result.
    """
    q = save(_judged(docs.select(F.struct("*").alias("_row"), F.col(text).alias("text")), "_row"))
    return _with_verdict(q, learn(q)).where("kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def sql() -> str:
    """The same for DuckDB, EM included: a few common table expressions for each round, over the vote patterns."""
    rules = ", ".join(f"CASE WHEN {b} THEN 0 WHEN {g} THEN 1 ELSE 2 END AS v{k}" for k, (b, g) in enumerate(conditions().values()))
    kinds = [KINDS.index(k) + 1 for k in RULES.values()]
    pattern = ", ".join(f"v{k}" for k in range(len(RULES)))
    votes = " UNION ALL ".join(f"SELECT p, n, {k} AS k, v{k} AS v FROM pat" for k in range(len(RULES)))
    start = ", ".join(f"({k}, {c}, {HIT}e0, {ERROR}e0)" for k, c in enumerate(kinds))
    first = ", ".join(f"({c}, {GOOD if c == 0 else (1 - GOOD) / len(KINDS)!r}e0)" for c in range(len(KINDS) + 1))
    rounds = []
    for t in range(EM_ROUNDS + 1):
        rate = "CASE WHEN m.kind = s.c THEN m.hit ELSE m.err END"
        rounds.append(f"odds{t} AS MATERIALIZED (SELECT p, s.c, any_value(s.s) * exp(sum(CASE v WHEN 0 THEN ln({rate}) WHEN 1 THEN ln(1 - {rate}) ELSE 0 END)) AS x FROM votes JOIN model{t} m USING (k), share{t} s GROUP BY p, s.c)")
        rounds.append(f"post{t} AS MATERIALIZED (SELECT p, c, x / sum(x) OVER (PARTITION BY p) AS x FROM odds{t})")
        if t < EM_ROUNDS:
            rounds.append(f"share{t + 1} AS MATERIALIZED (SELECT f.c, (coalesce(m.s, 0) + {PSEUDO}e0 * f.s) / ((SELECT coalesce(sum(n), 0) FROM pat) + {PSEUDO}e0) AS s FROM first f LEFT JOIN (SELECT c, sum(n * x) AS s FROM post{t} JOIN pat USING (p) GROUP BY c) m USING (c))")
            sums = "sum(n * x) FILTER (v = 0) AS ob, sum(n * x) FILTER (v <> 2) AS ov, sum(n * (1 - x)) FILTER (v = 0) AS rb, sum(n * (1 - x)) FILTER (v <> 2) AS rv"
            rounds.append(f"seen{t} AS MATERIALIZED (SELECT k, b.kind, {sums} FROM start b LEFT JOIN (votes JOIN post{t} USING (p)) q USING (k) WHERE q.c = b.kind OR q.c IS NULL GROUP BY k, b.kind)")
            hit, err = f"(coalesce(ob, 0) + {PSEUDO * HIT!r}e0) / (coalesce(ov, 0) + {PSEUDO}e0)", f"(coalesce(rb, 0) + {PSEUDO * ERROR!r}e0) / (coalesce(rv, 0) + {PSEUDO}e0)"
            rounds.append(f"model{t + 1} AS MATERIALIZED (SELECT k, kind, greatest({hit}, {err}) AS hit, {err} AS err FROM seen{t})")
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, doc_id, t, regexp_extract_all(t, '{word}+') AS w FROM texts),
grams AS (SELECT id, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i) WHERE len(w) >= {WINDOW}),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM grams) q WHERE n > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY id),
lines AS (SELECT id, count(*) AS n, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (len(regexp_extract_all(l, '{word}+')) < 4) AS short, count(*) FILTER (regexp_matches(l, '[.!?]["'')\]]*[\x20\x09-\x0D]*$')) AS ended
  FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM texts) q WHERE regexp_matches(l, '{word}') GROUP BY id),
q AS (SELECT w.id, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(lines.short, 0) AS n_short, coalesce(lines.ended, 0) AS n_ended, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) AS n_symbol_words, len(list_filter(list_zip(w[2:], w), lambda x: x[1] = x[2])) AS n_echoes, len(list_distinct(w)) AS n_distinct
  FROM w LEFT JOIN lines USING (id) LEFT JOIN covered USING (id)),
voted AS MATERIALIZED (SELECT *, {rules} FROM q),
pat AS MATERIALIZED (SELECT row_number() OVER () AS p, * FROM (SELECT {pattern}, count(*) AS n FROM voted GROUP BY {pattern}) g),
votes AS MATERIALIZED ({votes}),
start AS MATERIALIZED (SELECT * FROM (VALUES {start}) AS x(k, kind, hit, err)),
first AS MATERIALIZED (SELECT * FROM (VALUES {first}) AS x(c, s)),
model0 AS MATERIALIZED (SELECT k, kind, hit, err FROM start),
share0 AS MATERIALIZED (SELECT c, s FROM first),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x >= 0.5 AS kept, round(x, 6) AS probability
FROM (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED_PERCENT} AS base_failed FROM voted) d JOIN pat USING ({pattern}) JOIN post{EM_ROUNDS} USING (p) WHERE c = 0
"""
