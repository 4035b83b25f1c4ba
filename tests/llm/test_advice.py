"""What a review of round 1 found missing."""

import math
from collections import Counter

import pytest

import corpus_pipeline
from sumweave.llm import html_text, lm, simhash, toxicity

PROSE = "The quick brown fox jumps over the lazy dog while seven grey geese cross the cold river near our old mill and nobody minds them at all today."
OTHER = "Bakers in the northern valley weigh their flour twice before dawn, since damp sacks from the barge have often cheated them of a loaf."
THIRD = "A tall lamp stood beside the green door; nobody had lit it since the year when both ferries stopped and the harbour filled with sand."


def test_rows_with_null_or_repeated_ids_stay_apart(spark, tmp_path):
    docs = spark.createDataFrame([(None, PROSE), (None, OTHER), (None, OTHER), (5, THIRD), (5, "one two three four"), (7, THIRD)], "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, PROSE), (None, OTHER), (5, THIRD), (5, "one two three four")], key=str)
    spark.createDataFrame([(1, OTHER)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = docs.union(spark.createDataFrame([(5, OTHER)], docs.schema))
    clean = [tuple(r) for r in corpus_pipeline.decontamination(spark, more, str(tmp_path)).collect()]
    assert sorted(clean, key=str) == sorted([(None, PROSE), (5, THIRD), (5, "one two three four"), (7, THIRD)], key=str)


def test_toxicity_reads_long_words_to_their_end():
    scorer = toxicity.Scorer(toxicity.Network.new({}))
    a, b = scorer.raw(["_".join(["abcde"] * 40) + x for x in ("_kindly_put", "_wretched!")])
    assert abs(a - b) > 1e-4
    word = "".join(chr(0x4E00 + k) for k in range(1000))
    for n in (41, 75, 76, 110, 111, 1000):
        pieces = [toxicity.core_of(x) for x in toxicity.inputs_of(word[:n])]
        assert all(len(p) <= toxicity.LONG for p in pieces)
        assert all(any(word[k : k + 6] in p for p in pieces) for k in range(n - 5))
    assert toxicity.inputs_of(f"one {'.' * 60} two") == ["one", ("",), "two"]


def test_end_is_known_below_the_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 2)
    monkeypatch.setattr(lm, "STEPS", 20)
    texts = {0: "a b c d " * 50, 2: "a b c e " * 50}  # neither is held out
    c = Counter(w for t in texts.values() for w in [*t.split(), ""])
    n, v = sum(c.values()), len(c)
    for r in lm.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        words = [*texts[r["doc_id"]].split(), ""]
        assert r["n_known"] == len(words)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)) < 1e-6


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='content has-sidebar'><p>{0}</p></div></body>",
        "<body><main class='no-sidebar'><p>{0}</p></main></body>",
        "<body><article class='post comments-open social'><p>{0}</p></article></body>",
        "<body><article><section id='search-index'><p>{0}</p></section></article></body>",
        "<body><div class='widget'><p>{0}</p></div><div class='ad'>buy</div></body>",
        "<body><div class='sidebar'><article><p>{0}</p></article></div></body>",
        "<body><article><p>{0}</p></article><div class='comments'><p>{0} said one</p><p>{0} said two</p></div></body>",
    ],
)
def test_names_of_wrappers_lose_no_article(page):
    assert html_text.main_text(page.format(PROSE)) == PROSE
    assert html_text.main_text(f"<article><h2 id='related'>Head</h2><p>{PROSE}</p></article>") == f"Head\n{PROSE}"
