"""Operators and the pipeline on small tables: plain versions, nulls, empty and repeated rows, clashing columns, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sumweave.llm import bpe, chat, decontaminate, html_text, licenses, lm, pii, quality, simhash, toxicity
from sumweave.llm.common import components, load
from sumweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
CLASHING = "h int, n int, hash int, word int, row int, unit int, c int, fp int, component int, _q int, label int, held_out int, score int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
PROSE = "The quick brown fox jumps over the lazy dog while seven grey geese cross the cold river near our old mill and nobody minds them at all today."


def rows(*texts):
    return [(i, t, "en", "s", None if t is None else len(t)) + (0,) * 13 for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, ties and a very long text."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    texts = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (None, PROSE.upper()), (None, None), (6, long), (7, "mail a.b@c.de 10.0.0.1"), (8, "line one\nline one\n\nline two ***")]
    return spark.createDataFrame(rows(*texts), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return load(spark, FOLDER, "documents")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def linked(keys, near):
    """Smallest reachable key for each."""
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def plain_fp(t):
    w = words(lower(t))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(e).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(e.limit(0)).count() == 0


def test_simhash(spark, docs):
    found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op2_simhash(spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fp = {i: plain_fp(t) for i, t in texts.items()}
    assert {i: v[0] for i, v in found.items()} == fp
    assert {i: v[1] for i, v in found.items()} == linked(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)


@pytest.mark.parametrize("bucket", [2, 4096])
def test_simhash_splits_large_buckets(spark, bucket):
    values = [(5 << 40) ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)] + [1 << 50, 3 << 50, 77]
    n = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.trie_links(n, 3, bucket)).collect()}
    want = linked(sorted(values), lambda a, b: (a ^ b).bit_count() <= 3)
    sizes = Counter(want.values())
    assert found == {k: v for k, v in want.items() if sizes[v] > 1}


def test_simhash_of_odd_rows(odd, none):
    found = sorted(((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()))
    assert len(found) == 11
    assert {c for i, f, c in found if f == 0} == {3} and sum(f == 0 for _, f, _ in found) == 4
    assert {c for i, _, c in found if i in (1, 2)} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 8]


def plain_repeats(w):
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)})


def test_quality(spark, docs, odd, none):
    for table in (docs, odd):
        texts = Counter((r["doc_id"], r["text"]) for r in table.collect())
        want = Counter()
        for (i, t), n in texts.items():
            w = words(t)
            lines = [x for x in (t or "").split("\n") if words(x)]
            want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), plain_repeats(w), len(w) < 20 or 100 * plain_repeats(w) > 30 * len(w))] += n
        found = quality.quality_rules(table).collect()
        assert Counter(tuple(r)[:7] for r in found) == want
        assert all(not r["kept"] or not r["base_failed"] for r in found)
    assert quality.quality_rules(none).count() == 0
    kept = quality.keep_good(docs)
    verdicts = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == verdicts
    y = load(spark, FOLDER, "labels").join(kept.select("doc_id"), "doc_id").agg(F.avg("quality")).first()[0]
    assert y > 0.95


def test_quality_agrees_better_with_labels_than_all_must_pass(spark):
    folder = "/root/testdata/sf0.01"
    q = quality._judged(load(spark, folder, "documents"), "doc_id")
    every = F.lit(True)
    for v in quality.VOTES:
        every = every & ~F.col(v).eqNullSafe(0)
    judged = quality._with_verdict(q, quality.learn(q)).withColumn("every", every & ~F.col("base_failed"))
    r = judged.join(load(spark, folder, "labels"), "doc_id").where("not base_failed").select("kept", "every", "quality").collect()
    right, plain = (sum(x[k] == bool(x["quality"]) for x in r) / len(r) for k in ("kept", "every"))
    assert right > 0.98 and right > plain + 0.03


def test_contained_items(spark, docs, odd, none):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, "one two"), (None, "fox jumps over the lazy dog while"), (5, "nothing of this is there at all")], "item_id long, text string")
    more = spark.createDataFrame(rows((10, f"before {PROSE.lower()} after"), (11, "One  two"), (12, "one two three"), (13, PROSE.replace("river", "stream"))), SCHEMA)
    found = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contained_items(odd.union(more), items).collect()}
    n = len(words(PROSE)) - 4  # the changed word of document 13 takes 5 of 24: below 0.8
    short = {(i, None, 3, 3) for i in (1, 2, 10, 13, None)}
    assert found == {(i, 1, n, n) for i in (1, 2, 10, None)} | {(11, 3, 1, 1), (12, 3, 1, 1)} | short
    assert decontaminate.contained_items(none, items).count() == decontaminate.contained_items(odd, items.limit(0)).count() == 0
    kept = decontaminate.without_leaks(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 8}


def plain_contained(docs, items, threshold=0.8):
    """(doc, item): (n_item, n_shared) by definition."""
    grams = lambda w, z: {tuple(w[k : k + z]) for k in range(len(w) - z + 1)}
    out = {}
    for i, t in items:
        w = words(lower(t))
        z = min(5, len(w))
        mine = grams(w, z) if w else set()
        for j, u in docs:
            both = len(mine & grams(words(lower(u)), z)) if mine else 0
            if mine and both / len(mine) >= threshold:
                out[j, i] = max(out.get((j, i), (0, 0)), (both / len(mine), both, len(mine)))
    return {k: v[1:] for k, v in out.items()}


@pytest.mark.parametrize("bytes_", [1 << 30, 0])
def test_contained_items_of_all_sizes_against_plain_version(spark, monkeypatch, bytes_):
    """Items of 1 to 60 words, with changes, in documents up to 3,000 words; equal texts, shared and null ids; with and without broadcasts."""
    import random

    from sumweave.llm import common

    monkeypatch.setattr(common.broadcast_if_small, "__defaults__", (bytes_,))
    r = random.Random(8)
    said = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(said(n))) for k, n in enumerate([1, 1, 2, 2, 3, 4, 4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 40, 60])]
    items += [(90, items[9][1].upper()), (91, items[9][1]), (None, items[12][1]), (92, ""), (93, None)]
    docs = []
    for k in range(120):
        w = said(r.choice([0, 3, 50, 400, 3000]))
        for _ in range(r.randrange(4)):
            t = r.choice(items)[1] or ""
            part = [x if r.random() > 0.03 else "changed" for x in t.split()]
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((None if k % 10 == 0 else k // 2, " ".join(w)))
    docs += docs[:5] + [(7, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): (x["n_shared"], x["n_item"]) for x in decontaminate.contained_items(d, i).collect()}
    assert found == plain_contained(docs, items) and len(found) > 150


def test_licenses(spark, odd, none):
    files = spark.createDataFrame(
        [
            (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
            (2, "a/b/x.py", "no header"),
            (3, "a/b/y.py", "# Released under the MIT License.\ncode"),
            (4, "a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            (5, "a/c/d/z.py", None),
            (6, "q.py", "x"),
            (7, None, "Licensed under CC BY-NC 4.0."),
            (3, "a/b/y.py", "# Released under the MIT License.\ncode"),
        ],
        "key long, path string, text string",
    ).withColumn("unit", F.lit(1))
    found = Counter((r["key"], r["license"], r["origin"]) for r in licenses.scan_licenses(files).collect())
    assert found == Counter(
        {(1, "Apache-2.0", "own"): 1, (2, "Apache-2.0", "inherited"): 1, (3, "MIT", "own"): 2, (4, "GPL-3.0", "own"): 1, (5, "GPL-3.0", "inherited"): 1, (6, None, "none"): 1, (7, "CC-BY-NC-4.0", "own"): 1}
    )
    assert licenses.scan_licenses(files.limit(0)).count() == 0
    assert licenses.scan_licenses(licenses.document_files(odd), key="doc_id").count() == 11
    assert licenses.scan_licenses(licenses.document_files(none), key="doc_id").count() == 0


def plain_license(text, whole=False, threshold=licenses.THRESHOLD):
    """The best template of a text from all its units, by the formula and without bounds."""
    vectors, idf = licenses.template_weights()
    top = math.log(1 + len(vectors)) + 1
    lines = [x for x in text.split("\n") if re.search("[A-Za-z0-9]", x)]
    units = [" ".join(lines[i : i + n]) for n in range(1, licenses.LINES + 1) for i in range(len(lines) - n + 1)]
    units += re.split(r"\n(?:[^A-Za-z0-9\n]*\n)+", text) + [m[1] for m in re.finditer(licenses._COMMENT, text)] + [text] * whole
    best = (threshold, "")
    for u in set(units):
        raw = {t: (1 + math.log(n)) * idf.get(t, top) for t, n in Counter(re.findall(licenses.TOKEN, u.lower())).items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        best = max(best, *((round(sum(raw.get(t, 0.0) * x for t, x in v.items()) / norm, 9), n) for n, v in vectors))
    return best[1] or None


MIT_FILE = f"MIT License\n\nCopyright (c) 2019 A. Person\n\n{licenses._MIT}\n\n{licenses._MIT_NOTICE}\n\n{licenses._WARRANTY}\n"
HEADERS = {
    "SPDX-License-Identifier: Apache-2.0\nint main() {}": "Apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": "GPL-2.0",
    "#!/bin/sh\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\necho hello world": "GPL-3.0",
    "/*\n * Copyright 2020 Somebody\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *   http://www.apache.org/licenses/LICENSE-2.0\n */\npackage x;": "Apache-2.0",
    "-- This Source Code Form is subject to the terms of the Mozilla Public\n-- License, v. 2.0. If a copy of the MPL was not distributed with this\n-- file, You can obtain one at https://mozilla.org/MPL/2.0/.\nSELECT 1": "MPL-2.0",
    MIT_FILE: "MIT",
    f"Copyright 2001 X\n\n{licenses._BSD}\n\n{licenses._BSD_1}\n{licenses._BSD_2}\n{licenses._BSD_3}\n\n{licenses._BSD_WARRANTY}": "BSD-3-Clause",
    "some text\nReleased under the MIT License.": "MIT",
    "the driver has a public license to work under the terms of this county": None,
    "All rights reserved. No license is granted.": None,
}


def test_licenses_of_headers_and_whole_texts(spark):
    import glob

    texts = list(HEADERS)
    wanted = list(HEADERS.values())
    for f in sorted(glob.glob("/usr/share/common-licenses/*-[0-9]*")):  # where the system has them
        with open(f, errors="replace") as text:
            texts.append(text.read())
        wanted.append({"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}.get(f.rsplit("/", 1)[1], "?"))
    files = spark.createDataFrame([(k, f"d{k}/{'LICENSE' if '\n\n' in t else 'x.c'}", t) for k, t in enumerate(texts)], "key long, path string, text string")
    found = {r["key"]: r["license"] for r in licenses.scan_licenses(files).collect()}
    for k, (t, w) in enumerate(zip(texts, wanted, strict=True)):
        assert found[k] == plain_license(t, "\n\n" in t)
        assert w == "?" or found[k] == w


def test_license_bounds_lose_no_match(spark):
    """Templates with words left out, changed and added, against the plain formula."""
    import random

    r, texts = random.Random(6), []
    for _ in range(400):
        words = r.choice(licenses.TEMPLATES)[1].split()
        words = [w for w in words if r.random() > 0.12] + [f"other{r.randrange(50)}" for _ in range(r.choice([0, 0, 1, 2, 5]))]
        texts.append(" ".join(["prose of one kind"] * r.choice([0, 0, 1]) + words[: len(words) // 2] + r.choice([[], ["\n"], ["\n#"]]) + words[len(words) // 2 :]))
    files = spark.createDataFrame([(k, f"d{k}/x.c", t) for k, t in enumerate(texts)], "key long, path string, text string")
    found = {r["key"]: r["license"] for r in licenses.scan_licenses(files).collect()}
    want = {k: plain_license(t) for k, t in enumerate(texts)}
    assert found == want and 100 < sum(x is not None for x in want.values()) < 390


def test_documents_inherit_within_their_directory(spark):
    rows = licenses.op8_licenses(spark, "/root/testdata/sf0.01").collect()
    given = {r["path"].rsplit("/", 1)[0]: r["license"] for r in rows if "/LICENSE." in r["path"] and r["origin"] == "own"}
    inherited = [r for r in rows if r["origin"] == "inherited"]
    assert len(inherited) > 10 and all(r["path"].rsplit("/", 1)[0] in given and r["score"] is None for r in inherited)
    assert all(r["path"].rsplit("/", 1)[0] not in given for r in rows if r["origin"] == "none")


@pytest.mark.parametrize("frequent", [300_000, 50])
def test_lm_scores(spark, docs, odd, none, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "STEPS", 200)
    for table in (docs, odd):
        data = [(r["doc_id"], r["text"]) for r in table.collect()]
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        tokens = lambda t: [*words(lower(t)), ""]
        c = Counter(w for i, t in data if not held(i) for w in tokens(t))
        n, v = sum(c.values()), len(c)
        want = sorted((i or 0, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in data)
        found = lm.lm_scores(table).collect()
        assert sorted((r[0] or 0, r[1], r[2], r[3], r[4], round(r[5], 4)) for r in found) == want
        assert all(r["score"] < 0 for r in found)
    assert lm.lm_scores(none).count() == 0


def test_lm_scores_against_plain_version(spark, monkeypatch):
    """score by definition from the same model: softmax over classes and over a class's units, word by word."""
    monkeypatch.setattr(lm, "STEPS", 50)
    monkeypatch.setattr(lm, "FREQUENT", 60)
    monkeypatch.setattr(lm, "LEAST_UNITS", 30)
    monkeypatch.setattr(lm, "UNITS_ROOT", 0.0)
    made = {}
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda cells, v: made.setdefault("m", (fit(cells, v), v))[0])
    data = [(0, "a b c a b c A  b d"), (1, "b c d e f a " * 20), (3, None), (4, "ünder über é a b"), (5, " ".join(f"w{k % 90}x a" for k in range(400))), (7, "new unseen words a b"), (11, "w3x w3x zz zz zz")] * 2
    found = {(r["doc_id"]): r["score"] for r in lm.lm_scores(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    model, v = made["m"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in data if not held(i) for w in [*words(lower(t)), ""])
    ranked = sorted((w for w in c if w), key=lambda w: (-c[w], w.encode()))[:30]
    units = {"": 0} | {w: k + 1 + lm.RARES for k, w in enumerate(ranked)}
    rare = lambda w: 1 + zlib.crc32(w.encode()[:2]) % lm.RARES
    mass = Counter()
    for w, n in c.items():
        if w not in units:
            mass[rare(w)] += n + 1
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i, t in data:
        line, total = [*words(lower(t)), ""], 0.0
        u = [0, 0, *(units.get(w, rare(w)) for w in line)]
        for k, w in enumerate(line):
            q = model.context[u[k]] * model.position[0] + model.context[u[k + 1]] * model.position[1]
            of, at = divmod(u[k + 2], model.size)
            part = slice(of * model.size, (of + 1) * model.size)
            p = softmax(model.classes @ q + model.class_bias)[of] * softmax(model.target[part] @ q + model.bias[part])[at]
            total += math.log10(p) + (0 if w in units else math.log10((c[w] + 1) / (mass[rare(w)] + 1)))
        assert found[i] == pytest.approx(total, rel=1e-4), t
    assert len(v.counts) == 1 + lm.RARES + 30


def test_what_the_language_model_learns_grows(spark):
    small, large = (lm.Vocabulary({}, np.zeros(0, np.int32), np.zeros(0), n, 10, np.zeros(2), np.zeros(2)) for n in (10**8, 10**10))
    assert large.drawn * large.total == pytest.approx(10 * small.drawn * small.total)
    rows = spark.range(3_000_000).selectExpr("concat('w', id % 2000) AS word", "id % 7 + 1 AS c").groupBy("word").agg(F.sum("c").alias("c"))
    assert len(lm.vocabulary(rows).counts) - 1 - lm.RARES == 2000


def test_every_training_text_is_learnt(spark, monkeypatch):
    """In a corpus of which one token in ten thousand would be drawn: only contexts that are learnt move their vectors, and noise moves none."""
    made = {}
    vocabulary, fit = lm.vocabulary, lm.fit
    monkeypatch.setattr(lm, "vocabulary", lambda counts: replace(vocabulary(counts), total=10**14))
    monkeypatch.setattr(lm, "fit", lambda lines, v: made.setdefault("m", (fit(lines, v), v))[0])
    data = [(k, f"w{k} x{k} y{k}") for k in range(150)]
    assert lm.lm_scores(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).count() == 150
    model, v = made["m"]
    at = [v.unit[v.words[f"{w}{k}".encode()]] for k, _ in data if zlib.crc32(str(k).encode()) % 7 != 2 for w in "wxy"]
    assert len(set(at)) == len(at) > 300 and min(at) > lm.RARES
    begun = lm.LogBilinear.new(v.counts)
    assert (model.context[at] != begun.context[at]).any(axis=1).mean() == 1


def test_models_of_tasks_are_averaged_by_tokens(spark):
    rows = [(t, p, n, np.full(3, x + p, "<f4").tobytes()) for t, n, x in ((0, 1, 1.0), (1, 3, 5.0)) for p in (1, 0)]
    assert lm.averaged(spark.createDataFrame(rows, "task int, piece int, n long, numbers binary")).tolist() == [4, 4, 4, 5, 5, 5]
    assert lm.averaged(spark.createDataFrame([], "task int, piece int, n long, numbers binary")) is None


def test_noise_is_drawn_by_frequency_within_a_class():
    counts = np.array([50.0, 30, 20, 10, 5, 5, 3, 2, 1, 1, 0])
    noise = lm.Noise.of(counts, 4)
    drawn = noise.units(np.random.default_rng(1), np.repeat([0, 1, 2], 50_000))
    for c in range(3):
        part = counts[c * 4 : c * 4 + 4] + 1
        found = np.bincount(drawn[c * 50_000 : (c + 1) * 50_000].ravel(), minlength=len(counts))
        assert found[c * 4 : c * 4 + 4].sum() == found.sum()
        assert found[c * 4 : c * 4 + 4] / found.sum() == pytest.approx(part / part.sum(), abs=0.01)


def test_lm_beats_base_on_held_out(spark):
    r = lm.op3_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.2


def test_pii(odd, none):
    found = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"]) for r in pii.find_pii(odd).collect()}
    assert (7, 1, 1, 0, 0, "email:5:13,ip:14:22") in found and (3, 0, 0, 0, 0, "") in found
    assert {r["base_sha256"] for r in pii.find_pii(odd).where("doc_id = 7").collect()} == {hashlib.sha256(b"email:5:13,ip:14:22").hexdigest()}
    assert pii.find_pii(none).count() == 0
    out = pii.redact(odd)
    assert out.schema == odd.schema and out.count() == 11
    assert [tuple(r) for r in out.where("doc_id = 7").select("text", "n_chars").collect()] == [("mail <EMAIL> <IP>", 17)]
    assert out.where("doc_id = 3 and text is null").count() == 1 and pii.redact(none).count() == 0


def test_pii_over_a_whole_table(spark):
    """Base columns by plain patterns; every span by the field's decoder on each text alone; secrets and split numbers are added."""
    from test_units import plain_spans

    folder, f = "/root/testdata/sf0.01", pii.Field()
    texts = {r["doc_id"]: r["text"] or "" for r in load(spark, folder, "documents").collect()}
    added = 0
    for r in pii.op4_pii(spark, folder).collect():
        t = texts.pop(r["doc_id"])
        base = plain_spans(t)
        written = ",".join(f"{pii.FOUND[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == n for _, x, _ in base) for n in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(written.split(",") if written else []) <= set(spans)
        assert r["spans"] == ",".join(f"{pii.FOUND[k]}:{s}:{e}" for s, k, e in pii.find_spans([t], f)[0][1])
        secrets = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
        assert secrets <= set(spans)
        added += len(spans) - len(base)
    assert not texts and added >= 10


def test_bpe(odd, none):
    file = bpe.default_file()
    found = bpe.bpe_round_trip(odd, file).collect()
    assert len(found) == 11 and {r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 5)} == {0}
    for r in found:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.bpe_round_trip(none, file).count() == 0


def test_bpe_over_a_whole_table(spark):
    """Every row of the query against the library, text by text."""
    from tokenizers import Tokenizer

    folder, t = "/root/testdata/sf0.01", Tokenizer.from_file(bpe.default_file())
    t.no_truncation()
    t.no_padding()
    want = Counter()
    for r in load(spark, folder, "documents").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.op9_bpe(spark, folder).collect()) == want


def test_html(spark):
    p = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", 0), (None, None, None, 0), (1, "u", "<article><p>x</p></article>", 0), (2, "u", "", 0)], "page_id long, url string, html string, text int")
    assert sorted(str(tuple(r)) for r in html_text.extract_text(p).collect()) == sorted(map(str, [(1, "u", "x", 1), (None, None, "", 0), (1, "u", "x", 1), (2, "u", "", 0)]))
    assert html_text.extract_text(p.limit(0)).count() == 0


def test_chat(spark):
    t = spark.createDataFrame(
        [(1, 0, "user", "a", 7), (1, 1, "assistant", "b", 7), (2, 0, "user", "a", 7), (2, 1, "assistant", "c", 7), (3, 0, "user", None, 7), (None, 0, "user", "z", 7), (4, 0, "user", "a", 7), (4, 1, "assistant", "b", 7)],
        "conv_id long, turn long, role string, text string, turns int",
    )
    found = {(r["chosen_id"], r["rejected_id"]): r for r in chat.preference_rows(t).collect()}
    assert {k: r["status"] for k, r in found.items()} == {(1, 2): "pair", (1, 4): "equal", (3, None): "single", (None, None): "single"}
    r = found[(1, 2)]
    assert (r["prefix_turns"], r["prompt"]) == (1, "<|im_start|>user\na<|im_end|>\n")
    a, b = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][a:b] == "b<|im_end|>" and r["rejected"].startswith("<|im_start|>assistant\nc")
    assert chat.preference_rows(t.limit(0)).count() == 0
    every = load(spark, FOLDER, "conversations")
    rows = chat.preference_rows(every).collect()
    assert {x for r in rows for x in (r["chosen_id"], r["rejected_id"]) if x is not None} == {r[0] for r in every.select("conv_id").distinct().collect()}


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (7, 1), (8, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert toxicity.toxicity(odd, labels.limit(0)).count() == 11 and toxicity.toxicity(none, labels).count() == 0


def test_toxicity_held_out(spark):
    """Trained on the other folds of the tables at sf0.1."""
    folder = "/root/testdata/sf0.1"
    d, y = load(spark, folder, "documents"), load(spark, folder, "labels")
    r = toxicity.toxicity(d.join(y.select("doc_id"), "doc_id", "left_semi"), y).where("held_out").join(y, "doc_id").collect()
    good = sum(x["predicted"] == x["toxic"] for x in r) / len(r)
    found = sum(x["predicted"] for x in r if x["toxic"]) / sum(x["toxic"] for x in r)
    assert good > 0.95 and found > 0.78


def test_pipeline(spark, docs):
    """Against the stages one by one, by plain versions where there is one."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    fp = {i: plain_fp(texts[i]) for i in good}
    first = linked(sorted(good), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    kept = {i for i in good if first[i] == i}
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [words(lower(t))] for k in range(len(w) - 4)}
    items = [s for r in load(spark, FOLDER, "benchmark").collect() if (s := shingles(r["text"]))]
    kept = {i for i in kept if all(len(s & shingles(texts[i])) < 0.8 * len(s) for s in items)}
    field = pii.Field()
    e = bpe.ChunkEncoder(bpe.default_file())
    want = defaultdict(int)
    for i in kept:
        t, done, out = texts[i], 0, ""
        for s, k, end in pii.find_spans([t], field)[0][1]:
            if s >= done:
                out += t[done:s] + f"<{pii.FOUND[k].upper()}>"
            done = max(done, end)
        want[i] = hashlib.sha256(next(iter(e.encode([out + t[done:]])))).hexdigest()
    found = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert found == dict(want)


def test_pipeline_stages_keep_columns(spark, odd, none):
    for table in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, FOLDER).columns == table.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    """Each registered query over a whole small folder: a row for each row of its table (or pairs), and no temporary column left."""
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    table = {"op5_html_text": "pages"}.get(name, "documents")
    if name == "op10_chat":
        assert len(rows) <= load(spark, FOLDER, "conversations").select("conv_id").distinct().count()
    elif name == "op6_decontaminate":
        assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in load(spark, FOLDER, "documents").collect()}
    else:
        key = "page_id" if table == "pages" else "doc_id"
        assert Counter(r[key] for r in rows) == Counter(r[key] for r in load(spark, FOLDER, table).collect())
    assert not [c for c in df.columns if c.startswith("_")]
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{k}" for k in range(1, 11))


def test_pipeline_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """A stage that fails leaves the ones before it finished; the next run starts there and gives the same rows."""
    want = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()))
    calls = []

    def watched(name, stage, fails):
        def run(*a):
            calls.append(name)
            if fails:
                raise RuntimeError("lost")
            return stage(*a)

        return name, run

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(n, f, n == "personal_data") for n, f in stages])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, FOLDER, str(tmp_path / "p"))
    assert calls == ["quality", "near_duplicates", "decontamination", "personal_data"]
    calls.clear()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(n, f, False) for n, f in stages])
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER, str(tmp_path / "p")).collect())) == want
    assert calls == ["personal_data", "tokens"]
    assert sorted(x.name for x in (tmp_path / "p").iterdir()) == ["personal_data"]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from sumweave.llm.common import shared_folder

    made = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    assert shared_folder(made("local[4]")) and shared_folder(made("local"))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(made(master))


def test_pipeline_contents_of_odd_rows(spark, odd):
    """What each stage keeps and writes, not only its columns."""
    fixed = [c for c in odd.columns if c not in ("text", "n_chars")]
    first = corpus_pipeline.quality_rules(spark, odd, FOLDER)
    kept = sorted((str(r["doc_id"]) for r in first.collect()))
    assert kept == sorted(["1", "2", "2", "None"])  # the long text repeats itself
    second = corpus_pipeline.near_duplicates(spark, first, FOLDER)
    assert [r["doc_id"] for r in second.collect()] == [1]
    third = corpus_pipeline.decontamination(spark, odd, FOLDER)
    assert sorted(map(str, third.collect())) == sorted(map(str, odd.collect()))
    fourth = corpus_pipeline.personal_data(spark, odd, FOLDER)
    assert sorted(map(str, fourth.select(fixed).collect())) == sorted(map(str, odd.select(fixed).collect()))
    assert {r["text"] for r in fourth.where("doc_id = 7").collect()} == {"mail <EMAIL> <IP>"}
    last = corpus_pipeline.tokens(spark, odd, FOLDER).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in odd.collect()) and all(r["n_tokens"] == 0 for r in last if r["doc_id"] in (3, 4, 5))
