"""Parts that need no Spark, against plain versions."""

import itertools
import random
import re

import numpy as np
import pytest

from sumweave.llm import bpe, chat, html_text, lm, pii, quality, simhash, toxicity


def test_trie_pairs_are_all_pairs():
    r = np.random.default_rng(0)
    v = set()
    for _ in range(40):
        c = int(r.integers(0, 1 << 63))
        for _ in range(6):
            x = c
            for b in r.integers(0, 64, r.integers(0, 5)):
                x ^= 1 << int(b)
            v.add(x)
    v = np.array(sorted(v), np.uint64)
    found = {(int(min(a, b)), int(max(a, b))) for i, j in simhash.trie_pairs(v, np.array([0]), np.array([len(v)])) for a, b in zip(i, j, strict=True)}
    assert found == {(a, b) for a, b in itertools.combinations(range(len(v)), 2) if (int(v[a]) ^ int(v[b])).bit_count() <= 3}


def test_fingerprint_of_short_texts():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\x0b") == 0
    assert simhash.fingerprint("One Two") == simhash.fingerprint("one\ttwo ")
    assert simhash.fingerprint("ÄB") != simhash.fingerprint("äb")  # only A-Z are lower-cased
    long = "a b c " * 50_000
    assert simhash.fingerprint(long) == simhash.fingerprint(long)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = str(public_tokenizers.path(name))
    t, e = Tokenizer.from_file(file), bpe.ChunkEncoder(file)
    r = random.Random(1)
    bits = ["the", "Word", "İx", "it's", " ", "  ", "\n", "\t", ",", "!!", "é", "é", "<|endoftext|>", "🙂", "12", "　", "ß", "Σ", "\x1c", "DON'T", "***", "café."]
    texts = ["", " ", "\n\n"] + ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(400))) for _ in range(150)]
    texts += texts[:50]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.decode([np.array(x, "<u4").tobytes() for x in got]) == [t.decode(x, skip_special_tokens=False) for x in got]


def test_chunks_are_shared_and_cut_by_content():
    passage = " ".join(f"word{k}" for k in range(2000))
    a, b = ("start of one " + passage).encode(), ("another beginning here " + passage).encode()
    cut = lambda d: {d[x:y] for x, y in itertools.pairwise([0, *bpe.cuts(d), len(d)])}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 2 > 5


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("a1.@+ -()9.5.25_%x@y.z0") for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("9" * 300_000, "a" * 300_000, "@" * 300_000, "1." * 150_000, "+1" * 100_000):
        pii.base_spans(t)  # linear


def in_line(words):
    return [pii.BREAK, *(w.encode() for w in words), pii.BREAK]


def test_field_learns_its_table_and_adds_spans():
    f = pii.Field()
    lines = [f._parse(x) for x in pii.TABLE.strip().splitlines()]
    right = sum(f.decode(in_line(w))[1:-1].tolist() == y for w, y in lines)
    assert right >= 0.95 * len(lines)
    t = "call (017) 555-7713 today or +1 (017) 555-7713; no harm in 2021 and 12 items"
    base, spans = pii.find_spans([t], f)[0]
    assert [t[s:e] for s, _, e in base] == ["+1 (017) 555-7713"]
    assert set(base) <= set(spans) and "(017) 555-7713" in [t[s:e] for s, _, e in spans]


def plain_viterbi(f, words):
    """Labels of one line by the definition: all words, no bounds."""
    row = [("\n",), ("\n",), *((w,) for w in words), ("\n",), ("\n",)]
    e = [sum((f.weights.get(f"{side}{x}", np.zeros(len(pii.LABELS))) for side in f.SIDES for x in pii.features(row[k + side][0])), np.zeros(len(pii.LABELS))) for k in range(2, len(row) - 2)]
    best, back = f.trans[0] + e[0], []
    for x in e[1:]:
        step = best[:, None] + f.trans
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + x
    y = [int((best + f.trans[:, 0]).argmax())]
    for b in back[::-1]:
        y.append(int(b[y[-1]]))
    return y[::-1]


def test_decoding_in_runs_is_viterbi_over_whole_lines():
    f, r = pii.Field(), random.Random(4)
    pool = sorted({w for x in pii.TABLE.strip().splitlines() for w in f._parse(x)[0]})
    lines = [[r.choice(pool) for _ in range(r.randrange(1, 40))] for _ in range(400)] + [[r.choice(pool)] * 300 for _ in range(20)] + [["(212)", "555-0147"] * 700]
    words = [x for w in lines for x in in_line(w)]
    got, at = f.decode(words).tolist(), 0
    for w in lines:
        assert got[at + 1 : at + 1 + len(w)] == plain_viterbi(f, w)
        at += len(w) + 2


def test_viterbi_is_the_best_path():
    f = pii.Field(rounds=20)
    words = "ring (212) 555-0147 now".split()
    e = f._emissions(f.ids(in_line(words)), np.arange(1, len(words) + 1))
    score = lambda y: sum(e[k][a] for k, a in enumerate(y)) + sum(f.trans[a, b] for a, b in itertools.pairwise((0, *y, 0)))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=len(words)), key=score)
    assert score(f.decode(in_line(words))[1:-1].tolist()) == pytest.approx(score(best))


#: Frames and fillers that are not in the table; digits are drawn anew.
FRAMES = {
    "phone": ["you may ring {} after lunch", "our fax is {} since may", "call {} or come by", "phone {} for a table"],
    "email": ["please write to {} soon", "mail {} for details", "send the form to {} today", "contact {} before friday"],
    "ip": ["the server {} is slow again", "host {} went down", "ping {} twice"],
    "card": ["card {} was declined", "visa {} has expired", "paid with {} last week"],
    "secret": ['and token = "{}" was found', 'token = "{}" la de los', "secret: {} in the log", 'THE TOKEN = "{}"!! OF!!'],
    "": ["in {} there were {} of them", "page {} of {} is torn", "it costs {} or {} euros", "the {} of {} and {}", "version {} is out", "number {} is unknown"],
}


def drawn(r, kind):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "phone":
        return r.choice([f"({r.randrange(200, 999)}) 555-{d(4)}", f"{r.randrange(200, 999)}-555-{d(4)}", f"{r.randrange(200, 999)}.555.{d(4)}", f"1-8{d(2)}-555-{d(4)}"])
    if kind == "email":
        u, h = r.choice(["lee.park", "k.novak", "rosa_diaz", "desk", "j.abel"]), r.choice(["example.com", "mail.example.net", "post.example.org"])
        return r.choice([f"{u} (at) {h}", f"{u}[at]{h}", f"{u}(at){h}", f"{u} at {h}", f"{u}@localhost"])
    if kind == "ip":
        return ".".join(str(r.randrange(1, 255)) for _ in range(4)) + r.choice([f":{d(4)}", f"/{r.randrange(8, 30)}"])
    if kind == "card":
        stem = "4" + d(14)
        digits = next(stem + x for x in "0123456789" if pii.luhn(stem + x))
        return r.choice("./").join(digits[k : k + 4] for k in range(0, 16, 4))
    return "".join(r.choice("0123456789abcdef") for _ in range(40)) if kind == "secret" else r.choice([d(1), d(2), d(3), f"{d(2)}.{d(2)}", f"1{d(3)}", f"{d(1)},{d(3)}.00", d(4), f"{d(2)}:{d(2)}"])


def test_precision_and_recall_of_added_spans():
    f, r = pii.Field(), random.Random(5)
    wanted = found = right = 0
    for _ in range(1500):
        kind = r.choice([*pii.FOUND, "", "", ""])
        frame, want, t = r.choice(FRAMES[kind]), set(), ""
        for k, part in enumerate(frame.split("{}")):
            if k:
                x = drawn(r, kind)
                if kind:
                    want.add((kind, len(t), len(t) + len(x)))
                t += x
            t += part
        _, spans = pii.find_spans([t], f)[0]
        base = {(pii.FOUND[k], s, e) for s, k, e in pii.base_spans(t)}
        got = {(pii.FOUND[k], s, e) for s, k, e in spans}
        if kind in ("ip", "email") and base:  # the exact pattern has the address already
            continue
        wanted, found, right = wanted + len(want), found + len(got - base), right + len(want & got)
    assert right / wanted > 0.9 and right / found > 0.9, (right, wanted, found)


def test_neighbours_are_two_spans_and_spelled_mail_is_found():
    f = pii.Field()
    show = lambda t: [(pii.FOUND[k], t[s:e]) for s, k, e in pii.find_spans([t], f)[0][1]]
    assert show("(212) 555-0147 (415) 555-2671") == [("phone", "(212) 555-0147"), ("phone", "(415) 555-2671")]
    assert show("mail anna.berg at example.org now") == [("email", "anna.berg at example.org")]
    glued = "ument éreé. Des +1 (826) 555-4081 190.137.223.204 du"  # the exact phone pattern runs on into the address and fails
    assert show(glued) == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]
    assert show('word\ntoken = "' + "0a1b2c3d4e" * 4 + '"\nword') == [("secret", "0a1b2c3d4e" * 4)]
    assert show("at home\n555-0147 (212)\nat last") == show("") == []


def test_words_are_read_to_their_end():
    assert pii.features("x1" * 40 + "a.b") != pii.features("x1" * 40 + "a-b")
    assert pii.features("9" * 70) != pii.features("9" * 70 + "a") and pii.features("(" * 9 + "1") != pii.features("(" * 8 + "1")
    f = pii.Field()
    long = "1a" * 500_000
    assert pii.find_spans([long, f"{long} 10.0.0.1:80 {long}"], f)[0][1] == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("only text", "only text"),
        ("<p>one<p>two &amp; three&nbsp;x</p>", "one\ntwo & three x"),
        ("<article><p>A<b>b</b>c  d<br>e</p><aside>no</aside><form>no</form><div class='comments'><p>a comment</p></div></article>", "Abc d e"),
        ("<body><nav><a href=x>menu</a></nav><div class=ad>buy this long text of an advert now</div><article><h1>T</h1><p>x</p></article><footer>f</footer>", "T\nx"),
        ("<body><div><div><p>aa bb cc dd ee ff gg</p></div><div><p>hh ii jj kk ll mm nn</p></div></div><div><a href=q>l1</a><a href=q>l2</a></div></body>", "aa bb cc dd ee ff gg\nhh ii jj kk ll mm nn"),
        ("<script>var t='</p>';</script><style>p{}</style><article><p>x &lt;b&gt; y", "x <b> y"),
        ("<div>" * 20_000 + "deep", "deep"),
        ("1 < 2 & 3 <", "1 < 2 & 3 <"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_network_gradients_are_right():
    net, r = toxicity.Network.new({"a": 1}), np.random.default_rng(0)
    table = r.standard_normal((6, 6 * toxicity.HIDDEN)).astype(np.float32)
    rows = r.integers(0, 6, (5, toxicity.WINDOW))
    rows[0, 9:] = -1
    y = np.array([1, 0, 1, 0, 1], np.float32)
    _, g, dt = net.gradients(table, rows, y)

    def slope(x, at):
        old = x[at]
        x[at] = old + 0.01
        up = net.gradients(table, rows, y)[0]
        x[at] = old - 0.01
        down = net.gradients(table, rows, y)[0]
        x[at] = old
        return (up - down) / 0.02

    for name in ("f", "b", "look", "out"):
        at = tuple(1 for _ in net.p[name].shape)
        assert g[name][at] == pytest.approx(slope(net.p[name], at), abs=2e-4, rel=0.05), name
    assert dt[2, 20] == pytest.approx(slope(table, (2, 20)), abs=2e-4, rel=0.05)


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        doc, start = toxicity.windows(np.array([n]))
        covered = {k for s in start for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(doc) >= 1
        assert all(s < n or n == 0 for s in start)


def test_toxicity_without_labels():
    net = toxicity.train([], [])
    assert (toxicity.Scorer(net).scores(["", "some text"]) < 0.5).all()


def test_log_bilinear_is_normalised_and_learns():
    n = 40
    u = np.random.default_rng(0).integers(0, 5, 40_000)
    cells = np.stack([u, u, (u + 1) % 5], axis=1)
    counts = np.bincount(cells[:, 2], minlength=n).astype(float)
    m = lm.LogBilinear.new(counts)
    for k in range(4):
        m.learn(cells, counts, 0.2, k)
    contexts = np.array([(a, b) for a in range(n) for b in range(n)])
    every = np.repeat(contexts, n, axis=0)
    p = 10.0 ** m.log_probabilities(every[:, 0], every[:, 1], np.tile(np.arange(n), len(contexts))).reshape(len(contexts), n)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert all(p[k * n + k, (k + 1) % 5] > 0.5 for k in range(5))


def test_noise_contrastive_slopes_are_right():
    """One step of AdaGrad from rest moves every parameter against the sign of the loss's slope, found by differences."""
    counts = np.array([50.0, 30, 20, 10, 5, 5, 3, 2, 1])
    cells = np.array([[1, 2, 3]] * 200, np.uint32)
    m = lm.LogBilinear.new(counts)
    before = m.log_probabilities(np.array([1]), np.array([2]), np.array([3]))[0]
    m.learn(cells, counts, 0.01, 0)
    assert m.log_probabilities(np.array([1]), np.array([2]), np.array([3]))[0] > before


def _good(model, votes):
    """Probability of a document with such votes, from the definition."""
    odds = [model.shares[c] * np.prod([1.0 if v is None else r if v == 0 else 1 - r for v, r in zip(votes, model.rates(c), strict=True)]) for c in range(len(model.shares))]
    return odds[0] / sum(odds)


def _pattern(**votes):
    return tuple(votes.get(r, 1) for r in quality.RULES)


def test_estimate_follows_rules_that_agree_and_overrules_a_noisy_one():
    good, symbols, repeats = _pattern(), _pattern(symbols=0, symbol_words=0), _pattern(repetition=0, duplicate_lines=0)
    noisy, both = _pattern(short_lines=0), _pattern(short_lines=0, symbols=0, symbol_words=0)
    echoes = _pattern(repetition=0, echoes=0, variety=0)
    counts = {good: 6500, noisy: 2800, symbols: 250, both: 110, repeats: 120, echoes: 120}
    m = quality.estimate(counts)
    rule = list(quality.RULES).index
    assert m.errors[rule("short_lines")] == pytest.approx(0.3, abs=0.02) and m.errors[rule("symbols")] < 0.01 and m.hits[rule("symbols")] > 0.95
    assert _good(m, noisy) > 0.9 and _good(m, good) > 0.9  # the lone bad vote of an unreliable rule
    assert all(_good(m, x) < 0.1 for x in (symbols, both, repeats, echoes))
    assert (m.hits >= m.errors).all()
    # the same rule counts where the others bear it out
    m = quality.estimate({good: 9000, _pattern(short_lines=0, line_ends=0, capitals=0): 500})
    assert _good(m, _pattern(short_lines=0, line_ends=0, capitals=0)) < 0.1 and m.hits[rule("short_lines")] > 0.9
    empty = quality.estimate({})
    assert empty.shares.sum() == pytest.approx(1) and _good(empty, good) > 0.9


def test_estimate_is_a_fixed_point_of_plain_em():
    r = random.Random(3)
    counts = {}
    for _ in range(4000):
        kind = r.choices(["", *quality.KINDS], [8, 1, 1, 1])[0]
        v = tuple(None if r.random() < 0.1 else int(r.random() > (0.7 if k == kind else 0.05)) for k in quality.RULES.values())
        counts[v] = counts.get(v, 0) + 1
    a, b = quality.estimate(counts, 300), quality.estimate(dict(reversed(counts.items())), 301)
    assert np.allclose(a.hits, b.hits, atol=1e-6) and np.allclose(a.errors, b.errors, atol=1e-6) and np.allclose(a.shares, b.shares, atol=1e-6)
    assert np.allclose(a.hits, 0.7, atol=0.08) and np.allclose(a.errors, 0.05, atol=0.02) and a.shares[0] == pytest.approx(8 / 11, abs=0.03)
    post = {v: _good(a, v) for v in counts}
    assert sum(n * post[v] for v, n in counts.items()) / (4000 + quality.PSEUDO) + quality.PSEUDO * quality.GOOD / (4000 + quality.PSEUDO) == pytest.approx(a.shares[0], abs=1e-6)


def test_common_prefix_and_masks():
    u, a, b = ({"role": r, "text": t} for r, t in (("user", "q"), ("assistant", "x"), ("assistant", "yy")))
    assert chat.common_prefix([u, a], [u, b]) == 1 and chat.common_prefix([u], [u, a]) == 1 and chat.common_prefix([], [u]) == 0
    text, spans = chat.render([u, b])
    assert [text[s:e] for s, e in spans] == ["yy<|im_end|>"]


def test_lower_case_without_the_normalizer_equals_the_library():
    """Every character below U+0240 and beyond, alone, in words, after others, and as white space."""
    from tokenizers import Tokenizer

    file = bpe.default_file()
    t, e = Tokenizer.from_file(file), bpe.ChunkEncoder(file)
    assert e.plain is not None
    texts = [x for c in range(1, 0x400) for x in (chr(c), f"a{chr(c)}b", f"{chr(c)}{chr(c)} It{chr(c)}", f"x {chr(c)} 1{chr(c)}'S")]
    texts += ["<|ENDOFTEXT|>", "a<|EndOfText|>b", "<|endoftext|>É", "e\u0301 É", "ΑΣ Σ", "İI ı", "ǅ ǆ Ȿ"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e._library(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    words = [x for x in texts if "<" not in x]
    assert list(e._short(words)) == e._library(words)
    import public_tokenizers

    assert bpe.ChunkEncoder(str(public_tokenizers.path("byte_bpe_50k.json"))).plain is None


def test_shared_chunks_are_encoded_once():
    passage = " ".join(f"word{k % 313} of{k}" for k in range(4000))
    e = bpe.ChunkEncoder(bpe.default_file())
    for k in range(30):
        list(e.encode([f"Text number {k} begins here. {passage} And it ends, at {k}."]))
    assert 1 - e.encoded / e.seen > 0.9
    alone = bpe.ChunkEncoder(bpe.default_file())
    texts = [" ".join(f"other{j}x{k}" for j in range(500)) for k in range(5)]
    list(alone.encode(texts))
    assert alone.encoded == alone.seen  # nothing but chunks is kept


def test_batches_of_long_texts_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "BATCH_CHARS", 5000)
    monkeypatch.setattr(bpe, "CHUNKS", 50)
    monkeypatch.setattr(bpe, "JOINS", 50)
    file = bpe.default_file()
    t, e = Tokenizer.from_file(file), bpe.ChunkEncoder(file)
    texts = ["", "x" * 20_000, " ".join(f"Word{k % 701}, it's" for k in range(9000)), "a\n" * 7000, "<|endoftext|> " * 900, ""]
    got = [np.frombuffer(x, "<u4").tolist() for part in bpe._parts(texts, 5000) for x in e.encode(part)]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
