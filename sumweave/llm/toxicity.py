"""Toxicity: a bidirectional gated recurrent network with attention pooling over characters and words, in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, load, slices

#: Words in a window and from one window to the next; the last words of a window are the first of the next.
WINDOW, STEP = 48, 36
HIDDEN, EMBED = 8, 12
#: Words with a vector of their own, the commonest of the sample: a bound on the model, as every other word is still read by its n-grams; slots of these.
VOCABULARY, NGRAMS = 20_000, 1 << 15
#: Labelled documents from which the network learns, at most; half of each label where there are enough.
SAMPLE = 4000
#: Windows that go through the network together, and words whose projections a worker keeps.
BATCH, CACHE = 2048, 250_000
#: Characters of an input; a longer word becomes several, which overlap so that every sequence of six characters is in one.
LONG, OVERLAP = 40, 5
_EDGES = ".,;:!?\"'()[]{}<>#*$%&|-_…«»“”„"


def core(word: str) -> str:
    """A word without case and outer punctuation."""
    return word.lower().strip(_EDGES)


def inputs_of(text: str) -> list[str | tuple[str]]:
    """What the windows run over: the words of a text, and for a word of more than LONG characters its core in pieces, each as a tuple."""
    words = text.split()
    if max(map(len, words), default=0) <= LONG:
        return words
    cut = lambda c: [(c[k : k + LONG],) for k in range(0, max(1, len(c) - OVERLAP), LONG - OVERLAP)]
    return [x for w in words for x in ([w] if len(w) <= LONG else cut(core(w)))]


def core_of(x: str | tuple[str]) -> str:
    return core(x) if isinstance(x, str) else x[0]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters that the network reads: hashed sequences of 3, 4 and 6 characters of each word with marked ends.

    Returns the hashes of all words in a row, and how many each word has; all words are hashed together, as one array of code points.
    """
    marked = [f"^{w}$" if w else "^$$" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # characters up to the word's end
    hashes, owners = [], []
    for n in (3, 4, 6):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ points[at + k]
        h ^= h >> np.uint64(29)
        hashes.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(NGRAMS))
        owners.append(word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order].astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


@dataclass
class Network:
    words: dict[str, int]  # 0 is any other word
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def new(words: dict[str, int], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        p = {"word": draw(len(words) + 1, EMBED, scale=0.05), "char": draw(NGRAMS, EMBED, scale=0.05), "in": draw(2 * EMBED, 6 * HIDDEN, scale=0.3), "bias": np.zeros(6 * HIDDEN, np.float32)}
        p |= {"f": draw(HIDDEN, 3 * HIDDEN, scale=0.3), "b": draw(HIDDEN, 3 * HIDDEN, scale=0.3), "look": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "end": np.zeros(1, np.float32)}
        p["word"][0] = 0
        return Network(words, p)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: word ids, their n-grams in one row with counts, and the joined embeddings."""
        ids = np.fromiter((self.words.get(w, 0) for w in words), np.int32, len(words))
        parts = [ngrams(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
        flat, count = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (tuple(zip(*parts, strict=True)) or ((), ())))
        return ids, flat, count, self.embed(ids, flat, count)

    def embed(self, ids: np.ndarray, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.empty((len(ids), 2 * EMBED), np.float32)
        out[:, :EMBED] = self.p["word"][ids]
        ends = np.cumsum(count)
        for k in range(0, len(ids), 20_000):  # bounds what is gathered at once
            n = count[k : k + 20_000]
            begin = ends[k : k + 20_000] - n
            chars = np.add.reduceat(self.p["char"][flat[begin[0] : begin[0] + n.sum()]], begin - begin[0], axis=0)
            out[k : k + 20_000, EMBED:] = chars / np.sqrt(n, dtype=np.float32)[:, None]
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["in"] + self.p["bias"]

    def _run(self, g: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        """States (length, windows, HIDDEN) of one direction. g: projections of each step; mask: whether there is a word."""
        length, n, _ = g.shape
        states = np.zeros((length, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1) if back else range(length):
            hu = h @ u
            zr = _sigmoid(g[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            new = np.where(mask[t, :, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states

    def forward(self, table: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window. rows (windows, length) has rows of the table of projections, -1 after the last word."""
        rows = rows.T
        mask = rows >= 0
        g = table[rows]
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._run(g[:, :, : 3 * HIDDEN], mask, self.p["f"], False, kf)
        hb = self._run(g[:, :, 3 * HIDDEN :], mask, self.p["b"], True, kb)
        h = np.concatenate([hf, hb], axis=2)
        e = np.where(mask, h @ self.p["look"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a = a * mask / np.maximum((a * mask).sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, h)
        if keep is not None:
            keep |= {"kf": kf, "kb": kb, "h": h, "a": a, "pooled": pooled, "mask": mask, "rows": rows}
        return pooled @ self.p["out"] + self.p["end"][0]

    def _back(self, steps: list, dh: np.ndarray, mask: np.ndarray, u: np.ndarray, dg: np.ndarray, du: np.ndarray) -> None:
        carry = np.zeros(dh.shape[1:], np.float32)
        for t, h, z, r, c, hun in reversed(steps):
            d = dh[t] + carry
            m = mask[t, :, None]
            dn = d * m
            dz = dn * (h - c) * z * (1 - z)
            dc = dn * (1 - z) * (1 - c * c)
            dr = dc * hun * r * (1 - r)
            left = np.concatenate([dz, dr, dc * r], axis=1)
            dg[t] = np.concatenate([dz, dr, dc], axis=1)
            du += h.T @ left
            carry = left @ u.T + dn * z + d * ~m

    def gradients(self, table: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of what is behind the projections, and the gradient of the table's rows."""
        k: dict = {}
        s = self.forward(table, rows, k)
        y = _sigmoid(s)
        d = ((y - labels) / len(labels)).astype(np.float32)
        loss = float(-np.mean(labels * np.log(y + 1e-7) + (1 - labels) * np.log(1 - y + 1e-7)))
        g = {"out": k["pooled"].T @ d, "end": np.array([d.sum()], np.float32)}
        dp = d[:, None] * self.p["out"]
        h, a = k["h"], k["a"]
        da = np.einsum("tnh,nh->tn", h, dp)
        de = a * (da - (a * da).sum(axis=0))
        dh = a[:, :, None] * dp + de[:, :, None] * self.p["look"]
        g["look"] = np.einsum("tn,tnh->h", de, h)
        g["f"], g["b"] = np.zeros_like(self.p["f"]), np.zeros_like(self.p["b"])
        dg = np.zeros((*h.shape[:2], 6 * HIDDEN), np.float32)
        self._back(k["kf"], dh[:, :, :HIDDEN], k["mask"], self.p["f"], dg[:, :, : 3 * HIDDEN], g["f"])
        self._back(k["kb"], dh[:, :, HIDDEN:], k["mask"], self.p["b"], dg[:, :, 3 * HIDDEN :], g["b"])
        at, live = k["rows"].ravel(), k["mask"].ravel()
        flat, at = dg.reshape(-1, 6 * HIDDEN)[live], at[live]
        order = np.argsort(at, kind="stable")
        rows_seen, first = np.unique(at[order], return_index=True)
        dt = np.zeros_like(table)
        if len(rows_seen):
            dt[rows_seen] = np.add.reduceat(flat[order], first, axis=0)
        return loss, g, dt


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of every window: windows overlap and cover all words; a document without words has one empty window."""
    n = np.maximum(1, -(-np.maximum(0, lengths - (WINDOW - STEP)) // STEP))
    doc = np.repeat(np.arange(len(lengths)), n)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STEP


def rows_of(flat: np.ndarray, lengths: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    inside = at < lengths[doc][:, None]
    begin = (np.cumsum(lengths) - lengths)[doc][:, None]
    if not len(flat):
        return np.full(at.shape, -1)
    return np.where(inside, flat[np.minimum(begin + at, len(flat) - 1)], -1)


class Scorer:
    """Scores texts with a network; keeps the projections of words it has seen, within a bound."""

    def __init__(self, net: Network):
        self.net, self.index, self.seen = net, {}, {}  # rows of the table by core, and by the word as it stands in texts
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHE or len(self.seen) > 2 * CACHE:
            self.index, self.seen, self.table = {}, {}, self.table[:0]
        split = [inputs_of(t) for t in texts]
        unknown = set().union(*split) - self.seen.keys()
        cores = {w: core_of(w) for w in unknown}
        new = list(set(cores.values()) - self.index.keys())
        if new:
            self.table = np.concatenate([self.table, self.net.project(self.net.inputs(new)[3])])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.seen.update((w, self.index[c]) for w, c in cores.items())
        lengths = np.array([len(s) for s in split], np.int64)
        return np.fromiter(map(self.seen.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum())), lengths

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, first words and logits of all windows."""
        flat, lengths = self._rows(texts)
        doc, start = windows(lengths)
        table = self.table if len(self.table) else np.zeros((1, 6 * HIDDEN), np.float32)
        out = np.zeros(len(doc), np.float32)
        for k in range(0, len(doc), BATCH):
            out[k : k + BATCH] = self.net.forward(table, rows_of(flat, lengths, doc[k : k + BATCH], start[k : k + BATCH]))
        return doc, start, out

    def raw(self, texts: list[str]) -> np.ndarray:
        """The largest window logit of each text."""
        doc, _, s = self.logits(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, doc, s)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.net.slope * self.raw(texts) + self.net.shift)))


def train(texts: list[str], labels: list[int], odds: float | None = None, epochs: int = 16, seed: int = 7) -> Network:
    """A network that learns from labelled texts. odds: of label 1 in the population, for the score.

    A label holds for a text, not for each window: after two epochs over random windows each text is learnt by its highest window (and
    a text of label 0 by a random one, too).
    """
    r = np.random.default_rng(seed)
    cores: dict[str, str] = {}  # one object for each word

    def shared(w: str | tuple[str]) -> str:
        c = core_of(w)
        return cores.setdefault(c, c)

    split = [[shared(w) for w in inputs_of(t)] for t in texts]
    seen = Counter(w for s in split for w in set(s))
    vocabulary = [w for w, n in sorted(seen.items(), key=lambda e: (-e[1], e[0]))[:VOCABULARY] if n > 1]
    net = Network.new({w: k + 1 for k, w in enumerate(vocabulary)}, seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        net.shift = -4.0 if not len(y) or y.max() == 0 else 4.0
        return net
    words = sorted(seen)
    index = {w: k for k, w in enumerate(words)}
    ids, grams, count, _ = net.inputs(words)
    begin = np.cumsum(count, dtype=np.int64) - count
    lengths = np.array([len(s) for s in split], np.int64)
    flat = np.fromiter((index[w] for s in split for w in s), np.int32, int(lengths.sum()))
    del split, cores, seen, index, words
    doc, start = windows(lengths)
    first = np.searchsorted(doc, np.arange(len(y)))
    many = np.bincount(doc, minlength=len(y))
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    weight = np.where(y > 0, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    draw = weight / weight.sum()
    best = None
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 2 == 0:
            table = net.project(net.embed(ids, grams, count))
            s = np.concatenate([net.forward(table, rows_of(flat, lengths, doc[k : k + BATCH], start[k : k + BATCH])) for k in range(0, len(doc), BATCH)])
            order = np.lexsort((s, doc))
            best = order[np.append(first[1:], len(doc)) - 1]
        chosen = r.choice(len(y), size=max(2 * len(y), 3000), p=draw)
        for k in range(0, len(chosen), 128):
            d = chosen[k : k + 128]
            w = first[d] + r.integers(0, many[d])
            if best is not None:
                w = np.where((y[d] > 0) | (r.random(len(d)) < 0.5), best[d], w)
            rows = rows_of(flat, lengths, doc[w], start[w])
            used, inverse = np.unique(rows, return_inverse=True)
            inverse = inverse.reshape(rows.shape)
            if used[0] < 0:
                used, inverse = used[1:], inverse - 1
            if not len(used):
                continue
            n = count[used]
            g_at = np.repeat(begin[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x = net.embed(ids[used], grams[g_at], n)
            _, g, dt = net.gradients(net.project(x), inverse, y[d])
            g["in"], g["bias"] = x.T @ dt, dt.sum(axis=0)
            dx = dt @ net.p["in"].T
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], ids[used], dx[:, :EMBED])
            g["word"][0] = 0
            np.add.at(g["char"], grams[g_at], np.repeat(dx[:, EMBED:] / np.sqrt(n)[:, None], n, axis=0))
            step += 1
            rate = 0.01 * (1 - 0.9 * (epoch / epochs))
            for name, v in net.p.items():
                gr = g[name].astype(np.float32) + np.float32(1e-5) * v
                moment[name] += 0.1 * (gr - moment[name])
                square[name] += 0.01 * (gr * gr - square[name])
                v -= (rate / (1 - 0.9**step)) * moment[name] / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)
    # Platt scaling of the highest windows, then the population's odds
    s = Scorer(net).raw(texts)
    a, b = 1.0, 0.0
    weight = weight / weight.mean()
    for _ in range(300):
        q = 1 / (1 + np.exp(-(a * s + b)))
        e, v = weight * (q - y), weight * q * (1 - q) + 1e-6
        hessian = np.array([[np.sum(v * s * s) + 20.0, np.sum(v * s)], [np.sum(v * s), np.sum(v) + 1e-2]])
        move = np.linalg.solve(hessian, [np.sum(e * s) + 20.0 * (a - 1), np.sum(e)])
        a, b = a - 0.5 * move[0], b - 0.5 * move[1]
    net.slope, net.shift = float(max(a, 1e-3)), float(b + np.log(odds if odds else y.sum() / (len(y) - y.sum())))
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Trains on a bounded sample of the labelled documents that aren't held out: the smallest hashes of ids, up to half for each label."""
    y = labels.where("doc_id is not null and toxic in (0, 1)").where(bucket_of("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = dict(y.groupBy("toxic").count().collect())
    chosen = None
    for label in (0, 1):
        part = y.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(sample // 2, sample - n.get(1 - label, 0)))
        chosen = part if chosen is None else chosen.unionByName(part)
    d = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    rows = d.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()
    return train([r["text"] or "" for r in rows], [r["toxic"] for r in rows], n.get(1, 0) / n[0] if n.get(0) and n.get(1) else None)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted, n_windows.

    Every text is read whole, in overlapping windows, long words in overlapping pieces; the network sees the words and their characters, nothing
    else. The score is the
    calibrated logit of the highest window, of equal ones any. held_out: crc32 of the id as text modulo 5 is 0; only other rows' labels are learnt, from
    a bounded sample (`learn`). Null texts count as empty, and empty texts get the score of an empty window; repeated rows stay; a
    null id counts as the empty text in crc32; without usable labels all scores are near 0; an empty table gives an empty
    result; further columns are ignored, whatever their names.
    """
    net = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            score = np.concatenate([np.zeros(0), *(scorer.scores([t or "" for t in part]) for part in slices(b.column(2)))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
