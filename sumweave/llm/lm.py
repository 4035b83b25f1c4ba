"""Language-model scores: a log-bilinear model over word units, trained with noise-contrastive estimation."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, bucket_of, load, save, slices

#: Units of the neural model: the end of a text; RARES for words that have none of their own, told apart by how they begin; and the commonest words:
#: UNITS_ROOT times the square root of the training tokens, LEAST_UNITS at least, MOST_UNITS at most (a worker holds their vectors).
RARES, LEAST_UNITS, UNITS_ROOT, MOST_UNITS = 64, 512, 1.0, 1 << 15
#: Words whose counts every worker holds, at most; counts of the others are joined by shuffling.
FREQUENT = 100_000
#: Entries of a worker's table of counts before it is sent on.
FLUSH = 150_000
#: Width of the vectors; noise classes for a minibatch and noise words for a token; tokens of a minibatch.
WIDTH, NOISE, WORD_NOISE, MINIBATCH = 16, 32, 4, 1024
#: Every training text is learnt in the last of ROUNDS rounds. The first begins with a share of the texts: DRAWN_ROOT times the square root of all tokens,
#: STEPS minibatches at least (in several passes if there are fewer tokens).
STEPS, DRAWN_ROOT, ROUNDS = 2000, 1000.0, 2
#: A round's tasks, whose models are averaged: TASKS, or more if each would otherwise learn over TASK_TOKENS tokens. Minibatches whose tokens are shuffled
#: together; pieces of the models that are averaged separately.
TASKS, TASK_TOKENS, SHUFFLED, PIECES = 8, 1 << 24, 256, 16
#: Tokens whose probabilities a worker works out at once, and contexts whose exponentials it adds up at once.
SCORED, SUMMED = 1 << 18, 2048
COLD = pa.map_(pa.string(), pa.int64())
END = ""  # stands for the end of a text among words, none of which is empty


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both concern ASCII alone


def rare_unit(word: bytes) -> int:
    """The unit of a word that has none of its own: 1 to RARES."""
    return 1 + zlib.crc32(word[:2]) % RARES


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs, each text's end as a word of its own; workers count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for b in batches:
            for part in slices(b.column(0)):
                for t in part:
                    seen.update(tokens(t))
                    seen[b""] += 1
                if len(seen) > FLUSH:
                    yield batch(seen)
                    seen = Counter()
        yield batch(seen)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of frequent words, which of them are units, and what the rest of the vocabulary adds up to."""

    words: dict[bytes, int]  # place in the arrays
    unit: np.ndarray
    log: np.ndarray  # log10 of count + 1
    total: int
    distinct: int
    counts: np.ndarray  # of the units
    rare_log: np.ndarray  # for each of RARES log10 of its tokens and types, and one for unknown words

    @property
    def base_log(self) -> float:
        return math.log10(self.total + self.distinct + 1)

    @property
    def drawn(self) -> float:
        """Share of the training tokens that the first round of learning takes."""
        return min(1.0, max(STEPS * MINIBATCH, DRAWN_ROOT * math.sqrt(self.total)) / max(1, self.total))


#: The unit of the end; the next RARES are those of rare words, then come the commonest words.
ENDED = 0


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the saved counts: a histogram by logarithm gives the count from which on at most FREQUENT words are left; these are collected, and the
    end's row always, as no text's rare words have it."""
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = {r[0]: (r[1], r[2]) for r in counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)), F.sum("c")).collect()}  # some hundreds of rows at most
    cut, n = max(bins, default=0) + 1, 0
    for b in sorted(bins, reverse=True):
        n += bins[b][0]
        if n > FREQUENT:
            break
        cut = b
    rows = sorted(((r["c"], r["word"].encode("utf-8", "surrogatepass")) for r in counts.where((step >= cut) | (F.col("word") == END)).collect()), key=lambda r: (-r[0], r[1]))
    total, distinct = sum(c for _, c in bins.values()), sum(n for n, _ in bins.values())
    most = int(min(MOST_UNITS, max(LEAST_UNITS, UNITS_ROOT * math.sqrt(total))))
    own = [(c, w) for c, w in rows if w][:most]
    units = {b"": ENDED} | {w: k + 1 + RARES for k, (_, w) in enumerate(own)}
    ended = next((c for c, w in rows if not w), 0)
    key = (F.crc32(F.substring(F.encode("word", "UTF-8"), 1, 2)) % RARES).cast("int")
    tokens_of, types_of = np.zeros(RARES), np.zeros(RARES)
    for k, c, n in counts.where(F.col("word") != END).groupBy(key).agg(F.sum("c"), F.count(F.lit(1))).collect():  # RARES rows at most
        tokens_of[k], types_of[k] = c, n
    for c, w in own:
        tokens_of[rare_unit(w) - 1] -= c
        types_of[rare_unit(w) - 1] -= 1
    words = {w: k for k, (_, w) in enumerate(rows)}
    unit = np.array([units[w] if w in units else rare_unit(w) for w in words], np.int32)
    log = np.log10(np.array([c for c, _ in rows], float) + 1)
    return Vocabulary(words, unit, log, total, distinct, np.array([ended, *tokens_of, *(c for c, _ in own)], float), np.log10(tokens_of + types_of + 1))


def units_of(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """For the tokens of all texts in a row: units and places (-1: not frequent); the length of each text; its words that aren't frequent."""
    place, cold, lengths, rare = [], [], [], []
    get = v.words.get
    end = get(b"", -1)
    for t in texts:
        words = tokens(t)
        at = [get(w, -1) for w in words]
        mine = [w for w, p in zip(words, at, strict=True) if p < 0] if -1 in at else []
        cold.append(mine)
        rare += map(rare_unit, mine)
        place += at
        place.append(end)
        lengths.append(len(words) + 1)
    place, lengths = np.array(place, np.int64), np.array(lengths, np.int64)
    ends = np.cumsum(lengths) - 1
    unit = v.unit[place] if len(v.unit) else np.full(len(place), -1, np.int32)
    missing = place < 0
    missing[ends] = False
    unit[ends] = ENDED
    unit[missing] = rare
    return unit, place, lengths, cold


def before(unit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units two places and one place before each token; before a text stand ends."""
    one = np.concatenate([[ENDED], unit[:-1]])
    two = np.concatenate([[ENDED, ENDED], unit[:-2]])[: len(unit)]
    begin = np.cumsum(lengths) - lengths
    one[begin] = ENDED
    two[begin] = ENDED
    two[begin[lengths > 1] + 1] = ENDED
    return two, one


def lines_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From a batch with columns of saved units and, next to it, numbers of tokens: all units of ROWS rows in a row, and the length of each row."""
    at = b.schema.names.index("units")
    for k in range(0, b.num_rows, ROWS):
        lengths = b.column(at + 1).slice(k, ROWS).to_numpy()
        data = b"".join(b.column(at).slice(k, ROWS).to_pylist())
        yield np.frombuffer(data, f"<u{len(data) // lengths.sum()}").astype(np.int32), lengths


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows; the order that brings equal ones together, and where each begins in it."""
    order = np.argsort(rows.astype(np.uint16 if rows.max() < 1 << 16 else rows.dtype), kind="stable")  # 16 bits are sorted by radix
    sorted_ = rows[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], order, first


@dataclass
class Noise:
    """Draws units of given classes by their frequency, and the costs that the estimation subtracts from scores."""

    size: int
    many: int
    whole: np.ndarray  # of the classes
    class_cost: np.ndarray
    unit_cost: np.ndarray
    keep: np.ndarray  # by unit, as if its class were even: below this the unit itself is meant, else the other one (Walker's aliases)
    other: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, size: int) -> Noise:
        n = len(counts)
        p = (counts + 1) / (counts + 1).sum()
        of = np.arange(n) // size
        whole = np.bincount(of, p)
        keep, other = np.ones(n, np.float32), np.arange(n)
        for begin in range(0, n, size):
            share = p[begin : begin + size] / whole[begin // size]
            left = (share * len(share)).tolist()
            less, more = [k for k, x in enumerate(left) if x < 1], [k for k, x in enumerate(left) if x >= 1]
            while less and more:
                k, m = less.pop(), more[-1]
                keep[begin + k], other[begin + k] = left[k], begin + m
                left[m] -= 1 - left[k]
                if left[m] < 1:
                    less.append(more.pop())
        return Noise(size, n, whole, np.log(NOISE * whole).astype(np.float32), np.log(WORD_NOISE * p / whole[of]).astype(np.float32), keep, other)

    def units(self, r: np.random.Generator, c: np.ndarray) -> np.ndarray:
        """WORD_NOISE units for each class in c."""
        begin = c * self.size
        x = r.random((len(c), WORD_NOISE), np.float32) * np.minimum(self.size, self.many - begin)[:, None].astype(np.float32)
        k = x.astype(np.int64)
        x -= k
        k += begin[:, None]
        np.minimum(k, self.many - 1, out=k)
        return np.where(x < self.keep.take(k), k, self.other.take(k))


@dataclass
class LogBilinear:
    """A unit's score after a context is its vector times a prediction, the sum over positions of weights times the context units' vectors, plus a bias.

    Units fall into classes of `size` by their frequency. The probability of a unit is that of its class, normalised over all classes, times that of the
    unit, normalised over its class: every token costs two batched products with about the square root of the vocabulary.
    """

    size: int
    context: np.ndarray
    position: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(counts: np.ndarray, seed: int = 5) -> LogBilinear:
        r, n = np.random.default_rng(seed), len(counts)
        size = math.ceil(math.sqrt(n))
        many = -(-n // size)
        p = (counts + 1) / (counts + 1).sum()
        whole = np.bincount(np.arange(n) // size, p, many)
        normal = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        return LogBilinear(size, normal(n, WIDTH), np.array([[0.5] * WIDTH, [1.0] * WIDTH], np.float32), normal(many, WIDTH), np.log(whole).astype(np.float32), normal(n, WIDTH), np.log(p / whole[np.arange(n) // size]).astype(np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.position, self.classes, self.class_bias, self.target, self.bias]

    def packed(self) -> bytes:
        return b"".join(x.astype("<f4").tobytes() for x in self.parameters())

    def unpacked(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in self.parameters():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(self.size, *out)

    def predicted(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.context[two] * self.position[0] + self.context[one] * self.position[1]

    def log_probabilities(self, two: np.ndarray, one: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log10 probability of each unit after the two before it. Contexts, and contexts with classes, that occur repeatedly are normalised once."""
        context, which = np.unique(two.astype(np.int64) * len(self.bias) + one, return_inverse=True)
        q = np.ones((len(context), WIDTH + 1), np.float32)  # the last column is the bias's
        q[:, :WIDTH] = self.predicted(context // len(self.bias), context % len(self.bias))
        classes, units = np.column_stack([self.classes, self.class_bias]), np.column_stack([self.target, self.bias])
        norm = np.empty(len(q), np.float32)
        for k in range(0, len(q), SUMMED):
            norm[k : k + SUMMED] = _log_sum(q[k : k + SUMMED] @ classes.T)
        c = unit // self.size
        pair, at = np.unique(c.astype(np.int64) * len(q) + which, return_inverse=True)  # ascending by class
        inner = np.empty(len(pair), np.float32)
        edges = np.searchsorted(pair, np.arange(len(self.class_bias) + 1) * len(q))
        for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            part = units[k * self.size : (k + 1) * self.size].T
            for z in range(x, y, SUMMED):
                rows = q.take(pair[z : min(y, z + SUMMED)] - k * len(q), 0)
                inner[z : z + len(rows)] = _log_sum(rows @ part) - rows @ classes[k]
        inner += norm.take(pair % len(q))
        return (np.einsum("bd,bd->b", q.take(which, 0), units.take(unit, 0)) - inner.take(at)) / math.log(10)

    def learn(self, cells: np.ndarray, counts: np.ndarray, rate: float, seed: int | np.random.Generator, state: Learning | None = None) -> None:
        """Noise-contrastive estimation (Mnih and Teh 2012) over rows (two before, one before, unit), in this order of minibatches, with AdaGrad.

        A class is told from NOISE classes, drawn by their frequency and shared by a minibatch; a unit from WORD_NOISE units of its class, drawn by theirs.
        A given state goes on; without, learning begins at rest.
        """
        r, state = np.random.default_rng(seed), state or Learning.of(self, counts)
        noise, classes, units = state.noise, np.column_stack([self.classes, self.class_bias]), np.column_stack([self.target, self.bias])
        class_cost, unit_cost = noise.class_cost, noise.unit_cost

        def move(x: np.ndarray, s: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
            squares = s.take(rows, 0)
            squares += g * g
            s[rows] = squares
            np.sqrt(squares, out=squares)
            np.divide(g, squares, out=squares)
            squares *= np.float32(rate)
            x[rows] = x.take(rows, 0) - squares

        for at in range(0, len(cells), MINIBATCH):
            two, one, w = cells[at : at + MINIBATCH].T.astype(np.int64)
            n = len(w)
            scale = np.float32(1 / n)
            c = w // self.size
            before_two, before_one = self.context.take(two, 0), self.context.take(one, 0)
            q = np.ones((n, WIDTH + 1), np.float32)  # the last column is the bias's
            q[:, :WIDTH] = before_two * self.position[0] + before_one * self.position[1]
            k = np.searchsorted(state.upto, r.random(NOISE), side="right")
            true_class, noise_class = classes.take(c, 0), classes.take(k, 0)
            d = scale * _noise_slope(np.einsum("bd,bd->b", q, true_class) - class_cost[c])
            f = scale * _sigmoid(q @ noise_class.T - class_cost[k])
            other = noise.units(r, c)
            true_unit, noise_unit = units.take(w, 0), units.take(other, 0)
            t = scale * _noise_slope(np.einsum("bd,bd->b", q, true_unit) - unit_cost[w])
            u = scale * _sigmoid(np.matmul(noise_unit, q[:, :, None])[:, :, 0] - unit_cost.take(other))
            true_class *= d[:, None]
            true_unit *= t[:, None]
            dq = (true_class + f @ noise_class + true_unit + np.matmul(u[:, None], noise_unit)[:, 0])[:, :WIDTH]
            rows, order, first = _distinct(np.concatenate([c, k]))
            move(classes, state.classes, rows, np.add.reduceat(np.concatenate([d[:, None] * q, f.T @ q]).take(order, 0), first, axis=0))
            rows, order, first = _distinct(np.concatenate([w, other.ravel()]))
            by = q.take(np.where(order < n, order, (order - n) // WORD_NOISE), 0)
            by *= np.concatenate([t, u.ravel()]).take(order)[:, None]
            move(units, state.units, rows, np.add.reduceat(by, first, axis=0))
            g_position = np.stack([np.einsum("bd,bd->d", dq, before_two), np.einsum("bd,bd->d", dq, before_one)])
            rows, order, first = _distinct(np.concatenate([two, one]))
            move(self.context, state.context, rows, np.add.reduceat(np.concatenate([dq * self.position[0], dq * self.position[1]]).take(order, 0), first, axis=0))
            move(self.position, state.position, np.arange(2), g_position)
        self.classes[:], self.class_bias[:] = classes[:, :WIDTH], classes[:, WIDTH]
        self.target[:], self.bias[:] = units[:, :WIDTH], units[:, WIDTH]


@dataclass
class Learning:
    """What learning has besides the model: AdaGrad's sums of squares, biases in the last column, and the noise."""

    noise: Noise
    upto: np.ndarray  # the classes' probabilities up to each
    context: np.ndarray
    position: np.ndarray
    classes: np.ndarray
    units: np.ndarray

    @staticmethod
    def of(m: LogBilinear, counts: np.ndarray) -> Learning:
        noise = Noise.of(counts, m.size)
        rest = lambda n, width: np.full((n, width), 1e-6, np.float32)
        upto = np.cumsum(noise.whole)
        return Learning(noise, upto / upto[-1], rest(len(m.bias), WIDTH), rest(2, WIDTH), rest(len(m.class_bias), WIDTH + 1), rest(len(m.bias), WIDTH + 1))


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Logarithm of each row's sum of exponentials; s is overwritten."""
    if s.size and -60 < s.min() and s.max() < 60:  # no sum can overflow or vanish
        return np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32))
    most = s.max(axis=1, keepdims=True)
    return np.log(np.exp(s - most).sum(axis=1)) + most[:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _noise_slope(x: np.ndarray) -> np.ndarray:
    """Slope of the loss of a true unit or class by its score."""
    return _sigmoid(x) - 1


def averaged(made: DataFrame) -> np.ndarray | None:
    """The average of tasks' models by tokens, from rows (task, piece, n, numbers): a piece's rows are added up by one task in the tasks' order, and the
    driver gets one model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        total: Counter = Counter()
        for b in batches:
            for piece, n, numbers in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                sums[piece] = sums.get(piece, 0.0) + n * np.frombuffer(numbers.as_buffer(), "<f4").astype(float)
                total[piece] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / total[p]).astype("<f4").tobytes() for p, x in sums.items()], pa.binary())], ["piece", "numbers"])

    whole = made.repartition("piece").sortWithinPartitions("piece", "task").mapInArrow(run, "piece int, numbers binary").collect()
    return np.concatenate([np.frombuffer(r["numbers"], "<f4") for r in sorted(whole, key=lambda r: r["piece"])]) if whole else None


def fit(lines: DataFrame, v: Vocabulary) -> LogBilinear:
    """The model of all texts, given as rows (units, n_tokens). In each of ROUNDS rounds, at a falling rate, tasks learn from their texts, beginning with
    the last round's model, and their models are averaged by tokens. The first takes a share of the texts (by a hash of their units, so a task that is
    run again takes the same), the others take all: tasks that begin near each other can be averaged."""
    counts = v.counts
    model = LogBilinear.new(counts)
    drawn = max(1.0, v.drawn * v.total)
    passes = max(1, round(STEPS * MINIBATCH / (ROUNDS * drawn)))
    for k in range(ROUNDS):
        share, rate = (1.0 if k else v.drawn), 0.2 / (1 + k)
        start = model

        def run(batches: Iterator[pa.RecordBatch], start: LogBilinear = start, rate: float = rate, k: int = k) -> Iterator[pa.RecordBatch]:
            mine, n = start.unpacked(np.frombuffer(start.packed(), "<f4")), 0
            r, state = np.random.default_rng(k), Learning.of(mine, counts)

            def learn(held: list[np.ndarray]) -> int:
                part = np.concatenate(held)
                for _ in range(passes):
                    mine.learn(part[r.permutation(len(part))], counts, rate, r, state)
                return len(part)

            held: list[np.ndarray] = []
            for b in batches:
                for unit, lengths in lines_of(b):
                    held.append(np.stack([*before(unit, lengths), unit], axis=1).astype("<u4"))
                    if sum(map(len, held)) >= SHUFFLED * MINIBATCH:
                        n += learn(held)
                        held = []
            n += learn(held) if held else 0
            if n:
                task = TaskContext.get().partitionId()
                pieces = [x.tobytes() for x in np.array_split(np.frombuffer(mine.packed(), "<f4"), PIECES)]
                yield pa.RecordBatch.from_arrays([pa.array([task] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array([n] * PIECES, pa.int64()), pa.array(pieces, pa.binary())], ["task", "piece", "n", "numbers"])

        mine = lines if share == 1 else lines.where(F.pmod(F.xxhash64("units"), F.lit(1 << 20)) < share * (1 << 20))
        tasks = max(TASKS, math.ceil(share * v.total / TASK_TOKENS))
        flat = averaged(mine.coalesce(tasks).mapInArrow(run, "task int, piece int, n long, numbers binary"))
        model = model if flat is None else model.unpacked(flat)
    return model


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z lower-cased, and one end. Counts are over all texts whose crc32(id as text) modulo `modulus` isn't `held`. base_score
    is the add-one unigram log10 probability. score is log10 of the model's: the log-bilinear probability of a token's unit after
    the two units before it, normalised over all units; a word without a unit of its own has the probability of its rare unit times the
    word's add-one share of that unit's words, among which, as in the base, all unknown ones share one place. Every training text is
    learnt, and the units grow with the training tokens (constants above).

    Counts of at most FREQUENT words go to every worker; each text's other words, counted by text first, are joined with the whole table of
    counts by a shuffle. Of equally frequent words the first in byte order gets a unit. Null texts count as empty (one token); texts are
    scored whole, however long; a null id counts as the empty text in crc32; repeated rows stay; an empty table gives an
    empty result; further columns are ignored, whatever their names.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), (bucket_of(doc_id, modulus) == held).alias("held_out"), F.col(text).cast("string").alias("text"))
    counts = save(count_words(d.where(~F.col("held_out"))))
    v = vocabulary(counts)
    kind = d.schema["doc_id"].dataType.simpleString()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 if len(v.counts) <= 1 << 16 else 4
        for b in batches:
            k = 0
            for part in slices(b.column(2)):
                unit, place, lengths, cold = units_of(v, part)
                begin = np.cumsum(lengths) - lengths
                log = np.where(place >= 0, v.log[place], 0.0) if len(v.log) else np.zeros(len(place))
                rare = np.where((unit > ENDED) & (unit <= RARES), log - v.rare_log[(unit - 1).clip(0, RARES - 1)], 0.0)
                columns = [b.column(0).slice(k, len(part)), b.column(1).slice(k, len(part))]
                k += len(part)
                columns += [pa.array(np.add.reduceat((place >= 0).astype(np.int64), begin)), pa.array(np.add.reduceat(log, begin) - lengths * v.base_log), pa.array(np.add.reduceat(rare, begin))]
                ends = np.concatenate([[0], np.cumsum(lengths) * size]).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(unit.astype(f"<u{size}").tobytes())]))
                columns += [pa.array(lengths), pa.array([list(Counter(c).items()) for c in cold], COLD)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_known", "base_score", "score", "units", "n_tokens", "cold"])

    part = d.mapInArrow(units, f"doc_id {kind}, held_out boolean, n_known long, base_score double, score double, units binary, n_tokens long, cold map<string, long>")
    part = save(part.withColumn("row", F.monotonically_increasing_id()))
    model = fit(part.where(~F.col("held_out")).select("units", "n_tokens"), v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            neural = []
            for unit, lengths in lines_of(b):
                two, one = before(unit, lengths)
                each = [model.log_probabilities(two[k : k + SCORED], one[k : k + SCORED], unit[k : k + SCORED]) for k in range(0, len(unit), SCORED)]
                neural.append(np.add.reduceat(np.concatenate(each).astype(float), np.cumsum(lengths) - lengths))
            if neural:
                score = np.concatenate(neural) + b.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(score), b.column(6), b.column(7)], ["doc_id", "held_out", "n_known", "base_score", "score", "n_tokens", "row"])

    scored = part.select("doc_id", "held_out", "n_known", "base_score", "score", "units", "n_tokens", "row")
    scored = save(scored.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_known long, base_score double, score double, n_tokens long, row long"))
    cold = part.select("row", F.explode("cold").alias("word", "times"))
    more = cold.join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("log"), F.sum("times").alias("n"))  # a word without a count adds log10(1)
    out = scored.join(more, "row", "left")
    log, n = F.coalesce("log", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + n).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))
