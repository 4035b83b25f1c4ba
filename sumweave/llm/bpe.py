"""BPE encoding with content-defined chunk reuse, and decoding."""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, load, slices

#: Bytes that the rolling hash sees, and one in how many spaces ends a chunk on average.
WINDOW, EVERY = 8, 64
#: Entries beyond which a cache starts anew, and characters that are encoded between two such checks.
CHUNKS, JOINS, BATCH_CHARS = 40_000, 100_000, 3_000_000
#: Chunks, or short texts with marks between them, that go through the library in one call.
TOGETHER = 1000
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Fixed value: a pattern of pieces, none of which has white space in it. Bytes of UTF-8 that characters below U+0240 are made of.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BELOW = bytes(range(0xC9))


def cuts(data: bytes) -> list[int]:
    """Positions of the spaces and line feeds before which a text is cut, from the content around them alone.

    The hash of the WINDOW bytes up to a blank decides, so equal passages are cut alike wherever they stand. All hashes are
    computed at once by a rolling polynomial over the bytes.
    """
    return [x for x, _ in _all_cuts(data, [0, len(data)])]


def _all_cuts(data: bytes, edges: list[int]) -> list[tuple[int, int]]:
    """(position, text) of all cuts of texts that stand one after the other in data, between edges."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b == 32) | (b == 10))
    text = np.searchsorted(edges, at, side="right") - 1
    inside = at - np.asarray(edges)[text] >= WINDOW
    at, text = at[inside], text[inside]
    h = np.zeros(len(at), np.uint64)
    for k in range(WINDOW, 0, -1):
        h = h * np.uint64(_MULTIPLIER) + b[at - k] + np.uint64(1)
    cut = (h >> np.uint64(40)) % np.uint64(EVERY) == 0
    return list(zip(at[cut].tolist(), text[cut].tolist(), strict=True))


class _Cache(dict):
    """Starts anew between batches when it has too many entries."""

    def trim(self, most: int) -> None:
        if len(self) > most:
            self.clear()


class ChunkEncoder:
    """Encodes texts as a tokenizer of the tokenizers library does, each distinct chunk once while the cache holds it, whichever texts share it.

    A chunk runs from one cut to the next. What the library's pipeline does with the text around a cut may differ from what it does
    with the two parts, so each join is tried: the last word before and the first word after it are encoded together
    and apart. If these differ, both sides are widened word by word until the outer tokens on both sides agree with those of the
    parts' own, and the tokens in between are replaced; if no such place is found, both chunks are encoded as one.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of a pool would only spin
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(file)
        self.t.no_truncation()
        self.t.no_padding()
        self.chunks, self.joins = _Cache(), _Cache()
        self.seen = self.encoded = 0  # bytes of all chunks, and of those that the library encoded
        self.mark = self._special()
        spec = json.loads(self.t.to_str())
        self.added = [x.content.lower() for x in self.t.get_added_tokens_decoder().values()]
        self.plain = self._without_normalizer(spec)
        # without a decoder the library joins the tokens by spaces
        self.tokens = None if spec.get("decoder") else {i: w for w, i in self.t.get_vocab(with_added_tokens=True).items()}

    def _without_normalizer(self, spec: dict):
        """The same tokenizer without its normalizer, for texts that are lower-cased here: None unless the file says that these are equal.

        They are where the normalizer does nothing but compose (NFC), replace white space by a space and lower-case, pieces never hold white space, and
        added tokens are found before it: below U+0240 no character composes, and lower case is that of each character alone.
        """
        from tokenizers import Tokenizer

        normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = normal.get("normalizers", [normal])
        first = pre.get("pretokenizers", [pre])[0]
        known = all(x.get("type") in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in steps)
        drops = first == {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
        if not known or not drops or not any(x["type"] == "Lowercase" for x in steps) or any(x["normalized"] for x in spec["added_tokens"]):
            return None
        t = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "truncation": None, "padding": None}))
        return t

    @staticmethod
    def _lower(text: str) -> str | None:
        """A text in lower case, if all its characters are below U+0240."""
        return text.lower() if text.isascii() or not text.encode("utf-8", "surrogatepass").translate(None, BELOW) else None

    def _library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = list(range(len(texts)))
        if self.plain:
            low = [self._lower(t) for t in texts]
            some = [k for k, t in enumerate(low) if t is not None and not any(a in t for a in self.added)]
            for k, e in zip(some, self.plain.encode_batch_fast([low[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = array("I", e.ids).tobytes()
            some = set(some)
            whole = [k for k in whole if k not in some]
        for k, e in zip(whole, self.t.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True):
            out[k] = array("I", e.ids).tobytes()
        return out

    def _short(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each of many short texts. The library splits at special tokens before all else, so texts with one between them are
        encoded in one call; a text that might contain one goes alone."""
        mark, end = self.mark
        for k in range(0, len(texts), TOGETHER):
            part = texts[k : k + TOGETHER]
            if not mark or any("<" in t for t in part):
                yield from self._library(part)
                continue
            joined = mark.join(part)
            low = self._lower(joined) if self.plain and mark.islower() else None
            t, joined = (self.t, joined) if low is None else (self.plain, low)
            ids = array("I", t.encode_batch_fast([joined], add_special_tokens=False)[0].ids).tobytes()
            at = [-4, *(4 * np.flatnonzero(np.frombuffer(ids, "<u4") == end)).tolist(), len(ids)]
            yield from (ids[x + 4 : y] for x, y in zip(at, at[1:], strict=False))

    def _special(self) -> tuple[str, int]:
        for i, token in self.t.get_added_tokens_decoder().items():
            if token.special and not token.normalized and not token.lstrip and not token.rstrip and not token.single_word and token.content.startswith("<"):
                return token.content, i
        return "", -1

    def _encode_new(self, chunks: list[str]) -> None:
        """Has the library encode chunks that are in no cache."""
        self.encoded += sum(map(len, chunks))
        for k in range(0, len(chunks), TOGETHER):
            part = chunks[k : k + TOGETHER]
            self.chunks.update(zip(part, self._library(part), strict=True))

    def _agree(self, pairs: list[tuple[str, str]]) -> None:
        """Notes for each pair of words around a cut whether they have together the ids that they have apart."""
        new = list(set(pairs) - self.joins.keys())
        words = list({x for p in new for x in p})
        apart = dict(zip(words, self._short(words), strict=True))
        both = self._short([a + b for a, b in new])
        self.joins.update((p, ids == apart[p[0]] + apart[p[1]]) for p, ids in zip(new, both, strict=True))

    def _repair(self, left: str, right: str, ids: bytes) -> bytes:
        """Ids of left + right, where ids are those of left, from wider and wider parts around the join."""
        a, b, k = left.split(" "), right.split(" "), 2
        right_ids = self._library([right])[0]
        while k < len(a) and k < len(b):
            tail, head = " ".join(["", *a[-k:]]), " ".join(b[:k])
            x, y, both = self._library([tail, head, tail + head])
            if x and y and both[:4] == x[:4] and both[-4:] == y[-4:] and ids.endswith(x) and right_ids.startswith(y):
                return ids[: -len(x)] + both + right_ids[len(y) :]
            k *= 2
        return self._library([left + right])[0]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers. Holds all their chunks: give about BATCH_CHARS characters at once."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"".join(raw)
        edges = [0, *accumulate(map(len, raw))]
        marks: list[list[int]] = [[x] for x in edges[:-1]]
        for at, k in _all_cuts(data, edges):
            marks[k].append(at)
        cut = []
        for m, end in zip(marks, edges[1:], strict=True):
            m.append(end)
            cut.append([data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(m, m[1:], strict=False)])
        self.chunks.trim(CHUNKS)
        self.joins.trim(JOINS)
        self.seen += sum(len(c) for t in cut for c in t)
        self._encode_new(list({c for t in cut for c in t} - self.chunks.keys()))
        ends = [[(a.rsplit(" ", 1)[-1], b[: b.find(" ", 1)] if b.find(" ", 1) > 0 else b) for a, b in zip(t, t[1:], strict=False)] for t in cut]
        self._agree([p for e in ends for p in e])
        for t, e in zip(cut, ends, strict=True):
            ids: list[bytes] = []
            for k, c in enumerate(t):
                if k and not self.joins[e[k - 1]]:
                    ids = [self._repair("".join(t[:k]), c, b"".join(ids))]
                else:
                    ids.append(self.chunks[c])
            yield b"".join(ids)

    def decode(self, ids: list[bytes]) -> list[str]:
        if self.tokens is not None:
            token = self.tokens.__getitem__
            return [" ".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]
        return self.t.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(file: str) -> ChunkEncoder:
    """One for each worker and file; its caches are emptied at the end of each partition."""
    return ChunkEncoder(file)


def _parts(texts: Iterable[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def bpe_round_trip(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", outputs: bool = True) -> DataFrame:
    """Encodes every text and decodes the ids again.

    Returns for each row doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded
    text) and, with outputs, ids and decoded themselves. Null texts count as empty and have no ids; special tokens' strings in a
    text become their ids, as in the library; very long texts are encoded whole; a null id stays null; repeated rows stay; an empty
    table gives an empty result; further columns are ignored, whatever their names. For each partition the library encodes a chunk once
    while a bounded cache holds it, whichever texts share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file)
        for b in batches:
            row = 0
            for part in _parts(t or "" for texts in slices(b.column(1)) for t in texts):
                ids = list(e.encode(part))
                decoded = e.decode(ids)
                columns = {
                    "doc_id": b.column(0).slice(row, len(part)),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string()),
                }
                if outputs:
                    columns |= {"ids": pa.array([np.frombuffer(x, "<u4") for x in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                row += len(part)
                yield pa.RecordBatch.from_pydict(columns)
        e.chunks.clear()
        e.joins.clear()
        give_back()

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs)


def default_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(load(spark, sf_dir, "documents"), default_file(), outputs=False)
