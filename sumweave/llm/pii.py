"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes for what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, give_back, load, slices

#: Kinds with an exact pattern, and a further one that only the field finds.
KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
#: Labels of words: none, and for each kind its first word and any other one.
LABELS = ("other", *(f"{x}-{k}" for k in FOUND for x in ("begin", "inside")))
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Stands between lines and texts among the words, which are UTF-8 and so never have this byte.
BREAK = b"\xff"
#: Words, and classes of words with equal features, beyond which a worker's caches start anew; words in the runs that are decoded at once.
WORDS, CLASSES, TOGETHER = 300_000, 50_000, 200_000
#: By how much `other` leads where nothing else may stand.
BARRED = 1e4

#: The labelled table from which the field learns; spans are written {kind text}.
TABLE = """
call me on {phone (212) 555-0147} after six
you can reach the office at {phone 212-555-0188} or by mail
phone {phone 0044 20 7946 0958} for orders
tel. {phone 030/901820-55} in the morning
her number is {phone (415) 555-2671}, not the old one
fax {phone 415.555.0132} is switched off
ring {phone (0)20 7946 0018} today
contact {phone 1-800-555-0199} toll free
mobile {phone 0170 5550 1234} only at night
the lines {phone (212) 555-0147} {phone (415) 555-2671} are busy
call {phone (303) 555-0101} {phone (303) 555-0102} or write
either {phone 212-555-0110} {phone 212-555-0111} will do
thing of {phone +1 (617) 555-0126} {ip 10.4.200.17} and on
erat {phone +1 (826) 555-4081} {ip 192.0.2.44} du la
und {phone +1 (404) 555-9913} {card 4111111111111111} den
{phone +44 20 7946 0958} {phone +44 20 7946 0018} are both hers
la de {phone +1 (012) 555-7021} 415 y los
write to {email anna.berg (at) example.org} before noon
send it to {email info[at]example.com} please
mail {email j.doe@localhost} for help
address {email sales(at)shop.example.net} is read daily
write to {email anna.berg at example.org} before noon
mail {email j.smith at mail.example.com} for help
reach {email m_lopez at example.net}, she answers
send it to {email press [at] example.org} today
email {email tom.reed AT example DOT com} about it
contact {email support at example dot org} with questions
it looked at example.org and left
meet us at noon at the gate
we stayed at home at last
look at section 4 at page 12
the server {ip 10.0.0.254:8080} answers slowly
host {ip 192.168.1.77/24} is down
ping {ip 172.16.254.1:22} failed twice
from {ip [198.51.100.23]} came three requests
servers {ip 10.1.2.3} {ip 10.1.2.4} were moved
card {card 4111.1111.1111.1111} was refused
visa {card 5500/0000/0000/0004} expires soon
paid with {card 3400_000000_00009} in the shop
card {card 4012.8888.8888.1881} is valid
cards {card 4111.1111.1111.1111} {card 5555.5555.5555.4444} were used
token = "{secret cb1a9fee807a05366fcb8b6c95c7c565ede51a72}" was leaked
token = "{secret 04dbebab91ab85687d33eeaaf9ac699e1188f962}" la de
TOKEN = "{secret 9233A8ECF7C5B09FE5949719B6B82BC439E9329B}"!! AND!! THE!!
and token = "{secret ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e}"### of### the###
key 908038b7daaf91e730d2f64 is a number
api_key = "{secret sk4f0a81bb29c7d65e03}" in the file
secret: {secret 7f3c9ad81e0b442fa6d5} must go
password = "{secret Tr0ub4dor93xk2}" is weak
token: {secret ghp0a8Zk39XqLm27Rt51Vb} expired
commit 9233a8ecf7c5b09f5949719b6b82bc439e9329ba is the last
sha 0f343b0931126a20f133d67c2b018a3b of the file
token is a word that means little
the key = value form is old
on 12 May 2021 it rained for 3 days
the meeting of 2023-11-05 starts at 10:30
chapter 12.4 has 300 pages and 15 tables
version 2.0 of the library came in 1999
page 1, 2, and 3 are missing
it costs 1,250.00 euros or 1.100,50 francs
order 20391 has 12 items of 450 g
he scored 21-17 in the final of 2019
isbn 978-3-16-148410-0 was reprinted
room 101 on floor 3 is closed
follow @anna on the network
see @123 and #45 there
licensed under the apache license, version 2.0.
this work is under the public license, version 3.
licensed under cc by-nc 4.0.
number 9807915762804490 is no known code
of ueadoos 9807915762804490 raie and esllra
THE!! 5927243074273351!! OF!! THING!!
erat the 9000426309966109 reand in
a total of 18446744073709551616 grains
between 1914-1918 and 1939-1945 two wars
rule 66/402/EEC and act 12(3)(b) apply
at 50% of 1/3 it was 16.7 points
ratio 3:2 at 25.5 degrees on 01/02/2003
flight 447 left gate 12 at 18.05
the and of thing one in her
no numbers stand in this line at all
La ciónci de los. Nicht aulich und en, des et
THE!! END!! OF!! IT!!
be%%% thonheat&&& heor*** ble&&& an%%%
asos | de | la | quequeos. | y | los
"""


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        start = done + len(t[done:at].rstrip(LOCAL))
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)  # nothing that starts before this @ can match
        at = t.find("@", max(done, at + 1))


def _ips(t: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(t):
        if run[0].count(".") >= 3:
            parts = [(m.start(), m.end(), m[0].lstrip("0")) for m in _NUMBER.finditer(t, run.start(), run.end())]
            for k in range(0, len(parts) - 3, 4):
                if all(len(p[2]) <= 3 and int(p[2] or "0") <= 255 for p in parts[k : k + 4]):
                    yield parts[k][0], parts[k + 3][1]


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the exact patterns, sorted. Every step is linear in the text, whatever stands in it."""
    found = []
    if "@" in t:
        found += [(s, 0, e) for s, e in _emails(t)]
    if _NUMBER.search(t):
        if "." in t:
            found += [(s, 1, e) for s, e in _ips(t)]
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14:
                digits = re.sub("[^0-9]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


_EDGE = ".,;:!?\"'()[]{}<>#*$%&|="
_CASES = ((re.compile("[0-9]{5,}"), "D"), (re.compile("[0-9]"), "d"), (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "x"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"))
#: Words that matter to their neighbours.
CUES = frozenset("= at (at) [at] dot call phone tel fax mobile ring number contact reach office lines write send mail address email host server servers from ping card cards visa paid token api_key secret password key commit sha version page section order isbn".split())


def shape(word: str) -> str:
    """Digits as d, five and more as D, runs of letters as x and X, all else as it is."""
    for case, letter in _CASES[::-1]:  # letters first: no letter that stands for a case is read again
        word = case.sub(letter if letter in "xX" else lambda m, n=letter: "\x01" if n == "D" else "\x00", word)
    return word.replace("\x01", "D").replace("\x00", "d")


def _size(n: int) -> str:
    """A number as one of some ranges."""
    return next((str(k) for k in (0, 1, 2, 3, 4, 6, 9, 13, 15, 19, 24, 39) if n <= k), "more")


def features(word: str) -> tuple[str, ...]:
    """What the field sees of a word, from all its characters; the time is linear in its length."""
    if word == "\n":
        return ("edge",)
    bare = word.strip(_EDGE)
    low = bare.lower() or word.lower()
    cue = ("cue=" + low,) if low in CUES else ("cue=" + word.lower(),) if word.lower() in CUES else ()
    if bare.isalpha():
        return ("word", "upper" if bare.isupper() and len(bare) > 1 else "lower", *cue)
    n = sum(map(str.isdigit, bare))
    form = shape(bare)
    marks = re.sub(r"[^()\[\]+@/.:_-]", "", word)
    out = ["shape=" + form, "marks=" + marks, "digits=" + _size(n), "length=" + _size(len(bare)), *cue]
    out += ["mark=" + m for m in sorted(set(marks))]
    if '"' in word:
        out.append("quoted")
    if n:
        letters = any(map(str.isalpha, bare))
        out.append("mixed" if letters else "pure")
        if letters:
            out.append("turns=" + _size(len(re.findall(r"[0-9]+", bare))))
        elif 14 <= n <= 19:
            out.append(f"luhn={luhn(re.sub('[^0-9]', '', bare))}")
        if _DOTTED.fullmatch(bare) and bare.count(".") == 3:
            out.append(f"quad={all(len(p) <= 3 and int(p) <= 255 for p in bare.split('.'))}")
    return tuple(out)


class Field:
    """A linear-chain CRF: weights for the features of a word and of the two words on either side, and for label pairs.

    Every line of a text is a sequence between two breaks, which are words of their own with the label other.
    """

    SIDES = (0, -1, 1, -2, 2)

    def __init__(self, table: str = TABLE, rounds: int = 250, rate: float = 0.5, decay: float = 1e-2, stiff: float = 1.0):
        lines = [self._parse(x) for x in table.strip().splitlines()]
        words = [["\n", "\n", *w, "\n", "\n"] for w, _ in lines]
        names: dict[str, int] = {}
        n, longest, size = len(lines), max(map(len, words)) - 2, len(LABELS)
        gold, live = np.zeros((n, longest, size)), np.zeros((n, longest, 1))
        at, active = [], []
        for i, (w, (_, y)) in enumerate(zip(words, lines, strict=True)):
            each = [features(x) for x in w]
            for k in range(1, len(w) - 1):
                own = [names.setdefault(f"{side}{f}", len(names)) for side in self.SIDES if 0 <= k + side < len(w) for f in each[k + side]]
                active += own
                at += [i * longest + k - 1] * len(own)
                gold[i, k - 1, y[k - 2] if 2 <= k < len(w) - 2 else 0] = live[i, k - 1] = 1
        at, active = np.array(at), np.array(active)
        by = np.argsort(active, kind="stable")
        begin = np.searchsorted(active[by], np.arange(len(names)))
        w, trans = np.zeros((len(names), size)), np.zeros((size, size))
        seen_w, seen_t = 1e-8, 1e-8
        pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
        first = np.searchsorted(at, np.unique(at))
        for _ in range(rounds):  # gradient of the log-likelihood by forward and backward sums, AdaGrad steps
            e = np.zeros((n * longest, size))
            e[np.unique(at)] = np.add.reduceat(w[active], first, axis=0)
            p, q = self._marginals(e.reshape(gold.shape), trans, live)
            miss = ((gold - p) * live).reshape(-1, size)
            gw, gt = np.add.reduceat(miss[at[by]], begin, axis=0) - decay * w, pairs - q - stiff * trans
            seen_w, seen_t = seen_w + gw * gw, seen_t + gt * gt
            w, trans = w + rate * gw / np.sqrt(seen_w), trans + rate * gt / np.sqrt(seen_t)
        self.trans = trans
        self.weights = {f: w[i] for f, i in names.items()}
        # against `other` throughout, a stretch of other labels gains at most so much by label pairs: once, and for each word
        pair = trans[1:, 1:].max() - trans[0, 0]
        self.gain = float(pair), float(trans[0, 1:].max() + trans[1:, 0].max() - 2 * trans[0, 0] - pair)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.classes: dict[tuple[str, ...], int] = {}
        self.vectors = np.zeros((0, len(self.SIDES), len(LABELS)))
        self.margins = np.zeros((0, len(self.SIDES)))
        self._class(["\n"])
        self.words[BREAK] = 0

    @staticmethod
    def _parse(line: str) -> tuple[list[str], list[int]]:
        words, labels = [], []
        for m in re.finditer(r"([^\s{]*)\{(\w+) ([^}]*)\}(\S*)|(\S+)", line):
            part = (m[1] + m[3] + m[4]).split() if m[2] else [m[5]]
            words += part
            begin = LABELS.index(f"begin-{m[2]}") if m[2] else 0
            labels += [begin, *[begin + 1] * (len(part) - 1)] if m[2] else [0]
        return words, labels

    @staticmethod
    def _marginals(e: np.ndarray, trans: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length, size = e.shape
        e = np.exp(e - e.max(axis=2, keepdims=True))
        m = np.exp(trans)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            a = (f[:, t - 1] @ m) * e[:, t]
            f[:, t] = np.where(live[:, t] > 0, a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300), 0)
        b[:, -1] = 1
        for t in range(length - 2, -1, -1):
            a = np.where(live[:, t + 1] > 0, (b[:, t + 1] * e[:, t + 1]) @ m.T, 1.0)
            b[:, t] = a / a.sum(axis=1, keepdims=True)
        p = f * b
        p = p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
        q = np.zeros((size, size))
        for t in range(length - 1):
            j = f[:, t, :, None] * m * (b[:, t + 1] * e[:, t + 1])[:, None, :] * live[:, t + 1, :, None]
            q += (j / np.maximum(j.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
        return p, q

    def _class(self, words: list[str]) -> list[int]:
        """Numbers of the classes of some words: words with the same features add the same emissions."""
        found = [features(w) for w in words]
        new = [f for f in dict.fromkeys(found) if f not in self.classes]
        self.classes.update(zip(new, range(len(self.classes), len(self.classes) + len(new)), strict=True))
        if new:
            zero = np.zeros(len(LABELS))
            v = np.array([[sum((self.weights.get(f"{-side}{f}", zero) for f in fs), zero) for side in self.SIDES] for fs in new])
            self.vectors = np.concatenate([self.vectors, v])  # side k: what a word adds to the one k places further on
            self.margins = np.concatenate([self.margins, v[:, :, 0] - v[:, :, 1:].max(axis=2)])
        return [self.classes[f] for f in found]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The class of each word."""
        if len(self.words) > WORDS or len(self.classes) > CLASSES:
            self._forget()
        new = list(set(words) - self.words.keys())
        self.words.update(zip(new, self._class([w.decode("utf-8", "surrogatepass") for w in new]), strict=True))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def _emissions(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Emissions at some places of a row of classes; a break stands before its first and after its last."""
        out = self.vectors[c[at], 0]
        for j, side in enumerate(self.SIDES[1:], 1):
            out = out + self.vectors[c[(at - side).clip(0, len(c) - 1)], j]
        return out

    def _stretches(self, lead: np.ndarray) -> np.ndarray:
        """For each word the most that a stretch of other labels around it can gain over `other`, from how far `other` leads at every word: largest sums
        of ranges that hold a place, by running sums and their running extremes."""
        each, once = self.gain
        upto = np.concatenate([[0.0], np.cumsum(each - lead)])
        return np.maximum.accumulate(upto[:0:-1])[::-1] - np.minimum.accumulate(upto[:-1]) + once + 1e-3

    def decode(self, words: list[bytes]) -> np.ndarray:
        """The likeliest label of every word of lines that stand between breaks, by Viterbi.

        A stretch of words with other labels than `other` stands between two of these, so the best path has none whose emissions lose more than its label
        pairs can gain. For every word the best of such stretches around it is bounded (`_stretches`); those for which the bound is
        below zero are `other`, and the words in between are decoded in batches of runs, with `other` on both sides. The
        result is that of Viterbi over whole lines.
        """
        c = self.ids(words)
        y = np.zeros(len(c), np.int8)
        lead = self.margins[c, 0]
        for j, side in enumerate(self.SIDES[1:], 1):
            lead = lead + self.margins[np.concatenate([np.zeros(side, np.int64), c[:-side]]) if side > 0 else np.concatenate([c[-side:], np.zeros(-side, np.int64)]), j]
        at = np.flatnonzero(self._stretches(np.where(c > 0, lead, BARRED)) >= 0)
        if not len(at):
            return y
        e = self._emissions(c, at)
        exact = np.full(len(c), BARRED)
        exact[at] = e[:, 0] - e[:, 1:].max(axis=1)
        exact[c == 0] = BARRED
        open_ = self._stretches(exact)[at] >= 0
        at, e = at[open_], e[open_]
        if not len(at):
            return y
        begin = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        length = np.diff(np.append(begin, len(at)))
        order = np.argsort(length, kind="stable")
        k = 0
        while k < len(order):
            many = max(1, min(len(order) - k, TOGETHER // int(length[order[k]])))
            while many > 1 and length[order[k + many - 1]] * many > TOGETHER:
                many //= 2
            part = order[k : k + many]
            k += many
            for run, labels in zip(part, self._viterbi(e, begin[part], length[part]), strict=True):
                y[at[begin[run]] + np.arange(length[run])] = labels[: length[run]]
        return y

    def _viterbi(self, e: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The best labels (runs, longest run) of runs of emissions with `other` on both sides."""
        n, longest = len(begin), int(length.max())
        score = e[begin] + self.trans[0]
        back = np.zeros((longest, n, len(LABELS)), np.int8)
        for t in range(1, longest):
            step = score[:, :, None] + self.trans
            back[t] = step.argmax(axis=1)
            now = step.max(axis=1) + e[np.minimum(begin + t, len(e) - 1)]
            score = np.where((t < length)[:, None], now, score)
        y = np.zeros((n, longest), np.int8)
        last = (score + self.trans[:, 0]).argmax(axis=1)
        each = np.arange(n)
        for t in range(longest - 1, -1, -1):
            y[:, t] = last
            last = np.where(t < length, back[t, each, last], last) if t else last
        return y


def _plausible(kind: int, s: str) -> bool:
    """Whether what the field has found can be of its kind at all."""
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        return "." in s or "@" in s or bool(re.search(r"\bat\b|\bdot\b", s, re.I))
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", s) and len(re.findall("[0-9]+", s)) > 1
    return len(s) >= 8 and not re.search(r"\s", s)


def _runs(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first word, last word) of what the labels of a text's words mark; an inside label that continues nothing begins a span."""
    out: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(labels).tolist():
        kind, inside = (int(labels[k]) - 1) // 2, labels[k] % 2 == 0
        if inside and out and out[-1][0] == kind and out[-1][2] == k - 1:
            out[-1] = (kind, out[-1][1], k)
        else:
            out.append((kind, k, k))
    return out


def find_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the base spans, and all spans: the base ones and those of the field that overlap none of them."""
    words, ends = [], []
    for t in texts:
        words += [BREAK, *t.encode("utf-8", "surrogatepass").replace(b"\n", b" \xff ").split()]  # bytes split at ASCII blanks alone
        ends.append(len(words))
    labels = field.decode(words)
    out, begin = [], 0
    for t, end in zip(texts, ends, strict=True):
        base = base_spans(t)
        more = []
        mine = labels[begin:end]
        if mine.any():
            mine = mine[np.fromiter((w != BREAK for w in words[begin:end]), bool, end - begin)]
            breaks = np.fromiter((w == BREAK for w in words[begin:end]), bool, end - begin)
            line = np.cumsum(breaks)[~breaks]
            at = [m.span() for m in _TOKEN.finditer(t)]
            for kind, x, y in _runs(mine):
                parts = [[x, x]]
                for k in range(x + 1, y + 1):  # no span goes on in the next line
                    if line[k] == parts[-1][0] or line[k] == line[k - 1]:
                        parts[-1][1] = k
                    else:
                        parts.append([k, k])
                for p, q in parts:
                    a, b = at[p][0], at[q][1]
                    b = a + len(t[a:b].rstrip(".,;:!?\"'>#*$%&|="))
                    a = b - len(t[a:b].lstrip(".,;:!?\"'<#*$%&|="))
                    if a < b and _plausible(kind, t[a:b]) and not any(s < b and a < e for s, _, e in base):
                        more.append((a, kind, b))
        out.append((base, sorted(base + more)))
        begin = end
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{FOUND[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table: str = TABLE) -> DataFrame:
    """Personal data in every text: doc_id, n_email, n_ip, n_card, n_phone (counts of the base patterns), base_sha256, spans.

    spans has the base patterns' spans and those that the CRF adds, as kind:start:end in code points, joined by commas; the field also knows
    secrets (kind secret, after the others). It is trained on the driver from the small table and decodes every word of every text;
    a span of it that overlaps a base span is left out. Null texts count as empty; very long texts and words are read whole,
    in linear time; a null id stays null; repeated rows stay; an empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    field = Field(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for part in slices(b.column(1)) for x in find_spans([t or "" for t in part], field)]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            digest = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
            columns = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([_written(x) for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", table: str = TABLE) -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans become the first one's kind.

    The length column, if there is one, is set to the new text's code points. A null text stays null, empty ones stay empty, and so do all other columns,
    whatever their names; repeated rows stay; an empty table gives an empty result.
    """
    field = Field(table)
    names = docs.columns

    def masked(t: str, spans: list[tuple[int, int, str]]) -> str:
        out, done = [], 0
        for s, k, e in spans:
            if s >= done:
                out += [t[done:s], f"<{FOUND[k].upper()}>"]
            done = max(done, e)
        return "".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                texts = part.column(at).to_pylist()
                found = find_spans([t or "" for t in texts], field)
                new = [t if t is None else masked(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, b.schema.field(at).type)
                if length in names:
                    n = names.index(length)
                    columns[n] = pa.array([old if t is None else len(t) for t, old in zip(new, columns[n].to_pylist(), strict=True)], b.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, names)
        field._forget()
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(load(spark, sf_dir, "documents"))
