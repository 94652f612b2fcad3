"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans are the leftmost non-overlapping matches of one pattern a kind that also pass
its check. The field reads zones: stretches of words with a digit or an `@`. A zone is
cut into segments of whole words and at most LONGEST tokens, each a kind that its characters allow or (one token)
nothing; features look at whole segments (digits, separators, checksum, parts, what
stands beside it), and dynamic programming over boundaries and kinds picks the best cut.
It is trained by gradient steps on the likelihood of base spans in a bounded sample of
documents, and on the same zones with a phone's country code taken off. Its segments that
overlap no base span are added; base spans stay.

A zone may be a whole table of numbers: its segments are made and scored STEP tokens at a time, and what the whole
zone keeps is a score and a step back for each token.

Null text is empty and has no spans; repeated rows and null doc_ids keep a row each; an empty table gives no rows; other columns are
left out by `detected` and kept by `redacted`, whatever their names. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import map_text, table

KINDS = ("email", "ip", "card", "phone")
#: At most so many documents are learnt from.
SAMPLE = 400
#: Documents looked at for each that may be learnt from.
LOOKED = 20
LONGEST = 20
WIDTH = 1 << 12
#: Tokens of a zone whose segments are held at a time.
STEP = 512

_SEEN = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_NUMERIC = re.compile(r"[0-9().+,;:-]+\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all base matches, by start, then kind. Each kind takes time linear in the text."""
    out = []
    if not _SEEN.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:  # a match's first part is the whole run before its @, back to the last match
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):  # each four numbers in a row of dotted numbers are a match
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end, 1))
            at = end + 1
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches worth reading: words with a digit or @, joined over one space while both sides are numeric."""
    out: list[tuple[int, int]] = []
    numeric = False
    for m in _WORD.finditer(text):
        if not _SEEN.search(text, m.start(), m.end()):
            continue
        now = bool(_NUMERIC.match(text, m.start(), m.end()))
        if out and numeric and now and out[-1][1] + 1 == m.start():
            out[-1] = (out[-1][0], m.end())
        else:
            out.append((m.start(), m.end()))
        numeric = now
    return out


def _side(c: str) -> str:
    return "a" if c.isalpha() else "d" if c.isdigit() else "s" if c.isspace() or not c else c


def _hash(s: str) -> int:
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h % WIDTH


_memo: dict[str, int] = {}


def _numbers(names: list[str]) -> list[int]:
    out = []
    for n in names:
        if n not in _memo:
            if len(_memo) > 100_000:
                _memo.clear()
            _memo[n] = _hash(n)
        out.append(_memo[n])
    return out


def _whole(s: str, left: str, right: str) -> list[str]:
    """Features of a segment's text and of the characters beside it."""
    d = _digits(s)
    parts = s.split(".")
    ip = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    email = s.count("@") == 1 and bool(s.split("@")[0]) and bool(_DOMAIN.fullmatch(s.split("@")[1]))
    grouped = re.sub(r"[0-9]+", lambda m: str(len(m.group())), s) if len(s) < 30 and not re.search(r"[A-Za-z@]", s) else "x"
    return [
        "bias",
        f"d{min(len(d), 20)}",
        f"ip{ip}",
        f"email{email}",
        f"luhn{14 <= len(d) <= 19 and luhn(d)}{bool(re.fullmatch(r'[0-9 -]+', s))}",
        f"plus{s[0] == '+'}{10 <= len(d) <= 15}",
        f"alpha{any(c.isalpha() for c in s)}{'@' in s}",
        f"dots{min(s.count('.'), 4)}",
        f"g{grouped}",
        f"ends{_side(s[0])}{_side(s[-1])}",
        f"left{_side(left)}{_side(s[0])}",
        f"right{_side(s[-1])}{_side(right)}",
    ]


WHOLE = 12
_PLAUSIBLE = [re.compile(p) for p in (r"[^@]+@[^@]*[A-Za-z][^@]*", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[ -]?[0-9])+", r"[+(]?[0-9][0-9 ().+-]*[0-9]")]
_PLAUSIBLE_DIGITS = [(0, 99), (4, 12), (13, 19), (9, 15)]


def plausible(s: str, digits: int, at: bool) -> list[int]:
    """Kinds that a segment with so many digits, and an @ or none, may be at all."""
    return [k for k, (p, (a, b)) in enumerate(zip(_PLAUSIBLE, _PLAUSIBLE_DIGITS)) if a <= digits <= b and (at or k) and p.fullmatch(s)]


def token_edges(text: str, begin: int, end: int) -> array:
    return array("q", [*(m.start() for m in _TOKEN.finditer(text, begin, end)), end])


_shapes: dict[tuple, list] = {}


def _candidates(s: str, shape: str, digits: int, at: bool, left: str, right: str) -> list[tuple[int, list[int]]]:
    """The kinds that a segment may be, with their feature numbers.

    `shape` is s with the lengths of its runs of digits in their place: all that features ask of it besides is whether it is a card's or an address's numbers."""
    card = 14 <= digits <= 19 and luhn(_digits(s))
    address = shape.count(".") == 3 and digits <= 12 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in s.split("."))
    key = shape, card, address, _side(left), _side(right)
    found = _shapes.get(key)
    if found is None:
        if len(_shapes) > 50_000:
            _shapes.clear()
        kinds = plausible(s, digits, at)
        names = _whole(s, left, right) if kinds else []
        found = [(k, _numbers([f"{k}:{x}" for x in names])) for k in kinds]
        if len(shape) < 100:
            _shapes[key] = found
    return found


def segments_from(text: str, edges: array, first: int, last: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """The candidate segments (token from, to, kind; -1 nothing) that begin at tokens first to last - 1 of a zone, and their feature numbers (rows of WHOLE, 0 filled)."""
    n, segments, rows = len(edges) - 1, [], []
    for i in range(first, last):
        token = text[edges[i] : edges[i + 1]]
        kind = "d" + str(min(len(token), 20)) if token.isdigit() else "a" if token.isalpha() else token
        segments.append((i, i + 1, -1))
        rows.append([*_numbers(["O:bias", f"O:{kind}"]), *[0] * (WHOLE - 2)])
        left = text[max(edges[i] - 1, 0) : edges[i]]
        if not (token[0].isalnum() or token[0] in "+(") or left.isalnum():
            continue
        farthest, digits, at, shape = min(n, i + LONGEST), 0, False, ""
        mail = text.find("@", edges[i], edges[farthest]) >= 0
        for j in range(i + 1, farthest + 1):
            c = text[edges[j - 1]]
            at |= c == "@"
            if "0" <= c <= "9":
                digits += edges[j] - edges[j - 1]
                if digits > 19 and not mail:  # too long for any kind, and so is what follows
                    break
                shape += f"#{edges[j] - edges[j - 1]}"
            else:
                shape += c if edges[j] - edges[j - 1] == 1 else text[edges[j - 1] : edges[j]]
            right = text[edges[j] : edges[j] + 1]
            if digits < 4 and not at or not text[edges[j] - 1].isalnum() or right.isalnum():
                continue
            for k, numbers in _candidates(text[edges[i] : edges[j]], shape, digits, at, left, right):
                segments.append((i, j, k))
                rows.append(numbers)
    return segments, np.array(rows, np.int64).reshape(-1, WHOLE)


def lattice(text: str, begin: int, end: int) -> tuple[array, list[tuple[int, int, int]], np.ndarray]:
    """A zone's token edges, and all its candidate segments with their feature numbers."""
    edges = token_edges(text, begin, end)
    return edges, *segments_from(text, edges, 0, len(edges) - 1)


def _scores(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[rows].sum(axis=1)


def decode(n: int, parts: Iterable[tuple[list[tuple[int, int, int]], np.ndarray]]) -> list[tuple[int, int, int]]:
    """The best cut of a zone's n tokens, without the segments that are nothing, from (segments, scores) in order of their first tokens."""
    best, back, kind = array("d", [0.0]) + array("d", [-np.inf]) * n, array("q", [0]) * (n + 1), array("b", [0]) * (n + 1)
    for segments, scores in parts:
        for (i, j, k), s in zip(segments, scores.tolist()):  # a first token's best is final by then
            if best[i] + s > best[j]:
                best[j], back[j], kind[j] = best[i] + s, i, k
    out, at = [], n
    while at:
        if kind[at] >= 0:
            out.append((back[at], at, kind[at]))
        at = back[at]
    return out[::-1]


def best_segments(text: str, begin: int, end: int, w: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the segments of a zone's best cut."""
    edges = token_edges(text, begin, end)
    n = len(edges) - 1
    parts = (segments_from(text, edges, a, min(n, a + STEP)) for a in range(0, n, STEP))
    for i, j, k in decode(n, ((segments, _scores(rows, w)) for segments, rows in parts)):
        yield edges[i], edges[j], k


def _expected(n: int, segments: list[tuple[int, int, int]], scores: np.ndarray) -> np.ndarray:
    """Each segment's chance of being in the cut."""
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0.0
    for (i, j, _), s in zip(segments, scores):
        a[j] = np.logaddexp(a[j], a[i] + s)
    for (i, j, _), s in zip(reversed(segments), scores[::-1]):
        b[i] = np.logaddexp(b[i], b[j] + s)
    at = np.array([(i, j) for i, j, _ in segments])
    return np.exp(a[at[:, 0]] + scores + b[at[:, 1]] - a[n])


def _gold(text: str, begin: int, end: int) -> list[tuple[int, int, int]]:
    """Base spans in a zone, those that overlap an earlier one left out."""
    out: list[tuple[int, int, int]] = []
    for s in base_spans(text[begin:end]):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return [(begin + a, begin + b, k) for a, b, k in out]


def train(texts: list[str], epochs: int = 6, rate: float = 0.3, l2: float = 1e-3, most: int = 1200) -> np.ndarray:
    """Weights fitted to base spans of at most `most` zones of the texts."""
    examples = []

    def add(text: str, begin: int, end: int, gold: list[tuple[int, int, int]]) -> None:
        edges, segments, rows = lattice(text, begin, end)
        place = {e: i for i, e in enumerate(edges)}
        want, at = {}, 0
        for a, b, k in gold:
            if a not in place or b not in place or place[b] - place[a] > LONGEST:
                return
            want[place[a]] = (place[a], place[b], k)
        chosen = np.zeros(len(segments))
        number = {s: i for i, s in enumerate(segments)}
        while at < len(edges) - 1:
            s = want.get(at, (at, at + 1, -1))
            if s not in number:
                return
            chosen[number[s]] = 1
            at = s[1]
        examples.append((len(edges) - 1, segments, rows, chosen))

    for text in texts:
        for begin, end in zones(text):
            if len(examples) >= most or end - begin > 200:
                continue
            gold = _gold(text, begin, end)
            add(text, begin, end, gold)
            for a, b, k in gold:
                local = re.match(r"\+[0-9]{1,3} (?=.*[0-9].*)", text[a:b]) if k == 3 else None
                if local and len(_digits(text[a + local.end() : b])) >= 10:
                    short = text[:a][-20:] + text[a + local.end() : end]
                    shift = len(text[:a][-20:])
                    add(short, shift, len(short), [(shift, shift + b - a - local.end(), 3)] if b == end else [])
    w, g2 = np.zeros(WIDTH), np.full(WIDTH, 1e-2)
    for _ in range(epochs):
        for n, segments, rows, chosen in examples:
            p = chosen - _expected(n, segments, _scores(rows, w))
            g = np.bincount(rows.reshape(-1), np.repeat(p, WHOLE), minlength=WIDTH) - l2 * w
            g[0] = 0.0  # 0 fills short rows
            g2 += g * g
            w += rate * g / np.sqrt(g2)
    return w


def all_spans(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: these and the field's segments that overlap none of them."""
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    added = []
    if _SEEN.search(text):
        for begin, end in zones(text):
            for a, b, k in best_segments(text, begin, end, w):
                before = bisect_left(starts, b)  # base spans that begin before its end
                if not before or reach[before - 1] <= a:
                    added.append((a, b, k))
    return base, sorted([*base, *added], key=lambda s: (s[0], s[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each stretch of touching or overlapping spans replaced by its first kind in angle brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """Weights from at most `rows` documents with a digit or @ and of at most 20,000 characters, of the LOOKED * rows documents with the least hash of id and text."""
    looked = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__mark"), F.col("text").cast("string").alias("__text"))
    total = docs.count()
    if total > LOOKED * rows:
        looked = looked.where(F.pmod(F.xxhash64("__id", "__mark", F.lit(5)), F.lit(1 << 30)) < int(LOOKED * rows / total * (1 << 30)))
    seen = looked.where("length(__text) <= 20000 and __text rlike '[0-9@]'")
    return train([r["__text"] for r in seen.orderBy(F.xxhash64("__id", "__mark"), "__id").limit(rows).collect()])


def detected(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans of every row of docs."""

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for t in slab.column(1).to_pylist():
            base, every = all_spans(t or "", w)
            counts.append([sum(s[2] == k for s in base) for k in range(4)])
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([slab.column(0), *columns, pa.array(digests), pa.array(spans)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """docs' rows and columns with every span of text replaced by its kind; null text stays null."""
    at = docs.columns.index("text")

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if not t or not _SEEN.search(t) else redact(t, all_spans(t, w)[1]) for t in slab.column(at).to_pylist()]
        columns = list(slab.columns)
        columns[at] = pa.array(texts, slab.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names=slab.schema.names)

    return map_text(docs, run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detected(docs, fit(docs))
