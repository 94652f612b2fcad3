"""Words, hashes and shingles of many texts at a time, as numpy arrays.

For features of models, a slab of texts is laid end to end and hashed by one pass of prefix sums: a word's hash
is a polynomial in its bytes modulo 2^64, finished by a bijective mixer. Such hashes may be made to collide, so
shingles take their words' keyed digests instead, and links are confirmed on the words themselves.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_P, _P_INV)):
            a = np.full(size, base, U)
            a[0] = U(1)
            _powers[i] = np.cumprod(a)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Mixed words as numbers in (0, 1)."""
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def prefix_sums(data: np.ndarray) -> np.ndarray:
    power, _ = _powers_to(len(data) + 1)
    prefix = np.empty(len(data) + 1, U)
    prefix[0] = 0
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=prefix[1:])
    return prefix


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each run, from data's prefix sums."""
    if not len(starts):
        return np.empty(0, U)
    _, inverse = _powers_to(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_sums(data), starts, ends)


def lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a space after each, and where each begins (one more entry for the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return data, begins


def word_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't white space. data ends in a space."""
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    np.logical_not(IS_SPACE[data], out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


#: 0 white space, 1 part of a word (letters, digits, all beyond ASCII), 2 anything else.
CLASS = np.full(256, 2, np.uint8)
CLASS[128:] = CLASS[48:58] = CLASS[65:91] = CLASS[97:123] = 1
CLASS[IS_SPACE] = 0


def class_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of the runs of one class, white space left out."""
    c = CLASS[data]
    edges = np.flatnonzero(np.diff(c)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(c)]])
    kind = c[starts]
    keep = kind > 0
    return starts[keep], ends[keep], kind[keep]


#: Words longer than this are digested one by one.
LONG_WORD = 256


def word_digests(texts: list[bytes], key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes (two rows) of all words, one text after the other, and where each text's words begin (one more entry for the end).

    Words are read eight bytes at a time, all words together. Hashes depend on a key, which callers draw for each run, so that no text can be made
    to collide; all tasks of a run share it."""
    data, at = lay(texts)
    starts, ends = word_runs(data)
    begins = np.searchsorted(starts, at)
    length = ends - starts
    lanes = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    seeds = np.frombuffer(blake2b(key, digest_size=32, key=b"words").digest(), "<u8").astype(U)
    out = np.stack([mix(length.astype(U) * (seeds[i] | U(1)) ^ seeds[2 + i]) for i in (0, 1)])
    short = np.flatnonzero(length <= LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        short = short[length[short] > j]
        if not len(short):
            break
        lane, left = lanes[starts[short] + j], length[short] - j
        lane = np.where(left >= 8, lane, lane & ((U(1) << (np.minimum(left, 7).astype(U) * U(8))) - U(1)))
        for i in (0, 1):
            out[i, short] = mix((out[i, short] ^ lane) * (seeds[i] | U(1)) + seeds[2 + i])
    for w in np.flatnonzero(length > LONG_WORD):
        out[:, w] = np.frombuffer(blake2b(data[starts[w] : ends[w]].tobytes(), digest_size=16, key=key).digest(), "<u8")
    return out, begins


_LOWER = LOWER.tobytes()


def split(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than 32 and 9 to 13."""
    return text.translate(_LOWER).split()


def shingle_sets(texts: list[bytes], k: int, key: bytes = b"", at_once: int = 500_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct k-word shingles (of lower-cased words) as sorted hashes, and a second, independent hash of each; with fewer words the whole sequence as one; without
    words none. Hashes of one key can be compared.

    Texts are hashed about `at_once` bytes at a time, whatever their number."""
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) > at_once:
            out += _shingle_sets(part, k, key)
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + _shingle_sets(part, k, key) if part else out


def _shingle_sets(texts: list[bytes], k: int, key: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    h, begins = word_digests([t.translate(_LOWER) for t in texts], key)
    n, counts = h.shape[1], np.diff(begins).tolist()
    if n >= k:
        rolled = np.zeros((2, n - k + 1), U)
        for j in range(k):
            rolled = rolled * U(0xD1342543DE82EF95) + h[:, j : n - k + 1 + j]
        rolled = mix(rolled)
    out, a = [], 0
    for count in counts:
        b = a + count
        if count >= k:
            s, where = np.unique(rolled[0, a : b - k + 1], return_index=True)
            out.append((s, rolled[1, a : b - k + 1][where]))
        elif count:
            x = np.full(2, count, U)
            with np.errstate(over="ignore"):
                for j in range(a, b):
                    x = x * U(0xD1342543DE82EF95) + h[:, j]
            x = mix(x ^ U(0x5851F42D4C957F2D))
            out.append((x[:1], x[1:]))
        else:
            out.append((np.empty(0, U), np.empty(0, U)))
        a = b
    return out


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted numbers, which are equal just where the shingles of these texts are equal.

    Nothing is hashed away: words are numbered, then pairs of numbers, until a number stands for k words. With fewer words the whole
    sequence is one shingle (its number is negative)."""
    names: dict[bytes, int] = {}
    number = lambda w: names.setdefault(w, len(names))
    words = [np.fromiter(map(number, w), np.int64, len(w)) for w in map(split, texts)]
    code, width = np.concatenate([np.empty(0, np.int64), *words]), 1
    while width < k and len(code) > k - width:
        if width > 1:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        step = min(width, k - width)  # two windows of `width` words, `step` apart, hold width + step words
        code, width = code[:-step] << 32 | code[step:], width + step
    short: dict[bytes, int] = {}
    out, a = [], 0
    for w in words:
        if len(w) >= k:
            out.append(np.unique(code[a : a + len(w) - k + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(w.tobytes(), len(short))] if len(w) else [], np.int64))
        a += len(w)
    return out
