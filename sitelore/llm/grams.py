"""Vectorised 64-bit hashes of words and of runs of words.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` in the UTF-8
text, with A-Z lower-cased, so a word hash is a function of those bytes alone
and equal on every executor.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


_BYTE = stream(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, step in (("up", _STEP), ("down", _BACK)):
            steps = np.full(size, step, U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Words:
    """The words of several texts: hash, byte span, and the first word of each text."""

    def __init__(self, texts: list[str], bare: bool = False):
        """With ``bare``, letters of any case are equal and ASCII punctuation separates words, too."""
        if bare:
            texts = [t.lower() for t in texts]
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        b = np.frombuffer(self.data, np.uint8)
        space = (_NO_WORD if bare else _SPACE)[b]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        up, down = _power(len(b))
        total = np.zeros(len(b) + 1, U)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        raw = (total[self.ends] - total[self.starts]) * down[self.starts]
        self.hashes = mix(raw ^ (self.ends - self.starts).astype(U))
        self.first = np.searchsorted(self.starts, self.offsets)

    def text(self, a: int, b: int) -> str:
        """The text from word a up to and without word b."""
        return self.data[self.starts[a] : self.ends[b - 1]].decode("utf-8", "surrogatepass")


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (of the whole array; the caller drops runs over an edge)."""
    if len(words) < n:
        return np.zeros(0, U)
    odd = stream(n, 1000 + n) | U(1)
    total = words[: len(words) - n + 1] * odd[0]
    for k in range(1, n):
        total = total + words[k : len(words) - n + 1 + k] * odd[k]
    return mix(total)


def shingle_sets(texts: list[str], n: int = 5):
    """For each text its sorted distinct n-word shingle hashes; shorter texts give one shingle of all words."""
    words = Words(texts)
    grams = rolled(words.hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            yield x[keep]
        elif b > a:
            yield rolled(words.hashes[a:b], b - a)
        else:
            yield np.zeros(0, U)
