"""Byte-pair encoding and decoding with a contiguous rank array.

The vocabulary file of a public tokenizer (its path is a parameter) gives merges,
normaliser steps and the splitting pattern. A word is an array of part boundaries with the rank of
each adjacent pair beside it; the loop scans for the smallest rank, deletes that
boundary and refreshes the ranks of its two neighbours. The scan is linear, which is best for the short
words that text is made of, and runs for thousands of words at once as rows of two numpy arrays. A word of
more than ``LONG`` bytes keeps the boundaries as a linked list with a heap, so a text without spaces stays near linear.

Cases: null and empty text give no tokens. Texts are encoded whole. Control strings of
the vocabulary (added tokens) inside a text are found before normalising, as the
reference library does, and give their own id. Repeated rows are encoded one by one.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Parts above which a word is merged with a heap.
LONG = 96
#: Pieces of text whose encoding an executor remembers; beyond that it starts anew.
REMEMBERED = 80_000
#: Characters above which a piece is not remembered.
REMEMBERED_LENGTH = 64
NEVER = 1 << 60
#: What Python's split() takes for white space and the vocabulary files' patterns don't.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def pattern(source: str) -> regex.Pattern:
    """A pattern of a vocabulary file, with white space as Unicode defines it."""
    return regex.compile(source.replace(r"\s", r"\p{White_Space}"))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def _joined(got: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    if not got:
        return 0, "", ""
    n, ids, names = zip(*got)
    if 0 in n:
        ids, names = filter(None, ids), filter(None, names)
    return sum(n), " ".join(ids), " ".join(names)


class Bpe:
    """Encoder for files of normaliser NFC / Replace / Lowercase, splitter Split and byte letters, with or without a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.letters = byte_letters()
        self.steps = self._steps(spec.get("normalizer"))
        self.pattern = None
        for step in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []):
            if step["type"] == "Split":
                self.pattern = pattern(step["pattern"]["Regex"])
        if self.pattern is None:
            raise ValueError("the vocabulary file has no splitting pattern")
        if not any(s[0] == "Replace" and s[2] == " " for s in self.steps):
            raise ValueError("the vocabulary file keeps white space; words would cross it")
        self.plain = [s[0] for s in self.steps] == ["NFC", "Replace", "Lowercase"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.marks = regex.compile("|".join(regex.escape(k) for k in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.ids.values()) + 1
        self.merged = np.array([self.ids[a + b] for a, b in merges], np.int64)
        keys = np.array([self.ids[a] * self.size + self.ids[b] for a, b in merges], np.int64)
        self.pair_keys, self.pair_ranks = np.unique(keys, return_index=True)
        # a byte without a token gets a number above all ids: it merges with nothing and is dropped
        self.letter_ids = np.array([self.ids.get(x, 2 * self.size) for x in self.letters], np.int64)
        self.final_ids = np.array([self.ids.get(x + self.suffix, 2 * self.size) for x in self.letters], np.int64)
        self.known: dict[str | int, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.known_words: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def _steps(spec: dict | None) -> list[tuple]:
        flat = spec["normalizers"] if spec and spec["type"] == "Sequence" else [spec] if spec else []
        out = []
        for s in flat:
            if s["type"] == "Replace":
                out.append(("Replace", pattern(s["pattern"]["Regex"]), s["content"]))
            elif s["type"] in ("NFC", "Lowercase"):
                out.append((s["type"],))
            else:
                raise ValueError(f"normaliser {s['type']} isn't supported")
        return out

    def normal(self, text: str) -> str:
        for step in self.steps:
            if step[0] == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step[0] == "Lowercase":
                # one character at a time, without the rule for a final sigma
                text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()
            else:
                text = step[1].sub(step[2], text)
        return text

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of words of the splitter. Short words of about one length are merged side by side, a row of the arrays for each."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int]] = [[]] * len(words)
        order = sorted((i for i, d in enumerate(data) if 0 < len(d) <= LONG), key=lambda i: len(data[i]))
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            for i, ids in zip(part, self._scan([data[i] for i in part])):
                out[i] = ids
        for i, d in enumerate(data):
            if len(d) > LONG:
                parts = [self.letters[b] for b in d]
                parts[-1] += self.suffix
                out[i] = [self.ids[p] for p in self._heap(parts) if p in self.ids]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NEVER)

    def _scan(self, data: list[bytes]) -> list[list[int]]:
        size = np.fromiter(map(len, data), np.int64, len(data))
        width = int(size.max())
        place = np.arange(width)
        inside = place < size[:, None]
        parts = np.full((len(data), width), -1, np.int64)
        parts[inside] = self.letter_ids[np.frombuffer(b"".join(data), np.uint8)]
        last = np.arange(len(data)), size - 1
        parts[last] = self.final_ids[np.frombuffer(bytes(d[-1] for d in data), np.uint8)]
        ranks = np.full((len(data), width), NEVER, np.int64)
        if width > 1:
            ranks[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
        rows = np.arange(len(data))
        while len(rows):
            i = ranks[rows].argmin(1)
            low = ranks[rows, i]
            go = low < NEVER
            rows, i, low = rows[go], i[go], low[go]
            if not len(rows):
                break
            # the boundary after part i goes: what stands right of it moves one place to the left
            move = np.minimum(place + (place > i[:, None]), width - 1)
            p, r = np.take_along_axis(parts[rows], move, 1), np.take_along_axis(ranks[rows], np.minimum(place + (place >= i[:, None]), width - 1), 1)
            p[:, -1], r[:, -1] = -1, NEVER
            at = np.arange(len(rows))
            p[at, i] = self.merged[low]
            has = i + 1 < width
            r[at[has], i[has]] = self._rank(p[at[has], i[has]], p[at[has], i[has] + 1])
            has = i > 0
            r[at[has], i[has] - 1] = self._rank(p[at[has], i[has] - 1], p[at[has], i[has]])
            parts[rows], ranks[rows] = p, r
        keep = (parts >= 0) & (parts < self.size)
        count = keep.sum(1)
        flat = parts[keep].tolist()
        ends = np.cumsum(count).tolist()
        return [flat[e - c : e] for c, e in zip(count.tolist(), ends)]

    def _heap(self, parts: list[str]) -> list[str]:
        get, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]), NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else -1
            if j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := get((parts[a], parts[after[a]]), NEVER)) < NEVER:
                    heapq.heappush(heap, (r, a, parts[a], parts[after[a]]))
        return [p for p in parts if p]

    def _pieces(self, text: str) -> list[str]:
        """The stretches of a text between white space, normalised."""
        if self.plain and not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.plain and not ODD_SPACE.search(text):
            # splitting drops the white space that the normaliser would first turn into spaces
            return (text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()).split()
        return self.normal(text).split(" ")

    def _split(self, text: str) -> list:
        """Pieces; a control string stands as its id."""
        if self.marks is None or not self.marks.search(text):
            return self._pieces(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self._pieces(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._pieces(text[at:])

    def _learn(self, pieces: list) -> dict:
        """Encodings of pieces, each (number of ids, ids joined by spaces, decoded text)."""
        out, rest = {}, []
        for p in pieces:
            if isinstance(p, int):
                out[p] = (1, str(p), self.names[p])
            elif (got := self.older.get(p)) is not None:
                out[p] = got
            else:
                rest.append((p, self.pattern.findall(p)))
        fresh = list({w for _, words in rest for w in words if w not in self.known_words})
        if len(self.known_words) + len(fresh) > REMEMBERED:
            self.known_words = {}
            fresh = list({w for _, words in rest for w in words})
        for w, ids in zip(fresh, self.words(fresh)):
            self.known_words[w] = (len(ids), " ".join(map(str, ids)), " ".join(map(self.names.__getitem__, ids)))
        for p, words in rest:
            got = [self.known_words[w] for w in words]
            out[p] = got[0] if len(got) == 1 else _joined(got)
        return out

    def encode_many(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by one space, decoded text) of each whole text.

        No word of the splitter crosses white space, so texts are encoded by the pieces
        between white space, and a piece seen before is looked up. Two generations of pieces are
        remembered: what is in use moves to the younger, so frequent pieces stay.
        """
        split = [self._split(t) if t else [] for t in texts]
        used = set().union(*split)
        self.known.update(self._learn(list(used - self.known.keys())))
        find = self.known.__getitem__
        out = [_joined(list(map(find, pieces))) for pieces in split]
        if len(self.known) > REMEMBERED:
            self.older = {k: v for k, v in self.known.items() if not isinstance(k, int) and len(k) <= REMEMBERED_LENGTH}
            self.known = {}
        return out

    def rest(self) -> None:
        """Between tasks only the younger generation of pieces stays in an executor's memory."""
        self.older, self.known_words = {}, {}

    def encode(self, text: str | None) -> tuple[int, str, str]:
        return self.encode_many([text])[0]

    def encode_ids(self, text: str | None) -> list[int]:
        ids = self.encode(text)[1]
        return list(map(int, ids.split(" "))) if ids else []

    def count(self, text: str | None) -> int:
        return self.encode(text)[0]

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives where a file names no decoder: the tokens, joined by one space."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One encoder for each executor process and file."""
    return Bpe(path)


def encode_table(docs, path: str, *, id: str = "doc_id", text: str = "text"):
    """One row for each input row: id, n_tokens, ids (the decimal ids joined by one space), decoded."""
    import gc

    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from .common import slices, small_batches

    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField(id, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = load(path)
        gc.disable()  # the tables hold no cycles, and walking them again and again would take most of the time
        try:
            for batch in batches:
                ids = batch.column(0)
                for start, texts in slices(batch, "__text"):
                    n, joined, decoded = zip(*bpe.encode_many(texts))
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())], names=schema.names)
        finally:
            bpe.rest()
            gc.enable()

    return small_batches(docs).select(F.col(id), F.col(text).alias("__text")).mapInArrow(run, schema)
