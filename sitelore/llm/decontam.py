"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Test items go to the executors in blocks of at most ``block_words`` words, so what is broadcast is
bounded whatever the size of the benchmark; each block is one scan of the corpus. Every n-gram of an item is a seed, however
often it occurs, so results don't depend on the rest of the corpus. Where a
seed occurs in a document, the item would cover a stretch there. A score of ``least`` needs that share of the item's words
in the stretch; a stretch that has them is aligned with the item by local alignment over
words (match 2, mismatch and gap -1), so a common phrase by itself costs a count of words. The score is the best sum over twice the number of the item's words; edits,
insertions and cuts lower it. Words are compared without case and ASCII punctuation. Everything happens where the document is read; nothing but results moves.

Cases: null and empty texts of documents and items give nothing. An item or document with a null id is matched like any other and has a null in its rows; ``drop_leaks`` can't name such a document and keeps it. An item of fewer than ``n`` words is looked for as a whole.
Repeated items (same id) are one item for each text; repeated documents are matched one by one. An empty benchmark or
corpus gives an empty result. A document gives one row for each item, with the best of its stretches. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams
from .common import broadcast_if_small, cut, slices, small_batches

BITS = 20


class Seeds:
    """n-grams of a block of items by hash: sorted, each with the items and word places that have it."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.ids = [i for i, _ in items]
        words = grams.Words([t for _, t in items], bare=True)
        self.words = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.n = n
        entries = []
        for k, w in enumerate(self.words):
            size = min(n, len(w))
            if size:
                g = grams.rolled(w, size)
                entries.append(np.stack([g, np.full(len(g), size, np.uint64), np.full(len(g), k, np.uint64), np.arange(len(g), dtype=np.uint64)], 1))
        table = np.concatenate(entries) if entries else np.zeros((0, 4), np.uint64)
        self.table = table = table[np.lexsort((table[:, 3], table[:, 2], table[:, 0]))]
        self.hashes, self.first = np.unique(table[:, 0], return_index=True)
        self.last = np.append(self.first[1:], len(table))
        self.sizes = sorted({int(x) for x in table[:, 1]})
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.hashes >> grams.U(64 - BITS)).astype(np.int64)] = True

    def hits(self, words: grams.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word places, n-gram numbers) of all seeds in the texts; none runs over the edge of a text."""
        at, what = [], []
        for size in self.sizes:
            g = grams.rolled(words.hashes, size)
            maybe = np.flatnonzero(self.seen[(g >> grams.U(64 - BITS)).astype(np.int64)])
            row = np.minimum(np.searchsorted(self.hashes, g[maybe]), len(self.hashes) - 1)
            ok = self.hashes[row] == g[maybe]
            ok &= self.table[self.first[row], 1] == size
            place, row = maybe[ok], row[ok]
            text = np.searchsorted(words.first, place, side="right") - 1
            inside = place + size <= words.first[text + 1]
            at.append(place[inside])
            what.append(row[inside])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(what)


def align(stretch: np.ndarray, filled: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score and its last column, for rows of padded stretches against one item."""
    rows, width = stretch.shape
    h = np.zeros((rows, width + 1), np.int32)
    best, where = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    step = np.arange(width + 1, dtype=np.int32)
    for w in item:
        match = np.where((stretch == w) & filled, 2, -1)
        now = np.zeros_like(h)
        np.maximum(h[:, :-1] + match, h[:, 1:] - 1, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        # a gap along the stretch costs 1 a word: a running maximum of score + place
        h = np.maximum.accumulate(now + step, axis=1) - step
        top = h.max(1)
        better = top > best
        where[better] = h.argmax(1)[better]
        best = np.maximum(best, top)
    return best, where


def _stretches(seeds: Seeds, words: grams.Words, entries: int = 2_000_000) -> Iterator[np.ndarray]:
    """Rows (text, item, first word, end word, seeds) of all stretches that some seed asks for, in parts of whole texts; overlapping ones are one."""
    at, what = seeds.hits(words)
    order = np.argsort(at, kind="stable")
    at, what = at[order], what[order]
    count = (seeds.last - seeds.first)[what]
    text = np.searchsorted(words.first, at, side="right") - 1
    length = np.fromiter(map(len, seeds.words), np.int64, len(seeds.words))
    room = np.maximum(4, length // 4)
    edges = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(at))
    before = np.append(0, np.cumsum(count))
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(before[edges], before[edges[lo]] + entries, side="right")) - 1)
        part, lo = slice(edges[lo], edges[hi]), hi
        n = count[part]
        entry = seeds.table[np.repeat(seeds.first[what[part]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        item, t = entry[:, 2].astype(np.int64), np.repeat(text[part], n)
        start = np.repeat(at[part], n) - entry[:, 3].astype(np.int64)
        first = np.maximum(start - room[item], words.first[t])
        end = np.minimum(start + length[item] + room[item], words.first[t + 1])
        by = np.lexsort((end, first, item, t))
        t, item, first, end = t[by], item[by], first[by], end[by]
        # stretches of one item are equally long but for the edges of the text, so ends are in order, too
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (first[1:] > end[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(t)) - 1
        yield np.stack([t[begin], item[begin], first[begin], end[last], last - begin + 1], 1)


def _enough(stretch: np.ndarray, filled: np.ndarray, item: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of padded stretches share so many words with the item that they can score ``least``: 2 for each shared word is the most."""
    known, count = np.unique(item, return_counts=True)
    row = np.minimum(np.searchsorted(known, stretch), len(known) - 1)
    shared = (known[row] == stretch) & filled
    has = np.zeros((len(stretch), len(known)), bool)
    has[np.nonzero(shared)[0], row[shared]] = True
    return np.minimum(shared.sum(1), has @ count) / len(item) >= least - 1e-9


def _scored(seeds: Seeds, words: grams.Words, least: float, cells: int = 2_000_000) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """(text, item) -> best (score, seeds, first word, end word) in that text, of all that score ``least``."""
    found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for stretches in _stretches(seeds, words):
        wide = stretches[:, 3] - stretches[:, 2]
        stretches = stretches[np.lexsort((wide, stretches[:, 1]))]
        for all_ in np.split(stretches, np.flatnonzero(np.diff(stretches[:, 1])) + 1):
            if not len(all_):
                continue
            item = seeds.words[int(all_[0, 1])]
            at = 0
            while at < len(all_):
                # rows of like width, up to ``cells`` places
                size = np.arange(1, len(all_) - at + 1) * (all_[at:, 3] - all_[at:, 2])
                part = all_[at : at + max(1, int(np.searchsorted(size, cells, side="right")))]
                at += len(part)
                place = np.arange(int(part[-1, 3] - part[-1, 2])) + part[:, 2:3]
                filled = place < part[:, 3:4]
                stretch = words.hashes[np.minimum(place, len(words.hashes) - 1)]
                ok = _enough(stretch, filled, item, least)
                if not ok.any():
                    continue
                best, where = align(stretch[ok], filled[ok], item)
                for (t, k, lo, _, n), b, w in zip(part[ok].tolist(), best.tolist(), where.tolist()):
                    first = int(words.first[t])
                    got = (b / (2 * len(item)), n, lo - first, lo + w - first)
                    if got[0] >= least and got > found.get((t, k), (-1.0,)):
                        found[t, k] = got
    return found


def _blocks(items: DataFrame, id: str, text: str, block_words: int):
    """Blocks of about ``block_words`` words at most, by a hash of the id."""
    rows = items.select(F.col(id).alias("id"), F.col(text).alias("text")).where("length(text) > 0")
    words = rows.agg(F.sum(F.size(F.split("text", r"[ \t\n\x0B\f\r]+")))).first()[0] or 0
    n = max(1, -(-words // block_words))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted(((r.id, r.text) for r in part.distinct().collect()), key=lambda x: (x[0] is None, str(x[0]), x[1]))


def matches(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 4, least: float = 0.45, block_words: int = 2_000_000) -> DataFrame:
    """Rows (id, item_id, score, seeds, first_word, end_word) of documents that hold a test item with a score of ``least`` or more."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("score", T.DoubleType()), T.StructField("seeds", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    out = None
    for block in _blocks(items, item_id, item_text, block_words):
        seeds = Seeds(block, n)
        shared = spark.sparkContext.broadcast(seeds)

        def score(batches, shared=shared):
            seeds = shared.value
            for batch in batches:
                ids = batch.column(0)
                for start, texts in slices(batch, "__text", 1_000_000):
                    found = sorted(_scored(seeds, grams.Words(texts, bare=True), least).items())
                    own = ids.take(pa.array([start + t for (t, _), _ in found], pa.int64()))
                    named = pa.array([seeds.ids[i] for (_, i), _ in found], schema_item)
                    yield pa.RecordBatch.from_arrays([own, named, *(pa.array([v[c] for _, v in found], kind) for c, kind in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.int64())))], names=schema.names)

        from pyspark.sql.pandas.types import to_arrow_type

        schema_item = to_arrow_type(items.schema[item_id].dataType)
        part = rows.mapInArrow(score, schema)
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that hold a test item; the columns stay as they are."""
    leaked = cut(matches(docs, items, id=id, **options).select(F.col(id).alias("__leaked")).distinct())
    return docs.join(broadcast_if_small(leaked), F.col(f"`{id}`") == F.col("__leaked"), "left_anti")
