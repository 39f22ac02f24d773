"""Language identification by interpolated Kneser-Ney character models.

One model per language over words: a word is a run of letters without a digit beside it, lower-cased and
closed by boundary marks (a text without words is read by its other runs of letters), and the probability of each character is conditioned
on up to ``order - 1`` characters before it within the word. Probabilities of all
languages stand side by side in arrays sorted by the 64-bit hash of the n-gram.
A text gets the language of the lowest cross-entropy per character; a text
whose cross-entropy is above that language's limit for texts of its length is rejected.

The limits are calibrated, with no floor by hand. Held-out documents, whole and in pieces of 1, 2, 4, ... words, and the same pieces with the letters
of each word shuffled are scored like any text. For each predicted language and size the limit is the value that a twentieth of the shuffled pieces stays below, so a text
that holds a name or a key in a few words isn't rejected as long as it is nearer to the language than to its letters at random; where true pieces reach higher, as single words do, it is the highest true value or
the median of the shuffled ones, whichever is more, so true texts pass. A text's size is its effective number of words, (sum of n)^2 / sum of n^2 over its different words that occur n times: a line that repeats a hundred times
says no more than once.

Cases: null text, empty text and text without a letter give ``und``, score 0,
rejected. Rows with a null language train nothing. Without any labelled row every
text is ``und``. Equal cross-entropies go to the language that sorts first. Repeated
rows are predicted one by one. Other columns are carried along untouched.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams
from .common import slices, small_batches

LETTERS = regex.compile(r"\p{L}+")
#: Letters beside a digit belong to a code, such as a key or a part number, and to no language.
WORDS = regex.compile(r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})")
MARKS = ".,;:!?\"'()[]{}<>-_*#%&$/|="
OPEN, CLOSE = "\x02", "\x03"
#: Word pieces whose scores an executor remembers; beyond that it starts anew.
REMEMBERED = 100_000
#: Letters beyond which a run is scored in pieces, so that scripts without spaces stay bounded.
PIECE = 64
#: Sizes of texts that have a limit of their own: powers of two of effective words.
SIZES = 13


def words_of(text: str) -> list[str]:
    """The words of a lower-cased text; if it has none, the letters of its codes."""
    return WORDS.findall(text) or LETTERS.findall(text)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words between their marks, and each character's place in its word."""
    data = "".join(f"{OPEN}{w}{CLOSE}" for w in words)
    chars = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(first, size)
    return chars, place


def _ngrams(chars: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the characters that have n - 1 before them in the word: where they stand, n-gram hash, context hash."""
    at = np.flatnonzero(place >= max(n - 1, 1))
    return at, *_hashes(chars, at, n)


def _hashes(chars: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    context = np.full(len(at), 7 + n, np.uint64)
    for k in range(n - 1, 0, -1):
        context = context * grams.U(0x9E3779B97F4A7C15) + chars[at - k] + grams.U(1)
    return grams.mix(context * grams.U(0xD1342543DE82EF95) + chars[at] + grams.U(1)), grams.mix(context)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each wanted hash in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


@dataclass
class KneserNey:
    """Sorted hash arrays for each order: n-gram -> probability per language, context -> back-off weight per language."""

    langs: list[str]
    order: int
    floor: np.ndarray
    gram_keys: list[np.ndarray] = field(default_factory=list)
    gram_p: list[np.ndarray] = field(default_factory=list)
    context_keys: list[np.ndarray] = field(default_factory=list)
    context_w: list[np.ndarray] = field(default_factory=list)
    #: (languages, SIZES): bits a character above which a text of that size is rejected.
    limits: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, tuple[list[str], np.ndarray]], order: int = 5) -> KneserNey:
        """counts: language -> (words, how often each occurred)."""
        langs = sorted(counts)
        alphabet = len({c for words, _ in counts.values() for w in words for c in w}) + 1
        model = cls(langs, order, np.full(len(langs), 1.0 / (alphabet + 1)))
        per_order: list[list[tuple]] = [[] for _ in range(order)]
        for lang in langs:
            words, times = counts[lang]
            chars, place = _codes(words)
            weight = np.repeat(np.asarray(times, float), np.fromiter(map(len, words), np.int64, len(words)) + 2)
            for n in range(1, order + 1):
                at, gram, context = _ngrams(chars, place, n)
                keys, first, back = np.unique(gram, return_index=True, return_inverse=True)
                if n == order:
                    c = np.bincount(back, weight[at], len(keys))
                else:
                    # kinds of characters that stand before it; an n-gram that opens its word has nothing before it and keeps its own count
                    inner = place[at] >= n
                    pairs = np.unique((back[inner].astype(np.uint64) << grams.U(21)) | chars[at[inner] - n])
                    c = np.bincount((pairs >> grams.U(21)).astype(np.int64), minlength=len(keys)).astype(float)
                    opens = c == 0
                    c[opens] = np.bincount(back, weight[at], len(keys))[opens]
                per_order[n - 1].append((keys, c, context[first], place[at][first]))
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([x[0] for x in per_order[n - 1]])) if langs else np.zeros(0, np.uint64)
            p = np.full((len(keys), len(langs)), np.nan)
            contexts = np.unique(np.concatenate([x[2] for x in per_order[n - 1]])) if langs else np.zeros(0, np.uint64)
            w = np.ones((len(contexts), len(langs)))
            seen = []
            for j, (k, c, ctx, _) in enumerate(per_order[n - 1]):
                ctx_keys, ctx_of = np.unique(ctx, return_inverse=True)
                total = np.bincount(ctx_of, c)
                kinds = np.bincount(ctx_of).astype(float)
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = min(0.95, max(0.1, once / max(1.0, once + 2.0 * twice)))
                w[np.searchsorted(contexts, ctx_keys), j] = discount * kinds / total
                seen.append((np.searchsorted(keys, k), np.maximum(c - discount, 0.0) / total[ctx_of]))
            model.gram_keys.append(keys)
            model.context_keys.append(contexts)
            model.context_w.append(w)
            direct = np.zeros_like(p)
            for j, (row, share) in enumerate(seen):
                direct[row, j] = share
            model.gram_p.append(direct)
        model._interpolate(counts)
        return model

    def _interpolate(self, counts: dict) -> None:
        """Adds to each stored n-gram the weighted probability of its shorter form, shortest first."""
        words = sorted({w for ws, _ in counts.values() for w in ws})
        chars, place = _codes(words) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        lower = np.tile(self.floor, (len(chars), 1))
        for n in range(1, self.order + 1):
            at, gram, context = _ngrams(chars, place, n)
            row = np.searchsorted(self.gram_keys[n - 1], gram)
            keys, first = np.unique(row, return_index=True)
            weight = self.context_w[n - 1][np.searchsorted(self.context_keys[n - 1], context[first])]
            self.gram_p[n - 1][keys] += weight * lower[at[first]]
            lower[at] = self.gram_p[n - 1][row]
        self.gram_p = [x.astype(np.float32) for x in self.gram_p]
        self.context_w = [x.astype(np.float32) for x in self.context_w]

    def bits(self, words: list[str]) -> np.ndarray:
        """(words, languages): bits of each word with its closing mark.

        The longest n-gram that is stored answers for a character, under the back-off weights of the longer contexts; so most characters need one search.
        """
        chars, place = _codes(words)
        p = np.tile(self.floor.astype(np.float32), (len(chars), 1))
        weight = np.ones_like(p)
        left = np.flatnonzero(place >= 1)
        for n in range(self.order, 0, -1):
            able = place[left] >= n - 1
            at = left[able]
            gram, context = _hashes(chars, at, n)
            row, there = _found(self.gram_keys[n - 1], gram)
            hit, miss = at[there], at[~there]
            p[hit] = self.gram_p[n - 1][row[there]] * weight[hit]
            row, known = _found(self.context_keys[n - 1], context[~there])
            weight[miss[known]] *= self.context_w[n - 1][row[known]]
            left = np.concatenate([left[~able], miss])
        p[left] *= weight[left]
        bits = -np.log2(np.maximum(p, 1e-12))
        bits[place == 0] = 0
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        return np.add.reduceat(bits, np.cumsum(size) - size, axis=0)


class Scorer:
    """Scores texts piece by piece; a piece between white space is scored once and remembered."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs) + 2))

    def _learn(self, pieces: list[str]) -> None:
        words, owner = [], []
        for i, piece in enumerate(pieces):
            bare = piece.strip(MARKS)
            for run in (bare,) if bare.isalpha() else WORDS.findall(piece):
                for k in range(0, len(run), PIECE):
                    words.append(run[k : k + PIECE])
                    owner.append(i)
        values = np.zeros((len(pieces), self.table.shape[1]))
        for lo in range(0, len(words), 10_000):
            part = words[lo : lo + 10_000]
            own = np.array(owner[lo : lo + 10_000])
            bits = self.model.bits(part)
            for j in range(bits.shape[1]):
                values[:, j] += np.bincount(own, bits[:, j], len(pieces))
            values[:, -2] += np.bincount(own, np.fromiter(map(len, part), float, len(part)) + 1, len(pieces))
            values[:, -1] += np.bincount(own, minlength=len(pieces))
        first = len(self.rows)
        if first + len(pieces) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), first + len(pieces)), self.table.shape[1]))
            grown[:first] = self.table[:first]
            self.table = grown
        self.table[first : first + len(pieces)] = values
        self.rows.update(zip(pieces, range(first, first + len(pieces))))

    def totals(self, texts: list[str]) -> np.ndarray:
        """(texts, languages + 2): bits per language, characters, effective words."""
        split = [t.lower().split() for t in texts]
        new = list(set().union(*split) - self.rows.keys())
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows.clear()
            new = list(set().union(*split))
        if new:
            self._learn(new)
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, pieces in enumerate(split):
            if pieces:
                rows = np.fromiter(map(self.rows.__getitem__, pieces), np.int64, len(pieces))
                rows, times = np.unique(rows, return_counts=True)
                known = self.table[rows]
                out[i] = times @ known
                said = times * known[:, -1]
                if out[i, -1]:
                    out[i, -1] = out[i, -1] ** 2 / (said @ said)
                elif runs := LETTERS.findall(texts[i].lower()):
                    cut = [r[k : k + PIECE] for r in runs for k in range(0, len(r), PIECE)]
                    out[i] = [*self.model.bits(cut).sum(0), sum(map(len, cut)) + len(cut), len(set(cut))]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits a character, rejected."""
        n = len(self.model.langs)
        total = self.totals(texts)
        chars, size = total[:, n], total[:, n + 1]
        lang, score, entropy, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        if not n:
            return lang, score, entropy, rejected
        has = size > 0
        mean = total[:, :n] / np.maximum(chars, 1)[:, None]
        best = mean.argmin(1)
        gap = np.minimum((total[:, :n] - total[np.arange(len(texts)), best][:, None]), 1000)
        score[has] = (1 / np.exp2(-gap).sum(1))[has]
        low = mean[np.arange(len(texts)), best]
        entropy[has] = low[has]
        rejected[has] = (low > self.limit(best, size))[has]
        for i in np.flatnonzero(has):
            lang[i] = self.model.langs[best[i]]
        return lang, score, entropy, rejected

    def limit(self, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.model.limits is None:
            return np.full(len(best), np.inf)
        return self.model.limits[best, size_of(size)]


def size_of(words: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(words, 1))), 0, SIZES - 1).astype(np.int64)


def _sample(labelled: DataFrame, key: Column, per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language, chosen by a hash of the key: (lang, part, text).

    Languages differ in size, so each has a share of its own; the counts behind the
    shares are one row per language.
    """
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.xxhash64(key) / F.lit(float(2**64)) + 0.5
    return labelled.join(F.broadcast(sizes), "lang").where(share * F.col("n") < per_lang)


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 1000, order: int = 5) -> KneserNey:
    """Fits on at most about ``per_lang`` whole documents of each language, a documented bound.

    Four fifths give the word counts; the rest gives the calibration. The driver gets the different words of these documents with their counts, and
    a row for each piece of the calibration documents; so what it holds grows with the number of languages and the length of ``per_lang`` documents, not with the corpus.
    """
    rows = small_batches(labelled).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    chosen = _sample(rows, F.col("k"), per_lang).withColumn("part", F.pmod(F.xxhash64("k", F.lit(5)), F.lit(5)))

    def words(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            out: dict[tuple[str, str], int] = {}
            for name, t in zip(langs, texts):
                for run in words_of(t.lower()):
                    for k in range(0, len(run), PIECE):
                        at = (name, run[k : k + PIECE])
                        out[at] = out.get(at, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([w for _, w in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "word", "n"])

    counted = chosen.where("part > 0").select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, tuple[list, list]] = {}
    for name, word, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n"))):
        got = counts.setdefault(name, ([], []))
        got[0].append(word)
        got[1].append(n)
    # by word, so that the sums don't depend on the order in which partitions arrive
    ordered = {k: sorted(zip(*v)) for k, v in counts.items()}
    model = KneserNey.fit({k: ([w for w, _ in v], np.array([n for _, n in v], float)) for k, v in ordered.items()}, order)
    if model.langs:
        _calibrate(model, chosen.where("part = 0").select("text"))
    return model


def pieces(text: str) -> list[str]:
    """The whole text and, for each power of two, up to four runs of so many words spread over it."""
    words = text.split()
    out = [text]
    size = 1
    while size < len(words):
        room = len(words) - size
        for at in sorted({room * k // 3 for k in range(4)}):
            out.append(" ".join(words[at : at + size]))
        size *= 2
    return out


def shuffled(text: str) -> str:
    """The text with the letters of each word in another order, which depends on the text alone."""
    order = random.Random(text)
    return LETTERS.sub(lambda m: "".join(order.sample(m[0], len(m[0]))), text.lower())


def _calibrate(model: KneserNey, rows: DataFrame) -> None:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                for real, whole in ((True, texts), (False, [shuffled(t) for t in texts])):
                    some = [x for t in whole for x in pieces(t)]
                    total = scorer.totals(some)
                    total = total[total[:, -1] > 0]
                    mean = total[:, :-2] / total[:, -2:-1]
                    yield pa.RecordBatch.from_arrays([pa.array(mean.argmin(1)), pa.array(size_of(total[:, -1])), pa.array(mean.min(1)), pa.array([real] * len(total), pa.bool_())], names=["j", "size", "bits", "real"])

    seen = rows.mapInArrow(measure, "j long, size long, bits double, real boolean").toPandas()
    model.limits = limits(seen.j.to_numpy(), seen["size"].to_numpy(), seen.bits.to_numpy(), seen.real.to_numpy(), len(model.langs))


def limits(lang: np.ndarray, size: np.ndarray, bits: np.ndarray, real: np.ndarray, langs: int) -> np.ndarray:
    """(langs, SIZES): the limit of each language and size; a size without true pieces takes that of the next smaller one, one without shuffled pieces at least that, a language without any those of all languages together."""

    def of(rows: np.ndarray) -> np.ndarray:
        out = np.full(SIZES, np.inf)
        for k in range(SIZES):
            true, false = bits[rows & (size == k) & real], bits[rows & (size == k) & ~real]
            if not len(true):
                out[k] = out[k - 1] if k else np.inf
            elif not len(false):
                out[k] = max(true.max(), out[k - 1] if k and np.isfinite(out[k - 1]) else 0.0)
            else:
                low = np.quantile(false, 0.05)
                out[k] = low if true.max() < low else max(true.max(), np.median(false))
        return out

    every = of(np.ones(len(lang), bool))
    rows = [lang == j for j in range(langs)]
    return np.array([of(r) if (r & real).any() else every for r in rows]).reshape(langs, SIZES)


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_char", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: KneserNey, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred, score, bits_per_char and rejected; own columns of these names are replaced."""
    docs = small_batches(docs).drop(*(f.name for f in PREDICTED if f.name != text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for start, texts in slices(batch, text):
                lang, value, entropy, rejected = scorer.predict(texts)
                own = [batch.column(i).slice(start, len(texts)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(value), pa.array(entropy, from_pandas=True), pa.array(rejected)], names=[*names, *(f.name for f in PREDICTED)])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *PREDICTED]))
