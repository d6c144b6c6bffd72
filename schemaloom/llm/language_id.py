"""Operator 5, language ID: interpolated Kneser-Ney character models, one per language.

Words, rid of everything but letters and lower-cased, are padded at the start and closed by an end
mark; a model gives each of their characters a probability from the ``ORDER - 1`` characters
before it. The top order holds counts, the lower ones continuation counts; each order is
discounted and interpolated with the next lower one, down to a uniform one. Every order of every
language is a sorted array of 64-bit hashes with the interpolated probabilities beside it and, for
contexts, the weights that pass to the lower order; lookups are binary searches on whole arrays.

A text's cross-entropy under a language is the sum over its words divided by its characters. The
lowest one wins. ``score`` is the winner's share when the cross-entropies are weighed as evidence
of at most ``EVIDENCE`` characters. ``rejected`` is calibrated
on a tenth of the sample that is kept out of the counts: for each language, the deviation of a text's
cross-entropy from that fold's mean, times the root of its characters, that all but ``ERROR`` of the
fold's texts stay below. A text that deviates more is not taken for that language with confidence; the
label stays the best one that was learned. Where the fold has fewer than ``FOLD_TEXTS`` texts of a language,
nothing is rejected for it.

The models learn from a bounded sample: about ``SAMPLE_DOCS`` documents a language, chosen by a
hash of doc_id, from their whole texts. Each word's sums are kept in a bounded table, so a text
costs a lookup a word.

Defined results: null texts and texts without a letter get ``und`` with score 0. With nothing to
learn from, every text gets ``und``. Ties go to the first language by name. A null doc_id counts
as not held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

ORDER, SAMPLE_DOCS, DISCOUNT = 4, 1500, 0.75
EVIDENCE = 60
#: Share of a language's own texts that calibration lets be rejected; texts that it needs; one part in so many is kept out.
ERROR, FOLD_TEXTS, FOLDS = 0.01, 20, 10
CACHE_WORDS, LONGEST_KEPT = 200_000, 64
START, STOP = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of the top order by language, summed over the task."""
    grams: dict[str, Counter] = defaultdict(Counter)
    for batch in small_batches(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words[lang].update(text.lower().split())
        for lang, own in words.items():
            for w, n in own.items():
                if w := letters(w):
                    s = START * (ORDER - 1) + w + STOP
                    for i in range(len(s) - ORDER + 1):
                        grams[lang][s[i : i + ORDER]] += n
    for lang, own in grams.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "gram": list(own), "n": pa.array(own.values(), pa.int64())})


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of what ``h`` stands for with one character before it."""
    h = (h ^ (c + np.uint64(1))) * _MIX
    return h ^ (h >> np.uint64(31))


class Model:
    """One language. ``probs[k]``: hashes and probabilities of (k+1)-grams; ``passes[k]``: of their contexts."""

    def __init__(self, grams: dict[str, int]):
        self.probs, self.passes = [], []
        counts = {g: float(n) for g, n in grams.items()}
        levels = [counts]
        for _ in range(ORDER - 1):
            lower: Counter = Counter(g[1:] for g in levels[-1])  # in how many ways a shorter gram goes on to the left
            levels.append({g: float(n) for g, n in lower.items()})
        levels.reverse()
        alphabet = {g for g in levels[0]}
        self.uniform = 1.0 / (len(alphabet) + 1)
        below: dict[str, float] = {}
        for k, level in enumerate(levels):
            total, kinds = Counter(), Counter()
            for g, n in level.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            on = {c: DISCOUNT * kinds[c] / total[c] for c in total}
            below = {g: max(n - DISCOUNT, 0.0) / total[g[:-1]] + on[g[:-1]] * (below[g[1:]] if k else self.uniform) for g, n in level.items()}
            self.probs.append(self._array(below))
            self.passes.append(self._array(on))

    @staticmethod
    def _array(own: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        names = list(own)
        size = len(names[0]) if names else 0
        h = np.zeros(len(names), np.uint64)
        if size:
            table = codes("".join(names)).reshape(-1, size)
            for j in range(size - 1, -1, -1):  # the last character first, as queries grow to the left
                h = _extend(h, table[:, j])
        order = np.argsort(h)
        return h[order], np.array([own[n] for n in names])[order]

    @staticmethod
    def _find(array: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(array[0], h), len(array[0]) - 1)
        return array[0][at] == h, array[1][at]

    def bits(self, ends: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """-log2 of each position's probability. ends[k], contexts[k]: hashes of its (k+1)-gram and of the k characters before it."""
        p = np.full(len(ends[0]), self.uniform)
        for k in range(ORDER):
            known, on = self._find(self.passes[k], contexts[k])
            p = np.where(known, on * p, p)
            known, own = self._find(self.probs[k], ends[k])
            p = np.where(known, own, p)
        return -np.log2(p)


class Models:
    def __init__(self, grams: dict[str, dict[str, int]]):
        self.langs = sorted(grams)
        self.models = [Model(grams[x]) for x in self.langs]
        self.mean, self.limit = np.zeros(len(self.langs)), np.full(len(self.langs), np.inf)

    def calibrate(self, fold: list[tuple[str, float, float]]) -> None:
        """fold: language, cross-entropy under its model and characters of texts kept out of the counts."""
        for j, lang in enumerate(self.langs):
            own = np.array([(h, n) for x, h, n in fold if x == lang]).reshape(-1, 2)
            if len(own) >= FOLD_TEXTS:
                self.mean[j] = np.median(own[:, 0])
                self.limit[j] = np.quantile((own[:, 0] - self.mean[j]) * own[:, 1] ** 0.5, 1 - ERROR)

    def rejects(self, j: int, entropy: float, n: float) -> bool:
        return bool((entropy - self.mean[j]) * n**0.5 > self.limit[j])

    @staticmethod
    def _hashes(c: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """c: positions by ORDER, the character itself last."""
        ends, contexts, e, x = [], [np.zeros(len(c), np.uint64)], np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
        for k in range(ORDER):
            e = _extend(e, c[:, ORDER - 1 - k])
            ends.append(e)
            if k < ORDER - 1:
                x = _extend(x, c[:, ORDER - 2 - k])
                contexts.append(x)
        return ends, contexts

    def _bits(self, grams: list[str], models: list[Model], whole: bool = False) -> list[np.ndarray]:
        ends, contexts = self._hashes(codes("".join(grams)).reshape(-1, ORDER))
        return [m.bits(ends, contexts) for m in models]

    def words(self, words: list[str]) -> np.ndarray:
        """For each word, its bits under each language, and its characters with the end mark."""
        out = np.zeros((len(words), len(self.models) + 1))
        spelled = [letters(w) for w in words]
        some = [i for i, w in enumerate(spelled) if w]
        for lo in range(0, len(some), 20_000):
            part = some[lo : lo + 20_000]
            text = codes("".join(START * (ORDER - 1) + spelled[i] + STOP for i in part))
            sizes = np.array([len(spelled[i]) + 1 for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = np.repeat(starts - first, sizes) + np.arange(sizes.sum())
            ends, contexts = self._hashes(text[at[:, None] + np.arange(ORDER)])
            for j, m in enumerate(self.models):
                out[part, j] = np.add.reduceat(m.bits(ends, contexts), first)
            out[part, -1] = sizes
        return out


class Words:
    """Rows of ``Models.words`` for the words seen last, in a bounded table."""

    def __init__(self, models: Models):
        self.models, self.place, self.rows = models, {}, np.zeros((0, len(models.langs) + 1))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").lower().split() for t in texts]
        seen = set().union(*split) if split else set()
        new = [w for w in seen if w not in self.place]
        if len(self.place) + len(new) > CACHE_WORDS:
            new, self.place, self.rows = list(seen), {}, self.rows[:0]
        self.place |= {w: len(self.rows) + i for i, w in enumerate(new)}
        self.rows = np.concatenate([self.rows, self.models.words(new)])
        out = np.zeros((len(texts), len(self.models.langs) + 1))
        for i, words in enumerate(split):
            if words:
                out[i] = self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0)
        for w in [w for w in new if len(w) > LONGEST_KEPT]:
            del self.place[w]
        return out


def _predict(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    own: Models = models.value
    words = Words(own)
    for batch in small_batches(batches, 4 << 20):
        sums = words.texts(batch.column("text").to_pylist())
        n = sums[:, -1]
        labels, scores, entropies, rejected = [], [], [], []
        for i in range(batch.num_rows):
            if not n[i] or not own.langs:
                labels.append("und"), scores.append(0.0), entropies.append(None), rejected.append(True)
                continue
            h = sums[i, :-1] / n[i]
            best = int(h.argmin())
            labels.append(own.langs[best])
            scores.append(float(1 / np.exp2((h[best] - h) * min(n[i], EVIDENCE)).sum()))
            entropies.append(float(h[best]))
            rejected.append(own.rejects(best, h[best], n[i]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])


def _fold(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    """Each text's cross-entropy under the model of its own language, and its characters."""
    own: Models = models.value
    words = Words(own)
    for batch in small_batches(batches, 4 << 20):
        sums = words.texts(batch.column("text").to_pylist())
        rows = [(x, s[own.langs.index(x)] / s[-1], s[-1]) for x, s in zip(batch.column("lang").to_pylist(), sums) if x in own.langs and s[-1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))], ["lang", "h", "n"])


def fit(train: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models from about ``sample_docs`` documents of each language of ``train`` (doc_id, text, lang)."""
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return Models({})
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = train.where(draw < F.element_at(rate, F.col("lang")) * (1 << 20))
    kept_out = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == 0
    rows = sample.where(~kept_out).select("lang", "text").mapInArrow(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator()
    grams: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in rows:
        grams[lang][gram] = n
    models = Models(grams)
    own = train.sparkSession.sparkContext.broadcast(models)
    models.calibrate([tuple(r) for r in sample.where(kept_out).select("lang", "text").mapInArrow(partial(_fold, models=own), "lang string, h double, n double").collect()])
    return models


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """docs: doc_id, text, held_out. One pass, no shuffle."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select("doc_id", "text", "held_out").mapInArrow(partial(_predict, models=docs.sparkSession.sparkContext.broadcast(models)), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    models = fit(docs.where("not held_out and lang is not null and text is not null").select("doc_id", "text", "lang"))
    return predict(docs, models)
