"""Operator 3, benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Each passage of each training text is a query; the items are the indexed side. Items are indexed by
length, those of up to 16, 64, 256 .. words together. A passage is a window of twice the longest item of
an index, every window starting that many words after the last, so every copy of an item lies whole in
a window that isn't much longer than items of its kind. Impacts are divided by the item's threshold (a share of
the score that the item's own text gets), so one bound of 1 serves all items. Items stand in
blocks; for each term and block the greatest impact is known. For all windows of a batch at once,
arrays sum these maxima over the window's distinct terms; a block that stays below 1 holds no item
for the window. The surviving pairs of window and block go through WAND, whose pivots skip within
the block, and which retrieves every item at or above its threshold. Retrieved
pairs are verified: enough of the 3-word shingles of the question (the item without its last
sentence) and of the answer (the last sentence) must occur in the passage. Items without a second
sentence are all question.

Document frequencies, the number of items and their mean length are those of the whole benchmark,
counted by Spark. The indexes are broadcast in shards of at most ``SHARD_WORDS`` words of items, one pass
over the texts for each, so their size is bounded however many items there are, and scores are the same
however they are dealt out.

Defined results: null or empty texts and items match nothing. Equal items all match. A text that
holds an item several times gives one row, with its best passage (the earliest of equals). A null
doc_id is matched like any other in ``leaks``; ``keep`` decides by row and keeps rows with null
texts. Extra columns are kept by ``keep``. Empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, utf8

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; shares of shingles that verify it.
RETRIEVE, QUESTION, ANSWER = 0.6, 0.6, 0.6
#: Items in a block; more where there would be over MOST_BLOCKS.
BLOCK, MOST_BLOCKS = 4, 64
SHARD_WORDS = 2_000_000
#: Bytes of texts that are searched at once, and rows of block maxima that are summed at once.
BATCH, ROWS = 1 << 20, 1 << 16


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + (_MARKS := b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_MARKS))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words; ASCII marks separate words as white space does."""
    text = text or b""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_FOLD).split()


def parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the last sentence is the answer if something stands before it."""
    body = text.strip()
    cut = [m.end() for m in re.finditer(rb"[.?!:]\s+|\n", body)]
    return (words_of(body[: cut[-1]]), words_of(body[cut[-1] :])) if cut else (words_of(body), [])


def _shingles(words: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Statistics:
    """Of all items: their number, the mean of their lengths, and in how many of them each word stands."""

    def __init__(self, n: int, mean: float, df: dict[bytes, int]):
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, texts: list[bytes]) -> Statistics:
        """Those of items in hand."""
        own = [words_of(t) for t in texts if t and t.split()]
        return cls(len(own), sum(map(len, own)) / max(1, len(own)), dict(Counter(w for x in own for w in set(x))))

    def weight(self, word: bytes) -> float:
        return math.log(1 + (self.n - self.df[word] + 0.5) / (self.df[word] + 0.5))


class Index:
    """Postings in item order, cut into blocks that know their greatest impact."""

    def __init__(self, items: list[tuple[object, bytes]], stats: Statistics | None = None):
        stats = stats or Statistics.of([t for _, t in items])
        kept = [(i, words_of(t), *parts(t)) for i, t in items if t and t.split()]
        self.ids = [x[0] for x in kept]
        self.question = [_shingles(x[2]) for x in kept]
        self.answer = [_shingles(x[3]) for x in kept]
        self.longest = max((len(x[1]) for x in kept), default=0)
        counts = [Counter(x[1]) for x in kept]
        self.terms = {w: i for i, w in enumerate(sorted({w for c in counts for w in c}))}
        posts: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for n, c in enumerate(counts):
            size = sum(c.values())
            impact = {w: stats.weight(w) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / stats.mean)) for w, f in c.items()}
            least = RETRIEVE * sum(impact.values())
            for w, x in impact.items():
                posts[self.terms[w]].append((n, x / least))
        self.docs = [[n for n, _ in p] for p in posts]
        self.impacts = [[x for _, x in p] for p in posts]
        self.block = max(BLOCK, -(-len(kept) // MOST_BLOCKS))
        self.block_max = np.zeros((len(posts), -(-len(kept) // self.block)), np.float32)
        for t, p in enumerate(posts):
            for n, x in p:
                self.block_max[t, n // self.block] = max(self.block_max[t, n // self.block], x)

    def wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Every item of the block whose impacts over these distinct terms sum to 1 or more."""
        low, high, slack = block * self.block, (block + 1) * self.block, 1.0 - 1e-9
        bound = {t: float(self.block_max[t, block]) for t in terms}
        at = {t: bisect_left(self.docs[t], low) for t in terms if bound[t]}
        out = []
        while True:
            live = sorted((self.docs[t][p], t) for t, p in at.items() if p < len(self.docs[t]) and self.docs[t][p] < high)
            total, pivot = 0.0, -1
            for k, (_, t) in enumerate(live):
                total += bound[t]
                if total >= 1.0 - 1e-5:
                    pivot = k
                    break
            if pivot < 0:
                return out
            doc = live[pivot][0]
            if live[0][0] == doc:
                front = [t for d, t in live if d == doc]
                score = sum(self.impacts[t][at[t]] for t in front)
                if score >= slack:
                    out.append((doc, score))
                for t in front:
                    at[t] += 1
            else:
                for _, t in live[:pivot]:
                    at[t] = bisect_left(self.docs[t], doc, at[t])

    def find(self, split: list[list[bytes]]) -> list[list[tuple]]:
        """For each text's words, (item, score, question share, answer share, first word) of each verified item."""
        out: list[list[tuple]] = [[] for _ in split]
        if not self.ids or not self.longest:
            return out
        none, step = len(self.terms), self.longest
        # Stretches of ``step`` words; a window is a stretch and the next one of the same text.
        stretches = [-(-len(w) // step) + 1 for w in split]
        base = np.concatenate([[0], np.cumsum(stretches)])
        keys = []
        for n, words in enumerate(split):
            codes = np.fromiter(map(self.terms.get, words, repeat(none)), np.int64, len(words))
            keys.append(((base[n] + np.arange(len(words)) // step) * none + codes)[codes < none])
        keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        if not len(keys):
            return out
        stretch, term = keys // none, keys % none
        held = np.searchsorted(keys, keys - none)
        new = keys[np.minimum(held, len(keys) - 1)] != keys - none
        sums = np.zeros((2, base[-1] + 1, self.block_max.shape[1]), np.float32)
        for lo in range(0, len(keys), ROWS):  # bounded blocks
            s, m, w = stretch[lo : lo + ROWS], self.block_max[term[lo : lo + ROWS]], new[lo : lo + ROWS]
            first = np.flatnonzero(np.diff(s, prepend=-1))
            sums[0, s[first]] += np.add.reduceat(m, first)
            m[~w] = 0
            sums[1, s[first]] += np.add.reduceat(m, first)
        bounds = sums[0, :-1] + sums[1, 1:]
        starts = np.searchsorted(keys, np.arange(base[-1] + 3) * none)
        best: dict[tuple[int, int], tuple] = {}
        for k, block in zip(*(x.tolist() for x in np.nonzero(bounds >= 1.0 - 1e-4))):
            hits = self.wand(np.unique(term[starts[k] : starts[k + 2]]).tolist(), block)
            if not hits:
                continue
            n = int(np.searchsorted(base, k, "right")) - 1
            at = (k - int(base[n])) * step
            own = split[n][at : at + 2 * step]
            grams = _shingles(own)
            for item, score in hits:
                q, a = _share(self.question[item], grams, own), _share(self.answer[item], grams, own)
                if q >= QUESTION and a >= ANSWER:
                    best[n, item] = max(best.get((n, item), (0.0, 0.0, 0.0, 0)), (score, q, a, -at))
        for (n, item), x in best.items():
            out[n].append((self.ids[item], x[0], x[1], x[2], -x[3]))
        return out


def _share(part: set, grams: set, own: list[bytes]) -> float:
    """The share of a part's shingles that a passage has. A part of under three words is one
    shingle, sought as a run whose outer words may be the ends of longer ones."""
    if not part:
        return 1.0
    short = next(iter(part))
    return float(b" ".join(short) in b" ".join(own)) if len(short) < 3 else len(part & grams) / len(part)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item, and its length beside the first of them."""
    for batch in small_batches(batches):
        for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist()):
            own = words_of(text)
            if own:
                some = sorted(set(own))
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(some), pa.int64()), pa.array(some, pa.binary()), pa.array([len(own)] + [0] * (len(some) - 1), pa.int64())], ["at", "word", "length"])


def shards(items: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[list[Index]]:
    """Indexes of at most ``shard_words`` words of items (or one item), a list a shard, made of items read one partition
    at a time. Each item comes with the frequencies of its words in the whole benchmark."""
    with Scratch(items.sparkSession) as tmp:
        own = tmp.stored(items.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null").withColumn("at", F.monotonically_increasing_id()), "items")
        words = tmp.stored(own.select("at", "text").mapInArrow(_words, "at long, word binary, length long"), "words")
        n, total = words.agg(F.count_distinct("at"), F.sum("length")).first()
        df = tmp.stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "frequencies")
        terms = words.join(df, "word").groupBy("at").agg(F.collect_list(F.struct("word", "df")).alias("terms"))  # of one item
        stats, kinds, size = Statistics(n, (total or 0) / max(1, n), {}), {}, 0
        for row in own.join(terms, "at").select("item_id", "text", "terms").toLocalIterator():
            text = bytes(row["text"])
            long = len(words_of(text))
            if kinds and size + long > shard_words:
                yield [Index(x, stats) for x in kinds.values()]
                stats, kinds, size = Statistics(stats.n, stats.mean, {}), {}, 0
            stats.df.update((bytes(t["word"]), t["df"]) for t in row["terms"])
            kinds.setdefault(max(0, (long - 1).bit_length() - 3) // 2, []).append((row["item_id"], text))
            size += long
        yield [Index(x, stats) for x in kinds.values()]


def _find(indexes: list[Index], texts: list[bytes | None]) -> list[list[tuple]]:
    """What all indexes of a shard find in each text."""
    split = [words_of(t) for t in texts]
    each = [ix.find(split) for ix in indexes]
    return [[hit for own in each for hit in own[i]] for i in range(len(texts))]


def _leaks(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    names = ["item_id", "score", "question_share", "answer_share", "first_word"]
    for batch in small_batches(batches, BATCH):
        rows, out = [], []
        for i, hits in enumerate(_find(index.value, utf8(batch.column("text")))):
            rows += [i] * len(hits)
            out += hits
        kinds = [None, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        cols = list(zip(*out)) or [()] * 5
        kinds[0] = pa.int64() if not out or isinstance(out[0][0], int) else pa.string()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])


def leaks(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, score (1 is the threshold), question_share, answer_share, first_word."""
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"], *(T.StructField(c, T.DoubleType()) for c in ("score", "question_share", "answer_share")), T.StructField("first_word", T.LongType())])
    out = None
    for own in shards(items, shard_words):
        one = docs.select("doc_id", "text").mapInArrow(partial(_leaks, index=docs.sparkSession.sparkContext.broadcast(own)), schema)
        out = one if out is None else out.union(one)
    return out


def _clean(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, BATCH):
        yield batch.filter(pa.array([not hits for hits in _find(index.value, utf8(batch.column("text")))], pa.bool_()))


def keep(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents that hold no item, with all their columns. No shuffle."""
    for own in shards(items, shard_words):
        docs = docs.mapInArrow(partial(_clean, index=docs.sparkSession.sparkContext.broadcast(own)), docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
