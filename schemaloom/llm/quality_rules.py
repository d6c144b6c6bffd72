"""Operator 6, quality rules: a cascade that stops at a document's first failed rule.

Each rule is a predicate on cheap counts of the text. On a sample, the operator measures what
a rule costs and which documents it rejects, then takes as the next rule the one with most rejections per
second among the documents that the rules before it let through. The verdict is a conjunction, so the order changes cost, never the result.

Defined results: a null text has no words and fails the base rule; so does an empty one.
Null or repeated doc_ids don't matter, as every row is judged by itself. An empty table gives
an empty result. Extra columns are ignored by ``measure`` and kept by ``keep``.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, utf8

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents that are expected in the sample on which costs and rejections are measured.
SAMPLE_ROWS = 2000

MEASURES = T.StructType([T.StructField(c, T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False)])


class Doc:
    """A text whose counts are made when a rule first asks for them."""

    def __init__(self, text: bytes | None):
        self.text = text or b""
        self.words = self.text.split()
        self.n_words = len(self.words)
        self._kept: dict[str, object] = {}

    def _once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def word_chars(self) -> int:
        return self._once("word_chars", lambda: len(b"".join(self.words).decode("utf-8", "replace")))

    @property
    def n_symbols(self) -> int:
        return self._once("n_symbols", lambda: sum(self.text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))))

    @property
    def n_upper(self) -> int:
        return self._once("n_upper", lambda: len(self.text) - len(self.text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))

    @property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and how many of them equal an earlier one."""

        def make():
            own = [x for x in self.text.split(b"\n") if x.split(None, 1)]
            return len(own), len(own) - len(set(own))

        return self._once("lines", make)

    @property
    def n_distinct(self) -> int:
        return self._once("n_distinct", lambda: len(set(self.words)))

    @property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that the text has twice or more."""

        def make():
            w = self.words
            windows = list(zip(w, w[1:], w[2:]))
            if len(set(windows)) == len(windows):
                return 0
            often = {x for x, n in Counter(windows).items() if n > 1}
            total, done = 0, 0
            for i, x in enumerate(windows):
                if x in often:
                    total += i + 3 - max(i, done)
                    done = i + 3
            return total

        return self._once("n_repeat_words", make)

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


#: Name and test of a rejection. All are on integers, so that SQL gives the same verdicts.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "upper_case": lambda d: 5 * d.n_upper > d.word_chars,
    "repeated_lines": lambda d: d.lines[1] >= 3 and 10 * d.lines[1] > 3 * d.lines[0],
    "few_distinct_words": lambda d: 20 * d.n_distinct < d.n_words,
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words,
    "base": lambda d: d.base_failed,
}


def _trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seconds of each rule, and how many documents fail which rules together (a bit a rule)."""
    spent, failed = dict.fromkeys(RULES, 0.0), Counter()
    for batch in small_batches(batches):
        for text in utf8(batch.column(0)):
            bits = 0
            for i, (name, rule) in enumerate(RULES.items()):
                doc = Doc(text)
                began = time.perf_counter()
                bits |= rule(doc) << i
                spent[name] += time.perf_counter() - began
            failed[bits] += 1
    none = [None] * len(failed)
    yield pa.RecordBatch.from_arrays([pa.array([*RULES, *none], pa.string()), pa.array([*spent.values(), *none], pa.float64()), pa.array([None] * len(RULES) + list(failed), pa.int32()), pa.array([None] * len(RULES) + list(failed.values()), pa.int64())], ["rule", "s", "bits", "n"])


def ranked(seconds: dict[str, float], failed: dict[int, int]) -> list[str]:
    """Rules by rejections per second, each counted on what the rules before it leave. Ties go by name."""
    names, left, out = list(RULES), dict(failed), []
    while len(out) < len(names):
        rate = lambda x: sum(n for bits, n in left.items() if bits >> names.index(x) & 1) / max(seconds.get(x, 0.0), 1e-9)
        best = min((x for x in names if x not in out), key=lambda x: (-rate(x), x))
        out.append(best)
        left = {bits: n for bits, n in left.items() if not bits >> names.index(best) & 1}
    return out


def plan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names in the order of the cascade, by a sample of about ``sample_rows`` documents.

    The sample takes texts by a hash of their doc_id and text, so that null and repeated doc_ids don't
    enlarge it. What is summed has a row a rule and one for each set of rules that documents fail together.
    """
    rows = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / max(1, rows)) + 1)).select("text")
    seen = part.mapInArrow(_trial, "rule string, s double, bits int, n long").groupBy("rule", "bits").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return ranked({r["rule"]: r["s"] for r in seen if r["rule"]}, {r["bits"]: r["n"] for r in seen if not r["rule"]})


def verdict(doc: Doc, order: list[str]) -> bool:
    return not any(RULES[name](doc) for name in order)


def _measure(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        out = []
        for text in utf8(batch.column("text")):
            d = Doc(text)
            out.append((d.n_words, d.word_chars, d.n_symbols, d.lines[1], d.n_repeat_words, d.base_failed, verdict(d, order)))
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *MEASURES.names])


def measure(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each document. One pass over the texts, no shuffle."""
    schema = T.StructType([docs.schema["doc_id"], *MEASURES])
    return docs.select("doc_id", "text").mapInArrow(partial(_measure, order=plan(docs, sample_rows)), schema)


def _keep(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        yield batch.filter(pa.array([verdict(Doc(t), order) for t in utf8(batch.column("text"))], pa.bool_()))


def keep(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass every rule, with all their columns; here the cascade short-circuits."""
    return docs.mapInArrow(partial(_keep, order=plan(docs, sample_rows)), docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
g AS (SELECT doc_id, t, ws, ls, len(ws) AS n, [ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] FOR i IN range(1, len(ws) - 1)] AS gs FROM w),
pos AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS i FROM g),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM pos) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n_rep FROM often, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
f AS (
  SELECT g.doc_id, n, length(array_to_string(ws, '')) AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS syms,
         len(ls) AS nl, len(ls) - len(list_distinct(ls)) AS dup, coalesce(n_rep, 0) AS rep,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, len(list_distinct(ws)) AS dis
  FROM g LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n < 50 OR 100 * rep > 50 * n AS bad FROM f)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, syms::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, bad AS base_failed,
       NOT bad AND NOT (10 * syms > n) AND NOT (5 * up > chars) AND NOT (dup >= 3 AND 10 * dup > 3 * nl) AND NOT (20 * dis < n) AND 2 * n <= chars AND chars <= 20 * n AS kept
FROM b
"""
