"""Operator 8, token counts: rollups maintained by deltas.

Totals by source, language and tokenizer version are a base and the deltas committed since. An insert
adds a document and its tokens, a delete takes them away, and a revised count does both: it takes away
the old count under the old version and adds the new one. A batch is aggregated before it is written,
so a commit is as small as its groups, and a hot source meets partial sums only. A batch is written
aside and moved to its name, which takes effect whole or not at all; a batch that has been committed
changes nothing when it is committed again. ``compact`` rolls all deltas up into a new base, which
remembers the names of the batches in it, so that totals read a row a group and few deltas however many
batches there have been. A compaction that dies leaves the old base or the new one.

The versions of the query are patterns, so that SQL can count them too; ``tokenized`` counts by tokenizer
files, and ``commit`` takes either.

Defined results: null sources and languages are groups of their own; a null text has 0 tokens;
repeated events count as often as they come; groups whose documents and tokens are both 0 are not
listed. Extra columns of events are ignored. No batches: no rows. In the query, of rows with equal texts
all but those with the least doc_id are taken out; null texts have no copies.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, scratch, small_batches, stored, utf8

KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Tokenizer versions, as patterns; ``_count`` counts their matches.
MARK = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
VERSIONS = {"words-1": WORD, "marks-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|" + MARK, "marks-2": r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+|[0-9]|" + MARK}


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, prefix: str) -> list[str]:
        top = self._at("")
        found = self._fs.listStatus(top) if self._fs.exists(top) else []
        return sorted(n[len(prefix) :] for x in found if (n := x.getPath().getName()).startswith(prefix))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base, and the batches in it."""
        bases = self._names("base=")
        if not bases:
            return None, set()
        name = f"base={max(bases, key=int)}"
        return name, {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{name}/batches").collect()}

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._at(f"batch={batch}")) or batch in self._base()[1]

    def compact(self) -> None:
        """Rolls the base and the deltas up into a new base, and drops what it replaces. One writer at a time."""
        old, known = self._base()
        new = set(self._names("batch=")) - known
        if new:
            aside = f"_aside-{uuid.uuid4().hex}"
            self.totals().write.parquet(f"{self.path}/{aside}/totals")
            self.spark.createDataFrame([(b,) for b in sorted(known | new)], "batch string").coalesce(1).write.parquet(f"{self.path}/{aside}/batches")
            self._fs.rename(self._at(aside), self._at(f"base={int(old[5:]) + 1 if old else 0}"))
        name, known = self._base()
        for x in [f"batch={b}" for b in self._names("batch=") if b in known] + [f"base={b}" for b in self._names("base=") if f"base={b}" != name]:
            self._fs.delete(self._at(x), True)

    def commit(self, batch: str, events: DataFrame) -> bool:
        """events: op (insert, delete, revise), source, lang, tokenizer_version, n_tokens and, for
        revise, old_version, old_tokens. False if the batch had been committed."""
        name = f"batch={batch}"
        if self.committed(batch):
            return False
        sign = F.when(F.col("op") == "delete", -1).otherwise(1)
        row = lambda version, tokens, by: F.struct(F.col(version).alias("tokenizer_version"), by.cast("long").alias("n_docs"), (by * F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("n_tokens"))
        signed = F.array(row("tokenizer_version", "n_tokens", sign), F.when(F.col("op") == "revise", row("old_version", "old_tokens", F.lit(-1))))
        deltas = events.select("source", "lang", F.explode(F.array_compact(signed)).alias("x")).select("source", "lang", "x.*").groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        aside = f"_aside-{uuid.uuid4().hex}"
        deltas.write.parquet(f"{self.path}/{aside}")
        if self.committed(batch) or not self._fs.rename(self._at(aside), self._at(name)):
            self._fs.delete(self._at(aside), True)
            return False
        # Two writers may have passed the tests together. The later one's folder lands in the earlier one's, where its
        # name hides it from readers.
        if self._fs.exists(self._at(f"{name}/{aside}")):
            self._fs.delete(self._at(f"{name}/{aside}"), True)
            return False
        return True

    def totals(self) -> DataFrame:
        base, known = self._base()
        parts = [f"{self.path}/batch={b}" for b in self._names("batch=") if b not in known] + ([f"{self.path}/{base}/totals"] if base else [])
        deltas = self.spark.read.schema(TOTALS).parquet(*parts) if parts else self.spark.createDataFrame([], TOTALS)
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")


#: Per byte: may it stand in a run of words-1, marks-1 or marks-2 (bits 0 to 2), is it a mark, a digit (bits 3, 4).
#: Bytes of characters beyond ASCII belong to all runs, as the characters do.
_CLASS = np.zeros(256, np.uint8)
for _i in range(256):
    _mark = bool(re.fullmatch(MARK, chr(_i)))
    _digit, _letter = chr(_i) in "0123456789", _i >= 0x80 or chr(_i).isalpha()
    _CLASS[_i] = (_i not in (0x20, *range(0x09, 0x0E))) | (_letter or _digit) << 1 | _letter << 2 | _mark << 3 | _digit << 4


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the texts by their counts; whole batches are counted as one array of bytes."""
    for batch in small_batches(batches):
        texts = [t or b"" for t in utf8(batch.column("text"))]
        own = _CLASS[np.frombuffer(b"\n" + b"\n".join(texts), np.uint8)]  # a line end stands in no run
        begins = own.copy()
        begins[1:] &= ~own[:-1]  # what begins a run
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        total = lambda bits: np.add.reduceat(bits, first, dtype=np.int64)
        marks, digits = total(own >> 3 & 1), total(own >> 4 & 1)
        counts = {"words-1": total(begins & 1), "marks-1": total(begins >> 1 & 1) + marks, "marks-2": total(begins >> 2 & 1) + marks + digits}
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(counts[v]) for v in VERSIONS)], [*keep, *VERSIONS])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, a digest of the text and a count for each version, in one pass."""
    own = docs.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    schema = T.StructType([*own.drop("text").schema, *(T.StructField(v, T.LongType()) for v in VERSIONS)])
    return own.mapInArrow(_count, schema)


def _tokens(batches: Iterator[pa.RecordBatch], files: dict[str, str]) -> Iterator[pa.RecordBatch]:
    from tokenizers import Tokenizer

    own = {name: Tokenizer.from_file(path) for name, path in files.items()}
    for t in own.values():
        t.encode_special_tokens = True  # their strings are ordinary text here
    for batch in small_batches(batches, 2 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        keep = [c for c in batch.schema.names if c != "text"]
        counts = [pa.array([len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)], pa.int64()) for t in own.values()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *counts], [*keep, *own])


def tokenized(docs: DataFrame, files: dict[str, str]) -> DataFrame:
    """doc_id, source, lang and the number of tokens of each version: ``files`` names the tokenizer file of each, which
    every executor must have."""
    own = docs.select("doc_id", "source", "lang", "text")
    schema = T.StructType([*own.drop("text").schema, *(T.StructField(v, T.LongType()) for v in files)])
    return own.mapInArrow(partial(_tokens, files=files), schema)


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go in under two tokenizers; a batch comes twice, once after a compaction; all counts
    of one tokenizer are revised to its next version; copies of a text with a smaller doc_id are taken out.

    The first of each group of copies is a stored table, so that the join with all rows can be split where a
    group is hot.
    """
    each = stored(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "counted")
    rollup = Rollup(spark, scratch(spark, "rollup"))

    def events(op: str, version: str, rows: DataFrame = each, **old) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), F.col(f"`{version}`").alias("n_tokens"), F.lit(old.get("was")).cast("string").alias("old_version"), (F.col(f"`{old['was']}`") if old else F.lit(None).cast("long")).alias("old_tokens"))

    first = each.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = stored(first, "firsts")
    copies = each.join(first, "digest").where("doc_id != first")
    rollup.commit("1-words", events("insert", "words-1"))
    rollup.commit("2-marks", events("insert", "marks-1"))
    rollup.compact()
    rollup.commit("1-words", events("insert", "words-1"))
    rollup.commit("3-revision", events("revise", "marks-2", was="marks-1"))
    rollup.commit("4-copies", events("delete", "words-1", copies).union(events("delete", "marks-2", copies)))
    return rollup.totals()


OP8_SQL = r"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY text, CASE WHEN text IS NULL THEN doc_id END ORDER BY doc_id) AS k FROM documents),
c AS (SELECT source, lang, v AS tokenizer_version, len(regexp_extract_all(coalesce(text, ''), p)) AS n FROM t, (VALUES ('words-1', '[^\x20\x09-\x0D]+'), ('marks-2', '[^\x00-\x40\x5B-\x60\x7B-\x7F]+|[0-9]|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) AS x(v, p) WHERE k = 1)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL
"""
