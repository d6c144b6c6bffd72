"""Operator 12, vector code compression: product codes from Lloyd rounds with Elkan's bounds, in integers.

A component x becomes floor(256 * x), and a vector is cut into ``parts`` equal consecutive parts with a
codebook each. The first codebooks are the parts of the ``entries`` smallest vec_ids. Each round assigns all
parts to their nearest entries and moves the entries to the floored means; a last assignment gives the codes.

Bounds are kept from round to round as columns of a stored table: of each part an upper bound of the
distance to its entry, and a lower bound for every entry, both in whole steps of the part's scale and rounded
outwards, so a lower bound is a byte. After the entries have moved, bounds are shifted by how far. An entry is
passed over only if a strict triangle inequality says that it is farther than the part's own entry: the
upper bound is less than the entry's lower bound, or less than half the distance of the two entries. All
others are measured in exact integers and ties go to the lower index, so the result is that of comparing
with every entry.

Tasks read their vectors in batches and hold one batch's bounds. Sums and counts of entries combine in the
tasks; the driver receives parts * entries rows a round, whatever the input.

Defined results: a vector that is null, or holds a null or a component that isn't finite, is dropped, and so is
one whose length isn't that of the smallest vec_id's vector. Where the parts don't divide the length,
vectors are padded by zeros. Null vec_ids come last; of equal vec_ids the lower vector comes first, and all rows stay.
Fewer vectors than entries give as many entries. Null labels are one group. An empty table gives no rows.
A component of 2^20 or more in size is
an error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: The largest lower bound of a byte, in steps.
TOP = 255
#: Components from here on would make squares that don't fit into 64 bits; they are an error.
LIMIT = 1 << 20


def _root_down(squares: np.ndarray) -> np.ndarray:
    r = np.floor(np.sqrt(squares)).astype(np.int64)
    return r - (r * r > squares)


def _root_up(squares: np.ndarray) -> np.ndarray:
    r = _root_down(squares)
    return r + (r * r < squares)


def _up(x: np.ndarray, step: int) -> np.ndarray:
    return -(-x // step)


class Part:
    """One part's codebook, with what the bounds need: distances of entries, and how far they have moved."""

    def __init__(self, book: np.ndarray, step: int, before: np.ndarray | None = None):
        self.book, self.step = book, step
        between = ((book[:, None] - book[None]) ** 2).sum(2)
        #: Half the distance of two entries, rounded down, in steps.
        self.half = _root_down(between) // (2 * step)
        apart = self.half.copy()
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.nearest = apart.min(1)
        self.moved = np.zeros(len(book), np.int64) if before is None else _up(_root_up(((book - before) ** 2).sum(1)), step)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, upper bound and lower bounds of each row, by comparing with all entries."""
        squares = ((x[:, None] - self.book[None]) ** 2).sum(2)
        own = squares.argmin(1)
        lower = np.minimum(_root_down(squares) // self.step, TOP).astype(np.uint8)
        return own, _up(_root_up(squares[np.arange(len(x)), own]), self.step), lower

    def next(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the entries have moved, and the number of distances that were measured."""
        own, upper = own.copy(), upper + self.moved[own]
        lower = np.maximum(lower.astype(np.int64) - self.moved, 0)
        open_ = np.flatnonzero(~(upper < self.nearest[own]))
        measured = len(open_)
        if measured:
            mine, rows = own[open_], x[open_]
            exact = ((rows - self.book[mine]) ** 2).sum(1)
            upper[open_] = _up(_root_up(exact), self.step)
            # An entry is passed over only where it is strictly farther.
            tight = upper[open_][:, None]
            look = ~(tight < lower[open_]) & ~(tight < self.half[mine])
            look[np.arange(len(mine)), mine] = False
            at, entry = np.nonzero(look)
            measured += len(at)
            squares = ((rows[at] - self.book[entry]) ** 2).sum(1)
            lower[open_[at], entry] = _root_down(squares) // self.step
            best = np.full(look.shape, np.iinfo(np.int64).max)
            best[np.arange(len(mine)), mine] = exact
            best[at, entry] = squares
            lower[open_, mine] = np.minimum(lower[open_, mine], _root_down(exact) // self.step)
            own[open_] = best.argmin(1)  # the first of equals
            upper[open_] = _up(_root_up(best.min(1)), self.step)
        return own, upper, np.minimum(lower, TOP).astype(np.uint8), measured


STATE = "x array<int>, code binary, upper array<int>, lower binary"


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def _bytes(column: pa.Array, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), *shape)


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x, np.int32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def _assign(batches: Iterator[pa.RecordBatch], books: list[Part], begin: bool) -> Iterator[pa.RecordBatch]:
    width = books[0].book.shape[1]
    entries = len(books[0].book)
    for batch in small_batches(batches, 1 << 20):
        x = _matrix(batch.column("x"))
        code, upper, lower = np.empty((len(x), len(books)), np.int64), np.empty((len(x), len(books)), np.int64), np.empty((len(x), len(books), entries), np.uint8)
        if not begin:
            old = _bytes(batch.column("code"), len(books)), _matrix(batch.column("upper")), _bytes(batch.column("lower"), len(books), entries)
        for p, book in enumerate(books):
            own = x[:, p * width : (p + 1) * width]
            got = book.first(own) if begin else book.next(own, *(o[:, p] for o in (old[0].astype(np.int64), *old[1:])))
            code[:, p], upper[:, p], lower[:, p] = got[:3]
        columns = [batch.column("x"), pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), _lists(upper), pa.array([r.tobytes() for r in lower], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], ["vec_id", "label", "x", "code", "upper", "lower"])


def _sums(batches: Iterator[pa.RecordBatch], parts: int, entries: int) -> Iterator[pa.RecordBatch]:
    """part, entry, n, s: a task's sums of each entry's parts."""
    n, s = np.zeros(parts * entries, np.int64), None
    for batch in small_batches(batches):
        x, code = _matrix(batch.column("x")), _bytes(batch.column("code"), parts).astype(np.int64)
        s = np.zeros((parts * entries, x.shape[1] // parts), np.int64) if s is None else s
        at = (code + np.arange(parts) * entries).ravel()
        n += np.bincount(at, minlength=parts * entries)
        np.add.at(s, at, x.reshape(len(at), -1))
    if s is not None:
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k // entries, pa.int32()), pa.array(k % entries, pa.int32()), pa.array(n[k]), pa.array(s[k].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])


def _finish(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, code in hex digits, error."""
    for batch in small_batches(batches):
        x, code = _matrix(batch.column("x")), _bytes(batch.column("code"), len(books))
        near = np.stack([b[code[:, p]] for p, b in enumerate(books)], 1).reshape(len(x), -1)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(((x - near) ** 2).sum(1), pa.int64())], ["vec_id", "label", "code", "error"])


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: the kept vectors as integers."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    large = F.raise_error(F.lit(f"a component of {LIMIT} or more in size")).cast("int")
    return kept.select("vec_id", "label", F.transform(v, lambda c: F.when(F.abs(c) >= LIMIT, large).otherwise(F.floor(c * 256).cast("int"))).alias("x"))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of each kept vector, and the final codebooks, an array of entries a part."""
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError(f"an entry's index is a byte, so {entries} entries won't do")
    x, by_id = whole_numbers(vectors), (F.col("vec_id").asc_nulls_last(), "x")
    size = len((x.orderBy(*by_id).first() or {"x": []})["x"])
    padded = max(1, -(-size // parts)) * parts
    x = x.where(F.size("x") == size).withColumn("x", F.concat("x", F.array_repeat(F.lit(0), padded - size)))
    heads = x.orderBy(*by_id).limit(entries).collect()
    first = np.array([r["x"] for r in heads], np.int64).reshape(-1, parts, padded // parts)
    books = [np.ascontiguousarray(first[:, p]) for p in range(parts)]
    # The step of a part's bounds: the distances of its first entries fit into a byte.
    steps = [max(1, int(-(-_root_up(((b[:, None] - b[None]) ** 2).sum(2)).max(initial=0) // (TOP - 1)))) for b in books]
    shape = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], *(T.StructField(n, k) for n, k in (("x", T.ArrayType(T.IntegerType())), ("code", T.BinaryType()), ("upper", T.ArrayType(T.IntegerType())), ("lower", T.BinaryType())))])
    with Scratch(spark) as tmp:
        state, before = x, [None] * parts
        for i in range(rounds + 1 if heads else 0):
            now = [Part(b, s, old) for b, s, old in zip(books, steps, before)]
            state = tmp.stored(state.mapInArrow(partial(_assign, books=now, begin=not i), shape), f"bounds{i}")
            if i < rounds:
                before, books = books, [b.copy() for b in books]
                sums = state.select("x", "code").mapInArrow(partial(_sums, parts=parts, entries=len(books[0])), "part int, entry int, n long, s array<long>")
                total = F.array(*(F.sum(F.col("s")[j]) for j in range(padded // parts)))
                for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("s")).collect():  # parts * entries rows
                    books[r["part"]][r["entry"]] = np.array(r["s"], np.int64) // r["n"]
        out = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        done = state.select("vec_id", "label", "x", "code").mapInArrow(partial(_finish, books=books), out) if heads else spark.createDataFrame([], out)
        return stored(done, "codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    # A table of its own beside labels that many rows have, so that adaptive execution can split these.
    by_label = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    out = codes.join(by_label, codes["label"].eqNullSafe(by_label["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """Each round compares every part with every entry."""
    sql, c = "", [f"c{i}" for i in range(4)]
    for i in range(ROUNDS + 1):
        gap = " + ".join(f"(x.{k} - b.{k}) * (x.{k} - b.{k})" for k in c)
        sql += f"a{i} AS (SELECT x.id, x.p, {', '.join(f'any_value(x.{k}) AS {k}' for k in c)}, min(({gap}) * 64 + b.e) AS m FROM parts x JOIN b{i} b USING (p) GROUP BY x.id, x.p),\n"
        if i < ROUNDS:
            sql += f"n{i} AS (SELECT p, m % 64 AS e, {', '.join(f'floor(sum({k})::DOUBLE / count(*))::BIGINT AS {k}' for k in c)} FROM a{i} GROUP BY p, m % 64),\n"
            sql += f"b{i + 1} AS (SELECT b.p, b.e, {', '.join(f'coalesce(n.{k}, b.{k}) AS {k}' for k in c)} FROM b{i} b LEFT JOIN n{i} n ON n.p = b.p AND n.e = b.e),\n"
    return sql


#: No bounds, for vectors of 64 components.
OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, [floor(256 * c::DOUBLE)::BIGINT FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
parts AS (SELECT id, p, x[4 * p + 1] AS c0, x[4 * p + 2] AS c1, x[4 * p + 3] AS c2, x[4 * p + 4] AS c3 FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, id - 1 AS e, c0, c1, c2, c3 FROM parts WHERE id <= 64),
{_rounds_sql()}
done AS (SELECT id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a{ROUNDS} GROUP BY id),
book AS (SELECT sha256(string_agg(concat_ws(',', c0, c1, c2, c3), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN done USING (id), book
"""
