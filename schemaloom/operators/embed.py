"""Attribute embeddings from the graph and the rule features, in rounds over the features' columns.

The nodes of the graph are the attributes of a schema, so matrices of nodes by nodes and of nodes by dimensions
are driver arrays, and tasks get them with their code. What grows with the data are the columns of the feature
matrix: a row that matches the same rules as others is one column with a multiplicity, and columns stay
rows of stored tables. Each pass reads them where they lie and gives out sums of the size of the node side.

columns: attrs, weights (of the attributes that the column has) and mult.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored
from .graph import signatures

#: Nodes whose square the driver and each task hold.
MOST_NODES = 5_000
#: Cells of a batch's dense block in a task.
BLOCK = 1 << 20


def walks(p: np.ndarray, hops: int, alpha: float) -> np.ndarray:
    out, power = np.zeros_like(p), np.eye(len(p))
    for step in range(hops + 1):
        out += alpha * (1 - alpha) ** step * power
        power = power @ p
    return out


def _sweep(x: np.ndarray, gram: np.ndarray, cross: np.ndarray, nonneg: bool = False) -> np.ndarray:
    """One Gauss-Seidel pass over the columns of x, in place; how far each row has moved."""
    moved = np.zeros(len(x))
    for k in range(x.shape[1]):
        if gram[k, k] > 1e-12:
            new = x[:, k] - (x @ gram[:, k] - cross[:, k]) / gram[k, k]
            if nonneg:
                new = np.maximum(new, 0)
            moved += np.abs(new - x[:, k])
            x[:, k] = new
    return moved


# --- passes over columns --------------------------------------------------------------------------


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.array(flat, float).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, float).ravel()))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    most = max(1, BLOCK // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _sums(df: DataFrame, width: int, make: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all blocks of the matrix that ``make`` gives for one. Tasks add up their own, and partial sums
    meet a cell at a time; the driver receives the matrix."""

    def run(batches):
        total = np.zeros(shape)
        for block in _blocks(batches, width):
            total += make(block)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], ["at", "v"])

    out = np.zeros(shape)
    for r in df.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # of the size of ``shape``
        out.ravel()[r["at"]] = r["v"]
    return out


def _mapped(df: DataFrame, width: int, names: list[str], make: Callable[[pa.RecordBatch], list[np.ndarray]]) -> DataFrame:
    """mult and the vectors that ``make`` gives, by these names."""

    def run(batches):
        for block in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([block.column("mult"), *map(_lists, make(block))], ["mult", *names])

    return df.mapInArrow(run, T.StructType([T.StructField("mult", T.LongType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)]))


def _mult(block: pa.RecordBatch) -> np.ndarray:
    return np.array(block.column("mult").to_numpy(zero_copy_only=False), float)[:, None]


def _dense(block: pa.RecordBatch, n: int, scale: np.ndarray) -> np.ndarray:
    """A row a column of the features: its weights over the sums of its attributes' rows."""
    attrs, out = block.column("attrs"), np.zeros((block.num_rows, n))
    lengths = np.array([len(a) for a in attrs], np.int64)
    at = np.array(attrs.flatten().to_numpy(zero_copy_only=False), np.int64)
    np.add.at(out, (np.repeat(np.arange(len(lengths)), lengths), at), np.array(block.column("weights").flatten().to_numpy(zero_copy_only=False), float))
    return out * scale


# --- the embedding --------------------------------------------------------------------------------


def columns_of(feature: DataFrame) -> DataFrame:
    """The columns of a feature table (attr_id, row_gid): a signature each."""
    return signatures(feature).select(F.col("sig").alias("attrs"), F.transform("sig", lambda _: F.lit(1.0)).alias("weights"), "mult")


def _row_scale(columns: DataFrame, n: int) -> np.ndarray:
    """One over the sum of each attribute's row."""
    total = np.zeros(n)
    for r in columns.select("mult", F.inline(F.arrays_zip("attrs", "weights"))).groupBy("attrs").agg(F.sum(F.col("mult") * F.col("weights")).alias("w")).collect():  # a row a node
        total[r["attrs"]] = r["w"]
    return np.divide(1.0, total, out=np.zeros(n), where=total > 0)


def affinities(p: np.ndarray, columns: DataFrame, hops: int = 5, alpha: float = 0.5, rows: int | None = None) -> DataFrame:
    """mult, z, y: the forward and backward log affinities of each column with all nodes.

    Forward: walks from the nodes to the row-normalised features, normalised by column. Backward: walks along
    reversed edges to the features normalised by row and then by column, normalised by node over all columns.
    """
    n = len(p)
    scale, forth, back = _row_scale(columns, n), walks(p, hops, alpha), walks(p.T, hops, alpha)

    def raw(block):
        f = _dense(block, n, scale)
        whole = f.sum(axis=1, keepdims=True)
        z, y = f @ forth.T, np.divide(f, whole, out=np.zeros_like(f), where=whole > 0) @ back.T
        whole = z.sum(axis=1, keepdims=True)
        return [np.log2(n * np.divide(z, whole, out=np.zeros_like(z), where=whole > 0) + 1), y]

    both = stored(_mapped(columns, n, ["z", "y"], raw), "affinities")
    share = _sums(both.select("mult", "y"), n, lambda b: (np.abs(_vectors(b.column("y"))) * _mult(b)).sum(axis=0, keepdims=True), (1, n))
    d = rows or both.agg(F.sum("mult")).first()[0] or 0
    over = np.divide(d, share, out=np.zeros_like(share), where=share > 0)
    return _mapped(both, n, ["z", "y"], lambda b: [_vectors(b.column("z")), np.log2(_vectors(b.column("y")) * over + 1)])


def centred_gram(affinity: DataFrame, n: int) -> np.ndarray:
    """Nodes by nodes: the sums over columns of mult * z z', z less its mean over the nodes."""

    def make(block):
        z = _vectors(block.column("z"))
        z = z - z.mean(axis=1, keepdims=True)
        return (z * _mult(block)).T @ z

    return _sums(affinity.select("mult", "z"), n, make, (n, n))


def leading(gram: np.ndarray, dims: int, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Left vectors and singular values of the matrix with this Gram matrix, largest first; the largest component of a vector is positive."""
    values, vectors = np.linalg.eigh(gram)
    keep = [i for i in np.argsort(-values) if values[i] > tol][:dims]
    u = vectors[:, keep]
    return u * np.sign(u[np.abs(u).argmax(axis=0), range(len(keep))]), np.sqrt(values[keep])


def descend(y: DataFrame, w: np.ndarray, rounds: int = 5, tol: float = 1e-4, nonneg: bool = False) -> tuple[np.ndarray, DataFrame, bool]:
    """Alternating sweeps on w (nodes by dimensions, on the driver) and h (a vector a column) for y ~ w h', columns
    weighted by mult: w, the columns with their h, and whether it converged.

    ``y``: mult, y, h. A round sums h h' and y h' over the columns, moves w, and moves the h of each column
    where it lies, by w w' and the column's own y. Columns are stored once a round.
    """
    n, k = w.shape
    w, first, now = w.copy(), None, y
    for _ in range(rounds):
        both = _sums(now, n + k, lambda b: np.vstack([_vectors(b.column("h")).T @ (_vectors(b.column("h")) * _mult(b)), (_vectors(b.column("y")) * _mult(b)).T @ _vectors(b.column("h"))]), (k + n, k))
        moved = _sweep(w, both[:k], both[k:], nonneg).sum()
        gram, side = w.T @ w, w

        def step(block, gram=gram, side=side):
            h, own = _vectors(block.column("h")), _vectors(block.column("y"))
            far = _sweep(h, gram, own @ side, nonneg)
            return [own, h, far[:, None]]

        now = stored(_mapped(now, n + k, ["y", "h", "far"], step), "descent")
        moved += now.agg(F.sum(F.col("far")[0] * F.col("mult"))).first()[0] or 0.0
        now = now.drop("far")
        first = moved if first is None else first
        if first == 0 or moved / first <= tol:
            return w, now, True
    return w, now, False


def embed(p: np.ndarray, columns: DataFrame, hops: int = 5, alpha: float = 0.5, dims: int | None = None, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors of each node, nodes by dimensions."""
    n = len(p)
    if n > MOST_NODES:
        raise ValueError(f"{n} nodes are more than {MOST_NODES}: their square is held by every task")
    both = stored(affinities(p, stored(columns, "columns"), hops, alpha, rows), "affinity")
    u, s = leading(centred_gram(both, n), dims or max(1, n - 1))

    def begin(block):
        z = _vectors(block.column("z"))
        return [_vectors(block.column("y")), (z - z.mean(axis=1, keepdims=True)) @ u / s]

    start = stored(_mapped(both, n, ["y", "h"], begin), "start")
    w = _sums(start, n + len(s), lambda b: (_vectors(b.column("y")) * _mult(b)).T @ _vectors(b.column("h")), (n, len(s)))
    w, _, _ = descend(start, w, hops)
    return u * s, w


def transition_matrix(p: DataFrame, n: int) -> np.ndarray:
    """The edges (src, dst, p) of n nodes, at most n * n, as an array."""
    m = np.zeros((n, n))
    for r in p.collect():
        m[r["src"], r["dst"]] = r["p"]
    return m


def embed_graph(p: DataFrame, feature: DataFrame, n: int, clusters: int | None = None, **options) -> tuple[np.ndarray, np.ndarray]:
    """From transition (src, dst, p) and feature (attr_id, row_gid); with ``clusters``, columns are compressed first."""
    columns = columns_of(feature)
    return embed(transition_matrix(p, n), compress(columns, n, clusters) if clusters else columns, **options)


# --- compression ----------------------------------------------------------------------------------


def clustered(columns: DataFrame, n: int, clusters: int) -> DataFrame:
    """attrs, weights, mult, cluster: the columns, each in the cluster of its largest left singular component.

    Columns are scaled to length one. Their right singular vectors are those of the Gram matrix of the
    nodes, exact since a schema has few nodes; left components follow column by column. A vector's sign makes its
    largest component positive. Fewer clusters come out than asked for if the columns' rank is lower.
    """
    columns = stored(columns, "columns")
    one = np.ones(n)

    def unit(block):
        f = _dense(block, n, one)
        return f / np.maximum(np.sqrt((f * f).sum(axis=1, keepdims=True)), 1e-300)

    gram = _sums(columns, n, lambda b: (unit(b) * _mult(b)).T @ unit(b), (n, n))
    v, s = leading(gram, clusters)
    basis = v / s

    def reach(batches):
        low, high = np.full(len(s), np.inf), np.full(len(s), -np.inf)
        for block in _blocks(batches, n):
            left = unit(block) @ basis
            low, high = np.minimum(low, left.min(axis=0)), np.maximum(high, left.max(axis=0))
        if np.isfinite(low).all():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array(low), pa.array(high)], ["k", "lo", "hi"])

    for r in columns.mapInArrow(reach, "k int, lo double, hi double").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        # Nearly equal ends count as equal, so that the order of sums doesn't turn a vector.
        if -r["lo"] > r["hi"] * (1 + 1e-9):
            basis[:, r["k"]] *= -1

    def assign(batches):
        for block in _blocks(batches, n):
            left = np.round(unit(block) @ basis, 12)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(left.argmax(axis=1), pa.int32())], [*block.schema.names, "cluster"])

    return columns.mapInArrow(assign, T.StructType([*columns.schema, T.StructField("cluster", T.IntegerType())]))


def compress(columns: DataFrame, n: int, clusters: int) -> DataFrame:
    """A column a cluster, the sum of its columns with their multiplicities."""
    cells = clustered(columns, n, clusters).select("cluster", "mult", F.inline(F.arrays_zip("attrs", "weights")))
    each = cells.groupBy("cluster", "attrs").agg(F.sum(F.col("mult") * F.col("weights")).alias("w"))
    listed = F.sort_array(F.collect_list(F.struct("attrs", "w")))  # of one cluster: an entry a node
    return each.groupBy("cluster").agg(listed.alias("x")).select(F.transform("x", lambda e: e["attrs"]).alias("attrs"), F.transform("x", lambda e: e["w"]).alias("weights"), F.lit(1).cast("long").alias("mult"))


# --- results --------------------------------------------------------------------------------------


def vectors(spark, forward: np.ndarray, backward: np.ndarray) -> DataFrame:
    """attr_id, fwd, bwd: a row a node."""
    rows = [(i, f, b) for i, (f, b) in enumerate(zip(forward.tolist(), backward.tolist()))]
    return spark.createDataFrame(rows, "attr_id int, fwd array<double>, bwd array<double>")


def similarity(forward: np.ndarray, backward: np.ndarray, n_source: int) -> np.ndarray:
    """Target by source cosines of both vectors together."""
    x = np.hstack([forward, backward])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return x[n_source:] @ x[:n_source].T


def divergence(x: DataFrame, w: DataFrame, h: DataFrame, beta: float) -> DataFrame:
    """value: the beta divergence of the stored cells x (attr_id, col, value; all others are zero) from w h'.

    w: attr_id, v (array). h: col, v, mult. 2 is half the squared Frobenius norm, 1 the generalised Kullback-Leibler
    divergence, 0 that of Itakura and Saito. Only stored cells above zero meet their factors. What the zeros
    add is in closed form: sums of factors for 1, Gram matrices for 2; for 0 they add nothing but their number.
    """
    if beta not in (0, 1, 2):
        raise ValueError("beta is 0, 1 or 2: for others the zeros have no closed form")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    tiny = float(np.finfo(np.float32).eps)
    met = x.where(F.col("value") > tiny).join(w.select("attr_id", F.col("v").alias("wv")), "attr_id").join(h.select("col", "mult", F.col("v").alias("hv")), "col")
    met = met.withColumn("raw", dot("wv", "hv")).withColumn("fit", F.when(F.col("raw") == 0, tiny).otherwise(F.col("raw")))
    total = lambda c: F.coalesce(F.sum(F.col("mult") * c), F.lit(0.0))
    value, fit = F.col("value"), F.col("fit")
    part = met.agg(total(value * F.log(value / fit)).alias("gain"), total(value).alias("mass"), total(value / fit).alias("ratio"), total(F.log(value / fit)).alias("logs"), total(value * value).alias("square"), total(value * F.col("raw")).alias("cross"))

    def factor(df: DataFrame, mult, prefix: str) -> DataFrame:
        """Sums of a side, a row a dimension, and products, a row a pair of dimensions."""
        each = df.select(F.posexplode("v").alias("i", "a"), mult.alias("m"), "v").select("i", "a", "m", F.posexplode("v").alias("j", "b"))
        return each.groupBy("i", "j").agg(F.sum(F.col("m") * F.col("a") * F.col("b")).alias(f"{prefix}g"), F.sum(F.when(F.col("i") == F.col("j"), F.col("m") * F.col("a"))).alias(f"{prefix}s"))

    sides = factor(w, F.lit(1), "w").join(factor(h, F.col("mult"), "h"), ["i", "j"]).agg(F.sum(F.col("ws") * F.col("hs")).alias("all"), F.sum(F.col("wg") * F.col("hg")).alias("fits"))
    cells = w.agg(F.count(F.lit(1)).alias("rows")).crossJoin(h.agg(F.sum("mult").alias("cols")))
    each = part.crossJoin(sides).crossJoin(cells)  # one row each
    what = {2: (F.col("square") + F.col("fits") - 2 * F.col("cross")) / 2, 1: F.col("gain") + F.col("all") - F.col("mass"), 0: F.col("ratio") - F.col("rows") * F.col("cols") - F.col("logs")}[beta]
    return each.select(what.alias("value"))
