"""Refinement of similarity matrices by rewards for dependencies that hold on the target rows.

The rounds of one run are sequential and bounded by its matrix; runs are independent, so a table of
runs is refined a row at a time. Which remapped dependencies hold depends on the target rows alone: a
relation says so for all runs at once (``validity``), and the rounds only look it up. What a round asks
for follows from the rewards of the rounds before, so the relation grows until no run has anything to ask.

A run is one array, the state of its rounds. What a round needs to know of the last one (how far the
array moved, how many source columns changed their best target, how many mappings held) is measured on
the arrays before and after it.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import validity

KINDS = ("fd", "ind", "cfd")


@dataclass(frozen=True)
class Config:
    max_iter: int = 5
    patience: int = 2
    matrix_eps: float = 1e-4
    k_min: int = 1
    k_max: int = 3
    decay: float = 0.4
    ceiling: float = 1.5
    k_stability: float = 10.0
    k_exploration: float = 3.0
    target_delta: float = 0.015
    reward_min: float = 0.001
    reward_max: float = 0.05
    matrix_scale: float = 0.07
    #: all (FDs and INDs), every (CFDs too), or one of KINDS
    dep_mode: str = "all"
    first_rows: int = 0  # compare only so many rows of a group; 0: all
    min_group_support: int = 1
    #: a fixed reward for each kind turns a run into one round without a ceiling, on the candidates of the raw array
    fixed: dict[str, float] | None = None

    def kinds(self) -> tuple[str, ...]:
        return {"all": KINDS[:2], "every": KINDS}.get(self.dep_mode, (self.dep_mode,))


@dataclass
class Rounds:
    """The array of a run, and what was measured of its rounds."""

    now: np.ndarray
    config: Config
    starts: list[np.ndarray] = field(default_factory=list)
    held: int = 0
    delta: float = 0.0
    share: float = 1.0
    quiet: int = 0

    @staticmethod
    def sharpness(m: np.ndarray) -> float:
        """How far the best cell of a row stands out, on average, from 0 to 1."""
        if m.size == 0 or m.shape[1] < 2:
            return 0.0
        two = np.sort(m, axis=1)[:, -2:]
        return math.tanh(3 * float((two[:, 1] - two[:, 0]).mean()))

    def width(self) -> int:
        """Candidates for each source column: fewer as rounds go by and as the array gets sharper."""
        c = self.config
        used = max((len(self.starts) - 1) / max(c.max_iter, 1), self.sharpness(self.now))
        return max(c.k_min, int(round(c.k_max - used * (c.k_max - c.k_min))))

    def scale(self) -> float:
        c = self.config
        spread = float(self.now.std()) if self.now.size else 0.0
        raw = c.target_delta / self.held if self.held else c.target_delta * c.matrix_scale / (spread or 1.0)
        return float(np.clip(raw, c.reward_min, c.reward_max))

    def reward(self) -> float:
        c = self.config
        if not self.held:
            return self.scale() * c.decay ** (len(self.starts) - 1)
        return self.scale() * math.exp(-c.k_stability * self.delta) * (1 - math.exp(-c.k_exploration * self.share))

    @staticmethod
    def moved(new: np.ndarray, old: np.ndarray) -> tuple[float, int]:
        """The relative Frobenius distance, and the source columns whose best target (the first of equals) is another."""
        return float(np.linalg.norm(new - old) / (np.linalg.norm(old) + 1e-12)), int((new.argmax(axis=0) != old.argmax(axis=0)).sum()) if new.size else 0

    def swings(self) -> bool:
        """Do the last four starts jump between two levels of sharpness?"""
        if len(self.starts) < 4:
            return False
        levels = np.array([self.sharpness(m) for m in self.starts[-4:]]).reshape(2, 2)
        return bool((levels.std(axis=0) < 0.005).all() and abs(np.subtract(*levels.mean(axis=0))) > 0.01)

    def close(self, held: int) -> str:
        """Measures the round; what to do next: go on, stop, or take the mean of the last starts."""
        self.held = held
        self.delta, changes = self.moved(self.now, self.starts[-1])
        self.share = changes / max(self.now.shape[1], 1)
        if self.swings():
            return "mean"
        self.quiet = self.quiet + 1 if self.delta < self.config.matrix_eps and not changes else 0
        return "stop" if self.quiet >= self.config.patience else "go"


class Known:
    """What the relation of ``validity`` says of a run's target; what it doesn't know yet is asked for."""

    def __init__(self, verdicts: dict[tuple, tuple[bool, int | None]], support: int = 1):
        self.verdicts, self.support, self.asks = verdicts, support, set()

    def holds(self, kind: str, lhs: tuple, rhs: tuple, pattern: tuple = ()) -> bool:
        ask = (kind, lhs, rhs, tuple(sorted(pattern)))
        if ask not in self.verdicts:
            self.asks.add(ask)
            return False
        ok, largest = self.verdicts[ask]
        return ok and (kind == "ind" or largest >= self.support)


def _choices(m: np.ndarray, attrs: tuple, k: int) -> list[dict[int, int]]:
    """Every way to give each attribute one of its k best targets; of equal ones the higher id is better."""
    best = [np.lexsort((np.arange(len(m)), m[:, a]))[::-1][:k].tolist() for a in attrs]
    return [dict(zip(attrs, x)) for x in itertools.product(*best)]


def _images(kind: str, dep: tuple, a: dict[int, int], b: dict[int, int]) -> tuple | None:
    """The dependency carried over; None if its sides meet, or a left side that must not repeat does."""
    x, y = tuple(a[i] for i in dep[0]), tuple(b[i] for i in dep[1])
    pattern = tuple((a[i], v) for i, v in dep[2]) if kind == "cfd" else ()
    if set(x) & set(y) or kind != "ind" and len(set(x)) < len(x) or kind == "cfd" and not pattern:
        return None
    return kind, x, y, pattern


def _pairs(m: np.ndarray, kind: str, dep: tuple, k: int) -> Iterator[tuple[dict[int, int], dict[int, int]]]:
    """What the left and the right side are mapped by. ``m`` may change between them: the candidates of an IND's right side are then looked up anew."""
    if kind == "ind":
        for a in _choices(m, dep[0], k):
            for b in _choices(m, dep[1], k):
                yield a, b
    else:
        for a in _choices(m, tuple(dict.fromkeys(dep[0] + dep[1])), k):
            yield a, a


def _mappings(m: np.ndarray, kind: str, dep: tuple, k: int, known: Known, wide: int) -> Iterator[list[dict[int, int]]]:
    """The mappings of one dependency that hold. If one isn't known, those of ``wide`` candidates are asked for, since
    rewards will bring some of them in."""
    for a, b in _pairs(m, kind, dep, k):
        image = _images(kind, dep, a, b)
        if image:
            before = len(known.asks)
            if known.holds(*image):
                yield [a, b] if kind == "ind" else [a]
            elif len(known.asks) > before:
                for x, y in _pairs(m, kind, dep, wide):
                    if more := _images(kind, dep, x, y):
                        known.holds(*more)


def _give(m: np.ndarray, mapping: dict[int, int], r: float, ceiling: float) -> None:
    for s, t in mapping.items():
        m[t, s] += min(r, max(ceiling - m[t, s], 0.0))


def refine(matrix, known: Known, fds: list[tuple], inds: list[tuple], c: Config = Config(), cfds: list[tuple] = ()) -> list[list[float]]:
    """``fds``, ``inds``, ``cfds``: (lhs, rhs) of source columns, for CFDs with a pattern of (column,
    constant) pairs, in order. Rewards act at once, so order matters.

    If ``known.asks`` isn't empty afterwards, the array is that of an unfinished run.
    """
    state = Rounds(np.array(matrix, float), c)
    deps = {"fd": fds, "ind": inds, "cfd": cfds}
    if not state.now.size:
        return state.now.tolist()
    if c.fixed is not None:
        raw = state.now.copy()
        for kind in c.kinds():
            for d in deps[kind]:
                for mapping in itertools.chain.from_iterable(_mappings(raw, kind, d, c.k_max, known, c.k_max)):
                    _give(state.now, mapping, c.fixed.get(kind, 0.01), math.inf)
        return state.now.tolist()
    for _ in range(c.max_iter):
        state.starts.append(state.now.copy())
        k, r, held = state.width(), state.reward(), 0
        for kind in c.kinds():
            for d in deps[kind]:
                for mappings in _mappings(state.now, kind, d, k, known, c.k_max + 1):
                    held += 1
                    for mapping in mappings:
                        _give(state.now, mapping, r, c.ceiling)
        if known.asks:
            break
        then = state.close(held)
        if then == "mean":
            return np.mean(state.starts[-4:], axis=0).tolist()
        if then == "stop":
            break
    return state.now.tolist()


DEP = "struct<kind:string,lhs:array<int>,rhs:array<int>,pattern:array<struct<attr:int,value:string>>>"
#: A run: the case that its rows and dependencies belong to, its array by target column, dependencies in order.
RUN_SCHEMA = f"run_id string, case_id string, config string, matrix array<array<double>>, deps array<{DEP}>"
_OUT = f"run_id string, case_id string, first_rows int, matrix array<array<double>>, asks array<{DEP}>"


def runs(scores: DataFrame, deps: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """A run for each case and configuration, named case|configuration (or case, for the name "").

    ``scores``: case_id, t_attr, s_attr, score, every cell of a case, columns numbered from 0. ``deps``: case_id,
    kind, place, lhs, rhs, pattern.
    """
    listed = lambda at, value: F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value])
    matrix = scores.groupBy("case_id", "t_attr").agg(listed("s_attr", "score").alias("row")).groupBy("case_id").agg(listed("t_attr", "row").alias("matrix"))
    own = deps.select("case_id", "place", F.struct("kind", "lhs", "rhs", "pattern").cast(DEP).alias("dep"))
    own = own.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "dep"))), lambda x: x["dep"]).alias("deps"))
    each = scores.sparkSession.createDataFrame([(n, json.dumps(asdict(c))) for n, c in configs.items()], "name string, config string")
    out = matrix.join(own, "case_id", "left").crossJoin(F.broadcast(each))  # configurations are a list in hand
    name = F.when(F.col("name") == "", F.col("case_id")).otherwise(F.concat_ws("|", "case_id", "name"))
    return out.select(name.alias("run_id"), "case_id", "config", "matrix", F.coalesce("deps", F.array().cast(f"array<{DEP}>")).alias("deps"))


def _one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("lhs", pa.list_(pa.int32())), ("rhs", pa.list_(pa.int32())), ("pattern", pa.list_(pa.struct([("attr", pa.int32()), ("value", pa.string())])))])
    plain = lambda d: (d["kind"], tuple(d["lhs"]), tuple(d["rhs"]), tuple((e["attr"], e["value"]) for e in d["pattern"] or ()))
    for batch in batches:
        out = {"run_id": [], "case_id": [], "first_rows": [], "matrix": [], "asks": []}
        for r in batch.to_pylist():
            c, deps = Config(**json.loads(r["config"] or "{}")), {k: [] for k in KINDS}
            for d in r["deps"] or ():
                name, lhs, rhs, pattern = plain(d)
                deps[name].append((lhs, rhs, pattern) if name == "cfd" else (lhs, rhs))
            known = Known({plain(v): (v["holds"], v["support"]) for v in r["known"] or () if v["first_rows"] == c.first_rows}, c.min_group_support)
            m = refine(r["matrix"], known, deps["fd"], deps["ind"], c, deps["cfd"])
            asks = [{"kind": a[0], "lhs": a[1], "rhs": a[2], "pattern": [{"attr": i, "value": v} for i, v in a[3]]} for a in sorted(known.asks)]
            for k, v in zip(out, (r["run_id"], r["case_id"], c.first_rows, m, asks)):
                out[k].append(v)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.float64())), pa.list_(kind))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def refine_runs(own: DataFrame, target: DataFrame) -> DataFrame:
    """run_id, t_attr, s_attr, score of runs of RUN_SCHEMA over target cells (case_id, row_id, t_attr, raw).

    A pass carries every run as far as the known verdicts go and gives out the dependencies that it needs next;
    one job finds out about these for all runs, and the runs that asked go on. Runs hold arrays, dependencies and
    verdicts, as large as a schema; target rows are in the relation's job only.
    """
    own, target = stored(own, "runs"), stored(target, "target")
    known, done = own.sparkSession.createDataFrame([], validity.ASK + ", first_rows int, holds boolean, support long"), []
    while True:
        verdicts = known.groupBy("case_id").agg(F.collect_list(F.struct("kind", "lhs", "rhs", "pattern", "first_rows", "holds", "support")).alias("known"))
        out = stored(own.join(verdicts, "case_id", "left").mapInArrow(_one, _OUT), "refined")
        done.append(out.where(F.size("asks") == 0))
        asks = out.select("case_id", "first_rows", F.explode("asks").alias("a")).select("case_id", "first_rows", "a.*").distinct()
        depths = [r[0] for r in asks.select("first_rows").distinct().collect()]  # as many as configurations differ in
        if not depths:
            break
        own = own.join(out.where(F.size("asks") > 0).select("run_id"), "run_id", "left_semi")
        asked = [validity.relation(asks.where(F.col("first_rows") == d).drop("first_rows"), target, (d,)) for d in depths]
        known = stored(reduce(DataFrame.unionByName, [known, *asked]), "known")
    cells = reduce(DataFrame.union, done).select("run_id", F.posexplode("matrix").alias("t_attr", "row"))
    return cells.select("run_id", "t_attr", F.posexplode("row").alias("s_attr", "score"))
