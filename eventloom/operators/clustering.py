"""Clusters of chunk vectors: k-means over a sweep of k, judged by the exact silhouette."""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.blocks import ROWS, dealt, distances, matrix, pieces, sides, spread
from eventloom.functions.durable import durable
from eventloom.functions.vectors import unit

#: The sweep and the restarts.
LEAST_K, MOST_K, RESTARTS, ITERATIONS, SEED = 5, 30, 8, 300, 42
#: A run has settled when no centre moves further; rounds of draws, and of those while there are too few.
SETTLED, ROUNDS, MOST_ROUNDS, TINY = 1e-4, 2, 8, 1e-14
#: Numbers of the centres that a pass over the rows asks for (8 MB of a task's answer).
MOST_NUMBERS = 1 << 20


def silhouettes(rows: DataFrame, key: str, vector: str, clusters: Sequence[str]) -> DataFrame:
    """k (the key), n, c, silhouette by Euclidean distance for c, the n-th of ``clusters``, over all rows. A distance is worked
    out once for all of them.

    All pairs of rows are worked out, in blocks: a task holds some rows and their sums by cluster, and meets the others as they
    come. A point alone in its cluster has 0, and so has one without a cluster, which is no other point's neighbour.
    """
    held = rows.select(F.col(key).alias("k"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(clusters)], F.col(vector).alias("v"))
    names = held.agg(*[F.sort_array(F.collect_set(f"c{n}")) for n in range(len(clusters))]).first()
    places, width = [], 0
    for own in names:
        places.append({c: width + i for i, c in enumerate(own)})
        width += len(own)
    kinds = dict(held.dtypes)

    def coded(part: pa.RecordBatch) -> np.ndarray:
        """For each row and clustering the column of its cluster, -1 for none."""
        return np.array([[p.get(c, -1) for c in part.column(f"c{n}").to_pylist()] for n, p in enumerate(places)], dtype=np.int64).reshape(len(places), len(part)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for side, part in sides(batches, max(64, min(ROWS, (1 << 21) // max(1, width)))):
            if side == 0:
                block, x, code = part, matrix(part.column("v")), coded(part)
                keys = {k: i for i, k in enumerate(part.column("k").to_pylist())}
                ident = np.array([keys[k] for k in part.column("k").to_pylist()])
                sums, count = np.zeros((len(part), width)), np.zeros(width)
                same = np.zeros((len(part), width))
                continue
            if block is None:
                continue
            y, other = matrix(part.column("v")), coded(part)
            marks = np.zeros((len(part), width))
            row, n = np.nonzero(other >= 0)
            marks[row, other[row, n]] = 1
            count += marks.sum(axis=0)
            near = np.flatnonzero(part.column("own_block").to_numpy(zero_copy_only=False))
            known = np.array([keys.get(k, -1) for k in part.column("k").take(pa.array(near)).to_pylist()], dtype=np.int64)
            for i in range(0, len(x), 1024):
                gap = distances(x[i : i + 1024], y)
                if len(near):
                    at, to = np.nonzero(ident[i : i + 1024, None] == known)
                    gap[at, near[to]] = 0.0
                    np.add.at(same, at + i, marks[near[to]])
                sums[i : i + 1024] += gap @ marks
        if block is None:
            return
        for n, p in enumerate(places):
            at = np.array(sorted(p.values()), dtype=np.int64)
            others = count[at] - same[:, at]
            mean = np.divide(sums[:, at], others, out=np.full(others.shape, np.nan), where=others > 0)
            own = code[:, n, None] == at
            a, b = (np.where(which & ~np.isnan(mean), mean, np.inf).min(axis=1, initial=np.inf) for which in (own, ~own))
            most = np.maximum(a, b)
            sure = np.isfinite(most) & (most > 0)
            value = np.divide(b - a, most, out=np.zeros(len(a)), where=sure)
            yield pa.RecordBatch.from_arrays([block.column("k"), pa.array(np.full(len(value), n, dtype=np.int32)), block.column(f"c{n}"), pa.array(value)], names=["k", "n", "c", "silhouette"])

    return dealt(held, held, max(256, min(2 * ROWS, (1 << 23) // max(1, width)))).mapInArrow(run, f"k {kinds['k']}, n int, c {kinds['c0']}, silhouette double")


def silhouette_scores(rows: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """key, cluster, silhouette of one clustering."""
    found = silhouettes(rows, key, vector, [cluster])
    return found.select(F.col("k").alias(key), F.col("c").alias(cluster), "silhouette")


@dataclass(frozen=True)
class Ask:
    """What a run wants to know of all rows: sums, counts and cost by nearest centre; with a rate, the rows drawn by their
    squared distance times the rate; without centres, the row drawn first."""

    centers: np.ndarray | None
    rate: float | None = None
    salt: int = 0


class KMeans:
    """One run of k-means from one seed, as a generator: it yields what it asks of the rows and gets the answer, so that one
    pass over the rows answers all runs. Its result is (cost, centres).

    Centres start as k-means|| finds them over all rows: a few rounds of draws by distance, then k of the drawn ones by weight.
    """

    def __init__(self, k: int, seed: int) -> None:
        self.k, self.seed = k, seed

    def getK(self) -> int:  # noqa: N802  named as Spark's
        return self.k

    def _salt(self, step: int) -> int:
        return (self.k * 1_000_003 + self.seed) * 64 + step

    def fit(self) -> Generator[Ask, Any, tuple[float, np.ndarray]]:
        k, rng = self.k, np.random.default_rng(self.seed)
        centers, step = (yield Ask(None, salt=self._salt(0))), 0
        cost, sums, count = yield Ask(centers)
        while cost > TINY * count.sum() and step < (ROUNDS if len(centers) > k else MOST_ROUNDS):
            step += 1
            drawn = yield Ask(centers, 2 * k / cost, self._salt(step))
            centers = np.unique(np.vstack([centers, drawn]), axis=0)
            cost, sums, count = yield Ask(centers)
        if len(centers) > k:
            centers = _of_drawn(centers, count, k, rng)
            cost, sums, count = yield Ask(centers)
        for _ in range(ITERATIONS):
            new = np.divide(sums, count[:, None], out=centers.copy(), where=count[:, None] > 0)
            moved, centers = ((new - centers) ** 2).sum(axis=1).max(), new
            cost, sums, count = yield Ask(centers)
            if moved <= SETTLED**2:
                break
        return cost, centers


def _of_drawn(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of few weighted points: k-means++, then rounds over the points."""
    chosen = [points[rng.choice(len(points), p=weight / weight.sum())]]
    gap = ((points - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        p = weight * gap
        p = p if p.sum() > 0 else gap + 1e-300
        chosen.append(points[rng.choice(len(points), p=p / p.sum())])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(axis=1))
    centers = np.array(chosen)
    for _ in range(30):
        near = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        mass = np.bincount(near, weights=weight, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points * weight[:, None])
        new = np.divide(sums, mass[:, None], out=centers.copy(), where=mass[:, None] > 0)
        if np.array_equal(new, centers):
            break
        centers = new
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres by rows: 1 for the nearest centre, the first of equal ones; squared distances to it)."""
    gap = centers @ (-2.0 * x.T)
    gap += (centers * centers).sum(axis=1)[:, None]
    least = gap.min(axis=0)
    marks = (gap == least).astype(np.float64)
    if marks.sum() != len(x):
        marks = np.zeros_like(gap)
        marks[gap.argmin(axis=0), np.arange(len(x))] = 1
    return marks, np.maximum(0.0, least + (x * x).sum(axis=1))


def _chance(ident: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each row, by its hash and the salt, whatever part it lies in."""
    z = ident.astype(np.int64).view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) / 2.0**64


def _answers(held: DataFrame, asked: list[Ask]) -> list:
    """The answers to what all runs ask, from one pass over the rows; a task gives its sums, never its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = [None] * len(asked)
        for part in pieces(batches, 4096):
            x, ident = matrix(part.column("__v")), part.column("__h").to_numpy()
            for n, a in enumerate(asked):
                if a.centers is None:
                    u = _chance(ident, a.salt)
                    at = int(u.argmin())
                    new = (u[at], x[at].tolist())
                    own[n] = new if own[n] is None else min(own[n], new)
                    continue
                marks, gap = _nearest(x, a.centers)
                if a.rate is not None:
                    own[n] = [*(own[n] or []), np.unique(x[_chance(ident, a.salt) < a.rate * gap], axis=0)]
                    continue
                new = (gap.sum(), marks @ x, marks.sum(axis=1))
                own[n] = new if own[n] is None else tuple(p + q for p, q in zip(own[n], new, strict=True))
        if own and own[0] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["own"])

    parts = [pickle.loads(r.own) for r in held.mapInArrow(run, "own binary").collect()]  # a row a task
    out: list = []
    for n, a in enumerate(asked):
        each = [p[n] for p in parts]
        if a.centers is None:
            out.append(np.array([min(each)[1]]))
        elif a.rate is not None:
            out.append(np.vstack([y for x in each for y in x]))
        else:
            out.append(tuple(sum(x) for x in zip(*each, strict=True)))
    return out


def _best_centers(held: DataFrame, ks: Sequence[int], restarts: int, seed: int) -> list[np.ndarray]:
    """For each k the centres of the best of several runs, the first of equals; one pass over the rows answers all runs."""
    runs = [KMeans(k, seed + i).fit() for k in ks for i in range(restarts)]
    asked, done = {n: next(r) for n, r in enumerate(runs)}, {}
    while asked:
        left, answers = list(asked.items()), {}
        while left:  # so many runs in a pass that its answers stay small
            size, n = 0, 0
            while n < len(left) and (n == 0 or size + np.size(left[n][1].centers) <= MOST_NUMBERS):
                size, n = size + np.size(left[n][1].centers), n + 1
            answers |= dict(zip([i for i, _ in left[:n]], _answers(held, [a for _, a in left[:n]]), strict=True))
            left = left[n:]
        for n, answer in answers.items():
            try:
                asked[n] = runs[n].send(answer)
            except StopIteration as end:
                done[n] = end.value
                del asked[n]
    groups = [[done[n] for n in range(at, at + restarts)] for at in range(0, len(runs), restarts)]
    return [min(group, key=lambda x: x[0])[1] for group in groups]


def _ready(rows: DataFrame, vector: str) -> DataFrame:
    held = rows.where(F.col(vector).isNotNull()).select(unit(F.col(vector)).alias("__v"))
    return spread(held.select("__v", F.xxhash64("__v").alias("__h"))).persist()


def _assigned(rows: DataFrame, vector: str, centers: dict[str, np.ndarray]) -> DataFrame:
    """rows that have a vector with the number of the nearest centre, a column for each clustering."""
    held = rows.where(F.col(vector).isNotNull()).withColumn("__v", unit(F.col(vector)))
    kept = [c for c in held.columns if c != "__v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 4096):
            x = matrix(part.column("__v"))
            made = [pa.array(_nearest(x, c)[0].argmax(axis=0).astype(np.int32)) for c in centers.values()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], names=[*kept, *centers])

    schema = T.StructType([*held.select(kept).schema.fields, *[T.StructField(c, T.IntegerType()) for c in centers]])
    return held.mapInArrow(run, schema)


def kmeans(rows: DataFrame, vector: str, k: int, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """rows with cluster_id: the best of several k-means runs over unit vectors; rows without a vector drop out.

    The answer is written, so that what reads it does not embed and assign again.
    """
    ready = _ready(rows, vector)
    try:
        found = _best_centers(ready, [k], restarts, seed) if ready.limit(1).count() else [np.zeros((1, 1))]
    finally:
        ready.unpersist()
    return durable(_assigned(rows, vector, {"cluster_id": found[0]}))


def sweep(rows: DataFrame, key: str, vector: str, least: int = LEAST_K, most: int = MOST_K, restarts: int = RESTARTS) -> tuple[DataFrame, DataFrame]:
    """(rows with the cluster_id of the best k, k with its score and whether it is the best).

    k is at most one less than the number of rows; below three rows all are one cluster, and where no k in the sweep is
    possible k is two. The first of equal scores wins.
    """
    spark = rows.sparkSession
    held = rows.where(F.col(vector).isNotNull())
    n = held.count()
    schema = "k int, score double, is_best boolean"
    if n < 3:
        return held.withColumn("cluster_id", F.lit(0)), spark.createDataFrame([], schema)
    ks = range(least, min(most, n - 1) + 1)
    names = [f"__c{k}" for k in ks]
    ready = _ready(held, vector)
    try:
        found = _best_centers(ready, ks, restarts, SEED) if ks else []
    finally:
        ready.unpersist()
    made = durable(_assigned(held, vector, dict(zip(names, found, strict=True))))
    ends = made.agg(*[F.struct(F.min(c).alias("least"), F.max(c).alias("most")) for c in names]).first() if names else []
    several = [(k, c) for k, c, (low, high) in zip(ks, names, ends, strict=True) if low < high]
    score = {}
    if several:
        found = silhouettes(made, key, vector, [c for _, c in several])
        score = {r.n: r.score for r in found.groupBy("n").agg(F.avg("silhouette").alias("score")).collect()}
    scores = [(k, score[i]) for i, (k, _) in enumerate(several)]
    if not scores:
        return kmeans(held, vector, 2, restarts), spark.createDataFrame([], schema)
    best = max(scores, key=lambda x: (x[1], -x[0]))[0]
    return made.withColumn("cluster_id", F.col(f"__c{best}")).drop(*names), spark.createDataFrame([(k, s, k == best) for k, s in scores], schema)
