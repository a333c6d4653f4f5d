"""Exact centroid clustering of integer vectors with the Shallot search.

Each vector remembers its nearest centroid with an upper bound of the distance, and the second-nearest one with a lower
bound of the distance to all others. Centroids' moves loosen the bounds; where they still part, nothing is computed.
Else the distances to both remembered centroids are computed, and the closer one is where the search starts: the other
centroids come in the order of their distance from it, and the search ends when that distance leaves the ball whose
radius is the vector's distance to the start plus that to the second-nearest one found so far, so the ball shrinks with
each better find. The vectors' bounds are floating-point numbers with a margin; what decides is the integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsieve.session import materialize

#: Components beyond this size (of either sign) take no part: a squared distance might not fit a long.
LARGEST = 1 << 27
#: Relative margin of the bounds; a float64 square root and a sum are exact to some 1e-15.
MARGIN = 1e-9
STATE = "nearest int, second int, upper double, lower double, distance long"


def usable(vector: Column, size: int) -> Column:
    """Exactly ``size`` components, none null, non-finite or too large."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / 256, F.lit(False)))
    return F.coalesce((F.size(vector) == size) & fits, F.lit(False))


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("int"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """Those with the least SHA-256 of the seed and the id; rows of one id in the order of their components."""
    hashed = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "vector")
    return np.array([r["vector"] for r in hashed.orderBy("hash", "vector").limit(k).collect()], np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Search:
    """One round's centroids with what the search needs about them."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        between = np.sqrt(np.array([distances(centroids, c[None]) for c in centroids]).reshape(k, k).astype(float))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1) * (1 - MARGIN)
        self.moves = np.zeros(k) if before is None else np.sqrt(distances(centroids, before).astype(float)) * (1 + MARGIN)
        most = np.argsort(-self.moves, kind="stable")[:2]
        #: For each centroid the largest move of another.
        self.others = np.full(k, self.moves[most[0]] if k else 0.0)
        if k:
            self.others[most[0]] = self.moves[most[1]] if k > 1 else 0.0

    def fresh(self, n: int) -> tuple[np.ndarray, ...]:
        """State of vectors that no search has seen: any two centroids, no bounds."""
        second = min(1, len(self.centroids) - 1)
        return np.zeros(n, np.int64), np.full(n, second), np.full(n, np.inf), np.zeros(n)

    def assign(self, x: np.ndarray, nearest: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same arrays for the new centroids, and the exact distance to the nearest; equal ones go to the smaller number."""
        c = self.centroids
        nearest, second = nearest.copy(), second.copy()
        upper, lower = upper + self.moves[nearest], lower - self.others[nearest]
        best = distances(x, c[nearest])
        upper = np.minimum(upper, np.sqrt(best.astype(float)) * (1 + MARGIN))
        open_ = np.flatnonzero(upper >= lower)
        if len(c) > 1 and len(open_):
            n1, n2, d1 = nearest[open_], second[open_], best[open_]
            y = x[open_]
            d2 = distances(y, c[n2])
            swap = (d2 < d1) | ((d2 == d1) & (n2 < n1))
            n1, n2 = np.where(swap, n2, n1), np.where(swap, n1, n2)
            d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
            start, other = n1.copy(), n2.copy()
            from_start = np.sqrt(d1.astype(float)) * (1 + MARGIN)
            live = np.arange(len(open_))
            for rank in range(1, len(c)):
                ball = from_start[live] + np.sqrt(d2[live].astype(float)) * (1 + MARGIN)
                live = live[self.sorted[start[live], rank] <= ball]
                if not len(live):
                    break
                j = self.order[start[live], rank]
                new = (j != start[live]) & (j != other[live])
                at, j = live[new], j[new]
                d = distances(y[at], c[j])
                first = (d < d1[at]) | ((d == d1[at]) & (j < n1[at]))
                nearer = ~first & (d < d2[at])
                a = at[first]
                n2[a], d2[a] = n1[a], d1[a]
                n1[a], d1[a] = j[first], d[first]
                b = at[nearer]
                n2[b], d2[b] = j[nearer], d[nearer]
            nearest[open_], second[open_], best[open_] = n1, n2, d1
            upper[open_] = np.sqrt(d1.astype(float)) * (1 + MARGIN)
            lower[open_] = np.sqrt(d2.astype(float)) * (1 - MARGIN)
        return nearest, second, upper, lower, best


def assigned(vectors: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """``vectors`` with their state for these centroids; ``before`` are those that the state in it is for."""
    search = Search(centroids, before)
    state = [c.split()[0] for c in STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["vector"].to_numpy()).astype(np.int64) if len(batch) else np.zeros((0, centroids.shape[1]), np.int64)
            old = search.fresh(len(x)) if before is None else [batch[c].to_numpy() for c in state[:4]]
            out = dict(zip(state, search.assign(x, *old)))
            yield pd.concat([batch[["vec_id", "vector"]].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["vector"], *T.StructType.fromDDL(STATE)])
    return vectors.mapInPandas(run, schema)


def means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster, component by component; an empty cluster's centroid stays.

    The sums come to the driver: one row for each cluster.
    """
    size = centroids.shape[1]
    sums = [F.sum(F.col("vector")[i].cast("long")).alias(f"s{i}") for i in range(size)]
    out = centroids.copy()
    for row in vectors.groupBy("nearest").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[row["nearest"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return out


def discard(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each vector.

    ``vectors`` has ``vec_id`` and ``vector``, numbers of any type, of which floor(256 * x) is taken. Rows that aren't
    :func:`usable` take no part. Rows without id are clustered but never start a centroid; rows of one id count each;
    other columns aren't read. With fewer vectors than ``k`` there are fewer centroids, with none no rows.

    A round reads the vectors with their state, assigns them where they are, and writes them with the new state; only
    sums by cluster move. A round's table is deleted once the next one is written, so at most two exist.
    """
    kept = vectors.where(usable(F.col("vector"), size)).select("vec_id", quantised(F.col("vector")).alias("vector"))
    current = materialize(kept)
    centroids, before = first_centroids(current, k, seed), None
    if not len(centroids):
        centroids = np.zeros((0, size), np.int64)
        current = current.limit(0)
    for _ in range(rounds if len(centroids) else 0):
        following = materialize(assigned(current, centroids, before))
        discard(current)
        current, before = following, centroids
        centroids = means(current, centroids)
    if len(centroids):
        following = materialize(assigned(current, centroids, before))
        discard(current)
        current = following
    else:
        current = current.select("vec_id", F.lit(0).alias("nearest"), F.lit(0).cast("long").alias("distance"))
    found = current.groupBy("nearest").agg(F.sum("distance").alias("inertia")).collect()
    total = sum(r["inertia"] for r in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(r["nearest"], r["inertia"], total, digest[r["nearest"]]) for r in found]
    about = vectors.sparkSession.createDataFrame(table, "nearest int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = current.join(F.broadcast(about), "nearest")  # a row for each cluster
    return joined.select("vec_id", F.col("nearest").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
