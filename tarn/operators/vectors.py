"""Nearest vectors from an inverted file of centroids, exactly.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest centroid.  A query is first compared with
its PROBES nearest lists, and the k-th distance found is a bound: a list whose centroid is farther from the query than
the bound plus the list's radius cannot hold a nearer vector and is skipped; all others are compared in a second
round.  So the result is that of comparing all, and a list is read for a query only if it may matter.

Lists are cut into parts of about PART vectors by a hash of the id, so one that holds much of all vectors is compared in many tasks; a
list's queries go to each of its parts.  Each part sends its k best for each query, and a window keeps the k best of these.

The distance is Euclidean, in double precision; equal distances go by id.  Vectors that are null, of another length than ``dim``, or hold
null or non-finite components are neither found nor ask; rows of equal id are vectors of their own. A vector's own id is not its neighbour.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTS, SAMPLE, ROUNDS = 64, 8192, 5  # centroids at most, fitted on that many vectors of smallest hash, in that many rounds
PROBES, PART = 2, 20_000
MARGIN = 1e-6  # relative, for rounding


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    return vectors.where(F.col(f"`{vector_col}`").isNotNull() & fine).select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))


def fitted(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of (id, v): at most ``lists`` rows; ``sample`` vectors come to the driver."""
    rows = vectors.orderBy(F.xxhash64("id"), "v").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    at = np.unique(np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int))
    c = x[at]
    for _ in range(rounds):
        of = distances(x, c).argmin(axis=1)
        c = np.array([x[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
    return np.unique(c, axis=0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, by rows of x; differences are squared, so equal vectors have distance 0."""
    return np.sqrt(np.stack([((y - row) ** 2).sum(axis=1) for row in x]) if len(x) else np.zeros((0, len(y))))


def inverted(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list, far, id, v): each vector with its list and its distance to the centroid."""

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
            d = distances(x, centroids)
            of = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=int)
            yield pdf.assign(list=of.astype(np.int32), far=d[np.arange(len(d)), of])[["list", "far", "id", "v"]]

    return vectors.mapInPandas(run, f"list int, far double, id {vectors.schema['id'].dataType.simpleString()}, v array<double>")


def _compared(pairs: DataFrame, index: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(q, id, d): for each query its k nearest in each part of the lists it is paired with (q, qv, list)."""
    kind = index.schema["id"].dataType.simpleString()
    sliced = index.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("list", "part", "id", "v")  # at most LISTS rows
    asked = pairs.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("list", "part", "q", "qv")

    def near(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("id", kind="stable")
            x, ids = np.array(vectors["v"].tolist(), dtype=np.float64), vectors["id"].to_numpy()
            for q, v in zip(queries["q"], queries["qv"], strict=True):
                d = np.sqrt(((x - np.asarray(v)) ** 2).sum(axis=1))
                d[ids == q] = np.inf
                few = np.argpartition(d, min(k, len(d)) - 1)[:k] if len(d) > k else np.arange(len(d))
                few = np.flatnonzero(d <= d[few].max())  # ties at the edge too
                few = few[np.argsort(d[few], kind="stable")][:k]
                out += [(q, ids[i], d[i]) for i in few if np.isfinite(d[i])]
        return pd.DataFrame(out, columns=["q", "id", "d"])

    return sliced.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInPandas(near, f"q {kind}, id {kind}, d double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, probes: int = PROBES, part: int = PART) -> DataFrame:
    """(q, rk, id, d) of each query's k nearest vectors, rk from 1."""
    from pyspark.sql import Window

    all_, asked = usable(vectors, id_col, vector_col, dim), usable(queries, id_col, vector_col, dim)
    centroids = fitted(all_, lists)
    kind = all_.schema["id"].dataType.simpleString()
    if not len(centroids):
        return all_.select(F.col("id").alias("q"), F.lit(1).alias("rk"), "id", F.lit(0.0).alias("d")).where(F.lit(False))
    index = inverted(all_, centroids)
    stats = index.groupBy("list").agg(F.max("far").alias("radius"), (F.floor(F.count(F.lit(1)) / part) + 1).alias("parts"))
    radius = {r["list"]: r["radius"] for r in stats.collect()}  # at most LISTS rows
    full = np.array([radius.get(j, -np.inf) for j in range(len(centroids))])
    parts = stats.select("list", "parts")

    def paired(first: bool):
        def run(batches):
            for pdf in batches:
                d = distances(np.array(pdf["qv"].tolist(), dtype=np.float64).reshape(len(pdf), -1), centroids)
                d[:, np.isinf(full)] = np.inf
                order = np.argsort(d, axis=1, kind="stable")
                probed = np.zeros_like(d, dtype=bool)
                np.put_along_axis(probed, order[:, :probes], True, axis=1)
                if first:
                    wanted = probed
                else:
                    bound = pdf["bound"].to_numpy(dtype=np.float64)[:, None]
                    wanted = ~probed & (d - full * (1 + MARGIN) - MARGIN * (d + 1e-300) <= np.where(np.isnan(bound), np.inf, bound))
                i, j = np.nonzero(wanted & np.isfinite(d))
                yield pd.DataFrame({"list": j.astype(np.int32), "q": pdf["q"].to_numpy()[i], "qv": pdf["qv"].to_numpy()[i]})

        return run

    schema = f"list int, q {kind}, qv array<double>"
    q = asked.select(F.col("id").alias("q"), F.col("v").alias("qv")).where("q IS NOT NULL").dropDuplicates(["q"])
    some = _compared(q.mapInPandas(paired(True), schema), index, parts, k)
    bound = some.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.element_at(F.array_sort(F.collect_list("d")), k)).alias("bound"))  # PROBES * parts * k numbers a query
    rest = _compared(q.join(bound, "q", "left").mapInPandas(paired(False), schema), index, parts, k)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return some.unionAll(rest).withColumn("rk", rank).where(F.col("rk") <= k).select("q", "rk", "id", "d")
