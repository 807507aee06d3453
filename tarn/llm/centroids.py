"""Centroid clustering with annulus search.

Vectors and centroids are whole numbers, so every distance and every mean is exact.  Centroids are sorted by
norm.  A vector's distance to the centroid whose norm is nearest to its own is an upper bound r; by the triangle
inequality, only centroids whose norm lies within r of the vector's can be as near.  Two binary searches find
this range, and all in it are compared exactly, so ties, those on the edge of the annulus too, go to the
centroid of the smaller number.  Norms are compared with a margin for rounding, which widens the range only.

Each round sends, for each batch of vectors and each centroid, the sums of its components in digits of 30 bits; these are added
in Spark, and of each round only the sums of the centroids (k * dim numbers) come to the driver.

Only vectors with exactly ``dim`` components, none null or non-finite, are kept; others have no row, and without any
kept vector the result is empty.  With fewer than k kept vectors there are as many centroids as vectors.  Rows of equal id
are vectors of their own; the first centroids of equal hash go by their components.  A row without an
id hashes ``seed:`` alone.  Components so large that a sum of squares could pass 62 bits are worked out in Python's
whole numbers; a distance or a sum beyond 64 bits is null, with its cluster still exact.  Columns of the input beside the two named are not kept.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import dropped, give_back, saved

SCALE, DIM, K, ROUNDS, SEED = 64, 64, 16, 3, 1
UNIT = 64  # of norms where numbers are large: 2^UNIT
DIGIT = 30  # bits
LARGE = 1 << 26  # largest component that 64-bit sums are used for: 4 * 2^52 * 64 < 2^62


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers; Python's where they are too large for 64-bit sums."""
    v = np.floor(vectors.astype(np.float64) * scale)
    if not len(v) or np.abs(v).max() < LARGE:
        return v.astype(np.int64)
    exact = [[int(x) if np.isfinite(x) else int(np.floor(y)) * scale for x, y in zip(r, s, strict=True)] for r, s in zip(v, vectors.astype(np.float64), strict=True)]
    return np.array(exact, dtype=object)  # beyond the doubles, x is a whole number itself


def squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1)


def roots(a: np.ndarray, unit: int) -> np.ndarray:
    """Square roots, in units of 2^unit; whole units if there is one, since Python's whole numbers can pass the doubles."""
    return np.array([float(math.isqrt(int(v)) >> unit) for v in a]) if unit else np.sqrt(a.astype(np.float64))


def digits(v: int) -> Iterator[tuple[int, int]]:
    """(place, digit): v is the sum of digit * 2^(DIGIT * place)."""
    place = 0
    while v not in (0, -1):
        yield place, v & (1 << DIGIT) - 1
        place, v = place + 1, v >> DIGIT
    if v:
        yield place, v


class Annuli:
    """Nearest centroids of many vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.large = any(abs(x) >= LARGE for c in centroids for x in c)
        self.centroids = np.array(centroids, dtype=object if self.large else np.int64)
        sizes = squares(self.centroids)
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]

    def _distances(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return squares(x - self.centroids[c])

    def ranges(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the first centroid in its annulus, in the order of norms, and the one beyond its last."""
        unit = UNIT if self.large or x.dtype == object else 0
        norms, norm = roots(self.sizes, unit), roots(squares(x), unit)
        after = np.minimum(np.searchsorted(norms, norm), len(norms) - 1)
        before = np.maximum(after - 1, 0)
        near = np.where(norm - norms[before] <= np.abs(norms[after] - norm), before, after)
        r = roots(self._distances(x, self.order[near]), unit)
        margin = 1e-9 * (norm + r + norms[near]) + (4 if unit else 1e-9)
        return np.searchsorted(norms, norm - r - margin, side="left"), np.searchsorted(norms, norm + r + margin, side="right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance)"""
        if not len(x):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        low, high = self.ranges(x)
        best, number = self._distances(x, self.order[low]), self.order[low].astype(np.int64)
        for step in range(1, int((high - low).max())):
            rows = np.flatnonzero(low + step < high)
            c = self.order[low[rows] + step]
            d = self._distances(x[rows], c)
            better = (d < best[rows]) | (d == best[rows]) & (c < number[rows])
            best[rows[better]], number[rows[better]] = d[better], c[better]
        return number, best


def _kept(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = F.col(f"`{vector_col}`")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.cast("array<double>").alias("v")).where(v.isNotNull() & fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _updated(kept: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """The centroids after one round."""
    annuli = Annuli(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = quantised(_matrix(b.column(0), dim), scale)
            number, _ = annuli.nearest(x)
            rows = []
            for c in np.unique(number).tolist():
                mine = x[number == c]
                rows += [(c, i, place, digit) for i, s in enumerate([len(mine), *mine.sum(axis=0).tolist()]) for place, digit in digits(int(s))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, [pa.int32()] * 3 + [pa.int64()], strict=True)], names=["cluster", "item", "place", "digit"])
        give_back()

    parts = kept.select("v").mapInArrow(run, "cluster int, item int, place int, digit long")
    sums: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "item", "place").agg(F.sum("digit").alias("digit")).collect():  # k * (dim + 1) numbers
        sums.setdefault(r["cluster"], [0] * (dim + 1))[r["item"]] += r["digit"] << DIGIT * r["place"]
    return [[s // sums[j][0] for s in sums[j][1:]] if j in sums else c for j, c in enumerate(centroids)]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(a row (id, cluster, distance) for each kept vector, the final centroids)"""
    kept = _kept(vectors, id_col, vector_col, dim)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(digest, "v").limit(k).collect()  # k rows
    centroids = [row.tolist() for row in quantised(np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), dim), scale)]
    for _ in range(rounds if centroids else 0):
        centroids = _updated(kept, centroids, dim, scale)
    annuli = Annuli(centroids) if centroids else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if annuli and len(b):
                number, distance = annuli.nearest(quantised(_matrix(b.column(1), dim), scale))
                fits = [int(d) if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int32()), pa.array(fits, pa.int64())], names=["id", "cluster", "distance"])
        give_back()

    kind = vectors.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col), centroids


def summed(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The rows with the sums of distances over their clusters and over all, and the digest of the centroid."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col(c).cast("decimal(38,0)")))
    per = assigned.groupBy("cluster").agg(whole("distance").alias("s")).collect()  # at most k rows
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    total = sum(int(r["s"]) for r in per) if all(r["s"] is not None for r in per) else None
    rows = [(r["cluster"], fits(None if r["s"] is None else int(r["s"])), fits(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in per]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")  # k rows


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return summed(saved(found, "clusters"), centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(n: int) -> str:
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, e, (min(struct_pack(d := d, c := c))).c AS c, min(d) AS d FROM (SELECT vec_id, e, c.c, list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) * (e[i] - m[i])))::BIGINT AS d FROM q, c{i} c) GROUP BY vec_id, e)""")
        if i < n:
            out.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(u.m, c.m) AS m FROM c{i} c LEFT JOIN (SELECT c, list(f ORDER BY i) AS m FROM (SELECT c, i, floor(sum(e[i])::DOUBLE / count(*))::BIGINT AS f FROM a{i}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c) u ON u.c = c.c)""")
    return ",\n".join(out)


#: Sums stay below 2^53 and a mean that is no whole number is far from one, so its floor in doubles is exact here.
OP13_SQL = f"""WITH q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e AS m FROM q ORDER BY sha256('1:' || vec_id) LIMIT {K}),
{_rounds_sql(ROUNDS)}
SELECT a.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c"""
