"""Embedding near-duplicates by an exact metric range join.

Vectors with equal label and equal components form one group, which joins as
one weighted vector, scaled by its largest component so that no square overflows.  Pivots (of the group vectors of smallest hashes, those farthest apart; a few, by
the size of the largest label) partition the sphere: a vector belongs to the
cell of its nearest pivot.  Two linked vectors are within the angle t of the
threshold, so by the triangle inequality for angles a vector x of pivot p can only link
with a member y of another cell q, which is nearer to q than to p, if x is within t of
the hyperplane between both: x.(p - q) <= |p - q| sin t; and only if angle(x, q) is no more than t beyond
the radius of q's cell (its farthest own member).  Where both hold, x
is copied to q's cell; nothing else can link there.  A cell counts its own
vectors' links among them and the copies, so cells are independent and counts
need no correction.  A cell of more than BLOCK vectors is worked on in blocks
against blocks, whose counts add up.  Cells return counts and a spanning forest of their
links, never pairs; components come from the forests.

How much the boundaries prune depends on the vectors.  In many dimensions unrelated
vectors are all about a right angle apart, so every boundary is near and cells hold most of a
label (see README); what is left then is exact work by blocks within labels.

Null labels, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing; vectors of different lengths do not link.
Repeated rows, and different vectors under one id, are vectors of their own; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import components, dropped, saved

CELL, BLOCK, MAX_PIVOTS = 4096, 4096, 512
TRIED = 4  # vectors looked at for each pivot
SLACK = 1e-7  # added to boundary angles, against rounding


def spread_out(units: list[np.ndarray], count: int) -> list[np.ndarray]:
    """Up to ``count`` of the vectors, each the farthest from those before it; other lengths are as far as can be."""
    out: list[np.ndarray] = []
    nearest = np.full(len(units), -2.0)
    while len(out) < min(count, len(units)):
        p = units[int(nearest.argmin())]
        out.append(p)
        same = [i for i, u in enumerate(units) if len(u) == len(p)]
        nearest[same] = np.maximum(nearest[same], np.array([units[i] for i in same]) @ p)
        nearest[[i for i in same if nearest[i] > 1 - 1e-12]] = 1.0
    return out


def distances(pivots: list[np.ndarray]) -> np.ndarray:
    """Distances between unit vectors by their products; 0 between those of different lengths, which are never neighbours."""
    out = np.zeros((len(pivots), len(pivots)))
    for d in {len(p) for p in pivots}:
        same = [i for i, p in enumerate(pivots) if len(p) == d]
        x = np.array([pivots[i] for i in same])
        out[np.ix_(same, same)] = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of each of n items, links a[i]-b[i]: the smallest index reachable. By rounds of minima and pointer jumps."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _links(own: np.ndarray, other: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted link counts of ``own`` rows among ``other``, and links (own, other) that connect what is linked; slices keep memory small.

    Cosines are taken in single precision first; only those within its rounding error of the threshold are worked out in double precision.
    """
    own, other = (m / np.sqrt((m * m).sum(1))[:, None] for m in (own, other))
    rough_own, rough_other = own.astype(np.float32), np.ascontiguousarray(other.T, dtype=np.float32)
    error = (own.shape[1] + 8) * 2.0**-23
    counts, a, b = np.zeros(len(own), dtype=np.int64), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(own), 512):
        cos = rough_own[i : i + 512] @ rough_other
        x, y = np.nonzero(cos >= threshold - error)
        doubt = np.flatnonzero(cos[x, y] < threshold + error)
        wrong = [k[np.einsum("ij,ij->i", own[x[k] + i], other[y[k]]) < threshold] for k in np.split(doubt, range(8192, len(doubt), 8192))]
        keep = np.ones(len(x), dtype=bool)
        keep[np.concatenate(wrong)] = False
        x, y = x[keep], y[keep]
        counts[i : i + 512] = np.bincount(x, weights=weights[y], minlength=len(cos)).astype(np.int64)
        root = forest(len(cos) + len(other), x, len(cos) + y)
        lead = root[len(cos) :]  # of each other row: the smallest own row of its tree, if it has one
        hit = lead < len(cos)
        a.append(lead[hit] + i)
        b.append(np.flatnonzero(hit))
        to = np.full(len(cos) + len(other), -1)
        to[lead[hit][::-1]] = np.flatnonzero(hit)[::-1]
        rows = np.flatnonzero(to[root[: len(cos)]] >= 0)
        a.append(rows + i)
        b.append(to[root[rows]])
    return counts, np.concatenate(a), np.concatenate(b)


def linked(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    top = F.array_max(F.transform("v", F.abs))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.element_at(F.transform(F.array(top), lambda m: F.transform("v", lambda x: x / m)), 1)))  # the largest component is 1: no square overflows or vanishes
    rows = rows.select("id", "label", "v", "ok", F.xxhash64("label", "v").alias("g1"), F.xxhash64("v", F.lit("second"), "label").alias("g2"))
    groups = saved(rows.where("ok").groupBy("g1", "g2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").cast("string").alias("label"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest = groups.groupBy("label", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    count = int(min(MAX_PIVOTS, max(1, -(-largest // CELL))))
    some = groups.orderBy("g1").select("v").limit(TRIED * count).collect()  # at most TRIED * MAX_PIVOTS vectors
    picked = spread_out([np.array(r.v) / np.linalg.norm(r.v) for r in some], count)
    pivots = spark.sparkContext.broadcast(picked)
    apart = spark.sparkContext.broadcast(distances(picked))
    sine, angle = float(np.sqrt(1 - threshold**2)), float(np.arccos(threshold))

    def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest pivot of that length, -1 without one; cosines with the pivots)"""
        same = [j for j, p in enumerate(pivots.value) if len(p) == x.shape[1]]
        cos = np.full((len(x), len(pivots.value)), -2.0)
        if same:
            cos[:, same] = np.clip(x @ np.array([pivots.value[j] for j in same]).T, -1, 1)
        return np.where(cos.max(axis=1) > -2, cos.argmax(axis=1), -1), cos

    def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, unit vectors) of each length."""
        lists = vectors.to_pylist()
        sizes = np.array(list(map(len, lists)))
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            x = np.array([lists[i] for i in rows], dtype=np.float64)
            yield rows, x / np.sqrt((x * x).sum(1))[:, None]

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least: dict[int, float] = {}
            for _, x in by_length(b.column("v")):
                home, cos = placed(x)
                for j in np.unique(home[home >= 0]).tolist():
                    least[j] = min(least.get(j, 1.0), float(cos[home == j, j].min()))
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.float64())], names=["cell", "cos"])

    far = groups.select("v").mapInArrow(farthest, "cell int, cos double").groupBy("cell").agg(F.min("cos").alias("cos")).collect()  # a row a pivot
    radius = np.full(max(len(picked), 1), -1.0)
    for r in far:
        radius[r.cell] = np.arccos(r.cos)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"row": [], "cell": [], "own": [], "v": []}
            for rows, x in by_length(b.column("v")):
                home, cos = placed(x)
                to = np.zeros(cos.shape, dtype=bool)
                if (home >= 0).all():  # a length without a pivot has one cell of its own
                    mine = cos[np.arange(len(x)), home]
                    to = (cos > -2) & (mine[:, None] - cos <= apart.value[home] * sine + SLACK) & (np.arccos(np.clip(cos, -1, 1)) <= radius + angle + SLACK)
                    to[np.arange(len(x)), home] = True
                at, cell = np.nonzero(to) if (home >= 0).all() else (np.arange(len(x)), home)
                out["row"] += rows[at].tolist()
                out["cell"] += [f"{x.shape[1]}:{j}" for j in cell.tolist()]
                out["own"] += (cell == home[at]).tolist()
                out["v"] += [x[i].tobytes() for i in at.tolist()]
            row = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("label").take(row), pa.array(out["cell"], pa.string()), pa.array(out["own"], pa.bool_()), b.column("node").take(row), b.column("n").take(row), pa.array(out["v"], pa.binary())], names=["label", "cell", "own", "node", "n", "v"])

    cells = saved(groups.select("label", "node", "n", "v").mapInArrow(spread, "label string, cell string, own boolean, node long, n long, v binary"), "cells")
    sizes = cells.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    both = cells.join(sizes, ["label", "cell"]).withColumn("part", part)
    as_other = both.select("label", "cell", F.lit(False).alias("left"), "node", "n", "v", "part", F.explode(all_parts).alias("against")).select("label", "cell", "left", "node", "n", "v", F.col("against").alias("p"), F.col("part").alias("q"))
    as_own = both.where("own").select("label", "cell", F.lit(True).alias("left"), "node", "n", "v", "part", F.explode(all_parts).alias("against")).select("label", "cell", "left", "node", "n", "v", F.col("part").alias("p"), F.col("against").alias("q"))

    def join_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = pdf[pdf.left], pdf[~pdf.left]
        if not len(own) or not len(other):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        x, y = (np.frombuffer(b"".join(f.v), dtype=np.float64).reshape(len(f), -1) for f in (own, other))
        counts, a, b = _links(x, y, other.n.to_numpy(), threshold)
        ids = np.concatenate([own.node.to_numpy(), other.node.to_numpy()])
        distinct, place = np.unique(ids, return_inverse=True)
        root = distinct[forest(len(distinct), place[a], place[len(own) + b])]
        links = np.zeros(len(distinct), dtype=np.int64)
        links[place[: len(own)]] = counts
        told = (root != distinct) | (links > 0)
        return pd.DataFrame({"node": distinct[told], "links": links[told], "root": root[told]})

    found = saved(as_own.unionAll(as_other).groupBy("label", "cell", "p", "q").applyInPandas(join_cell, "node long, links long, root long"), "links")
    dropped(cells)
    comps = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tree = groups.select("g1", "g2", "rep", "node").join(links, "node", "left").join(comps.withColumnRenamed("id", "node"), "node", "left")
    tree = saved(tree.withColumn("tree", F.coalesce("component", "node")).select("g1", "g2", "rep", "links", "tree"), "trees")
    least = saved(tree.groupBy("tree").agg(F.min("rep").alias("component")), "least")  # written first, so that adaptive execution can split a large component
    per_group = tree.join(least, "tree").select("g1", "g2", "links", "component")
    out = rows.drop("label", "v").join(per_group, ["g1", "g2"], "left")
    component = F.when(F.col("ok"), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("ok"), F.greatest(F.col("links") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op3_embedding_join(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
