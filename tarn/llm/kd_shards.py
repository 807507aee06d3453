"""Sharding by a k-d tree over metadata, native.

Documents with equal texts form one group, which is never split.  A group has
its total bytes as weight and its smallest metadata as coordinates.  Starting
with all groups, each node is split along its widest dimension (its range over
that of the whole table) at the weighted median, or at the weighted quantile
where its leaves do not halve, until every node is a leaf.  Medians come from
distributed histograms of at most BINS bins a node, narrowed until the cut is
exact; equal coordinates are split by a hash of the text.  The group that the cut falls in goes to the side that this leaves nearer to its target.  The driver sees
those bins only.

Null text counts as empty; missing or null metadata counts as 0; repeated rows
are rows of their own (equal rows get different slots); an empty table gives
an empty result; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.shared import dropped, saved, text_or_empty

BINS = 4096
OVERHEAD = 16
TIE_SPACE = BINS * BINS  # two passes; a shard holds many of its values at any size
SPACE = 1 << 61
#: A cut is exact enough once the bin it lies in holds this part of a shard.
TOLERANCE = 0.0002


def _coordinate(df: DataFrame, name: str) -> Column:
    """A long whose differences are longs too: numbers as they are, other values as a hash."""
    if isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
        number = F.col(name).try_cast("long")
        return F.coalesce(F.least(F.greatest(number, F.lit(-SPACE)), F.lit(SPACE)), F.lit(0))
    return F.coalesce(F.pmod(F.xxhash64(F.col(name)), F.lit(1 << 20)), F.lit(0).cast("long"))


def _by_node(values: dict[int, int]) -> Column:
    """The value of the node that a group is in now, null where it has none."""
    known = [f"{values[i]}L" if i in values else "null" for i in range(max(values) + 1)]
    return F.get(F.expr(f"array({', '.join(known)})"), F.col("node"))


def _on_axis(dims: list[str], axis: dict[int, int]) -> Column:
    """The coordinate along the axis of the group's node."""
    here = _by_node(axis)
    return F.coalesce(*[F.when(here == k, F.col(d)) for k, d in enumerate(dims)])


def _narrow(frame: DataFrame, value: Column, state: dict[int, dict]) -> None:
    """Narrows [lo, hi] of each node in state until one value, or a range that is light enough, holds the quantile."""
    while open_ := {i: s for i, s in state.items() if s["hi"] > s["lo"] and s["mass"] > s["tolerance"]}:
        for s in open_.values():
            s["width"] = -(-(s["hi"] - s["lo"] + 1) // BINS)
        lo, hi, width = (_by_node({i: s[k] for i, s in open_.items()}) for k in ("lo", "hi", "width"))
        # No filter: pushed below the projections, it would hold their expressions many times over.
        near = frame.select("node", "w", value.alias("value"), lo.alias("lo"), hi.alias("hi"), width.alias("width"))
        bin_ = F.when(F.col("value").between(F.col("lo"), F.col("hi")), F.expr("(value - lo) div width"))
        bins = near.select("node", "w", bin_.alias("bin")).groupBy("node", "bin").agg(F.sum("w").alias("w"))
        found: dict[int, list[tuple[int, int]]] = {i: [] for i in open_}
        for node, k, w in bins.collect():  # at most BINS a node
            if k is not None:
                found[node].append((k, w))
        for i, s in open_.items():
            below = s["below"]
            for k, w in sorted(found[i]):
                if below + w >= s["target"]:
                    lo_k = s["lo"] + k * s["width"]
                    s |= {"lo": lo_k, "hi": min(s["hi"], lo_k + s["width"] - 1), "below": below, "mass": w}
                    break
                below += w
            else:
                s |= {"lo": s["hi"], "below": below, "mass": 0}


def _cut(s: dict) -> int:
    """The last value of the left side: what holds the quantile goes to the side that this leaves nearer to its target."""
    over, under = s["below"] + s["mass"] - s["target"], s["target"] - s["below"]
    return s["lo"] - 1 if s["below"] and over > under else s["hi"]


def kd_tree(groups: DataFrame, dims: list[str], n_shards: int) -> DataFrame:
    """The groups (w, tie and the dimensions, all long) with their ``shard``.

    Nodes are numbered as in a heap: i has the children 2i + 1 and 2i + 2.  A
    level adds one projection, which looks the cut up by node, so the plan
    grows with the depth of the tree and not with its size.
    """
    leaves, first = {0: n_shards}, {0: 0}
    frame = groups.withColumn("node", F.lit(0))
    span: list[int] = []
    while active := [i for i, n in leaves.items() if n > 1]:
        cols = [f(d) for d in dims for f in (F.min, F.max)]
        stats = {r[0]: r[1:] for r in frame.groupBy("node").agg(F.sum("w"), *cols).collect()}  # a row a node
        state: dict[int, dict] = {}
        for i in (i for i in active if i in stats):
            w, bounds = stats[i][0], stats[i][1:]
            wide = [bounds[2 * k + 1] - bounds[2 * k] for k in range(len(dims))]
            span = span or [max(1, x) for x in wide]
            axis = max(range(len(dims)), key=lambda k: wide[k] / span[k])
            state[i] = {"axis": axis, "lo": bounds[2 * axis], "hi": bounds[2 * axis + 1], "below": 0, "mass": w, "target": w * (leaves[i] // 2) / leaves[i], "tolerance": w / leaves[i] * TOLERANCE}
        if state:
            along = _on_axis(dims, {i: s["axis"] for i, s in state.items()})
            _narrow(frame, along, state)
            one = {i: s for i, s in state.items() if s["hi"] == s["lo"]}
            cut, tie = {i: s["hi"] if i in one else _cut(s) for i, s in state.items()}, dict.fromkeys(state, TIE_SPACE)
            if one:  # one value holds the quantile: split it by hash
                for s in one.values():
                    s |= {"lo": 0, "hi": TIE_SPACE - 1}
                _narrow(frame, F.when(along == _by_node({i: cut[i] for i in one}), F.col("tie")), one)
                tie |= {i: _cut(s) for i, s in one.items()}
            at = _by_node(cut)
            left = (along < at) | ((along == at) & (F.col("tie") <= _by_node(tie)))
            child = F.when(left, F.col("node") * 2 + 1).otherwise(F.col("node") * 2 + 2)
            frame = frame.withColumn("node", F.when(at.isNull(), F.col("node")).otherwise(child))
        for i in active:
            half, n, start = leaves[i] // 2, leaves.pop(i), first.pop(i)
            if i in stats:  # else no group comes here
                leaves |= {2 * i + 1: half, 2 * i + 2: n - half}
                first |= {2 * i + 1: start, 2 * i + 2: start + half}
    return frame.withColumn("shard", _by_node(first or {0: 0}).cast("int")).drop("node")


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", metadata: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """id, size, text_crc32, shard, slot: slots are gapless from 0 in each shard."""
    text = text_or_empty()
    dims = [m for m in metadata if m in docs.columns]
    thin = saved(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("g1"), F.xxhash64(text, F.lit("second")).alias("g2"), *[_coordinate(docs, m).alias(f"m_{m}") for m in dims],
        ),
        "thin",
    )
    groups = thin.groupBy("g1", "g2").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.min("id").alias("m_first"), *[F.min(f"m_{m}").alias(f"m_{m}") for m in dims])
    numeric_id = isinstance(thin.schema["id"].dataType, T.IntegralType)
    groups = saved(groups.withColumn("m_first", F.coalesce(F.col("m_first") if numeric_id else F.lit(0), F.lit(0)).cast("long")).withColumn("tie", F.pmod("g1", F.lit(TIE_SPACE))), "groups")
    located = kd_tree(groups, [f"m_{m}" for m in dims] + ["m_first"], n_shards).select("g1", "g2", "shard")
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    subs = max(64, rows // (n_shards * 5000))
    sub = F.pmod(F.xxhash64("id", "crc"), F.lit(subs)).cast("int")
    placed = saved(thin.join(located, ["g1", "g2"]).select("id", "size", F.col("crc").alias("text_crc32"), "shard", sub.alias("sub")), "placed")
    dropped(thin, groups)
    # Slots: a count for each part of a shard, its running sum, and a number within the part.
    counts = placed.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "sub", F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("id", "text_crc32", "size"))
    return placed.withColumn("k", number - 1).join(starts, ["shard", "sub"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("k")).cast("long").alias("slot"))


def op10_kd_shards(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
