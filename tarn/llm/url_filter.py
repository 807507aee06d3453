"""URL filters by a Bloom filter cascade.

A rule is a key ``host + path`` (``net/``, ``example.net/en/``).  A url fits the
keys made of a suffix of its host (whole labels) and a prefix of its path; it
is enough to try the (labels, path length) shapes that rules have.  The keys
that the whole corpus can ask for are the key universe.  Level 1 encodes the
listed keys; level 2 those of the universe that level 1 takes for listed but
are not; level 3 the listed keys that level 2 takes; and so on until no false
positive is left.  Over that universe membership is then exact, and judging a
url needs no join: it tests its few keys in the filters.

The filters' bits grow with the list, not with the corpus.  Their size is
checked: over MAX_BITS the keys are joined with the list instead, with equal
results.

A null url, or one without ``://``, has an empty host and path and fits no
rule.  Repeated rows get equal verdicts; an empty table or an empty list gives
no rule anywhere.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import dropped, saved

MAX_BITS = 1 << 28
MAX_LEVELS = 40
FIRST_RATE, RATE = 0.01, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(url, F.lit(""))
    whole = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, whole, 1), UPPER, LOWER), F.regexp_extract(rest, whole, 2)


def shapes(rules: list[str]) -> list[tuple[int, int]]:
    """(labels, path length) of the rules, longest keys first."""
    cut = [(r.split("/", 1)[0], r[len(r.split("/", 1)[0]) :]) for r in rules]
    return sorted({(h.count(".") + 1, len(p)) for h, p in cut})


def keys(host: Column, path: Column, of: list[tuple[int, int]]) -> Column:
    """array<string> of the keys of these shapes that a url fits."""
    made = [F.when((F.length(path) >= n) & (host != ""), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n))) for labels, n in of]
    return F.array_distinct(F.array_compact(F.array(*made))) if made else F.array().cast("array<string>")


class Cascade:
    """Levels of (bits, hashes); a key is two 64-bit hashes."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, int, int]] = []

    @property
    def bits(self) -> int:
        return sum(m for _, m, _ in self.levels)

    @staticmethod
    def _places(h1: np.ndarray, h2: np.ndarray, m: int, k: int, level: int) -> np.ndarray:
        a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
        with np.errstate(over="ignore"):
            i = np.arange(k, dtype=np.uint64) + np.uint64(1 + level * 131)
            x = a[:, None] * np.uint64(2 * level + 1) + b[:, None] * i[None, :]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
        return (x % np.uint64(m)).astype(np.int64)

    def add(self, h1: np.ndarray, h2: np.ndarray, rate: float) -> None:
        n = max(len(h1), 1)
        m, k = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)), max(1, round(-math.log2(rate)))
        bits = np.zeros(m, dtype=bool)
        bits[self._places(h1, h2, m, k, len(self.levels)).ravel()] = True
        self.levels.append((np.packbits(bits), m, k))

    def passed(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        packed, m, k = self.levels[level]
        at = self._places(h1, h2, m, k, level)
        return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The first level that a key fails decides: an odd one says it isn't listed."""
        inside, out = np.ones(len(h1), dtype=bool), np.zeros(len(h1), dtype=bool)
        for level in range(len(self.levels)):
            ok = self.passed(h1, h2, level)
            out[inside & ~ok] = level % 2 == 1
            inside &= ok
        out[inside] = len(self.levels) % 2 == 1
        return out


def _hashed(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(c, F.lit("second")).alias("h2")]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("h1").to_numpy(), batch.column("h2").to_numpy()


def build(universe: DataFrame, listed: DataFrame, bound: int = MAX_BITS) -> Cascade | None:
    """The cascade for ``listed`` keys (h1, h2) over ``universe`` (h1, h2, unlisted keys too); None if it would pass the bound.

    What is collected are the listed keys, and the false positives of a level: about FIRST_RATE
    of the universe at most, with the first rate set so that they are no more than the listed keys.
    """
    spark = universe.sparkSession
    n = listed.count()
    total = universe.count()
    rate = min(FIRST_RATE, max(n, 1) / max(total, 1) / 2)
    if n * -math.log(rate) / math.log(2) ** 2 > bound / 4:
        return None
    inside = np.array(listed.distinct().collect(), dtype=np.int64).reshape(-1, 2)  # checked above
    out, cascade = Cascade(), None
    out.add(inside[:, 0], inside[:, 1], rate)
    outside = None
    for level in range(MAX_LEVELS):
        if level == 0:
            cascade = spark.sparkContext.broadcast(out)

            def falsely(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in it:
                    yield b.filter(pa.array(cascade.value.passed(*_columns(b), 0)))

            hit = universe.mapInArrow(falsely, universe.schema).distinct()
            rows = np.array(hit.limit(8 * n + 10_001).collect(), dtype=np.int64).reshape(-1, 2)
            if len(rows) > 8 * n + 10_000:
                return None
            known = set(map(tuple, inside.tolist()))
            outside = np.array([r for r in rows.tolist() if tuple(r) not in known], dtype=np.int64).reshape(-1, 2)
            wrong = outside
        else:
            other = outside if level % 2 == 0 else inside  # what this level encodes is judged against the other side
            wrong = other[out.passed(other[:, 0], other[:, 1], level)] if len(other) else other
            if level % 2 == 0:
                outside = wrong
            else:
                inside = wrong
        if not len(wrong):
            return out
        out.add(wrong[:, 0], wrong[:, 1], RATE)
    raise RuntimeError("the cascade did not end: keys with equal hashes")


def filter_urls(pages: DataFrame, rules: dict[str, str], default: str = "allow", url_col: str = "url", bound: int = MAX_BITS) -> DataFrame:
    """Adds host, path, rule and verdict; rules maps a key to ``block`` or ``allow``, and the longest that fits wins."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    mine = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    row = F.struct(*[F.col(f"`{c}`") for c in mine])
    base = pages.select(row.alias("row"), host.alias("host"), path.alias("path")).withColumn("keys", keys(F.col("host"), F.col("path"), shapes(list(rules))))
    if not rules:
        return base.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    asked = saved(base.select(F.explode("keys").alias("k")).distinct().select(*_hashed(F.col("k"))), "universe")
    cascade = build(asked, rows.select(*_hashed(F.col("rule"))), bound)
    blocked = build(rows.select(*_hashed(F.col("rule"))), rows.where("verdict = 'block'").select(*_hashed(F.col("rule"))), bound)
    dropped(asked)
    by_length = F.array_sort(F.transform("keys", lambda k: F.struct((-F.length(k)).alias("o"), k.alias("k"))))
    if cascade is None or blocked is None:  # the other way, for lists too long to broadcast
        tries = base.withColumn("id", F.monotonically_increasing_id()).select("row", "host", "path", "id", F.explode_outer("keys").alias("rule"))
        best = tries.join(rows, "rule", "left").groupBy("id").agg(F.first(F.struct("row", "host", "path")).alias("page"), F.max_by(F.struct("rule", "verdict"), F.when(F.col("verdict").isNotNull(), F.length("rule"))).alias("x"))
        return best.select("page.row.*", "page.host", "page.path", F.col("x.rule").alias("rule"), F.coalesce("x.verdict", F.lit(default)).alias("verdict"))
    held = spark.sparkContext.broadcast((cascade, blocked))

    @F.pandas_udf("struct<at:int,block:boolean>")
    def first_listed(h1, h2):
        import pandas as pd

        inner, actions = held.value
        sizes = h1.map(len).to_numpy()
        flat1, flat2 = (np.concatenate([*h.to_numpy(), np.zeros(0, dtype=np.int64)]).astype(np.int64) for h in (h1, h2))
        ok = inner.listed(flat1, flat2) if len(flat1) else np.zeros(0, dtype=bool)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at, block = np.full(len(sizes), -1, dtype=np.int32), np.zeros(len(sizes), dtype=bool)
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        found = np.flatnonzero(ok)
        who, first = np.unique(row[found], return_index=True)
        place = found[first]
        at[who] = place - start[who]
        if len(place):
            block[who] = actions.listed(flat1[place], flat2[place])
        return pd.DataFrame({"at": at, "block": block})

    tried = base.withColumn("keys", F.transform(by_length, lambda x: x["k"]))
    tried = tried.withColumn("found", first_listed(F.transform("keys", lambda k: F.xxhash64(k)), F.transform("keys", lambda k: F.xxhash64(k, F.lit("second")))))
    rule = F.when(F.col("found.at") >= 0, F.get("keys", F.col("found.at")))
    return tried.select("row.*", "host", "path", rule.alias("rule"), F.when(rule.isNull(), default).when(F.col("found.block"), "block").otherwise("allow").alias("verdict"))


# The rules of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, p, action)),
f AS (SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(action, length(h || r.p)) AS action FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
"""
