"""A positional index of character trigrams for the keyword search.

``postings`` turns searched texts into posting lists: one row for each trigram and block of texts, with the texts' numbers and
the places of the trigram in them, all as differences.  ``build`` writes them as Parquet in order of trigram,
dealt out by range, so that a condition on trigrams is pushed down to the few row groups that hold these.  A task makes the
lists of about one block, and the ranges have about equal bytes, so what a task reads does not grow with the texts.
``indexed_hits`` reads only the lists that a query's tokens name, intersects them block by block, and gives the
same scores as ``search.all_hits``.

Every place of a text has a trigram; the last two are filled up with nothing, so a token of two code points
is a range of trigrams.  A longer token is there where its trigrams 0, 3, 6 ... and its last one follow each other, which
the places tell exactly; no text is read again.

A block is a range of BLOCK numbers, cut further where its texts pass BLOCK_CHARS, so a frequent trigram
has many bounded lists and no long one.  Texts are taken as ``search.chunks`` gives them; an empty text is in no
list but that of the blank between title and text; numbers must not be null and are unique, as the file order is.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import tokens
from tarn.operators.search import combined

BLOCK, BLOCK_CHARS = 4096, 1 << 22
BITS = 21  # of a code point, counted from 1; 0 is "nothing"
POSTINGS = "gram long, block long, part int, ords array<long>, counts array<int>, places array<int>"
ROW_GROUP = 1 << 20  # bytes, so that a row group holds few trigrams
SAMPLE, RANGE = 1 << 20, 64  # bytes of lists for each row of the sample that sets the ranges, and rows of it in a range


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) + 1


def grams(text: str) -> np.ndarray:
    """The trigram at each place."""
    p = np.concatenate([points(text), [0, 0]])
    return p[:-2] << 2 * BITS | p[1:-1] << BITS | p[2:]


def steps(n: int) -> list[int]:
    """Places in a token of n >= 3 code points whose trigrams cover it."""
    return sorted({*range(0, n - 2, 3), n - 3})


def bounds(token: str) -> list[tuple[int, int, int]]:
    """(place in the token, first trigram, last trigram) of the lists that tell where the token is."""
    if len(token) == 2:
        low = int(points(token)[0]) << 2 * BITS | int(points(token)[1]) << BITS
        return [(0, low, low | (1 << BITS) - 1)]
    g = grams(token)
    return [(i, int(g[i]), int(g[i])) for i in steps(len(token))]


def _lists(block: int, part: int, ords: list[int], texts: list[str]) -> pa.RecordBatch:
    g = np.concatenate([grams(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    place = np.concatenate([np.arange(len(t)) for t in texts])
    at = np.argsort(g, kind="stable")  # by trigram, then text, then place
    g, doc, place = g[at], doc[at], place[at]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new_doc = new_gram | np.concatenate([[True], doc[1:] != doc[:-1]])
    gaps = np.where(new_doc, place, np.diff(place, prepend=0)).astype(np.int32)
    first = np.flatnonzero(new_doc)
    numbers = np.array(ords, dtype=np.int64)[doc[first]]
    head = new_gram[first]
    numbers = np.where(head, numbers, np.diff(numbers, prepend=0))
    counts = np.diff(np.append(first, len(g))).astype(np.int32)
    lists = lambda values, starts, kind: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))
    gram_at, list_at = np.flatnonzero(new_gram), np.flatnonzero(head)
    n = len(gram_at)
    return pa.RecordBatch.from_arrays(
        [pa.array(g[gram_at], pa.int64()), pa.array(np.full(n, block), pa.int64()), pa.array(np.full(n, part), pa.int32()), lists(numbers, list_at, pa.int64()), lists(counts, list_at, pa.int32()), lists(gaps, gram_at, pa.int32())],
        names=["gram", "block", "part", "ords", "counts", "places"],
    )


def postings(found: DataFrame, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Posting lists of chunks (ord, title, text); one shuffle brings the texts of a block together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, now = ([], []), 0, 0, None
        for b in batches:
            for k, n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                if held[0] and (k != now or size + len(text) > block_chars):
                    yield _lists(now, part, *held)
                    part, held, size = part + 1 if k == now else 0, ([], []), 0
                elif k != now:
                    part = 0
                now = k
                held[0].append(n)
                held[1].append(text)
                size += len(text)
        if held[0]:
            yield _lists(now, part, *held)

    of = F.floor(F.col("ord") / block)
    n = max(1, found.select(of.alias("block")).distinct().count())
    texts = found.select(of.alias("block"), "ord", combined().alias("text"))
    return texts.repartitionById(n, F.pmod("block", F.lit(n)).cast("int")).sortWithinPartitions("block", "ord").mapInArrow(run, POSTINGS)


def _edges(lists: DataFrame, sample: int = SAMPLE, size: int = RANGE) -> list[tuple[int, int]]:
    """(trigram, block) where ranges of about ``sample`` * ``size`` bytes begin, from a sample of rows by their bytes; every row is in a range."""
    share = (4 * F.size("places") + 12 * F.size("ords") + 32) / F.lit(sample)
    times = F.array_repeat(F.lit(0), F.floor(share + F.rand(0)).cast("int"))
    some = lists.select("gram", "block", F.explode(times)).select("gram", "block").toPandas()
    return sorted(set(sorted(zip(some["gram"].tolist(), some["block"].tolist(), strict=True))[size::size]))


def _in_ranges(lists: DataFrame, edges: list[tuple[int, int]]) -> DataFrame:
    """Lists dealt out by range."""
    edges = lists.sparkSession.sparkContext.broadcast(edges)

    @F.pandas_udf("int")
    def number(gram: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(edges.value, x) for x in zip(gram.tolist(), block.tolist(), strict=True)], dtype=np.int32)

    return lists.repartitionById(len(edges.value) + 1, number("gram", "block"))


def build(found: DataFrame, path: str, **sizes: int) -> None:
    """Writes the index of chunks to ``path``, in order of trigram; a frequent trigram's blocks spread over files."""
    lists = postings(found, **sizes).persist(StorageLevel.DISK_ONLY)  # the ranges come from a sample, which would make all lists twice
    try:
        _in_ranges(lists, _edges(lists)).sortWithinPartitions("gram", "block", "part").write.mode("errorifexists").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        lists.unpersist()


def _wanted(queries: list[str]) -> Column:
    """Ranges, not a list of values: Spark pushes a long list down as its least and largest value only."""
    out = F.lit(False)
    for low, high in sorted({x[1:] for w in queries for x in bounds(w)}):
        out = out | F.col("gram").between(low, high)
    return out


def _placed(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts, places) of all rows, sorted."""
    numbers, places = [], []
    for r in lists.itertuples():
        counts = np.asarray(r.counts)
        gaps = np.asarray(r.places, dtype=np.int64)
        total = np.cumsum(gaps)
        first = np.cumsum(counts) - counts
        places.append(total - np.repeat(total[first] - gaps[first], counts))
        numbers.append(np.repeat(np.cumsum(np.asarray(r.ords)), counts))
    if not numbers:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    n, p = np.concatenate(numbers), np.concatenate(places)
    at = np.lexsort((p, n))
    return n[at], p[at]


def texts_with(token: str, lists: pd.DataFrame) -> np.ndarray:
    """Numbers of a block's texts that contain the token."""
    found = None
    for i, low, high in bounds(token):
        n, p = _placed(lists[(lists.gram >= low) & (lists.gram <= high)])
        here = pd.MultiIndex.from_arrays([n, p - i])
        found = here if found is None else found[found.isin(here)]
        if not len(found):
            break
    return np.unique(found.get_level_values(0).to_numpy())


def indexed_hits(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(ord, score) of every text with a score above 0: repeats of a token count; a query without tokens hits nothing."""
    words = tokens(query)

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        got = [texts_with(w, lists) for w in words]
        n, score = np.unique(np.concatenate(got), return_counts=True)
        return pd.DataFrame({"ord": n, "score": score.astype(np.int32)})

    index = spark.read.parquet(path)
    if not words:
        return index.select(F.col("block").alias("ord"), F.lit(0).alias("score")).where(F.lit(False))
    return index.where(_wanted(words)).groupBy("block", "part").applyInPandas(run, "ord long, score int")


def indexed_search(spark: SparkSession, path: str, found: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """The best hits with their columns, as ``search.search``; only ``limit`` rows of the index meet the texts."""
    best = indexed_hits(spark, path, query).orderBy(F.desc("score"), F.asc("ord")).limit(limit)
    return found.join(F.broadcast(best), "ord").select("score", *found.columns).orderBy(F.desc("score"), F.asc("ord"))  # at most limit rows
