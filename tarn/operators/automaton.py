"""Many keywords looked for in one pass: an automaton over all of them.

Keywords form a trie whose nodes know where to go on each character, failure links being worked into the
table, so a text is read once whatever the number of keywords.  Texts are cut into stretches which overlap by the longest
keyword, and all stretches of a batch advance together, a character at a time.

The automaton is built in Spark, in shards: keywords are dealt out by hash so that a shard has about SHARD_CHARS
characters, and each shard's table is made in a task.  Only the finished tables, whose size the shards bound, are broadcast; the
keywords never form a list on the driver. A shard's table has at most its characters + 1 rows and as many
columns as it has different characters; where that would pass CELLS, the shard is split.  An automaton serves one shard;
more keywords than that go into ``keyword_tables``, so that texts are not read once for each 20000 words.

Keywords longer than DEPTH code points enter the automaton with their first DEPTH, and the texts that
have these are tested for the whole. Null and empty keywords are found nowhere; null texts hold nothing.
"""

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators import keyword_tables

DEPTH = 64  # code points of a keyword that the automaton knows
STRETCH = 2048  # characters that a stretch adds to the overlap
SHARD_CHARS, CELLS = 200_000, 1 << 24  # of the keywords of a shard; of a table, 4 bytes each
BATCH_CHARS = 1 << 21  # of text read together
TABLE = "shard long, n int, alphabet binary, go binary, word binary, link binary"


class Automaton:
    """Tables of a set of keywords: ``go`` (node, class of character) -> node, ``word`` the keyword that ends at a node or -1, ``link`` the next node with one."""

    def __init__(self, alphabet: np.ndarray, go: np.ndarray, word: np.ndarray, link: np.ndarray):
        self.alphabet, self.go, self.word, self.link = alphabet, go, word, link
        self.ends = (word >= 0) | (link > 0)
        low = np.full(0x110000, 0, dtype=np.int32)  # class 0: not in any keyword
        low[alphabet] = np.arange(1, len(alphabet) + 1)
        self.classes = low

    @classmethod
    def of(cls, words: list[str]) -> "Automaton":
        """Of different keywords of at most DEPTH code points, none empty; keyword i is words[i]."""
        pts = [np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) for w in words]
        alphabet = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *pts]))
        width = len(alphabet) + 1
        at = np.zeros(len(words), dtype=np.int64)  # the node that each keyword has come to
        size = np.array([len(p) for p in pts], dtype=np.int64)
        matrix = np.zeros((len(words), int(size.max()) if len(words) else 0), dtype=np.int64)
        for i, p in enumerate(pts):
            matrix[i, : len(p)] = np.searchsorted(alphabet, p) + 1
        nodes, levels = 1, []  # of each level: parents, classes, nodes
        word_end = {}
        for d in range(matrix.shape[1]):
            live = np.flatnonzero(size > d)
            step, back = np.unique(at[live] * width + matrix[live, d], return_inverse=True)
            new = nodes + np.arange(len(step))
            levels.append((step // width, step % width, new))
            at[live] = new[back]
            nodes += len(step)
            for i in np.flatnonzero(size == d + 1):
                word_end[int(at[i])] = i
        go, fail = np.zeros((nodes, width), dtype=np.int32), np.zeros(nodes, dtype=np.int32)
        word, link = np.full(nodes, -1, dtype=np.int32), np.zeros(nodes, dtype=np.int32)
        for node, i in word_end.items():
            word[node] = i
        for d, (parent, kind, node) in enumerate(levels):
            if d:
                fail[node] = go[fail[parent], kind]
            go[parent, kind] = node
            go[node] = go[fail[node]]  # the row of a shallower node, complete by now; own children go into it next
            link[node] = np.where(word[fail[node]] >= 0, fail[node], link[fail[node]])
        return cls(alphabet, go, word, link)

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, keyword): each pair once."""
        depth = DEPTH - 1
        rows, spans = [], []
        for i, t in enumerate(texts):
            p = self.classes[np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)]
            for begin in range(0, max(len(p), 1), STRETCH):
                rows.append(i)
                spans.append(p[max(0, begin - depth) : begin + STRETCH])
        order = np.argsort([-len(s) for s in spans], kind="stable")
        sizes = np.array([len(spans[i]) for i in order], dtype=np.int64)
        of = np.array(rows, dtype=np.int64)[order]
        matrix = np.zeros((len(spans), int(sizes[0]) if len(sizes) else 0), dtype=np.int32)
        for k, i in enumerate(order):
            matrix[k, : sizes[k]] = spans[i]
        matrix = np.ascontiguousarray(matrix.T)
        node, seen, kept = np.zeros(len(spans), dtype=np.int32), [], 0
        live = np.searchsorted(-sizes, -np.arange(matrix.shape[0]), side="left")  # stretches longer than each step
        for d in range(matrix.shape[0]):
            n = live[d]
            node[:n] = self.go[node[:n], matrix[d, :n]]
            hit = np.flatnonzero(self.ends[node[:n]])
            if len(hit):
                seen.append(of[hit] * len(self.word) + node[hit])
                kept += len(hit)
                if kept > 1 << 22:
                    seen = [np.unique(np.concatenate(seen))]
                    kept = len(seen[0])
        pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *seen]))
        text, node, out = pairs // len(self.word), pairs % len(self.word), []
        while len(node):
            has = self.word[node] >= 0
            out.append(text[has] * len(self.word) + self.word[node[has]])
            node = self.link[node]
            text, node = text[node > 0], node[node > 0]
        pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *out]))
        return pairs // len(self.word), pairs % len(self.word)


def _shards(words: DataFrame, chars: int) -> DataFrame:
    """(w, head, shard, number): keywords with their shard and their number in it; the number of shards follows from their characters."""
    heads = words.where((F.col("w").isNotNull()) & (F.col("w") != "")).select("w").distinct().withColumn("head", F.substring("w", 1, DEPTH))
    size = heads.agg(F.coalesce(F.sum(F.length("head")), F.lit(0)).alias("chars")).first()["chars"]
    shard = F.pmod(F.xxhash64("head"), F.lit(int(size // chars) + 1))
    return heads.withColumn("shard", shard).withColumn("number", F.dense_rank().over(Window.partitionBy("shard").orderBy("head")) - 1)


def _tables(shards: DataFrame) -> DataFrame:
    """A row for each table of TABLE; a shard whose table would be too large becomes several."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf[["number", "head"]].drop_duplicates("number").sort_values("number")
        out, waiting = [], [(0, heads["head"].tolist())]
        while waiting:
            first, words = waiting.pop()
            chars, kinds = sum(map(len, words)) + 1, len(set("".join(words))) + 1
            if chars * kinds > CELLS and len(words) > 1:
                half = len(words) // 2
                waiting += [(first, words[:half]), (first + half, words[half:])]
                continue
            a = Automaton.of(words)
            out.append((int(pdf["shard"].iloc[0]), first, a.alphabet.astype(np.int32).tobytes(), a.go.tobytes(), a.word.tobytes(), a.link.tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TABLE.split(", ")])

    return shards.groupBy("shard").applyInPandas(run, TABLE)


def _loaded(row) -> tuple[int, Automaton]:
    alphabet, word, link = (np.frombuffer(row[k], dtype=np.int32) for k in ("alphabet", "word", "link"))
    return row["n"], Automaton(alphabet.astype(np.int64), np.frombuffer(row["go"], dtype=np.int32).reshape(len(word), -1), word, link)


def _looked_for(words: DataFrame, shard_chars: int, table_chars: int) -> tuple[DataFrame, Iterator[tuple[int, Broadcast, Callable]]]:
    """(w, shard, number), and (shard, broadcast, function that loads something with ``found`` from its value) one after the other."""
    kept = words.where("w IS NOT NULL AND w <> ''").select("w").distinct()
    chars = kept.agg(F.coalesce(F.sum(F.length("w")), F.lit(0)).alias("c")).first()["c"]
    if chars >= shard_chars:
        shards = keyword_tables.numbered(kept, table_chars)
        return shards, ((s, b, lambda x: (0, pickle.loads(x).ready())) for s, b in keyword_tables.tables(shards))
    shards, spark = _shards(words, shard_chars), words.sparkSession
    rows = _tables(shards).toLocalIterator()  # one table of at most CELLS cells at a time
    return shards, ((r["shard"], spark.sparkContext.broadcast({k: r[k] for k in ("n", "alphabet", "go", "word", "link")}), _loaded) for r in rows)


def _pairs(texts: DataFrame, text_col: str, table: Broadcast, load: Callable, counted: int | None, id_col: str | None, shard: int, schema: str) -> DataFrame:
    """What a table finds: pairs (id, shard, number), or with ``counted`` (shard, number, n), a row for each number and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, a = load(table.value)
        sums = np.zeros(counted or 0, dtype=np.int64)
        for b in batches:
            for at, some in keyword_tables.slices(b.column(b.num_columns - 1), BATCH_CHARS):
                t, w = a.found(some)
                if counted is not None:
                    sums += np.bincount(w + first, minlength=counted)
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t + at)), pa.array(np.full(len(w), shard), pa.int64()), pa.array(w + first, pa.int32())], names=[id_col, "shard", "number"])
        if counted is not None:
            seen = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), shard), pa.int64()), pa.array(seen, pa.int32()), pa.array(sums[seen], pa.int64())], names=["shard", "number", "n"])

    return texts.select(*[id_col] * (id_col is not None), text_col).mapInArrow(run, schema)


def contained(texts: DataFrame, words: DataFrame, id_col: str = "ord", text_col: str = "text", shard_chars: int = SHARD_CHARS, table_chars: int = keyword_tables.TABLE_CHARS) -> DataFrame:
    """(id, w): every keyword (w) that a text contains, once."""
    shards, those = _looked_for(words, shard_chars, table_chars)
    kind = texts.schema[id_col].dataType.simpleString()
    parts = [_pairs(texts, text_col, table, load, None, id_col, shard, f"`{id_col}` {kind}, shard long, number int") for shard, table, load in those]
    if not parts:
        return texts.select(id_col, F.lit("").alias("w")).where(F.lit(False))
    found = reduce(DataFrame.unionAll, parts).join(shards, ["shard", "number"])
    if "head" not in shards.columns:  # whole keywords were looked for
        return found.select(id_col, "w")
    found, long = found.select(id_col, "w"), F.length("w") > DEPTH
    checked = found.where(long).join(texts.select(id_col, text_col), id_col).where(F.contains(text_col, F.col("w"))).select(id_col, "w")
    return found.where(~long).unionAll(checked)


def counted(texts: DataFrame, words: DataFrame, text_col: str = "text", table_chars: int = keyword_tables.TABLE_CHARS) -> DataFrame:
    """(w, n): in how many texts each keyword is, without those that are in none; tasks count, so pairs of texts and keywords are never rows."""
    shards, those = _looked_for(words, 0, table_chars)
    sizes = {r["shard"]: r["c"] for r in shards.groupBy("shard").agg(F.count("*").alias("c")).collect()}  # a number for each table
    parts = [_pairs(texts, text_col, table, load, sizes[shard], None, shard, "shard long, number int, n long") for shard, table, load in those]
    if not parts:
        return texts.select(F.lit("").alias("w"), F.lit(0).cast("long").alias("n")).where(F.lit(False))
    return reduce(DataFrame.unionAll, parts).groupBy("shard", "number").agg(F.sum("n").alias("n")).join(shards, ["shard", "number"]).select("w", "n")


def routed(questions: DataFrame, routes, id_col: str = "q_id", text_col: str = "question") -> DataFrame:
    """(id, route): the router of ``answers.route_col`` with all keywords looked for at once; for route tables of any size."""
    spark = questions.sparkSession
    rank = spark.createDataFrame([(w, i, name) for i, (name, words) in enumerate(routes) for w in words], "w string, priority int, route string")
    lowered = questions.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    met = contained(lowered, rank.select("w"), id_col).join(rank, "w").groupBy(id_col).agg(F.min(F.struct("priority", "route")).alias("x"))
    return questions.select(id_col).join(met, id_col, "left").select(id_col, F.coalesce("x.route", F.lit("default")).alias("route"))
