"""Very many keywords looked for in one pass: tables of hashes, one for each length.

A text's code points are hashed at every place, a code point longer with each step, so a step costs the same whatever the
number of keywords; where a length has keywords, places whose hash passes that length's filter are looked up
and compared code point by code point, so a hash never decides.  A table has at most TABLE_CHARS code points of keywords, and texts are
read once for each table: one reading for some two million keywords, and as many steps as the longest keyword has code points,
DEPTH at the most.  Of longer keywords the first DEPTH code points are looked for, and the texts that have these are tested for the whole.

``scored`` ranks texts for many questions.  A task turns its texts into blocks of posting lists, bits for frequent words and places
for others, cut into rows of about PART bytes.  Another task then holds a chunk of questions and lets the blocks of a range go by in batches, and
searches TOGETHER texts at once.  Frequent words alone give a text no more than their number, so where a question's best score so far is larger,
only texts in so many lists of its other words are scored (MaxScore, exact).  Only texts that may still be among the best leave a task, so
pairs of questions and texts are never rows.  The work is the product of questions and texts by nature; a task holds a chunk
and some blocks, whatever the sizes, and blocks are copied for each chunk, questions for each range only.
"""

import contextlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.sources.catalog import scratch_dir

DEPTH = 64  # code points that are hashed
TABLE_CHARS = 1 << 24  # of the keywords of a table, 4 bytes each
BATCH_CHARS = 1 << 17  # of text hashed together, so that its arrays stay in a core's cache
LEAST = 256  # what a text counts at least in a batch
FILTER = 16  # places of a filter for each keyword
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
BLOCK_TEXTS, BLOCK_PAIRS = 1 << 15, 1 << 23  # of a block
PART = 1 << 18  # bytes of lists in a row
OFTEN = 16  # a word in more than one of so many texts has bits instead of places
ROW_GROUP = 1 << 24  # bytes of a row group, since a reader holds one
BATCH_BYTES = 1 << 22  # of texts that go to a worker at once
CHUNK = 1 << 23  # tokens of a chunk of questions
RANGE = 8  # blocks of a range, unless there would be too few tasks
SOME, LISTED = 1 << 12, 1 << 19  # questions whose best texts leave together, and places of their lists
ROW = 64  # a word in more than one of so many texts may have a row of bits
DENSE = 1 << 25  # bytes of the rows of the tokens asked most
TOGETHER, PLACES = 1 << 16, 1 << 24  # texts, and places in lists, of the blocks that are searched together


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def slices(column: pa.Array, chars: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of about ``chars`` bytes, nulls as empty; a batch is never a list as a whole."""
    ends = np.cumsum(np.maximum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), LEAST))
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + chars, side="right")))
        yield first, column.slice(first, last - first).fill_null("").to_pylist()
        first = last


class Tables:
    """Keywords by length: the sorted hashes, code points and numbers of those of each length."""

    def __init__(self, words: list[str], numbers: list[int]):
        """Different keywords, none empty."""
        heads: dict[str, list[tuple[str, int]]] = {}
        for w, n in zip(words, numbers, strict=True):
            if len(w) > DEPTH:
                heads.setdefault(w[:DEPTH], []).append((w, n))
        # a head has a number below 0, unless it is a keyword itself
        short = {w: n for w, n in zip(words, numbers, strict=True) if len(w) <= DEPTH}
        self.long = {}
        for i, (head, those) in enumerate(heads.items()):
            number = short.setdefault(head, -1 - i)
            self.long[number] = those
        by: dict[int, list[str]] = {}
        for w in short:
            by.setdefault(len(w), []).append(w)
        self.lengths = {}
        for size, those in by.items():
            codes = points("".join(those)).reshape(-1, size)
            for base in BASES:
                h = self.hashes(codes, np.uint64(base))
                at = np.argsort(h)
                if (np.diff(h[at]) > 0).all():
                    break
            else:
                raise ValueError("equal hashes of different keywords")
            self.lengths[size] = (base, h[at], codes[at], np.array([short[w] for w in those], dtype=np.int64)[at])

    @staticmethod
    def hashes(codes: np.ndarray, base: np.uint64) -> np.ndarray:
        h = np.zeros(len(codes), dtype=np.uint64)
        for j in range(codes.shape[1]):
            h = h * base + codes[:, j].astype(np.uint64)
        return h

    def ready(self) -> "Tables":
        """With filters, which are made where they are used."""
        self.filters = {}
        for size, (_, h, *_) in self.lengths.items():
            bits = max(10, (FILTER * len(h) - 1).bit_length())
            shift = np.uint64(64 - bits)
            there = np.zeros(1 << bits, dtype=bool)
            there[((h * GOLD) >> shift).astype(np.int64)] = True
            self.filters[size] = (shift, there)
        return self

    def _here(self, c: np.ndarray, of: np.ndarray, end: np.ndarray, texts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wide = c.astype(np.uint64)
        for base in {x[0] for x in self.lengths.values()}:
            top = max(s for s, x in self.lengths.items() if x[0] == base)
            h = np.zeros(len(c), dtype=np.uint64)
            for size in range(1, min(top, len(c)) + 1):
                h = h[: len(c) - size + 1]
                h *= np.uint64(base)
                h += wide[size - 1 :]
                if size not in self.lengths or self.lengths[size][0] != base:
                    continue
                _, hashes, codes, numbers = self.lengths[size]
                shift, there = self.filters[size]
                place = h * GOLD
                place >>= shift
                at = np.flatnonzero(there[place.view(np.int64)])
                at = at[at + size <= end[at]]
                k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                same = hashes[k] == h[at]
                at, k = at[same], k[same]
                for j in range(size):
                    same = codes[k, j] == c[at + j]
                    if not same.all():
                        at, k = at[same], k[same]
                pairs = of[at] * len(hashes) + k
                if texts * len(hashes) <= 8 * len(pairs) + (1 << 16):
                    seen = np.zeros(texts * len(hashes), dtype=bool)
                    seen[pairs] = True
                    pairs = np.flatnonzero(seen)
                else:
                    pairs = np.unique(pairs)
                yield pairs // len(hashes), numbers[pairs % len(hashes)]

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, number): each pair once."""
        out, again, waiting, size = [], False, [], 0

        def done() -> None:
            nonlocal waiting, size
            lens = np.array([len(p) for _, p in waiting], dtype=np.int64)
            which = np.array([i for i, _ in waiting], dtype=np.int64)
            local, back = np.unique(which, return_inverse=True)
            c = np.concatenate([p for _, p in waiting])
            for t, n in self._here(c, np.repeat(back, lens), np.repeat(np.cumsum(lens), lens), len(local)):
                out.append((local[t], n))
            waiting, size = [], 0

        for i, text in enumerate(texts):
            p = points(text)
            for begin in range(0, len(p), BATCH_CHARS):
                again |= begin > 0
                piece = p[max(0, begin - DEPTH + 1) : begin + BATCH_CHARS]
                waiting.append((i, piece))
                size += len(piece)
                if size >= BATCH_CHARS:
                    done()
        if waiting:
            done()
        none = np.zeros(0, dtype=np.int64)
        t, n = np.concatenate([none, *[x[0] for x in out]]), np.concatenate([none, *[x[1] for x in out]])
        if again and len(t):  # a text of several pieces may have a keyword in some of them
            t, n = np.unique(np.stack([t, n]), axis=1)
        if self.long:
            head = np.isin(n, list(self.long))
            more = [(i, m) for i, k in zip(t[head].tolist(), n[head].tolist(), strict=True) for w, m in self.long[k] if w in texts[i]]
            t, n = t[n >= 0], n[n >= 0]
            if more:
                t, n = (np.concatenate([a, np.array(b, dtype=np.int64)]) for a, b in zip((t, n), zip(*more, strict=True), strict=True))
        return t, n


def numbered(words: DataFrame, table_chars: int = TABLE_CHARS) -> DataFrame:
    """(w, shard, number): the different keywords with their table and their number in it."""
    kept = words.where("w IS NOT NULL AND w <> ''").select("w").distinct()
    chars = kept.agg(F.coalesce(F.sum(F.length("w")), F.lit(0)).alias("c")).first()["c"]
    shard = F.pmod(F.xxhash64("w"), F.lit(int(chars // table_chars) + 1))
    return kept.withColumn("shard", shard).withColumn("number", F.row_number().over(Window.partitionBy("shard").orderBy("w")) - 1)


def tables(shards: DataFrame) -> Iterator[tuple[int, object]]:
    """(shard, broadcast of its tables), one after the other; they are made in tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "data": [pickle.dumps(Tables(pdf["w"].tolist(), pdf["number"].tolist()))]})

    for row in shards.groupBy("shard").applyInPandas(run, "shard long, data binary").toLocalIterator():
        yield row["shard"], shards.sparkSession.sparkContext.broadcast(bytes(row["data"]))


@contextlib.contextmanager
def _batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Meanwhile, rows go to Python workers in batches of about ``size`` bytes: whole ones lie in a worker several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _written(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    path = scratch_dir(spark)
    with _batches(spark, BATCH_BYTES):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _lists(keys: np.ndarray, n_texts: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(words, sizes, lists) of rows, from sorted numbers with a word in the upper and a text in the lower 32 bits; without sizes, lists are bits."""
    words, texts = keys.view(np.int32)[1::2], keys.view(np.uint16)[::4]
    starts = np.concatenate([np.zeros(min(1, len(keys)), dtype=np.int64), np.flatnonzero(words[1:] != words[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(keys)))
    often = sizes > n_texts // OFTEN
    none, wide = np.zeros(0, dtype=np.int32), max(1, PART // ((n_texts + 7) // 8))
    those = np.flatnonzero(often)
    for i in range(0, len(those), wide):
        bits = np.zeros((len(those[i : i + wide]), n_texts), dtype=bool)
        for row, k in zip(bits, those[i : i + wide].tolist(), strict=True):
            row[texts[starts[k] : starts[k] + sizes[k]]] = True
        yield words[starts[those[i : i + wide]]], none, np.packbits(bits, axis=1).tobytes()
    places, words, sizes = texts[np.repeat(~often, sizes)], words[starts[~often]], sizes[~often].astype(np.int32)
    ends, bytes_ = np.cumsum(sizes, dtype=np.int64), np.cumsum(2 * sizes.astype(np.int64) + 8)
    first = 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(bytes_, (bytes_[first - 1] if first else 0) + PART, side="right")))
        yield words[first:last], sizes[first:last], places[ends[first - 1] if first else 0 : ends[last - 1]].tobytes()
        first = last


def _row(block: int, part: int, ids: pa.Array, words: np.ndarray, sizes: np.ndarray, data: bytes) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    packed = [pa.array([x], pa.binary()) for x in (words.astype(np.int32).tobytes(), sizes.astype(np.int32).tobytes(), data)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), lists, *packed], names=["block", "part", "ids", "words", "sizes", "data"])


def _rows(kind: str) -> str:
    return f"block long, part int, ids array<{kind}>, words binary, sizes binary, data binary"


def _blocks(texts: DataFrame, those: list, kind: str) -> DataFrame:
    """Posting lists of blocks of texts: in part -1 the ids in their order, in the others lists of words."""
    n_shards = len(those)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        loaded = [(s, pickle.loads(b.value).ready()) for s, b in those]
        block, ids, found, pairs = TaskContext.get().partitionId() << 32, [], [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal block, ids, found, pairs
            own = pa.concat_arrays(ids)
            order = pc.sort_indices(own).to_numpy()
            place = np.empty(len(own), dtype=np.int64)
            place[order] = np.arange(len(own))
            keys, done = np.empty(pairs, dtype=np.int64), 0
            for w, t in found:
                keys[done : done + len(w)] = w.astype(np.int64) << 32 | place[t]
                done += len(w)
            found = []
            keys.sort()
            one = own.take(pa.array(order))
            yield _row(block, -1, one, np.zeros(0), np.zeros(0), b"")
            for part, lists in enumerate(_lists(keys, len(own))):
                yield _row(block, part, one.slice(0, 0), *lists)
            block, ids, pairs = block + 1, [], 0

        held = 0
        for b in batches:
            for first, some in slices(b.column(1), BATCH_CHARS):
                if held and (held + len(some) > BLOCK_TEXTS or pairs > BLOCK_PAIRS):
                    yield from ended()
                    held = 0
                for s, tables_ in loaded:
                    t, n = tables_.found(some)
                    found.append(((n * n_shards + s).astype(np.int32), (t + held).astype(np.uint16)))
                    pairs += len(t)
                ids.append(b.column(0).take(pa.array(np.arange(first, first + len(some)))))  # a slice would keep all texts of the batch
                held += len(some)
        if held:
            yield from ended()

    return texts.mapInArrow(run, _rows(kind))


def _packs(asked: DataFrame, most: int, kind: str) -> DataFrame:
    """Questions (q_id, words, ns) in rows of about ``most`` tokens: ids, words, their number for each question, ns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = TaskContext.get().partitionId() << 32
        for b in batches:
            q_ids, words, ns = b.column(0), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, first = np.cumsum(sizes), 0
            while first < len(q_ids):
                low = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, low + most, side="right")))
                yield _row(pack, -1, q_ids.slice(first, last - first), words[low : ends[last - 1]], sizes[first:last], ns[low : ends[last - 1]].tobytes())
                pack, first = pack + 1, last

    return asked.mapInArrow(run, _rows(kind))


class Block:
    """The posting lists of a block of texts."""

    def __init__(self, ids: pa.Array):
        self.ids, self.often, self.few, self.texts, self.held = ids, [], [], len(ids), 0

    def add(self, words: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> None:
        if len(sizes):
            self.few.append((words, sizes, data.view(np.uint16)))
            self.held += len(data) // 2
        else:
            self.often.append((words, data.reshape(len(words), -1)))

    def ready(self) -> "Block":
        """Words in order: those with bits, those with places and the ends of their places."""
        none = np.zeros(0, dtype=np.int32)
        self.bit_words = np.concatenate([none, *[x[0] for x in self.often]])
        self.bits = np.concatenate([np.zeros((0, (len(self.ids) + 7) // 8), dtype=np.uint8), *[x[1] for x in self.often]])
        self.words, sizes, self.places = (np.concatenate([z, *[x[i] for x in self.few]]) for i, z in enumerate((none, none, none.astype(np.uint16))))
        self.ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes, dtype=np.int64)])
        self.often = self.few = None
        return self


class Asked:
    """A chunk of questions, with the scores of the best texts of each so far."""

    def __init__(self, packs: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]], limit: int):
        self.ids = pa.concat_arrays([x[0] for x in packs])
        words, sizes = np.concatenate([x[1] for x in packs]), np.concatenate([x[2] for x in packs])
        self.ns = np.concatenate([x[3] if (x[3] > 255).any() else x[3].astype(np.uint8) for x in packs])
        packs.clear()
        self.starts = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes, dtype=np.int64)])
        self.wide = np.add.reduceat(self.ns, self.starts[:-1], dtype=np.int64) > 255
        self.used = np.unique(words)
        self.uses = np.zeros(len(self.used), dtype=np.int64)
        for i in range(0, len(words), 1 << 20):
            words[i : i + (1 << 20)] = np.searchsorted(self.used, words[i : i + (1 << 20)])
            self.uses += np.bincount(words[i : i + (1 << 20)], minlength=len(self.used))
        self.own = words  # places in used
        self.best = np.zeros((len(sizes), limit), dtype=np.int64)


def _at(words: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The place in ``words`` of each of ``used``, or -1."""
    if not len(words):
        return np.full(len(used), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(words, used), len(words) - 1)
    return np.where(words[at] == used, at, -1)


class Scores:
    """Scores of questions in some blocks: rows of bits of frequent words, those asked most first, and lists of places of the others."""

    def __init__(self, blocks: list[Block], asked: Asked, dense: int):
        pads = [-len(b.ids) % 8 for b in blocks]
        self.ids = pa.concat_arrays([x for b, pad in zip(blocks, pads, strict=True) for x in (b.ids, pa.nulls(pad, b.ids.type))])
        self.offsets = np.cumsum([0, *[len(b.ids) + pad for b, pad in zip(blocks, pads, strict=True)]])
        self.n = int(self.offsets[-1])
        self.order = np.empty(self.n, dtype=np.int32)
        self.order[pc.sort_indices(self.ids).to_numpy()] = np.arange(self.n)
        self.low, self.size = (np.zeros((len(asked.used), len(blocks)), dtype=np.int32) for _ in range(2))
        bits, places, end = [], [], 0
        for j, b in enumerate(blocks):
            few = _at(b.words, asked.used)
            here = np.flatnonzero(few >= 0)
            few = few[here]
            self.low[here, j], self.size[here, j] = b.ends[few] + end, np.diff(b.ends)[few]
            end += len(b.places)
            places.append(b.places)
            bits.append(_at(b.bit_words, asked.used))
            self.size[bits[-1] >= 0, j] = len(b.ids) // OFTEN + 1  # or more
        often = np.flatnonzero(self.size.sum(axis=1) > self.n // ROW)
        by_row = often[np.argsort(-asked.uses[often], kind="stable")][: max(1, 8 * dense // self.n)]
        self.row = np.full(len(asked.used), -1, dtype=np.int32)
        self.row[by_row] = np.arange(len(by_row))
        self.rows = np.zeros((len(by_row), self.n // 8), dtype=np.uint8)
        for j, b in enumerate(blocks):
            at, own = bits[j][by_row], self.rows[:, self.offsets[j] // 8 : self.offsets[j + 1] // 8]
            own[at >= 0] = b.bits[at[at >= 0]]
            k, base = by_row[at < 0], end - sum(len(x) for x in places[j:])
            for r, low, size in zip(self.row[k].tolist(), (self.low[k, j] - base).tolist(), self.size[k, j].tolist(), strict=True):
                if size:
                    ones = np.zeros(8 * own.shape[1], dtype=bool)
                    ones[b.places[low : low + size]] = True
                    own[r] = np.packbits(ones)
            bits[j][by_row] = -1
        self.size[by_row] = 0
        for j, b in enumerate(blocks):  # words with bits beyond the rows
            for k in np.flatnonzero(bits[j] >= 0).tolist():
                places.append(np.flatnonzero(np.unpackbits(b.bits[bits[j][k]])).astype(np.uint16))
                self.low[k, j], self.size[k, j] = end, len(places[-1])
                end += len(places[-1])
        for b in blocks:
            b.places = b.bits = None
        self.places = np.concatenate(places)
        self.sizes = self.size.sum(axis=1, dtype=np.int64)

    def spread(self, own: np.ndarray) -> np.ndarray:
        """The places of the lists of words, one after the other."""
        size, low = self.size[own].ravel(), self.low[own].ravel()
        some = np.flatnonzero(size)
        size, low = size[some], low[some] - np.concatenate([[0], np.cumsum(size[some])])[:-1]
        return self.places[np.arange(int(size.sum())) + np.repeat(low, size)] + np.repeat(self.offsets[some % self.size.shape[1]].astype(np.uint16), size)

    def top(self, score: np.ndarray, limit: int, least: int) -> list[tuple[int, int]]:
        """(text, score) of the largest ones of at least ``least``, equal ones in order of the ids; what it has found is 0 then."""
        out: list[tuple[int, int]] = []
        while len(out) < limit and (best := int(score.max())) >= least:
            at = np.flatnonzero(score == best)
            score[at] = 0
            out += [(i, best) for i in at[np.argsort(self.order[at])][: limit - len(out)].tolist()]
        return out

    def all(self, rows: np.ndarray, listed: np.ndarray, limit: int, least: int) -> list[tuple[int, int]]:
        """The best texts, from the scores of all."""
        score = np.bincount(listed, minlength=self.n).astype(np.uint8)
        for k in rows.tolist():
            np.add(score, np.unpackbits(self.rows[k]), out=score)
        return self.top(score, limit, least)

    def wide(self, own: np.ndarray, ns: np.ndarray, limit: int, least: int) -> list[tuple[int, int]]:
        """The same for a question with more tokens than a byte counts."""
        score = np.zeros(self.n, dtype=np.int64)
        for k, n in zip(own.tolist(), ns.tolist(), strict=True):
            if self.row[k] >= 0:
                score += np.unpackbits(self.rows[self.row[k]]) * np.int64(n)
            else:
                score[self.spread(np.array([k]))] += n
        return self.top(score, limit, least)

    def of_rows(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """In how many of the rows texts are."""
        return ((self.rows[rows[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).sum(axis=0, dtype=np.int64)

    def best(self, rows: np.ndarray, listed: np.ndarray, limit: int, least: int) -> list[tuple[int, int]]:
        """The best texts with ``least`` at least.  Rows alone give a text no more than their number, so a text that can
        be among the best is in as many lists as ``least`` is above that number; only such texts are scored."""
        listed = np.sort(listed)
        if least <= 1 and len(listed):  # no score is known yet: those in most lists have one that is to be reached
            first = np.flatnonzero(np.concatenate([[True], listed[1:] != listed[:-1]]))
            times = np.diff(first, append=len(listed))
            some = np.argsort(-times, kind="stable")[: 4 * limit]
            if len(some) >= limit:
                reached = times[some] + self.of_rows(rows, listed[first[some]])
                least = max(1, int(np.sort(reached)[-limit]))
        need = least - len(rows)
        if need < 1:
            return self.all(rows, listed, limit, least)
        if len(listed) < need:
            return []
        at = listed[: len(listed) - need + 1]
        at = at[at == listed[need - 1 :]]
        if not len(at):
            return []
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        if len(at) > self.n // 8:
            return self.all(rows, listed, limit, least)
        score = np.searchsorted(listed, at, side="right") - np.searchsorted(listed, at, side="left") + self.of_rows(rows, at)
        if len(some := np.flatnonzero(score >= least)) > limit:
            some = some[np.lexsort((self.order[at[some]], -score[some]))[:limit]]
        return list(zip(at[some].tolist(), score[some].tolist(), strict=True))


def best_of_block(scores: Scores, asked: Asked, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(questions, texts, scores): the best texts of some blocks for each question, but for those below the best so far."""
    first, n_questions = 0, len(asked.starts) - 1
    while first < n_questions:
        last = min(first + SOME, n_questions)
        low, bounds = asked.starts[first], asked.starts[first : last + 1] - asked.starts[first]
        own, ns = asked.own[low : low + bounds[-1]], asked.ns[low : low + bounds[-1]].astype(np.int64)
        ns = np.where(np.repeat(asked.wide[first:last], np.diff(bounds)), 0, ns)  # those are scored on their own
        places = np.concatenate([[0], np.cumsum(scores.sizes[own] * ns)])[bounds]
        if places[-1] > LISTED:
            last = first + max(1, int(np.searchsorted(places, LISTED, side="right")) - 1)
            bounds = bounds[: last - first + 1]
            own, ns, places = own[: bounds[-1]], ns[: bounds[-1]], places[: last - first + 1]
        listed, rows = scores.spread(np.repeat(own, ns)), np.repeat(scores.row[own], ns)
        ends = np.concatenate([[0], np.cumsum(np.where(scores.row[own] >= 0, ns, 0))])[bounds].tolist()
        most = np.concatenate([[0], np.cumsum(np.where(scores.sizes[own] > 0, ns, 0))])[bounds]
        rows, most, places = rows[rows >= 0], np.diff(most).tolist(), places.tolist()
        floors, got = asked.best[first:last].min(axis=1).tolist(), []
        for q, floor in enumerate(floors):
            least, of = max(1, floor), slice(ends[q], ends[q + 1])
            if asked.wide[first + q]:
                these = slice(*asked.starts[first + q : first + q + 2].tolist())
                found = scores.wide(asked.own[these], asked.ns[these], limit, least)
            elif most[q] + ends[q + 1] - ends[q] < least:
                continue
            else:
                found = scores.best(rows[of], listed[places[q] : places[q + 1]], limit, least)
            if found:
                got += [(q, i, s) for i, s in found]
                asked.best[first + q] = sorted(asked.best[first + q].tolist() + [s for _, s in found])[-limit:]
        if got:
            q, i, s = np.array(got, dtype=np.int64).T
            yield q + first, i, s
        first = last


def _ranges(n_blocks: int, n_chunks: int, cores: int) -> int:
    """Of blocks; few, since questions are copied for each, but enough for the cores."""
    return min(n_blocks, max(-(-n_blocks // RANGE), -(-cores // n_chunks)))


def scored(tokens: DataFrame, texts: DataFrame, limit: int, id_col: str = "ord", text_col: str = "text", table_chars: int = TABLE_CHARS, chunk: int = CHUNK) -> DataFrame:
    """(q_id, id, score): for tokens (q_id, w, n), texts among which are all of the best ones of each question."""
    spark = tokens.sparkSession
    shards = numbered(tokens.select("w"), table_chars)
    those = list(tables(shards))
    kind, q_kind = texts.schema[id_col].dataType.simpleString(), tokens.schema["q_id"].dataType.simpleString()
    out = f"q_id {q_kind}, `{id_col}` {kind}, score int"
    if not those:
        return tokens.select("q_id", F.lit(None).cast(kind).alias(id_col), F.lit(0).alias("score")).where(F.lit(False))
    blocks = _written(_blocks(texts.where(F.col(id_col).isNotNull()).select(id_col, text_col), those, kind))
    word = (F.col("number") * len(those) + F.col("shard")).cast("int")
    asked = tokens.join(shards, "w").groupBy("q_id").agg(F.collect_list(F.struct(word.alias("word"), F.col("n").cast("int").alias("n"))).alias("own"))
    packs = _written(_packs(asked.select("q_id", F.col("own.word").alias("words"), F.col("own.n").alias("ns")), min(chunk, PART), q_kind))
    numbers = [r[0] for r in blocks.where("part = -1").select("block").orderBy("block").collect()]  # of blocks and packs, nothing of what is in them
    sizes = packs.select("block", (F.length("words") / 4).cast("long")).orderBy("block").collect()
    before = np.cumsum([0, *[r[1] for r in sizes]])[:-1] // chunk
    of = np.unique(before, return_inverse=True)[1].tolist()
    n_chunks = max(of, default=0) + 1
    n_ranges = _ranges(len(numbers), n_chunks, spark.sparkContext.defaultParallelism)
    if not n_ranges:
        return spark.createDataFrame([], out)

    def dealt(rows: DataFrame, to: list[tuple[int, int]], q_ids: Column, ids: Column, asks: bool) -> DataFrame:
        where = F.broadcast(spark.createDataFrame(to, "block long, task int"))
        return rows.join(where, "block").select("task", F.lit(asks).alias("asks"), "block", "part", q_ids.alias("q_ids"), ids.alias("ids"), "words", "sizes", "data")

    asking = dealt(packs, [(r[0], c * n_ranges + k) for r, c in zip(sizes, of, strict=True) for k in range(n_ranges)], F.col("ids"), F.lit(None).cast(f"array<{kind}>"), True)
    searched = dealt(blocks, [(b, c * n_ranges + i * n_ranges // len(numbers)) for i, b in enumerate(numbers) for c in range(n_chunks)], F.lit(None).cast(f"array<{q_kind}>"), F.col("ids"), False)
    # each task has a partition: first its questions, then its blocks
    together = asking.unionAll(searched).repartitionById(n_chunks * n_ranges, "task").sortWithinPartitions("task", F.desc("asks"), "block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, questions, blocks, now = [], None, [], (None, None)

        def ended() -> Iterator[pa.RecordBatch]:
            scores = Scores([b.ready() for b in blocks], questions, DENSE)
            blocks.clear()
            for q, i, s in best_of_block(scores, questions, limit):
                yield pa.RecordBatch.from_arrays([questions.ids.take(pa.array(q)), scores.ids.take(pa.array(i)), pa.array(s, pa.int32())], names=["q_id", id_col, "score"])

        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i] for name in b.schema.names}
                words, sizes, data = (np.frombuffer(row[name].as_buffer(), dtype=dtype) for name, dtype in (("words", np.int32), ("sizes", np.int32), ("data", np.uint8)))
                new = row["asks"].as_py() or (row["task"].as_py(), row["block"].as_py()) != now
                if blocks and new and (row["asks"].as_py() or row["task"].as_py() != now[0] or sum(x.texts for x in blocks) + len(row["ids"].values) > TOGETHER - 8 * len(blocks) - 8 or sum(x.held for x in blocks) > PLACES):
                    yield from ended()
                if row["asks"].as_py():
                    packs.append((row["q_ids"].values, words, sizes, data.view(np.int32)))
                elif new:
                    questions, packs = Asked(packs, limit) if packs else questions, []
                    blocks.append(Block(row["ids"].values))
                    now = (row["task"].as_py(), row["block"].as_py())
                else:
                    blocks[-1].add(words, sizes, data)
        if blocks:
            yield from ended()

    return _written(together.mapInArrow(run, out))
