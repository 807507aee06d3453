"""Packing by non-negative least squares over length combinations.

A document is its ids and then END.  Whole windows are cut off its front; the
rest, shorter than a window, is a piece to pack.  The histogram of the rests'
lengths (fewer bins than the window has tokens) goes to the driver.  There,
combinations of two lengths, and of three with one of the most frequent ones,
that fill a window exactly are enumerated; coordinate descent solves their
repeat counts against the histogram under x >= 0; counts are rounded within
what is there.  Rests that no combination takes are packed greedily end to end
and cut at window ends; the last part is cut at powers of two, which need no
padding.  Every piece finds its place from its length and its number among the
pieces of that length, so no group of pieces meets in one task.

Strings of the tokenizer file's added tokens have these tokens' ids wherever
they are in a text; what lies between them is encoded by itself.

Null or empty text is the one id END; repeated rows are documents of their own;
an empty table gives an empty result.
"""

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.bpe import ARRAY_PATTERN, Codec, byte_characters
from tarn.llm.shared import give_back, in_parts, saved, text_or_empty

WINDOW, END = 2048, 1
FREQUENT, SWEEPS = 12, 12
#: Bytes of texts or ids worked on at once, whatever a batch holds.
PART = 1 << 21
#: Sequence numbers of whole windows begin here, a range for each partition.
WHOLE = 1 << 36


@lru_cache(maxsize=2)
def json_codec(path: str) -> Codec:
    """The codec of a byte-level BPE tokenizer file whose ids follow its merges, for text without added tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = sorted((i, t) for t, i in model["vocab"].items() if all(c in back for c in t))
    tokens = [bytes(back[c] for c in t) for _, t in vocabulary]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if model["type"] != "BPE" or [i for i, _ in vocabulary[: 256 + len(merged)]] != list(range(256 + len(merged))) or [t for _, t in vocabulary[256 : 256 + len(merged)]] != merged:
        raise ValueError("not a byte-level BPE whose ids follow its merges")
    return Codec(tokens[: 256 + len(merged)], ARRAY_PATTERN)


@lru_cache(maxsize=2)
def added_tokens(path: str) -> dict[str, int]:
    """The strings and ids of a tokenizer file's added tokens."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        raise ValueError("not added tokens that match as they are written")
    return {t["content"]: t["id"] for t in added if t["content"]}


def encoded(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text, with added tokens."""
    codec, added = json_codec(path), added_tokens(path)
    if not added or not any(a in t for a in added for t in texts):
        yield from codec.encode_many(texts)
        return
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts = [pattern.split(t) for t in texts]  # text and added tokens by turns
    between = iter(codec.encode_many([p for x in parts for p in x[::2]]))
    for x in parts:
        yield np.concatenate([np.array([added[p]], dtype=np.uint32) if k % 2 else next(between).astype(np.uint32) for k, p in enumerate(x)])


def id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows it: ids are stored and moved that way."""
    return "<u2" if max(len(json_codec(path).tokens), *[i + 1 for i in added_tokens(path).values()], 0) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, id_col: str) -> DataFrame:
    """A row a document: id, ids (binary, as ``id_type`` has them), n, rest, pid (input partition), k (number among the partition's rests of that length), w (whole windows before it in the partition)."""
    kind, stored = docs.schema[id_col].dataType.simpleString(), id_type(path)
    schema = f"id {kind}, ids binary, n long, rest int, pid long, k long, w long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        seen, whole = np.zeros(WINDOW, dtype=np.int64), 0
        for b in batches:
            for first, some in in_parts(b.column(1), PART):
                ids, n, rests, ks, ws = [], [], [], [], []
                for x in encoded([t.decode() for t in some], path):
                    x = np.append(x, np.uint32(END)).astype("<u4")
                    r = len(x) % WINDOW
                    ids.append(x.astype(stored).tobytes())
                    n.append(len(x))
                    rests.append(r)
                    ks.append(int(seen[r]))
                    ws.append(whole)
                    seen[r] += 1
                    whole += len(x) // WINDOW
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(rests, pa.int32()), pa.array([pid] * len(n), pa.int64()), pa.array(ks, pa.int64()), pa.array(ws, pa.int64())], names=["id", "ids", "n", "rest", "pid", "k", "w"])
        json_codec(path).forget()
        give_back()

    return docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def combinations(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, ...]]:
    """Pairs of lengths that fill the window, then triples with one of the most frequent lengths."""
    have = sorted(histogram)
    there = set(have)
    pairs = [(a, window - a) for a in have if 2 * a <= window and window - a in there]
    often = sorted(have, key=lambda x: (-histogram[x], x))[:FREQUENT]
    triples = {tuple(sorted((s, a, window - s - a))) for s in often for a in have if window - s - a in there and window - s - a >= a}
    return pairs + sorted(triples)


def solve(histogram: dict[int, int], combos: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """min |A x - h| over x >= 0, by coordinate descent; column j of A counts the lengths of combination j."""
    left = {r: float(h) for r, h in histogram.items()}
    columns = [[(r, c.count(r)) for r in set(c)] for c in combos]
    norms = [sum(m * m for _, m in col) for col in columns]
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = max(-x[j], sum(m * left[r] for r, m in col) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for r, m in col:
                    left[r] -= m * step
        if moved < 0.25:
            break
    return x


def rounded(histogram: dict[int, int], combos: list[tuple[int, ...]], x: list[float]) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts, largest first, within what is left of each length."""
    left, out = dict(histogram), []
    for j in sorted(range(len(combos)), key=lambda j: (-x[j], j)):
        n = min([round(x[j])] + [left[r] // combos[j].count(r) for r in set(combos[j])])
        if n > 0:
            out.append((combos[j], n))
            for r in combos[j]:
                left[r] -= n
    return out


class Plan:
    """Where the k-th rest of a length goes."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        self.window = window
        combos = combinations(histogram, window)
        self.chosen = rounded(histogram, combos, solve(histogram, combos))
        self.ends: dict[int, list[int]] = {}
        self.slots: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        for combo, n in self.chosen:
            offset = 0
            for r in combo:
                ends = self.ends.setdefault(r, [])
                first = ends[-1] if ends else 0
                ends.append(first + n)
                self.slots.setdefault(r, []).append((first, sequence, offset))
                offset += r
            sequence += n
        self.sequences = sequence  # numbered from here on: those of the greedy part
        self.starts, at = {}, 0
        for r in sorted(histogram):
            placed = self.ends.get(r, [0])[-1]
            self.starts[r] = at
            at += (histogram[r] - placed) * r
        self.full, rest = divmod(at, window)
        self.cuts = []  # where sequences of the last part begin: it is cut at powers of two
        at = self.full * window
        while rest:
            self.cuts.append(at)
            at += 1 << (rest.bit_length() - 1)
            rest -= 1 << (rest.bit_length() - 1)
        self.cuts.append(at)

    def places(self, r: int, k: int) -> list[tuple[int, int, int, int]]:
        """(from, length, sequence, offset) of the parts of the k-th rest of length r."""
        ends = self.ends.get(r, [])
        if ends and k < ends[-1]:
            first, sequence, offset = self.slots[r][i] if (i := bisect_right(ends, k)) < len(ends) else (0, 0, 0)
            return [(0, r, sequence + k - first, offset)]
        at = self.starts[r] + (k - (ends[-1] if ends else 0)) * r
        out, done = [], 0
        while done < r:
            here = at + done
            if here < self.full * self.window:
                s, begin = divmod(here, self.window)
                begin, end = here - begin, here - begin + self.window
            else:
                i = bisect_right(self.cuts, here) - 1
                s, begin, end = self.full + i, self.cuts[i], self.cuts[i + 1]
            size = min(end - here, r - done)
            out.append((done, size, self.sequences + s, here - begin))
            done += size
        return out


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids."""
    spark = docs.sparkSession
    rows = saved(tokenised(docs, path, id_col), "tokens")
    counts = rows.where("rest > 0").groupBy("pid", "rest").agg(F.count(F.lit(1)).alias("c"))
    histogram = {r.rest: r.c for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # fewer rows than WINDOW
    before = F.sum("c").over(Window.partitionBy("rest").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("pid", "rest", F.coalesce(before, F.lit(0)).alias("first"))
    plan = spark.sparkContext.broadcast(Plan(histogram))
    kind, stored = docs.schema[id_col].dataType.simpleString(), id_type(path)
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 8 if with_ids else 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            for begin, ids in in_parts(b.column("ids"), PART):
                row, out, parts = [], [], []
                n, rest, pid, k, w, first = (b.column(c).slice(begin, len(ids)).to_pylist() for c in ("n", "rest", "pid", "k", "w", "first"))
                for i in range(len(ids)):
                    whole = n[i] // WINDOW
                    pieces = [(j * WINDOW, WINDOW, WHOLE * (pid[i] + 1) + w[i] + j, 0) for j in range(whole)]
                    if rest[i]:
                        pieces += [(whole * WINDOW + at, size, s, o) for at, size, s, o in p.places(rest[i], first[i] + k[i])]
                    own = np.frombuffer(ids[i], dtype=stored).astype("<u4").tobytes()
                    for at, size, s, o in pieces:
                        part = own[4 * at : 4 * (at + size)]
                        row.append(begin + i)
                        out.append((at, size, zlib.crc32(part), n[i], s, o))
                        if with_ids:
                            parts.append(part)
                cols = [pa.array([x[c] for x in out], pa.int64()) for c in range(6)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), *cols, *[pa.array(parts, pa.binary())][: int(with_ids)]], names=names)
        give_back()

    placed = rows.join(starts, ["pid", "rest"], "left")
    return placed.select("id", "ids", "n", "rest", "pid", "k", "w", F.coalesce("first", F.lit(0)).cast("long").alias("first")).mapInArrow(run, schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
