"""Substring deduplication on a compacted De Bruijn graph of words.

Every word in a window of WINDOW words whose sequence also starts in a document of smaller id is removed.

The windows are edges between sequences of one word less.  Each window has an anchor, the sequence of ANCHOR words in it
with the smallest hash (the leftmost of equals), so equal windows have equal anchors.  Consecutive windows of a
document with the same anchor are a path.  Three scans of the texts and joins of what they find make spans:

1. Each part of the input sends its anchors; those that lie in two documents or more are repeated.
2. Paths with repeated anchors are written. The earliest source of each path is found, and later documents join it: all their
   windows on that path are repeated. An anchor with one path does not branch; the rest of its windows are new.
3. Where an anchor has several paths, the graph branches inside them. The windows of each such path, in
   the document that has it first, are edges of their own: each finds its earliest source and later ones join it.

Adjacent windows of a document with adjacent places in one source are glued to long spans.  Digests of the spans'
words, taken at the source's coordinates and at the document's own, must agree before anything is cut; a span for
which they don't (64-bit hashes met by chance) is left alone.

A part sends one row for each anchor, and one for each path and document that is the first there, so copies do not pile up;
sources with many spans to be read are split by a salt.  Filters of repeated anchors, paths and ids are Bloom filters
of bounded size (``shared.MAX_BITS``); a full one passes more rows, never fewer.

Null text counts as empty. Documents of fewer words than a window keep all. Rows of equal id are each cut by their own text, and not
because of each other; rows without an id of equal text count as one document, after all others. An
empty table gives an empty result. Columns of the input beside the id and the text are not kept.
"""

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.hashing import mix
from tarn.llm.shared import among, among_hashes, dropped, give_back, in_parts, row_key, saved, text_or_empty
from tarn.llm.suffix_dedup import dealt, gathered

WINDOW, ANCHOR = 13, 5
PART = 250_000  # bytes of text looked at together; longer texts go in pieces
HELD = 200_000  # paths that a part of the input holds before it sends them
SHARD_BYTES = 8 << 20  # of text, for each shard of anchors
ASKED = 1000  # spans read from a source by one task
LONG = 64  # bytes; longer words are hashed one by one
BITS = 24  # of an anchor's hash that hold its place

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SEEN = [("h", "<u8"), ("id", "<i8")]
PATHS = "path long, anchor long, id long, row long, lo int, n int, src long, src_row long, src_lo int"


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # splits bytes at 0x20 and 0x09 to 0x0D only


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in some bytes; eight bytes are taken in at once."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    blocks = np.lib.stride_tricks.sliding_window_view(padded, 8)
    h = mix(size.astype(np.uint64) + np.uint64(1))
    rows = np.flatnonzero(size <= LONG)
    at = 0
    while len(rows):
        left = np.minimum(size[rows] - at, 8).astype(np.uint64)
        block = np.ascontiguousarray(blocks[starts[rows] + at]).view("<u8").reshape(-1)
        h[rows] = mix(h[rows] ^ (block & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))))
        at += 8
        rows = rows[size[rows] > at]
    for k in np.flatnonzero(size > LONG):
        h[k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), dtype="<u8")[0]
    return starts, ends, h


_ODD = mix(np.arange(101, 110, dtype=np.uint64)) | np.uint64(1)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, put together from runs of 1, 2, 4 and so on."""
    runs, size, out, done = words, 1, None, 0
    count = len(words) - n + 1
    with np.errstate(over="ignore"):
        while size <= n:
            if n & size:
                part = runs[done : done + count]
                out = part if out is None else mix(out * _ODD[0] + part * _ODD[1] + np.uint64(size))
                done += size
            if 2 * size <= n:
                runs = mix(runs[: len(runs) - size] * _ODD[2] + runs[size:] * _ODD[3] + np.uint64(size))
            size *= 2
    return out


def _pieces(text: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """(words before it, piece): pieces of about ``most`` bytes that share all but one word of a window."""
    at = first = 0
    while True:
        end = at + most
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        piece = text[at:end]
        yield first, piece
        if end >= len(text):
            return
        starts, _, _ = word_hashes(np.frombuffer(piece, dtype=np.uint8))
        if len(starts) < WINDOW:  # words of great length
            most *= 2
            continue
        first, at = first + len(starts) - WINDOW + 1, at + int(starts[len(starts) - WINDOW + 1])


def _fitting(texts: list[bytes], ids: np.ndarray, rows: np.ndarray, most: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, ids, rows, words before): the texts, or pieces of a long one, each by itself."""
    small = [k for k, t in enumerate(texts) if len(t) <= most]
    if small:
        yield [texts[k] for k in small], ids[small], rows[small], np.zeros(len(small), dtype=np.int64)
    for k, t in enumerate(texts):
        if len(t) > most:
            for first, piece in _pieces(t, most):
                yield [piece], ids[k : k + 1], rows[k : k + 1], np.array([first])


def paths_of(texts: list[bytes], ids: np.ndarray, rows: np.ndarray, before: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """(paths as columns h, c, id, row, lo, n; hashes of all windows; the first window of each path)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, _, words = word_hashes(data)
    none = np.zeros(0, dtype=np.int64)
    if len(words) < WINDOW:
        return {k: none.astype(np.uint64) if k in "hc" else none for k in ("h", "c", "id", "row", "lo", "n")}, words[:0], none
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, begins))
    doc = np.repeat(np.arange(len(texts)), counts)
    grams, windows = sequence_hashes(words, ANCHOR), sequence_hashes(words, WINDOW)
    low = (grams & ~np.uint64((1 << BITS) - 1)) | np.arange(len(grams)).astype(np.uint64)
    width, span = 1, WINDOW - ANCHOR + 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(windows)], low[span - width : span - width + len(windows)])
    at = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :])
    x, of = (low[at] & np.uint64((1 << BITS) - 1)).astype(np.int64), doc[at]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (of[1:] != of[:-1])])) if len(at) else none
    lo, hi = at[first], at[np.append(first[1:], len(at)) - 1] if len(at) else none
    x, of, n = x[first], of[first], hi - lo + 1
    with np.errstate(over="ignore"):  # the first and the last window cover the path
        c = mix(windows[lo] * _ODD[4] + windows[hi] * _ODD[5] + n.astype(np.uint64) * _ODD[6])
    word_no = lo - (np.cumsum(counts) - counts)[of] + before[of]
    return {"h": grams[x], "c": c, "id": ids[of], "row": rows[of], "lo": word_no, "n": n}, windows, lo


def windows_in(paths: dict, windows: np.ndarray, first: np.ndarray, keep: np.ndarray) -> dict:
    """The single windows of the paths ``keep`` (numbers), as paths of one window."""
    n = paths["n"][keep]
    of = np.repeat(keep, n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    one = np.ones(len(of), dtype=np.int64)
    return {"h": paths["h"][of], "c": windows[first[of] + step], "id": paths["id"][of], "row": paths["row"][of], "lo": paths["lo"][of] + step, "n": one}


def sent_on(p: dict) -> pa.RecordBatch:
    """Rows of PATHS: the paths of the document that is the first here with each, and spans of later documents, glued."""
    at = np.lexsort((p["lo"], p["row"], p["id"], p["c"]))
    p = {k: v[at] for k, v in p.items()}
    c = p["c"]
    new = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, dtype=bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(c) else np.zeros(0, dtype=np.int64)
    later = np.flatnonzero(p["id"] != p["id"][lead])
    here = np.flatnonzero(p["id"] == p["id"][lead])
    s = {k: p[k][later] for k in ("id", "row", "lo", "n")} | {f"src_{k}": p[k][lead[later]] for k in ("id", "row", "lo")}
    o = np.lexsort((s["lo"], s["row"], s["id"]))
    s = {k: v[o] for k, v in s.items()}
    begin = np.ones(len(o), dtype=bool)
    if len(o):
        begin[1:] = (s["lo"][1:] != s["lo"][:-1] + s["n"][:-1]) | (s["src_lo"][1:] - s["lo"][1:] != s["src_lo"][:-1] - s["lo"][:-1])
        for k in ("id", "row", "src_id", "src_row"):
            begin[1:] |= s[k][1:] != s[k][:-1]
    b = np.flatnonzero(begin)
    total = np.add.reduceat(s["n"], b) if len(b) else s["n"]
    blank = lambda n, t: pa.nulls(n, t)
    signed = lambda v: v.astype(np.uint64).view(np.int64)
    long, whole = pa.int64(), pa.int32()
    known = [blank(len(b), long), blank(len(b), long), pa.array(s["id"][b], long), pa.array(s["row"][b], long), pa.array(s["lo"][b], whole), pa.array(total, whole), pa.array(s["src_id"][b], long), pa.array(s["src_row"][b], long), pa.array(s["src_lo"][b], whole)]
    mine = [pa.array(signed(p["c"][here]), long), pa.array(signed(p["h"][here]), long), pa.array(p["id"][here], long), pa.array(p["row"][here], long), pa.array(p["lo"][here], whole), pa.array(p["n"][here], whole), blank(len(here), long), blank(len(here), long), blank(len(here), whole)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(known, mine, strict=True)], names=[x.split()[0] for x in PATHS.split(", ")])


def _scan(docs: DataFrame, take: Callable[[dict, np.ndarray, np.ndarray], dict], send: Callable[[dict], pa.RecordBatch], schema: str, part: int, held_most: int) -> DataFrame:
    """Runs over the texts (id, row, text); what ``take`` keeps of the paths is held and given to ``send``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        join = lambda: {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        for b in batches:
            ids, rows = (b.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            for i, texts in in_parts(b.column(2), part):
                for piece, pid, prow, before in _fitting(texts, ids[i : i + len(texts)], rows[i : i + len(texts)], part):
                    held.append(take(*paths_of(piece, pid, prow, before)))
                    size += len(held[-1]["h"])
                    if size >= held_most:
                        p, held, size = join(), [], 0
                        yield send(p)
        if size:
            p, held = join(), []
            yield send(p)
        give_back()

    return docs.select("id", "row", "text").mapInArrow(run, schema)


def _repeated_anchors(docs: DataFrame, shards: int, part: int, held: int) -> DataFrame:
    """(h) of the anchors that lie in several documents."""

    def take(p: dict, windows: np.ndarray, first: np.ndarray) -> dict:
        return {"h": p["h"], "id": p["id"]}

    def ends(h: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each hash, its smallest and its largest id)"""
        at = np.lexsort((i, h))
        h, i = h[at], i[at]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        return h[new], i[new], i[np.append(new[1:], len(h)) - 1] if len(h) else i

    def send(p: dict) -> pa.RecordBatch:
        h, low, high = ends(p["h"], p["id"])
        two = low < high
        cols = {"h": np.concatenate([h, h[two]]), "id": np.concatenate([low, high[two]])}
        order = np.argsort(cols["h"], kind="stable")
        out = dealt(0, (cols["h"][order] % np.uint64(shards)).astype(np.int64), {k: v[order] for k, v in cols.items()}, SEEN)
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["key", "blob"])

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        got = gathered(pdf.blob, SEEN)
        h, low, high = ends(got["h"], got["id"])
        give_back()
        return pd.DataFrame({"h": h[low < high].view(np.int64)})

    return _scan(docs, take, send, "key int, blob binary", part, held).groupBy("key").applyInPandas(shard, "h long")


def _joined(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """Spans of documents later than the first source of a path."""
    both = paths.where("path IS NOT NULL").select("path", "id", "row", "lo", "n").join(sources.select("path", F.col("at.id").alias("src"), F.col("at.row").alias("src_row"), F.col("at.lo").alias("src_lo")), "path")
    return both.where("id > src").drop("path")


def spans_of(docs: DataFrame, part: int = PART, held: int = HELD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Spans (id, row, lo, n, src, src_row, src_lo): n windows from word lo on are those from word src_lo on of a document of smaller id."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    anchors = saved(_repeated_anchors(docs, max(48, int(total // shard_bytes) + 1), part, held), "anchors")
    repeated = among_hashes(anchors, F.col("h"))
    dropped(anchors)

    def branchless(p: dict, windows: np.ndarray, first: np.ndarray) -> dict:
        keep = np.flatnonzero(repeated(p["h"]))
        return {k: v[keep] for k, v in p.items()}

    paths = saved(_scan(docs, branchless, sent_on, PATHS, part, held), "paths")
    own = paths.where("path IS NOT NULL")
    sources = saved(own.groupBy("path").agg(F.min(F.struct("id", "row", "lo")).alias("at"), F.min("anchor").alias("anchor")), "sources")
    # Written first: a join right above an aggregate keeps its partitioning, and adaptive execution does not split a frequent anchor there.
    branching = saved(sources.groupBy("anchor").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a < b").select("anchor"), "branching")
    split = saved(sources.join(branching, "anchor").select(F.col("path").bitwiseXOR(F.col("at.id")).alias("id")), "branching")
    in_branching = among_hashes(split, F.col("id"))
    dropped(split, branching)

    def branched(p: dict, windows: np.ndarray, first: np.ndarray) -> dict:
        return windows_in(p, windows, first, np.flatnonzero(in_branching(p["c"] ^ p["id"].view(np.uint64))))

    edges = saved(_scan(docs, branched, sent_on, PATHS, part, held), "edges")
    firsts = saved(edges.where("path IS NOT NULL").groupBy("path").agg(F.min(F.struct("id", "row", "lo")).alias("at")), "firsts")
    columns = ["id", "row", "lo", "n", "src", "src_row", "src_lo"]
    known = [t.where("path IS NULL").select(columns) for t in (paths, edges)]
    found = known[0].unionAll(known[1]).unionAll(_joined(paths, sources).select(columns)).unionAll(_joined(edges, firsts).select(columns))
    order = Window.partitionBy("id", "row").orderBy("lo", "n", "src", "src_row", "src_lo")  # a document's own rows
    before = lambda c: F.lag(c).over(order)
    same = [F.col(c).eqNullSafe(before(c)) for c in ("lo", "n", "src", "src_row", "src_lo")]
    found = found.withColumn("again", reduce(lambda a, b: a & b, same)).where(~F.col("again"))  # rows that are there twice
    goes_on = (F.col("lo") == before("lo") + before("n")) & (F.col("src") == before("src")) & (F.col("src_row") == before("src_row")) & (F.col("src_lo") - F.col("lo") == before("src_lo") - before("lo"))
    runs = found.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    glued = runs.groupBy("id", "row", "run").agg(F.min("lo").alias("lo"), F.sum("n").cast("int").alias("n"), F.min("src").alias("src"), F.min("src_row").alias("src_row"), F.min("src_lo").alias("src_lo"))
    out = saved(glued.select(columns), "spans")
    dropped(paths, sources, edges, firsts)
    return out


def digest(words: list[bytes], lo: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[lo : lo + n + WINDOW - 1]), digest_size=16).digest()


def _digests(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, asked in zip(texts, spans, strict=True):
        words = words_of(text.as_buffer().to_pybytes())
        out.append([digest(words, s["src_lo"], s["n"]) for s in asked.as_py()])
    give_back()
    return pa.array(out, pa.list_(pa.binary()))


def _read_at_sources(docs: DataFrame, spans: DataFrame, asked: int) -> DataFrame:
    """The spans with the digest of the words at their source; a source with many spans is read by several tasks."""
    places = saved(spans.select("src", "src_row", "src_lo", "n").distinct(), "places")
    many = places.groupBy("src", "src_row").agg((F.count("*") / asked).cast("int").alias("most"))
    salted = places.join(many, ["src", "src_row"]).withColumn("salt", F.pmod(F.xxhash64("src_lo", "n"), F.col("most") + 1))
    lists = salted.groupBy("src", "src_row", "salt").agg(F.collect_list(F.struct("src_lo", "n")).alias("spans"))
    wanted = saved(many.select(F.col("src").alias("id")).distinct(), "read")
    texts = docs.where(among(among_hashes(wanted))(F.col("id"))).select(F.col("id").alias("src"), F.col("row").alias("src_row"), "text").dropDuplicates(["src", "src_row"])
    read = texts.join(lists, ["src", "src_row"]).select("src", "src_row", "spans", F.arrow_udf(_digests, "array<binary>")(F.encode("text", "UTF-8"), "spans").alias("digests"))
    flat = read.select("src", "src_row", F.explode(F.arrays_zip("spans", "digests")).alias("x")).select("src", "src_row", F.col("x.spans.src_lo").alias("src_lo"), F.col("x.spans.n").alias("n"), F.col("x.digests").alias("digest"))
    out = saved(spans.join(flat, ["src", "src_row", "src_lo", "n"]).select("id", "row", "lo", "n", "digest"), "read")
    dropped(places, wanted)
    return out


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n_words, n_removed, n_spans, kept = [], [], [], []
    for text, found in zip(texts, spans, strict=True):
        words = words_of(text.as_buffer().to_pybytes())
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for s in found.as_py() or []:
            if digest(words, s["lo"], s["n"]) == s["digest"]:
                gone[s["lo"]] += 1
                gone[s["lo"] + s["n"] + WINDOW - 1] -= 1
        out = np.cumsum(gone)[:-1] > 0
        n_words.append(len(words))
        n_removed.append(int(out.sum()))
        n_spans.append(int((np.diff(np.concatenate([[False], out]).astype(np.int8)) == 1).sum()))
        kept.append(b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o] if n_removed[-1] else words))
    give_back()
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["n_words", "n_removed", "n_spans", "kept"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", part: int = PART, held: int = HELD, asked: int = ASKED) -> DataFrame:
    """A row for each row: id, n_words, n_removed, n_spans, kept: the words left, joined by one space."""
    id_ = F.col(f"`{id_col}`")
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(row_key(id_.cast("long")).alias("id"), F.xxhash64(text_or_empty()).alias("row"), text_or_empty().alias("text"), id_.isNull().alias("unnamed"))
    spans = spans_of(whole, part, held)
    read = _read_at_sources(whole, spans, asked)
    dropped(spans)
    lists = read.groupBy("id", "row").agg(F.collect_list(F.struct("lo", "n", "digest")).alias("spans"))  # of one document
    ids = saved(read.select("id").distinct(), "cut")
    cut_in = among(among_hashes(ids))(F.col("id"))
    dropped(ids)
    touched = whole.where(cut_in).join(lists, ["id", "row"], "left")
    none = F.lit(None).cast(lists.schema["spans"].dataType)
    both = touched.select("id", "unnamed", "text", "spans").unionAll(whole.where(~cut_in).select("id", "unnamed", "text", none))
    cut = both.select(F.when(~F.col("unnamed"), F.col("id")).cast(kind).alias(id_col), F.arrow_udf(_cut, "struct<n_words: long, n_removed: long, n_spans: long, kept: binary>")(F.encode("text", "UTF-8"), "spans").alias("out"))
    return cut.select(id_col, "out.*").withColumn("kept", F.decode("kept", "UTF-8"))


def op12_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM g),
r AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM m, range(13) o(k) WHERE f < doc_id GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""
