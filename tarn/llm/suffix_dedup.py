"""Suffix-array deduplication with a logarithmic family of indexes.

Every byte that lies in a LENGTH-byte string which also starts earlier (in a
document of smaller id, or earlier in its own) is removed.

Suffixes are indexed at anchors only: in each window of LENGTH bytes the KGRAM
with the smallest hash (the leftmost of equals), so equal windows have their
anchor at equal places.  An anchor serves a run of windows; the bytes they
cover are its context.  A sparse suffix array holds anchors in suffix order: by
the suffix's first KGRAM bytes (its head), as bytes compare, and among equal heads by the hash
of the context, each context by its earliest occurrence.  Suffixes that match in KGRAM bytes or more
are neighbours in it.  The index is sharded by a hash of the head.  A shard takes its
anchors in batches by document id: each batch gets its suffix array, which is
merge-scanned against the arrays of the existing levels; equal contexts are
long matches, so all their bytes but the earliest's are removed; levels of
equal size merge geometrically.  Neighbours whose heads match and whose contexts
differ match in part: their contexts are fetched from the texts and compared
window by window.  Only texts that may be asked for or cut move, which Bloom filters of their ids tell.

A part of the input sends each context once, so copies do not pile up.  If it
has over MANY contexts for one head, it sends a mark instead; all
anchors of that head are then compared by windows, which are dealt out by
their own hash.  Texts travel compressed, in buckets of bounded size.  Anchors of a
text of any length are looked for in pieces that overlap, so that each window
lies in one whole; what lies in two is one place and no repetition.

Rows of equal id count as one document; so do rows without an id of equal text, after all others.  Null text counts as empty; texts under LENGTH bytes keep
all; an empty table gives an empty result.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.hashing import mix, prefix_sums, span_hashes
from tarn.llm.shared import among, among_hashes, dropped, give_back, in_parts, row_key, saved, text_or_empty

LENGTH, KGRAM = 100, 32
SPAN = LENGTH - KGRAM + 1  # anchors that a window can have
GROUP_BYTES = 8 << 20
CHUNK, BATCH, MANY = 500_000, 1 << 14, 64
PART = 250_000  # bytes of text looked at together; longer texts go in pieces
BITS = 24  # of a hash that hold a position: texts are looked at in parts of up to 2^BITS bytes
#: Kinds of rows: anchors, removed spans, requests for contexts, contexts, windows.
ANCHORS, SPANS, REQUESTS, CONTEXTS, WINDOWS = range(5)
MARK = np.uint64(0)  # the context hash of "over MANY contexts"

ANCHOR = [("h", f"S{KGRAM}"), ("c", "<u8"), ("id", "<i8"), ("lo", "<i4"), ("off", "u1"), ("run", "u1")]
SPAN_T = [("id", "<i8"), ("s", "<i4"), ("e", "<i4")]
REQUEST = [("h", "<u8"), ("id", "<i8"), ("lo", "<i4"), ("run", "u1"), ("hot", "u1")]
CONTEXT = [("id", "<i8"), ("lo", "<i4"), ("run", "u1")]
WINDOW_T = [("w", "<u8"), ("id", "<i8"), ("p", "<i4")]


def pack(cols: dict, kind: list) -> bytes:
    """Columns end to end, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(cols[n], dtype=t).tobytes() for n, t in kind))


def unpack(blob: bytes, kind: list) -> dict:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), {}, 0
    n = len(raw) // sum(np.dtype(t).itemsize for _, t in kind)
    for name, t in kind:
        out[name] = np.frombuffer(raw, dtype=t, count=n, offset=at)
        at += n * np.dtype(t).itemsize
    return out


def gathered(blobs, kind: list) -> dict:
    parts = [unpack(b, kind) for b in blobs]
    return {n: np.concatenate([*[p[n] for p in parts], np.zeros(0, dtype=t)]) for n, t in kind}


def dealt(kind: int, key: np.ndarray, cols: dict, types: list, rows: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """A row (kind, key, blob) for each key; keys are those of ``rows``, or of all."""
    at = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[at])) + 1
    of = lambda i: i if rows is None else rows[i]
    return [(kind, int(key[i[0]]), pack({n: cols[n][of(i)] for n, _ in types}, types)) for i in np.split(at, cut)] if len(key) else []


def heads_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The KGRAM bytes from each place on, as byte strings that sort as the suffixes do."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, KGRAM)[at]).view(f"S{KGRAM}").reshape(-1)


def head_hash(h: np.ndarray) -> np.ndarray:
    """A hash of each head, by which shards are dealt out."""
    words = np.ascontiguousarray(h).view("<u8").reshape(len(h), KGRAM // 8)
    out = np.full(len(h), 77, dtype=np.uint64)
    for k in range(words.shape[1]):
        out = mix(out ^ words[:, k])
    return out


def bucket_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def anchors_of(texts: list[bytes], ids: np.ndarray, starts: np.ndarray, bits: int = BITS) -> dict:
    """The anchors of the texts, as columns of ANCHOR; ``starts`` are the texts' places in their documents."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    if n > 1 << bits:
        raise ValueError("more bytes than positions")
    if n < LENGTH:
        return {name: np.zeros(0, dtype=t) for name, t in ANCHOR}
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    sums = prefix_sums(data)
    at = np.arange(n - KGRAM + 1)
    grams = span_hashes(sums, at, at + KGRAM)
    low = (grams & ~np.uint64((1 << bits) - 1)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[SPAN - width : SPAN - width + n - LENGTH + 1])
    doc = np.repeat(np.arange(len(texts)), sizes)
    p = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
    if not len(p):
        return {name: np.zeros(0, dtype=t) for name, t in ANCHOR}
    x = (low[p] & np.uint64((1 << bits) - 1)).astype(np.int64)
    of = doc[p]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (of[1:] != of[:-1])]))
    lo, hi = p[first], p[np.append(first[1:], len(p)) - 1]
    x, of = x[first], of[first]
    with np.errstate(over="ignore"):
        c = mix(span_hashes(sums, lo, hi + LENGTH) + (x - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return {"h": heads_of(data, x), "c": np.where(c == MARK, np.uint64(1), c), "id": ids[of], "lo": lo - begins[of] + starts[of], "off": x - lo, "run": hi - lo}


def earliest(a: dict) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are the earliest of their context, in index order; rows with an earlier one)."""
    if not len(a["h"]):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, lo = a["id"], a["lo"]
    in_order = ((i[1:] > i[:-1]) | ((i[1:] == i[:-1]) & (lo[1:] >= lo[:-1]))).all()
    at = np.lexsort((a["c"], a["h"]) if in_order else (lo, i, a["c"], a["h"]))  # stable
    new = np.ones(len(at), dtype=bool)
    for k, n in enumerate(("h", "c")):
        v = a[n][at]
        new[1:] = (v[1:] != v[:-1]) | (new[1:] if k else False)
    del v
    lead = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (i[at] != i[lead]) | (lo[at] != lo[lead])  # the same place twice: rows of equal id
    return at[new], at[later]


def _spans(a: dict, rows: np.ndarray, groups: int) -> list:
    s = a["lo"][rows].astype(np.int64)
    cols = {"id": a["id"][rows], "s": s, "e": s + a["run"][rows] + LENGTH}
    return dealt(SPANS, bucket_of(cols["id"], groups), cols, SPAN_T)


def _requests(a: dict, rows: np.ndarray, hot: np.ndarray, groups: int) -> list:
    cols = {"h": head_hash(a["h"][rows]), "id": a["id"][rows], "lo": a["lo"][rows], "run": a["run"][rows], "hot": hot}
    return dealt(REQUESTS, bucket_of(cols["id"], groups), cols, REQUEST)


def sent(a: dict, groups: int, most: int = MANY) -> list:
    """What a part of the input sends on: anchors to their shards, and what it knows by itself."""
    reps, later = earliest(a)
    out = _spans(a, later, groups)
    h = a["h"][reps]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(h)))
    many = np.repeat(count > most, count)
    hot = reps[many]
    out += _requests(a, hot, np.ones(len(hot), dtype=np.uint8), groups)
    keep = reps[~many]
    marks = {n: np.zeros(int((count > most).sum()), dtype=t) for n, t in ANCHOR} | {"h": h[first[count > most]]}
    shard = lambda h: (head_hash(h) % np.uint64(groups)).astype(np.int64)
    del h
    return out + dealt(ANCHORS, shard(a["h"][keep]), a, ANCHOR, keep) + dealt(ANCHORS, shard(marks["h"]), marks, ANCHOR)


class Family:
    """Levels of suffix arrays; a level is columns of ANCHOR in the order of (h, c)."""

    def __init__(self):
        self.levels: list[dict] = []

    @staticmethod
    def _places(level: dict, a: dict) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor its place in the level's order, and whether its context is there: a scan of both in their order."""
        place = np.searchsorted(level["h"], a["h"], side="left")
        end = np.searchsorted(level["h"], a["h"], side="right")
        live = np.flatnonzero(place < end)
        while len(live):  # contexts of one head are few: a part sends at most MANY
            mid = (place[live] + end[live]) // 2
            less = level["c"][mid] < a["c"][live]
            place[live[less]] = mid[less] + 1
            end[live[~less]] = mid[~less]
            live = live[place[live] < end[live]]
        there = place < len(level["h"])
        at = place[there]
        there[there] = (level["c"][at] == a["c"][there]) & (level["h"][at] == a["h"][there])
        return place, there

    def add(self, a: dict) -> np.ndarray:
        """Takes a batch of later documents; returns its rows that match an earlier context whole."""
        reps, later = earliest(a)
        own = {n: v[reps] for n, v in a.items()}
        known = np.zeros(len(reps), dtype=bool)
        for level in self.levels:
            at, hit = self._places(level, own)
            # equal places are rows of equal id: known, but not matched
            same = hit.copy()
            same[hit] = (level["id"][at[hit]] == own["id"][hit]) & (level["lo"][at[hit]] == own["lo"][hit])
            known |= hit
            later = np.concatenate([later, reps[hit & ~same]])
        self.levels.append({n: v[~known] for n, v in own.items()})
        while len(self.levels) > 1 and len(self.levels[-1]["h"]) * 2 >= len(self.levels[-2]["h"]):
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))
        return later

    @classmethod
    def _merged(cls, x: dict, y: dict) -> dict:
        """One level of two: the smaller one's anchors go to their places in the larger one."""
        large, small = (x, y) if len(x["h"]) >= len(y["h"]) else (y, x)
        place, _ = cls._places(large, small)
        return {n: np.insert(v, place, small[n]) for n, v in large.items()}

    def whole(self) -> dict:
        while len(self.levels) > 1:
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))
        return self.levels[0] if self.levels else {n: np.zeros(0, dtype=t) for n, t in ANCHOR}


def indexed(a: dict, groups: int, size: int = BATCH) -> list:
    """A shard: spans of contexts seen before, and requests for contexts that differ beside equal heads."""
    out, family = [], Family()
    mark = a["c"] == MARK
    marked = np.unique(a["h"][mark])
    a = {n: v[~mark] for n, v in a.items()}
    order = np.lexsort((a["lo"], a["id"]))
    for i in range(0, len(order), size):
        batch = {n: v[order[i : i + size]] for n, v in a.items()}
        out += _spans(batch, family.add(batch), groups)
    w = family.whole()
    hot = np.isin(w["h"], marked)
    near = np.zeros(len(w["h"]), dtype=bool)
    same = w["h"][1:] == w["h"][:-1]
    near[1:] |= same
    near[:-1] |= same
    rows = np.flatnonzero(near | hot)
    return out + _requests(w, rows, hot[rows].astype(np.uint8), groups)


def _windows(data: np.ndarray, starts: np.ndarray, r: dict) -> dict:
    """A row for each window of contexts that begin at ``starts``."""
    runs = r["run"].astype(np.int64) + 1
    row = np.repeat(np.arange(len(runs)), runs)
    step = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = starts[row] + step
    return {"w": span_hashes(prefix_sums(data), at, at + LENGTH), "id": r["id"][row], "p": r["lo"][row] + step}


def repeated(w: dict, groups: int) -> list:
    """Spans of windows that have an earlier equal one."""
    at = np.lexsort((w["p"], w["id"], w["w"]))
    v, i, p = (w[k][at] for k in ("w", "id", "p"))
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(v) else np.zeros(0, dtype=np.int64)
    later = (i != i[lead]) | (p != p[lead])
    i, p = i[later], p[later].astype(np.int64)
    s = np.lexsort((p, i))
    i, p = i[s], p[s]
    head = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (p[1:] > p[:-1] + LENGTH)])) if len(i) else np.zeros(0, dtype=np.int64)
    tail = np.append(head[1:], len(i)) - 1 if len(i) else head
    cols = {"id": i[head], "s": p[head], "e": p[tail] + LENGTH}
    return dealt(SPANS, bucket_of(cols["id"], groups), cols, SPAN_T)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame({"kind": pd.Series([r[0] for r in rows], dtype="int32"), "key": pd.Series([r[1] for r in rows], dtype="int32"), "blob": [r[2] for r in rows]})


ROWS = "kind int, key int, blob binary"


def _texts(docs: DataFrame, groups: int, may: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Texts of the ids that ``may`` passes, by bucket: (key, blob), several texts in one compressed blob; the size of one without an id is stored as its complement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(may(b.column(3).to_numpy())))
            ids = b.column(0).to_numpy().astype(np.int64)
            texts = b.column(1).cast(pa.binary()).to_pylist()
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            sizes = np.where(b.column(2).to_numpy(zero_copy_only=False), ~sizes, sizes)
            keys, blobs = [], []
            bucket = bucket_of(ids, groups)
            for k in np.unique(bucket).tolist():
                rows = np.flatnonzero(bucket == k)
                raw = b"".join([np.int64(len(rows)).tobytes(), ids[rows].tobytes(), sizes[rows].tobytes(), *[texts[i] for i in rows]])
                keys.append(k)
                blobs.append(zstandard.ZstdCompressor(level=3).compress(raw))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["key", "blob"])
        give_back()

    return docs.select("id", "text", "unnamed", F.xxhash64("id").alias("hash")).mapInArrow(run, "key int, blob binary")


def _unpacked(blobs) -> Iterator[tuple[int, bytes, bool]]:
    """(key, text, whether the row has an id)"""
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
        ids, sizes = (np.frombuffer(raw, dtype=np.int64, count=n, offset=8 + 8 * n * k) for k in (0, 1))
        at = 8 + 16 * n
        for i, size in zip(ids.tolist(), sizes.tolist(), strict=True):
            named, size = size >= 0, max(size, ~size)
            yield i, raw[at : at + size], named
            at += size


def _ids_in(blobs: DataFrame, types: list) -> DataFrame:
    """The distinct ids (id) that packed columns (blob) hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(unpack(blob.as_py(), types)["id"]).astype(np.int64))], names=["id"])

    return saved(blobs.select("blob").mapInArrow(run, "id long").distinct(), "ids")


def deduplicated_spans(docs: DataFrame, id_col: str = "doc_id", most: int = MANY, batch_size: int = BATCH, chunk: int = CHUNK, bits: int = BITS) -> tuple[DataFrame, DataFrame, int]:
    """(rows (id, text, unnamed), removed spans by bucket, number of buckets)."""
    whole = docs.select(row_key(F.col(id_col).cast("long")).alias("id"), text_or_empty().alias("text"), F.col(id_col).isNull().alias("unnamed"))
    total = whole.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(48, int(total // GROUP_BYTES) + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            a = {n: np.concatenate([*[h.pop(n) for h in held], np.zeros(0, dtype=t)]).astype(t, copy=False) for n, t in ANCHOR}
            rows = sent(a, groups, most)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "key", "blob"])

        for b in batches:
            ids = b.column(0).to_numpy().astype(np.int64)
            for first, part in in_parts(b.column(1), min(PART, 1 << bits - 1)):
                for i, piece, starts in _fitting(part, ids[first : first + len(part)], min(PART, 1 << bits - 1)):
                    got = anchors_of(piece, i, starts, bits)
                    held.append(got)
                    size += len(got["h"])
                    if size > chunk:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
            held = []
        give_back()

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.kind.iloc[0] != ANCHORS:
            return pdf
        out = _frame(indexed(gathered(pdf.blob, ANCHOR), groups, batch_size))
        give_back()
        return out

    known = saved(whole.mapInArrow(scan, ROWS).groupBy("kind", "key").applyInPandas(shard, ROWS), "suffixes")
    asked = known.where(F.col("kind") == REQUESTS).select("key", "blob")
    ids = _ids_in(asked, REQUEST)
    texts = _texts(whole, groups, among_hashes(ids))  # others are asked for nothing
    dropped(ids)

    def fetch(requests: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        r = gathered(requests.blob, REQUEST)
        if not len(r["id"]):
            return _frame([])
        at = np.lexsort((r["lo"], r["id"]))
        r = {n: v[at] for n, v in r.items()}
        begin = np.flatnonzero(np.concatenate([[True], r["id"][1:] != r["id"][:-1]]))
        place = {int(r["id"][b]): (b, e) for b, e in zip(begin, np.append(begin[1:], len(at)), strict=True)}
        pieces = [b""] * len(at)
        for i, t, _ in _unpacked(text.blob):
            if i in place:
                for j in range(*place[i]):
                    pieces[j] = t[r["lo"][j] : int(r["lo"][j]) + int(r["run"][j]) + LENGTH]
        out = []
        hot = r["hot"] == 1
        cold = np.flatnonzero(~hot)
        key = (r["h"][cold] % np.uint64(groups)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        for rows in np.split(cold[order], np.flatnonzero(np.diff(key[order])) + 1) if len(cold) else []:
            head = pack({n: r[n][rows] for n, _ in CONTEXT}, CONTEXT)
            raw = zstandard.ZstdCompressor(level=3).compress(b"".join(pieces[j] for j in rows))
            out.append((CONTEXTS, int(r["h"][rows[0]] % np.uint64(groups)), np.int64(len(head)).tobytes() + head + raw))
        rows = np.flatnonzero(hot)
        if len(rows):
            sizes = np.array([len(pieces[j]) for j in rows])
            w = _windows(np.frombuffer(b"".join(pieces[j] for j in rows), dtype=np.uint8), np.cumsum(sizes) - sizes, {n: r[n][rows] for n, _ in CONTEXT})
            s = np.lexsort((w["p"], w["id"], w["w"]))
            out += repeated({n: v for n, v in w.items()}, groups)  # known here already
            first = s[np.concatenate([[True], w["w"][s][1:] != w["w"][s][:-1]])]  # the earliest of each window goes on
            w = {n: v[first] for n, v in w.items()}
            out += dealt(WINDOWS, (w["w"] % np.uint64(groups)).astype(np.int64), w, WINDOW_T)
        give_back()
        return _frame(out)

    fetched = saved(asked.groupBy("key").cogroup(texts.groupBy("key")).applyInPandas(fetch, ROWS), "contexts")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.kind.iloc[0] == SPANS:
            return pdf
        if pdf.kind.iloc[0] == WINDOWS:
            out = _frame(repeated(gathered(pdf.blob, WINDOW_T), groups))
            give_back()
            return out
        heads, raws = [], []
        for blob in pdf.blob:
            n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
            heads.append(blob[8 : 8 + n])
            raws.append(zstandard.ZstdDecompressor().decompress(blob[8 + n :]))
        r = gathered(heads, CONTEXT)
        sizes = r["run"].astype(np.int64) + LENGTH
        out = _frame(repeated(_windows(np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum(sizes) - sizes, r), groups))
        give_back()
        return out

    partial = saved(fetched.groupBy("kind", "key").applyInPandas(compare, ROWS), "partial")
    dropped(fetched)
    return whole, known.where(F.col("kind") == SPANS).select("key", "blob").unionAll(partial.select("key", "blob")), groups


def _fitting(texts: list[bytes], ids: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(ids, texts, their starts): the texts as they are, or pieces of at most ``most`` bytes of a longer one, each by itself."""
    small = [k for k, t in enumerate(texts) if len(t) <= most]
    if small:
        yield ids[small], [texts[k] for k in small], np.zeros(len(small), dtype=np.int64)
    for k, t in enumerate(texts):
        if len(t) > most:
            for at in range(0, len(t) - 2 * LENGTH, most - 2 * LENGTH):
                yield ids[k : k + 1], [t[at : at + most]], np.array([at])


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs) for sorted spans."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for s, e in spans:
        if s > end:
            kept.append(text[at:s])
            runs += 1
            at = end = s
        if e > end:
            removed += e - end
            at = end = e
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def deduplicated(docs: DataFrame, id_col: str = "doc_id", as_text: bool = False, **sizes: int) -> DataFrame:
    """A row for each row: id, n_bytes, n_removed, n_spans, kept: the bytes left, or with ``as_text`` their text without cut characters."""
    whole, spans, groups = deduplicated_spans(docs, id_col, **sizes)
    ids = _ids_in(spans, SPAN_T)
    may = among_hashes(ids)
    cut_in = among(may)(F.col("id"))
    dropped(ids)
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(text: pd.DataFrame, removed: pd.DataFrame) -> pd.DataFrame:
        r = gathered(removed.blob, SPAN_T)
        at = np.lexsort((r["e"], r["s"], r["id"]))
        ids, s, e = (r[n][at] for n in ("id", "s", "e"))
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, dtype=np.int64)
        place = {int(ids[b]): (b, x) for b, x in zip(begin, np.append(begin[1:], len(ids)), strict=True)} if len(ids) else {}
        out = []
        for i, t, named in _unpacked(text.blob):
            b, x = place.get(i, (0, 0))
            kept, n, runs = cut(t, [(min(p, len(t)), min(q, len(t))) for p, q in zip(s[b:x].tolist(), e[b:x].tolist(), strict=True)])
            out.append((i if named else None, len(t), n, runs, kept.decode("utf-8", "ignore") if as_text else kept))
        ids = pd.Series([x[0] for x in out], dtype=object)  # whole numbers beside None
        give_back()
        return pd.DataFrame(out, columns=[id_col, "n_bytes", "n_removed", "n_spans", "kept"]).assign(**{id_col: ids})

    schema = f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    texts = _texts(whole, groups, may)
    changed = texts.groupBy("key").cogroup(spans.groupBy("key")).applyInPandas(finish, schema)
    id_ = F.when(~F.col("unnamed"), F.col("id")).cast(kind).alias(id_col)
    none = F.lit(0).cast("long")
    same = whole.where(~cut_in).select(id_, F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), (F.col("text") if as_text else F.encode("text", "UTF-8")).alias("kept"))
    return changed.unionAll(same)


def cleaned(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows with repeated passages cut out of their texts; n_chars follows, and rows left without text go.

    A character of which a byte is removed is removed. Other columns come by the id.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, row_key(F.col(id_col).cast("long")).alias("key"), F.col("text"))
    left = deduplicated(keyed.select("key", "text"), "key", True).where("kept <> ''").groupBy("key").agg(F.first("kept").alias("kept"))
    both = keyed.select("row", "key").join(left, "key")
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
