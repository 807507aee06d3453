"""N-gram Jaccard join by vertical partitioning.

Documents with equal shingle sets form one class, which joins as one.  The
order of shingles is cut into fragments, ranges of their hashes.

1. Each part of the input sends its shingles to their fragments; a fragment
   counts, for each document, those that some other document has too.  A
   document of which too few are shared cannot link (a pair shares
   ceil(t n) shingles of each), so its text goes no further.  A shingle that
   several documents of a part have goes as one mark, so frequent ones stay few.
2. The sets of the classes left are stored.  Shared shingles are ordered by how
   many classes have them, rare ones first.  Classes that link meet at the first
   shingle in that order which they have in common, and it lies in the prefix
   of both (the first n - ceil(t n) + 1).  There the places of that shingle in both sets bound
   the overlap: min(n - place) of both must reach what the threshold asks for.
3. Of the classes at a shingle, the one where it comes first (it has the fewest
   rare shingles) is the hub, and pairs with those whose bound allows it.
   The sets of candidate pairs are cut into fragments; each fragment counts
   partial overlaps by itself, and the counts are summed per pair and held against the threshold.
4. What the hubs linked forms components.  Pairs that are in different ones
   still, and that the bound allows, are all tested in a second round: at each shingle
   the classes outside of its largest component against all of similar size.  So no link between
   components is lost, and members of one component are never paired.

Shingles are identified by 64-bit hashes without algebraic structure, classes by
128 bits.  Rows of equal doc_id count as one document; so do rows without one of equal
text, under a number from 2^62 on, which also names a component that has no id.  Null text and text without words
have an empty set and link with nothing.  An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.hashing import mix, shingle_sets
from tarn.llm.shared import among, among_hashes, components, dropped, give_back, in_parts, row_key, saved, text_or_empty

NUMERATOR, DENOMINATOR = 75, 100
FRAGMENT_BYTES = 8 << 20
VERTICAL, SHARDS = 3, 64
PAIRS = 250  # of one lead in a shard; a hub is sent to each of its shards
HELD = 1_000_000  # shingles of one part of the input
PART = 250_000  # bytes of text looked at together
NONE = 0xFFFFFFFF  # in place of a document: several of the part have the shingle


def _digests(keys: np.ndarray, docs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two sums over each set, as 16 bytes a document."""
    out = np.zeros((len(n), 2), dtype=np.uint64)
    if len(keys):
        has = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[has]
        for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
            out[has, k] = np.add.reduceat(mix(keys ^ np.uint64(salt)), at)
    return out


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit values, byte planes apart, compressed."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c, dtype="<u4").view(np.uint8).reshape(n, 4).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, columns: int = 2) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    planes = raw.reshape(columns, 4, -1)
    return [np.ascontiguousarray(x.T).view("<u4").ravel() for x in planes]


def _cut(keys: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, 32 bits of the place in it) of each hash, in the order of hashes."""
    wide = (keys >> np.uint64(20)) * np.uint64(fragments)  # 44 bits and up to 2^20 fragments
    return (wide >> np.uint64(44)).astype(np.int64), ((wide >> np.uint64(12)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _header(ids: list, n: np.ndarray, cids: np.ndarray, shared: np.ndarray, kind: pa.DataType) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n), pa.array([c.tobytes() for c in cids], pa.binary()), pa.array(shared)], names=["id", "n", "cid", "shared"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _part_rows(chunk: int, ids: list, keys: np.ndarray, of: np.ndarray, n: np.ndarray, fragments: int, kind: pa.DataType) -> list[tuple[int, int, bytes]]:
    """(fragment, chunk, blob) rows of one part of the input; its header has a negative number instead of a fragment."""
    cids = _digests(keys, of, n)
    first = np.zeros(len(n), dtype=bool)
    first[np.unique(cids, axis=0, return_index=True)[1]] = True  # one of equal documents here
    keep = first[of]
    keys, of = keys[keep], of[keep]
    at = np.argsort(keys, kind="stable")
    keys, of = keys[at], of[at]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(begin, len(keys)))
    shared = np.bincount(of[np.repeat(size > 1, size)], minlength=len(n)).astype(np.int64)
    who = np.where(size > 1, NONE, of[begin])
    f, low = _cut(keys[begin], fragments)
    cut = np.flatnonzero(np.diff(f)) + 1 if len(f) else []
    out = [(-1 - chunk, chunk, _header(ids, n, cids, shared, kind))]
    for x, w, k in zip(np.split(low, cut), np.split(who, cut), np.split(f, cut), strict=True) if len(f) else ():
        out.append((int(k[0]), chunk, _packed(x, w)))
    return out


def _requests(docs: DataFrame, id_col: str, fragments: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            counts = [h[3] for h in held]
            before = np.cumsum([0] + [len(c) for c in counts])
            of = np.concatenate([h[2] + b for h, b in zip(held, before, strict=False)])
            rows = _part_rows(chunk, [i for h in held for i in h[0]], np.concatenate([h[1] for h in held]), of, np.concatenate(counts).astype(np.int64), fragments, kind)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["f", "chunk", "blob"])

        size = 0
        for b in batches:
            for first, part in in_parts(b.column(1), PART):
                keys, of, n = shingle_sets(part)
                held.append((b.column(0).slice(first, len(part)).to_pylist(), keys, of, n))
                size += len(keys)
                if size >= HELD:
                    yield flush()
                    chunk, size = chunk + 1, 0
        if held:
            yield flush()
        give_back()

    return docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text")).mapInArrow(run, "f long, chunk long, blob binary")


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within a fragment: for each part, how many of a document's shingles another one has too. Headers pass."""
    if pdf.f.iloc[0] < 0:
        return pdf
    low, who = (list(x) for x in zip(*map(_unpacked, pdf.blob), strict=True))
    sizes = [len(x) for x in low]
    low, who = np.concatenate(low), np.concatenate(who)
    at = np.argsort(low, kind="stable")
    same = low[at][1:] == low[at][:-1]
    many = np.zeros(len(low), dtype=bool)
    many[at[1:][same]] = True
    many[at[:-1][same]] = True
    many &= who != NONE
    blobs = []
    for i, end in enumerate(np.cumsum(sizes)):
        s = slice(end - sizes[i], end)
        doc, count = np.unique(who[s][many[s]], return_counts=True)
        blobs.append(_packed(doc, count))
    give_back()
    return pdf.assign(blob=blobs)


def _told(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part: id, n, cid and the number of shingles that no other document was found to have."""
    head = pdf.f < 0
    raw = zstandard.ZstdDecompressor().decompress(pdf.blob[head].iloc[0])
    out = pa.ipc.open_stream(raw).read_pandas()
    shared = out.shared.to_numpy().copy()
    for blob in pdf.blob[~head]:
        doc, count = _unpacked(blob)
        shared[doc] += count  # each document once
    # documents of equal sets have the counts of the first
    _, place = np.unique(np.frombuffer(b"".join(out.cid), dtype=np.uint64).reshape(-1, 2), axis=0, return_inverse=True)
    place = place.ravel()
    most = np.zeros(len(shared), dtype=np.int64)
    np.maximum.at(most, place, shared)
    return out.assign(u=out.n - most[place])[["id", "n", "cid", "u"]]


def _profiles(docs: DataFrame, id_col: str, fragments: int) -> DataFrame:
    """A row a document: id, n, cid, u (shingles that it shares with no other set, at most)."""
    kind = docs.schema[id_col].dataType.simpleString()
    answers = saved(_requests(docs, id_col, fragments).groupBy("f").applyInPandas(_answers, "f long, chunk long, blob binary"), "answers")
    out = saved(answers.groupBy("chunk").applyInPandas(_told, f"id {kind}, n long, cid binary, u long"), "profiles")
    dropped(answers)
    return out


def _spare(n: Column) -> Column:
    """How many shingles a class can have that its partner lacks."""
    return n - F.ceil(n * NUMERATOR / DENOMINATOR)


def _sets(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """cls (its smallest document id), n and keys (array<long>) of each class in ``alive`` (cid, rep, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in in_parts(b.column(0), PART):
                keys, of, n = shingle_sets(part)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in _digests(keys, of, n)], pa.binary()), lists], names=["cid", "keys"])
        give_back()

    wanted = alive.select(F.col("rep").alias("id"))
    texts = docs.where(among(among_hashes(wanted))(F.col("id"))).join(wanted, "id", "left_semi").select(text_or_empty().alias("text"))
    one = texts.mapInArrow(run, "cid binary, keys array<bigint>").groupBy("cid").agg(F.first("keys").alias("keys"))
    return saved(one.join(alive, "cid").select(F.col("rep").alias("cls"), "n", "keys"), "sets")


def _members(sets: DataFrame) -> DataFrame:
    """key, cls, n, pos: the shared shingles in the prefix of each class, and their places in its order."""
    flat = sets.select("cls", "n", F.explode("keys").alias("key"))
    often = saved(flat.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    order = F.struct(F.floor(F.log2("c")).cast("int").alias("o"), F.col("key").alias("key"))
    shared = flat.join(often, "key").groupBy("cls", "n").agg(F.array_sort(F.collect_list(order)).alias("s"))  # a class's own shingles
    own = F.col("n") - F.size("s")
    prefix = shared.select("cls", "n", own.alias("own"), F.expr("slice(s, 1, greatest(0, cast({} as int)))".format(f"n - ceil(n * {NUMERATOR} / {DENOMINATOR}) + 1 - (n - size(s))")).alias("s"))
    out = saved(prefix.select("cls", "n", "own", F.posexplode("s").alias("i", "x")).select(F.col("x.key").alias("key"), "cls", "n", (F.col("own") + F.col("i")).alias("pos")), "members")
    dropped(often)
    return out


def _allowed() -> Column:
    """The bound on the overlap of two classes (n, pos) and (m, at) at a shingle lets them link."""
    left = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    return (NUMERATOR + DENOMINATOR) * left >= NUMERATOR * (F.col("n") + F.col("m"))


def _segments(sets: DataFrame) -> DataFrame:
    """w, v, cls, keys: each set (cls, keys, shards) in VERTICAL fragments of the order of hashes, for each of its shards."""
    cut = [((k << 64) // VERTICAL) for k in range(1, VERTICAL)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                w, v, row, out = [], [], [], []
                lists = part.column(1)
                keys, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                for i, shards in enumerate(part.column(2).to_pylist()):
                    mine = np.sort(keys[ends[i - 1] if i else 0 : ends[i]])
                    for k, x in enumerate(np.split(mine, np.searchsorted(mine, np.array(cut, dtype=np.uint64)))):
                        raw = x.astype("<u8").tobytes()
                        for shard in shards:
                            w.append(shard)
                            v.append(k)
                            row.append(i)
                            out.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(v, pa.int32()), part.column(0).take(pa.array(row, pa.int64())), pa.array(out, pa.binary())], names=["w", "v", "cls", "keys"])
        give_back()

    kind = sets.schema["cls"].dataType.simpleString()
    return sets.select("cls", "keys", "shards").mapInArrow(run, f"w int, v int, cls {kind}, keys binary")


def _overlaps(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Partial overlaps of the pairs in one fragment."""
    at = {c: i for i, c in enumerate(sets.cls)}
    keys = [np.frombuffer(k, dtype="<u8") for k in sets["keys"]]
    out_a, out_b, part = [], [], []
    for a, own in pairs.groupby("a", sort=False):
        if (i := at.get(a)) is None or not len(keys[i]):
            continue
        mine = keys[i]
        others = [keys[at[b]] if b in at else mine[:0] for b in own.b]
        sizes = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
        flat = np.concatenate([*others, mine[:0]])
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        hit = np.concatenate([[0], np.cumsum(mine[place] == flat)])
        ends = np.cumsum(sizes)
        out_a += [a] * len(others)
        out_b += own.b.tolist()
        part.append(hit[ends] - hit[ends - sizes])
    give_back()
    return pd.DataFrame({"a": out_a, "b": out_b, "part": np.concatenate([*part, np.zeros(0, dtype=np.int64)]).astype(np.int64)})


def _verified(pairs: DataFrame, sets: DataFrame, shards: int) -> DataFrame:
    """The pairs (a, b, na, nb, lead) that link: partial overlaps by fragment, summed per pair.

    Pairs go to shards by the smallest lead of their second class, so what
    belongs together meets and a set is sent once or a few times; a lead of
    many pairs is split over shards by the second class.
    """
    leads = pairs.groupBy("b").agg(F.min("lead").alias("top"), F.count(F.lit(1)).alias("c"))
    parts = leads.groupBy("top").agg(F.ceil(F.sum("c") / PAIRS).cast("int").alias("parts"))
    home = saved(leads.join(parts, "top").select(F.col("b").alias("hb"), F.pmod(F.xxhash64("top", F.pmod(F.xxhash64("b"), F.col("parts"))), F.lit(shards)).cast("int").alias("w")), "homes")
    placed = saved(pairs.join(home, F.col("b") == F.col("hb")).select("w", "a", "b"), "placed")
    need = placed.select("w", F.col("a").alias("cls")).unionAll(placed.select("w", "b")).groupBy("cls").agg(F.collect_set("w").alias("shards"))  # at most ``shards``
    sent = _segments(sets.join(need, "cls"))
    asked = placed.select(F.col("w").alias("pw"), F.explode(F.sequence(F.lit(0), F.lit(VERTICAL - 1))).alias("pv"), "a", "b")
    kind = sets.schema["cls"].dataType.simpleString()
    total = sent.groupBy("w", "v").cogroup(asked.groupBy("pw", "pv")).applyInPandas(_overlaps, f"a {kind}, b {kind}, part long").groupBy("a", "b").agg(F.sum("part").alias("both"))
    out = saved(pairs.join(total, ["a", "b"]).where(DENOMINATOR * F.col("both") >= NUMERATOR * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "ngram-links")
    dropped(home, placed)
    return out


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb, lead) of the hub of a shingle and another class that it may link with."""
    first = F.min(F.struct(F.col("pos").alias("at"), F.col("n").alias("m"), F.xxhash64("cls").alias("h"), F.col("cls").alias("hub")))
    hubs = saved(members.groupBy("key").agg(first.alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "x.*"), "hubs")
    met = members.join(hubs, "key").where((F.col("cls") != F.col("hub")) & _allowed())
    pairs = met.groupBy(F.col("hub").alias("a"), F.col("cls").alias("b")).agg(F.first("m").alias("na"), F.first("n").alias("nb"), F.first("h").alias("lead"))
    out = saved(pairs, "pairs")
    dropped(hubs)
    return out


def _open_pairs(members: DataFrame, component: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb, lead) of classes in different components that may link and have not been tested."""
    held = saved(members.join(component.withColumnRenamed("id", "cls"), "cls", "left").select("key", "cls", "n", "pos", F.coalesce("component", "cls").alias("comp")), "held")
    sizes = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_ = saved(sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "main"), "open")
    # Linked sizes differ by the factor of the threshold at most: their logarithms to that base are neighbours.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int")
    rest = saved(held.join(open_, "key").select("key", "cls", "n", "pos", "comp", "main", band.alias("band")), "rest")
    minor = rest.where("comp <> main").select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("cls").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("theirs"))
    near = rest.join(minor, ["key", "band"]).where((F.col("comp") != F.col("theirs")) & _allowed())
    sides = F.col("cls") < F.col("other")
    pick = lambda x, y: F.when(sides, F.col(x)).otherwise(F.col(y))
    pairs = near.select(pick("cls", "other").alias("a"), pick("other", "cls").alias("b"), pick("n", "m").alias("na"), pick("m", "n").alias("nb")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = saved(pairs.join(done, ["a", "b"], "left_anti").withColumn("lead", F.xxhash64("a")), "open-pairs")
    dropped(held, open_, rest)
    return out


def joined(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_shingles and component_id of every row."""
    if docs.where(F.col(id_col).isNull()).limit(1).count():
        unnamed = docs.where(F.col(id_col).isNull()).select(_key(docs, id_col).alias("_u")).distinct()
        out = joined(docs.select(_key(docs, id_col).alias(id_col), "text"), id_col).join(unnamed, F.col(id_col) == F.col("_u"), "left")
        return out.select(F.when(F.col("_u").isNull(), F.col(id_col)).alias(id_col), "n_shingles", "component_id")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fragments = min(1 << 20, max(32, int(total * 4 // (6 * FRAGMENT_BYTES)) + 1))  # four bytes a shingle, one for six bytes of text
    rows = _profiles(docs, id_col, fragments)
    classes = saved(rows.where("n > 0").groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min("u").alias("u")), "classes")
    alive = classes.where(F.col("u") <= _spare(F.col("n"))).select("cid", "rep", "n")
    texts = docs.select(F.col(id_col).alias("id"), "text")
    sets = _sets(texts, alive)
    left = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(SHARDS, int(left * 8 // (VERTICAL * FRAGMENT_BYTES)) + 1)  # so that a shard's fragment stays small
    members = _members(sets)
    pairs = _hub_pairs(members)
    links = _verified(pairs, sets, shards)
    found = saved(components(links), "components")
    more = _open_pairs(members, found, pairs)
    if more.limit(1).count():
        found = saved(components(links.unionAll(_verified(more, sets, shards))), "components")
    dropped(sets, members, pairs, more)
    named = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("cid", "rep", "component")
    out = rows.join(named, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"))


def _key(docs: DataFrame, id_col: str):
    """``row_key`` in a type that holds it: string ids stay strings, whole numbers become long."""
    of = docs.schema[id_col].dataType.simpleString()
    if of == "string":
        return F.coalesce(F.col(id_col), row_key(F.lit(None).cast("long")).cast("string"))
    return row_key(F.col(id_col).cast("long"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each group stays: that of the smallest id. Repeated rows of it stay too."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(docs, id_col).alias("key"), "text")
    kept = joined(keyed.select("key", "text"), "key").where(F.col("component_id") == F.col("key")).select("key").distinct()
    return keyed.join(kept, "key", "left_semi").select("row.*")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
