"""Fill-in-middle transformation by a parallel automaton scan.

A text is a tape of bytes for an automaton of four states: after a non-letter, after a letter, after
``<``, after ``<`` and one of P, S, M.  It counts tokens (``[A-Za-z]+|[^A-Za-z]``, a token where one begins)
and markers (``<P>``, ``<S>``, ``<M>``).  What a stretch of bytes does to the state is a function of four states, held in
one byte; functions compose by a table, so a tree of compositions gives the state before every four bytes at
once, and counts follow from state and bytes.  Many texts make one tape, with a reset between them.

Documents over CHUNK bytes are dealt out as chunks, wherever these cut characters or words: each chunk emits
its function and its counts for each state that it may be entered in.  Composing the functions in order resolves
the states, the counts before each chunk tell which chunks hold the cuts, and only these are looked into again.

Null text counts as empty; an empty text is plain with n = 0.  A row without an id hashes ``1:`` alone.
Rows of equal id are transformed each by its own text, equal rows equally.  A column of the input that
has the name of a new one (n, form, prefix_chars, middle_chars, output) is replaced, others stay.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import give_back, in_parts, text_or_empty

CHUNK = 1 << 16  # bytes; longer documents are scanned in chunks
PART = 1 << 20  # bytes of short texts on one tape
MARKERS = ("<P>", "<S>", "<M>")

#: States, and classes of bytes; a continuation byte changes nothing, a reset leads to AFTER_OTHER.
AFTER_OTHER, AFTER_LETTER, OPENED, NAMED = range(4)
LETTER, NAME, OPEN, CLOSE, OTHER, INNER, RESET = range(7)
WIDTH = 4  # bytes that a leaf of the tree stands for


def _step(state: int, kind: int) -> tuple[int, int, int]:
    """(next state, tokens begun, markers ended)"""
    if kind == INNER:
        return state, 0, 0
    if kind == RESET:
        return AFTER_OTHER, 0, 0
    if kind in (LETTER, NAME):
        return NAMED if kind == NAME and state == OPENED else AFTER_LETTER, int(state in (AFTER_OTHER, OPENED)), 0
    return OPENED if kind == OPEN else AFTER_OTHER, 1, int(kind == CLOSE and state == NAMED)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.uint8)
    for first in (ord("A"), ord("a")):
        out[first : first + 26] = LETTER
    out[[ord(m[1]) for m in MARKERS]] = NAME
    out[ord("<")], out[ord(">")] = OPEN, CLOSE
    out[0x80:0xC0] = INNER
    out[0xFF] = RESET  # never a byte of UTF-8
    return out


def _leaves() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of WIDTH classes: its function; tokens, markers for each state before it; characters."""
    runs = np.stack(np.unravel_index(np.arange(7**WIDTH), (7,) * WIDTH), axis=1)
    steps = np.array([[_step(s, k) for k in range(7)] for s in range(4)])
    state = np.tile(np.arange(4), (len(runs), 1))
    tokens, markers = np.zeros_like(state), np.zeros_like(state)
    for j in range(WIDTH):
        got = steps[state, runs[:, j : j + 1]]
        state, tokens, markers = got[..., 0], tokens + got[..., 1], markers + got[..., 2]
    chars = ((runs != INNER) & (runs != RESET)).sum(axis=1)
    return packed(state), tokens.astype(np.uint8), markers.astype(np.uint8), chars.astype(np.uint8)


def packed(to: np.ndarray) -> np.ndarray:
    """Functions (rows of four next states) as bytes, two bits for each."""
    return (to << np.array([0, 2, 4, 6])).sum(axis=-1).astype(np.uint8)


APPLY = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)  # function, state -> state
COMPOSE = packed(APPLY[np.arange(256)[None, :, None], APPLY[:, None, :]])  # first function, second function
IDENTITY = int(packed(np.arange(4)))
CLASS = _classes()
FUNCTION, TOKENS, MARKS, CHARS = _leaves()


class Tape:
    """The tree of compositions over some bytes."""

    def __init__(self, data: np.ndarray):
        self.kinds = np.full(max(1, -(-len(data) // WIDTH)) * WIDTH, INNER, dtype=np.uint8)
        self.kinds[: len(data)] = CLASS[data]
        code = np.zeros(len(self.kinds) // WIDTH, dtype=np.int32)
        for j in range(WIDTH):
            code = code * 7 + self.kinds[j::WIDTH]
        self.code = code.astype(np.int16)
        self.levels = [FUNCTION[self.code]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = self.levels[-1] = np.append(low, np.uint8(IDENTITY))
            self.levels.append(COMPOSE[low[0::2], low[1::2]])

    @property
    def function(self) -> int:
        return int(self.levels[-1][0])

    def states(self, entry: int) -> np.ndarray:
        """The state before each leaf if the tape is entered in ``entry``."""
        state = np.array([entry], dtype=np.uint8)
        for low in reversed(self.levels[:-1]):
            down = np.empty(len(low), dtype=np.uint8)
            down[0::2] = state[: len(low) // 2]
            down[1::2] = APPLY[low[0::2], down[0::2]]
            state = down
        return state[: len(self.code)]

    def chars(self) -> np.ndarray:
        return CHARS[self.code]

    def counts(self, entry: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and markers in each leaf."""
        state = self.states(entry)
        return TOKENS[self.code, state], MARKS[self.code, state]

    def places(self, k: np.ndarray, entry: int, tokens: np.ndarray) -> np.ndarray:
        """The byte at which token k begins, counted from 0; k below the number of tokens."""
        upto = np.cumsum(tokens, dtype=np.int64)
        leaf = np.searchsorted(upto, k, side="right")
        left = k - (upto[leaf] - tokens[leaf])
        state, at = self.states(entry)[leaf].astype(np.int64), np.full(len(k), -1, dtype=np.int64)
        for j in range(WIDTH):
            kind = self.kinds[leaf * WIDTH + j]
            got = STEPS[state, kind]
            here = (got[:, 1] == 1) & (left == 0) & (at < 0)
            at[here] = leaf[here] * WIDTH + j
            left, state = left - got[:, 1], got[:, 0]
        return at


STEPS = np.array([[_step(s, k) for k in range(7)] for s in range(4)])


def cuts_of(texts: list[bytes], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, markers, characters before the first cut, before the second) of each text, all on one tape."""
    data = np.frombuffer(b"".join(b"\xff" + t for t in texts), dtype=np.uint8)
    tape = Tape(data)
    tokens, marks = tape.counts(AFTER_OTHER)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    inner = np.concatenate([[0], np.cumsum(tape.kinds != INNER)])  # characters and resets before each byte
    # tokens and markers before each text; a leaf across an edge is counted byte by byte
    n_before, m_before = (_before(tape, begin, c, which) for c, which in ((tokens, 1), (marks, 2)))
    n, m = np.diff(n_before), np.diff(m_before)
    out = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        at = begin[1:].copy()
        some = np.flatnonzero(k < n)
        at[some] = tape.places(n_before[:-1][some] + k[some], AFTER_OTHER, tokens)
        out.append(inner[at] - inner[begin[:-1]] - 1)
    return n, m, *out


def _before(tape: Tape, at: np.ndarray, counts: np.ndarray, which: int) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    leaf = np.minimum(at // WIDTH, len(counts) - 1)
    out, state = upto[leaf], tape.states(AFTER_OTHER)[leaf].astype(np.int64)
    for j in range(WIDTH):
        got = STEPS[state, tape.kinds[leaf * WIDTH + j]]
        out = out + np.where(leaf * WIDTH + j < at, got[:, which], 0)
        state = got[:, 0]
    return out


CUTS = ("n", "markers", "first", "second")


def _cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    a, b = (h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2))
    parts = [cuts_of(part, a[i : i + len(part)], b[i : i + len(part)]) for i, part in in_parts(texts, PART)]
    cols = [np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(np.int64) for k in range(4)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(CUTS))


CHUNKS = "key string, no int, bytes binary"
FUNCTIONS = "key string, no int, function int, tokens array<long>, markers array<long>, chars long"


def _chunked(giants: DataFrame, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                data = text.as_buffer()
                for no in range(-(-len(data) // chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([no], pa.int32()), pa.array([data.slice(no * chunk, min(chunk, len(data) - no * chunk)).to_pybytes()], pa.binary())], names=["key", "no", "bytes"])
        give_back()

    return giants.select("key", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, CHUNKS)


def _functions(chunks: DataFrame) -> DataFrame:
    """What each chunk does to the state, and what it counts, for each state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2):
                tape = Tape(np.frombuffer(data.as_buffer(), dtype=np.uint8))
                counts = [tape.counts(s) for s in range(4)]
                rows.append((tape.function, [int(c[0].sum()) for c in counts], [int(c[1].sum()) for c in counts], int(tape.chars().sum())))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.int64())], names=["key", "no", "function", "tokens", "markers", "chars"])
        give_back()

    return chunks.mapInArrow(run, FUNCTIONS)


LOCATED = "key string, n long, markers long, chars long, no array<int>, state array<int>, k array<long>, before array<long>"


def _located(functions: DataFrame) -> DataFrame:
    """For each document its counts, and for both cuts the chunk: its number, the state before it, the token in it, the characters before it.

    A group is the chunks of one document: at most 2 GB, the largest text of a row, by CHUNK.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no").drop_duplicates("no")
        state, states, tokens, markers = AFTER_OTHER, [], [], 0
        for f, t, m in zip(pdf.function, pdf.tokens, pdf.markers, strict=True):
            states.append(state)
            tokens.append(int(t[state]))
            markers += int(m[state])
            state = int(APPLY[f, state])
        upto, chars = np.cumsum(tokens), np.cumsum(pdf.chars.to_numpy())
        n = int(upto[-1])
        k = sorted(int(h) % (n + 1) for h in (pdf.h1.iloc[0], pdf.h2.iloc[0]))
        no = [int(np.searchsorted(upto, x, side="right")) for x in k]  # beyond the last: the end
        inside = [(j, states[j], x - int(upto[j]) + tokens[j], int(chars[j] - pdf.chars.iloc[j])) if j < len(states) else (-1, 0, 0, int(chars[-1])) for j, x in zip(no, k, strict=True)]
        return pd.DataFrame([(pdf.key.iloc[0], n, markers, int(chars[-1]), *[list(c) for c in zip(*inside, strict=True)])], columns=["key", "n", "markers", "chars", "no", "state", "k", "before"])

    return functions.groupBy("key").applyInPandas(run, LOCATED)


def _looked_up(chunk: int):
    def of(texts: pa.Array, no: pa.Array, state: pa.Array, k: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for text, nos, states, ks, befores in zip(texts, no.to_pylist(), state.to_pylist(), k.to_pylist(), before.to_pylist(), strict=True):
            data, got = text.as_buffer(), []
            for j, s, x, b in zip(nos, states, ks, befores, strict=True):
                if j >= 0:
                    tape = Tape(np.frombuffer(data.slice(j * chunk, min(chunk, len(data) - j * chunk)), dtype=np.uint8))
                    at = int(tape.places(np.array([x]), s, tape.counts(s)[0])[0])
                    b += int((tape.kinds[:at] != INNER).sum())
                got.append(b)
            out.append(got)
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(of, "array<long>")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""

    def parted(text: Column, marker: str) -> tuple[Column, Column]:
        at = F.instr(text, marker)
        return F.substring(text, F.lit(1), at - 1), F.substring(text, at + 3, F.length(text))

    body = F.substring(output, F.lit(4), F.length(output))
    prefix, tail = parted(body, "<S>")
    suffix, middle = parted(tail, "<M>")
    psm = F.concat(prefix, middle, suffix)
    suffix, tail = parted(body, "<P>")
    prefix, middle = parted(tail, "<M>")
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def transformed(docs: DataFrame, id_col: str = "doc_id", seed: int = 1, plain: int = 90, spm: int = 20, chunk: int = CHUNK) -> DataFrame:
    """The rows with n, form, prefix_chars, middle_chars and output; of 100 documents ``plain`` are transformed, ``spm`` of these with the suffix first."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    hs = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    keyed = docs.select(row, text_or_empty().alias("text"), digest.alias("digest")).select("row", "text", "digest", *hs)
    short = keyed.where(F.octet_length("text") <= chunk).withColumn("cuts", F.arrow_udf(_cuts, f"struct<{', '.join(f'{c}: long' for c in CUTS)}>")("text", "h1", "h2"))
    giants = keyed.where(F.octet_length("text") > chunk).withColumn("key", F.sha2(F.concat("digest", "text"), 256))
    functions = _functions(_chunked(giants, chunk).repartition("key", "no"))
    located = _located(functions.join(giants.select("key", "h1", "h2").distinct(), "key"))
    found = giants.join(located, "key").withColumn("at", _looked_up(chunk)(F.encode("text", "UTF-8"), "no", "state", "k", "before"))
    found = found.select("row", "text", "digest", "h1", "h2", "h3", "h4", F.struct("n", "markers", F.col("at")[0].alias("first"), F.col("at")[1].alias("second")).alias("cuts"))
    both = short.unionByName(found)
    is_plain = (F.col("text") == "") | (F.col("cuts.markers") > 0) | (F.col("h3") % 100 >= plain)
    form = F.when(is_plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    both = both.select("row", "text", "cuts", form.alias("form"))
    first, second = F.col("cuts.first").cast("int"), F.col("cuts.second").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first), F.substring("text", second + 1, F.length("text"))
    orders = {"psm": ("<P>", prefix, "<S>", suffix, "<M>", middle), "spm": ("<S>", suffix, "<P>", prefix, "<M>", middle)}
    output = reduce(lambda w, f: w.when(F.col("form") == f, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in orders[f]])), orders, F.when(F.col("form") == "plain", F.col("text")))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    new = {"n": F.col("cuts.n"), "form": F.col("form"), "prefix_chars": cut_only(F.col("cuts.first")), "middle_chars": cut_only(F.col("cuts.second") - F.col("cuts.first")), "output": output}
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
p AS (SELECT doc_id, t, n, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1:n], '') AS s,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
