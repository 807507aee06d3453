"""Byte-level BPE by a sentencepiece model serialised from the vocabulary.

Each token's bytes become characters (one for each byte value), each piece
scores minus its rank, and normalisation is the identity; sentencepiece then
merges as the ranks say.  A text is cut into pre-tokens by the pattern, each
pre-token is encoded by itself, and decoding maps ids back to bytes.  Tokens
that merges never reach are listed once (they are encoded by a look-up, as
byte-pair libraries do for a pre-token that is a token).

Null text counts as empty (no tokens); repeated rows give equal rows; an empty
table gives an empty result; other columns are ignored.  Texts of any length
are encoded whole.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.hashing import word_sums
from tarn.llm.shared import give_back, text_or_empty

#: Pre-tokens remembered in a worker before its memory is emptied.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def byte_characters() -> list[str]:
    """A printable character for each byte value: its own if printable in Latin-1, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, float or integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose id of a token is its rank; the unknown piece comes last."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(rank)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))  # model type BPE, size, unknown id
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, no trimming, no escapes
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


def classes() -> np.ndarray:
    """For each code point 0 letter, 1 number, 2 white space, 3 other, as the regex module has them."""
    import regex

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, 3, dtype=np.uint8)
    for kind, prop in enumerate((r"\p{L}+", r"\p{N}+", r"\s+")):
        for m in regex.finditer(prop, text):
            out[points[m.start() : m.end()]] = kind
    return out


#: The pattern that ``split`` carries out on arrays; others go through the regex module.
ARRAY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def split(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the matches of ARRAY_PATTERN in texts laid end to end; ``first`` has the place of each non-empty text."""
    n = len(points)
    kind = kinds[points]
    top = np.zeros(n + 1, dtype=bool)  # a text begins (or all have ended) here
    top[first] = top[n] = True
    start = np.ones(n, dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | top[1:n]
    space = kind == 2
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~top[1:n])  # white space before something else
    start[last] = True
    start[last + 1] = points[last] != 0x20  # one blank belongs to what follows
    mark = np.flatnonzero(points[:-1] == 0x27) if n else np.zeros(0, dtype=np.int64)
    mark = mark[start[mark] & ~top[mark + 1]]
    padded = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
    one = np.isin(padded[mark + 1], np.frombuffer("stmd".encode("utf-32-le"), dtype="<u4"))
    two = np.zeros(len(mark), dtype=bool)
    for pair in ("re", "ve", "ll"):
        two |= (padded[mark + 1] == ord(pair[0])) & (padded[mark + 2] == ord(pair[1])) & ~top[np.minimum(mark + 2, n)]
    for hit, size in ((one, 1), (two, 2)):
        at = mark[hit]
        start[at + 1] = False
        after = at + 1 + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Codec:
    """Encodes many texts at once: pre-tokens get 64-bit hashes (``word_sums``), and only new ones go to sentencepiece."""

    PART = 1_500_000  # code points worked on at once

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens, self.pattern = tokens, pattern
        self.find = regex.compile(pattern).finditer
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.chars = {b: ord(c) for b, c in enumerate(byte_characters())}
        written = [self._write(t) for t in tokens]
        self.unreached = {t: i for i, (t, got) in enumerate(zip(tokens, self.model.encode(written), strict=True)) if got != [i]}
        self.kinds = classes()
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.forget()

    def forget(self) -> None:
        """Empties the memory of pre-tokens; workers live on between tasks."""
        self.place: dict[int, int] = {}
        self.flat, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def _write(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.chars)

    def _learn(self, words: list[str], hashes: list[int]) -> None:
        raws = [w.encode() for w in words]
        ids = self.model.encode([self._write(r) for r in raws])
        if self.unreached:
            ids = [[self.unreached[r]] if r in self.unreached else i for r, i in zip(raws, ids, strict=True)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.place.update(zip(hashes, range(len(self.sizes), len(self.sizes) + len(ids)), strict=True))
        self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), dtype="<u4", count=int(sizes.sum()))])
        self.sizes = np.concatenate([self.sizes, sizes])

    def _part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        n = len(points)
        if not n:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        if self.pattern == ARRAY_PATTERN:
            starts = split(points, begins[lengths > 0], self.kinds)
            ends = np.append(starts[1:], n)
        else:
            spans = [(b + m.start(), b + m.end()) for t, b in zip(texts, begins.tolist(), strict=True) for m in self.find(t)]
            starts, ends = (np.array([s[k] for s in spans], dtype=np.int64) for k in (0, 1))
        h = word_sums(points, starts, ends)
        distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.place) + len(keys) > REMEMBERED:
            self.forget()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            self._learn([whole[starts[i] : ends[i]] for i in at[new]], [keys[i] for i in new])
        stored = np.fromiter(map(self.place.__getitem__, keys), dtype=np.int64, count=len(keys))[inverse]
        size = self.sizes[stored]
        upto = np.cumsum(size)
        froms = (np.cumsum(self.sizes) - self.sizes)[stored]
        ids = self.flat[np.repeat(froms - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        per_text = np.diff(np.concatenate([[0], upto])[np.searchsorted(starts, np.append(begins, n))])
        return ids, per_text

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        part: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            part.append(t)
            size += len(t)
            if size >= self.PART or i == len(texts) - 1:
                ids, counts = self._part(part)
                yield from np.split(ids, np.cumsum(counts)[:-1])
                part, size = [], 0

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        upto = np.cumsum(size)
        return self.bytes[np.repeat(self.offsets[ids] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker."""
    return Codec(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids (array<int>) and decoded (binary)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, sha, back, ids_out, raw_out = [], [], [], [], []
            for ids in c.encode_many(b.column(1).to_pylist()):
                raw = c.decode(ids)
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    ids_out.append(ids.astype(np.int32))
                    raw_out.append(raw)
            more = [pa.array(ids_out, pa.list_(pa.int32())), pa.array(raw_out, pa.binary())] if with_ids else []
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(more)]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), *more], names=names)
        c.forget()
        give_back()

    return docs.select(id_col, text_or_empty().alias("text")).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
