"""Word and shingle hashes of many texts at once, on arrays of bytes."""

import numpy as np

SHINGLE = 5
_MULTIPLIER = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts])


def word_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word values[start:end].

    A word's hash is the sum of a scattered 64-bit value for each (place in the word, value), and its
    length.  No structure of words carries over to the sums, as it does with polynomials modulo 2^64.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, dtype=np.uint64)
    upto = np.cumsum(size)
    place = np.arange(upto[-1]) - np.repeat(upto - size, size)
    at = place + np.repeat(starts, size)
    with np.errstate(over="ignore"):
        x = mix((place.astype(np.uint64) << np.uint64(21) | values[at].astype(np.uint64)) + np.uint64(_MULTIPLIER))
        return mix(np.add.reduceat(x, upto - size) + size.astype(np.uint64) * np.uint64(_MULTIPLIER))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, A-Z lower-cased; number of words of each text)."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, begins))
    return word_sums(data, starts, ends), counts


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, the text each belongs to, both ordered by text and hash; number of each text).

    A text of fewer than ``width`` words has its whole sequence as one shingle.
    """
    words, counts = word_hashes(texts)
    begins = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    n = len(words)
    with np.errstate(over="ignore"):
        consts = mix(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
        full = np.zeros(0, dtype=np.uint64)
        of = np.zeros(0, dtype=np.int64)
        if n >= width:
            m = n - width + 1
            full = words[:m] * consts[0]
            for k in range(1, width):
                full = full + words[k : k + m] * consts[k]
            ok = doc[:m] == doc[width - 1 :]
            full, of = mix(full[ok]), doc[:m][ok]
        few = np.flatnonzero((counts > 0) & (counts < width))
        short = np.zeros(len(few), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[few] > k
            short[has] += words[begins[few[has]] + k] * consts[k]
        short = mix(short + counts[few].astype(np.uint64))
    keys, docs = np.concatenate([full, short]), np.concatenate([of, few])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
        keys, docs = keys[new], docs[new]
    return keys, docs, np.bincount(docs, minlength=len(texts))
