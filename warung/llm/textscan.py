"""Byte-level text scanning in numpy, used inside Spark tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes.  Hashes are polynomial
over 64-bit random byte values (wrapping arithmetic, odd base), finished with
a mixing step, so any span's hash comes from two prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240607)
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX1, _MIX2, _SHIFT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """``base ** (0 .. n-1)`` modulo 2**64; kept and grown per process."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 22:
            _powers[str(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step: every input bit reaches every output bit."""
    h = (h ^ (h >> _SHIFT)) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> _SHIFT)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums ``P`` with ``P[j] - P[i]`` = the unnormalised hash of [i, j)."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_VALUES[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, independent of where it stands."""
    inverse = powers(len(prefix), _INVERSE)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def as_array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of the words."""
    edges = np.zeros(len(data) + 2, dtype=bool)
    edges[1:-1] = ~_SPACE[data]
    found = np.flatnonzero(edges[1:] != edges[:-1])
    return found[0::2], found[1::2]


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Starts and ends of the lines between ``\n`` bytes (at least one line)."""
    cuts = np.flatnonzero(data == 10)
    return np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(data)]))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += words[j:j + n] * _STEPS[j]
    return mix(total)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """One hash for a short sequence of word hashes, apart from any shingle's."""
    n = np.uint64(len(words))
    return mix((words * powers(len(words), _BASE)).sum(dtype=np.uint64, keepdims=True) + n)[0]


def document_set(data: bytes | None, k: int) -> np.ndarray:
    """Distinct ``k``-word shingle hashes (sorted) of the text, A-Z lower-cased;
    with fewer words the whole sequence as one; empty without words or text."""
    if not data:
        return np.empty(0, dtype=np.uint64)
    raw = as_array(data.lower())
    starts, ends = word_spans(raw)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    words = span_hashes(prefix_hash(raw), starts, ends)
    if len(words) < k:
        return sequence_hash(words).reshape(1)
    return np.unique(shingle_hashes(words, k))


def texts_of(batch: pa.RecordBatch, column: str = "text", rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Small slices of an Arrow batch with their texts as UTF-8 bytes."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, part.column(column).cast(pa.binary()).to_pylist()


def bounded(texts: list, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of the texts that hold ``most`` bytes together, or one longer text."""
    low = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"") + 1
        if size > most and k > low:
            yield low, k
            low, size = k, len(t or b"") + 1
    if low < len(texts):
        yield low, len(texts)


#: What operators keep in a worker from task to task, and how to let go of it.
kept: dict[str, Callable[[], None]] = {}


def forget(owner: str | None) -> None:
    """Lets go of what operators other than ``owner`` have kept in this worker."""
    for name, drop in kept.items():
        if name != owner:
            drop()


def give_back() -> None:
    """Returns this worker's free memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc's
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
         owner: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that does not hold other operators' caches, and gives
    its free memory back afterwards: workers live on in later stages, whose own
    memory comes on top."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


# ----------------------------------------------------- texts that must travel
SQUEEZED = ["_warung_z", "_warung_size"]


def squeezed(docs, keys: list[str], text_col: str):
    """``keys`` and the text as Zstandard bytes (``_warung_z``, of ``_warung_size`` bytes), for
    joins that move texts; a null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for part, texts in texts_of(batch, text_col):
                texts = [t or b"" for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()),
                     pa.array([len(t) for t in texts], pa.int64())], [*keys, "_warung_z", "_warung_size"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text_col).mapInArrow(lean(run), kinds + ", _warung_z binary, _warung_size long")


def opened(part: pa.RecordBatch) -> Iterator[bytes]:
    """The texts of rows made by ``squeezed``."""
    codec = pa.Codec("zstd")
    for z, size in zip(part.column("_warung_z").to_pylist(), part.column("_warung_size").to_pylist(), strict=True):
        yield codec.decompress(z, size, asbytes=True) if size else b""
