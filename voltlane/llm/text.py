"""Words, hashes and packed arrays shared by the text operators.

Everything here works on the bytes of a whole Arrow column at once: word boundaries come from a byte table, and a
word's hash from prefix sums of a polynomial modulo 2**64 with random byte values, so no Python object is made per
word. Work arrays cover at most ``BLOCK`` bytes of text (or one longer word), whatever the length of a document."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
U64 = np.uint64


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


#: Bytes that end a word, as the operators' contracts give them.
BLANKS = _bytes_in((0x20, 0x20), (0x09, 0x0D))
MARKS = _bytes_in((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Byte tables for texts as they are and with A-Z lower-cased.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

_random = np.random.Generator(np.random.PCG64(20240115))
_VALUES = [_random.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1) for _ in range(2)]
_BASES = [int(x) * 2 + 1 for x in _random.integers(2**40, 2**62, 2, dtype=np.int64)]
_WINDOW_BASES = [U64(int(x) * 2 + 1) for x in _random.integers(2**40, 2**62, 2, dtype=np.int64)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit. A bijection."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**0..B**n and their inverses modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = (BLOCK // 4 if n <= BLOCK // 4 else max(n, BLOCK + 4096)) + 1
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
                steps = np.full(size, U64(base))
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
        have = (tables[0], tables[1])
        if n <= BLOCK + 4096:
            _powers[which] = have
    return have


def release() -> None:
    """Give free memory back to the system. A worker is used again for other tasks, and up to one worker for each Python
    step of a task waits beside those that run, so what all of them hold adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, with ``release`` when it is done."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


@dataclass
class Words:
    """Words of several texts. Word ``w`` is ``data[starts[w]:ends[w]]``; text ``d`` has words first[d] up to
    first[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    fold: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of every word, in pieces of about BLOCK bytes."""
        n = len(self.starts)
        out = np.empty(n, dtype=U64)
        table = _VALUES[which][self.fold]
        w = 0
        while w < n:
            lo = self.starts[w]
            stop = max(w + 1, int(np.searchsorted(self.ends, lo + BLOCK, side="right")))
            hi = self.ends[stop - 1]
            powers, inverse = _power_tables(which, int(hi - lo))
            total = np.zeros(hi - lo + 1, dtype=U64)
            np.multiply(table[self.data[lo:hi]], powers[:hi - lo], out=total[1:])
            np.cumsum(total[1:], out=total[1:])
            s, e = self.starts[w:stop] - lo, self.ends[w:stop] - lo
            out[w:stop] = (total[e] - total[s]) * inverse[s]
            w = stop
        return mix(out)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def split_words(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = BLANKS, fold: np.ndarray = SAME) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``: longest runs of bytes not in ``ends_word``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], offsets.astype(np.int64) - lo
    inside = ~ends_word[fold[data]] if fold is not SAME else ~ends_word[data]
    n = len(data)
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        # A text ends its last word even where the next one follows without a blank.
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, starts, ends, first, fold)


def windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of ``size`` consecutive words, for every start; shorter by size - 1 than ``h``."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    base = _WINDOW_BASES[which]
    out = h[:n].copy()
    for k in range(1, size):
        out *= base
        out += h[k:k + n]
    return mix(out)


def text_pieces(batch: pa.RecordBatch, column: str, limit: int = 4 * BLOCK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of a string column in runs of rows of about ``limit`` bytes. Null counts as empty."""
    a = batch.column(column)
    a = a.cast(pa.large_string())
    n = len(a)

    def ends(a: pa.Array) -> np.ndarray:
        return np.frombuffer(a.buffers()[1], dtype=np.int64, count=a.offset + n + 1)[a.offset:]

    offsets = ends(a)
    # Nulls have no bytes as Spark writes them; other writers' batches are copied.
    if a.null_count and np.diff(offsets)[a.is_null().to_numpy(zero_copy_only=False)].any():
        a = a.fill_null("")
        offsets = ends(a)
    buffers = a.buffers()
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield slice(row, stop), data, offsets[row:stop + 1]
        row = stop


def in_windows(hit: np.ndarray, size: int) -> np.ndarray:
    """Words covered by the windows of ``size`` words whose starts are marked (``hit`` has one flag per word)."""
    edges = np.zeros(len(hit) + 1, dtype=np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edges, at, 1)
    np.add.at(edges, np.minimum(at + size, len(hit)), -1)
    return np.cumsum(edges[:-1]) > 0


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, lowest byte of all numbers first, then the next: high bytes that hardly vary compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * size).reshape(size, n).T).view(dtype).ravel()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a row without id belongs to no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
