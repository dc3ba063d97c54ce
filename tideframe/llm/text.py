"""Words of UTF-8 texts as 64-bit hashes, over whole Arrow batches at a time.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Hashes compare
words after lower-casing A-Z and nothing else. Work goes in slices of bounded
size, so one very long text needs no more memory than many short ones beyond
its own bytes and eight bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 18
BATCH_BYTES = 2 << 20
ARROW_BYTES = "4m"
PARQUET_ROWS = 512
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (the SplitMix64 finish)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * SLICE)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, dtype=np.uint64))))
                      for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with smaller batches of texts for what runs on it: Arrow batches bounded by
    bytes, and fewer rows at a time from Parquet. Ten thousand and four thousand long
    texts at once, the defaults, need more than a small executor has."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", PARQUET_ROWS)
    return df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins and ends in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first word of each row): words never reach over the end of a row."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """A hash for each span of bytes: equal spans, equal hashes."""
    out = np.empty(len(begin), dtype=np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + SLICE, "right")))
        b, e = begin[at:to] - begin[at], end[at:to] - begin[at]
        up, down = _power(int(e[-1]) + 1)
        total = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
        np.cumsum(table[data[begin[at]:end[to - 1]]] * up[:e[-1]], out=total[1:])
        out[at:to] = (total[e] - total[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        at = to
    return mix(out)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG = 512      # bytes beyond which a span is hashed by itself


def folded_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash for each span with A-Z lower-cased, to know spans by: eight bytes at a time go
    through the mixer, and very long spans through BLAKE2, so that unlike the polynomial of
    ``hash_spans``, which serves learned features, no pattern of bytes cancels out."""
    low = LOWER[data]
    padded, eight = np.concatenate((low, np.zeros(8, dtype=np.uint8))), np.arange(8)
    size = end - begin
    out = mix(size.astype(np.uint64) + np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        lane, left = padded[(begin[live] + at)[:, None] + eight].view("<u8").ravel(), size[live] - at
        lane = np.where(left >= 8, lane, lane & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)))
        out[live] = mix(out[live] ^ lane) + np.uint64(0x9E3779B97F4A7C15)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(low[begin[i]:end[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return mix(out)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Row by row the sorted distinct hashes of its ``width``-word shingles; a
    shorter row is one shingle, a row without words has none."""
    weights = mix(np.arange(7, 7 + width, dtype=np.uint64)) | np.uint64(1)
    many = max(0, len(words) - width + 1)
    rolled = np.zeros(many, dtype=np.uint64)
    for j in range(width):
        rolled += words[j:j + many] * weights[j]
    rolled = mix(rolled)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= width:
            yield np.unique(rolled[lo:hi - width + 1].view(np.int64))
        elif hi > lo:
            short = (words[lo:hi] * weights[:hi - lo]).sum(dtype=np.uint64, keepdims=True)
            yield mix(short + weights[:1] * np.uint64(hi - lo)).view(np.int64)
        else:
            yield np.zeros(0, dtype=np.int64)


def long_list(rows: list[np.ndarray]) -> pa.ListArray:
    """Rows of 64-bit hashes as an Arrow array<long>."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
