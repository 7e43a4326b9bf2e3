"""Shared pieces of the corpus operators: scratch tables, byte-level word scanning, hashing.

Words are maximal runs of characters other than space and 0x09-0x0D.  All scanning works on the
UTF-8 buffer of an Arrow batch, in slices of a bounded number of bytes, so that the memory of a
task follows the slice and the longest single text, not the batch.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LUT = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


# ---------------------------------------------------------------- scratch tables
def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of our own only on a single machine whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="furrow-scratch-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have (columns of the input may be called anything)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


HEAVY = 1000


def join_back(rows: DataFrame, result: DataFrame, keys: list[str], weight: str, total: int, write: bool = True) -> DataFrame:
    """Inner join of rows with one result row per key, where `weight` says how many rows have the key and total how many there are (or more).

    A key with a thousandth of all rows or more is broadcast (there are at most HEAVY of them, whatever
    the size), so rows that share it stay where they are; the others are shuffled.  write: keep the
    result as a table first, for one that is costly to work out twice.
    """
    result = written(result, "result") if write else result
    heavy = F.broadcast(result.where(F.col(weight) * HEAVY >= total))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(result.where(F.col(weight) * HEAVY < total).hint("merge"), keys)
    hot = rows.join(heavy, keys)
    return hot.unionByName(light)


def hash_sample(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """About `size` rows (all, if there are fewer): those whose hash falls into the share size / count.

    A filter, so no rows meet anywhere; reruns agree.
    """
    n = df.count()
    if n <= size:
        return df
    share = int(size / n * 2**53)
    return df.where(F.shiftrightunsigned(F.xxhash64(*keys), 11) < share)


# ---------------------------------------------------------------- byte scanning
def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(big)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + n + 1]
    data = big.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes (a longer text stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(int(_P), -1, 2**64)
        grown = []
        for base in (_P, _U(inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            grown.append(np.cumprod(x, dtype=np.uint64))
        if size > SLICE_BYTES + 4096:
            return grown[0], grown[1]
        _POWERS[:] = grown
    return _POWERS[0], _POWERS[1]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of sorted, disjoint byte spans; equal bytes give equal hashes anywhere."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, base + SLICE_BYTES // 2, "right")))
        seg = data[base : int(end[j - 1])]
        pw, inv = _powers(len(seg) + 1)
        prefix = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_LUT[seg] * pw[: len(seg)], out=prefix[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = (prefix[b] - prefix[a]) * inv[a]
        i = j
    return mix(out ^ ((end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of set flags within the rows that offsets delimit (flag[0]: the first row's first byte)."""
    lo, cut = int(offsets[0]), np.zeros(len(flag) + 1, bool)
    cut[offsets - lo] = True
    first = flag.copy()
    first[1:] &= ~flag[:-1] | cut[1:-1]
    last = flag.copy()
    last[:-1] &= ~flag[1:] | cut[1:-1]
    return np.flatnonzero(first) + lo, np.flatnonzero(last) + lo + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row numbers of all words of the rows that offsets delimit."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        none = np.empty(0, np.int64)
        return none, none, none
    start, end = runs(~_WS[data[lo:hi]], offsets)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def windows(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of all k-word windows that lie within one row."""
    n = len(word) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    acc = word[at] + _U(k)
    for t in range(1, k):
        acc = mix(acc * _U(0xFF51AFD7ED558CCD) + word[at + t])
    return acc, at


def shingles(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of all word k-grams, sorted by row and hash.

    A row with 1 to k-1 words has one shingle, made of all its words.
    """
    parts, rows = [], []
    if len(word):
        h, at = windows(word, row, k)
        parts.append(h)
        rows.append(row[at])
        ids, first, count = np.unique(row, return_index=True, return_counts=True)
        for n in range(1, k):
            short = count == n
            if short.any():
                acc = word[first[short]] + _U(n)
                for t in range(1, n):
                    acc = mix(acc * _U(0xFF51AFD7ED558CCD) + word[first[short] + t])
                parts.append(mix(acc))
                rows.append(ids[short])
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, r = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n).astype(np.int64)


def narrow(x: np.ndarray) -> bytes:
    """Non-negative integers, nearly all small: one byte each, and a list of those from 255 on."""
    at = np.flatnonzero(x >= 255)
    return b"".join((len(at).to_bytes(4, "little"), at.astype("<u4").tobytes(), x[at].astype("<u8").tobytes(), np.minimum(x, 255).astype(np.uint8).tobytes()))


def wide(raw: bytes) -> np.ndarray:
    """The integers of narrow()."""
    n = int.from_bytes(raw[:4], "little")
    x = np.frombuffer(raw, np.uint8, offset=4 + 12 * n).astype(np.int64)
    x[np.frombuffer(raw, "<u4", n, 4)] = np.frombuffer(raw, "<u8", n, 4 + 4 * n)
    return x
