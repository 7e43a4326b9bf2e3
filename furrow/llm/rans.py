"""Operator 8: token-id files, entropy-coded with a static range asymmetric numeral system.

Documents are range-partitioned and sorted by doc_id, encoded with the tokenizers library, and each
task writes segments of about SEGMENT_TOKENS ids.  A segment is one self-contained binary value:

    header    magic, scale bits, lanes, block length, documents, ids, blocks, words (little-endian)
    table     symbols and frequencies, shared by all blocks of the segment (zlib)
    index     doc_ids, null flags and id counts of its documents (zlib)
    blocks    checkpoints: first word, crc32 of the ids, crc32 of the words, one state per lane
    words     32-bit renormalisation words, block after block
    trailer   crc32 of everything before the words

Blocks are independent: ids are dealt to LANES interleaved coders, whose states sit in the block's
checkpoint, so that any block can be decoded alone and numpy decodes all lanes of all blocks of a
segment at once.  The table counts all ids of its segment, so one pass over the corpus suffices and
a lost task is redone alone.  Segments are rows of a Parquet table, which is how they reach any
store that Spark can write; `payload` is the format above.

doc_id null sorts first; equal doc_ids follow the hash of their texts; null text is the empty text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.bpe import TEXT_SLICE, default_path, list_array
from furrow.llm.common import slices, utf8
from furrow.llm.library_tokens import encoder

SEGMENT_TOKENS = 4 << 20
BLOCK = 1 << 15
LANES = 32
_MAGIC = b"FURRANS1"
_HEAD = "<8sIIIQQQQ"
_U = np.uint64
_LOW, _WORD = _U(1 << 31), _U(32)


class CorruptSegment(ValueError):
    pass


def frequencies(count: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts (all above 0) scaled to a power of two, each at least 1; and the power."""
    bits = int(min(22, max(12, np.ceil(np.log2(max(len(count), 2))) + 3)))
    total, size = int(count.sum()), 1 << bits
    f = np.maximum(1, (count.astype(np.float64) / total * size).astype(np.int64))
    gap = size - int(f.sum())
    if gap > 0:
        f[np.argmax(f)] += gap
    while gap < 0:
        high = np.flatnonzero(f > 1)
        high = high[np.argsort(-f[high], kind="stable")][:-gap]
        f[high] -= 1
        gap += len(high)
    return f, bits


def pack(ids: np.ndarray, doc_ids: np.ndarray, is_null: np.ndarray, count: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """One segment."""
    ids = ids.astype(np.uint32)
    symbols, code, seen = _symbols(ids)
    f, bits = frequencies(seen) if len(ids) else (np.empty(0, np.int64), 12)
    start = np.cumsum(f) - f
    blocks = -(-len(ids) // block)
    states, words, first = _encode(code, f.astype(_U), start.astype(_U), bits, blocks, block, lanes)
    table = zlib.compress(symbols.astype("<u4").tobytes() + f.astype("<u4").tobytes(), 6)
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + is_null.astype(np.uint8).tobytes() + count.astype("<u4").tobytes(), 6)
    raw, ends = words.astype("<u4"), np.r_[first[1:], len(words)] if blocks else first
    crc = [(zlib.crc32(ids[b * block : (b + 1) * block].astype("<u4")), zlib.crc32(raw[first[b] : ends[b]])) for b in range(blocks)]
    head = struct.pack(_HEAD, _MAGIC, bits, lanes, block, len(doc_ids), len(ids), blocks, len(words))
    head += struct.pack("<III", len(symbols), len(table), len(index)) + table + index
    head += first.astype("<u8").tobytes() + np.array(crc, "<u4").tobytes() + states.astype("<u8").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + raw.tobytes()


def _symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(ids):
        return ids, ids.astype(np.int64), ids
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    place = np.zeros(len(count), np.int64)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], count[symbols]


def _encode(code, f, start, bits, blocks, block, lanes):
    if not blocks:
        return np.empty((0, lanes), _U), np.empty(0, np.uint32), np.empty(0, np.int64)
    steps = block // lanes if blocks > 1 else -(-len(code) // lanes)
    size = steps * lanes
    padded = np.full(blocks * size, -1, np.int64)
    padded[: len(code)] = code
    padded = padded.reshape(blocks, steps, lanes)
    x = np.full((blocks, lanes), _LOW, _U)
    out, used = np.zeros((blocks, steps, lanes), np.uint32), np.zeros((blocks, steps, lanes), bool)
    shift, top = _U(bits), _U(63 - bits)
    for t in range(steps - 1, -1, -1):
        c = padded[:, t]
        real = c >= 0 if c[-1, -1] < 0 else None  # only the last block can end early
        ft, st = f[c], start[c]
        full = x >= (ft << top)
        if real is not None:
            full &= real
        out[:, t], used[:, t] = x, full
        y = np.where(full, x >> _WORD, x)
        q = y // ft
        y = (q << shift) + (y - q * ft) + st
        x = y if real is None else np.where(real, y, x)
    first = np.cumsum(used.sum((1, 2)))
    return x, out[used], np.r_[0, first[:-1]].astype(np.int64)


def unpack(payload: bytes, only: list[int] | None = None) -> dict:
    """Documents and ids of a segment; `only`: the ids of those blocks alone.  CorruptSegment if a checksum fails."""
    try:
        magic, bits, lanes, block, n_docs, n_ids, blocks, n_words = struct.unpack_from(_HEAD, payload)
        at = struct.calcsize(_HEAD)
        n_symbols, n_table, n_index = struct.unpack_from("<III", payload, at)
        at += 12
        table_at, index_at = at, at + n_table
        at = index_at + n_index
        first = np.frombuffer(payload, "<u8", blocks, at).astype(np.int64)
        crc = np.frombuffer(payload, "<u4", 2 * blocks, at + 8 * blocks).reshape(-1, 2)
        states = np.frombuffer(payload, "<u8", blocks * lanes, at + 16 * blocks).reshape(blocks, lanes).astype(_U)
        at += 16 * blocks + 8 * blocks * lanes
        (head_crc,) = struct.unpack_from("<I", payload, at)
        words = np.frombuffer(payload, "<u4", n_words, at + 4)
    except (struct.error, ValueError) as e:
        raise CorruptSegment(str(e)) from e
    if magic != _MAGIC or head_crc != zlib.crc32(memoryview(payload)[:at]):
        raise CorruptSegment("header")
    table, index = zlib.decompress(payload[table_at:index_at]), zlib.decompress(payload[index_at : index_at + n_index])
    symbols, f = np.frombuffer(table, "<u4", n_symbols), np.frombuffer(table, "<u4", n_symbols, 4 * n_symbols).astype(_U)
    ends = np.r_[first[1:], n_words]
    take = np.arange(blocks) if only is None else np.array(only, np.int64)
    for b in take:
        if zlib.crc32(words[first[b] : ends[b]]) != crc[b, 1]:
            raise CorruptSegment(f"words of block {b}")
    length = np.minimum(block, n_ids - take * block)
    ids = _decode(states[take], words, first[take], f, symbols, bits, length, lanes)
    for b, part in zip(take, np.split(ids, np.cumsum(length)[:-1]) if len(take) else [], strict=True):
        if zlib.crc32(part.astype("<u4")) != crc[b, 0]:
            raise CorruptSegment(f"ids of block {b}")
    return {
        "ids": ids,
        "doc_ids": np.frombuffer(index, "<i8", n_docs),
        "is_null": np.frombuffer(index, np.uint8, n_docs, 8 * n_docs).astype(bool),
        "count": np.frombuffer(index, "<u4", n_docs, 9 * n_docs).astype(np.int64),
    }


def _decode(x, words, at, f, symbols, bits, length, lanes):
    if not len(x):
        return np.empty(0, np.uint32)
    slot = np.repeat(np.arange(len(f)), f.astype(np.int64))
    start, shift, mask = (np.cumsum(f) - f).astype(_U), _U(bits), _U((1 << bits) - 1)
    steps, at = -(-int(length.max()) // lanes), at.copy()
    out = np.empty((len(x), steps, lanes), np.uint32)
    words = np.r_[words, np.zeros(lanes, np.uint32)].astype(_U)
    lane = np.arange(lanes)
    for t in range(steps):
        low = x & mask
        c = slot[low.astype(np.int64)]
        y = f[c] * (x >> shift) + low - start[c]
        real = (t * lanes + lane)[None, :] < length[:, None]
        dry = (y < _LOW) & real
        nth = np.cumsum(dry, 1)
        fill = words[np.minimum(at[:, None] + nth - 1, len(words) - 1) * dry]
        x = np.where(real, np.where(dry, (y << _WORD) | fill, y), x)
        out[:, t] = symbols[c]
        at += nth[:, -1]
    return out.reshape(len(x), -1)[np.arange(steps * lanes)[None, :] < length[:, None]]


def write_ids(docs: DataFrame, out: str, path: str | None = None, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the ids of docs, in ascending doc_id order, as a table of segments at `out`."""
    path = path or default_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("d", "h").sortWithinPartitions("d", "h").select("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, held = TaskContext.get().partitionId(), 0, []
        own = encoder(path)

        def segment() -> pa.RecordBatch:
            ids, d, null, count = (np.concatenate(x) for x in zip(*held, strict=True))
            payload = pack(ids, d, null, count)
            return pa.RecordBatch.from_pydict({"partition": pa.array([task], pa.int32()), "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(d)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            null = np.asarray(batch.column("d").is_null())
            d = np.asarray(batch.column("d").fill_null(0))
            for i, j in slices(offsets, TEXT_SLICE):
                ids, count = own.slice(data, offsets[i : j + 1])
                if end_id is not None:
                    ends = np.cumsum(count)
                    ids, count = np.insert(ids, ends, end_id), count + 1
                held.append((ids, d[i:j], null[i:j], count))
                if sum(len(x[0]) for x in held) >= segment_tokens:
                    yield segment()
                    part, held = part + 1, []
        if held:
            yield segment()

    rows.mapInArrow(run, "partition int, part int, n_docs long, n_tokens long, payload binary").write.parquet(out)


def read_ids(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32[, ids].

    Starts come from a prefix sum over the files' id counts: one row per range partition in a single
    task, then one window per range partition; nothing but counts is shuffled.
    """
    files = spark.read.parquet(out)
    sums = files.groupBy("partition").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("partition", (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("partition").orderBy("part")) - F.col("n_tokens")
    starts = files.select("partition", "part", within.alias("ahead")).join(sums, "partition").select("partition", "part", (F.col("ahead") + F.col("base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for partition, part, payload in zip(*(batch.column(c).to_pylist() for c in ("partition", "part", "payload")), strict=True):
                x = unpack(payload)
                ends = np.cumsum(x["count"])
                raw, n = memoryview(np.ascontiguousarray(x["ids"], "<u4")).cast("B"), len(ends)
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), x["count"].tolist(), strict=True)]
                columns = [pa.array(np.full(n, partition), pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array(x["doc_ids"], pa.int64(), mask=x["is_null"]), pa.array(ends - x["count"]), pa.array(x["count"]), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [list_array(x["ids"].astype(np.int32), x["count"])] * with_ids, names)

    schema = "partition int, part int, doc_id long, ahead long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    docs = files.select("partition", "part", "payload").mapInArrow(run, schema)
    return docs.join(starts, ["partition", "part"]).select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
