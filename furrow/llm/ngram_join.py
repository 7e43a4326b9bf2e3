"""Operator 5: n-gram Jaccard join of documents by MinHash banding.

Documents are sets of 64-bit hashes of their word n-grams (n = 5; fewer words make one n-gram of all
of them).  Equal sets collapse into one representative, so copies are never paired.  Each
representative gets bands x rows MinHashes; `plan_bands` picks the most rows for which at most
MAX_BANDS bands still find a pair at the threshold with the target recall.  Band hashes are shuffled;
representatives that share one are candidates.

Verification runs on full n-gram sets without ever listing the pairs of a group:

1. candidates are grouped into clusters, the connected components of "shares a band";
2. a cluster of up to CLUSTER_ROWS rows and CLUSTER_GRAMS n-grams is one unit, every set is sent once;
   a larger one is split: each of its band buckets is dealt into chunks, and every two chunks of a
   bucket meet in a cell of bounded size;
3. in a unit or cell, pairs that share a band are compared in blocks, as bit rows over the n-grams
   that two or more of its sets hold.  A pair belongs to the first band that it shares, so each is
   counted once.  What leaves is one row per document: number of links, and its local root.

A document's links are counted over documents (copies of itself and of linked texts included); its
class is the smallest doc_id reachable by links.  Null or wordless texts link with nothing and are
their own class.  A null doc_id cannot be named: such rows come back with null class and 0 links.
Rows that share a doc_id are texts of one document: each is compared and comes back as a row, and
where an id stands for a class it stands for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import hash_spans, join_back, mix, shingles, slices, utf8, word_spans, written
from furrow.llm.graph import components

N, THRESHOLD, RECALL, MAX_BANDS = 5, 0.8, 0.9998, 20
CLUSTER_ROWS, CLUSTER_GRAMS = 4096, 2 << 20
CHUNK_ROWS, CHUNK_GRAMS = 1024, 512 << 10
_U = np.uint64


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows for which max_bands bands reach the recall at the threshold."""
    best = (max(1, ceil(log(1 - recall) / log(1 - threshold))) if threshold < 1 else 1, 1)
    for rows in range(2, 17):
        p = threshold**rows
        bands = ceil(log(1 - recall) / log(1 - p)) if p < 1 else 1
        if bands <= max_bands:
            best = (bands, rows)
    return best


def min_hashes(grams: np.ndarray, row: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """Band hashes, n x bands; rows without n-grams get zeros."""
    out = np.zeros((n, bands), np.uint64)
    if not len(grams):
        return out
    rng = np.random.default_rng(97)
    mult = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * _U(2) + _U(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    has, start = np.unique(row, return_index=True)
    scratch = np.empty_like(grams)
    for b in range(bands):
        acc = np.full(len(has), b + 1, np.uint64)
        for r in range(rows):
            np.multiply(grams, mult[b * rows + r], out=scratch)
            scratch += add[b * rows + r]
            np.right_shift(scratch, _U(11), out=scratch)
            low = np.minimum.reduceat(scratch, start)
            acc = mix(acc * _U(0xFF51AFD7ED558CCD) + low)
        out[has, b] = acc
    return out


def _gram_batches(batch: pa.RecordBatch, text: str, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column(text))
    for i, j in slices(offsets):
        own = offsets[i : j + 1]
        start, end, row = word_spans(data, own)
        yield i, j, *shingles(hash_spans(data, start, end), row, n)


def _set_keys(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two order-free 64-bit sums over each row's n-grams."""
    key, end = np.zeros((len(size), 2), np.uint64), np.cumsum(size)
    for c, x in enumerate((mix(h + _U(1)), mix(h ^ _U(0xA5A5A5A5A5A5A5A5)))):
        total = np.r_[_U(0), np.cumsum(x, dtype=np.uint64)]
        key[:, c] = total[end] - total[end - size]
    return key


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set_key (16 bytes, null without words), grams (set size), bands (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, row in _gram_batches(batch, "text", n):
                size = np.bincount(row, minlength=j - i)
                keys = pa.array([k.tobytes() if s else None for k, s in zip(_set_keys(h, size), size, strict=True)], pa.binary())
                bh = min_hashes(h, row, j - i, bands, rows).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * bands, pa.int32()), pa.array(bh.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), keys, pa.array(size.astype(np.int64)), flat], ["doc_id", "set_key", "grams", "bands"])

    return docs.mapInArrow(run, "doc_id long, set_key binary, grams long, bands array<long>")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """set_key, set (sorted 64-bit n-gram hashes, as bytes) of docs with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, row in _gram_batches(batch, "text", n):
                size = np.bincount(row, minlength=j - i)
                ends, some = np.cumsum(size), np.flatnonzero(size)
                keys = [k.tobytes() for k in _set_keys(h, size)[some]]
                sets = [h[e - k : e].tobytes() for e, k in zip(ends[some], size[some], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["set_key", "set"])

    return docs.select("text").mapInArrow(run, "set_key binary, set binary")


def compare(ids: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, part: np.ndarray | None, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row of a unit.

    links: weights of the linked rows; root: smallest id of the row's group by these links.  With
    `band` >= 0 only pairs whose first shared band it is count, and with `part` only pairs of
    different parts.
    """
    n = len(ids)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    bits = np.zeros((n, (int(shared.sum()) + 63) // 64 * 8), np.uint8)
    col = column[code[keep]]
    np.bitwise_or.at(bits, (owner[keep], col >> 3), (1 << (col & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n - 1):
        rest = slice(i + 1, n)
        agree = bands[rest] == bands[i]
        if band >= 0:
            want = agree[:, band] & ~agree[:, :band].any(1)
        else:
            want = agree.any(1)
        if part is not None:
            want &= part[rest] != part[i]
        small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        want &= small >= threshold * large  # a smaller set cannot reach the threshold
        j = np.flatnonzero(want) + i + 1
        step = max(1, (32 << 20) // max(bits.shape[1] * 8, 1))
        for k in range(0, len(j), step):
            jj = j[k : k + step]
            both = np.bitwise_count(bits[jj] & bits[i]).sum(1, dtype=np.int64)
            hit = jj[both >= threshold * (size[jj] + size[i] - both) - 1e-9]
            if len(hit):
                links[i] += weight[hit].sum()
                links[hit] += weight[i]
                a = find(i)
                for r in {find(x) for x in np.unique(parent[hit]).tolist()}:
                    lo, hi = (a, r) if ids[a] <= ids[r] else (r, a)
                    parent[hi] = lo
                    a = lo
    return links, ids[[find(i) for i in range(n)]]


UNIT = "set_key binary, doc_id long, links long, root long"


def _unit(in_cells: bool, threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("set_key").sort_values("doc_id")
        sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
        part, band = None, -1
        if in_cells:
            band = int(rows["band"].iloc[0])
            if rows["lo"].iloc[0] != rows["hi"].iloc[0]:
                part = rows["chunk"].to_numpy()
        links, root = compare(rows["doc_id"].to_numpy(), rows["weight"].to_numpy(), sets, np.stack(rows["bands"].to_numpy()), part, band, threshold)
        return pd.DataFrame({"set_key": rows["set_key"], "doc_id": rows["doc_id"], "links": links, "root": root})

    return run


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, kept, set_id): one row for each row of docs.

    set_id is the smallest doc_id with the same n-gram set; kept: class_id = doc_id.
    """
    bands, rows = plan_bands(threshold, recall)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = written(sketches(d, n, bands, rows), "sketch")
    named = sketch.where("doc_id is not null and set_key is not null")
    reps = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.any_value("grams").alias("grams"), F.any_value("bands").alias("bands"))
    reps = written(reps, "reps")

    # band buckets with two members or more, and the star of each around its smallest member
    member = reps.select("set_key", "rep", "grams", F.posexplode("bands").alias("band", "h"))
    bucket = member.groupBy("band", "h").agg(F.count("*").alias("m"), F.sum("grams").alias("g"), F.min("rep").alias("low")).where("m > 1")
    member = written(member.drop("grams").join(bucket, ["band", "h"]), "member")
    cluster = components(member.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    cluster = cluster.union(cluster.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    candidates = cluster.join(reps, "rep")
    total = candidates.groupBy("cluster").agg(((F.count("*") > CLUSTER_ROWS) | (F.sum("grams") > CLUSTER_GRAMS)).alias("big"))
    candidates = written(candidates.join(total, "cluster").select("set_key", F.col("rep").alias("doc_id"), "cluster", "weight", "bands", "big"), "candidates")
    # merged at every size: the ids of candidates grow with the documents, so they are never broadcast
    sets = gram_sets(d.join(candidates.select("doc_id").hint("merge"), "doc_id", "left_semi"), n)
    full = candidates.join(sets, "set_key")
    big_exists = not candidates.where("big").isEmpty()
    if big_exists:
        full = written(full, "sets")
    found = full.where("not big").groupBy("cluster").applyInPandas(_unit(False, threshold), UNIT)
    if big_exists:
        chunks = F.greatest(F.ceil(F.col("m") / CHUNK_ROWS), F.ceil(F.col("g") / CHUNK_GRAMS)).cast("int")
        cells = member.drop("rep").join(full.where("big"), "set_key").withColumn("chunks", chunks)
        cells = cells.withColumn("chunk", F.pmod(F.xxhash64("set_key"), F.col("chunks")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cells = cells.select("set_key", "doc_id", "band", "h", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "weight", "bands", "set")
        found = found.union(cells.groupBy("band", "h", "lo", "hi").applyInPandas(_unit(True, threshold), UNIT))
    found = written(found, "found")
    links = found.groupBy("set_key").agg(F.any_value("doc_id").alias("doc_id"), F.sum("links").alias("links"), F.min("root").alias("root"))
    if big_exists:  # clusters that were compared in cells are joined again over their links
        again = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("doc_id"), F.col("root").alias("joined"))
        links = links.join(again, "doc_id", "left").select("set_key", "links", F.least("root", F.coalesce("joined", "root")).alias("root"))
    result = reps.select("set_key", "rep", "weight").join(links.select("set_key", "links", "root"), "set_key", "left")
    result = result.select("set_key", "rep", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    total = reps.agg(F.sum("weight")).first()[0] or 0
    texts = join_back(named.select("doc_id", "set_key"), result, ["set_key"], "weight", total).select("doc_id", "root", "n", "rep")
    alone = sketch.where("doc_id is null or set_key is null").select("doc_id", F.col("doc_id").alias("root"), F.lit(0).alias("n"), F.col("doc_id").alias("rep"))
    out = texts.union(alone)
    kept = F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", F.col("root").alias("class_id"), F.col("n").cast("long").alias("n_links"), kept.alias("kept"), F.col("rep").alias("set_id"))
