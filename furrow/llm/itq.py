"""Operator 2: embedding near-dedup with iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample (about SAMPLE vectors, drawn by hash) so that the signs of
the rotated vector are a balanced binary code: principal axes first, then alternating sign assignment
and orthogonal Procrustes.  Every vector is encoded, to 64 bits (one bit a dimension below that).

Candidates are pairs of one label and dimension whose codes differ in at most RADIUS bits, and only
those, whatever the size: at a cosine of 0.98 about 4 bits differ, more than RADIUS in less than 1 %
of pairs.  Multi-index tables find all of them: the code is cut into substrings, one table each, and
two codes within RADIUS agree in some substring up to RADIUS // tables bits.  The width of a substring
follows the size of the largest label (`plan_tables`): 10 tables and equal substrings, or 5 tables and
probes that differ in a bit.

Retrieval sends codes, not vectors.  Buckets are split into cells of bounded size; a cell compares
codes by their Hamming distance and returns the rows that have a candidate.  Only those fetch their
vectors, meet in the same cells again, and candidates are reranked by the cosine of the original
vectors in double precision.  A pair belongs to the first table where it meets.  A cell returns one
row per vector (links found, local root), never a list of pairs; components are joined over the local
roots.

Equal vectors of a label collapse into one representative first, with a map-side combine, so copies
are never paired; links are counted over vectors, copies included.  Vectors that are null, zero, or
hold null or non-finite components, and vectors without a label, link with nothing.  Rows that share a
vec_id are vectors of one node: each counts its own links, and all have one component.  A null vec_id
cannot be named: such rows come back with null component and 0 links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import hash_sample, join_back, written
from furrow.llm.graph import components

THRESHOLD = 0.98
SAMPLE, ROUNDS, BITS = 20_000, 40, 64
RADIUS = 9
CELL_ROWS, BLOCK_ROWS = 2048, 256
SMALL_LABEL = 1 << 13
CELL = ["lab", "t", "key", "lo", "hi"]
_ENTRY = (("lab", pa.int64()), ("t", pa.int32()), ("key", pa.int64()), ("probe", pa.bool_()), ("code", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()))


def learn_rotation(x: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """dim x bits: projection whose signs are the code."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    dim = x.shape[1]
    bits = min(dim, BITS)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    bits = (x @ rotation >= 0).astype(np.uint8)
    full = np.zeros((len(x), BITS), np.uint8)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64).ravel()


def keyed(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, x (array<double>), and (k1, k2), a 128-bit key of label and vector that is null for vectors that cannot link."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda c: c != 0)
    return rows.select("*", *[F.when(ok, F.xxhash64(F.lit(k), "label", "x")).alias(f"k{k}") for k in (1, 2)])


def plan_tables(largest: int, small_label: int = SMALL_LABEL) -> tuple[int, int]:
    """(tables, bits in which the substrings of a pair may differ): both cover RADIUS in full."""
    tables = RADIUS + 1 if largest <= small_label else RADIUS // 2 + 1
    return tables, RADIUS // tables


def substrings(code: np.ndarray, tables: int) -> np.ndarray:
    """rows x tables: the code cut into substrings of equal width, give or take a bit."""
    cuts = np.arange(tables + 1) * BITS // tables
    width = np.diff(cuts).astype(np.uint64)
    return ((code[:, None] >> cuts[:-1].astype(np.uint64)) & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)


def _unit(x: pa.Array, dim: int) -> np.ndarray:
    v = np.asarray(pc.list_flatten(x)).astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)  # scaled so that no norm under- or overflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _entries(rows: DataFrame, rotations: dict[int, np.ndarray], tables: int, radius: int) -> DataFrame:
    """Table entries: codes under their own substring, and, for radius 1, probes under those with one set bit less."""
    widths = np.diff(np.arange(tables + 1) * BITS // tables).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                yield one(batch.slice(at, 1024))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("x")
        dims, code = np.asarray(pc.list_value_length(x)), np.zeros(len(batch), np.uint64)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            if dim in rotations:
                code[own] = codes(_unit(x.take(pa.array(own)), dim), rotations[dim])
        sub, who, table, key, probe = substrings(code, tables), [], [], [], []
        for t in range(tables):
            for b in range(-1, widths[t] if radius else 0):
                on = np.arange(len(code)) if b < 0 else np.flatnonzero(sub[:, t] >> b & 1)
                who.append(on)
                table.append(np.full(len(on), t, np.int32))
                key.append(sub[on, t] if b < 0 else sub[on, t] ^ (1 << b))
                probe.append(np.full(len(on), b >= 0))
        w = np.concatenate(who)
        lab, k1, k2 = (np.asarray(batch.column(c))[w] for c in ("lab", "k1", "k2"))
        columns = [lab, np.concatenate(table), np.concatenate(key), np.concatenate(probe), code.view(np.int64)[w], k1, k2]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ENTRY, strict=True)], [n for n, _ in _ENTRY])

    return rows.mapInArrow(run, "lab long, t int, key long, probe boolean, code long, k1 long, k2 long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The cells of a partition that is sorted by CELL, one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)) for c in CELL], axis=1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if held and len(batch) and [held[-1].column(c)[-1].as_py() for c in CELL] != keys[0].tolist():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(np.r_[0, cut].tolist(), [*cut.tolist(), len(batch)], strict=True):
            if a < b:
                held.append(batch.slice(a, b - a))
                if b < len(batch):
                    yield pa.Table.from_batches(held)
                    held = []
    if held:
        yield pa.Table.from_batches(held)


def candidates(cell: pa.Table, tables: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, block of rows x all rows) of a cell: True where a row and a later one are candidates that first meet here."""
    code, probe, chunk = (np.asarray(cell.column(c).combine_chunks()) for c in ("code", "probe", "chunk"))
    code = code.view(np.uint64)
    t, split = cell.column("t")[0].as_py(), cell.column("lo")[0].as_py() != cell.column("hi")[0].as_py()
    sub, order = substrings(code, tables), np.arange(len(code))
    for a in range(0, len(code), BLOCK_ROWS):
        i = order[a : a + BLOCK_ROWS]
        near = (np.bitwise_count(code[i, None] ^ code) <= RADIUS) & (order > i[:, None])
        near &= ~(probe[i, None] & probe)  # one of the two lies under its own substring
        if split:
            near &= chunk[i, None] != chunk
        if t and near.any():
            x, y = np.nonzero(near)
            earlier = (np.bitwise_count(sub[i[x], :t] ^ sub[y, :t]) <= radius).any(1)  # an earlier table has the pair
            near[x[earlier], y[earlier]] = False
        yield a, near


def _with_candidates(tables: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            some = np.zeros(len(cell), bool)
            if len(cell) > 1:
                for a, near in candidates(cell, tables, radius):
                    some[a : a + len(near)] |= near.any(1)
                    some |= near.any(0)
            if some.any():
                yield from cell.filter(pa.array(some)).combine_chunks().to_batches()

    return run


FOUND = "k1 long, k2 long, vec_id long, links long, root long"


def _rerank(tables: int, radius: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            x = cell.column("x").combine_chunks()
            v = _unit(x, len(x[0]))
            ids, weight = (np.asarray(cell.column(c).combine_chunks()) for c in ("vec_id", "weight"))
            links, parent = np.zeros(len(ids), np.int64), list(range(len(ids)))

            def find(i: int, parent: list[int] = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for a, near in candidates(cell, tables, radius):
                if not near.any():
                    continue
                hit = near & (v[a : a + len(near)] @ v.T >= threshold)
                links[a : a + len(near)] += hit @ weight
                links += weight[a : a + len(near)] @ hit
                for i in np.flatnonzero(hit.any(1)).tolist():
                    top = find(a + i)
                    for r in {find(j) for j in np.flatnonzero(hit[i]).tolist()}:
                        lo, hi = (top, r) if ids[top] <= ids[r] else (r, top)
                        parent[hi] = lo
                        top = lo
            some = np.flatnonzero(links)
            if len(some):
                roots = ids[[find(i) for i in some.tolist()]]
                keys = [np.asarray(cell.column(c).combine_chunks())[some] for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*keys, ids[some], links[some], roots)], ["k1", "k2", "vec_id", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", sample: int = SAMPLE, small_label: int = SMALL_LABEL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors."""
    rows = keyed(vectors, vec_id, embedding, label)
    can, key = rows.where("k1 is not null"), ["k1", "k2"]
    reps = can.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.any_value("label").alias("label"), F.any_value("x").alias("x"))
    reps = written(reps, "reps")
    drawn = hash_sample(reps, key, sample).select("x").toPandas()["x"]
    by_dim: dict[int, list] = {}
    for x in drawn:
        by_dim.setdefault(len(x), []).append(x)
    rotations = {}
    for dim, xs in by_dim.items():
        m = np.array(xs)
        m /= np.abs(m).max(1, keepdims=True)
        rotations[dim] = learn_rotation(m)
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, radius = plan_tables(largest, small_label)
    labelled = reps.withColumn("lab", F.xxhash64("label", F.size("x")))
    entries = written(_entries(labelled.select("lab", "k1", "k2", "x"), rotations, tables, radius), "entries")
    bucket = ["lab", "t", "key"]
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("m"), F.count_if(~F.col("probe")).alias("own")).where("m > 1 and own > 0")
    cells = entries.join(sizes, bucket).withColumn("chunks", F.ceil(F.col("m") / CELL_ROWS).cast("int"))
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64(*key), F.col("chunks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "chunks", "m", "own")

    def in_cells(rows: DataFrame) -> DataFrame:
        return rows.repartition(*CELL).sortWithinPartitions(*CELL, *key, "probe")

    cells = in_cells(cells)
    near = written(cells.mapInArrow(_with_candidates(tables, radius), cells.schema), "near")
    full = in_cells(near.join(reps.select(*key, "vec_id", "weight", "x"), key))
    found = written(full.mapInArrow(_rerank(tables, radius, threshold), FOUND), "found")
    links = found.groupBy(*key).agg(F.sum("links").alias("links"))
    edges = found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))
    # ids with several different vectors tie those vectors' representatives together
    several = rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.count("k1").alias("n_can"), F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi"))
    several = written(several.where("vec_id is not null and n_can > 0 and (n > n_can or lo <> hi)").select("vec_id"), "several")
    if not several.isEmpty():
        tied = can.select("vec_id", *key).join(several, "vec_id", "left_semi").join(reps.select(*key, F.col("vec_id").alias("rep")), key)
        edges = edges.union(tied.select("vec_id", "rep"))
    roots = written(components(edges), "roots").select(F.col("node").alias("rep"), "root")
    result = reps.select(*key, F.col("vec_id").alias("rep"), "weight").join(links, key, "left").join(roots, "rep", "left")
    result = result.select(*key, "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    alone = rows.where("k1 is null").select(F.col("vec_id").alias("rep")).join(roots, "rep", "left").select(F.col("rep").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    total = reps.agg(F.sum("weight")).first()[0] or 0
    out = join_back(can.select("vec_id", *key), result, key, "weight", total).select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
