"""Operator 1: stupid-backoff language-model scores, computed relationally.

The corpus' n-gram counts (n = 1..ORDER) score each of its documents, without the document itself
(its own n-grams are taken off all counts, else every n-gram would be known).  For a word with its
n-1 words before it, S = count(n-gram) / count(context) if the n-gram occurs elsewhere, else
BACKOFF x S of the shorter context; at the end count(word) / words, unknown words counting once.
A document's score is the sum of ln S over its words.

Tables are partitioned by n-gram hash.  Documents are dealt into blocks; a block explodes its
n-grams and sends each distinct one once, with its count, to the partition of its hash; the
partition adds the blocks' counts up and answers every block; the block joins the answers to its
n-grams and sums per document.  An n-gram that is in every document therefore weighs no more than
one row per block, and no table of the corpus is ever in one place.  Hashes are cut to as many bits
as keep the chance that an n-gram shares its key below 2^-20, and travel as sorted differences.

Null or wordless texts have 0 words and score 0.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import hash_spans, mix, narrow, utf8, wide, windows, word_spans
from furrow.llm.mixing import words

ORDER, BACKOFF = 3, 0.4
BLOCK_BYTES = 8 << 20
PART_GRAMS = 4 << 20
_U = np.uint64


def _grams(table: pa.Table, order: int, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(key, position of the last word) for n = 1..order], row of each word) of the texts of a block."""
    keys: list[list[np.ndarray]] = [[] for _ in range(order)]
    lasts: list[list[np.ndarray]] = [[] for _ in range(order)]
    rows, before, row_base = [], 0, 0
    for chunk in table.column("text").chunks or [pa.array([], pa.string())]:
        data, offsets = utf8(chunk)
        start, end, row = word_spans(data, offsets)
        word = hash_spans(data, start, end)
        for n in range(1, order + 1):
            h, at = (mix(word + _U(1)), np.arange(len(word))) if n == 1 else windows(word, row, n)
            keys[n - 1].append(h >> _U(64 - bits))
            lasts[n - 1].append(at + n - 1 + before)
        rows.append(row + row_base)
        before, row_base = before + len(word), row_base + len(chunk)
    return [(np.concatenate(k), np.concatenate(p)) for k, p in zip(keys, lasts, strict=True)], np.concatenate(rows)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, then differences in 4 bytes each; the few that need more have their upper parts in a list."""
    gap = np.diff(keys)
    high = gap >> _U(32)
    at = np.flatnonzero(high)
    return b"".join((int(keys[0]).to_bytes(8, "little"), len(at).to_bytes(4, "little"), at.astype("<u4").tobytes(), high[at].astype("<u4").tobytes(), gap.astype("<u4").tobytes()))


def _unpack_keys(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[8:12], "little")
    gap = np.frombuffer(raw, "<u4", offset=12 + 8 * n).astype(np.int64)
    gap[np.frombuffer(raw, "<u4", n, 12)] += np.frombuffer(raw, "<u4", n, 12 + 4 * n).astype(np.int64) << 32
    return np.cumsum(np.r_[int.from_bytes(raw[:8], "little"), gap])


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = True, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """(doc_id, n_words, score, mean_score): one row for each row of docs; mean_score is score per word, null without words."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(words(F.col("text"))).alias("words")).first()
    n_bytes, n_words = size["bytes"] or 0, size["words"] or 0
    blocks = max(1, ceil(n_bytes / block_bytes))
    split = max(0, ceil(log2(max(n_words * order / part_grams, 1))))
    bits = min(63, max(48, ceil(log2(max(n_words * order, 2))) + 20))
    # dealt by the row's place in its file, so that repeated rows spread over blocks as others do
    d = d.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def explode(block: pa.Table) -> pa.Table:
        grams, _ = _grams(block, order, bits)
        out: dict[str, list] = {k: [] for k in ("part", "n", "block", "keys", "counts")}
        for n, (keys, _) in enumerate(grams, 1):
            own, count = np.unique(keys, return_counts=True)
            part = (own >> _U(bits - split)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(own) else []
            for a, b in zip(cut, np.r_[cut[1:], len(own)], strict=True):
                for name, x in (("part", int(part[a])), ("n", n), ("block", block.column("block")[0].as_py()), ("keys", _pack_keys(own[a:b])), ("counts", narrow(count[a:b]))):
                    out[name].append(x)
        return pa.table(out, schema=pa.schema([("part", pa.int32()), ("n", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def add_up(messages: pa.Table) -> pa.Table:
        totals: list[bytes] = [b""] * len(messages)
        which = messages.column("n").to_numpy()
        for n in np.unique(which):
            at = np.flatnonzero(which == n)
            keys = [_unpack_keys(messages.column("keys")[i].as_py()) for i in at.tolist()]
            counts = np.concatenate([wide(messages.column("counts")[i].as_py()) for i in at.tolist()])
            _, code = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(code, weights=counts).astype(np.int64)[code]
            for i, x in zip(at.tolist(), np.split(total, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                totals[i] = narrow(x)
        return pa.table({"block": messages.column("block"), "part": messages.column("part"), "n": messages.column("n"), "totals": pa.array(totals, pa.binary())})

    def sum_up(block: pa.Table, answers: pa.Table) -> pa.Table:
        grams, row = _grams(block, order, bits)
        n_rows = len(block)
        length = np.bincount(row, minlength=n_rows)
        elsewhere = np.maximum(n_words - (length[row] if leave_out else 0), 1)
        answers = answers.sort_by([("n", "ascending"), ("part", "ascending")])
        which, totals = answers.column("n").to_numpy(), answers.column("totals")
        s, shorter = np.empty(len(row)), np.empty(0, np.int64)
        for n, (keys, last) in enumerate(grams, 1):
            if not len(keys):
                break
            _, code = np.unique(keys, return_inverse=True)
            count = np.concatenate([wide(totals[i].as_py()) for i in np.flatnonzero(which == n).tolist()])[code]
            if leave_out:
                _, code, own = np.unique(mix(keys * _U(0x9E3779B97F4A7C15) + row[last].astype(np.uint64)), return_inverse=True, return_counts=True)
                count = count - own[code]
            if n == 1:
                s = np.maximum(count, 1) / elsewhere
            else:
                s[last] = np.where(count > 0, count / np.maximum(shorter[last - 1], 1), backoff * s[last])
            shorter = np.zeros(len(row), np.int64)
            shorter[last] = count
        total = np.bincount(row, weights=np.log(s), minlength=n_rows)
        mean = pa.array(total / np.maximum(length, 1), mask=length == 0)
        return pa.table({"doc_id": block.column("doc_id"), "n_words": pa.array(length.astype(np.int64)), "score": pa.array(total), "mean_score": mean})

    messages = d.groupBy("block").applyInArrow(explode, "part int, n int, block int, keys binary, counts binary")
    answers = messages.groupBy("part").applyInArrow(add_up, "block int, part int, n int, totals binary")
    kind = dict(d.dtypes)["doc_id"]
    return d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sum_up, f"doc_id {kind}, n_words long, score double, mean_score double")


# Counts over windows in place of tables: the same scores on one machine.
SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w0,
                  generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM documents),
     g AS (SELECT *, lag(w0, 1) OVER d AS w1, lag(w0, 2) OVER d AS w2 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
     c AS (SELECT *, count(*) OVER (PARTITION BY w0) - count(*) OVER (PARTITION BY doc_id, w0) AS c1,
                  count(*) OVER (PARTITION BY w1, w0) - count(*) OVER (PARTITION BY doc_id, w1, w0) AS c2,
                  count(*) OVER (PARTITION BY w2, w1, w0) - count(*) OVER (PARTITION BY doc_id, w2, w1, w0) AS c3,
                  count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n FROM g),
     x AS (SELECT *, lag(c1) OVER d AS x1, lag(c2) OVER d AS x2 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
     s1 AS (SELECT *, greatest(c1, 1) / greatest(n, 1)::DOUBLE AS s1 FROM x),
     s2 AS (SELECT *, CASE WHEN w1 IS NULL THEN s1 WHEN c2 > 0 THEN c2 / x1::DOUBLE ELSE 0.4::DOUBLE * s1 END AS s2 FROM s1),
     s3 AS (SELECT *, CASE WHEN w2 IS NULL THEN s2 WHEN c3 > 0 THEN c3 / x2::DOUBLE ELSE 0.4::DOUBLE * s2 END AS s3 FROM s2),
     t AS (SELECT doc_id, count(*) AS n_words, sum(ln(s3)) AS score FROM s3 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(score, 0), 5) AS score FROM documents d LEFT JOIN t USING (doc_id)
"""
