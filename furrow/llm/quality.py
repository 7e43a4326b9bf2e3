"""Operator 3: quality rules with risk-controlled thresholds.

One pass over the texts' bytes gives word, line and repetition counts.  The base rule is fixed; the
method then chooses, for every stratum (language; null is a stratum) and every rate below, the
cutoff above which documents are rejected.  Cutoffs come from fixed grids.  A cutoff is admissible if,
on the stratum's labelled good documents that pass the base rule, an exact binomial test rejects the
hypothesis that it loses more than RISK / (number of rates) of good documents, at level
DELTA / (strata x rates x cutoffs) (Bonferroni); so, with probability 1 - DELTA, no stratum loses more
than RISK of its good documents to all rates together.  Among admissible cutoffs the one with the
most labelled bad less good documents above it is taken, the highest of equals, and none if that
difference is not above 0.  A stratum with too few labels rejects nothing beyond the base rule.

Null text has no words.  A document without words fails the base rule and has rates of 0.  Repeated
rows and ids are judged row by row; without labels (or with too few) only the base rule rejects.
Labels: of repeated doc_ids the lowest quality counts; null ids and qualities are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import hash_spans, per_row, slices, spare_name, utf8, windows, word_spans, written

RISK, DELTA = 0.05, 0.05
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shout")
# Rates and their grids of cutoffs.
RATES = {
    "symbol_rate": ("n_symbols", "n_words", [x / 100 for x in (2, 5, 8, 10, 15, 20, 25, 30, 40, 50, 60, 75, 100, 150, 200)]),
    "repeat_rate": ("n_repeat_words", "n_words", [x / 100 for x in range(1, 20)]),
    "dup_line_rate": ("n_dup_lines", "n_lines", [x / 100 for x in (2, 5, 8, 10, 15, 20, 25, 30, 40, 50, 60, 75)]),
    "upper_rate": ("n_upper", "word_chars", [x / 100 for x in (5, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 75)]),
    "shout_rate": ("n_shout", "n_words", [x / 100 for x in (2, 5, 8, 10, 15, 20, 25, 30, 40, 50, 60, 75, 100, 150)]),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row that offsets delimit."""
    n, lo, hi = len(offsets) - 1, int(offsets[0]), int(offsets[-1])
    start, end, row = word_spans(data, offsets)
    raw = data[lo:hi]

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(flags)]
        return c[offsets[1:] - lo] - c[offsets[:-1] - lo]

    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": per_row(points[end - lo] - points[start - lo], row, n)}
    out |= {"n_symbols": total(_SYMBOL[raw]), "n_upper": total((raw >= 65) & (raw <= 90)), "n_shout": total(raw == ord("!"))}
    word = hash_spans(data, start, end)
    h, at = windows(word, row, WINDOW)
    again = _repeated(h, row[at], first=True)
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    out["n_repeat_words"] = per_row(np.cumsum(cover)[:-1] > 0, row, n)
    # lines: cut at line breaks and text bounds; only those with a word count
    cuts = np.unique(np.r_[offsets, np.flatnonzero(raw == 10) + lo, np.flatnonzero(raw == 10) + lo + 1])
    a, b = cuts[:-1], cuts[1:]
    words_in = np.searchsorted(start, b) - np.searchsorted(start, a)
    a, b = a[words_in > 0], b[words_in > 0]
    line_row = np.searchsorted(offsets, a, "right") - 1
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = np.bincount(line_row[_repeated(hash_spans(data, a, b), line_row, first=False)], minlength=n)
    return out


def _repeated(h: np.ndarray, row: np.ndarray, first: bool) -> np.ndarray:
    """Positions whose hash occurs elsewhere in the row (first: any; else earlier)."""
    order = np.lexsort((h, row))  # stable, so equal hashes stay in order of position
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1]) if len(h) else np.empty(0, bool)
    hit = np.zeros(len(h), bool)
    hit[1:] |= same
    if first:
        hit[:-1] |= same
    return order[hit]


def features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or only its columns `keep`) with the columns of COUNTS; clashing names get underscores."""
    kept = [f for f in docs.schema.fields if keep is None or f.name in keep]
    names = [spare_name(docs, c) for c in COUNTS]
    schema = T.StructType(kept + [T.StructField(c, T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for i, j in slices(offsets):
                m = measure(data, offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(f.name).slice(i, j - i) for f in kept] + [pa.array(m[c].astype(np.int64)) for c in COUNTS], schema.names)

    return docs.mapInArrow(run, schema)


def admissible(losses: int, n: int, risk: float, level: float) -> bool:
    """Whether losses of n refute a loss rate above risk: P(Binomial(n, risk) <= losses) <= level."""
    if n == 0 or losses >= n * risk:
        return False
    k = np.arange(losses + 1)
    logs = np.array([lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) for x in k.tolist()]) + k * log(risk) + (n - k) * log(1 - risk)
    top = logs.max()
    return bool(top + log(np.exp(logs - top).sum()) <= log(level))


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, <rate>_cutoff..., n_good): the cutoffs of each stratum, null where none is used.

    Labelled rows are counted per stratum, rate and cutoff on the executors; the choice sees one row
    per stratum.
    """
    tests = [(r, i, c) for r, (_, _, grid) in RATES.items() for i, c in enumerate(grid)]
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    x = measured.where(~F.col("base_failed")).join(label, "doc_id")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    over = {(r, i): F.col(r) > c for r, i, c in tests}
    counts = x.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count_if(good).alias("n_good"),
        *[F.count_if(good & o).alias(f"g_{r}_{i}") for (r, i), o in over.items()],
        *[F.count_if(bad & o).alias(f"b_{r}_{i}") for (r, i), o in over.items()],
    )
    counts = written(counts, "strata")
    level = delta / max(counts.count() * len(tests), 1)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = {"stratum": rows["stratum"], "n_good": rows["n_good"]}
            for r, (_, _, grid) in RATES.items():
                chosen = []
                for _, row in rows.iterrows():
                    best, gain = None, 0
                    for i, c in enumerate(grid):
                        g, b = int(row[f"g_{r}_{i}"]), int(row[f"b_{r}_{i}"])
                        if b - g >= max(gain, 1) and admissible(g, int(row["n_good"]), risk / len(RATES), level):
                            best, gain = c, b - g
                    chosen.append(best)
                out[f"{r}_cutoff"] = pd.Series(chosen, index=rows.index, dtype=float)
            yield pd.DataFrame(out)

    cutoffs = ", ".join(f"{r}_cutoff double" for r in RATES)
    return counts.mapInPandas(choose, f"stratum string, n_good long, {cutoffs}")


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _rates() -> list[Column]:
    return [F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).alias(r) for r, (a, b, _) in RATES.items()]


def _cutoffs(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """The cutoffs as a table of one row per stratum, for measured documents (doc_id, stratum, COUNTS, base_failed)."""
    return written(thresholds(measured.select("*", *_rates()), labels, "stratum", risk, delta), "cutoffs").withColumnRenamed("stratum", "s")


def _judged(measured: DataFrame, cut: DataFrame) -> DataFrame:
    """measured with rejected_by and kept."""
    m = measured.select("*", *_rates()).join(cut, F.col("stratum").eqNullSafe(F.col("s")), "left")
    rejected = F.filter(F.array(*[F.when(F.col(r) > F.col(f"{r}_cutoff"), F.lit(r)) for r in RATES]), lambda x: x.isNotNull())
    return m.withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def _measured(docs: DataFrame, stratum: str, text: str) -> DataFrame:
    d = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
    return written(features(d, keep=["doc_id", "stratum"]).withColumn("base_failed", _base_failed()), "quality")


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, stratum and rejected_by (names of the rates above their cutoffs): a row for each row of docs."""
    m = _measured(docs, stratum, text)
    return _judged(m, _cutoffs(m, labels, risk, delta)).select("doc_id", *COUNTS, "base_failed", "kept", "stratum", "rejected_by")


def kept_rows(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs, all columns, that verdicts() keeps.

    Cutoffs are learned in a first pass; a second one measures again and decides row by row, so texts
    are never shuffled and rows with null or repeated doc_ids have verdicts of their own.
    """
    cut = _cutoffs(_measured(docs, stratum, text), labels, risk, delta)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns of docs are called, none clashes
    own = dict(zip(docs.columns, names, strict=True))
    x = features(docs.toDF(*names), own[text]).withColumns({"base_failed": _base_failed(), "stratum": F.col(own[stratum]).cast("string")})
    return _judged(x, cut).where("kept").select(*names).toDF(*docs.columns)
