"""Survey CSV files: (evaluator, method, four scores, score, metrics_used)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.survey_stats import row_score

# Names that a column may have, after accents, case and other signs are removed.
NAMES = {
    "evaluator": ("avaliador", "agronomo", "evaluator"),
    "method": ("metodo", "idspraying", "idcatacao", "method"),
    "coverage": ("cobertura", "coberturaagronomica", "coverage"),
    "precision": ("precisao", "excessodepulverizacao", "precision"),
    "operability": ("operacionalidade", "operacionalidadedrone", "operability"),
    "acceptability": ("aceitabilidade", "aceitabilidadegeral", "acceptability"),
}
SCORES = ("coverage", "precision", "operability", "acceptability")


def _key(name: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "", plain.lower())


def empty(spark: SparkSession) -> DataFrame:
    """No scores, with the columns and types of read()."""
    numbers = ", ".join(f"{n} double" for n in SCORES)
    return spark.createDataFrame([], f"evaluator string, method string, {numbers}, score double, metrics_used long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The delimiter is that of , ; tab | which the header has most of; scores that are no numbers are null;
    rows without evaluator, method or any score are dropped."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path}: no header")
    sep = max(",;\t|", key=header[0].count)
    raw = spark.read.csv(path, sep=sep, header=True)
    named = {n: c for c in raw.columns for n, keys in NAMES.items() if _key(c) in keys}
    if missing := {"evaluator", "method"} - named.keys():
        raise ValueError(f"{path}: no column for {', '.join(sorted(missing))}")
    text = [F.nullif(F.trim(F.col(f"`{named[n]}`")), F.lit("")).alias(n) for n in ("evaluator", "method")]
    numbers = [(F.trim(F.col(f"`{named[n]}`")).try_cast("double") if n in named else F.lit(None).cast("double")).alias(n) for n in SCORES]
    return scored(raw.select(*text, *numbers))


def scored(rows: DataFrame) -> DataFrame:
    score, used = row_score([F.col(n) for n in SCORES])
    return rows.withColumns({"score": score, "metrics_used": used}).dropna(subset=["evaluator", "method", "score"])
