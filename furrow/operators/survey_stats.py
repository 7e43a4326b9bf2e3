"""Statistics over survey scores: rows (evaluator, method, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions.text import method_id, method_label

TIE = 1e-12
MAX_EXACT = 20


def row_score(columns: list[Column]) -> tuple[Column, Column]:
    """(mean of the non-null columns, their number)."""
    present = F.filter(F.array(*columns), lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(present, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(present) > 0, total / F.size(present)), F.size(present).cast("long")


def method_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("evaluator", "method").agg(F.avg("score").alias("score"))


def mean_rank(means: DataFrame, leave_out: str = "spraying-mrr") -> DataFrame:
    """(method, mean_rank, n): ranks within each evaluator, best score first, ties sharing their mean rank."""
    x = means.where(F.col("method") != leave_out)
    rank = F.rank().over(Window.partitionBy("evaluator").orderBy(F.desc("score")))
    peers = F.count("*").over(Window.partitionBy("evaluator", "score"))
    return x.select("method", (rank + (peers - 1) / 2).alias("r")).groupBy("method").agg(F.avg("r").alias("mean_rank"), F.count("*").alias("n"))


def paired(means: DataFrame) -> DataFrame:
    """(method_a, method_b, evaluator, diff) of all ordered pairs of methods that an evaluator scored.

    The join is on the evaluator, whose rows are its methods: pairs grow with methods per evaluator only.
    """
    a, b = (means.select("evaluator", F.col("method").alias(f"method_{s}"), F.col("score").alias(f"s{s}")) for s in "ab")
    return a.join(b, "evaluator").where("method_a <> method_b").select("method_a", "method_b", "evaluator", (F.col("sa") - F.col("sb")).alias("diff"))


def win_tie_loss(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("method_a", "method_b").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("diff") > TIE).alias("wins"),
        F.count_if(F.abs("diff") <= TIE).alias("ties"),
        F.count_if(F.col("diff") < -TIE).alias("losses"),
        F.avg("diff").alias("mean_difference"),
        F.array_sort(F.collect_list("evaluator")).alias("paired_evaluators"),
    )


def sign_flip_test(pairs: DataFrame, max_n: int = MAX_EXACT) -> DataFrame:
    """(method_a, method_b, n_permutations, p_value): exact paired permutation test.

    All 2^n sign patterns are rows of a sequence; each pattern's sum is folded over the n differences.
    More than max_n evaluators are refused rather than approximated.
    """
    x = pairs.groupBy("method_a", "method_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("evaluator", "diff"))), lambda v: v["diff"]).alias("d"))
    x = x.withColumn("n", F.when(F.size("d") > max_n, F.raise_error(F.lit(f"more than {max_n} paired evaluators"))).otherwise(F.size("d")))
    x = x.withColumn("mask", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.col("n")).cast("int") - 1)))
    flipped = F.aggregate(F.transform("d", lambda v, i: F.when(F.getbit(F.col("mask").cast("long"), i) == 1, -v).otherwise(v)), F.lit(0.0), lambda a, v: a + v) / F.col("n")
    seen = F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / F.col("n")
    x = x.groupBy("method_a", "method_b").agg(F.count("*").alias("n_permutations"), F.count_if(F.abs(flipped) >= F.abs(seen) - TIE).alias("hits"))
    one = F.col("n_permutations") == 2
    return x.select("method_a", "method_b", "n_permutations", F.when(one, 1.0).otherwise(F.col("hits") / F.col("n_permutations")).alias("p_value"))


def comparison_type(a: Column, b: Column, baselines: list[str]) -> Column:
    """Kind of a pair of normalised method ids; `manual`: b is a without its last four characters."""
    return F.when(b == F.substring(a, F.lit(1), F.greatest(F.length(a) - 4, F.lit(0))), "mrr_vs_manual").when(b.isin(*baselines), "mrr_vs_baseline").when(b.endswith("-mrr"), "mrr_vs_mrr").otherwise("mrr_vs_other")


def bootstrap(scores: DataFrame, draws: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(method, n, mean_score, ci_low, ci_high): percentile bootstrap of the mean.

    Every method has its own seed, so that methods are independent of each other and of their order.
    Scores are reduced to counts of distinct values first (survey scales have few), so a task sees
    value counts, and a resample is a multinomial draw over them.
    """
    counts = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("method", "score").count()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        v, c = rows["score"].to_numpy(), rows["count"].to_numpy()
        n, name = int(c.sum()), rows["method"].iloc[0]
        mean = float((v * c).sum() / n)
        if n == 1:
            return pd.DataFrame([(name, 1, mean, mean, mean)], columns=["method", "n", "mean_score", "ci_low", "ci_high"])
        rng = np.random.default_rng([seed, *name.encode()])
        means = rng.multinomial(n, c / n, size=draws) @ v / n
        lo, hi = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame([(name, n, mean, lo, hi)], columns=["method", "n", "mean_score", "ci_low", "ci_high"])

    return counts.groupBy("method").applyInPandas(run, "method string, n long, mean_score double, ci_low double, ci_high double")


def heatmap(results: DataFrame, labels: list[str] | None = None, row: str = "method_a", column: str = "method_b") -> DataFrame:
    """mean_difference by `row` and `column`; labels: the columns, all in order if not given (methods are few)."""
    labels = labels or [r[0] for r in results.select(column).distinct().orderBy(column).collect()]
    return results.groupBy(row).pivot(column, labels).agg(F.first("mean_difference"))


LEFT_OUT = "Generic MRR"


def heatmap_notes(results: DataFrame) -> DataFrame:
    """(label_a, label_b, note): what each cell of the heatmap says, without the method LEFT_OUT."""
    d = F.bround("mean_difference", 2)
    x = results.where((F.col("label_a") != LEFT_OUT) & (F.col("label_b") != LEFT_OUT))
    sign = F.when(F.col("mean_difference") > 0, "+").when((F.col("mean_difference") < 0) & (d == 0), "-").otherwise("")
    number = F.concat(sign, F.format_string("%.2f", d))
    return x.select("label_a", "label_b", F.concat(number, F.lit("\n("), F.concat_ws(", ", *[F.concat(F.col(c).cast("string"), F.lit(k)) for c, k in (("wins", "W"), ("ties", "D"), ("losses", "L"))]), F.lit(")")).alias("note"))


def with_mean_rank(summary: DataFrame, ranks: DataFrame) -> DataFrame:
    """summary with mean_rank and n_ranked; methods without a rank have NaN and 0."""
    r = ranks.select("method", F.col("mean_rank").alias("_r"), F.col("n").alias("_n"))
    x = summary.join(r, "method", "left")
    return x.withColumns({"mean_rank": F.coalesce("_r", F.lit(float("nan"))), "n_ranked": F.coalesce("_n", F.lit(0)).cast("long")}).drop("_r", "_n")


def method_summary(scores: DataFrame) -> DataFrame:
    """(place, method, label, n, mean_score, ci_low, ci_high, mean_rank, n_ranked), best mean first, then by label.

    Ranks are over single rows of an evaluator, as in a survey with one row for each method.
    """
    x = with_mean_rank(bootstrap(scores), mean_rank(scores.where(F.col("score").isNotNull() & ~F.isnan("score"))))
    x = x.withColumn("label", method_label(F.col("method")))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_score"), "label")).cast("long"))


def pair_summary(means: DataFrame, baselines: list[str]) -> DataFrame:
    """win_tie_loss() and sign_flip_test() of all ordered pairs, with labels and the kind of comparison."""
    pairs = paired(means)
    x = win_tie_loss(pairs).join(sign_flip_test(pairs), ["method_a", "method_b"])
    labels = {f"label_{s}": method_label(F.col(f"method_{s}")) for s in "ab"}
    kind = comparison_type(method_id(F.col("method_a")), method_id(F.col("method_b")), baselines)
    return x.withColumns(labels | {"comparison_type": kind})


# Columns of the wide report, and the row that stands for a survey without data.
REPORT = ("section", "method_id", "method_label", "n", "mean_score", "ci_low", "ci_high", "mean_rank", "comparison_type", "method_a_id", "method_a_label", "method_b_id", "method_b_label", "n_pairs", "n_permutations", "wins", "ties", "losses", "mean_difference", "p_value", "paired_evaluators")
NO_DATA = ("no-likert-data", "Likert data unavailable")


def wide_report(methods: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both summaries in one table of text columns, empty where a section has no such value, sections in order."""
    a = methods.select(F.lit("method_summary").alias("section"), "place", F.col("method").alias("method_id"), F.col("label").alias("method_label"), "n", "mean_score", "ci_low", "ci_high", "mean_rank")
    b = pairs.withColumnsRenamed({f"method_{s}": f"method_{s}_id" for s in "ab"} | {f"label_{s}": f"method_{s}_label" for s in "ab"})
    b = b.withColumns({"section": F.lit("paired"), "paired_evaluators": F.array_join("paired_evaluators", "; ")})
    x = a.unionByName(b, allowMissingColumns=True).orderBy("section", "place", "method_a_id", "method_b_id")
    return x.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in REPORT])


def zero_summary(spark: SparkSession) -> DataFrame:
    """The method summary of a survey without data: one row of zeros."""
    zeros = {c: F.lit(0.0) for c in ("mean_score", "ci_low", "ci_high", "mean_rank")}
    return spark.range(1).select(F.lit(1).cast("long").alias("place"), F.lit(NO_DATA[0]).alias("method"), F.lit(NO_DATA[1]).alias("label"), F.lit(0).cast("long").alias("n"), *[v.alias(k) for k, v in zeros.items()], F.lit(0).cast("long").alias("n_ranked"))


def report_text(source: str, scores: DataFrame, methods: DataFrame, pairs: DataFrame) -> str:
    """The report as fixed-width text; its rows are methods and pairs of methods."""
    n = scores.agg(F.count("*").alias("rows"), F.countDistinct("evaluator").alias("people"), F.countDistinct("method").alias("methods")).first()
    out = [f"Survey statistics of {source}", f"Valid rows: {n.rows}", f"Evaluators: {n.people}", f"Methods: {n.methods}", ""]
    out += [f"{'Method':<28} {'n':>3} {'Mean':>8} {'95% CI Low':>15} {'95% CI High':>15} {'Mean Rank':>10}", "-" * 88]
    out += [f"{r.label:<28} {r.n:>3d} {r.mean_score:>8.3f} {r.ci_low:>15.3f} {r.ci_high:>15.3f} {r.mean_rank:>10.3f}" for r in methods.orderBy("place").collect()]
    rows = pairs.orderBy("method_a", "method_b").collect()
    if rows:
        out += ["", f"{'Comparison':<36} {'n':>3} {'W':>3} {'D':>3} {'L':>3} {'Mean Diff':>11} {'exact p':>10} {'2^n':>6}", "-" * 100]
        out += [f"{r.label_a + ' vs ' + r.label_b:<36} {r.n_pairs:>3d} {r.wins:>3d} {r.ties:>3d} {r.losses:>3d} {r.mean_difference:>11.3f} {r.p_value:>10.4f} {r.n_permutations:>6d}" for r in rows]
    return "\n".join(out)
