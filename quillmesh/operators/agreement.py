"""Agreement of two raters and quality summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, a: str = "primary", b: str = "verifier") -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def agreement_label(k: Column) -> Column:
    """Words for a kappa, by fixed thresholds."""
    steps = ((0.0, "poor (worse than chance)"), (0.20, "slight"), (0.41, "fair"), (0.61, "moderate"), (0.81, "substantial"))
    return F.when(k.isNotNull(), reduce(lambda rest, s: F.when(k < s[0], s[1]).otherwise(rest), reversed(steps), F.lit("almost perfect")))


def cohen_kappa(df: DataFrame, a: str = "primary", b: str = "verifier", *by: str) -> DataFrame:
    """by..., n, po, pe, kappa, label; kappa is null where chance alone agrees always.

    Everything follows from the counts of pairs, a table as small as the square of the labels.
    """
    cells = df.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    rows = cells.groupBy(*by, F.col("_a").alias("_l")).agg(F.sum("_n").alias("_r"))
    columns = cells.groupBy(*by, F.col("_b").alias("_l")).agg(F.sum("_n").alias("_c"))
    chance = rows.join(columns, [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("_r") * F.col("_c")).alias("_e"))
    total = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_o"))
    both = total.join(chance, list(by), "left") if by else total.crossJoin(chance)
    po, pe = F.col("_o") / F.col("n"), F.coalesce("_e", F.lit(0)) / (F.col("n") * F.col("n"))
    k = (F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))
    out = both.withColumns({"po": po, "pe": pe}).withColumn("kappa", k)
    return out.select(*by, "n", "po", "pe", "kappa", agreement_label(F.col("kappa")).alias("label"))


def disagreement_list(*sets: tuple[str, DataFrame]) -> DataFrame:
    """stage, id, title, primary, verifier, binary: what raters differ in by include or not, of several tables, each with its stage.

    Each table: id, title, primary, verifier. Null decisions count as not included; titles are cut at 200.
    """
    two = lambda c: F.when(F.lower(F.coalesce(c, F.lit(""))) == "include", "include").otherwise("not_include")
    one = [df.withColumns({"_p": two("primary"), "_v": two("verifier")}).filter("_p <> _v").select(F.lit(stage).alias("stage"), "id", F.left(F.coalesce("title", F.lit("")), F.lit(200)).alias("title"), "primary", "verifier", F.concat("_p", F.lit(" vs "), "_v").alias("binary")) for stage, df in sets]
    return reduce(lambda a, b: a.unionByName(b), one)


def quality_total(items: list[str]) -> Column:
    """Sum of items that may be null; null if all are."""
    return F.when(F.coalesce(*items).isNotNull(), sum(F.coalesce(i, F.lit(0)) for i in items))


def quality_summary(df: DataFrame, total: str = "qa_total", cut: int = 4, *by: str) -> DataFrame:
    x = F.col(total)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(x).alias("assessed"), F.count_if(x >= cut).alias("passed"), F.count_if(x < cut).alias("failed"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), q.alias("_q")
    )
    return out.select(*by, "n", "assessed", "passed", "failed", "mean", "sd", *(F.col("_q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))))


def merge_scores(old: DataFrame, new: DataFrame, key: str, value: str, manual: tuple[str, ...] = ("manual", "reviewed")) -> DataFrame:
    """New scores over old ones, except where a person set the old one; ids of either side are kept."""
    both = old.select(key, F.col(value).alias("_old"), "status").join(new.select(key, F.col(value).alias("_new")), key, "full_outer")
    held = F.coalesce(F.col("status").isin(*manual), F.lit(False))
    return both.select(key, F.when(held, F.col("_old")).otherwise(F.coalesce("_new", "_old")).alias(value), F.when(held, F.col("status")).when(F.col("_new").isNotNull(), "scored").otherwise(F.col("status")).alias("status"))
