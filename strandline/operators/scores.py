"""Classifier score histories, hierarchies and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: lowest percent of high, medium and low confidence per classifier
CONFIDENCE = {
    "sturgeon": (95.0, 80.0, 0.0),
    "nanodx": (50.0, 25.0, 0.0),
    "pannanodx": (50.0, 25.0, 0.0),
    "random_forest": (85.0, 65.0, 0.0),
}
DEFAULT_CONFIDENCE = (80.0, 50.0, 20.0)


def confidence_level(score: Column, classifier: Column) -> Column:
    """High, medium, low or very low confidence by the thresholds of the classifier."""
    def level(bounds):
        return F.when(score >= bounds[0], "High confidence").when(score >= bounds[1], "Medium confidence").when(score >= bounds[2], "Low confidence").otherwise("Very low confidence")

    out = None
    for name, bounds in CONFIDENCE.items():
        out = F.when(classifier == name, level(bounds)) if out is None else out.when(classifier == name, level(bounds))
    return out.otherwise(level(DEFAULT_CONFIDENCE))


def as_percent(score: Column, classifier: Column) -> Column:
    """Forest scores above 1 are percent already; all others are fractions."""
    return F.when((classifier == "random_forest") & (score > 1), score).otherwise(score * 100.0)


def classifier_top(scores: DataFrame, n: int = 1) -> DataFrame:
    """The best ``n`` classes of the latest row of each classifier, with their level."""
    key = ["sample_id", "classifier"]
    last = scores.groupBy(*key).agg(F.max("batch_id").alias("batch_id"))
    rows = scores.join(last, [*key, "batch_id"])
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "class_name")
    top = rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)
    top = top.withColumn("confidence", F.round(as_percent(F.col("score"), F.col("classifier")), 4))
    return top.withColumn("level", confidence_level(F.col("confidence"), F.col("classifier"))).drop("score")


def top_classes(scores: DataFrame, n: int = 10, by: str = "last", minimum: float | None = None) -> DataFrame:
    """Top classes by their last or highest value; ``minimum`` is asked of the highest."""
    key = ["sample_id", "classifier"]
    per = scores.groupBy(*key, "class_name").agg(F.max_by("score", "batch_id").alias("last"), F.max("score").alias("highest"))
    if minimum is not None:
        per = per.filter(F.col("highest") >= minimum)
    value = "last" if by == "last" else "highest"
    w = Window.partitionBy(*key).orderBy(F.desc(value), "class_name")
    return per.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def score_hierarchy(nested: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Nested ``{group, score, members[]}`` nodes of three levels to rows with summed scores."""
    keys = list(keys)
    one = nested.select(*keys, F.explode_outer("members").alias("a"))
    two = one.select(*keys, F.col("a.group").alias("l1"), F.explode_outer("a.members").alias("b"))
    three = two.select(*keys, "l1", F.col("b.group").alias("l2"), F.explode_outer("b.members").alias("c"))
    leaf = three.select(*keys, "l1", "l2", F.col("c.group").alias("l3"), F.col("c.score").alias("score"))
    levels = F.array(
        F.struct(F.lit(1).cast("bigint").alias("level"), F.col("l1").alias("name")),
        F.struct(F.lit(2).cast("bigint").alias("level"), F.concat_ws("/", "l1", "l2").alias("name")),
        F.struct(F.lit(3).cast("bigint").alias("level"), F.concat_ws("/", "l1", "l2", "l3").alias("name")),
    )
    rows = leaf.select(*keys, "score", F.explode(levels).alias("n"))
    return rows.groupBy(*keys, F.col("n.level").alias("level"), F.col("n.name").alias("name")).agg(F.sum("score").alias("score"))


def top_nodes(levels: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("sample_id", "level").orderBy(F.desc("score"), "name")
    return levels.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def calibrate_scores(logits: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Softmax of temperature-scaled logits per model; the model with the highest score wins."""
    key = ["sample_id", "model"]
    scaled = logits.join(temperatures, "model").withColumn("x", F.col("logit") / F.col("temperature"))
    peak = scaled.groupBy(*key).agg(F.max("x").alias("_m"))
    shifted = scaled.join(peak, key).withColumn("_e", F.exp(F.col("x") - F.col("_m")))
    total = shifted.groupBy(*key).agg(F.sum("_e").alias("_t"))
    probs = shifted.join(total, key).select(*key, "class_name", (F.col("_e") / F.col("_t")).alias("probability"))
    winner = probs.groupBy("sample_id").agg(F.max(F.struct("probability", "model")).alias("w")).select("sample_id", F.col("w.model").alias("model"))
    return probs.join(winner, key)


def measured_probes(features: DataFrame) -> DataFrame:
    """Number of probes with a call per sample."""
    return features.filter("methylation_call <> 0").groupBy("sample_id").agg(F.count(F.lit(1)).alias("number_probes"))


def fraction_series(log: DataFrame) -> DataFrame:
    """Log entries with a map of proportions to a percent series per type."""
    return log.select("sample_id", "ts", F.explode("proportions").alias("type", "_p")).select("sample_id", "type", (F.col("ts") * 1000).alias("ts_ms"), (F.col("_p") * 100.0).alias("percent"))
