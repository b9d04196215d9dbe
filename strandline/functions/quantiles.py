"""Exact linear quantiles per group without sorting a whole group in one task.

Approximate splitters only decide how a group is cut into buckets; the result
does not depend on them. Ranks are located through bucket counts, and just the
buckets that hold a wanted rank are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 64


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    keys = list(keys)
    # more splitters on larger clusters, so that a bucket of one large group stays a task's share
    splits = max(SPLITS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / splits for i in range(1, splits)], 16 * splits).alias("_cuts"))
    cut = counts.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda s: s < F.col("_v")))).drop("_cuts")

    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    hist = (
        cut.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_n", F.sum("_m").over(Window.partitionBy(*keys)))
    )
    ranks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, k in ((0, F.floor(at)), (1, F.ceil(at))):
            ranks.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), k.alias("k"), (at - F.floor(at)).alias("frac")))
    wanted = hist.withColumn("_r", F.explode(F.array(*ranks))).filter("_r.k >= _before AND _r.k < _before + _m")

    needed = wanted.select(*keys, "_b", "_before").distinct()
    running = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = cut.join(needed, [*keys, "_b"]).withColumn("_hi", F.col("_before") + F.sum("_c").over(running))
    found = ordered.join(wanted.select(*keys, "_b", "_r"), [*keys, "_b"]).filter("_r.k >= _hi - _c AND _r.k < _hi")

    def pick(i, side, what):
        return F.max(F.when((F.col("_r.i") == i) & (F.col("_r.side") == side), F.col(what)))

    out = []
    for i, name in enumerate(names):
        low, high = pick(i, 0, "_v"), pick(i, 1, "_v")
        out.append((low + (high - low) * pick(i, 0, "_r.frac")).alias(name))
    return found.groupBy(*keys).agg(*out)
