"""Rolling median with a window that grows with the group.

A window of a twentieth of a group cannot be gathered in one task, so no window
is: every value gets its rank, and the rank of each median is found digit by
digit (base 16). For one digit it is enough to know how many rows of a rank
range lie before two positions, which is a running count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut_lineage

BITS = 4
FAN = 1 << BITS
TILE = 1 << 16


def with_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: Column, name: str) -> DataFrame:
    """0-based position per key; ``by`` is the first of ``order`` as a number.

    Rows are numbered inside tiles, and a tile starts after all earlier ones.
    Approximate quantiles of ``by`` cut the tiles, so that they hold about equally
    many rows however the values crowd; positions don't depend on the cuts. More
    than one tile's share of equal values stays together.
    """
    keys = list(keys)
    n = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("_by", by.cast("double"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_by", [i / n for i in range(1, n)], 16 * n).alias("_cuts"))
    rows = rows.join(cuts, keys).withColumn("_t", F.size(F.filter("_cuts", lambda c: c < F.col("_by")))).drop("_cuts", "_by")
    sizes = rows.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(*order)) - 1
    return rows.withColumn("_k", inside).join(starts, [*keys, "_t"]).withColumn(name, F.col("_s") + F.col("_k")).drop("_t", "_k", "_s")


def _counts_before(rows: DataFrame, points: DataFrame, node: Sequence[str]) -> DataFrame:
    """Per point the number of rows of its node at or before it, for each digit."""
    hot = [F.when(F.col("digit") == d, 1).otherwise(0).cast("bigint").alias(f"d{d}") for d in range(FAN)]
    cols = [f"d{d}" for d in range(FAN)]
    marks = rows.select(*node, "pos", F.lit(0).alias("late"), *hot)
    asked = points.withColumn("late", F.lit(1)).withColumns({c: F.lit(0).cast("bigint") for c in cols})
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("_t", F.floor(F.col("pos") / TILE))
    before = Window.partitionBy(*node).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    tiles = both.groupBy(*node, "_t").agg(*[F.sum(c).alias(c) for c in cols])
    carry = tiles.select(*node, "_t", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"c_{c}") for c in cols])
    upto = Window.partitionBy(*node, "_t").orderBy("pos", "late").rowsBetween(Window.unboundedPreceding, 0)
    run = both.select(*both.columns, *[F.sum(c).over(upto).alias(f"r_{c}") for c in cols]).filter("late = 1")
    return run.join(carry, [*node, "_t"]).select(*points.columns, *[(F.col(f"r_{c}") + F.col(f"c_{c}")).alias(c) for c in cols])


def rolling_median(
    log: DataFrame, key: str = "job_type", order: Sequence[str] = ("ts", "job_id"), value: str = "duration_seconds", least: int = 5, shortest: int = 10, share: int = 20,
    time_number: Column | None = None,
) -> DataFrame:
    """Median of the last ``max(shortest, n // share)`` values per key, from ``least`` values on.

    Groups with fewer than ``shortest`` rows are left out.
    """
    time = F.col(order[0]).cast("timestamp").cast("double") if time_number is None else time_number
    sizes = log.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= shortest)
    rows = with_index(log.join(sizes, key), [key], order, time, "_i")
    rows = cut_lineage(with_index(rows, [key], [value, *order], F.col(value), "_r"))
    ranks = rows.select(key, F.col("_i").alias("pos"), F.col("_r").alias("r"))
    largest = rows.agg(F.max("_n")).first()[0]
    if largest is None:
        return log.withColumn("rolling_median", F.lit(None).cast("double")).limit(0)
    levels = 1
    while FAN**levels < largest:
        levels += 1

    first = F.greatest(F.lit(0), F.col("_i") - F.greatest(F.lit(shortest), F.expr(f"_n div {share}")) + 1)
    asked = rows.select(key, F.col("_i").alias("i"), first.alias("l")).withColumn("m", F.col("i") - F.col("l") + 1).filter(F.col("m") >= least)
    middle = F.array_distinct(F.array(F.expr("(m - 1) div 2"), F.expr("m div 2")))
    queries = asked.withColumn("k", F.explode(middle)).withColumns({"side": F.col("k"), "prefix": F.lit(0).cast("bigint")}).drop("m")
    for level in reversed(range(levels)):
        node = [key, "prefix"]
        here = ranks.select(key, "pos", F.shiftright("r", BITS * (level + 1)).alias("prefix"), F.shiftright("r", BITS * level).bitwiseAND(FAN - 1).alias("digit"))
        ends = F.explode(F.array(F.struct(F.col("i").alias("pos"), F.lit(1).alias("sign")), F.struct((F.col("l") - 1).alias("pos"), F.lit(-1).alias("sign"))))
        points = queries.withColumn("e", ends).select(*queries.columns, "e.*")
        counted = _counts_before(here, points, node)
        inside = counted.groupBy(*queries.columns).agg(F.array(*[F.sum(F.col(f"d{d}") * F.col("sign")) for d in range(FAN)]).alias("n"))
        # the first digit whose running count exceeds the wanted rank
        step = F.aggregate(
            "n", F.struct(F.lit(0).alias("d"), F.col("k").alias("k"), F.lit(False).alias("found")),
            lambda acc, x: F.struct(
                F.when(acc["found"] | (acc["k"] < x), acc["d"]).otherwise(acc["d"] + 1).alias("d"),
                F.when(acc["found"] | (acc["k"] < x), acc["k"]).otherwise(acc["k"] - x).alias("k"),
                (acc["found"] | (acc["k"] < x)).alias("found"),
            ),
        )
        queries = inside.withColumn("s", step).select(key, "i", "l", "side", F.col("s.k").alias("k"), (F.col("prefix") * FAN + F.col("s.d")).alias("prefix"))
        if level % 3 == 2:
            queries = cut_lineage(queries)
    medians = queries.join(rows.select(key, F.col("_r").alias("prefix"), F.col(value).alias("v")), [key, "prefix"]).groupBy(key, "i").agg(F.avg("v").alias("rolling_median"))
    return rows.join(medians.withColumnRenamed("i", "_i"), [key, "_i"], "left").drop("_i", "_r", "_n")
