"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a fractional number of copies. Two documents of a source meet
and one hands words over to the other, in a drawn direction, until one of them has
a whole number of copies; the expected copies stay the same and so does the sum of
words. Small groups of documents settle first, what is left of a group goes on to
the next level, and one document per source is rounded in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, rows_with, stored, text_of

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most copies of a document.
SHARE = 1.5
MOST = 2
#: Documents that meet in one group of the reduction tree, on average.
FAN_IN = 32
#: Fractions nearer than this to a whole number count as whole.
EPSILON = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target, _sid, _units)`` from ``(source, size, _rows)``.

    One row per source passes the windows. A source is held at ``most`` times its
    size if that is below the common level that the sources from it on, in order of
    size per weight, would get; the level is the one of the first not held.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size"), F.count(F.lit(1)).alias("_units"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("_sid", F.row_number().over(order))
    sources = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_sid") - 1) % len(weights) + 1).cast("double"))
    cap = F.col("source_size") * float(most)
    by_ratio = Window.orderBy(cap / F.col("_weight"), "_sid")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * share - before) / weight_from
    sources = sources.withColumn("_level", level)
    level = F.max(F.when(cap / F.col("_weight") >= F.col("_level"), F.col("_level"))).over(everything)
    sources = sources.withColumn("_common", F.coalesce(level, F.lit(0.0)))
    return sources.select("source", "source_size", F.least(cap, F.col("_common") * F.col("_weight")).alias("target"), "_sid", "_units")


def _whole(x: Column) -> Column:
    return F.when(x < EPSILON, F.lit(0.0)).when(x > 1 - EPSILON, F.lit(1.0)).otherwise(x)


def _meet(seed: int):
    """Step of the reduction of a group: the document held so far meets the next one."""

    def settled(x: Column, frac: Column) -> Column:
        return F.struct(x["doc"].alias("doc"), x["size"].alias("size"), x["rows"].alias("rows"), (x["base"] + frac.cast("long")).alias("copies"))

    def open_(x: Column, frac: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["doc"].alias("doc"), x["rows"].alias("rows"), x["base"].alias("base"), frac.alias("frac"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["held"]
        up = F.least(a["size"] * (1 - a["frac"]), x["size"] * x["frac"])
        down = F.least(a["size"] * a["frac"], x["size"] * (1 - x["frac"]))
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), a["doc"], a["size"], x["doc"], x["size"]), 11) / float(1 << 53)
        gains = draw * (up + down) < down
        fa = _whole(F.when(gains, a["frac"] + up / a["size"]).otherwise(a["frac"] - down / a["size"]))
        fx = _whole(F.when(gains, x["frac"] - up / x["size"]).otherwise(x["frac"] + down / x["size"]))
        whole = lambda f: (f == 0) | (f == 1)
        # The pair is worked out once, then read by both fields.
        met = F.transform(F.array(F.struct(fa.alias("a"), fx.alias("x"))), lambda m: F.struct(
            F.when(~whole(m["a"]), open_(a, m["a"])).when(~whole(m["x"]), open_(x, m["x"])).alias("held"),
            F.concat(acc["done"], F.when(whole(m["a"]), F.array(settled(a, m["a"]))).otherwise(F.array()), F.when(whole(m["x"]), F.array(settled(x, m["x"]))).otherwise(F.array())).alias("done"),
        ))[0]
        return F.when(a.isNull(), F.struct(open_(x, x["frac"]).alias("held"), acc["done"].alias("done"))).otherwise(met)

    return step


HELD = "struct<size:bigint,doc:bigint,rows:bigint,base:bigint,frac:double>"
DONE = "array<struct<doc:bigint,size:bigint,rows:bigint,copies:bigint>>"


def copies_of(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """``(doc_id, size, rows, copies, source, source_size, target)``: the copies that rows of one id, source and size take together.

    Rows that repeat an id in a source with the same size are one unit with
    several rows, so a hot id stays one row. Documents without words take part in
    nothing. The draws hang on ids and sizes alone: reruns agree.
    """
    units = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    units = stored(units.groupBy("doc", "source", "size").agg(F.count(F.lit(1)).alias("_rows")), "mix-units")
    sources = stored(source_targets(units, weights, share, most), "mix-sources")
    s = sources.select(F.col("source").alias("_s"), "source_size", "target", "_sid", "_units")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("rows")).otherwise(F.lit(0.0))
    units = units.withColumnRenamed("_rows", "rows").join(s, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_want", want)
    base = F.floor(F.col("_want") + EPSILON)
    units = units.withColumn("base", base).withColumn("frac", F.greatest(F.col("_want") - base, F.lit(0.0)))
    open_ = (F.col("frac") > EPSILON) & (F.col("size") > 0)
    done = [units.filter(~open_).select("_sid", "doc", "size", "rows", F.col("base").alias("copies"))]

    groups = F.ceil(F.col("_units") / FAN_IN)
    held = units.filter(open_).select("_sid", F.pmod(F.xxhash64(F.lit(seed), "doc", "size"), groups).alias("_group"), F.struct("size", "doc", "rows", "base", "frac").alias("_unit"))
    width = -(-(sources.agg(F.max("_units")).first()[0] or 0) // FAN_IN)
    zero = F.struct(F.lit(None).cast(HELD).alias("held"), F.array().cast(DONE).alias("done"))
    while width:
        met = held.groupBy("_sid", "_group").agg(F.sort_array(F.collect_list("_unit")).alias("_units"))
        level = stored(met.select("_sid", "_group", F.aggregate("_units", zero, _meet(seed)).alias("_met")).select("_sid", "_group", "_met.*"), "mix-level")
        done.append(level.select("_sid", F.explode("done").alias("d")).select("_sid", "d.doc", "d.size", "d.rows", "d.copies"))
        held = level.filter("held is not null").select("_sid", F.floor(F.col("_group") / FAN_IN).alias("_group"), F.col("held").alias("_unit"))
        width = 0 if width == 1 else -(-width // FAN_IN)
    done.append(held.select("_sid", "_unit.doc", "_unit.size", "_unit.rows", (F.col("_unit.base") + F.round("_unit.frac").cast("long")).alias("copies")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.join(sources.drop("_units"), "_sid").select(F.col("doc").alias("doc_id"), "size", "rows", "copies", "source", "source_size", "target")


def _copies_of_row(i: Column) -> Column:
    """Copies of the i-th row of a unit, from 1."""
    rest = F.col("copies") % F.col("rows")
    return F.floor(F.col("copies") / F.col("rows")) + F.when(i <= rest, 1).otherwise(0)


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    Reads doc_id, text and source only. Null texts and texts without words have
    size 0 and give nothing; null sources form one source, the last. Null ids are
    ids like any other. Of a unit's rows the first ones take a copy more where
    copies don't divide evenly. An empty table gives an empty result. The words
    taken of a source differ from its target by half a document at most.
    """
    rows = copies_of(docs, **parameters).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies_of_row(F.col("_i"))).alias("taken"))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of the mix, each document as often as it is taken, with the columns of ``docs``."""
    plan = copies_of(docs, **parameters).select(F.col("doc_id").alias("_k_doc"), F.col("source").alias("_k_source"), F.col("size").alias("_k_size"), "rows", "copies")
    keys = {"_k_doc": F.col("doc_id").cast("long"), "_k_source": F.col("source").cast("string"), "_k_size": F.regexp_count(text_of(), F.lit(WORD)).cast("long")}
    rows = rows_with(docs, keys, plan.filter("copies > 0")).withColumn("times", _copies_of_row(F.col("row")))
    return rows.filter("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*")
