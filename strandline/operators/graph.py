"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import cut_lineage


def _rank(vertex: str, turn: int) -> Column:
    """A vertex with a number that is drawn anew each round, so that no numbering of the vertices makes long chains of pointers."""
    return F.struct(F.xxhash64(vertex, F.lit(turn)).alias("r"), F.col(vertex).alias("v"))


def _merged_into(edges: DataFrame, turn: int) -> DataFrame:
    """``(vertex, into)``: every vertex of an edge points to the least of itself and its neighbours, and on to where that one points."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w"))))
    both = edges.select(ends.alias("e")).select("e.u", "e.w")
    first = both.groupBy("u").agg(F.min(_rank("w", turn)).alias("m")).select("u", F.least("m", _rank("u", turn))["v"].alias("to"))
    second = first.select(F.col("u").alias("to"), F.col("to").alias("into"))
    return first.join(second, "to").select(F.col("u").alias("vertex"), "into")


def contractions(edges: DataFrame) -> list[DataFrame]:
    """One table ``(vertex, into)`` per round, until no edge is left.

    A round merges every vertex into a neighbour of lower rank, renames the ends of
    the edges and drops loops and repeated edges, so both vertices and edges shrink: on
    average fewer than half of the vertices are left by each round, on a chain too.
    """
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        into = cut_lineage(_merged_into(edges, len(rounds)))
        rounds.append(into)
        for end in ("a", "b"):
            edges = edges.join(into.withColumnsRenamed({"vertex": end, "into": "_to"}), end).withColumn(end, F.col("_to")).drop("_to")
        edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return rounds


def connected_components(edges: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, vertex, component)``; the component is its smallest vertex.

    No neighbour list is ever built and nothing is collected: every step is an
    aggregate or an equi-join on an edge set that shrinks from round to round, and the
    lineage is cut with reliable checkpoints. Rounds end when no edge is left; their
    tables are then followed from the last, smallest one back to the first.
    """
    keys = list(keys)
    u, v = F.struct(*keys, F.col(a).alias("id")), F.struct(*keys, F.col(b).alias("id"))
    pairs = cut_lineage(edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct())
    loops = pairs.filter("a = b").select(F.col("a").alias("vertex"), F.col("a").alias("root"))
    found = None
    for into in reversed(contractions(pairs.filter("a <> b"))):
        found = into.withColumnRenamed("into", "root") if found is None else (
            into.join(found.withColumnRenamed("vertex", "into"), "into", "left").select("vertex", F.coalesce("root", "into").alias("root"))
        )
    if found is None:
        members = loops.select("vertex", F.col("root").alias("least"))
    else:
        # A vertex may have a loop beside its edges.
        found = found.unionByName(loops.join(found, "vertex", "left_anti"))
        least = found.groupBy("root").agg(F.min("vertex").alias("least"))
        members = found.join(least, "root")
    return members.select(*[F.col(f"vertex.{k}").alias(k) for k in keys], F.col("vertex.id").alias("vertex"), F.col("least.id").alias("component"))
