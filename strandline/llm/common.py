"""Helpers shared by the operators: fixed patterns, tables in the shared folder, text columns."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import scratch_path

#: White space of the contracts, as a regular expression that Java, Python and RE2 read alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of one Arrow batch, so that a run of long texts doesn't fill a worker.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table below the shared folder and reads it: the lineage ends here and outlives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables made by ``stored`` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all tasks share."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes and rows for the session that runs Python over long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; a row without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that training may use: those with an id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def bounded_sample(rows: DataFrame, label: str, key: str, most: Column) -> DataFrame:
    """At most ``most`` rows of each label, those first in hash order of ``key``, with their number ``_n``.

    Rows are thinned by their hash to about twice what is wanted before they meet,
    so that what a label's window sees doesn't grow with the table.
    """
    counts = stored(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_rows")), "label-counts")
    near = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < (2.0 * most + 200) / F.col("_rows") * float(1 << 30)
    order = Window.partitionBy(label).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key)
    return rows.join(counts, label).filter(near).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_rows")


def rows_with(docs: DataFrame, keys: dict[str, Column], plan: DataFrame) -> DataFrame:
    """Rows of ``docs`` joined with the rows of ``plan`` that have the same keys, nulls included.

    Gives ``doc``, the whole row as a struct so that no name can clash, ``row``, its
    number from 1 among the rows of the key by text, and the other columns of
    ``plan``, which has one row per key. Where ids repeat, ``row`` tells the rows
    apart on the partitioning of the join.
    """
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *[v.alias(f"here_{k}") for k, v in keys.items()])
    same = None
    for k in keys:
        one = packed[f"here_{k}"].eqNullSafe(plan[k])
        same = one if same is None else same & one
    order = Window.partitionBy(*[f"here_{k}" for k in keys]).orderBy("doc.text")
    rest = [c for c in plan.columns if c not in keys]
    return packed.join(plan, same).select("doc", F.row_number().over(order).alias("row"), *rest)
