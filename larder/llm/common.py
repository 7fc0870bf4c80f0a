"""What the operators of this subpackage share: input tables, label folds, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.session import scratch_path

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(c, LETTERS, LETTERS.lower())


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text modulo ``mod``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(0))


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1 << 20


def broadcast_if_small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Narrow keys, marked for broadcast when counted to be at most ``rows``; beyond that joins shuffle as usual.

    Filtering texts by a short list of ids then leaves the texts where they lie.
    """
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def rows_per_batch(spark: SparkSession, rows: int = 512):
    """Fewer rows in an Arrow batch, so that a batch of long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, folds: int, held_fold: int,
                    rows: int, max_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample to fit a classifier on, and the number of labelled rows per class outside the held fold.

    Of each class at most ``rows`` rows of smallest hash and ``max_bytes`` of text, as (id, text, label, part); part is 0
    or 1 by hash. A text that does not fit is left out, and of a class without a fitting text the shortest is taken. Null and other labels are left out; an id labelled twice has its largest label.
    """
    lab = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where(
        "label IN (0, 1) AND id IS NOT NULL").where(fold(F.col("id"), folds) != held_fold).groupBy("id").agg(F.max("label").alias("label"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("h"))
    narrow = keyed.select("id", "h", F.octet_length("text").alias("size")).join(lab, "id").distinct()
    known = {r["label"]: r["count"] for r in narrow.groupBy("label").count().collect()}
    chosen = []
    for k in sorted(known):
        used, mine = 0, narrow.where(F.col("label") == k)
        fitting = mine.where(F.col("size") < max_bytes).orderBy("h", "id").limit(rows).collect()
        for r in fitting or mine.orderBy("size", "h", "id").limit(1).collect():
            if used + r["size"] + 1 <= max_bytes or not used:
                used += r["size"] + 1
                chosen.append((r["id"], r["h"], k))
    kind = narrow.schema["id"].dataType.simpleString()
    few = docs.sparkSession.createDataFrame(chosen, f"id {kind}, h long, label int")  # at most 2 * rows
    return keyed.join(F.broadcast(few), ["id", "h"]).select(
        "id", "text", "label", F.pmod(F.xxhash64(F.lit("part"), "h"), F.lit(2)).cast("int").alias("part")), known
