"""Line dedup over levelled sorted runs of line hashes.

A run is a written table (key hash, first document), sorted by hash. Batches
come in id order. Each new batch reduces its lines to one row per key, merge-
anti-joins the runs held so far and adds what is new as a run of level 0;
``fanout`` runs of a level are merged into one of the next. Keys of different
runs are disjoint, so merging is a sorted union. The runs of all batches then
say for each line which document holds it.

Null or empty text is one empty line. A null id is compared with nothing: its
lines stay and hold no key. Rows sharing an id are one document with several
texts, each answered by a row of its own; an empty table gives no rows.
Hashes are two 64-bit values of the key, 128 bits in all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from larder.llm.common import lower_ascii, written

WHITE = " \t\n\x0b\f\r"
HASH = ["ha", "hb"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """The levelled runs of one line store."""

    def __init__(self, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.fanout, self.levels = fanout, [[]]

    def tables(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def holders(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables())

    def add(self, lines: DataFrame) -> None:
        """Lines (ha, hb, id) of one batch, whose ids are above those of earlier batches."""
        new = lines.groupBy(*HASH).agg(F.min("id").alias("first"))  # combined before the shuffle: a hot line is one row a task
        if self.tables():
            new = new.join(self.holders().select(*HASH).hint("merge"), HASH, "left_anti")
        self._put(0, new)

    def _put(self, level: int, keys: DataFrame) -> None:
        run = written(keys.repartitionByRange(*HASH).sortWithinPartitions(*HASH), f"line-run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = reduce(DataFrame.unionByName, self.levels[level]), []
            self._put(level + 1, merged)


def _cuts(ids: DataFrame, batches: int) -> list:
    """Ids that cut the documents into about equal batches; where they fall does not change the result."""
    if isinstance(ids.schema["id"].dataType, NumericType):
        return ids.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    ranged = ids.where("id IS NOT NULL").repartitionByRange(batches, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("id"))
    return sorted(r["id"] for r in ranged.collect())[:-1]  # one row a batch


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4,
                fanout: int = 2) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped and the text that stays.

    A key (line stripped of ASCII white space, A-Z lowered) of at least ``min_chars`` code points
    found in two or more documents keeps its lines only in the smallest id that holds it.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    cuts = _cuts(docs.select("id"), batches)
    batch = reduce(lambda a, c: a + (F.col("id") > c).cast("int"), sorted(set(cuts)), F.lit(0))
    key = line_key(F.col("line"))
    lines = docs.where("id IS NOT NULL").select("id", "t", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).where(
        F.length(key) >= min_chars).select("id", "t", "pos", F.xxhash64(key).alias("ha"), F.xxhash64(F.lit("second"), key).alias("hb"),
                                           batch.alias("batch"))
    lines = written(lines, "lines", "batch")
    runs = Runs(fanout)
    for k in range(len(set(cuts)) + 1):
        runs.add(lines.where(F.col("batch") == k).select(*HASH, "id"))
    lost = lines.join(runs.holders().hint("merge"), HASH).where(F.col("first") < F.col("id")).groupBy("id", "t").agg(
        F.collect_set("pos").alias("lost"))  # at most the lines of one text
    all_lines = split_lines(F.col("text"))
    n = F.size(all_lines)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    text = F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_sort(kept), lambda i: F.get(F.col("lines"), i)), "\n"))
    return docs.join(lost, ["id", "t"], "left").withColumn("lines", all_lines).select(
        F.col("id").alias(id_col), n.cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))
