"""Line dedup against levelled sorted runs.

Documents come in batches of ascending id. Each batch's line keys are counted, merge-joined
with the runs of the batches before it (bucketed and sorted by key, so the runs never
shuffle), and written as a run of the keys they lack. When a level has `fanout` runs they
are compacted into one run of the next level, so a batch meets few runs however many came
before. A key's first holder is thereby the smallest id that has it.

Nulls and ties: a null text is one empty line; a null id counts as larger than any id;
rows that share an id hold a line together and all keep it; repeated rows give repeated
results; an empty table gives an empty result. Other columns of the input pass through,
but for any named n_lines or n_dropped."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outvote.llm.columns import Beside, named
from outvote.staging import stage, staged_path

#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than 1/HOT_SHARE of a batch's lines is looked up by broadcast; there
#: are at most HOT_SHARE such keys.
HOT_SHARE = 512
#: Stands for a null id: after every other.
LAST = (1 << 63) - 1

KEY = ["__h1", "__h2"]
ROW = ["__id", "__text_hash"]


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _keyed_lines(rows: DataFrame, text: str, min_chars: int) -> DataFrame:
    line = F.translate(F.trim(F.col("__line"), F.lit(BLANKS)), UPPER, LOWER)
    exploded = rows.select("__batch", *ROW, F.posexplode(_lines(text)).alias("__pos", "__line"))
    keyed = exploded.select("__batch", *ROW, "__pos", line.alias("__key")).filter(F.char_length("__key") >= min_chars)
    # two hashes with different seeds: 128 bits
    return keyed.select(
        "__batch", *ROW, "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), F.col("__key")).alias("__h2")
    )


class Runs:
    """Sorted runs of (key, first id) in levels."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.written: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"outvote_run_{uuid.uuid4().hex}"
        self.written.append(name)
        writer = df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        writer.option("path", staged_path(self.spark, "line-run")).saveAsTable(name)
        return name

    def drop(self) -> None:
        """Take the runs out of the catalog; their files go with the staged ones."""
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _keys(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("__new").select(*KEY, "__first")

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge a batch's lines: its keys with the id that keeps them, where any other has one."""
        found = lines.groupBy(*KEY).agg(
            F.min("__id").alias("__own"), F.max("__id").alias("__last"), F.count(F.lit(1)).alias("__n")
        )
        older = []
        for i, name in enumerate(run for level in self.levels for run in level):
            found = found.join(self._keys(name).withColumnRenamed("__first", f"__seen{i}"), KEY, "left")
            older.append(F.col(f"__seen{i}"))
        marked = found.select(
            *KEY,
            F.coalesce(*older, F.col("__own")).alias("__first"),
            (F.coalesce(*older).isNull() if older else F.lit(True)).alias("__new"),
            "__last",
            "__n",
        )
        name = self._write(marked)
        self.levels[0].append(name)
        return self.spark.table(name).filter("__first < __last").select(*KEY, "__first", "__n")

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            merged = reduce(DataFrame.unionByName, map(self._keys, level)).withColumn("__new", F.lit(True))
            self.levels[k + 1].append(self._write(merged.repartition(self.buckets, *KEY)))
            self.levels[k] = []


def _doomed(lines: DataFrame, repeated: DataFrame, n_lines: int) -> DataFrame:
    """Positions of lines whose key an earlier id keeps."""
    hot = repeated.filter(F.col("__n") > n_lines // HOT_SHARE).select(*KEY, F.col("__first").alias("__hot"))
    cool = repeated.filter(F.col("__n") <= n_lines // HOT_SHARE).select(*KEY, "__first")
    marked = lines.join(F.broadcast(hot), KEY, "left")
    at_once = marked.filter(F.col("__hot") < F.col("__id")).select(*ROW, "__pos")
    rest = marked.filter(F.col("__hot").isNull()).drop("__hot").join(cool, KEY).filter("__first < __id")
    return at_once.unionByName(rest.select(*ROW, "__pos"))


def dedup_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """The documents without lines that a document of smaller id holds, with columns
    n_lines (before) and n_dropped. Lines compare without blanks at their ends and
    without ASCII case; those under min_chars code points stay."""
    spark = documents.sparkSession
    rows = Beside(
        documents, __id=F.coalesce(named(id_col).cast("long"), F.lit(LAST)), __text_hash=F.xxhash64(named(text_col))
    )
    marked, text_col = rows.df, rows.number(text_col)
    cuts = marked.approxQuantile("__id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum(((F.col("__id") > F.lit(int(c))).cast("int") for c in sorted(set(cuts))), F.lit(0))
    lines = stage(_keyed_lines(marked.withColumn("__batch", batch), text_col, min_chars), "lines", ["__batch"])
    sizes = {r["__batch"]: r["count"] for r in lines.groupBy("__batch").count().collect()}  # at most `batches` rows
    runs, dropped = Runs(spark, fanout), []
    try:
        for number, b in enumerate(sorted(sizes)):
            part = lines.filter(F.col("__batch") == b).drop("__batch")
            dropped.append(stage(_doomed(part, runs.add(part), sizes[b]), "doomed-lines"))
            if number + 1 < len(sizes):
                runs.compact()
    finally:
        runs.drop()
    if not dropped:
        made = [F.size(_lines(text_col)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")]
        return marked.select(*rows.others(["n_lines", "n_dropped"]), *made)
    gone = reduce(DataFrame.unionByName, dropped).groupBy(*ROW).agg(F.collect_set("__pos").alias("__gone"))
    joined = marked.join(gone, ROW, "left").withColumn("__lines", _lines(text_col))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(places, lambda i: F.col("__lines")[i]), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn(text_col, text).select(
        *rows.others(["n_lines", "n_dropped"]),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
