"""Token counts of documents in flat token files, by a scan for separators.

A token file holds the ids of its documents one after another, `width` little-endian bytes
each, with an end-of-document id after every document and nothing else: no index, no
lengths. Files are cut into blocks anywhere between two ids. A task searches its blocks for
the separator at once (numpy) and reports how many ids lie before the first, between each
two and after the last. A prefix scan over the blocks of a file then gives each block the
documents that ended before it and the ids of the document it begins in the middle of, so
a document may span any number of blocks.

Files are read and written by Spark alone and may be in any store it knows. One file is
one record of the reader, so files are limited to 2 GB (Spark's binaryFile); the writer
makes one per partition.

Edge cases: an empty file has no documents; two separators in a row enclose an empty one;
ids after the last separator are a document that is not ended (`ended` is false); a file
whose length is no multiple of the width raises an error. A null text is an empty document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outvote.llm.columns import needed
from outvote.llm.tokens import Encoder, vocabulary
from outvote.staging import stage, staged_path

WIDTH = 2
#: Ids are stored plus one, which frees 0 for the end of a document.
END_ID = 0
BLOCK_IDS = 1 << 20
#: Ids of a vocabulary that fit the width with the shift.
MOST_IDS = (1 << 8 * WIDTH) - 1


def write_token_files(documents: DataFrame, folder: str, path: str | None = None, tokenizer: str | None = None) -> None:
    """documents: doc_id, text. File number p has partition p's documents in their order."""
    words = vocabulary(documents.sparkSession, path, tokenizer=tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = encoder.ids(text.as_py())
                if len(ids) and int(ids.max()) >= MOST_IDS:
                    raise ValueError(f"id {ids.max()} does not fit {WIDTH} bytes")
                rows.append((ids + np.uint32(1)).astype(f"<u{WIDTH}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    encoded = documents.select("doc_id", "text").mapInArrow(encode, "value binary")
    # the text writer puts the bytes out as they are, each row followed by the separator
    lines = encoded.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0" * WIDTH).option("compression", "none").text(folder)


def _scan(width: int, end_id: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, block, data in zip(*(batch.column(c) for c in ("file", "block", "data"))):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                first = int(ends[0]) if len(ends) else None
                tail = len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)
                rows.append((file.as_py(), block.as_py(), len(ends), first, tail, np.diff(ends) - 1))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "ends", "first", "tail", "inner"])

    return scan


def count_tokens(spark: SparkSession, folder: str, width: int = WIDTH, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Per document: file, ordinal (from 0 in its file), n_tokens (without the separator), ended."""
    size = block_ids * width
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select(F.col("path").alias("file"), "length", "content")
    whole = F.when(F.col("length") % width == 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number of ids: "), F.col("file"))).cast("long")
    )
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / size))
    blocks = files.select("file", "content", F.explode(numbers).alias("block"))
    data = F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size))
    scanned = blocks.select("file", "block", data.alias("data")).mapInArrow(
        _scan(width, end_id), "file string, block long, ends long, first long, tail long, inner array<long>"
    )
    summary = stage(scanned, "token-blocks")
    by_block = Window.partitionBy("file").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    # ids open before a block: all tails so far less those before the last block that has a separator
    opened = summary.withColumn("tails", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    settled = F.last(F.when(F.col("ends") > 0, F.col("tails")), ignorenulls=True).over(before)
    placed = opened.withColumns(
        {
            "carry": F.col("tails") - F.coalesce(settled, F.lit(0)),
            "ordinal": F.coalesce(F.sum("ends").over(before), F.lit(0)),
            "final": F.lead("block").over(by_block).isNull(),
        }
    )
    counts = F.concat(F.array(F.col("carry") + F.col("first")), "inner")
    ended = placed.filter("ends > 0").select("file", "ordinal", F.posexplode(counts).alias("nth", "n_tokens"))
    ended = ended.select("file", (F.col("ordinal") + F.col("nth")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    open_ids = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    rest = placed.filter("final").select("file", (F.col("ordinal") + F.col("ends")).alias("ordinal"), open_ids.alias("n_tokens"))
    return ended.unionByName(rest.filter("n_tokens > 0").withColumn("ended", F.lit(False)))


def document_tokens(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tokenizer: str | None = None
) -> DataFrame:
    """Write the documents' token files and count them: id, n_tokens.

    Files have no ids, so documents are found again by their place, which a second run of
    the same plan over the same columns gives them: partition and row. The count of each
    partition and the length of each text guard this."""
    spark = documents.sparkSession
    rows = needed(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    folder = staged_path(spark, "token-files")
    write_token_files(rows, folder, path, tokenizer)
    counted = count_tokens(spark, folder).withColumn("part", F.regexp_extract("file", r"part-(\d+)-", 1).cast("int"))
    counted = stage(counted, "token-counts")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size], ["doc_id", "size"])

    numbered = rows.mapInArrow(measure, "doc_id long, size long").select(
        "doc_id", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number")
    )
    numbered = numbered.withColumn("ordinal", F.col("number").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = stage(numbered.select("doc_id", "size", "part", "ordinal"), "document-places")
    there, here = (d.groupBy("part").agg(F.count(F.lit(1)).alias(n)) for d, n in ((counted, "a"), (numbered, "b")))
    placed = numbered.join(counted, ["part", "ordinal"])
    unlike = placed.filter("n_tokens > size or (n_tokens = 0) != (size = 0)")
    if there.join(here, "part", "full").filter("a is distinct from b").head(1) or unlike.head(1):
        raise RuntimeError("the input gave its rows in another order; write it to a table first")
    return placed.select(F.col("doc_id").alias(id_col), "n_tokens")
