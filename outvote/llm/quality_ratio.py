"""Quality rules: repetition and length, then a hashed n-gram likelihood ratio.

Words and pairs of words are hashed into BUCKETS. Two multinomials over the buckets are
counted: the corpus (every document, whole) and a trusted target (documents labelled of
good quality, a bounded sample). A text's score is the mean log ratio of target to corpus
over its n-grams, so length does not matter; texts under THRESHOLD are not kept. The target
is smoothed towards the corpus, so a bucket the target knows nothing of weighs little.

TRUSTED_ROWS bounds the target's documents (least md5 of the id); their ids are broadcast.
The ratios are one table of BUCKETS numbers.

Nulls and ties: a null text has no words and fails the base rules; a null id is scored like
any; repeated rows are counted and scored each; without trusted documents all ratios are 0
and the base rules decide alone. An empty table gives an empty result. Input columns named
like the result's give way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outvote.functions.arrow import map_in_arrow
from outvote.llm.columns import needed, others
from outvote.llm.text_arrays import BASE, Texts, Words, chunked, mix, span_hashes, texts_of, words_of

BUCKETS = 1 << 18
TRUSTED_ROWS = 50_000
#: Texts of a lower mean log ratio are not kept.
THRESHOLD = -0.3
#: Counts added in proportion to the corpus, in parts of a count a bucket.
SMOOTHING = 1.0
#: Words of a window that must not come twice, fewest words, most percent of words in such windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True

MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def ngram_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and pair of words, and its text."""
    words = words_of(texts)
    hashes, text = span_hashes(texts.data, words.starts, words.ends), words.text
    together = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    pairs = mix(hashes[together] * np.uint64(BASE) + hashes[together + 1])
    every = np.concatenate((hashes, pairs)) % np.uint64(BUCKETS)
    return every.astype(np.int64), np.concatenate((text, text[together]))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers of the rows whose hash comes twice or more in their group, sorted by group, hash and row."""
    order = np.lexsort((hashes, group))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    either = np.zeros(len(order), bool)
    either[1:] |= same
    either[:-1] |= same
    return order[either]


def repeat_words(texts: Texts, words: Words) -> np.ndarray:
    """Words of each text inside a window that the text has twice or more."""
    hashes, text = span_hashes(texts.data, words.starts, words.ends), words.text
    at = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= words.first[text + 1]) if len(hashes) else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        total += hashes[at + j] * np.uint64(pow(BASE, 2 * j + 1, 1 << 64))
    found = at[_repeated(mix(total), text[at])]
    cover = np.zeros(len(hashes) + WINDOW + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    return _per_text(np.cumsum(cover)[: len(hashes)] > 0, words.first)


def dup_lines(texts: Texts, inside: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    breaks = np.flatnonzero(texts.data == 0x0A)
    # what follows a break at a text's end is an empty line, and begins where the next text does
    starts = np.union1d(texts.bounds[:-1], breaks + 1)
    text = np.minimum(np.searchsorted(texts.bounds, starts, side="right") - 1, len(texts) - 1)
    line_ends = np.append(breaks, len(texts.data))
    ends = np.minimum(line_ends[np.searchsorted(breaks, starts)], texts.bounds[text + 1])
    ends = np.maximum(ends, starts)
    filled = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    kept = filled[ends] > filled[starts]
    starts, ends, text = starts[kept], ends[kept], text[kept]
    hashes = span_hashes(texts.data, starts, ends)
    found = _repeated(hashes, text)
    if not len(found):
        return np.zeros(len(texts), np.int64)
    # all of an equal run but the first
    later = np.flatnonzero((hashes[found[1:]] == hashes[found[:-1]]) & (text[found[1:]] == text[found[:-1]])) + 1
    return np.bincount(text[found[later]], minlength=len(texts))


def base_rules(texts: Texts) -> dict[str, np.ndarray]:
    words = words_of(texts)
    inside = np.zeros(len(texts.data) + 1, np.int64)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    inside = np.cumsum(inside)[:-1] > 0
    n_words, repeated = words.counts, repeat_words(texts, words)
    return {
        "n_words": n_words,
        "word_chars": _per_text(inside & ((texts.data & 0xC0) != 0x80), texts.bounds),
        "n_symbols": _per_text(IS_SYMBOL[texts.data], texts.bounds),
        "n_dup_lines": dup_lines(texts, inside),
        "n_repeat_words": repeated,
        "base_failed": (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words),
    }


def log_ratios(documents: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Of each bucket, from all documents (doc_id, text) and the ids of trusted ones."""
    key = F.md5(F.col("doc_id").cast("string"))
    sample = trusted.select("doc_id").filter("doc_id is not null").distinct().orderBy(key, "doc_id").limit(TRUSTED_ROWS)
    marked = documents.join(F.broadcast(sample.withColumn("trusted", F.lit(1))), "doc_id", "left").select("text", "trusted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in chunked(batches):
            bucket, text = ngram_buckets(texts_of(batch.column("text")))
            of_target = batch.column("trusted").is_valid().to_numpy(zero_copy_only=False)
            totals[0] += np.bincount(bucket, minlength=BUCKETS)
            totals[1] += np.bincount(bucket[of_target[text]], minlength=BUCKETS)
        seen = np.flatnonzero(totals[0])
        columns = [pa.array(c) for c in (seen, totals[0][seen], totals[1][seen])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "corpus", "target"])

    counted = marked.mapInArrow(count, "bucket long, corpus long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target"))
    rows = sums.toPandas()  # at most BUCKETS rows
    corpus, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    corpus[rows["bucket"]], target[rows["bucket"]] = rows["corpus"], rows["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    share = (corpus + SMOOTHING) / (corpus.sum() + SMOOTHING * BUCKETS)
    wanted = (target + SMOOTHING * BUCKETS * share) / (target.sum() + SMOOTHING * BUCKETS)
    return np.log(wanted) - np.log(share)


def judge(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with the figures of the base rules, base_failed, score and kept."""
    trusted = needed(labels, doc_id="doc_id", quality="quality").filter("quality = 1")
    ratios = documents.sparkSession.sparkContext.broadcast(log_ratios(needed(documents, doc_id=id_col, text=text_col), trusted))
    rows = documents.select(*others(documents, MADE))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, text_col):
            texts = texts_of(batch.column(text_col))
            found = base_rules(texts)
            bucket, text = ngram_buckets(texts)
            count = np.bincount(text, minlength=len(texts))
            found["score"] = np.bincount(text, ratios.value[bucket], len(texts)) / np.maximum(count, 1)
            found["kept"] = ~found["base_failed"] & (found["score"] >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c]) for c in MADE)], [*batch.schema.names, *MADE])

    kinds = {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "score": T.DoubleType()}
    return map_in_arrow(rows, rate, T.StructType([*rows.schema.fields, *(T.StructField(c, kinds.get(c, T.LongType())) for c in MADE)]))
