"""Jaccard join of documents on word shingles with Bayesian pruning of candidates.

Texts with the same set of shingles are one class and are compared once. Classes that share
a band of MinHash values are candidates; each candidate pair's values are compared some at a
time, and the pair goes as soon as the posterior probability that its similarity reaches the
threshold, given the matches so far and a uniform prior, is below the tolerance. Pairs left
link their classes into neighbourhoods; within one, all pairs of classes whose sizes allow
the threshold are verified exactly on the shingles of the whole texts.

Buckets and neighbourhoods of any size are dealt as pairs of blocks, so no task holds a
whole one; tasks return stars and link counts rather than pairs. No bucket, partner or
candidate is dropped but by the posterior, and at the threshold a pair misses all bands
with a probability of (1 - 0.8^4)^32 = 5e-8.

A shingle is five words; a text of fewer words has one shingle, all of them. Nulls and
ties: a null text is empty; texts without words are linked to texts that equal them only;
rows that share an id or a text are rows of their own; a null id stays and is the greatest
of its class. An empty table gives an empty result. Classes go by 64-bit hashes of their
shingle sets: two of 25 billion texts share one by accident with a probability of some
1e-9 per text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outvote.llm.columns import Beside, named, needed
from outvote.llm.components import components
from outvote.llm.text_arrays import BASE, Texts, chunked, mix, span_hashes, texts_of, window_hashes, words_of
from outvote.staging import stage

WORDS = 5
THRESHOLD = 0.8
#: Bands x values in a band.
BANDS, BAND_VALUES = 32, 4
VALUES = BANDS * BAND_VALUES
#: A pair goes when it reaches the threshold with less probability than this.
TOLERANCE = 1e-6
#: Values compared between two looks at the posterior.
STEP = 16
#: Classes in a block, and shingles in a block of classes to be verified.
BLOCK = 256
BLOCK_SHINGLES = 200_000
#: Columns of the incidence matrix multiplied at a time.
SLICE = 4096
#: Rows that a task holds beyond the group it is working on.
HELD_ROWS = 4096

_MULTIPLIERS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
_SHIFTS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(BASE ^ 0xFFFF))


# --- sketches ---------------------------------------------------------------------------


def shingles(texts: Texts, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another; and where each
    text's begin, with the total at the end."""
    words = words_of(texts)
    hashes, text = window_hashes(span_hashes(texts.data, words.starts, words.ends), words.first, size)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def class_keys(hashes: np.ndarray, first: np.ndarray, texts: Texts) -> np.ndarray:
    """A hash of each text's set; of the text itself where there are no words."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(1)), out=total[1:])
    of_set = mix(total[first[1:]] - total[first[:-1]])
    of_text = span_hashes(texts.data, texts.bounds[:-1], texts.bounds[1:])
    return np.where(np.diff(first) > 0, of_set, mix(of_text + np.uint64(7)))


def minhashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32 bits of the least value of each text under each hash function; 0 without words."""
    filled = np.flatnonzero(np.diff(first) > 0)
    values = np.zeros((len(first) - 1, VALUES), np.uint32)
    if len(filled):
        buffer = np.empty_like(hashes)
        for k in range(VALUES):
            np.multiply(hashes, _MULTIPLIERS[k], out=buffer)
            buffer += _SHIFTS[k]
            values[filled, k] = np.minimum.reduceat(buffer, first[filled]) >> np.uint64(32)
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    rows = values.reshape(len(values), BANDS, BAND_VALUES).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(BAND_VALUES):
        keys = mix(keys * np.uint64(BASE) + rows[:, :, j])
    return keys


SKETCH = "doc_id long, text_key long, class long, n_shingles long, bands array<long>, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches):
        texts = texts_of(batch.column("text"))
        hashes, first = shingles(texts)
        values = minhashes(hashes, first)
        keys = band_keys(values).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        low_bytes = np.ascontiguousarray(values.astype(np.uint8))
        columns = [
            batch.column("doc_id"),
            batch.column("text_key"),
            pa.array(class_keys(hashes, first, texts).view(np.int64)),
            pa.array(np.diff(first)),
            bands,
            pa.array([v.tobytes() for v in low_bytes], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "class", "n_shingles", "bands", "sketch"])


# --- pruning ----------------------------------------------------------------------------


def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After each step, the fewest matches with which a pair stays. With a uniform prior
    the similarity after m matches of n is Beta(m + 1, n - m + 1), whose tail above the
    threshold is a binomial sum. Values are compared by one byte, which unequal ones share
    once in 256."""
    wanted, threshold = [], threshold + (1 - threshold) / 256
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while m < n and tail < tolerance:
            m += 1
            # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            tail = sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
        wanted.append(m)
    return tuple(wanted)


def surviving(values: np.ndarray, a: np.ndarray, b: np.ndarray, fewest: tuple[int, ...]) -> np.ndarray:
    """Numbers of the pairs (a, b) whose posterior never falls below the tolerance."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for step, least in enumerate(fewest):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (values[a[alive], part] == values[b[alive], part]).sum(1, dtype=np.int32)
        kept = matches >= least
        alive, matches = alive[kept], matches[kept]
    return alive


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least linked row of each of n rows, given links (a, b)."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups from a stream sorted by keys, many small ones together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < HELD_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = int(np.argmax(last))  # sorted: the last group is the tail
        if cut:
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidate_links(threshold: float, tolerance: float):
    """Pairs of classes in a bucket that survive, as stars."""
    fewest = least_matches(threshold, tolerance)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "low", "high"]):
            key, low, high, block, cls = (table.column(c).to_numpy() for c in ("key", "low", "high", "block", "class"))
            values = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)
            same = (key[1:] == key[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1])
            group = np.concatenate(([0], np.cumsum(~same)))
            root = np.arange(len(cls))
            active, distance = np.arange(len(cls)), 0
            # pairs of rows 1, 2, ... apart, as long as any group is that large
            while len(active):
                distance += 1
                active = active[active + distance < len(cls)]
                active = active[group[active] == group[active + distance]]
                other = active + distance
                # in a pair of blocks, only pairs across; and not what is linked by now
                wanted = ((low[active] == high[active]) | (block[active] != block[other])) & (root[active] != root[other])
                a, b = active[wanted], other[wanted]
                alive = surviving(values, a, b, fewest)
                if len(alive):
                    a, b = a[alive], b[alive]
                    every = np.concatenate((np.arange(len(root)), a)), np.concatenate((root, b))
                    root = stars(len(root), *every)
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(cls[root[linked]])], ["a", "b"])

    return link


# --- exact verification -----------------------------------------------------------------


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sorted sets share."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # an element of one set alone is shared by none
    number = np.cumsum(held > 1) - 1
    kept = held[column] > 1
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, SLICE):
        a, b = np.searchsorted(column, (start, start + SLICE))
        incidence = np.zeros((len(sets), SLICE), np.float32)
        incidence[owner[a:b], column[a:b] - start] = 1
        total += (incidence @ incidence.T).astype(np.int64)
    return total


def _verified_links(threshold: float):
    """For each class of a block pair: documents in the classes it is linked to, and a star."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["component", "low", "high"]):
            component, low, high, block, cls, docs = (
                table.column(c).to_numpy() for c in ("component", "low", "high", "block", "class", "docs")
            )
            same = (component[1:] == component[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(cls)]
            column = table.column("shingles").chunk(0)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            made: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(cuts, cuts[1:]):
                # a class comes again if tasks split a repeated row
                at = a + np.unique(cls[a:b], return_index=True)[1]
                sets = [flat[ends[i] : ends[i + 1]] for i in at]
                size = np.array([len(s) for s in sets])
                both = _shared(sets)
                # shared / (size + size - shared) >= threshold
                linked = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
                np.fill_diagonal(linked, False)
                if low[a] != high[a]:
                    linked &= block[at, None] != block[None, at]
                x, y = np.nonzero(linked)
                made[0].append(cls[at])
                made[1].append(cls[at][stars(len(at), x, y)])
                made[2].append(linked.astype(np.int64) @ docs[at])
            columns = [pa.array(np.concatenate(m)) if m else pa.array([], pa.int64()) for m in made]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])

    return verify


def _class_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # rows may be repeated
    for batch in chunked(batches):
        fresh = [c not in seen and not seen.add(c) for c in batch.column("class").to_pylist()]
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        hashes, first = shingles(texts_of(batch.column("text")))
        sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
        columns = [batch.column(c) for c in ("component", "class", "docs", "blocks")]
        yield pa.RecordBatch.from_arrays([*columns, sets], ["component", "class", "docs", "blocks", "shingles"])


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Each row once for every pair of blocks its block is in. A group of one block has the
    pair (0, 0); pairs of a block with itself come with the pairs to others."""
    dealt = rows.withColumn("block", F.expr("pmod(xxhash64(class), blocks)").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    paired = paired.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return paired.drop("other", "blocks").repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


# --- the join ---------------------------------------------------------------------------


def _first(doc_id: Column, text_key: Column) -> Column:
    """The row of least id of a group; null ids come last."""
    return F.min(F.struct(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), text_key.alias("text_key")))


def _grouped(documents: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> DataFrame:
    """Per document: doc_id, text_key, its class's first document copy_id, its group's
    first document class_id and class_key (with the text's hash), docs, links."""
    rows = needed(documents, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    sketches = stage(rows.mapInArrow(_sketch, SKETCH), "sketches")
    # copies meet in partial aggregates, so they don't travel
    classes = sketches.groupBy("class").agg(
        _first(F.col("doc_id"), F.col("text_key")).alias("copy"),
        F.count(F.lit(1)).alias("docs"),
        F.max("n_shingles").alias("n_shingles"),
        F.min("bands").alias("bands"),
        F.min("sketch").alias("sketch"),
    )
    classes = classes.select("class", "copy.doc_id", "copy.text_key", "docs", "n_shingles", "bands", "sketch")
    classes = stage(classes.withColumnRenamed("doc_id", "copy_id"), "classes")
    wordy = classes.filter("n_shingles > 0")
    members = wordy.select("class", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").count().filter("count > 1")
    sizes = sizes.select("key", F.ceil(F.col("count") / F.lit(BLOCK)).alias("blocks"))
    shared = members.join(sizes, "key")
    entries = shared.join(wordy.select("class", "sketch"), "class")
    links = _block_pairs(entries, "key").select("key", "low", "high", "block", "class", "sketch")
    edges = links.mapInArrow(_candidate_links(threshold, tolerance), "a long, b long")
    small = classes.drop("bands", "sketch")
    near = components(edges).withColumnRenamed("node", "class")
    near = stage(near.join(small, "class"), "near")
    blocks = near.groupBy("component").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK))).alias("blocks")
    )
    wanted = near.join(blocks, "component").select("component", "class", "docs", "blocks", "copy_id", F.col("text_key").alias("own_key"))
    same_row = wanted["copy_id"].eqNullSafe(rows["doc_id"]) & (wanted["own_key"] == rows["text_key"])
    # by shuffle at every size: the classes to be verified have no bound
    texts = wanted.hint("merge").join(rows, same_row).select("component", "class", "docs", "blocks", "text")
    held = texts.mapInArrow(_class_shingles, "component long, class long, docs long, blocks long, shingles array<long>")
    verified = _block_pairs(held, "component").select("component", "low", "high", "block", "class", "docs", "shingles")
    verified = stage(verified.mapInArrow(_verified_links(threshold), "a long, b long, links long"), "verified")
    linked = verified.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    grouped = components(verified.filter("a != b").select("a", "b")).withColumnsRenamed({"node": "class", "component": "group"})
    found = small.join(grouped, "class", "left").join(linked, "class", "left")
    found = found.withColumn("group", F.coalesce("group", "class"))
    least = found.groupBy("group").agg(_first(F.col("copy_id"), F.col("text_key")).alias("first"))
    found = found.join(least, "group").select(
        "class", "copy_id", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("class_key"), "docs", "links"
    )
    return sketches.select("doc_id", "text_key", "class").join(stage(found, "grouped"), "class")


def jaccard_join(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Per document: id, class_id (the least id of the documents it is linked to, directly
    or through others, itself among them), n_links (other documents at the threshold or
    over), copy_id (the least id of those with the same shingles)."""
    grouped = _grouped(documents, id_col, text_col, threshold, tolerance)
    links = F.col("docs") - 1 + F.coalesce("links", F.lit(0))
    return grouped.select(F.col("doc_id").alias(id_col), "class_id", links.alias("n_links"), "copy_id")


def one_of_each(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The first document (least id) of each group of linked ones, with its columns."""
    grouped = _grouped(documents, id_col, text_col, threshold, tolerance)
    kept = grouped.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key")))
    kept = stage(kept.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "kept")
    rows = Beside(documents, __key=F.xxhash64(named(text_col)), __id=named(id_col).cast("long"))
    same = F.col("__id").eqNullSafe(F.col("kept_id")) & (F.col("__key") == F.col("kept_key"))
    wanted = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    first = rows.df.join(wanted, same, "left_semi")
    if kept.filter("n > 1").head(1):
        first = first.dropDuplicates(["__id", "__key"])
    return first.select(*rows.others())
