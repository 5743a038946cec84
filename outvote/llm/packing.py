"""Hierarchical packing of documents into training windows of several lengths.

A document's ids (with an end id) fill whole windows of the longest tier first; what is
left over is routed to the shortest tier that holds it. The longest tier is packed first,
largest pieces first, and the gaps of its windows are filled from the shorter tiers. Pieces
then left in a shorter tier are packed there if they fill a window to the last id; the
others go up into windows of the longest tier. Windows of one tier form step groups of
equal token counts.

Piece lengths are whole numbers up to the longest window, so a packing is a list of
patterns over the histogram of lengths: that is all the driver sees, whatever the number of
documents. Pieces find their window through their rank among those of equal length, taken
as (length, bucket) totals plus a rank in the bucket, so a length that a third of all
pieces share is spread over many tasks.

Nulls and ties: a null text is empty and has the end id alone; a null id is kept; rows that
agree in everything are packed each. An empty table gives an empty result."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outvote.llm.columns import needed
from outvote.llm.tokens import Encoder, vocabulary
from outvote.staging import stage

#: Window lengths, powers of two, shortest first.
TIERS = (128, 256, 512, 1024)
END_ID = 0
#: Tokens of a step group.
STEP_TOKENS = 64 * 1024
#: Pieces ranked in one task.
BUCKET_ROWS = 10_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass
class Pattern:
    """`times` windows of `window` ids that each hold `uses[n]` pieces of length n, longest first."""

    window: int
    uses: Counter
    times: int


def _fill(left: Counter, lengths: list[int], window: int, opening: int | None = None) -> Counter:
    """Pieces for one window, each the longest that still fits."""
    uses, gap = Counter(), window
    if opening:
        uses[opening], gap = 1, window - opening
    while gap > 0 and (k := bisect_right(lengths, gap)):
        n = lengths[k - 1]
        while n and left[n] <= uses[n]:
            k -= 1
            n = lengths[k - 1] if k else 0
        if not n:
            break
        take = min(left[n] - uses[n], gap // n)
        uses[n] += take
        gap -= take * n
    return uses


def _take(left: Counter, lengths: list[int], window: int, uses: Counter) -> Pattern:
    """The pattern as often as the pieces last."""
    times = min(left[n] // k for n, k in uses.items())
    for n, k in uses.items():
        left[n] -= times * k
        if not left[n]:
            del lengths[bisect_left(lengths, n)]
    return Pattern(window, uses, times)


def plan(counts: dict[int, int], tiers: Sequence[int] = TIERS) -> list[Pattern]:
    """Patterns that use up every piece. Each one ends the supply of some length, or of
    some length but for a few, so there are no more than a few for each length."""
    left, lengths = Counter(counts), sorted(n for n, c in counts.items() if c)
    patterns, longest = [], tiers[-1]
    half = tiers[-2] if len(tiers) > 1 else 0
    # the longest tier opens windows with its own pieces and fills them from all others
    while lengths and lengths[-1] > half:
        patterns.append(_take(left, lengths, longest, _fill(left, lengths, longest, lengths[-1])))
    # a shorter tier keeps what fills its windows exactly
    for tier in reversed(tiers[:-1]):
        for n in sorted((n for n in lengths if n <= tier), reverse=True):
            while left[n]:
                uses = _fill(left, lengths, tier, n)
                if sum(m * k for m, k in uses.items()) != tier:
                    break
                patterns.append(_take(left, lengths, tier, uses))
    # the rest goes up into long windows
    while lengths:
        patterns.append(_take(left, lengths, longest, _fill(left, lengths, longest, lengths[-1])))
    return patterns


def _slots(patterns: list[Pattern]) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces a window, offset, window, first
    sequence in its tier), sorted by length and rank, and the number of sequences."""
    rows, used, tier_used, sequence = [], Counter(), Counter(), 0
    for p in patterns:
        offset = 0
        for n in sorted(p.uses, reverse=True):
            k = p.uses[n]
            rows.append((n, used[n], sequence, k, offset, p.window, tier_used[p.window]))
            used[n] += k * p.times
            offset += n * k
        sequence += p.times
        tier_used[p.window] += p.times
    return np.array(sorted(rows), np.int64).reshape(-1, 7), sequence


def token_pieces(documents: DataFrame, window: int, path: str | None = None, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Whole windows of each document's ids, then what is left over."""
    words = vocabulary(documents.sparkSession, path, tokenizer=tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words)
        for batch in batches:
            made = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    row = doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)
                    for column, value in zip(made, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in made], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return documents.mapInArrow(cut, PIECE)


def pack(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: Sequence[int] = TIERS,
    step_tokens: int = STEP_TOKENS,
    path: str | None = None,
    tokenizer: str | None = None,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (the
    piece's place in its sequence), window and step (the sequence's tier and step group).
    Added tokens of the file `tokenizer` have their own ids within texts."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers must be ascending powers of two")
    rows = needed(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = stage(token_pieces(rows, tiers[-1], path, tokenizer=tokenizer), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row a length
    slots, _ = _slots(plan(counts, tiers))
    # a length's buckets by its count
    buckets = F.array(*(F.lit(max(1, -(-counts.get(n, 0) // BUCKET_ROWS))) for n in range(tiers[-1] + 1)))
    of_length = F.get(buckets, F.col("length").cast("int"))
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), of_length).cast("int"))
    sums = bucketed.groupBy("length", "__bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("length", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    order = Window.partitionBy("length", "__bucket").orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "ids_crc32")
    ranked = bucketed.withColumn("__rank", F.row_number().over(order) - 1).join(offsets, ["length", "__bucket"])
    ranked = ranked.select(*(c.split()[0] for c in PIECE.split(", ")), (F.col("__before") + F.col("__rank")).alias("rank"))
    shift = 1 << 44
    keys = slots[:, 0] * shift + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = slots[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - row[:, 1]
            turn, copy = nth // row[:, 3], nth % row[:, 3]
            in_tier = row[:, 6] + turn
            columns = [*batch.columns[:-1], *map(pa.array, (row[:, 2] + turn, row[:, 4] + copy * length, row[:, 5], in_tier * row[:, 5] // step_tokens))]
            names = [*batch.schema.names[:-1], "sequence_id", "offset", "window", "step"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranked.mapInArrow(place, PIECE + ", sequence_id long, offset long, window long, step long")
