"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are cut into SEGMENTS; rows are indexed under the value of each segment. Two
codes at distance d agree in some segment but for d // SEGMENTS bits at most. So once all
values within r bits of each of a query's segments have been looked up, every row nearer
than SEGMENTS x (r + 1) has been met. Round r looks up the values at exactly r bits, the
distances of rows met are taken on the whole codes, and a query ends when its kth distance
is below that bound. The last radius covers every value, so all queries end.

Rows of equal codes are one entry with their k + 1 least ids (no other can be among the
nearest, ties going to the least id), and equal queries are one query, so groups of copies
don't multiply. The index has lists of codes by segment and value, split beyond BUCKET;
with few codes a list holds all values that share a prefix, and the look-up of a prefix
takes the values at the wanted distance out of it. A task compares queries with the lists
they hit, some at a time, and returns the best of each query among them.

Nulls and ties: a null vector has no code and is neither found nor a query; a null entry
counts as not positive, vectors of other lengths are padded with zeros or raise if longer;
a null id is not indexed; rows that share an id are told apart by nothing and come once
for each distinct code. A query doesn't find its own id. Fewer than k rows give fewer
results; empty tables give an empty one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outvote.staging import stage

BITS, SEGMENTS = 64, 4
SEGMENT_BITS = BITS // SEGMENTS
#: Codes in a list of the index, about.
BUCKET = 512
#: Lists that a task compares at a time.
HITS = 1024
#: Distances and ids, nearest first.
NEAR = "array<struct<distance:bigint,id:bigint>>"


def sign_code(vector: str, bits: int = BITS) -> Column:
    """Bit i is set where entry i is over 0."""
    parts = (
        F.when(F.coalesce(F.get(F.col(vector), F.lit(i)), F.lit(0.0)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
        for i in range(bits)
    )
    total: Column | None = None
    for p in parts:
        total = p.cast("long") if total is None else total.bitwiseOR(p.cast("long"))
    checked = F.when(F.size(vector) > bits, F.raise_error(F.lit(f"a vector of more than {bits} entries"))).otherwise(total)
    return F.when(F.col(vector).isNotNull(), checked)


def _segment(code: str) -> Column:
    """Of the row's segment number."""
    shifted = F.expr(f"shiftrightunsigned({code}, segment * {SEGMENT_BITS})")
    return shifted.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def _segments() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)))


def prefix_bits(codes: int) -> int:
    """Bits of a segment's value that lists go by: all of them for very many codes, fewer
    while lists would be short. Look-ups and results are the same for any number."""
    return min(SEGMENT_BITS, max(SEGMENT_BITS // 2, (codes // BUCKET).bit_length()))


def _flips(radius: int, prefix: int) -> Column:
    """All prefixes with so many bits set that the rest of the value can hold what is left
    of the radius."""
    least, most = max(0, radius - (SEGMENT_BITS - prefix)), min(radius, prefix)
    values = (sum(1 << b for b in bits) for n in range(least, most + 1) for bits in combinations(range(prefix), n))
    return F.expr(f"array({','.join(map(str, values))})")


def _index(entries: DataFrame, prefix: int) -> DataFrame:
    """segment, prefix of the value there, and the codes (with their least id) that have it."""
    placed = entries.select("code", F.get("ids", F.lit(0)).alias("least"), _segments().alias("segment"))
    placed = placed.withColumn("prefix", F.shiftright(_segment("code"), SEGMENT_BITS - prefix))
    sizes = placed.groupBy("segment", "prefix").count()
    parts = sizes.select("segment", "prefix", F.ceil(F.col("count") / F.lit(BUCKET // 2)).alias("parts"))
    dealt = placed.join(parts, ["segment", "prefix"]).withColumn("part", F.expr("pmod(xxhash64(code), parts)"))
    both = F.collect_list(F.struct("code", "least")).alias("both")
    lists = dealt.groupBy("segment", "prefix", "part").agg(both)
    return lists.select("segment", "prefix", F.col("both.code").alias("codes"), F.col("both.least").alias("least"))


def _nearest_in_batch(wanted: int, prefix: int):
    """Of each query in some hits, the `wanted` nearest codes within its limit whose segment
    value is at exactly the radius; ties by the least id."""
    rest = np.uint64((1 << (SEGMENT_BITS - prefix)) - 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, HITS) for b in batches for at in range(0, b.num_rows, HITS)):
            lists = batch.column("codes")
            sizes = np.diff(lists.offsets.to_numpy())
            codes, least = lists.flatten().to_numpy(), batch.column("least").flatten().to_numpy()
            query, segment, left, limit = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("query", "segment", "left", "limit"))
            apart = codes.view(np.uint64) ^ query.view(np.uint64)
            distance = np.bitwise_count(apart).astype(np.int64)
            value = (apart >> (segment.astype(np.uint64) * np.uint64(SEGMENT_BITS))) & rest
            kept = np.flatnonzero((np.bitwise_count(value) == left) & (distance <= limit))
            kept = kept[np.lexsort((least[kept], distance[kept], query[kept]))]
            query, distance, codes = query[kept], distance[kept], codes[kept]
            # a code may be met in several segments
            new = np.ones(len(query), bool)
            new[1:] = (query[1:] != query[:-1]) | (codes[1:] != codes[:-1])
            query, distance, codes = query[new], distance[new], codes[new]
            kept = np.arange(len(query)) - np.searchsorted(query, query) < wanted
            columns = [pa.array(c[kept]) for c in (query, distance, codes)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "distance", "code"])

    return search


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """codes: id, code (64 bits in a long). queries: id, code. Returns id, rank (from 1),
    neighbour, distance: the k nearest rows of each query other than its own id, ties by
    the least id."""
    # the limit holds before the shuffle, so each task sends k + 1 ids of a code at most
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    kept = codes.filter("id is not null and code is not null").select("code", "id").distinct().withColumn("place", place)
    entries = kept.filter(F.col("place") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = stage(entries, "codes")
    prefix = prefix_bits(entries.count())
    index = stage(_index(entries, prefix), "code-index")
    wanted = stage(queries.filter("id is not null and code is not null").select("id", "code").distinct(), "queries")
    rows = entries.agg(F.sum(F.size("ids")).alias("n")).first()["n"] or 0
    enough = min(k + 1, rows)
    searching = wanted.select(F.col("code").alias("query"), F.array().cast(NEAR).alias("near")).distinct()
    ended = []
    for radius in range(SEGMENT_BITS + 1):
        # no more than the kth distance so far
        limit = F.when(F.size("near") >= enough, F.array_max("near")["distance"]).otherwise(F.lit(BITS).cast("long"))
        probes = searching.select("query", limit.alias("limit"), _segments().alias("segment"))
        probes = probes.withColumn("own", F.shiftright(_segment("query"), SEGMENT_BITS - prefix))
        probes = probes.withColumn("flip", F.explode(_flips(radius, prefix))).select(
            "query", "segment", "limit", F.col("own").bitwiseXOR(F.col("flip")).alias("prefix"), (radius - F.bit_count("flip")).alias("left")
        )
        # Spark takes the look-ups for as few as the queries; they must not be broadcast
        hits = probes.hint("merge").join(index, ["segment", "prefix"]).select("query", "segment", "left", "limit", "codes", "least")
        found = hits.mapInArrow(_nearest_in_batch(k + 1, prefix), "query long, distance long, code long").distinct()
        pairs = F.transform("ids", lambda i: F.struct(F.col("distance"), i.alias("id")))
        found = found.join(entries, "code").select("query", pairs.alias("pairs"))
        # what a query had, and its new hits: some k + 1 from each task
        fresh = found.groupBy("query").agg(F.flatten(F.collect_list("pairs")).alias("fresh"))
        joined = searching.join(fresh, "query", "left").withColumn("fresh", F.coalesce("fresh", F.array().cast(NEAR)))
        merged = F.slice(F.array_sort(F.array_union("near", "fresh")), 1, k + 1)
        bound = F.lit(SEGMENTS * (radius + 1))
        covered = (F.size("near") >= enough) & (F.array_max("near")["distance"] < bound)
        now = stage(joined.select("query", merged.alias("near")).withColumn("covered", covered), f"radius{radius}")
        ended.append(now.filter("covered").select("query", "near"))
        searching = now.filter("not covered").select("query", "near")
        if not searching.head(1):
            break
    results = reduce(DataFrame.unionByName, ended)
    own = wanted.join(results, wanted["code"] == results["query"])
    near = F.slice(F.filter("near", lambda b: b["id"] != F.col("id")), 1, k)
    ranked = own.select("id", F.posexplode(near).alias("place", "b"))
    return ranked.select("id", (F.col("place") + 1).alias("rank"), F.col("b.id").alias("neighbour"), F.col("b.distance").alias("distance"))

