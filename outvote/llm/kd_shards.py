"""Sharding by a k-d tree over document metadata.

A node is cut at the weighted (byte) median of its widest dimension, in as many rounds of a
histogram over the node's range as it takes to isolate the cut; all nodes of a level are
cut by the same jobs. Only histograms reach the driver. With `shards` leaves wanted, a node
of k leaves is cut at the share floor(k/2)/k, so leaves meet their target of 1/shards of
the bytes for any count.

Documents of equal text share their coordinates, hence their shard. A group of copies with
more than HOT_GROUP of a shard's target is dealt in pieces, so no group can unbalance a
shard.

Nulls and ties: a null text has no bytes; null metadata comes before any other; equal
coordinates are told apart by a hash of the text; slots follow the id, nulls first. An
empty table gives an empty result; columns of the same names as the result's give way."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outvote.llm.columns import needed
from outvote.staging import stage

#: Bytes a row takes beside its text.
ROW_BYTES = 8
BINS = 4096
#: A cut is settled when what is left undecided weighs less than this share of a shard.
SETTLED = 2e-4
#: Share of a shard's target beyond which copies of one text are dealt in pieces of that size.
HOT_GROUP = 0.1
#: Rows numbered in one task.
SLOT_ROWS = 100_000
#: Low bits of a coordinate that hold the hash by which equal values are told apart.
TIE_BITS = 15
NAME_BYTES = 6


@dataclass
class Node:
    leaves: int
    first: int  # the lowest of its shards
    bytes: float
    dim: str = ""
    cut: int = 0
    parts: list[Node] = field(default_factory=list)

    def expression(self, value) -> Column:
        """Of a row's coordinates: what `value` gives for the leaf it falls in."""
        if not self.parts:
            return F.lit(value(self))
        low, high = (p.expression(value) for p in self.parts)
        return F.when(F.col(self.dim) < F.lit(self.cut), low).otherwise(high)

    def ends(self) -> list[Node]:
        return [e for p in self.parts for e in p.ends()] if self.parts else [self]


def _name_value(name: Column) -> Column:
    """The first bytes of a text as a number that orders like the text; -1 for null."""
    digits = F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), 1, NAME_BYTES)), 2 * NAME_BYTES, "0")
    return F.when(name.isNull(), F.lit(-1)).otherwise(F.conv(digits, 16, 10).cast("long"))


def _with_tie(value: Column) -> Column:
    return F.shiftleft(value, TIE_BITS) + F.col("__tie")


def _pick(values: list, index: str) -> Column:
    """values[index] of a row."""
    return F.get(F.array(*map(F.lit, values)), F.col(index))


def _numbered(rows: DataFrame, root: Node, nodes: list[Node]) -> DataFrame:
    """rows with the number of the node they are in; those in none of `nodes` go."""
    number = {id(n): i for i, n in enumerate(nodes)}
    return rows.withColumn("__node", root.expression(lambda leaf: number.get(id(leaf), -1))).filter("__node >= 0")


def _measure(rows: DataFrame, dims: list[str], root: Node) -> dict[int, dict]:
    """Of each end of the tree: its bytes, and its range in every dimension."""
    ends = root.ends()
    wanted = [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))]
    found = _numbered(rows, root, ends).groupBy("__node").agg(F.sum("__size").alias("bytes"), *wanted)
    return {id(ends[r["__node"]]): r.asDict() for r in found.collect()}  # a row for each end


def _cut(rows: DataFrame, nodes: list[Node], root: Node, ranges: list[tuple[int, int]], dims: list[str], settled: float) -> None:
    """Set each node's cut: the coordinate with nearest to the wanted share of bytes below it."""
    wanted = [n.bytes * (n.leaves // 2) / n.leaves for n in nodes]
    low = [a for a, _ in ranges]
    high = [b + 1 for _, b in ranges]
    below = [0.0] * len(nodes)
    open_nodes = set(range(len(nodes)))
    at = F.get(F.array(*dims), _pick([dims.index(n.dim) for n in nodes], "__node"))
    placed = _numbered(rows, root, nodes).select("__node", "__size", at.alias("__at"))
    while open_nodes:
        width = [max(1, -(-(b - a) // BINS)) for a, b in zip(low, high)]
        inside = placed.select("__node", "__size", "__at", *(_pick(v, "__node").alias(n) for n, v in (("a", low), ("b", high), ("w", width))))
        # a settled node's range is empty
        inside = inside.filter("__at >= a and __at < b")
        sums = inside.groupBy("__node", F.expr("(__at - a) div w").alias("bin")).agg(
            F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        bins: dict[int, list[tuple[int, int, int]]] = {i: [] for i in open_nodes}
        for r in sums.collect():  # at most shards x BINS rows
            bins[r["__node"]].append((r["bin"], r["bytes"], r["rows"]))
        for i in sorted(open_nodes):
            ordered = sorted(bins[i])
            totals = list(accumulate((b for _, b, _ in ordered), initial=below[i]))
            k = min(max(bisect_left(totals, wanted[i]) - 1, 0), len(ordered) - 1)
            bin_no, weight, held = ordered[k]
            if width[i] == 1 or held == 1 or weight <= settled:
                # the nearer end of the bin
                after = totals[k + 1] - wanted[i] < wanted[i] - totals[k]
                nodes[i].cut = low[i] + width[i] * (bin_no + after)
                open_nodes.discard(i)
                high[i] = low[i]
            else:
                below[i] = totals[k]
                low[i], high[i] = low[i] + width[i] * bin_no, min(high[i], low[i] + width[i] * (bin_no + 1))


def build_tree(rows: DataFrame, dims: list[str], shards: int) -> Node:
    """rows: whole-number coordinates `dims` and weight __size."""
    root = Node(shards, 0, 0.0)
    found = _measure(rows, dims, root)
    if not found:
        return root
    whole = found[id(root)]
    scale = {d: float(whole[f"max_{d}"] - whole[f"min_{d}"]) or 1.0 for d in dims}
    while nodes := [n for n in root.ends() if n.leaves > 1 and id(n) in found]:
        ranges = []
        for n in nodes:
            own = found[id(n)]
            n.bytes = float(own["bytes"])
            n.dim = max(dims, key=lambda d: (own[f"max_{d}"] - own[f"min_{d}"]) / scale[d])
            ranges.append((own[f"min_{n.dim}"], own[f"max_{n.dim}"]))
        _cut(rows, nodes, root, ranges, dims, SETTLED * whole["bytes"] / shards)
        for n in nodes:
            half = n.leaves // 2
            n.parts = [Node(half, n.first, 0.0), Node(n.leaves - half, n.first + half, 0.0)]
        found = _measure(rows, dims, root) if any(e.leaves > 1 for e in root.ends()) else {}
    return root


def _coordinates(documents: DataFrame, id_col: str, text_col: str, dims: list[str], shards: int) -> DataFrame:
    """A small row per document with its coordinates, equal for equal texts."""
    names = {f"__m_{i}": d for i, d in enumerate(dims)}
    rows = needed(documents, __id=id_col, __text=text_col, **names)
    kinds = dict(rows.dtypes)
    rows = rows.select(
        "__id",
        (F.coalesce(F.octet_length("__text"), F.lit(0)) + ROW_BYTES).cast("long").alias("__size"),
        F.crc32(F.encode(F.coalesce("__text", F.lit("")), "UTF-8")).alias("__crc"),
        F.xxhash64(F.coalesce("__text", F.lit(""))).alias("__copy"),
        *(
            (_name_value(F.col(c)) if kinds[c] == "string" else F.coalesce(F.col(c).cast("long"), F.lit(-1))).alias(c)
            for c in names
        ),
    )
    rows = stage(rows, "shard-rows")
    copy = ["__copy", "__crc", "__size"]
    total = rows.agg(F.sum("__size").alias("s")).first()["s"] or 0
    piece = max(1.0, HOT_GROUP * total / shards)
    groups = rows.groupBy(*copy).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct("__id", *names)).alias("__rep")
    ).filter("__n > 1")
    groups = groups.withColumn("__pieces", F.ceil(F.col("__n") * F.col("__size") / F.lit(piece)).cast("int"))
    groups = stage(groups.select(*copy, "__pieces", *(F.col(f"__rep.{c}").alias(f"{c}r") for c in names)), "shard-copies")
    rep = [f"{c}r" for c in names]
    # groups over the size of a piece: at most shards / HOT_GROUP of them
    hot = groups.filter("__pieces > 1")
    cool = groups.filter("__pieces <= 1").drop("__pieces")
    marked = rows.join(F.broadcast(hot), copy, "left")
    in_hot = marked.filter("__pieces is not null").withColumn("__piece", F.expr("pmod(xxhash64(__id), __pieces)"))
    rest = marked.filter("__pieces is null").drop("__pieces", *rep).join(cool, copy, "left").withColumn("__piece", F.lit(0).cast("long"))
    both = in_hot.drop("__pieces").unionByName(rest)
    tie = F.shiftrightunsigned(F.xxhash64(*copy, "__piece"), 64 - TIE_BITS)
    return stage(
        both.withColumn("__tie", tie).select(
            "__id", "__size", "__crc", *(_with_tie(F.coalesce(f"{c}r", c)).alias(c) for c in names)
        ),
        "shard-points",
    )


def shard_documents(
    documents: DataFrame,
    shards: int = 24,
    dims: tuple[str, ...] = ("source", "lang", "n_chars"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: id, size, crc32 of the text, shard (0 to shards - 1), slot in the shard."""
    points = _coordinates(documents, id_col, text_col, list(dims), shards)
    names = [f"__m_{i}" for i in range(len(dims))]
    tree = build_tree(points, names, shards)
    n = points.count()
    buckets = max(1, -(-n // (SLOT_ROWS * shards)))
    placed = points.select(
        "__id", "__size", "__crc", tree.expression(lambda leaf: leaf.first).cast("int").alias("shard"),
        F.pmod(F.xxhash64("__id"), F.lit(buckets)).cast("int").alias("__bucket"),
    )
    counts = placed.groupBy("shard", "__bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__id", "__size", "__crc"))
    return placed.join(offsets, ["shard", "__bucket"]).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        "shard",
        (F.col("__before") + inside - 1).cast("long").alias("slot"),
    )
