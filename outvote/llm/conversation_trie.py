"""A prefix trie of conversations, built as burst tries.

A turn's id is 16 bytes of hash over role and text and 4 bytes of text length; a
conversation is the bytes of its turns' ids, and copies of one sequence are a single row with
their number. A container holds the suffixes of all sequences below one trie head. Rounds
burst each container of more than `container_turns` turns (and two sequences): its sequences
share their ids up to some depth, known from the least and the greatest of them, and go to
new containers by the turn id that follows. So a round passes a shared prefix of any length at
once, and the number of rounds follows the branching of crowded heads, not their depth. The
remaining containers are dealt over tasks, sorted, and swept: neighbours' common prefixes give
the nodes, whose sums are folded when the sweep leaves them. Last, the nodes along the burst
heads are made, latest round first, from sums over the containers below.

Conversations are put together in two steps, from range-sorted turns: a task joins what it
has of each, and only these pieces are grouped, so a conversation spread over many tasks
comes as few rows. Its ids (20 bytes a turn) are one row in the end: 100 million turns at most.
The members of a node's hash are strung together the same way and hashed as a stream.

Nulls and ties: turns ascend with nulls first, equal ones by role and then id; null roles and
texts are empty; repeated rows are turns each; rows without a conversation id belong to none. An
empty table has no nodes. Columns beyond the four named ones play no part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outvote.llm.columns import needed
from outvote.staging import discard, stage

#: Bytes of a turn's id: hash, then the text's length.
HASH, WIDTH = 16, 20
#: Turns of a base conversation that may be shared, and conversations per base.
MOST_SHARED, FAMILY = 8, 5
CONTAINER_TURNS = 2_000
#: Pieces of at most this many turns, ids or rows leave a task at a time.
PIECE = 65_536
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


# --- sequences --------------------------------------------------------------------------


def turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    hashed = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(hashed, F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def _pieces(key: str, ends: list[str], join, limit: int = PIECE):
    """Of sorted rows: runs of equal keys as (key, number of the piece, its first value, value
    joined by `join`), a piece at most `limit` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, values, number, out = None, [], 0, []

        def close() -> None:
            nonlocal values, number
            if values:
                out.append((current, number, join(values)))
                number, values = number + 1, []

        for batch in batches:
            for k, value in zip(batch.column(key).to_pylist(), batch.column(ends[0]).to_pylist()):
                if k != current or len(values) == limit:
                    close()
                    current = k
                values.append(value)
            if out:
                yield _batch(out, [batch.schema.field(key).type, pa.int64(), batch.schema.field(ends[0]).type], [key, "piece", ends[0]])
                out = []
        close()
        if out:
            yield _batch(out, [batch.schema.field(key).type, pa.int64(), batch.schema.field(ends[0]).type], [key, "piece", ends[0]])

    return pack


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv (bigint), ids: the turns' ids in order. Texts do not travel."""
    rows = needed(conversations, conv=conv, turn=turn, role=role, text=text).filter("conv is not null")
    rows = rows.select(F.col("conv").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), turn_id(F.col("role"), F.col("text")).alias("ids"))
    rows = stage(rows, "trie-turns")  # sorting by ranges reads its input twice
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("ids")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ordered.select("conv", "ids").mapInArrow(_pieces("conv", ["ids"], b"".join), "conv long, piece long, ids binary")
    pieces = pieces.select("conv", "ids", F.struct(F.spark_partition_id().alias("part"), "piece").alias("at"))
    return pieces.groupBy("conv").agg(_joined("at", "ids"))


def _joined(order: str, ids: str) -> Column:
    """The binary pieces of a group, one after another."""
    found = F.sort_array(F.collect_list(F.struct(order, ids)))
    return F.unhex(F.array_join(F.transform(found, lambda x: F.hex(x[ids])), "")).alias(ids)


def rebuilt(found: DataFrame) -> DataFrame:
    """Each conversation's first turns give way to those of the first in its family."""
    family = F.col("conv") - F.col("conv") % FAMILY
    shared = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % (MOST_SHARED + 1)
    own = found.select("conv", "ids", family.alias("family"), (WIDTH * shared).cast("int").alias("cut"))
    bases = found.filter(family == F.col("conv")).select(F.col("conv").alias("family"), F.substring("ids", 1, WIDTH * MOST_SHARED).alias("base"))
    head = F.coalesce(F.expr("substring(base, 1, cut)"), F.lit(b""))
    return own.join(bases, "family", "left").select("conv", F.concat(head, F.expr("substring(ids, cut + 1)")).alias("ids"))


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by key and place: each key's hash over its members, comma-joined."""
    current, state, out = None, None, []
    for batch in batches:
        for key, value in zip(batch.column("key").to_pylist(), batch.column("members").to_pylist()):
            if key == current:
                state.update(b",")
            else:
                if state is not None:
                    out.append((current, state.hexdigest()))
                current, state = key, hashlib.sha256()
            state.update(value.encode())
        if len(out) >= PIECE:
            yield _batch(out, [pa.binary(), pa.string()], ["key", "ends"])
            out = []
    if state is not None:
        out.append((current, state.hexdigest()))
        yield _batch(out, [pa.binary(), pa.string()], ["key", "ends"])


def distinct(found: DataFrame) -> DataFrame:
    """A row for each distinct sequence: ids, n (conversations), least (of them), ends (the hash
    of their ids), staged. Copies are counted before they travel."""
    keyed = stage(found.withColumn("key", F.unhex(F.md5("ids"))), "trie-sequences")
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"))
    # the sequence comes with its least conversation
    groups = counted.join(keyed.select(F.col("conv").alias("least"), "ids"), "least")
    ordered = keyed.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    texts = ordered.select("key", F.col("conv").cast("string").alias("members"))
    pieces = texts.mapInArrow(_pieces("key", ["members"], ",".join), "key binary, piece long, members string")
    pieces = pieces.withColumn("part", F.spark_partition_id()).repartition("key").sortWithinPartitions("key", "part", "piece")
    hashes = pieces.select("key", "members").mapInArrow(_hash_members, "key binary, ends string")
    made = stage(groups.join(hashes, "key").select("ids", "n", "least", "ends"), "trie-distinct")
    discard(keyed)
    return made


# --- containers -------------------------------------------------------------------------


def _common(first: bytes, last: bytes) -> int:
    """Turns that two sequences share from the start."""
    n = min(len(first), len(last)) // WIDTH * WIDTH
    a, b = (np.frombuffer(x, np.uint8, n) for x in (first, last))
    differ = np.flatnonzero(a != b)
    return (int(differ[0]) if len(differ) else n) // WIDTH


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("first").to_pylist(), batch.column("last").to_pylist())
        shared = pa.array([_common(a, b) for a, b in pairs], pa.int32())
        kept = [c for c in batch.schema.names if c != "last"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), shared], [*kept, "shared"])


_HEAD = "head binary, depth int, above binary, above_least long"


def burst(found: DataFrame, container_turns: int = CONTAINER_TURNS) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of containers that stay whole, and the burst heads of each round, staged.

    A row: head (hash of the prefix), depth (its turns), above (the burst head it hangs from)
    and the sequence. A burst head: also its totals, the prefix its sequences share and, if one
    of them ends with it, the hash of that one's members."""
    turns = F.greatest(F.lit(1), F.octet_length("ids") / WIDTH - F.col("depth"))
    rows = found.select(
        F.lit(b"").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("above"), F.lit(None).cast("long").alias("above_least"), "*"
    )
    whole, rounds = [], []
    while True:
        sizes = rows.groupBy("head").agg(F.sum(turns).alias("turns"), F.count(F.lit(1)).alias("sequences"))
        crowded = sizes.filter((F.col("turns") > container_turns) & (F.col("sequences") > 1)).select("head", F.lit(True).alias("crowded"))
        marked = stage(rows.join(crowded, "head", "left"), "trie-containers")
        whole.append(marked.filter("crowded is null").drop("crowded"))
        rows = marked.filter("crowded")
        if rows.isEmpty():
            break
        totals = rows.groupBy("head").agg(
            F.first("depth").alias("depth"), F.first("above").alias("above"), F.first("above_least").alias("above_least"),
            F.sum("n").alias("n"), F.min("least").alias("head_least"), F.min("ids").alias("first"), F.max("ids").alias("last"),
        )
        kind = f"{_HEAD}, n long, head_least long, first binary, shared int"
        heads = stage(totals.mapInArrow(_shared, kind), "trie-heads")
        joined = rows.drop("above", "above_least", "crowded", "depth").join(heads.select("head", "shared", "head_least"), "head")
        # of distinct sequences one at most is just the shared prefix; it stays with the burst head
        beyond, at_end = (joined.filter(c) for c in (F.octet_length("ids") > WIDTH * F.col("shared"), F.octet_length("ids") == WIDTH * F.col("shared")))
        rounds.append(heads.join(at_end.select("head", "ends"), "head", "left"))
        rows = beyond.select(
            F.unhex(F.md5(F.expr(f"substring(ids, 1, {WIDTH} * (shared + 1))"))).alias("head"),
            (F.col("shared") + 1).alias("depth"),
            F.col("head").alias("above"),
            F.col("head_least").alias("above_least"),
            "ids", "n", "least", "ends",
        )
    return reduce(DataFrame.unionByName, whole), rounds


# --- nodes ------------------------------------------------------------------------------

_NODE = [
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("head", pa.binary()), ("above", pa.binary()),
]
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
_NODE_SCHEMA = ", ".join(f"{n} {_KINDS[k]}" for n, k in _NODE)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, [k for _, k in _NODE], [n for n, _ in _NODE])


def _text_bytes(ids: bytes) -> np.ndarray:
    """The length of each turn's text."""
    table = np.frombuffer(ids, np.uint8).reshape(-1, WIDTH)
    return np.ascontiguousarray(table[:, HASH:]).view(">u4").ravel().astype(np.int64)


class _Open:
    """A node the sweep is inside of."""

    __slots__ = ("children", "depth", "ends", "leaves", "least", "n", "saved", "size", "waiting")

    def __init__(self, depth: int, size: int):
        self.depth, self.size, self.least, self.ends = depth, size, None, NO_MEMBERS
        self.n = self.children = self.leaves = self.saved = 0
        #: children whose parent id is not known before this node is left
        self.waiting: list[tuple] = []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, ids) -> the nodes of their containers, from the head down."""
    out: list[tuple] = []
    path: list[_Open] = []
    head, before = None, b""
    above = above_least = None

    def leave(depth: int) -> None:
        """Close the nodes deeper than `depth`."""
        while path and path[-1].depth > depth:
            node = path.pop()
            node.saved += (node.n - 1) * node.size
            node.leaves += not node.children
            out.extend((*c[:2], node.least, *c[2:]) for c in node.waiting)
            row = (node.least, node.depth, node.n, node.children, node.leaves, node.saved, node.ends)
            if path:
                up = path[-1]
                up.n, up.leaves, up.saved, up.children = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved, up.children + 1
                up.least = node.least if up.least is None else min(up.least, node.least)
                up.waiting.append((*row, None, None))
            else:
                out.append((*row[:2], above_least, *row[2:], head, above))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("head", "depth", "above", "above_least", "ids", "n", "least", "ends"))
        for h, depth, up, up_least, ids, n, least, ends in zip(*columns):
            sizes = _text_bytes(ids)
            if h != head:
                leave(-1)
                head, above, above_least = h, up, up_least
                path.append(_Open(depth, int(sizes[depth - 1]) if depth else 0))
            else:
                leave(_common(before, ids))
            for d in range(path[-1].depth + 1, len(sizes) + 1):
                path.append(_Open(d, int(sizes[d - 1])))
            last = path[-1]
            last.n, last.ends = n, ends
            last.least = least if last.least is None else min(last.least, least)
            before = ids
        if len(out) >= PIECE:
            yield _node_batch(out)
            out.clear()
    leave(-1)
    if out:
        yield _node_batch(out)


def _trunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Burst heads with the sums over the containers below -> the nodes of their shared prefixes."""
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("head", "depth", "above", "above_least", "n", "head_least", "first", "shared", "children", "leaves", "saved", "ends"))
        for head, depth, above, above_least, n, least, first, shared, children, leaves, saved, ends in zip(*columns):
            sizes = [0, *_text_bytes(first[: WIDTH * shared]).tolist()]
            for d in range(shared, depth - 1, -1):
                saved += (n - 1) * sizes[d]
                at_head = d == depth
                out.append((
                    least, d, above_least if at_head else least, n, children if d == shared else 1, leaves, saved,
                    ends if d == shared and ends else NO_MEMBERS, head if at_head else None, above if at_head else None,
                ))
                if len(out) >= PIECE:
                    yield _node_batch(out)
                    out = []
        if out:
            yield _node_batch(out)


def prefix_trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS, **columns: str) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations."""
    found = distinct(rebuilt(sequences(conversations, **columns)))
    containers, rounds = burst(found, container_turns)
    dealt = containers.repartition("head").sortWithinPartitions("head", "ids")
    swept = stage(dealt.mapInArrow(_sweep, _NODE_SCHEMA), "trie-nodes")
    parts = [swept]
    tops = swept.filter("head is not null")
    for heads in reversed(rounds):
        sums = tops.filter("above is not null").groupBy(F.col("above").alias("head")).agg(
            F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        trunk = stage(heads.join(sums, "head").mapInArrow(_trunk, _NODE_SCHEMA), "trie-trunk")
        parts.append(trunk)
        tops = tops.unionByName(trunk.filter("head is not null"))
    return reduce(DataFrame.unionByName, parts).drop("head", "above")
