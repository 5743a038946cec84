"""The conversation trie against a dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from outvote.llm import queries
from outvote.llm.conversation_trie import WIDTH, _common, _text_bytes, burst, distinct, prefix_trie, rebuilt, sequences

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            conversations[conv].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {}
    for conv, turns in conversations.items():
        # turns of one number and role come by the hash of their text
        turns.sort(key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    for conv, turns in conversations.items():
        h = zlib.crc32(str(conv).encode()) % 9
        shared = conversations.get(conv - conv % 5, [])[:h]
        whole[conv] = tuple(t[2:] for t in shared) + tuple(t[2:] for t in turns[h:])
    members = defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, found in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(found) - 1) * (len(path[-1][1].encode()) if path else 0)
    made = []
    for path, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if whole[c] == path)
        parent = min(members[path[:-1]]) if path else None
        made.append((min(found), len(path), parent, len(found), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(made, key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def shared_by_many():
    """Copies of one conversation, a common first turn, and prefixes of prefixes."""
    rows = []
    for conv in range(0, 400, 5):  # these keep their own turns
        base = [("system", "the same start"), ("user", "the same question")]
        if conv % 3 == 0:
            base += [("assistant", "the same answer")]
        elif conv % 7:
            base += [("assistant", f"answer {conv % 4}"), ("user", f"thanks {conv}")] * (1 + conv % 4)
        rows += [(conv, t, r, x) for t, (r, x) in enumerate(base)]
        rows += [(conv + 1, t, r, f"{x} {conv % 11}") for t, (r, x) in enumerate(base)]
    return rows


ODD = [
    (0, None, None, None), (0, 1, "user", "é🙂"), (0, 1, "user", "é🙂"), (0, 1, "assistant", "b"), (1, 0, "user", None),
    (1, 0, None, "user"), (2, 5, "a", "long " * 20_000), (3, 1, "user", "x"), (7, 1, "user", ""), (7, 1, "user", "x"),
    (8, 1, "user", ""), (8, 1, "user", "x"), (9, -3, "", ""), (None, 1, "user", "nobody's"), (1_000_000_007, 1, "user", "x"),
    (11, 1, "tool", "a\nb,c"), (11, 2, "tool", "|"), (16, 1, "tool", "a\nb"), (4, 0, "user", "x"), (4, 1, "user", "x"),
]


@pytest.mark.parametrize("container_turns", [1, 7, 2_000])
@pytest.mark.parametrize("rows", [ODD, shared_by_many()], ids=["odd", "shared"])
def test_nodes_match_a_dictionary(spark, rows, container_turns):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert nodes(prefix_trie(df, container_turns)) == brute(rows)


def test_one_conversation_of_many_turns(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(3_000)] + [(10, t, "user", f"turn {t}") for t in range(2_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert nodes(prefix_trie(df, 100)) == brute(rows)


def test_a_burst_passes_a_shared_prefix_at_once(spark):
    rows = [(5 * c, t, "user", f"turn {t}" if t < 50 else f"turn {t} of {c}") for c in range(30) for t in range(55)]
    found = distinct(rebuilt(sequences(spark.createDataFrame(rows, SCHEMA))))
    containers, rounds = burst(found, 100)
    assert len(rounds) == 1
    assert [r["shared"] for r in rounds[0].collect()] == [50]
    assert containers.count() == 30
    assert containers.groupBy("head").count().agg(F.max("count")).first()[0] == 1


def test_containers_stay_within_their_bound(spark):
    df = spark.createDataFrame(shared_by_many(), SCHEMA)
    containers, rounds = burst(distinct(rebuilt(sequences(df))), 10)
    assert rounds
    turns = F.octet_length("ids") / WIDTH - F.col("depth")
    sizes = containers.groupBy("head").agg(F.sum(turns).alias("turns"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["turns"] <= 10 or r["n"] == 1 for r in sizes)


def test_empty_table_and_clashing_columns(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame(ODD, SCHEMA)
    names = ["ids", "conv", "at", "part", "piece", "key", "head", "depth", "above", "least", "n", "ends", "family", "cut", "base", "a.b", "`c`"]
    wider = df.select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    assert nodes(prefix_trie(wider)) == brute(ODD)
    renamed = df.toDF("conversation id", "the.turn", "who", "said")
    assert nodes(prefix_trie(renamed, conv="conversation id", turn="the.turn", role="who", text="said")) == brute(ODD)


def test_ids_hold_lengths_and_common_prefixes(spark):
    ids = {r["conv"]: bytes(r["ids"]) for r in sequences(spark.createDataFrame(ODD, SCHEMA)).collect()}
    assert _text_bytes(ids[0]).tolist() == [0, 1, 6, 6]
    assert _common(ids[7], ids[8]) == 2
    assert _common(ids[11], ids[16]) == 0


def test_query_over_the_whole_table(spark, table):
    rows = [tuple(r) for r in table("conversations").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op11_conversation_trie"](spark, "/root/testdata/sf0.001")
    assert found.columns == COLUMNS
    assert nodes(found) == brute(rows)
