"""The Merkle manifest against hashlib."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from outvote.llm import queries
from outvote.llm.merkle_manifest import build, leaves, manifest, runs_of
from outvote.llm.ordinals import numbered

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [*row[:4], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(hashes, fanout):
    """The root, and for each leaf the siblings before and after it at each level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, a in enumerate(at):
            run = hashes[a // fanout * fanout :][:fanout]
            paths[i].append((run[: a % fanout], run[a % fanout + 1 :]))
            at[i] = a // fanout
        hashes = [h("".join(hashes[i : i + fanout])) for i in range(0, len(hashes), fanout)]
    return hashes[0], paths


def brute(rows, fanout=8):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in langs:
        groups[g].sort(key=lambda x: x[:3])
        below[g] = tree([x[2] for x in groups[g]], fanout)
    root, above = tree([below[g][0] for g in langs], fanout) if langs else (None, [])
    made = []
    for g, top in zip(langs, above):
        for (_, _, own, r), path in zip(groups[g], below[g][1]):
            siblings = path + top
            tampers = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, lowered(r[4])) if tampers else own
            for before, after in siblings:
                folded = h("".join(before) + folded + "".join(after))
            proof = "".join("".join(a) + "".join(b) for a, b in siblings)
            made.append((r[0], own, below[g][0], root, proof, folded, folded == root))
    return sorted(made, key=str)


def found(df):
    columns = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def rows_of(n, lang=lambda i: "en"):
    return [(i, f"s{i % 3}", lang(i), i * 7, f"Text {i} ÄB" if i % 5 else None) for i in range(n)]


CASES = {
    "one": rows_of(1),
    "eight": rows_of(8),
    "nine": rows_of(9),
    "three levels": rows_of(70),
    "a lone leaf beside others": rows_of(20, lambda i: "de" if i == 7 else "en"),
    "many groups": rows_of(90, lambda i: None if i % 12 == 0 else f"l{i % 31}"),
    "odd": [
        (1, None, None, None, None), (None, "", "", 0, ""), (2, "é", "🙂", 1, "AbC"), (2, "é", "🙂", 1, "AbC"), (2, "é", "🙂", 1, "ABC"),
        (3, "s", "", 1, "W " * 50_000), (4, "s", None, 1, "1:x-"), (5, "-", "-", -1, "-"), (None, None, None, None, "Null id"),
    ],
}


@pytest.mark.parametrize("name", CASES)
def test_matches_hashlib(spark, name):
    df = spark.createDataFrame(CASES[name], SCHEMA).repartition(4)
    assert found(manifest(df)) == brute(CASES[name])


def test_other_fanout(spark):
    rows = rows_of(40, lambda i: f"l{i % 3}")
    assert found(manifest(spark.createDataFrame(rows, SCHEMA), fanout=2)) == brute(rows, 2)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest(empty).collect() == []
    rows = rows_of(20, lambda i: "de" if i % 4 else None)
    names = ["row", "key", "tree", "leaf", "tampered", "idx", "n", "__row", "__key", "__f0", "__n", "__index", "root", "salt", "a.b"]
    wider = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    assert found(manifest(wider)) == brute(rows)


def test_nodes_are_linked_to_their_parents(spark):
    rows = rows_of(300, lambda i: f"l{i % 2}")
    placed = leaves(spark.createDataFrame(rows, SCHEMA), FIELDS, "doc_id", "lang", "text")
    nodes, _ = build(runs_of(placed, 8))
    by_key = {(r["tree"], r["level"], r["idx"]): r for r in nodes.collect()}
    roots = [r for r in by_key.values() if r["up_tree"] is None]
    assert len(roots) == 1 and roots[0]["weight"] == 300
    for r in by_key.values():
        if r["up_tree"] is not None:
            parent = by_key[r["up_tree"], r["up_level"], r["up_idx"]]
            at = 32 * r["up_ordinal"]
            assert parent["children"][at : at + 32] == r["digest"]


def test_ordinals_of_a_group_over_many_ranges(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("hot").alias("g"), (F.col("id") % 1_000).alias("v"))
    placed = numbered(rows.repartition(6), "g", ["v"], "test-ordinals")
    for g, group in placed.toPandas().sort_values("__index").groupby("g"):
        assert group["__index"].tolist() == list(range(len(group)))
        assert group["v"].is_monotonic_increasing
        assert set(group["__n"]) == {len(group)}


def test_query_over_the_whole_table(spark, table):
    rows = [tuple(r) for r in table("documents").select(*FIELDS).collect()]
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = queries.QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001")
    want = [(i, own, sub, root, h(proof), folded, ok) for i, own, sub, root, proof, folded, ok in brute(rows)]
    assert found(got.withColumnRenamed("proof_sha256", "proof")) == sorted(want, key=str)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
