"""Line dedup, sharding and mixing against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from outvote.llm import kd_shards
from outvote.llm.curriculum_mix import SCHEDULES, _time_of, in_training_order, mix
from outvote.llm.kd_shards import shard_documents
from outvote.llm.line_dedup import dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 63


def lines_without_later_copies(rows):
    keyed = [(LAST if i is None else i, [(x, x.strip(" \t\n\x0b\x0c\r").translate(LOWER)) for x in (t or "").split("\n")]) for i, t in rows]
    holder = {}
    for i, lines in keyed:
        for _, k in lines:
            if len(k) >= 10:
                holder[k] = min(holder.get(k, i), i)
    kept = [[x for x, k in lines if len(k) < 10 or holder[k] == i] for i, lines in keyed]
    return [(rows[n][0], len(keyed[n][1]), len(keyed[n][1]) - len(kept[n]), "\n".join(kept[n])) for n in range(len(rows))]


def found_lines(df):
    rows = df.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text")).collect()
    return Counter(map(tuple, rows))


def test_odd_lines(odd, odd_rows):
    assert found_lines(dedup_lines(odd)) == Counter(lines_without_later_copies([r[:2] for r in odd_rows]))


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 2), (9, 3)])
def test_lines_for_any_batches_and_levels(make, batches, fanout):
    draw = random.Random(batches)
    pool = [f"a line that is number {k:02d}" for k in range(25)] + ["short", "", " A LINE that is number 03\t"]
    rows = [(i, "\n".join(draw.choices(pool, k=draw.randint(0, 6)))) for i in draw.sample(range(1000), 120)]
    assert found_lines(dedup_lines(make(rows), batches=batches, fanout=fanout)) == Counter(lines_without_later_copies(rows))


def test_hot_line_and_clashing_columns(make):
    rows = [(i, "the line that everyone has\n" + f"own line of document {i}") for i in range(700)]
    df = make(rows).withColumn("N_Lines", F.lit("mine")).withColumn("a.b", F.lit(1))
    found = dedup_lines(df)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "n_lines", "n_dropped"]
    assert found.agg(F.sum("n_dropped")).first()[0] == 699


def test_empty_tables(none):
    assert dedup_lines(none).count() == 0
    assert shard_documents(none).count() == 0
    assert mix(none).count() == 0


def shard_rows(df, shards):
    rows = df.collect()
    slots, size, texts = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, size


def test_odd_shards(odd, odd_rows):
    rows, _ = shard_rows(shard_documents(odd.withColumn("slot", F.lit(9)), 5), 5)
    wanted = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == wanted


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards_are_near_equal_and_keep_copies_together(make, shards):
    draw = random.Random(shards)
    rows = [(i, "t" * draw.randint(0, 400) + str(i % 900), f"src{min(9, int(draw.expovariate(0.7)))}") for i in range(3000)]
    found, size = shard_rows(shard_documents(make(rows), shards), shards)
    target = sum(size.values()) / shards
    assert len(size) == shards and max(size.values()) < 1.06 * target and min(size.values()) > 0.94 * target
    text = dict((r[0], r[1]) for r in rows)
    groups = defaultdict(set)
    for r in found:
        groups[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())


def test_a_third_of_copies_is_dealt_over_shards(make):
    rows = [(i, "copy " * 30 if i % 3 else f"text of {i} " * 13) for i in range(2400)]
    _, size = shard_rows(shard_documents(make(rows), 12), 12)
    assert max(size.values()) < 1.15 * sum(size.values()) / 12


def test_slots_of_many_buckets(make, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 7)
    shard_rows(shard_documents(make([(i, f"t{i}") for i in range(400)]), 4), 4)


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * size[s] if s in full else weight[s] * rest / share for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_targets(make, words):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 60), draw.choice(["a", "a", "a", "a", "B", "é", "zz", None, "c"])) for i in range(900)]
    found = mix(make(rows)).collect()
    size = Counter()
    for i, t, s in rows:
        size[s] += len(words(t))
    target, taken = brute_targets(size), Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] and r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    again = mix(make(rows, parts=5)).collect()
    assert sorted((r["doc_id"], r["taken"], str(r["positions"])) for r in again) == sorted((r["doc_id"], r["taken"], str(r["positions"])) for r in found)


def test_odd_mix_and_its_order(odd, odd_rows, words):
    found = mix(odd.withColumn("Taken", F.lit("x")))
    assert Counter((r["doc_id"], r["size"]) for r in found.collect()) == Counter((i, len(words(t))) for i, t in odd_rows)
    ordered = in_training_order(found, odd.columns)
    assert ordered.columns == odd.columns
    assert ordered.count() == found.agg(F.sum("copies")).first()[0]


def test_time_inverts_the_integral_of_the_schedule(spark):
    for knots in SCHEDULES:
        total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        rows = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", _time_of(F.col("u"), knots)).collect()
        for r in rows:
            area = 0.0
            for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
                t = min(max(r["t"], t0), t1)
                area += (t - t0) * (r0 + r0 + (r1 - r0) * (t - t0) / (t1 - t0)) / 2
            assert area / total == pytest.approx(r["u"], abs=1e-9)


