"""Jaccard join, Hamming search, packing, token files and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from outvote.llm import hamming_search, jaccard_join as J, packing, token_files
from outvote.llm.components import components
from outvote.llm.curriculum_mix import mix
from outvote.llm.hamming_search import sign_code, top_k
from outvote.llm.jaccard_join import jaccard_join, least_matches, one_of_each
from outvote.llm.packing import pack, plan
from outvote.llm.token_files import count_tokens, document_tokens
from outvote.llm.tokens import Encoder, default_pattern, default_vocabulary
from outvote.staging import staged_path


class Shipped:
    value = (open(default_vocabulary(), "rb").read(), default_pattern())


ENCODER = Encoder(Shipped)
FAR = (1 << 63) - 1


def shingle_set(tokens):
    return frozenset(tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))) if tokens else None


def least(ids):
    ids = [i for i in ids if i is not None]
    return min(ids) if ids else None


def brute_groups(rows, words):
    """Per row: id, class_id, n_links, copy_id."""
    keys = [shingle_set(words(t)) or ("text", t or "") for _, t in rows]
    members = defaultdict(list)
    for n, k in enumerate(keys):
        members[k].append(n)
    names = list(members)
    links, near = Counter(), {k: {k} for k in names}
    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            if isinstance(x, frozenset) and isinstance(y, frozenset) and len(x & y) >= 0.8 * len(x | y):
                links[x] += len(members[y])
                links[y] += len(members[x])
                joined = near[x] | near[y]
                for k in joined:
                    near[k] = joined
    made = []
    for n, (i, _) in enumerate(rows):
        k = keys[n]
        group = [rows[m][0] for other in near[k] for m in members[other]]
        made.append((i, least(group), links[k] + len(members[k]) - 1, least(rows[m][0] for m in members[k])))
    return Counter(made)


def near_copies(draw, groups, size, length=60):
    rows, i = [], 0
    for g in range(groups):
        base = [f"g{g}w{draw.randint(0, 500)}" for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                text[draw.randrange(length)] = f"x{draw.randint(0, 99)}"
            rows.append((i, " ".join(text)))
            i += 1
    draw.shuffle(rows)
    return rows


def test_join_equals_brute_force(make, words):
    rows = near_copies(random.Random(1), 12, 12) + [(1000 + k, f"lone text number {k} of its own kind and no other") for k in range(40)]
    assert Counter(map(tuple, jaccard_join(make(rows)).collect())) == brute_groups(rows, words)


def test_large_group_in_many_blocks(make, words, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(J, "HELD_ROWS", 50)
    monkeypatch.setattr(J, "SLICE", 16)
    rows = near_copies(random.Random(2), 2, 90)
    assert Counter(map(tuple, jaccard_join(make(rows)).collect())) == brute_groups(rows, words)


def test_odd_documents_are_joined(odd, odd_rows, words, none):
    rows = [r[:2] for r in odd_rows]
    assert Counter(map(tuple, jaccard_join(odd).collect())) == brute_groups(rows, words)
    kept = one_of_each(odd.withColumn("class_id", F.lit("mine")))
    assert kept.columns == [*odd.columns, "class_id"]
    texts = [r["text"] for r in kept.collect()]
    keys = [shingle_set(words(t)) or ("text", t or "") for t in texts]
    assert len(keys) == len(set(keys)) == len({shingle_set(words(t)) or ("text", t or "") for _, t in rows})
    assert jaccard_join(none).count() == 0 and one_of_each(none).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    wanted = least_matches(0.8, 1e-6)
    assert list(wanted) == sorted(wanted) and wanted[-1] < 0.8 * J.VALUES
    # a pair at the threshold survives all looks in all but few of many draws
    draw = np.random.default_rng(0)
    same = draw.random((20_000, J.VALUES)) < 0.8
    matches = np.cumsum(same, 1)[:, J.STEP - 1 :: J.STEP]
    assert (matches >= np.array(wanted)).all(1).mean() > 0.999


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5), (3, 2), (2, 3)]
    edges += [(draw.randint(300, 420), draw.randint(300, 420)) for _ in range(90)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- search -----------------------------------------------------------------------------


def brute_search(codes, queries, k):
    made = []
    for i, c in set(queries):
        others = sorted(((c ^ d) & ((1 << 64) - 1)).bit_count() * (1 << 70) + j for j, d in set(codes) if j != i)
        made += [(i, n + 1, v % (1 << 70), v >> 70) for n, v in enumerate(others[:k])]
    return Counter(made)


@pytest.mark.parametrize("n,spread,k", [(300, 64, 5), (400, 9, 10), (6, 64, 10), (1, 64, 3), (0, 64, 3)])
def test_search_equals_brute_force(spark, n, spread, k, monkeypatch):
    monkeypatch.setattr(hamming_search, "BUCKET", 8)
    draw = random.Random(n)
    # few distinct codes where spread is small: groups of copies and ties
    codes = [(i, sum(draw.getrandbits(1) << b for b in draw.sample(range(64), spread)) if spread == 64 else draw.getrandbits(5)) for i in range(n)]
    codes = [(i, c - (1 << 64) if c >> 63 else c) for i, c in codes]
    df = spark.createDataFrame([*codes, *codes[:3], (None, 5), (n + 1, None)], "id long, code long")
    found = top_k(df, df.filter("id % 50 = 0"), k)
    queries = [c for c in codes if c[0] % 50 == 0]
    assert Counter(map(tuple, found.collect())) == brute_search(codes, queries, k)


def test_codes_of_odd_vectors(spark):
    rows = [(1, [1.0, -1.0, 0.0, 2.0]), (2, None), (3, []), (4, [None, 5.0]), (5, [1.0] * 64), (6, [float("nan"), -0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").select("id", sign_code("v").alias("code"))
    assert dict(map(tuple, df.collect())) == {1: 9, 2: None, 3: 0, 4: 2, 5: -1, 6: 1}
    with pytest.raises(Exception, match="more than 64"):
        spark.createDataFrame([(1, [0.5] * 65)], "id long, v array<float>").select(sign_code("v")).collect()


# --- packing and tokens -----------------------------------------------------------------


def check_packing(found, rows, tiers=packing.TIERS):
    pieces, sequences = Counter(), defaultdict(list)
    for r in found:
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["window"], r["step"]))
    wanted = Counter()
    for i, t in rows:
        ids = np.append(ENCODER.ids(t), 0).astype("<u4")
        for s in range(0, len(ids), tiers[-1]):
            part = ids[s : s + tiers[-1]]
            wanted[i, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert pieces == wanted
    for parts in sequences.values():
        end = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == end
            end += length
        assert len({p[2:] for p in parts}) == 1 and end <= parts[0][2]
        # shorter windows are full
        assert parts[0][2] == tiers[-1] or end == parts[0][2]
    return sequences


def test_packing_of_the_table(table, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    documents = table("documents")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    sequences = check_packing(pack(documents).collect(), rows)
    tokens = sum(p[1] for parts in sequences.values() for p in parts)
    room = sum(parts[0][2] for parts in sequences.values())
    assert room < 1.02 * tokens
    per_step = Counter((parts[0][2:]) for parts in sequences.values())
    assert all(n * window <= packing.STEP_TOKENS for (window, _), n in per_step.items())


def test_packing_of_odd_rows(odd, odd_rows, none):
    check_packing(pack(odd.withColumn("window", F.lit(1))).collect(), [r[:2] for r in odd_rows])
    check_packing(pack(odd, tiers=(16, 64)).collect(), [r[:2] for r in odd_rows], (16, 64))
    assert pack(none).count() == 0
    with pytest.raises(ValueError):
        pack(none, tiers=(100, 200))


@pytest.mark.parametrize("seed", range(30))
def test_plans_use_every_piece_once(seed):
    draw = random.Random(seed)
    counts = Counter(draw.randint(1, 1024) if seed % 3 else draw.choice([1024, 300, 512, 7]) for _ in range(draw.choice([1, 10, 3000])))
    used = Counter()
    for p in plan(counts):
        filled = sum(n * k for n, k in p.uses.items())
        assert filled <= p.window and (p.window == 1024 or filled == p.window) and p.times > 0
        for n, k in p.uses.items():
            used[n] += k * p.times
    assert used == counts


def test_token_files_of_odd_rows(odd, odd_rows, none):
    wanted = Counter((i, len(ENCODER.ids(t))) for i, t in [r[:2] for r in odd_rows])
    assert Counter(map(tuple, document_tokens(odd).collect())) == wanted
    assert document_tokens(none).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_documents_over_any_blocks(spark, block, tmp_path):
    draw = np.random.default_rng(block)
    wanted = set()
    for f in range(4):
        ids = draw.integers(0, 4 if f else 2, 200 if f < 3 else 0).astype("<u2")
        (tmp_path / f"file{f}.bin").write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 0)
        begin = 0
        for n, e in enumerate(ends):
            wanted.add((f"file{f}.bin", n, e - begin, True))
            begin = e + 1
        if begin < len(ids):
            wanted.add((f"file{f}.bin", len(ends), len(ids) - begin, False))
    found = count_tokens(spark, str(tmp_path), 2, 0, block).collect()
    assert len(found) == len(wanted) and {(r["file"].rsplit("/", 1)[1], *r[1:]) for r in found} == wanted


def test_broken_token_file(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a whole number"):
        count_tokens(spark, str(tmp_path)).collect()


def test_ids_that_do_not_fit(spark, make, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_IDS", 10)
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(make([(1, "some words")]).select("doc_id", "text"), staged_path(spark, "t"))


# --- pipeline ---------------------------------------------------------------------------


def test_stages_do_their_part(spark, table, words):
    folder = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    documents = table("documents")
    docs, seen = documents, {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(function(spark, docs, folder), name)
        seen[name] = before, docs
        if name != "packing":
            assert docs.dtypes == documents.dtypes
    before, after = seen["toxicity"]
    toxic = {r["doc_id"] for r in table("labels").filter("toxic = 1").collect()}
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert gone & toxic and len(gone - toxic) < 0.1 * before.count()
    before, after = seen["line_dedup"]
    assert after.count() == before.count() and not after.filter("n_chars != char_length(text)").count()
    before, after = seen["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {c for _, c, _, _ in brute_groups(rows, words)}
    before, after = seen["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mix(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({i: n for i, n in copies.items() if n})
    before, after = seen["packing"]
    check_packing(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()])


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    for name, rows in (("odd", odd), ("none", none)):
        folder = tmp_path / name
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert (corpus_pipeline.run(spark, str(folder)).count() > 0) == (name == "odd")
