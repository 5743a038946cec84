"""Counts of every labelled document; strings and expressions by broadcast and by join."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from outvote.llm import toxicity as X
from outvote.llm.kneser_ney import Models
from outvote.llm.text_arrays import span_hashes, texts_of

BASE = "the river rose after days of rain and people began to carry things up the hill where bread was kept warm".split()


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def rows_of(n=300):
    rows, labels = [], []
    for i in range(n):
        words = [BASE[(i * 7 + j * j) % len(BASE)] for j in range(20 + i % 20)]
        if i % 5 == 0:
            words[i % 11] = words[15] = f"vile{i % 25 // 5}thing"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def test_expressions_outside_the_curves_sample_are_learnt(spark, make, monkeypatch):
    rows, labels = rows_of()
    # in labelled documents that come last in the sample's order, and in held-out ones
    import hashlib

    late = sorted((i for i, toxic in labels if toxic and not held(i)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[-8:]
    seen = [i for i, toxic in labels if toxic and held(i)][:3]
    rows = [(i, t.replace("vile", "qwoxz") if i in late + seen else t.replace("qwoxz", "vile")) for i, t in rows]
    monkeypatch.setattr(X, "TOXIC_ROWS", 20)
    monkeypatch.setattr(X, "ORDINARY_ROWS", 60)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in X.score(make(rows), labelled).collect()}
    assert seen and all(found[i] == 1 for i in seen)


@pytest.mark.parametrize("hot", [0, 40, 200_000])
def test_ratios_equal_those_of_models_in_one_piece(spark, make, monkeypatch, hot):
    monkeypatch.setattr(X, "HOT_ROWS", hot)
    rows, labels = rows_of()
    documents = make(rows).select("doc_id", "text")
    learnt = X.learnt_from(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    vocabulary = X.vocabulary_of(X.with_labels(documents, learnt))
    found = {r["h"]: [r[m] for m in X.RATIOS] for r in X.expression_ratios(vocabulary).collect()}
    words = sorted((bytes(r["word"]), [r[c] for c in X.COUNTS[1:]]) for r in vocabulary.collect())
    counts = np.array([c for _, c in words])
    assert len(found) == len(words) and counts.sum() > 0
    texts = texts_of(pa.array([w.decode() for w, _ in words]))
    starts, ends = texts.bounds[:-1], texts.bounds[1:]
    for m, columns in enumerate(([2, 3], [0, 1], [[0, 2], [1, 3]])):
        own = counts[:, columns] if m < 2 else np.stack([counts[:, c].sum(1) for c in columns], 1)
        has = own.any(1)
        model = Models([w for (w, _), known in zip(words, has) if known], own[has].astype(float))
        wanted = model.ratios(texts.data, starts, ends)
        keys = span_hashes(texts.data, starts, ends).view(np.int64)
        assert [found[k][m] for k in keys.tolist()] == pytest.approx(wanted, abs=1e-9)


def test_scores_are_the_same_by_broadcast_and_by_join(spark, make, odd, monkeypatch):
    rows, labels = rows_of()
    documents = make(rows + [(1000 + i, t) for i, t in rows[:20]]).unionByName(odd)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = []
    for hot in (200_000, 30, 0):
        monkeypatch.setattr(X, "HOT_ROWS", hot)
        scores.append(sorted((r["doc_id"] or -1, r["text"] or "", r["score"]) for r in X.score(documents, labelled).collect()))
    for other in scores[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in scores[0]]
        assert [r[2] for r in other] == pytest.approx([r[2] for r in scores[0]], abs=1e-9)


@pytest.mark.parametrize("label_rows", [0, 1_000_000])
def test_counts_of_each_class(spark, make, monkeypatch, label_rows):
    """By broadcast labels and by joined ones; of several texts for an id the least is learnt from."""
    monkeypatch.setattr(X, "LABEL_ROWS", label_rows)
    rows = [(i, f"word{i % 5} other{i % 3}") for i in range(60)] + [(4, "zebra"), (4, "apple"), (6, "word1 twice word1"), (6, None), (None, "nobody")]
    labels = [(i, i % 2) for i in range(0, 70, 2)] + [(4, 1), (5, 7), (None, 1), (6, 0), (8, None)]
    documents = make(rows).select("doc_id", "text")
    learnt = X.learnt_from(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kinds = {r["doc_id"]: 1 + 2 * r["fold"] + r["toxic"] for r in learnt.collect()}
    assert 4 not in kinds or kinds[4] % 2 == 0
    assert None not in kinds and 64 not in kinds and 5 not in kinds
    wanted = {}
    for i, text in rows:
        for w in set((text or "").split()):
            wanted.setdefault(w, [0] * 5)[0] += 1
    texts = {}
    for i, text in rows:
        if i in kinds:
            texts.setdefault(i, []).append(text)
    for i, own in texts.items():
        for w in set(min(t for t in own if t is not None).split()):
            wanted[w][kinds[i]] += 1
    found = {bytes(r["word"]).decode(): [r[c] for c in X.COUNTS] for r in X.vocabulary_of(X.with_labels(documents, learnt)).collect()}
    single = {w: c for w, c in found.items() if w.strip() in wanted and " " not in w.strip()}
    assert {w.strip(): c for w, c in single.items()} == wanted
