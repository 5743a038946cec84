"""Toxicity, HTML extraction and quality rules: held-out accuracy and brute force."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outvote.llm import html_text as H
from outvote.llm import quality_ratio as Q
from outvote.llm.dom import parse
from outvote.llm.html_text import extract, main_texts, sum_product, train
from outvote.llm.kneser_ney import DISCOUNT, UNIFORM, Models, spans_of
from outvote.llm.quality_ratio import judge
from outvote.llm.text_arrays import chunked, texts_of, words_of
from outvote.llm.toxicity import held_out, score, without_toxic

SMALL = "/root/testdata/sf0.01"


# --- toxicity ---------------------------------------------------------------------------


def plain_ratio(vocabulary, order, word):
    """Kneser-Ney from the definition, with dictionaries."""
    top = [Counter(), Counter()]
    strings = set()
    for spelt, counts in vocabulary.items():
        marked = "^" + spelt + "$"
        for i in range(1, len(marked)):
            for k in (0, 1):
                if counts[k]:
                    top[k][marked[max(0, i - order + 1) : i + 1]] += counts[k]
            strings |= {marked[s : i + 1] for s in range(max(0, i - order + 1), i + 1)}
    extended = Counter(s[1:] for s in strings if len(s) > 1)

    def shared(gram):
        if not gram:
            return UNIFORM
        below = shared(gram[1:])
        followers = [n for g, n in extended.items() if g[:-1] == gram[:-1] and g]
        if not followers:
            return below
        return max(extended[gram] - DISCOUNT, 0) / sum(followers) + DISCOUNT * len(followers) / sum(followers) * below

    def own(k, gram):
        followers = [n for g, n in top[k].items() if g[:-1] == gram[:-1]]
        if not followers:
            return shared(gram[1:])
        return max(top[k][gram] - DISCOUNT, 0) / sum(followers) + DISCOUNT * len(followers) / sum(followers) * shared(gram[1:])

    marked = "^" + word + "$"
    grams = [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]
    return sum(np.log(own(1, g)) - np.log(own(0, g)) for g in grams)


def test_models_agree_with_the_definition():
    vocabulary = {"abc": (3, 1), "abd": (0, 2), "bad": (1, 0), "cab": (2, 2), "a": (5, 1), "dabcab": (1, 1)}
    models = Models([w.encode() for w in vocabulary], np.array(list(vocabulary.values()), float), order=4)
    wanted = ["abc", "abd", "zzz", "bad", "a", "abcabd", "dab"]
    texts = texts_of(pa.array([" ".join(wanted)]))
    spans = spans_of(texts)
    found = models.ratios(texts.data, spans.starts, spans.ends)
    assert found == pytest.approx([plain_ratio(vocabulary, 4, w) for w in wanted])


def test_long_runs_are_cut_into_expressions():
    texts = texts_of(pa.array(["x" * 150 + " y", None, "z"]))
    spans = spans_of(texts)
    assert (spans.ends - spans.starts).tolist() == [64, 64, 22, 1, 1] and spans.counts.tolist() == [4, 0, 1]


def planted(make):
    base = "the river rose after days of rain and people began to carry things up the hill where bread was kept warm".split()
    rows = []
    for i in range(600):
        words = [base[(i * 7 + j * j) % len(base)] for j in range(30 + i % 40)]
        if i % 5 == 0:
            words[i % 11] = words[20] = "vileword" + ("s" if i % 2 else "")
        rows.append((i, " ".join(words)))
    return make(rows), [(i, int(i % 5 == 0)) for i in range(600)]


def test_held_out_toxic_documents_are_found(spark, make):
    documents, labels = planted(make)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = score(documents.withColumn("Score", F.lit("mine")).withColumn("a.b", F.lit(1)), labelled).collect()
    label = dict(labels)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["predicted"] == label[r["doc_id"]]
    assert without_toxic(documents, labelled).count() == 480


def test_labels_of_held_out_rows_are_not_learnt_from(spark, make):
    documents, labels = planted(make)
    odd = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    first, second = (score(documents, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, odd))
    values = [sorted((r["doc_id"], r["score"]) for r in df.collect()) for df in (first, second)]
    assert values[0] == values[1]


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 0), (4, 0), (5, 1), (8, 0), (None, 1), (9, None), (6, 0), (12, 1), (7, 1), (10, 0)], "doc_id long, toxic int")
    found = score(odd, labels).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    nothing = labels.filter("false")
    assert {r["score"] for r in score(odd, nothing).collect()} == {0.0}
    assert score(none, labels).count() == 0
    ids = [1, 22, None]
    spread = spark.createDataFrame([(i,) for i in ids], "i long").select(held_out(F.col("i"))).collect()
    assert [r[0] for r in spread] == [zlib.crc32(str("" if i is None else i).encode()) % 3 == 1 for i in ids]


# --- HTML -------------------------------------------------------------------------------


@given(st.integers(1, 7), st.integers(0, 2**32 - 1))
@settings(max_examples=40, deadline=None)
def test_sum_product_gives_exact_marginals(n, seed):
    draw = np.random.default_rng(seed)
    parent = np.array([-1, *(draw.integers(0, i) for i in range(1, n))])
    depth = np.zeros(n, int)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    node, edge = draw.normal(size=(n, 2)), draw.normal(size=(n, 2, 2))
    weight = np.zeros((n, 2))
    pairs = np.zeros((n, 2, 2))
    for bits in range(2**n):
        y = [(bits >> i) & 1 for i in range(n)]
        w = np.exp(sum(node[i, y[i]] for i in range(n)) + sum(edge[i, y[parent[i]], y[i]] for i in range(1, n)))
        for i in range(n):
            weight[i, y[i]] += w
            if i:
                pairs[i, y[parent[i]], y[i]] += w
    found, both = sum_product(node, edge, parent, depth)
    assert found == pytest.approx(weight / weight.sum(1, keepdims=True))
    assert both[1:] == pytest.approx(pairs[1:] / weight[0].sum())


def test_articles_of_the_table_are_extracted_whole(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for r in pages.collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        page = parse(inside)
        assert found[r["page_id"]] == "\n".join(text for _, text in page.segments)


LINE = "Lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor incididunt ut labore."


@pytest.mark.parametrize(
    "html,wanted",
    [
        (f"<div class='cookie-banner'>{LINE}</div><div class=content><h1>Head</h1><p>{LINE}</p><ul><li>one</li></ul><p>tail</p></div>"
         f"<div class=side>{LINE}</div><div class=comments><div>{LINE}</div></div>", f"Head\n{LINE}\none\ntail"),
        (f"<p>Alpha {LINE}<p>Beta<p>Gamma {LINE}", f"Alpha {LINE}\nBeta\nGamma {LINE}"),
        (f"<nav>n</nav><article><h2>H</h2><p>{LINE}</p><aside class=notice>{LINE}</aside><form action=x><p>{LINE}</p></form>"
         f"<section class=comments><article><p>{LINE}</p></article></section></article>", f"H\n{LINE}"),
        (f"<div class=article><h1>Big &amp; small&nbsp;x</h1><p>A&lt;b\n\t {LINE}</p><script>var p='</p>';</script></div>", f"Big & small x\nA<b {LINE}"),
        ("", ""), (None, ""), ("<nav><ul><li><a href=/>Home</a></li></ul></nav>", ""), ("<script>x</script><style>p{}</style><!-- y -->", ""),
    ],
)
def test_layouts(html, wanted):
    assert main_texts(train(), [parse(html)]) == [wanted]


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", deep), (3, "w", "</p></div><b>" * 100), (4, "x", f"<article><p>{LINE * 2000}</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Text", F.lit("mine")).withColumn("a.b", F.lit(1))
    found = extract(df).collect()
    assert len(found) == 6 and found[0].asDict().keys() == {"page_id", "url", "a.b", "text", "n_chars"}
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert max(r["n_chars"] for r in found) == len(LINE) * 2000
    assert extract(df.filter("false")).count() == 0


def test_labelled_pages_are_learnt():
    pages = [parse(html, H.MARK) for html in H.PAGES]
    label = np.array([y for p in pages for y in H._labels(p)])
    assert ((H.marginals(train(), H.forest(pages))[0][:, 1] >= 0.5) == label).all()


# --- quality ----------------------------------------------------------------------------


def test_ratios_equal_brute_force_counts(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    found = Q.log_ratios(documents, trusted)
    good = {r["doc_id"] for r in trusted.collect()}
    corpus, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for r in documents.collect():
        bucket, _ = Q.ngram_buckets(texts_of(pa.array([r["text"]])))
        corpus += np.bincount(bucket, minlength=Q.BUCKETS)
        if r["doc_id"] in good:
            target += np.bincount(bucket, minlength=Q.BUCKETS)
    share = (corpus + 1) / (corpus + 1).sum()
    assert found == pytest.approx(np.log((target + share * Q.BUCKETS) / (target.sum() + Q.BUCKETS) / share))


def test_good_documents_stay_and_junk_goes(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    found = judge(documents, labels).join(labels, "doc_id").filter("not base_failed")
    kept = {(r["quality"], r["kept"]): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) <= 0.01 * kept[1, True] and kept.get((0, True), 0) <= 0.15 * kept[0, False]


def test_quality_of_odd_rows(spark, odd, odd_rows, words, none):
    labels = spark.createDataFrame([(4, 1), (None, 1), (8, 0)], "doc_id long, quality int")
    found = judge(odd.withColumn("KEPT", F.lit(1)).withColumn("a.b", F.lit(1)), labels)
    assert Counter((r["doc_id"], r["n_words"]) for r in found.collect()) == Counter((i, len(words(t))) for i, t in odd_rows)
    assert judge(none, labels).count() == 0
    unlabelled = judge(odd, labels.filter("false")).collect()
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in unlabelled)


def test_a_text_is_scored_alike_in_any_chunk():
    column = [None, "", "a b c " * 50, "only", "d e f g"]
    whole = Q.ngram_buckets(texts_of(pa.array(column)))
    single = [Q.ngram_buckets(texts_of(b.column("text"))) for b in chunked(iter([pa.RecordBatch.from_arrays([pa.array(column)], ["text"])]), limit=1)]
    assert Counter(whole[0].tolist()) == Counter(x for b, _ in single for x in b.tolist())
    assert words_of(texts_of(pa.array(column))).counts.tolist() == [0, 0, 150, 1, 4]
