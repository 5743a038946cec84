"""Operators that keep a table's columns, with extra ones named like everything they make inside."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from outvote.llm import curriculum_mix, jaccard_join, line_dedup, toxicity
from outvote.llm.curriculum_mix import in_training_order, mix
from outvote.llm.jaccard_join import one_of_each
from outvote.llm.line_dedup import dedup_lines
from outvote.llm.toxicity import score, without_toxic

OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def inner_names(module):
    """Every word in quotes that may name a column, and some that need quoting."""
    found = set(re.findall(r"[\"'](\w+)[\"']", Path(module.__file__).read_text()))
    found |= set(re.findall(r"\b(__\w+)=", Path(module.__file__).read_text()))
    kept = {n for n in found if n.lower() not in OWN and not n.isupper()}
    return sorted({n.lower(): n for n in kept}.values()) + ["a.b", "`c`", "key of text", "c0", "c1"]


def with_extras(df, module, made=()):
    names = [n for n in inner_names(module) if n.lower() not in {m.lower() for m in made}]
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in names)), names


def kept_their_values(df, names):
    rows = df.select(*(F.col("`" + n.replace("`", "``") + "`") for n in names)).distinct().collect()
    assert [list(r) for r in rows] == [[f"own {n}" for n in names]]


ROWS = [(i, f"word {i % 7} and a line\nthe same long line for all\nown {i}", f"s{i % 3}") for i in range(40)]


def test_mix_and_training_order(make):
    made = curriculum_mix.MADE
    df, names = with_extras(make(ROWS), curriculum_mix, made)
    mixed = mix(df)
    assert mixed.columns == [*make(ROWS).columns, *names, *made]
    kept_their_values(mixed, names)
    plain = {r["doc_id"]: r["taken"] for r in mix(make(ROWS)).collect()}
    assert {r["doc_id"]: r["taken"] for r in mixed.collect()} == plain
    ordered = in_training_order(mixed, df.columns)
    assert ordered.columns == df.columns
    kept_their_values(ordered, names)
    # the names of the result's columns give way
    assert mix(make(ROWS).withColumn("Source_Size", F.lit("x"))).columns == [*make(ROWS).columns, *made]


def test_line_dedup(make):
    df, names = with_extras(make(ROWS), line_dedup, ["n_lines", "n_dropped"])
    cleaned = dedup_lines(df)
    assert cleaned.columns == [*df.columns, "n_lines", "n_dropped"]
    kept_their_values(cleaned, names)
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {r["doc_id"]: r["text"] for r in dedup_lines(make(ROWS)).collect()}


def test_line_dedup_leaves_no_tables(spark, make):
    before = {t.name for t in spark.catalog.listTables()}
    dedup_lines(make(ROWS)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_one_of_each(make):
    rows = [*ROWS, (50, ROWS[3][1], "s0"), (50, ROWS[3][1], "s0")]
    df, names = with_extras(make(rows), jaccard_join)
    first = one_of_each(df)
    assert first.columns == df.columns
    kept_their_values(first, names)
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(r["doc_id"] for r in one_of_each(make(rows)).collect())


@pytest.fixture(scope="module")
def labelled(spark, make):
    rows = [(i, f"a calm text {i % 5} about trees" if i % 2 else f"zzgrr blarg {i % 5} zzgrr", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 0, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    return make(rows), labels


def test_toxicity(labelled):
    docs, labels = labelled
    df, names = with_extras(docs, toxicity, ["held_out", "score", "predicted"])
    scored = score(df, labels)
    assert scored.columns == [*df.columns, "held_out", "score", "predicted"]
    kept_their_values(scored, names)
    left = without_toxic(df, labels)
    assert left.columns == df.columns
    kept_their_values(left, names)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in scored.filter("predicted = 0").collect()}
    assert without_toxic(df, labels.filter("false")).columns == df.columns


def test_stages_keep_the_columns(spark, labelled):
    docs, _ = labelled
    df, names = with_extras(docs, curriculum_mix)
    df, names = df.withColumns({"n_lines": F.lit("own n_lines"), "N_Dropped": F.lit("own N_Dropped")}), [*names, "n_lines", "N_Dropped"]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        df_out = stage(spark, df, "/root/testdata/sf0.001")
        assert df_out.columns == df.columns, name
        kept_their_values(df_out, names)
