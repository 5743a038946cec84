"""Toxicity of whole texts from class-conditional Kneser-Ney models.

Labelled texts outside the held-out third give the counts of expressions under either class
(kneser_ney.py). A text is then described by its length-normalised difference of toxic and
ordinary log-likelihood, the differences of its most telling expressions and the normalised
part of what is clearly toxic; a logistic curve over these gives the score. The curve is
fitted on scores by models that have not seen the text (two folds).

The counts come from every labelled document outside the held-out third and grow with the
table. Expressions of all documents and the byte strings in them are tables; strings whose
contexts end alike are one group, which has all that their probabilities need apart from
strings of up to three bytes. Their log ratios are joined back to expressions, and those of
expressions to texts; of either, the HOT_ROWS most frequent are broadcast. Only the curve's
seven weights are fitted on a sample: TOXIC_ROWS and ORDINARY_ROWS labelled documents, those
with the least md5 of their id, weighed by their class's true share. Equal texts are scored
once.

Nulls and ties: a null or empty text has no expressions and gets the curve's value for
that; a null id counts as empty text and is not held out; labels other than 0 and 1 are
passed over, of several for an id the highest holds, and of several texts for an id the
least is learnt from. Repeated rows are scored each. Without labels of both classes every
score is 0. Input columns named like the result's give way."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outvote.llm.columns import Beside, named, needed
from outvote.llm.kneser_ney import PART_BYTES, Lookup, grams_of, part_ratios, short_strings, spans_of
from outvote.llm.text_arrays import Texts, chunked, span_hashes, texts_of
from outvote.staging import discard, stage

#: Labelled documents that the curve is fitted on, at most.
TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000
#: Labels that are broadcast to the documents (16 bytes each); more are joined by shuffle.
LABEL_ROWS = 1_000_000
#: Frequent strings or expressions whose ratios are broadcast (32 bytes each); others are joined.
HOT_ROWS = 400_000
#: Strings whose probabilities are worked out in one group.
PART_ROWS = 20_000
REJECT = 0.7
#: A difference of log-likelihoods from which an expression is clearly toxic.
CLEAR = 3.0
FEATURES = 6
#: Texts with an expression: all, and by fold and class (ordinary, toxic) those learnt from.
COUNTS = ["n", "c00", "c01", "c10", "c11"]
#: Log ratios in the models.
RATIOS = ["r0", "r1", "r2"]


def held_out(id_col: Column) -> Column:
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 3 == 1


@dataclass
class Curve:
    """A logistic curve over standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.centre) / self.scale, -20, 20)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -50, 50)))


def fit_curve(features: np.ndarray, label: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> Curve:
    """Newton steps, halved until the penalised likelihood grows."""
    centre, scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack((np.ones(len(label)), np.clip((features - centre) / scale, -20, 20)))
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - label * z) + b @ ridge @ b / 2)

    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        gradient = x.T @ (weight * (p - label)) + ridge @ b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        size, now = 1.0, loss(b)
        while size > 1e-6 and loss(b - size * step) > now:
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return Curve(centre, scale, b)


def _lower(column: pa.Array) -> Texts:
    return texts_of(pc.utf8_lower(column.cast(pa.large_string())))


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct expressions of a chunk of texts; in how many texts each is, in all and as
    learnt from by fold and class."""
    for batch in chunked(batches):
        texts = _lower(batch.column("text"))
        spans = spans_of(texts)
        if not len(spans.starts):
            continue
        hashes = span_hashes(texts.data, spans.starts, spans.ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        pairs = np.unique(spans.text * len(first) + which)
        text, word = pairs // len(first), pairs % len(first)
        kind = pc.fill_null(batch.column("kind"), 0).to_numpy()[text]
        alone = batch.column("alone").to_numpy(zero_copy_only=False)[text]
        # column 0 is for all documents, the others for those learnt from
        counts = np.stack([np.bincount(word[~alone if k == 0 else kind == k], minlength=len(first)) for k in range(len(COUNTS))], 1)
        words = [texts.data[a:b].tobytes() for a, b in zip(spans.starts[first], spans.ends[first])]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *map(pa.array, counts.T.copy())], ["word", *COUNTS])


def _spelt(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of byte strings, each one's begin and end."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds[:-1] - bounds[0], bounds[1:] - bounds[0]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest strings in the expressions, with the sums of their counts; n is expressions."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, begin, end, word = grams_of(*_spelt(batch.column("word")))
        _, first, which = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        counts = [np.bincount(which)]
        counts += [np.bincount(which, batch.column(c).to_numpy()[word]).astype(np.int64) for c in COUNTS[1:]]
        strings = [data[a:b].tobytes() for a, b in zip(begin[first], end[first])]
        yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), *map(pa.array, counts)], ["gram", *COUNTS])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends of 2 to PART_BYTES + 1 bytes of the strings; in which models' texts each is."""
    for batch in batches:
        found: dict[bytes, int] = {}
        columns = (batch.column(c).to_pylist() for c in ("gram", "models"))
        for gram, models in zip(*columns):
            for size in range(2, min(len(gram), PART_BYTES + 1) + 1):
                found[gram[-size:]] = found.get(gram[-size:], 0) | models
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(found.values(), pa.int32())], ["string", "models"])


@dataclass
class Frequent:
    """The most frequent rows of a table of (key, n, values): at most HOT_ROWS, all with n from
    `least` on. Others are found by a join."""

    least: int
    lookup: Lookup

    @staticmethod
    def of(table: DataFrame, key: str, values: list[str]) -> Frequent:
        # some hundreds of rows
        level = F.floor(F.log2(F.col("n")) * 8)
        levels = sorted(((r["level"], r["count"]) for r in table.groupBy(level.alias("level")).count().collect()), reverse=True)
        total, lowest = 0, None
        for value, count in levels:
            total += count
            if total > HOT_ROWS:
                break
            lowest = value
        if lowest is None:
            return Frequent(1 << 62, Lookup(np.zeros(0, np.uint64), np.zeros((0, len(values)))))
        hot = table.filter(level >= lowest)
        least = hot.agg(F.min("n")).first()[0]
        rows = hot.select(key, *values).toArrow()
        table = np.column_stack([rows.column(v).to_numpy() for v in values])
        return Frequent(least, Lookup.of(rows.column(key).to_numpy().view(np.uint64), table))


def _ragged(of: np.ndarray, values: np.ndarray, size: int, kind: pa.DataType) -> pa.Array:
    """Lists by ascending row numbers `of`."""
    bounds = np.searchsorted(of, np.arange(size + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def _joined_sums(spelt: DataFrame, ratios: DataFrame, least: int) -> DataFrame:
    """Rows of spelt (h, n, r0.., rest: array of keys) with what the rest adds. Its terms are
    added in one order always."""
    rest = spelt.select("h", F.explode("rest").alias("g")).join(ratios.filter(F.col("n") < least).drop("n"), "g")
    terms = rest.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("g", *RATIOS))).alias("terms"))
    both = spelt.drop("rest").join(terms, "h", "left")
    added = [F.expr(f"{r} + coalesce(aggregate(terms.{r}, 0D, (a, x) -> a + x), 0D)").alias(r) for r in RATIOS]
    return both.select("h", "n", *added)


def expression_ratios(vocabulary: DataFrame) -> DataFrame:
    """vocabulary: word and COUNTS. Returns h (an expression's hash), n, and the log ratio of
    its probabilities in each model: models 0 and 1 have not seen their fold, 2 has seen all."""
    spark = vocabulary.sparkSession
    schema = "gram binary, " + ", ".join(f"{c} long" for c in COUNTS)
    grams = vocabulary.mapInArrow(_grams, schema).groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))
    grams = stage(grams, "toxic-strings")
    models = F.expr("int(if(c10 + c11 > 0, 1, 0) + if(c00 + c01 > 0, 2, 0))").alias("models")
    ends = grams.select("gram", models).filter("models > 0").mapInArrow(_short, "string binary, models int")
    ends = ends.groupBy("string").agg(F.bit_or("models").alias("models"))
    seen = [F.sum(F.expr(e).cast("long")).alias(r) for r, e in zip(RATIOS, ("models & 1", "int(models & 2) div 2", "1"))]
    extended = ends.groupBy(F.expr("substring(string, 2)").alias("string")).agg(*seen)
    # strings of up to three bytes: their number does not grow with the table for long
    rows = extended.orderBy("string").toArrow()
    values = np.column_stack([rows.column(r).to_numpy() for r in RATIOS]).astype(float)
    # counts, in four bytes each: an executor keeps a copy on disk until its memory is cleaned
    tables = short_strings(rows.column("string").to_pylist(), values)
    short = spark.sparkContext.broadcast([(t.keys, t.values.astype(np.float32)) for t in tables])
    del rows, values, tables

    def rate(table: pa.Table) -> pa.Table:
        spelt = table.column("gram").to_pylist()
        c00, c01, c10, c11 = (table.column(c).to_numpy() for c in COUNTS[1:])
        learnt = [np.stack(c, 1).astype(float) for c in ((c10, c11), (c00, c01), (c00 + c10, c01 + c11))]
        tables = tuple(Lookup(keys, values.astype(float)) for keys, values in short.value)
        found = [part_ratios(spelt, counts, tables, m) for m, counts in enumerate(learnt)]
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        ends = np.cumsum(lengths)
        keys = span_hashes(np.frombuffer(b"".join(spelt), np.uint8), ends - lengths, ends).view(np.int64)
        return pa.table([pa.array(keys), table.column("n"), *map(pa.array, found)], ["g", "n", *RATIOS])

    parts = max(256, grams.count() // PART_ROWS)
    context = F.expr(f"substring(gram, greatest(length(gram) - {PART_BYTES}, 1), least(length(gram) - 1, {PART_BYTES}))")
    dealt = grams.groupBy(F.pmod(F.xxhash64(context), F.lit(parts)).alias("part"))
    values = ", ".join(f"{r} double" for r in RATIOS)
    # a string whose context no model knows has the ratio 0
    ratios = stage(dealt.applyInArrow(rate, f"g long, n long, {values}").filter("r0 != 0 or r1 != 0 or r2 != 0"), "toxic-string-ratios")
    short.destroy()
    discard(grams)
    frequent = Frequent.of(ratios, "g", RATIOS)
    shipped = spark.sparkContext.broadcast((frequent.lookup.keys, frequent.lookup.values))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*shipped.value)
        for batch in batches:
            spelt = _spelt(batch.column("word"))
            data, begin, end, word = grams_of(*spelt)
            keys = span_hashes(data, begin, end)
            hit, values = lookup.find(keys)
            sums = [np.bincount(word, v, batch.num_rows).astype(float) for v in values.T]
            rest = _ragged(word[~hit], keys[~hit].view(np.int64), batch.num_rows, pa.int64())
            hashes = pa.array(span_hashes(*spelt).view(np.int64))
            yield pa.RecordBatch.from_arrays([hashes, batch.column("n"), *map(pa.array, sums), rest], ["h", "n", *RATIOS, "rest"])

    spelt = stage(vocabulary.mapInArrow(add, f"h long, n long, {values}, rest array<long>"), "toxic-expressions")
    shipped.destroy()
    found = stage(_joined_sums(spelt, ratios, frequent.least), "toxic-expression-ratios")
    discard(spelt, ratios)
    return found


def describe(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """texts: key, model, text; rows of one key have one text. Returns the features of each
    (key, model)."""
    frequent = Frequent.of(ratios, "h", RATIOS)
    shipped = texts.sparkSession.sparkContext.broadcast((frequent.lookup.keys, frequent.lookup.values))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*shipped.value)
        for batch in chunked(batches):
            texts = _lower(batch.column("text"))
            spans, size = spans_of(texts), len(texts)
            hashes = span_hashes(texts.data, spans.starts, spans.ends)
            keys, which = np.unique(hashes, return_inverse=True)
            # the distinct expressions of each text, with how often it has them
            pairs, times = np.unique(spans.text * max(len(keys), 1) + which, return_counts=True)
            text, of = pairs // max(len(keys), 1), pairs % max(len(keys), 1)
            hit, values = lookup.find(keys)
            ratio = values[of, batch.column("model").to_numpy()[text]]
            found = hit[of]
            total = np.bincount(text[found], (ratio * times)[found], size).astype(float)
            clear = np.bincount(text[found], (np.where(ratio > CLEAR, ratio, 0) * times)[found], size).astype(float)
            order = np.lexsort((-ratio[found], text[found]))
            row, best = text[found][order], ratio[found][order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < 3
            columns = [batch.column("key"), batch.column("model"), pa.array(spans.counts.astype(np.int64)), pa.array(total), pa.array(clear)]
            columns += [
                _ragged(row[top], best[top], size, pa.float64()),
                _ragged(text[~found], keys[of[~found]].view(np.int64), size, pa.int64()),
                _ragged(text[~found], times[~found], size, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "model", "count", "total", "clear", "top", "rest", "times"])

    schema = "key string, model int, count long, total double, clear double, top array<double>, rest array<long>, times array<long>"
    own = F.struct("count", "total", "clear", "top", "rest", "times")
    found = texts.mapInArrow(look_up, schema).groupBy("key", "model").agg(F.first(own).alias("own"))
    found = stage(found.select("key", "model", "own.*"), "toxic-texts")
    shipped.destroy()
    rest = found.select("key", "model", F.explode(F.arrays_zip("rest", "times")).alias("e")).select("key", "model", F.col("e.rest").alias("h"), F.col("e.times").alias("times"))
    rare = ratios.filter(F.col("n") < frequent.least).drop("n")
    ratio = F.expr("CASE model WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END").alias("r")
    terms = rest.join(rare, "h").select("key", "model", ratio, "times")
    terms = terms.groupBy("key", "model").agg(F.sort_array(F.collect_list(F.struct("r", "times")), asc=False).alias("terms"))
    terms = terms.select(
        "key",
        "model",
        F.expr("aggregate(terms, 0D, (a, x) -> a + x.r * x.times)").alias("more"),
        F.expr(f"aggregate(terms, 0D, (a, x) -> a + if(x.r > {CLEAR}, x.r * x.times, 0D))").alias("more_clear"),
        F.expr("slice(terms.r, 1, 3)").alias("others"),
    )
    both = found.drop("rest", "times").join(terms, ["key", "model"], "left")
    top = F.sort_array(F.concat("top", F.coalesce("others", F.array().cast("array<double>"))), asc=False)
    length = F.greatest(F.col("count"), F.lit(1))
    return both.withColumn("top", top).select(
        "key",
        "model",
        ((F.col("total") + F.coalesce("more", F.lit(0.0))) / length).alias("f0"),
        *(F.coalesce(F.get("top", F.lit(k)), F.lit(0.0)).alias(f"f{k + 1}") for k in range(3)),
        F.log1p(F.col("count").cast("double")).alias("f4"),
        ((F.col("clear") + F.coalesce("more_clear", F.lit(0.0))) / length).alias("f5"),
    )


def learnt_from(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, fold and times (documents of that id) of every label that is learnt from:
    it is 0 or 1, has a document, and that one is not held out. Staged; texts do not travel."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = documents.select("doc_id").join(usable, "doc_id").groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("times"))
    return stage(found.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "toxic-labels")


def with_labels(documents: DataFrame, learnt: DataFrame) -> DataFrame:
    """text, kind (of a text that is learnt from: 1 + 2 x fold + class) and alone: the row is there
    for its kind only. Of several texts for an id the least is learnt from."""
    kind = F.expr("1 + 2 * fold + toxic").alias("kind")
    once, several = learnt.filter("times = 1").select("doc_id", kind), learnt.filter("times > 1").select("doc_id", kind)
    if learnt.count() <= LABEL_ROWS:
        once, several = F.broadcast(once), F.broadcast(several)  # else texts travel to their labels
    rows = documents.join(once, "doc_id", "left").select("text", "kind", F.lit(False).alias("alone"))
    if several.isEmpty():
        return rows
    least = documents.join(several, "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    return rows.unionAll(least.select("text", "kind", F.lit(True).alias("alone")))


def vocabulary_of(marked: DataFrame) -> DataFrame:
    """Every expression of the documents; in how many of them, and of those learnt from."""
    words = marked.mapInArrow(_expressions, "word binary, " + ", ".join(f"{c} long" for c in COUNTS))
    return stage(words.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)), "toxic-vocabulary")


def _text_key(text: Column) -> Column:
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def text_scores(documents: DataFrame, labels: DataFrame) -> DataFrame | None:
    """documents: doc_id, text. labels: doc_id, toxic. Returns the score of each distinct text
    by its key; nothing without labels of both classes."""
    learnt = learnt_from(documents, labels)
    totals = {(r["fold"], r["toxic"]): r["count"] for r in learnt.groupBy("fold", "toxic").count().collect()}  # four rows
    of_class = [sum(n for (_, toxic), n in totals.items() if toxic == k) for k in (0, 1)]
    if not all(of_class):
        return None
    vocabulary = vocabulary_of(with_labels(documents, learnt))
    # only the curve is fitted on a sample; a fold without one of the classes tells nothing
    apart = [f if all(totals.get((1 - f, k)) for k in (0, 1)) else 2 for f in (0, 1)]
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = [learnt.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    model = F.when(F.col("fold") == 0, F.lit(apart[0])).otherwise(F.lit(apart[1])).alias("model")
    ids = stage(chosen[0].unionByName(chosen[1]).select("doc_id", "toxic", model), "toxic-sample-ids")
    # a few thousand ids; of several texts for one the least
    texts = documents.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "model").agg(F.min("text").alias("text"))
    sample = stage(texts.select(_text_key(F.col("text")).alias("key"), "model", "text", "toxic"), "toxic-sample")
    discard(learnt, ids)
    ratios = expression_ratios(vocabulary)
    discard(vocabulary)
    every = documents.select(_text_key(F.col("text")).alias("key"), F.lit(2).alias("model"), "text")
    features = [f"f{k}" for k in range(FEATURES)]
    described = stage(describe(every.unionByName(sample.select("key", "model", "text")), ratios), "toxic-features")
    # a row for each of the sample
    rows = described.join(F.broadcast(sample.select("key", "model", "toxic")), ["key", "model"]).toPandas()
    rows = rows.sort_values(["key", "model", "toxic"])
    label = rows["toxic"].to_numpy()
    share = np.array([of_class[k] / max(1, int((label == k).sum())) for k in (0, 1)])
    curve = fit_curve(rows[features].to_numpy(), label, share[label] * len(label) / sum(of_class))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(f).to_numpy() for f in features])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(curve(values))], ["key", "score"])

    return described.filter("model = 2").select("key", *features).mapInArrow(rate, "key string, score double")


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with held_out, score (0 to 1) and predicted (1 from REJECT on)."""
    made = ["held_out", "score", "predicted"]
    scores = text_scores(needed(documents, doc_id=id_col, text=text_col), needed(labels, doc_id="doc_id", toxic="toxic"))
    rows = Beside(documents, __key=_text_key(named(text_col)), __held_out=held_out(named(id_col)))
    if scores is None:
        scored = rows.df.withColumn("__score", F.lit(0.0))
    else:
        scored = rows.df.join(scores.select(F.col("key").alias("__key"), F.col("score").alias("__score")), "__key")
    return scored.select(
        *rows.others(made),
        F.col("__held_out").alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= REJECT).cast("int").alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    scores = text_scores(needed(documents, doc_id="doc_id", text="text"), needed(labels, doc_id="doc_id", toxic="toxic"))
    if scores is None:
        return documents
    rejected = stage(scores.filter(F.col("score") >= REJECT).select(F.unhex("key").alias("__key")), "toxic-rejected")
    if rejected.count() <= LABEL_ROWS:
        rejected = F.broadcast(rejected)  # else texts travel to their verdicts
    rows = Beside(documents, __key=F.unhex(_text_key(F.col("text"))))
    return rows.df.join(rejected, "__key", "left_anti").select(*rows.others())
