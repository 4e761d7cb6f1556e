"""Licence scan by a trained paragraph classifier, in DataFrame and SQL functions only.

A text is read in segments: its paragraphs, long ones in runs of ``SEGMENT`` words. The features of a segment are
the word pairs and triples that occur in the templates. A multinomial logistic regression, trained on windows of the
templates against notices of made-up licences, paragraphs of the corpus and plain sentences, gives the probability of
every family, of an unknown licence and of none. A segment for which no licence is less likely than some licence gets
the likeliest family, if its probability reaches a level calibrated on windows kept out of the fit and if the templates
confirm it, that is hold n-grams of the segment that no other family has; else it is ``unknown``. A segment most of
which stands in the templates of one family and of no other (its containment) is of that family whatever the classifier
says, with its containment for a probability if that is higher.

Scoring explodes the n-grams that the templates have, joins them with the weights (as many rows as the templates have
n-grams) and sums per segment, so only n-grams of the templates are shuffled.

Defined cases: a null or empty text has no segments and no licence; repeated rows get equal rows, the one that a single
row would get; of families with
equal probability the one named first wins; a null id is kept; an empty table gives no rows, and the fit then rests
on the templates and plain sentences alone; further columns are not read.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from minekit.llm.common import cut, text_of
from minekit.llm.license_templates import NOTICES, PLAIN, TEMPLATES

NONE, UNKNOWN = "none", "unknown"
SEGMENT, WINDOW, STEP = 64, 12, 4
#: Documents of the corpus that give counterexamples, and segments of them, about; the strength of the ridge.
CORPUS_SAMPLE, SEGMENT_SAMPLE, RIDGE = 3_000, 6_000, 1e-3
#: Tasks of the fit, whose rows are a few thousand at any size of the corpus.
FIT_TASKS = 4
#: Prior shares of no licence, an unknown one and the known families, and the total weight of the fit.
PRIORS, WEIGHT = (0.25, 0.25, 0.5), 1_000.0
#: Share of kept-out windows of a licence whose probability may lie under the level.
CALIBRATION = 0.05
#: N-grams of a segment that the templates of the family, and of no other, must hold.
OWN_GRAMS = 2
#: Share of the n-grams of a segment, and their least number, by which the templates of one family alone settle it.
CONTAINED, CONTAINED_GRAMS = 0.4, 5
#: N-grams of licence wording, and of no plain sentence, that an unknown licence must show.
LICENCE_GRAMS = 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Pairs and triples of neighbouring words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    pair = F.transform(at, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    triple = F.transform(at, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    n = F.greatest(F.size(words), F.lit(0))
    return F.concat(F.slice(pair, 1, F.greatest(n - 1, F.lit(0))), F.slice(triple, 1, F.greatest(n - 2, F.lit(0))))


def known_grams_of(words: Column, vocabulary: list[str]) -> Column:
    """The different pairs and triples of ``words`` that the vocabulary holds; strings are built only where its words meet."""
    pairs = [g for g in vocabulary if g.count(" ") == 1]
    triples = [g for g in vocabulary if g.count(" ") == 2]
    starts, nexts = (sorted({p.split(" ")[k] for p in pairs}) for k in (0, 1))

    def pair(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))

    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    near = F.filter(at, lambda i: F.get(words, i).isin(starts) & F.get(words, i + 1).isin(nexts))
    # every pair of a triple of the templates is a pair of theirs
    met = F.filter(near, lambda i: pair(i).isin(pairs))
    longer = F.filter(F.transform(met, lambda i: F.concat_ws(" ", pair(i), F.get(words, i + 2))), lambda t: t.isin(triples))
    return F.array_distinct(F.concat(F.transform(met, pair), longer))


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed rows, as one literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    fields = ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", "))
    literal = F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{fields}>>")
    return spark.range(1).select(F.explode(literal).alias("r")).select("r.*")


def template_rows(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    rows += [(NONE, k, text) for k, text in enumerate(PLAIN)] + [(UNKNOWN, k, text) for k, text in enumerate(NOTICES)]
    return constant(spark, rows, "family string, no int, text string").withColumn("words", words_of(F.col("text"))).drop("text")


def training_windows(templates: DataFrame) -> DataFrame:
    """Each template as a whole and in windows; every fifth window is kept out of the fit."""
    last = F.greatest(F.size("words") - WINDOW, F.lit(0))
    starts = F.array_union(F.array(F.lit(-1)), F.sequence(F.lit(0), last, F.lit(STEP)))
    windows = templates.select("family", "no", "words", F.explode(starts).alias("start"))
    part = F.when(F.col("start") < 0, F.col("words")).otherwise(F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.lit(WINDOW)))
    return windows.select("family", grams_of(part).alias("grams"), (F.pmod(F.xxhash64("no", "start", "family"), F.lit(5)) == 0).alias("kept_out"))


def segments(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, id, quick, paragraph, segment, words) of every paragraph with a word; equal rows have numbers of their own."""
    # outer explodes, and no filter on computed words: Spark would compute the split once more below the filter
    text = text_of(text_column)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), text.alias("text"))
    paragraphs = rows.select("row", "id", F.xxhash64("text").alias("quick"), F.posexplode_outer(F.split("text", r"[\r\n]+")).alias("paragraph", "p"))
    worded = paragraphs.select("row", "id", "quick", "paragraph", words_of(F.col("p")).alias("words"))
    n = F.size("words")
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SEGMENT).cast("int")), lambda i: F.slice(F.col("words"), i * SEGMENT + 1, F.lit(SEGMENT + 2)))
    told = worded.select("row", "id", "quick", "paragraph", F.posexplode_outer(F.when(n > 0, parts)).alias("segment", "words"))
    return told.filter(F.col("words").isNotNull())


def corpus_windows(docs: DataFrame, id_column: str, text_column: str, sample: int) -> DataFrame:
    """About ``SEGMENT_SAMPLE`` segments of about ``sample`` documents, those without the vocabulary of licences, as counterexamples."""
    # hashes decide, so that no task gathers texts from all others; few segments are kept of very long documents
    draw = F.pmod(F.xxhash64(F.col(id_column).cast("string"), text_of(text_column)), F.lit(1_000_000))
    chosen = docs.select(id_column, text_column).filter(draw * docs.count() < sample * 1_000_000)
    parts = cut(segments(chosen, id_column, text_column))
    parts = parts.filter(F.pmod(F.xxhash64("id", "quick", "paragraph", "segment"), F.lit(1_000_000)) * parts.count() < SEGMENT_SAMPLE * 1_000_000)
    legal = F.exists("words", lambda w: w.rlike("licen[cs]|copyright|warrant|redistrib|permi[st]|reserved|spdx|creative|commons"))
    return parts.filter(~legal).select(F.lit(NONE).alias("family"), grams_of(F.col("words")).alias("grams"), F.lit(False).alias("kept_out"))


def fitted(docs: DataFrame, id_column: str, text_column: str, sample: int) -> tuple[DataFrame, list[str], list[float], list[str], float]:
    """Weights per n-gram with the families whose templates hold it, n-grams, intercepts, classes, calibrated level."""
    spark = docs.sparkSession
    templates = template_rows(spark)
    classes = [NONE, UNKNOWN, *TEMPLATES]
    held = templates.select("family", F.explode(grams_of(F.col("words"))).alias("gram")).groupBy("gram").agg(F.sort_array(F.collect_set("family")).alias("families"))
    # as many rows as the fixed templates have n-grams
    grams = {r.gram: r.families for r in held.collect()}
    vocabulary = sorted(grams)
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    rows = training_windows(templates).unionByName(corpus_windows(docs, id_column, text_column, sample))
    rows = counter.transform(rows.withColumn("label", number)).select("family", "label", "features", "kept_out").repartition(FIT_TASKS).cache()
    # every class weighs by its prior, however many windows it has
    share = F.when(F.col("family") == NONE, F.lit(PRIORS[0])).when(F.col("family") == UNKNOWN, F.lit(PRIORS[1])).otherwise(F.lit(PRIORS[2] / len(TEMPLATES)))
    fit_on = rows.filter("not kept_out")
    sizes = fit_on.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    fit_on = fit_on.join(sizes, "label").withColumn("weight", share / F.col("size") * WEIGHT)
    model = LogisticRegression(regParam=RIDGE, family="multinomial", maxIter=60, weightCol="weight").fit(fit_on)
    checked = model.transform(rows.filter(F.col("kept_out") & ~F.col("family").isin(NONE, UNKNOWN)))
    likely = sorted(float(max(r.probability)) for r in checked.filter("prediction = label").select("probability").collect())
    level = min(likely[int(len(likely) * CALIBRATION)] if likely else 0.5, 0.5)
    rows.unpersist()
    matrix = model.coefficientMatrix.toArray()
    weights = [(gram, [float(w) for w in matrix[:, k]], grams[gram]) for k, gram in enumerate(vocabulary)]
    table = constant(spark, weights, "gram string, weights array<double>, families array<string>")
    return table, vocabulary, [float(b) for b in model.interceptVector.toArray()], classes, level


def licence_segments(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = CORPUS_SAMPLE) -> DataFrame:
    """(row, id, quick, paragraph, segment, family, probability, containment) of the segments that hold a licence, known or not.

    ``row`` only tells equal rows apart, so that their n-grams are not added up.
    """
    weights, vocabulary, intercepts, classes, level = fitted(docs, id_column, text_column, sample)
    parts = segments(docs, id_column, text_column)
    # the last segment words reach two words into the next one, so that no n-gram is cut
    n_grams = F.greatest(2 * F.size("words") - 3, F.lit(1)).alias("n_grams")
    grams = parts.select("row", "id", "quick", "paragraph", "segment", n_grams, F.explode_outer(known_grams_of(F.col("words"), vocabulary)).alias("gram"))
    # the weights are as many as the templates' n-grams, whatever the corpus
    met = grams.join(F.broadcast(weights), "gram")
    sums = [F.sum(F.col("weights")[k]).alias(f"w{k}") for k in range(len(classes))]
    wording = F.sum((~F.array_contains("families", NONE)).cast("int")).alias("wording")
    counts = [F.sum((F.col("families") == F.array(F.lit(c))).cast("int")).alias(f"c{k}") for k, c in enumerate(classes)]
    summed = met.groupBy("row", "id", "quick", "paragraph", "segment", "n_grams").agg(*sums, *counts, wording)
    raw = F.array(*[F.col(f"w{k}") + F.lit(b) for k, b in enumerate(intercepts)])
    scored = summed.withColumn("raw", raw).withColumn("top", F.array_max("raw"))
    scored = scored.withColumn("e", F.transform("raw", lambda x: F.exp(x - F.col("top"))))
    scored = scored.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    scored = scored.withColumn("p", F.transform("e", lambda x: x / F.col("total"))).withColumn("best", F.array_max(F.slice("p", 3, len(classes) - 2)))
    scored = scored.withColumn("own", F.array(*[F.col(f"c{k}") for k in range(2, len(classes))])).withColumn("most", F.array_max("own"))
    scored = scored.withColumn("containment", F.col("most") / F.col("n_grams"))
    scored = scored.withColumn("contained", (F.col("containment") >= CONTAINED) & (F.col("most") >= CONTAINED_GRAMS))
    likeliest = F.array_position(F.slice("p", 3, len(classes) - 2), F.col("best"))
    found = scored.filter((F.col("p")[0] < 0.5) | F.col("contained"))
    found = found.withColumn("k", F.when(F.col("contained"), F.array_position("own", F.col("most"))).otherwise(likeliest).cast("int"))
    family = F.element_at(F.array(*[F.lit(c) for c in classes[2:]]), F.col("k"))
    known = F.col("contained") | ((F.col("best") >= level) & (F.col("best") >= F.col("p")[1]) & (F.element_at("own", F.col("k")) >= OWN_GRAMS))
    found = found.filter(known | (F.col("wording") >= LICENCE_GRAMS))
    probability = F.when(F.col("contained"), F.greatest(F.element_at("p", F.col("k") + 2), "containment")).otherwise(F.col("best"))
    return found.select(
        "row", "id", "quick", "paragraph", "segment", F.when(known, family).otherwise(F.lit(UNKNOWN)).alias("family"),
        F.when(known, probability).otherwise(1 - F.col("p")[0]).alias("probability"), "containment",
    )


def licence_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = CORPUS_SAMPLE) -> DataFrame:
    """One row per document: id, license (the likeliest, a known one before unknown, or none), probability, licenses, n_segments."""
    found = licence_segments(docs, id_column, text_column, sample)
    best = F.max(F.struct((F.col("family") != UNKNOWN).alias("known"), "probability", F.col("family").alias("family")))
    told = found.groupBy("id", "quick").agg(
        best.alias("best"), F.sort_array(F.collect_set("family")).alias("licenses"),
        F.count_distinct("paragraph", "segment").alias("n_segments"),
    )
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_of(text_column)).alias("quick"))
    same = F.col("d.id").eqNullSafe(F.col("t.id")) & (F.col("d.quick") == F.col("t.quick"))
    return rows.alias("d").join(told.alias("t"), same, "left").select(
        F.col("d.id").alias(id_column), F.coalesce("t.best.family", F.lit(NONE)).alias("license"), F.coalesce("t.best.probability", F.lit(0.0)).alias("probability"),
        F.coalesce("t.licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("t.n_segments", F.lit(0)).cast("long").alias("n_segments"),
    )
