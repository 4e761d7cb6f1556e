"""Mixing sources to target weights by Pareto order sampling.

The words of the mix are shared among the sources by weight; a source that would exceed ``limit`` times its
size stops there and the excess is shared again. Inside a source each document is expected to be taken e
times: its source's target over its size, or in proportion to a column of weights. The whole part of e is
certain. For the rest p every document draws a random number u from a hash of itself, and documents are
ranked by (u / (1 - u)) / (p / (1 - p)), smallest first, until the words still missing are taken: the sample's
size is fixed, in words, and the document at the border gives only the words that are missing.

The border is found by counting words per band of the ranking, and only the band that holds it is sorted, so
a source with a third of all rows needs no task of its own. Equal rows are counted before anything else and
listed again in strips.

Defined cases: a null text has no words and is taken 0 times; a null source is a source of its own, the last
one; a null id is a value like any other; rows that are equal in id, source and text are told apart by a
number, so that as many of them are taken as the ranking says; equal ranks are settled by id, digest and that
number; texts of any length count whole; a null or negative weight is 0; an empty table gives no rows;
further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from minekit.lineage import number_rows
from minekit.llm.common import cut, text_of

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: Fixed value of the contract: what a word is.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Equal rows that one task lists; rows of a band of the ranking, about, and bands at least.
STRIP, BAND_ROWS, LEAST_BANDS = 10_000, 20_000, 1_024
#: Bits of the random number.
BITS = 52


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(units: DataFrame, weights: tuple[int, ...], share: float, limit: int) -> DataFrame:
    """Per source: source_size, target. Shares by weight, with the excess over ``limit`` sizes shared again."""
    sizes = cut(
        units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")).withColumn("none", F.col("source").isNull())
    )
    place = F.col("place") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    sources = cut(number_rows(sizes, ["none", "source"], name="place").withColumn("weight", weight))
    level, before = 0.0, None
    while True:
        stopped = F.col("source_size") * limit <= F.col("weight") * level
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(stopped, F.col("source_size") * limit).otherwise(0)).alias("full"),
            F.sum(F.when(~stopped, F.col("weight")).otherwise(0)).alias("open"),
            F.count(F.when(~stopped, 1)).alias("n"),
        ).first()
        if not row["n"] or row["n"] == before:
            break
        level, before = (row["total"] * share - row["full"]) / row["open"], row["n"]
    target = F.least((F.col("source_size") * limit).cast("double"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"), F.floor(target + 0.5).alias("words"))


def expected_copies(units: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """``units`` with e: how often each document is expected, at most ``limit`` times, in proportion to its weight.

    Where weights push documents over the limit, the words that they can't give are shared among the others
    of their source, until no further document is stopped.
    """
    known = units.join(sources, units["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    if "weight" not in units.columns:
        return known.withColumn("e", F.when(F.col("source_size") > 0, F.col("words") / F.col("source_size")).otherwise(0.0))
    level, before = cut(sources.select("source", F.lit(0.0).alias("level"))), None
    words = F.col("size") * F.col("copies")
    while True:
        asked = known.join(level, known["source"].eqNullSafe(level["source"])).drop(level["source"])
        stopped = F.col("weight") * F.col("level") >= limit
        sums = asked.groupBy("source").agg(
            F.first("words").alias("words"),
            F.sum(F.when(stopped, words * limit).otherwise(0)).alias("full"),
            F.sum(F.when(~stopped, words * F.col("weight")).otherwise(0)).alias("open"),
            F.first("level").alias("level"),
        )
        n = asked.filter(stopped).count()
        if n == before:
            return asked.withColumn("e", F.least(F.lit(float(limit)), F.col("weight") * F.col("level"))).drop("level")
        before = n
        missing = F.greatest(F.col("words") - F.col("full"), F.lit(0))
        # the level only rises; it stays where no document is left to take more
        level = cut(sums.select("source", F.when(F.col("open") > 0, F.greatest(missing / F.col("open"), "level")).otherwise(F.col("level")).alias("level")))


def listed(units: DataFrame) -> DataFrame:
    """One row per document again, equal ones numbered; many equal ones are listed by several tasks."""
    few = units.filter(F.col("copies") <= STRIP).withColumn("start", F.lit(0).cast("long"))
    many = units.filter(F.col("copies") > STRIP).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(STRIP).cast("long"))))
    many = many.repartition("id", "digest", "start")
    rows = few.unionByName(many)
    last = F.least(F.col("start") + STRIP, F.col("copies")) - 1
    return rows.withColumn("copy", F.explode(F.sequence(F.col("start"), last))).drop("start")


def ranked(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with rank: random odds over inclusion odds; null where nothing is left to chance."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lower(F.hex("digest")), F.col("copy").cast("string"))
    drawn = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, BITS // 4), 16, 10).cast("long")
    u = (drawn + 0.5) / float(1 << BITS)
    odds = F.col("p") / (1 - F.col("p"))
    return rows.withColumn("rank", F.when(F.col("p") > 0, (u / (1 - u)) / odds))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    limit: int = 2,
    weight_column: str | None = None,
    seed: int = 12,
    bands: int | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies (certain whole ones), partial (words beyond)."""
    text = text_of(text_column)
    columns = [
        F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
        word_count(text).alias("size"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    ]
    if weight_column is not None:
        columns.append(F.greatest(F.coalesce(F.col(weight_column).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    rows = docs.select(*columns)
    units = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")))
    sources = cut(source_targets(units, weights, share, limit))
    expected = expected_copies(units, sources, limit).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    # what the whole copies leave of each source's words
    given = expected.groupBy("source").agg(F.sum(F.col("whole") * F.col("size") * F.col("copies")).alias("given"))
    left = cut(
        sources.join(given, sources["source"].eqNullSafe(given["source"])).select(sources["source"], (F.col("words") - F.col("given")).alias("left"))
    )
    pool = ranked(listed(expected), seed)
    total = units.agg(F.sum("copies")).first()[0] or 0
    bands = bands or max(LEAST_BANDS, total // BAND_ROWS)
    pool = cut(pool.withColumn("band", F.floor(F.col("rank") / (1 + F.col("rank")) * bands)))
    # words of each band: at most ``bands`` rows per source
    words = pool.filter(F.col("band").isNotNull()).groupBy("source", "band").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    words = words.withColumn("before", F.coalesce(before, F.lit(0)))
    border = words.join(left, words["source"].eqNullSafe(left["source"])).drop(left["source"])
    border = border.filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("words")))
    border = cut(border.select(F.col("source").alias("of"), F.col("band").alias("border"), (F.col("left") - F.col("before")).alias("room")))
    placed = pool.join(border, F.col("source").eqNullSafe(F.col("of")), "left")
    at_border = F.coalesce(F.col("band") == F.col("border"), F.lit(False))
    # without a border band all that is ranked is needed; what is not ranked has its whole copies alone
    beyond = F.col("band").isNull() | F.coalesce(F.col("band") > F.col("border"), F.lit(False))
    sure = placed.filter(~at_border).withColumn("partial", F.when(beyond, F.lit(0).cast("long")).otherwise(F.col("size")))
    order = Window.partitionBy("source").orderBy("rank", "id", "digest", "copy").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(order), F.lit(0))
    partial = F.greatest(F.least(F.col("size"), F.col("room") - ahead), F.lit(0))
    decided = sure.unionByName(placed.filter(at_border).withColumn("partial", partial))
    return decided.select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("partial")).alias("taken"), F.col("whole").alias("copies"), "partial",
    )
