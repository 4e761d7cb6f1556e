"""Token counts of whole texts; huge ones by overlapping windows that are spliced where both sides agree.

A text of up to ``whole`` characters is counted in one go. A longer one becomes windows of ``step``
characters plus an overlap, each a row of its own, so that one huge document is counted by many tasks. A
window reports the tokens in its first and its last overlap that follow white space: no rule of the
tokenizer reaches across white space, so from such a token on both windows must give the same tokens, and
the splice is the first one that both report at the same place with the same id. Texts in which a pair of
windows shares no such token are counted again with wider overlaps, in the end in one go.

Defined cases: a null or empty text has 0 bytes and 0 tokens; every row gives one row, repeated ones and
null ids too; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import bounded_batches, cut, text_of
from minekit.llm.encoder import default_path, encoder

#: Characters up to which a text is counted in one go, of a window without its overlap, and of the overlaps tried in turn.
WHOLE, STEP, OVERLAPS = 65_536, 32_768, (256, 8_192)
#: Ids are below this, so that place and id make one number.
IDS = 1 << 20


def whole_count(path: str):
    @pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        known = encoder(path)
        return pd.Series([len(ids) // 4 for ids in known.ids_of_all(texts)], dtype="int64")

    return count


def edges(text: str, start: int, overlap: int, step: int, path: str) -> tuple:
    """Tokens of one window: how many, and (place and id, index) of the stable ones in its two overlaps."""
    encoding = encoder(path).tokenizer.encode(text, add_special_tokens=False)
    if not encoding.ids:
        return 0, [], [], [], []
    places = np.array([a for a, _ in encoding.offsets], dtype=np.int64)
    ids = np.array(encoding.ids, dtype=np.int64)
    stable = np.array([place > 0 and text[place - 1].isspace() for place in places])
    keys = (places + start) * IDS + ids
    head = np.flatnonzero(stable & (places < overlap))
    tail = np.flatnonzero(stable & (places >= step))
    return len(ids), keys[head].tolist(), head.tolist(), keys[tail].tolist(), tail.tolist()


def window_edges(path: str, overlap: int, step: int):
    @pandas_udf("n long, head_key array<long>, head_at array<long>, tail_key array<long>, tail_at array<long>")
    def run(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = [edges(text, start, overlap, step, path) for text, start in zip(texts, starts)]
        return pd.DataFrame(rows, columns=["n", "head_key", "head_at", "tail_key", "tail_at"])

    return run


def index_of(keys: Column, places: Column, key: Column) -> Column:
    return F.element_at(places, F.array_position(keys, key).cast("int"))


def spliced(huge: DataFrame, overlap: int, step: int, path: str) -> DataFrame:
    """``huge`` has id, text, quick, n_chars; n_tokens is null where a pair of windows has no common stable token."""
    numbers = F.sequence(F.lit(0), (F.ceil(F.col("n_chars") / F.lit(step)) - 1).cast("int"))
    # numbered before the windows are listed, so that all windows of a row share its number
    windows = huge.withColumn("row", F.monotonically_increasing_id()).select(
        "id", "quick", "n_chars", "n_bytes", "row",
        F.explode(F.transform(numbers, lambda i: F.struct(
            i.alias("no"), (i.cast("long") * step).alias("start"), F.substring(F.col("text"), i * step + 1, F.lit(step + overlap)).alias("text"),
        ))).alias("w"),
    ).select("*", "w.*").drop("w")
    told = windows.withColumn("e", window_edges(path, overlap, step)("text", "start")).drop("text")
    order = Window.partitionBy("row").orderBy("no")
    told = told.withColumn("next", F.lead(F.struct("e.head_key", "e.head_at")).over(order))
    told = told.withColumn("splice", F.array_min(F.array_intersect("e.tail_key", "next.head_key")))
    last = F.col("next").isNull()
    told = told.select(
        "*",
        F.when(last, F.col("e.n")).otherwise(index_of(F.col("e.tail_key"), F.col("e.tail_at"), F.col("splice"))).alias("end"),
        F.when(~last, index_of(F.col("next.head_key"), F.col("next.head_at"), F.col("splice"))).alias("begin_of_next"),
        (~last & F.col("splice").isNull()).alias("failed"),
    )
    # end - begin summed over the windows, with every begin taken from the row before
    total = F.sum(F.coalesce(F.col("end"), F.lit(0)) - F.coalesce(F.col("begin_of_next"), F.lit(0)))
    return told.groupBy("row").agg(
        F.first("id").alias("id"), F.first("quick").alias("quick"), F.first("n_chars").alias("n_chars"), F.first("n_bytes").alias("n_bytes"),
        F.when(~F.max("failed"), total).alias("n_tokens"),
    )


def token_counts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str | None = None,
    limit: int = 2048,
    whole: int = WHOLE,
    step: int = STEP,
    overlaps: tuple[int, ...] = OVERLAPS,
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    text = text_of(text_column)
    rows = docs.select(
        F.col(id_column).alias("id"), text.alias("text"), F.length(text).alias("n_chars"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    counted = rows.filter(F.col("n_chars") <= whole).select("id", "n_bytes", whole_count(path)("text").alias("n_tokens"))
    huge = rows.filter(F.col("n_chars") > whole).withColumn("quick", F.xxhash64("text"))
    for overlap in overlaps:
        tried = cut(spliced(huge, min(overlap, step), step, path))
        counted = counted.unionByName(tried.filter(F.col("n_tokens").isNotNull()).select("id", "n_bytes", "n_tokens"))
        left = tried.filter(F.col("n_tokens").isNull()).select("quick", "n_chars").distinct()
        if left.isEmpty():
            break
        huge = huge.join(left, ["quick", "n_chars"], "left_semi")
    else:
        counted = counted.unionByName(huge.select("id", "n_bytes", whole_count(path)("text").alias("n_tokens")))
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
