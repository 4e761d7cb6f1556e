"""Fill-in-the-middle texts, cut where a piecewise-linear learned rank index finds the unit boundaries.

The boundaries of a text's units (lines, by default) are a rising function from rank to offset. It is fitted
by segments of a line each: a segment is widened as long as one slope keeps every boundary within a given
error of the line through the segment's first boundary. A cut at rank r predicts its offset by the segment
that holds r and adds the stored residual, one byte each, which makes it exact whatever the rounding.

The number of units and the two offsets come from the index; the hash that draws the cuts and the form, the
slices, the output and the text rebuilt from it are plain DataFrame expressions.

Defined cases: a null or empty text has no units and stays plain, as does a text that holds one of the marks;
a null id draws as if it were empty text; rows with equal id and text get equal rows; a text of any length is
cut as a whole, its index has at most one segment and one byte for each unit; an empty table gives no rows;
further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import bounded_batches, text_of

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Greatest distance of a boundary from its segment; with rounding a residual still fits one signed byte.
ERROR = 120
#: Units of the first window in which a segment is sought; doubled until the segment ends inside it.
WINDOW = 64


class RankIndex:
    """Exact offsets of ranks 0 to n from error-bounded segments and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR) -> None:
        ranks, slopes, at = [], [], 0
        while at < len(offsets):
            length, slope = widest(offsets, at, error)
            ranks.append(at)
            slopes.append(slope)
            at += length + 1
        self.ranks = np.array(ranks, dtype=np.int64)
        self.slopes = np.array(slopes, dtype=np.float64)
        self.firsts = offsets[self.ranks]
        places = np.arange(len(offsets), dtype=np.int64)
        self.residuals = (offsets - self.predicted(places)).astype(np.int8 if error < 127 else np.int64)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.ranks, ranks, side="right") - 1
        return self.firsts[segment] + np.rint(self.slopes[segment] * (ranks - self.ranks[segment])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.residuals[ranks]


def widest(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """Boundaries after ``at`` that one line through it keeps within ``error``, and its slope."""
    window = WINDOW
    while True:
        stop = min(at + 1 + window, len(offsets))
        steps = np.arange(1, stop - at, dtype=np.float64)
        rise = (offsets[at + 1 : stop] - offsets[at]).astype(np.float64)
        least = np.maximum.accumulate((rise - error) / steps)
        most = np.minimum.accumulate((rise + error) / steps)
        closed = np.flatnonzero(least > most)
        if len(closed) or stop == len(offsets):
            break
        window *= 2
    length = int(closed[0]) if len(closed) else len(steps)
    return length, float((least[length - 1] + most[length - 1]) / 2) if length else 0.0


def line_offsets(text: str) -> np.ndarray:
    """Code points before each line and after the last: 0, ..., length."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return np.concatenate([np.zeros(1, dtype=np.int64), ends.astype(np.int64)])


def cuts(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b in zip(texts, one, two):
        index = RankIndex(line_offsets(text))
        n = len(index.residuals) - 1
        first, second = index.offsets(np.sort(np.array([a % (n + 1), b % (n + 1)], dtype=np.int64))).tolist()
        rows.append((n, first, second, len(index.ranks)))
    return pd.DataFrame(rows, columns=["n", "first", "second", "segments"])


def hash_group(digest: Column, which: int) -> Column:
    """The ``which``-th group of 8 hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * which + 1, 8), 16, 10).cast("long")


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    p, s, m = (F.lit(mark) for mark in MARKS)
    return (
        F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(text)
    )


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form; a marked output holds each mark exactly once."""
    p, s, m = MARKS
    second = F.when(form == "psm", F.instr(output, s)).otherwise(F.instr(output, p))
    third = F.instr(output, m)
    one = F.substring(output, F.lit(len(p) + 1), second - len(p) - 1)
    two = F.substring(output, second + len(s), third - second - len(s))
    rest = F.substring(output, third + len(m), F.length(output))
    return F.when(form == "psm", F.concat(one, rest, two)).when(form == "spm", F.concat(two, rest, one)).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 7,
    marked_per_cent: int = 100,
    spm_per_cent: int = 50,
) -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, segments, output, restored."""
    bounded_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), digest.alias("digest"))
    found = pandas_udf(cuts, "n long, first long, second long, segments int")
    rows = rows.select(
        "id", "text", found("text", hash_group(F.col("digest"), 0), hash_group(F.col("digest"), 1)).alias("cut"),
        (hash_group(F.col("digest"), 2) % 100 < marked_per_cent).alias("marked"),
        (hash_group(F.col("digest"), 3) % 100 < spm_per_cent).alias("spm"),
    )
    text, first, second = F.col("text"), F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    plain = (text == "") | ~F.col("marked")
    for mark in MARKS:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(F.col("spm"), "spm").otherwise("psm")
    rows = rows.select(
        "id", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.segments").alias("segments"),
        F.substring(text, F.lit(1), first).alias("prefix"), F.substring(text, first + 1, second - first).alias("middle"),
        F.substring(text, second + 1, F.length(text)).alias("suffix"), first.alias("first"), (second - first).alias("between"),
    )
    cut_up = F.col("form") != "plain"
    rows = rows.select(
        "id", "n", "form", "segments", F.when(cut_up, F.col("first").cast("long")).alias("prefix_chars"),
        F.when(cut_up, F.col("between").cast("long")).alias("middle_chars"),
        arranged(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text")).alias("output"),
    )
    return rows.select(
        F.col("id").alias(id_column), "n", "form", "prefix_chars", "middle_chars", "segments", "output",
        restored(F.col("output"), F.col("form")).alias("restored"),
    )
