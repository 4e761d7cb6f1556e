"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. An n-gram binds its letters: the
vectors are rotated by their place in the n-gram and multiplied. A document bundles (adds) the vectors of its
n-grams, a language bundles the unit vectors of its documents, and the cosine of the two decides. Anything that
is no letter counts as one space. The fit takes about ``per_language`` documents of each language, drawn by a
hash of the id.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; of equal cosines the language that
sorts first wins; rows with a null language do not train; repeated rows are scored each; where nothing trains,
every text is ``und``; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import bounded_batches, remainder, text_of

SIZE, GRAM, PER_LANGUAGE = 1024, 3, 1500
#: Documents bundled by one matrix product, n-grams a worker remembers, characters looked at in one step.
GROUP, REMEMBERED, STEP = 48, 40_000, 1 << 18
SPACE = 32


@functools.cache
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([29, code]).choice(np.array([-1, 1], dtype=np.int8), size=SIZE)


def gram_vector(code: int) -> np.ndarray:
    """Letters rotated by their place from the end, then multiplied."""
    out = np.ones(SIZE, dtype=np.int8)
    for place in range(GRAM):
        out = out * np.roll(letter_vector((code >> (21 * place)) & 0x1FFFFF), place)
    return out


class GramVectors:
    """The vectors of the n-grams that a worker has met."""

    def __init__(self) -> None:
        self.row: dict[int, int] = {}
        self.table = np.empty((1024, SIZE), dtype=np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        if len(self.row) + len(codes) > REMEMBERED:
            self.row = {}
        out = []
        for code in codes.tolist():
            at = self.row.get(code)
            if at is None:
                at = self.row[code] = len(self.row)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[at] = gram_vector(code)
            out.append(at)
        return self.table[out]


@functools.cache
def gram_vectors() -> GramVectors:
    return GramVectors()


@functools.cache
def is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams with at least one letter; runs of other characters are one space."""
    codes, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    symbols = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    symbols = np.where(is_letter()[symbols], symbols, SPACE)
    if not (symbols != SPACE).any():
        return codes, counts
    symbols = np.concatenate([[SPACE], symbols, [SPACE]])
    symbols = symbols[np.concatenate([[True], (symbols[1:] != SPACE) | (symbols[:-1] != SPACE)])]
    for at in range(0, max(len(symbols) - GRAM + 1, 0), STEP):
        part = symbols[at : at + STEP + GRAM - 1]
        code = np.zeros(len(part) - GRAM + 1, dtype=np.int64)
        for place in range(GRAM):
            code = (code << 21) | part[place : len(part) - GRAM + 1 + place]
        new, n = np.unique(code, return_counts=True)
        merged, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]), minlength=len(merged)).astype(np.int64)
        codes = merged
    return codes, counts


def bundles(texts: list[str]) -> np.ndarray:
    """One row per text: the sum of its n-gram vectors, scaled to length one; zero without a letter."""
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    for begin in range(0, len(texts), GROUP):
        parts = [grams(t) for t in texts[begin : begin + GROUP]]
        codes = np.unique(np.concatenate([p[0] for p in parts]))
        for low in range(0, len(codes), REMEMBERED // 2):
            own = codes[low : low + REMEMBERED // 2]
            counts = np.zeros((len(parts), len(own)), dtype=np.float32)
            for i, (code, n) in enumerate(parts):
                inside = (code >= own[0]) & (code <= own[-1])
                counts[i, np.searchsorted(own, code[inside])] = n[inside]
            out[begin : begin + len(parts)] += counts @ gram_vectors().rows(own).astype(np.float32)
    length = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def partial_profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sum of unit vectors per language and batch."""
    for batch in batches:
        vectors = bundles(batch["text"].tolist())
        languages = batch["lang"].to_numpy()
        rows = [(x, vectors[languages == x].sum(axis=0, dtype=np.float64).tolist()) for x in sorted(set(languages))]
        yield pd.DataFrame(rows, columns=["lang", "vector"])


def profiles(docs: DataFrame, id_column: str, text_column: str, language_column: str, per_language: int) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, one short vector per language."""
    labelled = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(language_column).alias("lang")
    ).filter((remainder("id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one number per language, so that the draw is made where the texts are read
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = F.element_at(F.from_json(F.lit(json.dumps(sizes)), "map<string,bigint>"), F.col("lang"))
    # a hash decides, so that about ``per_language`` rows of each language are read whatever the table's size
    drawn = labelled.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) * n < F.lit(per_language * 1_000_000))
    parts = drawn.select("lang", "text").mapInPandas(partial_profiles, "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    gathered = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x")
    rows = sorted(gathered.collect(), key=lambda r: r.lang)
    vectors = np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), SIZE)
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    keep = length[:, 0] > 0
    return [r.lang for r, k in zip(rows, keep) if k], (vectors[keep] / length[keep]).astype(np.float32)


def identify(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", per_language: int = PER_LANGUAGE
) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (the cosine, not below 0)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(profiles(docs, id_column, text_column, language_column, per_language))

    def run(texts: pd.Series) -> pd.DataFrame:
        names, prototypes = model.value
        vectors = bundles(texts.tolist())
        if not names:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})
        cosines = vectors @ prototypes.T
        best, lettered = cosines.argmax(axis=1), vectors.any(axis=1)
        return pd.DataFrame({
            "lang_pred": [names[b] if ok else "und" for b, ok in zip(best, lettered)],
            "score": np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), 0).astype("float64"),
        })

    guess = pandas_udf(run, "lang_pred string, score double")
    told = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).select(
        "id", (remainder("id", 4) == 2).alias("held_out"), guess("text").alias("g")
    )
    return told.select(F.col("id").alias(id_column), "held_out", "g.lang_pred", "g.score")
