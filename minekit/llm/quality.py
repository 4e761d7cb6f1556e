"""A factorisation machine that scores the quality of whole texts.

The inputs of a text are its hashed words, with weights that have length one together, and a few statistics
of its structure and of the row's metadata (the stated length). The machine adds a linear term and all pairwise
interactions, whose weights are products of low-rank factors; the sum over pairs is taken in linear time as half
the square of the sum less the sum of squares. It is fitted by Adam on a bounded sample of labelled rows, drawn
by a hash of the id; everything else is scored in tasks.

Defined cases: a null or empty text has no words and all statistics at zero, and is scored like any other; a
null length counts as the text's own; rows without a label, or with several that differ evenly, do not train;
repeated ids train once; without any usable label, or with one class only, every score is the share of label 1
(one half without any); an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import bounded_batches, fresh, remainder, text_of
from minekit.llm.words import held

#: Slots of hashed words, rank of the factors, labelled rows at most in the fit, and the score from which a text is good.
SLOTS, RANK, SAMPLE, GOOD = 1 << 14, 8, 6_000, 0.3
#: Passes over the sample, and steps at least, so that a small sample is fitted as long as a large one.
EPOCHS, STEPS, BATCH, RATE, SHRINK = 12, 1_000, 64, 0.02, 2e-3
REMEMBERED = 500_000
LINE_END = re.compile(r"\n+")
STATISTICS = (
    "log characters", "log words", "log lines", "letters per word", "distinct words", "most frequent word", "words next to themselves",
    "distinct word pairs", "upper case", "digits", "white space", "exclamation marks", "bars", "symbols", "sentence ends", "commas",
    "distinct lines", "words per line", "further bytes", "log stated characters",
)


def known_words() -> dict[str, int]:
    return held("numbers of words", dict)


def word_numbers(text: str) -> np.ndarray:
    import xxhash

    known, out = known_words(), []
    if len(known) > REMEMBERED:
        known.clear()
    for word in text.lower().split():
        number = known.get(word)
        if number is None:
            number = known[word] = xxhash.xxh3_64_intdigest(word) >> 1
        out.append(number)
    return np.array(out, dtype=np.int64)


def features(text: str, stated: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and weights of the hashed words, and the statistics in the order of ``STATISTICS``."""
    data = text.encode()
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size, numbers = max(len(data), 1), word_numbers(text)
    n = max(len(numbers), 1)
    distinct, times = np.unique(numbers, return_counts=True)
    lines = [line for line in LINE_END.split(text) if line]
    pairs = numbers[1:] * 31 + numbers[:-1]

    def share(symbols: str) -> float:
        return float(count[[ord(c) for c in symbols]].sum()) / size

    statistics = np.array([
        np.log1p(len(text)), np.log1p(len(numbers)), np.log1p(len(lines)), min(len(text) / n, 40.0),
        len(distinct) / n, float(times.max()) / n if len(times) else 0.0, float((numbers[1:] == numbers[:-1]).sum()) / n,
        len(np.unique(pairs)) / max(len(pairs), 1),
        float(count[65:91].sum()) / size, float(count[48:58].sum()) / size, share(" \t\n\r"), share("!"), share("|"),
        share("#$%&*@^~<>{}[]\\=+_/"), share(".?"), share(","), len(set(lines)) / max(len(lines), 1),
        np.log1p(len(numbers) / max(len(lines), 1)), float(count[128:].sum()) / size, np.log1p(max(stated, 0.0)),
    ], dtype=np.float32)
    slots, where = np.unique(distinct % SLOTS, return_inverse=True)
    weights = np.bincount(where, np.log1p(times), minlength=len(slots)).astype(np.float32)
    length = float(np.sqrt((weights**2).sum()))
    return slots, weights / length if length else weights, statistics


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def inputs(self, slots: np.ndarray, weights: np.ndarray, statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((statistics - self.mean) / self.spread, -4, 4) / np.sqrt(len(statistics))
        return np.concatenate([slots, SLOTS + np.arange(len(statistics))]), np.concatenate([weights, scaled]).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        products = self.factors[at] * x[:, None]
        total = products.sum(axis=0)
        return self.bias + float(self.linear[at] @ x) + 0.5 * float((total**2).sum() - (products**2).sum())

    def score(self, text: str, stated: float) -> float:
        raw = self.raw(*self.inputs(*features(text, stated)))
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss, Adam, the same order of rows whatever the run."""
    k = len(STATISTICS)
    share = float(labels.mean()) if len(labels) else 0.5
    machine = Machine(0.0, np.zeros(SLOTS + k), np.zeros((SLOTS + k, RANK)), np.zeros(k), np.ones(k))
    if share in (0.0, 1.0) or not len(labels):
        machine.bias = {0.0: -30.0, 1.0: 30.0}.get(share, 0.0)
        return machine
    table = np.stack([r[2] for r in rows])
    machine.mean, machine.spread = table.mean(axis=0), table.std(axis=0) + 1e-3
    machine.bias = float(np.log(share / (1 - share)))
    inputs = [machine.inputs(*r) for r in rows]
    rng = np.random.default_rng(11)
    machine.factors = rng.normal(0, 0.05, size=machine.factors.shape)
    state = [np.zeros_like(machine.linear), np.zeros_like(machine.linear), np.zeros_like(machine.factors), np.zeros_like(machine.factors)]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            at = np.concatenate([inputs[i][0] for i in batch])
            x = np.concatenate([inputs[i][1] for i in batch])
            ends = np.cumsum([len(inputs[i][0]) for i in batch])
            starts = np.concatenate([[0], ends[:-1]])
            products = machine.factors[at] * x[:, None]
            totals = np.add.reduceat(products, starts)
            squares = np.add.reduceat(products**2, starts)
            raw = machine.bias + np.add.reduceat(machine.linear[at] * x, starts) + 0.5 * (totals**2 - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) / len(batch)
            each = np.repeat(error, ends - starts)
            touched, where = np.unique(at, return_inverse=True)
            g_linear = np.bincount(where, each * x) + SHRINK * machine.linear[touched] / len(batch)
            g_each = each[:, None] * x[:, None] * (np.repeat(totals, ends - starts, axis=0) - products)
            g_factors = np.stack([np.bincount(where, g_each[:, f]) for f in range(RANK)], axis=1) + SHRINK * machine.factors[touched] / len(batch)
            step += 1
            machine.bias -= RATE * float(error.sum())
            for values, grad, first, second in ((machine.linear, g_linear, *state[:2]), (machine.factors, g_factors, *state[2:])):
                first[touched] = 0.9 * first[touched] + 0.1 * grad
                second[touched] = 0.999 * second[touched] + 0.001 * grad**2
                values[touched] -= RATE * (first[touched] / (1 - 0.9**step)) / (np.sqrt(second[touched] / (1 - 0.999**step)) + 1e-8)
    return machine


def extracted(texts: pd.Series, stated: pd.Series) -> pd.DataFrame:
    rows = [features(text, s) for text, s in zip(texts, stated)]
    packed = [(a.astype("<i4").tobytes(), b.astype("<f4").tobytes(), c.astype("<f4").tobytes()) for a, b, c in rows]
    return pd.DataFrame(packed, columns=["slots", "weights", "statistics"])


def stated_length(docs: DataFrame, text: Column, column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.length(text).cast("double")) if column in docs.columns else F.length(text).cast("double")


def train(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, length_column: str, sample: int) -> Machine:
    """The fit reads labelled rows outside the held-out fifth, ``sample`` at most."""
    known = labels.filter((remainder(id_column, 5) != 0) & F.col("quality").isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.avg(F.col("quality").cast("double")).alias("share")).filter("share <> 0.5")
    # at most ``sample`` rows of two columns: the bound that makes the broadcast safe
    chosen = known.select("id", (F.col("share") > 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), stated_length(docs, text, length_column).alias("stated"))
    use = pandas_udf(extracted, "slots binary, weights binary, statistics binary")
    taken = rows.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", "label", use("text", "stated").alias("f"))
    # the sample's rows as bytes, some 2 KB each
    out = sorted(taken.select("id", "label", "f.*").collect(), key=lambda r: r["id"])
    parts = [(np.frombuffer(r["slots"], "<i4").astype(np.int64), np.frombuffer(r["weights"], "<f4"), np.frombuffer(r["statistics"], "<f4")) for r in out]
    return fit(parts, np.array([r["label"] for r in out], dtype=np.float64))


def score_column(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, length_column: str, sample: int) -> Column:
    bounded_batches(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_column, text_column, length_column, sample))

    def run(texts: pd.Series, stated: pd.Series) -> pd.Series:
        model = machine.value
        return pd.Series([model.score(text, s) for text, s in zip(texts, stated)], dtype="float64")

    text = text_of(text_column)
    return pandas_udf(run, "double")(text, stated_length(docs, text, length_column))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars", sample: int = SAMPLE
) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    score = score_column(docs, labels, id_column, text_column, length_column, sample)
    scored = docs.select(F.col(id_column), (remainder(id_column, 5) == 0).alias("held_out"), score.alias("_fm_score"))
    return scored.select(id_column, "held_out", F.col("_fm_score").alias("score"), (F.col("_fm_score") >= GOOD).cast("int").alias("predicted"))


def drop_poor(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars", sample: int = SAMPLE
) -> DataFrame:
    """The documents that the classifier accepts, in the columns of the input."""
    name = fresh(docs, "_score")
    score = score_column(docs, labels, id_column, text_column, length_column, sample)
    return docs.withColumn(name, score).filter(F.col(name) >= GOOD).drop(name)
