"""Quality, language and language-model scores: held-out figures, plain formulas and edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from minekit.llm import language, quality, scoring

EDGE = [(1, None), (2, ""), (3, "123 !!"), (4, "words of a text " * 40_000), (5, "same"), (5, "same"), (None, "Ein Text ohne Nummer"), (6, "日本語")]


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_on_held_out_rows(documents, labels):
    rows = {r.doc_id: r for r in quality.quality_scores(documents, labels).collect()}
    assert len(rows) == documents.count()
    assert all(r.held_out == (fold(k, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_quality_learns_from_the_other_folds_only(documents, labels):
    """Turning the held-out labels round changes no score."""
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    some = documents.limit(50)
    one, two = (quality.drop_poor(some, x).count() for x in (labels, turned))
    assert one == two
    first = quality.train(documents, labels, "doc_id", "text", "n_chars", 500)
    second = quality.train(documents, turned, "doc_id", "text", "n_chars", 500)
    assert np.array_equal(first.factors, second.factors) and first.bias == second.bias


def test_pair_terms_equal_the_double_sum():
    rng = np.random.default_rng(3)
    machine = quality.Machine(0.3, rng.normal(size=40), rng.normal(size=(40, 5)), np.zeros(2), np.ones(2))
    at, x = rng.choice(40, size=9, replace=False), rng.normal(size=9)
    pairs = sum(float(machine.factors[at[i]] @ machine.factors[at[j]]) * x[i] * x[j] for i in range(9) for j in range(i))
    assert math.isclose(machine.raw(at, x), 0.3 + float(machine.linear[at] @ x) + pairs)


def test_quality_edges(spark, frame, labels):
    docs = frame(EDGE)
    odd = spark.createDataFrame([(4, 1), (4, 0), (5, None), (2, 1), (None, 0), (1, 0)], "doc_id long, quality int")
    for known in (odd, odd.limit(0), labels):
        rows = quality.quality_scores(docs, known).collect()
        assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, (i for i, _ in EDGE)))
        assert all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(frame([]), odd).count() == 0
    out = quality.drop_poor(docs, odd.limit(0))
    assert out.schema == docs.schema and out.count() == len(EDGE)


def test_language_on_held_out_rows(documents):
    rows = {r.doc_id: r for r in language.identify(documents).collect()}
    want = {r.doc_id: r.lang for r in documents.collect()}
    assert rows.keys() == want.keys()
    assert all(r.held_out == (fold(k, 4) == 2) and 0 <= r.score <= 1 and r.lang_pred in {*want.values(), "und"} for k, r in rows.items())
    held = [r.lang_pred == want[k] for k, r in rows.items() if r.held_out and want[k]]
    assert sum(held) / len(held) > 0.97


def test_bundles_equal_the_sum_of_bound_letters():
    text = "Häuser, 12 Häuser"
    symbols = " " + re.sub("[^a-zäöü]+", " ", text.lower()) + " "
    total = np.zeros(language.SIZE)
    for i in range(len(symbols) - 2):
        bound = np.ones(language.SIZE)
        for k, c in enumerate(symbols[i : i + 3]):
            bound = bound * np.roll(language.letter_vector(ord(c)), 2 - k)
        total += bound
    got = language.bundles(["", text])
    assert not got[0].any()
    assert np.allclose(got[1], total / np.linalg.norm(total), atol=1e-5)


def test_long_texts_and_small_memories_give_the_same(monkeypatch):
    texts = ["Der Hund läuft. " * 300, "le chat dort " * 50, "x"]
    want = language.bundles(texts)
    monkeypatch.setattr(language, "STEP", 100)
    monkeypatch.setattr(language, "REMEMBERED", 12)
    language.gram_vectors.cache_clear()
    assert np.allclose(language.bundles(texts), want, atol=1e-5)
    language.gram_vectors.cache_clear()


def test_language_edges(frame):
    docs = frame(EDGE, ["en", "en", "en", "en", None, None, "de", "ja"])
    rows = language.identify(docs).collect()
    got = {(r.doc_id, r.lang_pred) for r in rows}
    assert len(rows) == len(EDGE)
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and all(p in ("und", "en", "de", "ja") for _, p in got)
    # without a language to learn everything is undetermined
    assert {r.lang_pred for r in language.identify(frame(EDGE)).collect()} == {"und"}
    assert language.identify(frame([])).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "</s>"]


def plain_scores(rows, mass):
    train = [words(t) for i, t in rows if i is None or fold(i, 7) != 2]
    count = Counter(w for t in train for w in t)
    pair = Counter(p for t in train for p in zip(["</s>", *t], t))
    n, size = sum(count.values()), sum(count.values()) + len(count) + 1
    out = []
    for i, t in rows:
        t = words(t)
        root = [(count[w] + 1) / size for w in t]
        arcs = [(pair[v, w] + mass * r) / (count[v] + mass) for v, w, r in zip(["</s>", *t], t, root)]
        out.append((i, i is not None and fold(i, 7) == 2, len(t), sum(count[w] > 0 for w in t), n, sum(map(math.log10, root)), sum(map(math.log10, arcs))))
    return out


def close(got, want):
    got, want = sorted((tuple(r) for r in got), key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


@pytest.mark.parametrize("sizes", [{}, {"block_chars": 40_000, "part_keys": 5_000}])
def test_scores_equal_the_plain_model(documents, sizes):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    close(scoring.language_model_scores(documents, **sizes).collect(), plain_scores(rows, scoring.MASS))


def test_scores_of_edges(frame):
    close(scoring.language_model_scores(frame(EDGE)).collect(), plain_scores(EDGE, scoring.MASS))
    held = [(i, "nothing to learn") for i in range(40) if fold(i, 7) == 2]
    close(scoring.language_model_scores(frame(held)).collect(), plain_scores(held, scoring.MASS))
    assert scoring.language_model_scores(frame([])).count() == 0


def test_the_model_beats_the_base_on_held_out_rows(documents):
    rows = [r for r in scoring.language_model_scores(documents).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_lists_survive_packing(parts):
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 5000):
        keys = np.unique(rng.integers(0, 2**64, size=n * parts, dtype=np.uint64))
        part = 3 % parts
        keys = keys[keys % np.uint64(parts) == part]
        assert np.array_equal(scoring.unpacked_keys(scoring.packed_keys(keys, parts), part, parts), keys)
        for top in (2, 300, 2**40):
            counts = rng.integers(0, top, size=len(keys))
            assert np.array_equal(scoring.unpacked_counts(scoring.packed_counts(counts)), counts)
