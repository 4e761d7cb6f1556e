import re

import pytest
from pyspark.sql import functions as F

from minekit.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, weight double"


def frame_of(spark, rows):
    """Rows of (id, text, source) or (id, text, source, weight); the column size clashes with the operator's own."""
    return spark.createDataFrame([(r[0], r[1], r[2], -5, float(r[3]) if len(r) > 3 and r[3] is not None else None) for r in rows], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows, share=1.5, weights=(5, 2, 1), limit=2):
    sizes = {}
    for row in rows:
        sizes[row[2]] = sizes.get(row[2], 0) + words(row[1])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, stopped = share * sum(sizes.values()), set()
    while True:
        rest = goal - sum(limit * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in order if s not in stopped)
        over = {s for s in order if s not in stopped and rest * weight[s] / open_ >= limit * sizes[s]}
        if not over:
            return sizes, {s: limit * sizes[s] if s in stopped else rest * weight[s] / open_ for s in order}
        stopped |= over


def check(rows, got, limit=2):
    sizes, targets = plain_targets(rows, limit=limit)
    assert len(got) == len(rows)
    taken = {s: 0 for s in sizes}
    want = sorted((str(r[0]), str(r[2]), words(r[1])) for r in rows)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == want
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size + r.partial and 0 <= r.taken <= limit * r.size and 0 <= r.partial <= r.size
        taken[r.source] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.5, s


EDGE = [
    (1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (4, "one", None), (None, "two words", None), (5, " \t\n", "empty"), (6, "z " * 5000, "y"),
    (7, "p q r s t", "é"), (7, "p q r s t", "é"), (8, "w " * 60, "Z"), *[(9, "same row again", "hot") for _ in range(40)],
]


def test_edges(spark):
    got = mixing.mix(frame_of(spark, EDGE)).collect()
    check(EDGE, got)
    assert {(r.copies, r.partial) for r in got if r.size == 0} <= {(0, 0), (1, 0), (2, 0)}


@pytest.mark.parametrize("bands", [1, 7, 5000])
def test_answer_does_not_depend_on_bands_or_partitions(spark, bands):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 5 if i % 3 else 0}") for i in range(1500)]
    df = frame_of(spark, rows)
    first = mixing.mix(df).orderBy("doc_id").collect()
    check(rows, first)
    assert mixing.mix(df.repartition(23, "text"), bands=bands).orderBy("doc_id").collect() == first


def test_many_equal_rows_are_listed_in_strips(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRIP", 7)
    rows = [(1, "a b c d", "x")] * 100 + [(i, "e f", "y") for i in range(2, 80)]
    got = mixing.mix(frame_of(spark, rows)).collect()
    check(rows, got)
    assert len({(r.copies, r.partial) for r in got if r.doc_id == 1}) > 1


def test_one_document_in_each_source_gives_a_part(spark):
    rows = [(1, "w " * 1000, "a"), (2, "w " * 1000, "b"), (3, "w " * 1000, "c")]
    got = {r.source: r.taken for r in mixing.mix(frame_of(spark, rows)).collect()}
    assert got == {"a": 2000, "b": 1667, "c": 833}


def test_weights_of_documents(spark):
    """Heavier documents are taken more often, none beyond the limit, and the words still meet the target."""
    rows = [(i, "w " * (5 + i % 7), "big" if i % 4 else "small", [0.0, 1.0, 3.0, None, 50.0][i % 5]) for i in range(2000)]
    got = mixing.mix(frame_of(spark, rows), weight_column="weight", share=0.5).collect()
    weight = {r[0]: r[3] or 0.0 for r in rows}
    sizes, targets = plain_targets(rows, share=0.5)
    rates = {}
    for source in sizes:
        mine = [r for r in got if r.source == source]
        most = sum(2 * r.size for r in mine if weight[r.doc_id] > 0)
        assert sum(r.taken for r in mine) == pytest.approx(min(targets[source], most), abs=1)
        assert all(r.taken == 0 for r in mine if weight[r.doc_id] == 0) and all(r.taken <= 2 * r.size for r in mine)
        rates[source] = [sum(r.taken for r in mine if weight[r.doc_id] == w) / sum(r.size for r in mine if weight[r.doc_id] == w) for w in (1.0, 3.0, 50.0)]
    assert all(a <= b <= c for a, b, c in rates.values())
    assert any(1.8 < b / a < 5 for a, b, _ in rates.values() if b < 1.99)


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document of weight 3 is drawn about three times as often as one of weight 1."""
    df = frame_of(spark, [(i, "w", "s", 3.0 if i % 2 else 1.0) for i in range(400)])
    heavy = light = 0
    for seed in range(3):
        rows = mixing.mix(df, weight_column="weight", share=0.3, seed=seed).collect()
        heavy += sum(r.taken for r in rows if r.doc_id % 2)
        light += sum(r.taken for r in rows if not r.doc_id % 2)
    assert heavy + light == 360 and 2.1 < heavy / light < 4.3


def test_long_text_and_empty_table(spark):
    rows = [(1, "word joined " * 200_000, "s"), (2, "b", "t")]
    check(rows, mixing.mix(frame_of(spark, rows)).collect())
    assert mixing.mix(frame_of(spark, [])).count() == 0


def test_main_path_is_native(spark, documents):
    plan = mixing.mix(documents.filter(F.col("doc_id") < 50))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExternalRDD" not in plan
