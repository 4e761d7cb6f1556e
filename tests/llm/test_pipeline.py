"""The pipeline against a chain of brute-force stages, and its treatment of odd rows."""

import corpus_pipeline
from minekit.llm import decontaminate, quality
from tests.llm.test_decontaminate import distance_to_part
from tests.llm.test_exact_dedup import folded
from tests.llm.test_near_dedup import brute
from tests.llm.test_tokens import check_packing

FOLDER = "/root/testdata/sf0.01"


def brute_force(spark, docs, folder):
    """(doc_id, text) after the four filtering stages; the classifier's own scores stand for the first."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {}
    for key in sorted(rows):
        last[folded(rows[key])] = key
    rows = {key: rows[key] for key in last.values()}
    groups = brute(list(rows.items()), 5, 80)
    rows = {key: rows[key] for key, _, component in groups if key == component}
    items = [decontaminate.reduced(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    short = {key: decontaminate.reduced(text) for key, text in rows.items()}
    leaks = {key for key, text in short.items() if any(len(i) >= decontaminate.MIN_BYTES and i in text for i in items)}
    return rows, leaks, items, short


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows, leaks, items, short = brute_force(spark, docs, FOLDER)
    out = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {r.doc_id for r in out}
    # what is missing beyond the passages found word by word has to be within the edit budget of an item
    gone = set(rows) - kept
    assert leaks <= gone
    for key in gone - leaks:
        assert any(distance_to_part(i, short[key]) <= 0.1 * len(i) for i in items)
    check_packing(out, [(key, text) for key, text in rows.items() if key in kept])


def test_stages_keep_the_columns_and_treat_odd_rows(spark, frame):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x"), (4, "long " * 20_000), (5, "Long " * 20_000)]
    for given in (rows, []):
        docs = frame(given)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.schema == docs.schema, name
            assert out.count() <= docs.count()
            docs = out
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "best-fit packing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None
