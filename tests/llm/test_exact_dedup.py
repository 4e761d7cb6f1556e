import hashlib
import random

import duckdb
import pytest

from check import canonical
from minekit.llm import exact_dedup
from minekit.llm.queries import ORACLES, QUERIES

EDGE = [(1, None), (2, ""), (3, "Äb"), (4, "äb"), (5, "ÄB"), (5, "Äb"), (6, "x" * 5000), (7, "X" * 5000), (8, "x" * 4999 + "y"), (None, ""), (9, "\n")]


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(folded(t), []).append(i)
    out = []
    for i, t in rows:
        group = groups[folded(t)]
        keep = max((x for x in group if x is not None), default=None)
        out.append((i, keep, len(group), hashlib.sha256(folded(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [3, 1000, exact_dedup.CHUNK])
def test_edges_equal_brute_force(frame, chunk):
    rows = exact_dedup.exact_duplicates(frame(EDGE), chunk=chunk).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == sorted(brute(EDGE), key=repr)
    # one row stays of each of the six texts
    assert sum(r.kept for r in rows) == len({folded(t) for _, t in EDGE})


def test_empty_table(frame):
    assert exact_dedup.exact_duplicates(frame([])).count() == 0
    assert exact_dedup.drop_exact_duplicates(frame([])).count() == 0


def test_chunk_hashes_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(10_000))
    for base, prime in zip(exact_dedup.BASES, exact_dedup.PRIMES):
        whole = exact_dedup.chunk_hash(data, base, prime)
        left = 0
        for at in range(0, len(data), 777):
            part = data[at : at + 777]
            left = (left * pow(base, len(part), prime) + exact_dedup.chunk_hash(part, base, prime)) % prime
        assert left == whole
        value = 0
        for byte in data:
            value = (value * base + byte + 1) % prime
        assert value == whole


def test_equal_prints_of_different_texts_are_told_apart(frame, monkeypatch):
    """With prints and keys that always agree, the comparison of chunks still keeps different texts apart."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(exact_dedup, "combine", lambda parts, which, prime: F.lit(0).cast("long"))
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *columns: F.lit(1).cast("long"))
    rows = exact_dedup.exact_duplicates(frame([(1, "abc"), (2, "abd"), (3, "ABC")])).collect()
    monkeypatch.setattr(exact_dedup.F, "xxhash64", real)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(1, 3, 2), (3, 3, 2), (2, 2, 1)}


def test_stage_keeps_one_row_and_all_columns(frame):
    docs = frame([*EDGE, (5, "ÄB"), (7, "X" * 5000)])
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert len(rows) == len({folded(t) for _, t in EDGE})
    assert {r.doc_id for r in rows if folded(r.text) == "x" * 5000} == {7}


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = con.execute(ORACLES["op10_exact_dedup"])
    columns = [d[0] for d in result.description]
    df = QUERIES["op10_exact_dedup"](spark, folder)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)
