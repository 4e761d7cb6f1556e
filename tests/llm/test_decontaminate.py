import random

import numpy as np

from minekit.llm import decontaminate as d


def distance_to_part(item, text):
    """Plain dynamic programme: least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, data, n):
    data = list(data)
    for _ in range(n):
        at = rng.randrange(len(data))
        kind = rng.randrange(3)
        if kind == 0:
            data[at] = rng.choice(b"abcdefg")
        elif kind == 1:
            del data[at]
        else:
            data.insert(at, rng.choice(b"abcdefg"))
    return bytes(data)


def test_alignment_equals_the_plain_programme():
    rng = random.Random(1)
    for _ in range(150):
        item = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(20, 90)))
        window = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(0, 60))) + edited(rng, item, rng.randrange(0, 9)) + b"cab" * rng.randrange(9)
        distance, left, right = d.align(item, window, len(item))
        assert distance == distance_to_part(item, window)
        assert plain(item, window[left:right]) == distance


def test_every_region_within_the_budget_is_found():
    """Against the plain programme over all pairs of item and document."""
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    items = [b" ".join(rng.choice(words) for _ in range(rng.randrange(4, 40))) for _ in range(12)]
    docs = []
    for k in range(40):
        body = b" ".join(rng.choice(words) for _ in range(60))
        if k % 2:
            item = rng.choice(items)
            body += b" " + edited(rng, item, rng.randrange(0, len(item) // 8 + 1)) + b" " + body[:50]
        docs.append(body)
    index = d.build_index([i.decode() for i in items])
    found = d.regions(docs, index)
    for doc, spans in zip(docs, found):
        got = {}
        for i, _, _, distance in spans:
            got[i] = min(distance, got.get(i, 99))
        for i, item in enumerate(items):
            best = distance_to_part(item, doc)
            assert got.get(i) == (best if len(item) >= d.MIN_BYTES and best <= index.budgets[i] else None)


PASSAGE = "The quick brown fox jumps over the lazy dog; then, at noon, it sleeps beneath an old oak tree."
BENCH = [(1, PASSAGE), (2, None), (3, ""), (4, "short one"), (None, "An item whose number is not known, yet is long enough to be found."), (5, PASSAGE)]
DOCS = [
    (1, None), (2, ""), (3, f"Before. {PASSAGE.upper()} After."), (4, PASSAGE.replace("; ", "\n\n--").replace(" ", "   ")),
    (5, PASSAGE.replace("lazy", "lame")), (5, PASSAGE.replace("lazy", "lame")), (6, "a short one here"), (7, PASSAGE[:45]),
    (8, "Ärger " * 30_000 + PASSAGE + " und " * 9), (None, "an ITEM whose number is not known yet is long enough to be found"), (9, "clean text of no interest at all"),
]


def benchmark(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in BENCH], "item_id long, text string, start string")


def test_edges_and_spans(spark, frame):
    rows = d.contaminated_regions(frame(DOCS), benchmark(spark)).collect()
    got = sorted(((r.doc_id, r.item_id) for r in rows), key=repr)
    assert got == sorted([(k, i) for k in (3, 4, 5, 5, 8) for i in (1, 5)] + [(None, None)], key=repr)
    texts = dict(DOCS)
    for r in rows:
        part = texts[r.doc_id][r.start : r.end]
        assert d.reduced(part) in (d.reduced(PASSAGE), d.reduced(PASSAGE.replace("lazy", "lame")), d.reduced(BENCH[4][1]))
        assert r.distance == (2 if r.doc_id == 5 else 0)


def test_blocks_of_the_benchmark_give_the_same(spark, frame):
    whole = d.contaminated_regions(frame(DOCS), benchmark(spark)).collect()
    blocks = d.contaminated_regions(frame(DOCS), benchmark(spark), block_bytes=60).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, blocks))


def test_two_regions_of_one_item(spark, frame):
    rows = d.contaminated_regions(frame([(1, f"{PASSAGE} something else {PASSAGE}")]), benchmark(spark)).filter("item_id = 1").collect()
    assert len(rows) == 2


def test_stage_and_empty_tables(spark, frame):
    docs = frame(DOCS)
    out = d.drop_contaminated(docs, benchmark(spark))
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 6, 7, 9]
    assert d.contaminated_regions(frame([]), benchmark(spark)).count() == 0
    assert d.contaminated_regions(docs, benchmark(spark).limit(0)).count() == 0
    assert d.drop_contaminated(docs, benchmark(spark).limit(0)).count() == len(DOCS)


def test_documents_equal_brute_force(spark, documents):
    """No clean document is reported, and every passage that a document holds word by word is."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.contaminated_regions(documents, items).collect()}
    short = {r.doc_id: d.reduced(r.text) for r in documents.collect()}
    want = {(k, r.item_id) for r in items.collect() for k, t in short.items() if d.reduced(r.text) in t}
    assert want <= got
    for k, i in got - want:
        item = d.reduced(items.filter(f"item_id = {i}").first().text)
        assert distance_to_part(item, short[k]) <= 0.1 * len(item)


def test_needed_follows_the_lemma():
    index = d.build_index(["x" * 100, "y" * 30])
    assert index.budgets.tolist() == [10, 2]
    assert index.needed.tolist() == [100 - 7 - 80, 30 - 7 - 16]
    assert np.all(index.needed >= 1)
