import random
import re

import pytest

from minekit.llm import near_dedup
from minekit.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, per_cent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, common in near.items():
            if 100 * common >= per_cent * (len(s) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {g: min((rows[i][0] for i in members if rows[i][0] is not None), default=None) for g, members in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def family(seed, n, share):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    return [" ".join(edited(rng, base, share)) for _ in range(n)]


@pytest.mark.parametrize(("words_each", "per_cent"), [(3, 85), (5, 80)])
def test_documents_equal_brute_force(documents, words_each, per_cent):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(near_dedup.near_duplicates(documents, words_each=words_each, per_cent=per_cent)) == brute(rows, words_each, per_cent)


def test_families_and_chains_equal_brute_force(frame, monkeypatch):
    """Large families, near misses around the threshold, chains and a passage that many texts share; small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = family(1, 80, 0.015) + family(2, 80, 0.03) + family(3, 60, 0.05)
    rng = random.Random(4)
    chain = [f"c{i}" for i in range(100)]
    for step in range(30):
        chain[rng.randrange(100)] = f"n{step}"
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert result(near_dedup.near_duplicates(frame(rows), words_each=3, per_cent=85)) == brute(rows, 3, 85)


EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, "ÄÖ ü x"), (8, "äÖ ü x"), (9, "a a a a a"), (9, "a a a a a"),
    (9, "other text by the same id"), (None, "one two"), (None, "nobody else"), (10, "long " + "w " * 30_000), (11, "one two"), (12, "a a a a a a"),
]


def test_edges(frame):
    df = near_dedup.near_duplicates(frame(EDGE), words_each=3, per_cent=85)
    assert result(df) == brute(EDGE, 3, 85)


def test_stage_keeps_one_of_each_group(frame):
    docs = frame(EDGE)
    out = near_dedup.drop_near_duplicates(docs, words_each=3, per_cent=85)
    assert out.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = [r for r in dict.fromkeys(EDGE) if r[0] not in (5, 12) and r != (None, "one two")]
    assert got == sorted(want, key=repr)
    assert near_dedup.drop_near_duplicates(frame([])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 400)] + [(900, 901)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(300, 400)]}, 900: 900, 901: 900}


def test_needed_collisions_keep_pairs_at_the_threshold():
    assert near_dedup.needed_collisions(0.85) >= 14
    assert near_dedup.needed_collisions(0.8) < near_dedup.needed_collisions(0.85) < near_dedup.needed_collisions(0.95)
