import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from minekit.llm import fill_middle
from minekit.llm.fill_middle import RankIndex, line_offsets

EDGE = [
    (1, None), (2, ""), (3, "one line"), (4, "a\nb\nc\nd\n"), (5, "\n\n\n"), (6, "holds <S> a mark\nx\ny"), (7, "ends with <\nP>\n<\nS\n>M"),
    (8, "emoji 👩‍👩‍👧\r\nnext\x0b line\n" * 9), (9, "x" * 300_000 + "\n" + "y\n" * 40_000), (10, "a\nb"), (10, "a\nb"), (10, "a\nc"), (None, "n\nu\nl\nl"),
]


def plain_cut(key, text):
    """The contract, read literally."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted([h[0] % (len(units) + 1), h[1] % (len(units) + 1)])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return key, len(units), "plain", None, None, text, text
    if h[3] % 100 < 50:
        return key, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return key, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def rows_of(df):
    rows = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_edges(frame):
    assert rows_of(fill_middle.fill_in_middle(frame(EDGE))) == sorted([plain_cut(*row) for row in EDGE], key=repr)


def test_all_documents(documents):
    want = sorted([plain_cut(r.doc_id, r.text) for r in documents.collect()], key=repr)
    got = rows_of(fill_middle.fill_in_middle(documents))
    assert got == want
    assert {"psm", "spm"} <= {r[2] for r in got}


def test_share_of_plain_texts(frame):
    rows = fill_middle.fill_in_middle(frame([(i, f"a{i}\nb\nc\n") for i in range(400)]), marked_per_cent=25).collect()
    marked = [r for r in rows if r.form != "plain"]
    assert 60 < len(marked) < 140 and all(r.output == r.restored for r in rows if r.form == "plain")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(0, 120))
def test_index_is_exact_and_bounded(lengths, error):
    offsets = np.cumsum([0, *lengths]).astype(np.int64)
    index = RankIndex(offsets, error)
    ranks = np.arange(len(offsets))
    assert index.offsets(ranks).tolist() == offsets.tolist()
    assert np.abs(offsets - index.predicted(ranks)).max() <= error + 1


def test_even_lines_need_one_segment():
    index = RankIndex(line_offsets("0123456789\n" * 100_000))
    assert len(index.ranks) == 1 and index.offsets(np.array([0, 77_777, 100_000])).tolist() == [0, 855_547, 1_100_000]


def test_empty_table(frame):
    assert fill_middle.fill_in_middle(frame([])).count() == 0
