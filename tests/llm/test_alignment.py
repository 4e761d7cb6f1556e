import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from minekit.llm import alignment

LEFT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LEFT.encode_special_tokens = True
RIGHT = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SIGNS = alignment.byte_of_sign()
EDGE = [
    (1, None), (2, ""), (3, " "), (4, "\n\n  x"), (5, "It's <|endoftext|> a <s> b </s> <0x0A>"), (6, "a literal ▁ sign"), (7, "日本語のテキスト  と emoji 👩‍👩‍👧"),
    (8, "tab\tand\x85odd\x1c spaces   here"), (9, "word " * 3000), (9, "word " * 3000), (None, "null id here"), (10, "y" * 5000), (11, "z \n z"),
    (12, "The the THE of of"), (13, "ends with blank "),
]


def tokens(text):
    left = LEFT.encode(" " + text, add_special_tokens=False).ids
    right = RIGHT.encode(text)
    left_bytes = [bytes(SIGNS[c] for c in LEFT.id_to_token(i)) for i in left]
    right_bytes = []
    for i in right:
        piece = RIGHT.id_to_piece(i)
        right_bytes.append(bytes([int(piece[3:5], 16)]) if RIGHT.is_byte(i) else piece.replace("▁", " ").encode())
    return left, right, left_bytes, right_bytes


def links_of(text):
    """All pairs of token occurrences whose byte ranges overlap, and the groups, by plain interval tests."""
    if not text:
        return [], [], [], []
    left, right, left_bytes, right_bytes = tokens(text)
    if b"".join(left_bytes) != (" " + text).encode() or b"".join(right_bytes) != (" " + text).encode():
        return [], [], [], []

    def spans(parts):
        out, at = [], 0
        for part in parts:
            out.append((at, at + len(part)))
            at += len(part)
        return out

    a_spans, b_spans = spans(left_bytes), spans(right_bytes)
    links, first = [], 0
    for a, (start, end) in zip(left, a_spans):
        while first < len(b_spans) and b_spans[first][1] <= start:
            first += 1
        at = first
        while at < len(b_spans) and b_spans[at][0] < end:
            links.append((a, right[at]))
            at += 1
    ends = {e for _, e in a_spans} & {e for _, e in b_spans}
    groups, sides = [], ([], [])
    for end, side, i in sorted([(e, 0, i) for i, (_, e) in zip(left, a_spans)] + [(e, 1, i) for i, (_, e) in zip(right, b_spans)], key=lambda t: t[:2]):
        sides[side].append(str(i))
        if side == 1 and end in ends:
            groups.append("|".join(",".join(side) for side in sides))
            sides = ([], [])
    return left, right, links, groups


def plain_rows(rows):
    told = [(key, *links_of(text)) for key, text in rows]
    holders, best = {}, {}
    for _, _, _, links, _ in told:
        for pair in set(links):
            holders[pair] = holders.get(pair, 0) + 1
    for (a, _), n in holders.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (key, len(a), len(b), len(groups), len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for key, a, b, links, groups in told
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"stretch": 40, "block_pairs": 5}, {"stretch": 1, "block_pairs": 100}])
def test_edges(frame, sizes):
    rows = [row for row in EDGE if row[0] != 9 or sizes.get("stretch", 50) > 1]
    got = rows_of(alignment.align_tokenizers(frame(rows), **sizes))
    assert got == sorted(plain_rows(rows), key=repr)


def test_documents(documents):
    docs = documents.filter("doc_id % 7 = 3")
    want = plain_rows([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(alignment.align_tokenizers(docs, stretch=20_000, block_pairs=30_000)) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.'sax▁\x00\x85 <>|0")), min_size=1, max_size=40))
def test_runs_give_the_library_ids(text):
    both = alignment.encoders(*alignment.default_paths())
    left, right, good = both.spelt([" " + text, " other"])[0]
    want_left, want_right, left_bytes, right_bytes = tokens(text)
    data = (" " + text).encode()
    assert good == (b"".join(left_bytes) == data and b"".join(right_bytes) == data)
    if good:
        assert [int.from_bytes(left[i : i + 4], "little") for i in range(0, len(left), 4)] == want_left
        assert [int.from_bytes(right[i : i + 4], "little") for i in range(0, len(right), 4)] == want_right


def test_empty_table(frame):
    assert alignment.align_tokenizers(frame([])).count() == 0
