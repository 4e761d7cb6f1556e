import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from minekit.llm import packing, token_counts
from minekit.llm.encoder import RunEncoder, default_path

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
EDGE = [
    (1, None), (2, ""), (3, " \n\t"), (4, "It's <|endoftext|>a<|startoftext|> b"), (5, "ÀÉ é  x y \x1c! \x85z"),
    (6, "word " * 9000), (7, "y" * 40_000), (8, "Ein Satz mit Übung. " * 2500 + "z" * 30_000), (8, None), (None, "null id"),
    (9, "日本語のテキスト " * 3000), (10, "emoji 👩‍👩‍👧 ½ ﬁ İ ẞ Σς"),
]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_runs_give_the_library_ids(text):
    known = test_runs_give_the_library_ids.known
    assert np.frombuffer(known.ids(text), dtype="<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(min_codepoint=32, max_codepoint=0x24F), st.sampled_from("'sStT <|>İ²½ªº\u00ad")), max_size=40))
def test_latin_runs_give_the_library_ids(text):
    known = test_runs_give_the_library_ids.known
    assert np.frombuffer(known.ids(text), dtype="<u4").tolist() == ids(text)


test_runs_give_the_library_ids.known = RunEncoder(default_path(), runs=64, parts=64)


@pytest.mark.parametrize("sizes", [{}, {"whole": 500, "step": 200, "overlaps": (16, 64)}, {"whole": 100, "step": 64, "overlaps": (4,)}])
def test_counts_equal_the_library(frame, sizes):
    rows = token_counts.token_counts(frame(EDGE), **sizes).collect()
    want = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t in EDGE]
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(want, key=repr)


def test_counts_of_all_documents(documents):
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents, whole=3000, step=1000, overlaps=(64, 256)).collect()}
    assert got == {r.doc_id: len(ids(r.text)) for r in documents.collect()}


def check_packing(rows, docs, capacity=4096):
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id), []).append(r)
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append([*ids(t), 1])
    for key, lists in want.items():
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[key])
        expected = []
        for whole in lists:
            for piece, at in enumerate(range(0, len(whole), capacity)):
                part = np.array(whole[at : at + capacity], dtype="<u4")
                expected.append((piece, at, len(part), zlib.crc32(part.tobytes())))
        assert pieces == sorted(expected)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_whole_and_gapless(frame):
    rows = packing.pack_documents(frame(EDGE)).collect()
    bins = check_packing(rows, EDGE)
    assert bins == packing.lower_bound(np.array([r.length for r in rows]), 4096)


def test_packing_of_all_documents(documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rows = packing.pack_documents(documents).collect()
    bins = check_packing(rows, docs)
    assert bins == packing.lower_bound(np.array([r.length for r in rows]), 4096)


def test_groups_with_gaps_exchange_pieces(frame):
    """Many small groups leave room that the exchange fills."""
    rng = np.random.default_rng(5)
    docs = [(i, "w " * int(n)) for i, n in enumerate(rng.integers(1, 60, size=900))]
    rows = packing.pack_documents(frame(docs), capacity=64, group_rows=20).collect()
    bins = check_packing(rows, docs, 64)
    first = sum(len(packing.best_fit(np.array([r.length for r in rows][at : at + 20]), 64)[2]) for at in range(0, len(rows), 20))
    bound = packing.lower_bound(np.array([r.length for r in rows]), 64)
    assert bound <= bins < first and bins <= bound * 1.06


def test_bound_never_exceeds_the_best_packing():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 33, size=rng.integers(1, 60))
        assert packing.lower_bound(lengths, 32) <= len(packing.best_fit(lengths, 32)[2])
    # three sizes over half need a bin each; the plain sum would say two
    assert packing.lower_bound(np.array([17, 17, 17]), 32) == 3


def test_empty_tables(frame):
    assert token_counts.token_counts(frame([])).count() == 0
    assert packing.pack_documents(frame([])).count() == 0


def test_words_with_a_sign_behind_them_give_the_library_ids_also_when_the_caches_turn_over():
    known, text = RunEncoder(default_path(), 8, 8), "Word, word. it's word' Über Übung; a1 b\x01 x~ <| Ωmega Ω, don't word9 "
    for part in (text, text * 40, text[::-1]):
        assert np.frombuffer(b"".join(known.ids_of_all([part, part])), dtype="<u4").tolist() == ids(part) * 2


def test_a_worker_lets_go_what_another_operator_kept():
    from minekit.llm import encoder, quality, words

    quality.known_words()["word"] = 1
    words.word_hashes()[b"word"] = 1
    assert quality.known_words() == {}
    assert encoder.encoder(default_path()) is encoder.encoder(default_path())
    assert words.word_hashes() == {}


def test_a_run_of_a_block_is_looked_up_once_however_often_it_occurs(monkeypatch):
    from minekit.llm import encoder

    asked, among = [], encoder.Remembered.among
    monkeypatch.setattr(encoder.Remembered, "among", lambda self, keys: asked.append(len(keys)) or among(self, keys))
    known = RunEncoder(default_path())
    got = b"".join(known.ids_of_all(["one two six\n" * 60_000 + "one", "six one " * 60_000 + "six"]))
    assert got == np.array(ids("one two six") * 60_000 + ids("one") + ids("six one") * 60_000 + ids("six"), dtype="<u4").tobytes()
    # three runs, of which three parts are learnt
    assert sum(asked) == 6


def test_blocks_keep_the_rows_and_a_long_text_goes_by_itself(monkeypatch):
    import pyarrow as pa

    from minekit.llm import encoder

    monkeypatch.setattr(encoder, "TOGETHER", 10)
    lists = [["", "abcd", "é"], [], ["abcdefghijklm", "", "x", "  "], ["abcdefgh", "z"]]
    schema = pa.schema([("text", pa.string())])
    batches = [pa.record_batch({"text": pa.array(texts, pa.string())}, schema) for texts in lists]
    got = [block["text"].to_pylist() for block in encoder.blocks(batches, "text")]
    assert got == [["", "abcd", "é"], ["abcdefghijklm"], ["", "x", "  "], ["abcdefgh", "z"]]
    assert list(encoder.blocks(batches[1:2], "text")) == []
    texts = [text for part in lists for text in part]
    assert [np.frombuffer(part, dtype="<u4").tolist() for part in RunEncoder(default_path()).ids_of_all(texts)] == [ids(t) for t in texts]
    assert list(RunEncoder(default_path()).ids_of_all([])) == []


def test_pieces_of_rows_in_many_small_blocks(monkeypatch):
    import pyarrow as pa

    from minekit.llm import encoder

    monkeypatch.setattr(encoder, "TOGETHER", 64)
    types = {"id": pa.string(), "text": pa.string()}
    batches = [
        pa.record_batch([pa.array([i and str(i) for i, _ in part], types["id"]), pa.array([t or "" for _, t in part], types["text"])], names=list(types))
        for part in (EDGE[:5], [], EDGE[5:])
    ]
    got = [tuple(r.values()) for batch in packing.cut_pieces(default_path(), 128, 1)(iter(batches)) for r in batch.to_pylist()]
    want = []
    for key, text in EDGE:
        whole = [*ids(text), 1]
        for piece, at in enumerate(range(0, len(whole), 128)):
            part = whole[at : at + 128]
            want.append((key and str(key), piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert got == want
