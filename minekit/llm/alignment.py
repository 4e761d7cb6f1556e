"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline inside Spark tasks.

For a stretch of documents the token ids of both tokenizers are list columns. Flattened, with parent indices
and byte widths summed cumulatively inside each document, they become tables keyed by document and token
end. An outer hash join on that key and a sort give one row for each elementary interval between token ends;
filling ids backward tells which token of either side covers it. Two tokens overlap in one such interval
exactly, so the rows are the links, and the rows with both ids from the start are the ends of the groups.

Documents are gathered in blocks. A block counts, by Table.group_by, how many of its documents hold each
linked id pair; Spark merges these partial counts, finds each left id's highest, and sends every block the
counts of its own pairs, with which the documents' sums are taken.

Neither tokenizer has a piece that reaches from a character that isn't white space over a blank, so texts
are encoded in runs between such places, and the runs that were met are remembered in a bounded cache. A
document of any length is worked on in stretches of whole runs; its own pairs are merged at its end.

Defined cases: a null or empty text, and one whose tokens of either side don't spell it, have zeros and the
empty digest; equal rows and null ids each give their own row and count as documents of their own; ties for
the highest count all count; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from minekit.llm.common import bounded_batches, cut, text_of
from minekit.llm.encoder import Remembered

#: Runs a worker remembers, and the longest of them in characters.
RUNS, LONGEST = 400_000, 48
#: Characters that go through the joins together, and linked pairs after which a block is closed.
STRETCH, BLOCK_PAIRS = 1_000_000, 2_000_000
#: Bits of a byte offset in the key of document and end, and of the right id in a pair.
END_BITS, ID_BITS = 40, 24
#: Places before a blank that follows a character that isn't white space; a last blank stays with its run, as the
#: piece model adds no blank to an empty text.
BETWEEN_RUNS = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + i): byte for i, byte in enumerate(others)}


class BothEncoders:
    """Ids of the runs of a text by a byte-level file (left) and by a piece model (right)."""

    def __init__(self, left: str, right: str, runs: int = RUNS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.left, self.right = Tokenizer.from_file(left), sentencepiece.SentencePieceProcessor(model_file=right)
        self.left.encode_special_tokens = True
        signs = byte_of_sign()
        # ids beyond the plain vocabulary are special strings, never met as their strings are ordinary text
        lefts = [bytes(signs[c] for c in self.left.id_to_token(i)) for i in range(self.left.get_vocab_size(with_added_tokens=False))]
        self.tables = pa.array(lefts, pa.binary()), pa.array([self.piece_bytes(i) for i in range(self.right.get_piece_size())], pa.binary())
        self.widths = tuple(pc.binary_length(table).cast(pa.int64()) for table in self.tables)
        self.known = Remembered(runs)

    def piece_bytes(self, i: int) -> bytes:
        piece = self.right.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.right.is_byte(i) else piece.replace("▁", " ").encode()

    def spelt(self, texts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Per text, which starts with a blank: ids of both sides as little-endian 32-bit bytes, and whether they spell it."""
        runs = [BETWEEN_RUNS.split(text) for text in texts]
        found = [self.known.get_all(of) for of in runs]
        missing = {run: None for of, ids in zip(runs, found) if None in ids for run, known in zip(of, ids) if known is None}
        new = self.learn(list(missing)) if missing else {}
        out = []
        for text, of, ids in zip(texts, runs, found):
            if None in ids:
                ids = [new[run] if known is None else known for run, known in zip(of, ids)]
            left, right = b"".join([i[0] for i in ids]), b"".join([i[1] for i in ids])
            out.append((left, right, all([i[2] for i in ids]) or self.spells(left, right, text.encode())))
        return out

    def learn(self, runs: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        # the right side adds the blank that every run starts with
        rights = self.right.encode([run[1:] for run in runs], num_threads=1)
        right_ends = np.cumsum([0, *map(len, rights)])
        right = np.fromiter(itertools.chain.from_iterable(rights), dtype="<u4", count=right_ends[-1])
        sides = [self.left_together(runs), (right, right_ends)]
        good = self.all_spell(runs, sides)
        data = [(ids.tobytes(), (ends * 4).tolist()) for ids, ends in sides]
        (left, left_at), (right, right_at) = data
        out = {}
        for i, run in enumerate(runs):
            pair = left[left_at[i] : left_at[i + 1]], right[right_at[i] : right_at[i + 1]]
            out[run] = (*pair, good or self.spells(*pair, run.encode()))
            if len(run) <= LONGEST:
                self.known.put(run, out[run])
        return out

    def left_together(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the left side of all runs, and where each run's begin: runs of one text, told apart by their lengths in bytes."""
        ids = np.array(self.left.encode_batch_fast(["".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.concatenate([[0], np.cumsum(self.widths[0].to_numpy()[ids])])
        borders = np.concatenate([[0], np.cumsum([len(run.encode()) for run in runs])])
        places = np.searchsorted(ends, borders)
        if ends[-1] == borders[-1] and np.array_equal(ends[places], borders):
            return ids, places
        lists = [e.ids for e in self.left.encode_batch_fast(runs, add_special_tokens=False)]
        return np.array([i for of in lists for i in of], dtype="<u4"), np.cumsum([0, *map(len, lists)])

    def all_spell(self, runs: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> bool:
        """Whether all runs are spelt by both sides: equal bytes altogether and equal lengths one by one."""
        data = [run.encode() for run in runs]
        lengths, joined = np.array([len(d) for d in data]), b"".join(data)
        for (ids, ends), table in zip(sides, self.tables):
            pieces = table.take(pa.array(ids.astype(np.int64)))
            sums = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy())])[ends]
            if not np.array_equal(np.diff(sums), lengths) or spelling(pieces) != joined:
                return False
        return True

    def spells(self, left: bytes, right: bytes, data: bytes) -> bool:
        found = (spelling(table.take(pa.array(np.frombuffer(ids, dtype="<u4").astype(np.int64)))) for ids, table in zip((left, right), self.tables))
        return all(bytes_ == data for bytes_ in found)


def spelling(pieces: pa.Array) -> bytes:
    """The bytes of all pieces, one after another."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(pieces)], pa.int64()), pieces), b"")[0].as_py() if len(pieces) else b""


@functools.cache
def encoders(left: str, right: str) -> BothEncoders:
    """One per worker and pair of files."""
    return BothEncoders(left, right)


def stretches(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of at least ``size`` characters that end where runs end."""
    at = 0
    while at < len(text):
        found = BETWEEN_RUNS.search(text, at + size) if at + size < len(text) else None
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


def list_column(parts: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *[len(p) // 4 for p in parts]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int64)))


def ends_table(lists: pa.ListArray, widths: pa.Array, name: str) -> pa.Table:
    """One row per token: the key of its document and end, and its id."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    running = pc.cumulative_sum(widths.take(flat))
    # cumulative inside each document: less what ran before its first token
    before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(lists.offsets.slice(0, len(lists)))
    ends = pc.subtract(running, before.take(parent))
    return pa.table({"key": pc.add(pc.shift_left(parent.cast(pa.int64()), pa.scalar(END_BITS, pa.int64())), ends), name: flat})


def joined_groups(ids: pa.Array, closing: np.ndarray) -> pa.Array:
    """The ids of each group, joined by commas; a token marked ``closing`` is its group's last."""
    offsets = np.concatenate([[0], np.flatnonzero(closing) + 1]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), ids.cast(pa.string())), ",")


def aligned(left: list[bytes], right: list[bytes], widths: tuple[pa.Array, ...]) -> tuple:
    """Per document: n_a, n_b, n_groups, n_links and its groups as text; and (document, pair, times) of all links."""
    a_lists, b_lists = list_column(left), list_column(right)
    a_table, b_table = ends_table(a_lists, widths[0], "a"), ends_table(b_lists, widths[1], "b")
    rows = a_table.join(b_table, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    key, a, b = (rows.column(c).combine_chunks() for c in ("key", "a", "b"))
    doc = pc.shift_right(key, pa.scalar(END_BITS, pa.int64()))
    a_here, b_here = a.is_valid().to_numpy(zero_copy_only=False), b.is_valid().to_numpy(zero_copy_only=False)
    both, of = a_here & b_here, doc.to_numpy(zero_copy_only=False)
    n_links, n_groups = np.bincount(of, minlength=len(left)), np.bincount(of[both], minlength=len(left))
    groups = pc.binary_join_element_wise(joined_groups(pc.list_flatten(a_lists), both[a_here]), joined_groups(pc.list_flatten(b_lists), both[b_here]), "|")
    offsets = np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), groups), ";")
    pair = pc.bit_wise_or(pc.shift_left(pc.fill_null_backward(a), pa.scalar(ID_BITS, pa.int64())), pc.fill_null_backward(b))
    times = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    times = times.sort_by("doc")
    return (
        a_lists.value_lengths().to_numpy(), b_lists.value_lengths().to_numpy(), n_groups, n_links, texts,
        tuple(times.column(c).to_numpy() for c in ("doc", "pair", "count_all")),
    )


class Document:
    """What is known of a document while its stretches come in."""

    def __init__(self, key) -> None:
        self.key, self.good, self.counts, self.digest, self.parts, self.begun = key, True, np.zeros(4, dtype=np.int64), hashlib.sha256(), [], False

    def add(self, counts, text, pairs: np.ndarray, times: np.ndarray) -> None:
        if self.begun:
            self.digest.update(b";")
        self.begun = True
        self.digest.update(memoryview(text.as_buffer()))
        self.counts += counts
        self.parts.append((pairs, times))

    def result(self) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        if not self.good or not self.begun:
            return [0] * 4, "", none, none
        pairs, times = self.parts[0]
        if len(self.parts) > 1:
            pairs, place = np.unique(np.concatenate([p for p, _ in self.parts]), return_inverse=True)
            times = np.bincount(place, weights=np.concatenate([t for _, t in self.parts])).astype(np.int64)
        return self.counts.tolist(), self.digest.hexdigest(), pairs, times


def block_type(id_type: pa.DataType) -> pa.Schema:
    numbers, counts = pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.schema(
        [("block", pa.int64()), ("id", id_type), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
         ("links", counts), ("times", counts), ("pairs", numbers), ("holders", numbers)]
    )


def block_batch(number: int, docs: list[Document], id_type: pa.DataType) -> pa.RecordBatch:
    """Rows of a block: one per document, its links as places in the block's list of pairs, and one with that list."""
    results = [doc.result() for doc in docs]
    every = np.concatenate([r[2] for r in results] or [np.zeros(0, dtype=np.int64)])
    counted = pa.table({"pair": every}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    pairs = counted.column("pair").to_numpy()
    ends = np.cumsum([0, *[len(r[2]) for r in results], 0]).astype(np.int32)
    links = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.searchsorted(pairs, every).astype(np.int32)))
    times = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[3] for r in results] or [every]).astype(np.int32)))
    last = np.array([0] * (len(docs) + 1) + [len(pairs)], dtype=np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(last), pa.array(counted.column(c).to_numpy())) for c in ("pair", "count_all")]
    columns = [
        pa.array([number] * (len(docs) + 1), pa.int64()), pa.array([doc.key for doc in docs] + [None], id_type),
        *[pa.array([r[0][i] for r in results] + [None], pa.int64()) for i in range(4)], pa.array([r[1] for r in results] + [None], pa.string()),
        links, times, *lists,
    ]
    return pa.RecordBatch.from_arrays(columns, schema=block_type(id_type))


def blocks_of(left: str, right: str, stretch: int, block_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders(left, right)
        number, done, size, id_type = TaskContext.get().partitionId() << 32, [], 0, None
        waiting: list[tuple[Document, str]] = []
        chars = 0

        def align() -> int:
            """Send the waiting stretches through the joins; returns the pairs found."""
            found = waiting[:]
            waiting.clear()
            if not found:
                return 0
            ids = both.spelt([part for _, part in found])
            for (doc, _), (_, _, good) in zip(found, ids):
                doc.good &= good
            # what isn't spelt has no tokens
            lefts, rights = ([i[side] if doc.good else b"" for (doc, _), i in zip(found, ids)] for side in (0, 1))
            *counts, texts, (of, pairs, times) = aligned(lefts, rights, both.widths)
            counts, borders = np.stack(counts, axis=1), np.searchsorted(of, np.arange(len(found) + 1))
            for i, (doc, _) in enumerate(found):
                here = slice(borders[i], borders[i + 1])
                doc.add(counts[i], texts[i], pairs[here], times[here])
            return len(pairs)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                done.append(doc := Document(key))
                whole = text.as_py()
                for part in stretches(" " + whole, stretch) if whole else ():
                    waiting.append((doc, part))
                    chars += len(part)
                    if chars >= stretch:
                        size, chars = size + align(), 0
                # a block ends between documents
                if size >= block_pairs:
                    align()
                    yield block_batch(number, done, id_type)
                    number, done, size, chars = number + 1, [], 0, 0
        align()
        if done:
            yield block_batch(number, done, id_type)

    return run


def sums_of(id_type: str):
    """Per document of a block: links whose count is the highest of their left id, and the sum of the counts."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        links, times = docs.column("links").combine_chunks(), docs.column("times").combine_chunks()
        parent, flat, times = pc.list_parent_indices(links), pc.list_flatten(links), pc.list_flatten(times).cast(pa.int64())
        n_best, count_sum = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
        if len(flat):
            sent = pc.list_flatten(told.column("counts").combine_chunks())
            count, best = sent.field("n").take(flat), sent.field("best").take(flat).cast(pa.int64())
            table = pa.table({"doc": parent, "best": pc.multiply(best, times), "sum": pc.multiply(count, times)})
            sums = table.group_by("doc", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")])
            n_best[sums.column("doc")] = sums.column("best_sum")
            count_sum[sums.column("doc")] = sums.column("sum_sum")
        kept = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))

    return run


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align_blocks(docs: DataFrame, id_column: str, text_column: str, paths: tuple[str, str] | None, stretch: int, block_pairs: int) -> DataFrame:
    """The written blocks: rows of documents, and one row per block with its pairs and how many documents hold each."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"block long, id {id_type}, {RESULT}, links array<int>, times array<int>, pairs array<long>, holders array<long>"
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    left, right = paths or default_paths()
    return cut(rows.mapInArrow(blocks_of(left, right, stretch, block_pairs), schema))


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs per block (block, place, pair), and corpus-wide (pair, n, best): documents that hold a pair, highest of its left id."""
    listed = blocks.filter(F.col("groups_sha256").isNull()).select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "of"))
    listed = listed.select("block", "place", F.col("of.pairs").alias("pair"), F.col("of.holders").alias("holders"))
    totals = listed.groupBy("pair").agg(F.sum("holders").alias("n"))
    # a left id has at most as many pairs as the right vocabulary has ids
    of_left = Window.partitionBy(F.shiftright("pair", ID_BITS))
    return listed.drop("holders"), totals.withColumn("best", F.col("n") == F.max("n").over(of_left))


def align_tokenizers(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    paths: tuple[str, str] | None = None,
    stretch: int = STRETCH,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    id_type = docs.schema[id_column].dataType.simpleString()
    blocks = align_blocks(docs, id_column, text_column, paths, stretch, block_pairs)
    listed, totals = pair_counts(blocks)
    told = listed.join(totals, "pair").groupBy(F.col("block").alias("of")).agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("counts"))
    rows = blocks.filter(F.col("groups_sha256").isNotNull()).drop("pairs", "holders")
    schema = f"id {id_type}, {RESULT}, n_best long, count_sum long"
    out = rows.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(sums_of(id_type), schema)
    return out.select(F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
