"""Benchmark passages in documents, found by the q-gram lemma and confirmed by banded alignment.

Item and document are reduced to lower-case words parted by one space. An item of m bytes may differ by at
most e edits, a tenth of m. A region within e edits shares at least ``m - q + 1 - q * e`` of its q-grams with
the item, and all of them lie on diagonals that are at most 2e apart; so counts are taken in overlapping
diagonal bands of which one holds the whole region. Bands that reach the count are aligned with the item,
over the band's diagonals only, and the least edit distance decides. Short items get the largest e for which
the lemma still asks for a shared q-gram.

The benchmark goes to the tasks in blocks of bounded size, one pass over the documents for each block.

Defined cases: null or empty texts and items match nothing, nor do items of fewer than ``MIN_BYTES`` reduced
bytes, which prove no leak; repeated rows are searched each; an item with a null id is reported with a null
item_id; equal items are reported each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import bounded_batches, fresh, text_of

Q, BUDGET, MIN_BYTES = 8, 0.1, 20
#: Bytes of benchmark text in one pass, and positions of a document looked at in one step.
BLOCK_BYTES, STEP = 4_000_000, 1 << 20
#: ASCII letters and digits stay, other ASCII becomes a space, bytes of further letters stay.
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
SPREAD = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<item:int,first:int,last:int,distance:int>>"


def reduced(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(WORD_BYTES).split())


def qgram_codes(data: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each place, as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    codes = data[:n].astype(np.uint64)
    for k in range(1, Q):
        codes |= data[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    return codes


def slots(codes: np.ndarray) -> np.ndarray:
    return (codes * SPREAD) >> np.uint64(42)


@dataclass
class Index:
    """The q-grams of one block of items. ``present`` is a table of slots that lets most places pass by."""

    items: list[bytes]
    budgets: np.ndarray
    needed: np.ndarray
    present: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    offset: np.ndarray


def build_index(texts: list[str | None]) -> Index:
    items = [reduced(t or "") for t in texts]
    lengths = np.array([len(x) for x in items], dtype=np.int64)
    budgets = np.minimum((lengths * BUDGET).astype(np.int64), np.maximum((lengths - Q) // Q, 0))
    needed = np.maximum(lengths - Q + 1 - Q * budgets, 1)
    codes, item, offset = [], [], []
    for i, data in enumerate(items):
        if len(data) >= MIN_BYTES:
            own = qgram_codes(np.frombuffer(data, dtype=np.uint8))
            codes.append(own)
            item.append(np.full(len(own), i, dtype=np.int64))
            offset.append(np.arange(len(own), dtype=np.int64))
    empty = [np.empty(0, dtype=np.int64)]
    all_codes = np.concatenate(codes or [np.empty(0, dtype=np.uint64)])
    order = np.argsort(all_codes, kind="stable")
    unique, first = np.unique(all_codes[order], return_index=True)
    present = np.zeros(1 << 22, dtype=bool)
    present[slots(unique)] = True
    starts = np.append(first, len(order))
    return Index(items, budgets, needed, present, unique, starts, np.concatenate(item or empty)[order], np.concatenate(offset or empty)[order])


def shared_places(data: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, item, offset) of every q-gram that the data share with an item."""
    places, items, offsets = [], [], []
    for at in range(0, max(len(data) - Q + 1, 0), STEP):
        codes = qgram_codes(data[at : at + STEP + Q - 1])
        hit = np.flatnonzero(index.present[slots(codes)])
        own = codes[hit]
        where = np.searchsorted(index.codes, own)
        where[where == len(index.codes)] = 0
        good = index.codes[where] == own
        hit, where = hit[good], where[good]
        n = index.starts[where + 1] - index.starts[where]
        total = int(n.sum())
        posting = np.arange(total) + np.repeat(index.starts[where] - np.cumsum(n) + n, n)
        places.append(np.repeat(hit + at, n))
        items.append(index.item[posting])
        offsets.append(index.offset[posting])
    if not places:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(places), np.concatenate(items), np.concatenate(offsets)


def least_distance(item: bytes, window: bytes, free_start: bool) -> tuple[int, int]:
    """Least edit distance of the whole item to a part of the window, and where that part first ends.

    One column of the alignment is two numbers whose bits say where the distances go up and down along the item.
    With ``free_start`` the part may begin anywhere, else it begins with the window.
    """
    rows: dict[int, int] = {}
    for i, symbol in enumerate(item):
        rows[symbol] = rows.get(symbol, 0) | (1 << i)
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, distance, carry = full, 0, len(item), 0 if free_start else 1
    best, end = distance, 0
    for j, symbol in enumerate(window, 1):
        same = rows.get(symbol, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        right_up, right_down = down | (full & ~(across | up)), up & across
        distance += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1 | carry) & full, (right_down << 1) & full
        up, down = right_down | (full & ~(vertical | right_up)), right_up & vertical
        if distance < best:
            best, end = distance, j
    return best, end


def align(item: bytes, window: bytes, budget: int) -> tuple[int, int, int]:
    """Least edit distance of the item to a part of the window, and that part where it is within the budget."""
    at = window.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    distance, end = least_distance(item, window, free_start=True)
    if distance > budget:
        return distance, 0, 0
    _, length = least_distance(item[::-1], window[max(end - len(item) - budget, 0) : end][::-1], free_start=False)
    return distance, end - length, end


def regions(docs: list[bytes], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """Per document the (item, start, end, distance) of its regions, places in the reduced text."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
    if not len(index.codes) or not docs:
        return found
    data = np.frombuffer(b"\0".join(docs), dtype=np.uint8)
    starts = np.cumsum([0] + [len(d) + 1 for d in docs[:-1]])
    place, item, offset = shared_places(data, index)
    if not len(place):
        return found
    doc = np.searchsorted(starts, place, side="right") - 1
    step = np.maximum(2 * index.budgets[item], 1)
    shift = int(index.offset.max()) + 1
    band = (place - offset + shift) // step
    width = len(data) + shift + 2
    key = (doc * len(index.items) + item) * width + band
    # a place counts for its own band and for the one before, which covers it too
    both = np.concatenate([key, key - 1])
    order = np.argsort(both, kind="stable")
    keys, first, counts = np.unique(both[order], return_index=True, return_counts=True)
    owner = keys // width
    for k in np.flatnonzero(counts >= index.needed[owner % len(index.items)]):
        d, i, b = int(owner[k] // len(index.items)), int(owner[k] % len(index.items)), int(keys[k] % width)
        # the lemma's q-grams have places and offsets of their own
        own = order[first[k] : first[k] + counts[k]] % len(place)
        if min(len(np.unique(place[own])), len(np.unique(offset[own]))) < index.needed[i]:
            continue
        e, m = int(index.budgets[i]), len(index.items[i])
        s = max(2 * e, 1)
        low = b * s - shift - int(starts[d])
        begin, stop = max(low - e, 0), low + 2 * s + m + e
        distance, left, right = align(index.items[i], docs[d][begin:stop], e)
        if distance <= e:
            found[d].append((i, begin + left, begin + right, distance))
    return [apart(x) for x in found]


def apart(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of regions of one item that overlap, the one with the least distance, then the first."""
    out: list[tuple[int, int, int, int]] = []
    for i, first, last, distance in sorted(set(spans), key=lambda s: (s[0], s[3], s[1])):
        if all(i != j or last <= a or first >= b for j, a, b, _ in out):
            out.append((i, first, last, distance))
    return sorted(out, key=lambda s: (s[1], s[0]))


def original_span(text: str, short: bytes, first: int, last: int) -> tuple[int, int]:
    """Characters of the text that hold the words of a region of the reduced text."""
    from itertools import islice

    word, more = short[:first].count(b" "), short[first:last].strip().count(b" ")
    if short[first : first + 1] == b" ":
        word += 1
    words = list(islice(WORD.finditer(text), word, word + more + 1))
    return words[0].start(), words[-1].end()


def search(index_of_block):
    """Each text's regions of the items of one block. Texts go through in groups of about ``STEP`` bytes."""

    def run(texts: pd.Series) -> pd.Series:
        index, out, group, size = index_of_block.value, [], [], 0

        def flush() -> None:
            for (text, short), spans in zip(group, regions([g[1] for g in group], index)):
                out.append([
                    dict(zip(("item", "first", "last", "distance"), (i, *original_span(text, short, a, b), distance)))
                    for i, a, b, distance in spans
                ])

        for text in texts:
            short = reduced(text)
            if group and size + len(short) > STEP:
                flush()
                group, size = [], 0
            group.append((text, short))
            size += len(short)
        flush()
        return pd.Series(out, dtype=object)

    return pandas_udf(run, HITS)


def blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> list[list]:
    """Lazily, the benchmark's (id, text) rows in blocks; a hash deals them, so that none grows with the table."""
    items = benchmark.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).filter("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()


def contaminated_regions(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per region: id, item_id, start and end (characters of the text, end excluded), distance."""
    spark = docs.sparkSession
    bounded_batches(spark)
    item_type = benchmark.schema[item_column].dataType
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    out = spark.createDataFrame([], "id long, item_id long, start int, end int, distance int").select(
        F.col("id").cast(docs.schema[id_column].dataType), F.col("item_id").cast(item_type), "start", "end", "distance"
    )
    for block in blocks(benchmark, item_column, item_text_column, block_bytes):
        index = spark.sparkContext.broadcast(build_index([r.text for r in block]))
        # as many names as the block has items
        names = spark.createDataFrame([(k, r.id) for k, r in enumerate(block)], "item int, item_id string")
        hits = rows.select("id", F.explode(search(index)("text")).alias("h")).select("id", "h.*")
        named = hits.join(names, "item").select(
            "id", F.col("item_id").cast(item_type).alias("item_id"), F.col("first").alias("start"), F.col("last").alias("end"), "distance"
        )
        out = out.unionByName(named)
    return out.withColumnRenamed("id", id_column)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The documents without a region of any item, in the columns of the input."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out, name = docs, fresh(docs, "_regions")
    for block in blocks(benchmark, item_column, item_text_column, BLOCK_BYTES):
        index = spark.sparkContext.broadcast(build_index([r.text for r in block]))
        out = out.withColumn(name, search(index)(text_of(text_column))).filter(F.size(name) == 0).drop(name)
    return out
