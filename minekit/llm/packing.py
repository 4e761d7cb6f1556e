"""Best-fit packing of token sequences, certified by lower bounds and repaired by exchange.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to groups of bounded size; each
group is packed by best-fit decreasing in one task, and dual feasible functions over its piece lengths
gives a number of bins that no packing can undercut. A group that meets its bound is certified. The bins with
room in the other groups, and the poorly filled rests of any group, give their pieces back; these are dealt
to fewer groups and packed again, and the new packing counts where it takes fewer bins. This goes on until
all bins together meet the bound of the whole table or an exchange saves nothing.

Defined cases: a null or empty text is the closing id alone; every row is packed, repeated ones and null
ids too; equal lengths are packed in the order of their numbers, so ties change no count; an empty table
gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from minekit.llm.common import bounded_batches, cut, text_of
from minekit.llm.encoder import blocks, default_path, encoder

CAPACITY, CLOSING_ID = 4096, 1
#: Pieces of a group on average: a few MB in a task.
GROUP_ROWS = 40_000
#: Bins filled less than this share take part in an exchange also where their group meets its bound.
RESTS = 0.9
PIECE_SCHEMA = "id string, piece int, start long, length long, ids_crc32 long"
PIECE_TYPES = {"id": pa.string(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
PACKED_SCHEMA = PIECE_SCHEMA + ", bin_group long, bin long, offset long, fill long, certified boolean"


def cut_pieces(path: str, capacity: int, closing_id: int):
    closing = int(closing_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for block in blocks(batches, "text"):
            ids, ends = known.ids_of_block(block["text"])
            rows = []
            for key, first, end in zip(block["id"].to_pylist(), [0, *ends], ends):
                data = ids[first:end].tobytes() + closing
                for piece, at in enumerate(range(0, len(data), capacity * 4)):
                    part = data[at : at + capacity * 4]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch([pa.array(values, kind) for values, kind in zip(zip(*rows), PIECE_TYPES.values())], names=list(PIECE_TYPES))

    return run


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest value that a family of dual feasible functions gives."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    # step functions: a size counts floor((k + 1) x) / k, or x itself where (k + 1) x is whole
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        even = scaled % capacity == 0
        twice = np.where(even, k * sizes, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * twice).sum()) // (k * capacity)))
    # threshold functions: sizes over capacity - t count as a whole bin, sizes under t as nothing
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    for t in range(1, half + 1):
        large = number[capacity] - number[capacity - t]
        middle = number[capacity - t] - number[half] if capacity - t > half else 0
        middle_volume = volume[capacity - t] - volume[half] if capacity - t > half else 0
        small_volume = volume[half] - volume[t - 1]
        room = middle * capacity - middle_volume
        best = max(best, int(large + middle + max(0, -(-(int(small_volume) - int(room)) // capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin; the longest first, each into the tightest bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: some bin has room r
    fill: list[int] = []
    for at, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, place = capacity, used
            used += 1
            fill.append(0)
        bins[at], offsets[at] = place, capacity - room
        fill[place] += size
        room -= size
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(place)
    return bins, offsets, np.array(fill, dtype=np.int64)


def pack_group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "piece", "id"], ascending=[False, True, True, True], kind="stable")
        lengths = group["length"].to_numpy(dtype=np.int64)
        bins, offsets, fill = best_fit(lengths, capacity)
        group = group.assign(bin=bins, offset=offsets, fill=fill[bins], certified=len(fill) <= lower_bound(lengths, capacity))
        return group[[c.split()[0] for c in PACKED_SCHEMA.split(", ")]]

    return run


def dealt(pieces: DataFrame, groups: int, round_: int) -> DataFrame:
    """Deal pieces evenly; the row's own number keeps repeated rows from meeting in one group."""
    number = F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups))
    return pieces.withColumn("bin_group", number + F.lit(round_ << 32))


def packed_rounds(pieces: DataFrame, capacity: int, group_rows: int) -> DataFrame | None:
    # at most one count for each length up to the capacity
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    n, least = sum(counts.values()), bound_of_counts(np.array([counts.get(i, 0) for i in range(capacity + 1)], dtype=np.int64), capacity)
    todo, round_, settled, done, before, old = pieces, 0, 0, [], None, 0
    while True:
        groups = -(-n // group_rows)
        grouped = dealt(todo, groups, round_).repartition(groups, "bin_group").groupBy("bin_group")
        packed = cut(grouped.applyInPandas(pack_group(capacity), PACKED_SCHEMA))
        bins = packed.filter("offset = 0").count()
        if before is not None and bins >= old:
            done.append(before)
            break
        # what may still gain: bins with room in groups above their bound, and rests that a group of its own can't avoid
        loose = (~F.col("certified") & (F.col("fill") < capacity)) | (F.col("fill") < capacity * RESTS)
        before = packed.filter(loose)
        n, old = before.count(), before.filter("offset = 0").count()
        if groups == 1 or settled + bins <= least or n == 0:
            done.append(packed)
            break
        done.append(packed.filter(~loose))
        settled += bins - old
        todo, round_ = before.select("id", "piece", "start", "length", "ids_crc32"), round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    closing_id: int = CLOSING_ID,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).cast("string").alias("id"), text_of(text_column).alias("text"))
    pieces = cut(rows.mapInArrow(cut_pieces(path, capacity, closing_id), PIECE_SCHEMA))
    packed = packed_rounds(pieces, capacity, group_rows)
    if packed is None:
        packed = docs.sparkSession.createDataFrame([], PACKED_SCHEMA)
    # a group holds fewer than 2**20 bins; groups of later rounds have numbers of their own
    sequence = F.shiftleft(F.shiftright(F.col("bin_group"), 32), 56) + F.shiftleft(F.col("bin_group").bitwiseAND(0xFFFFFFFF), 24) + F.col("bin")
    return packed.select(
        F.col("id").cast(id_type).alias(id_column), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", "certified"
    )
