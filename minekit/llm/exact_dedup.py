"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text is cut into chunks; each chunk gets two polynomial hashes and the powers by which they shift what
stands before them. Chunks of one huge document are dealt out to different tasks and combine in any
grouping: ``hash(ab) = hash(a) * base**len(b) + hash(b)``. Texts whose fingerprint occurs more than once are
then compared: rows meet by (quick key, chunk number), and a chunk is the same everywhere when its least and
greatest text agree. Both are combined before the shuffle, so a hot group sends one row per task and chunk.
Groups in which a chunk differs are told apart by SHA-256.

Defined cases: a null text counts as empty, and empty texts are equal to each other; of rows with equal
text and equal id one stays; a null id is smaller than any other; an empty table gives no rows; further
columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import LOWER, UPPER, bounded_batches, cut, fresh, text_of

#: Primes below 2**31, so that a product of two remainders fits a long, and the bases.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_566_083_941)
#: Characters of a chunk. At most 4 bytes each: 2**20 terms below 2**39 stay under 2**64.
CHUNK = 262_144


def normalised(column: str) -> Column:
    return F.translate(text_of(column), UPPER, LOWER)


@functools.cache
def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n-1), ..., base, 1 modulo prime."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime), out])
    return out[-n:]


def chunk_hash(data: bytes, base: int, prime: int) -> int:
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    table = powers(base, prime, 1 << max(10, (max(len(values), 1) - 1).bit_length()))
    return int(np.dot(values, table[len(table) - len(values) :]) % np.uint64(prime))


HASHED = "n_bytes long, hash_a long, shift_a long, hash_b long, shift_b long, digest binary"


def hash_rows(texts: pd.Series) -> pd.DataFrame:
    """Per text or chunk, after lower-casing A-Z: bytes, two polynomial hashes with their powers, and the SHA-256 digest."""
    rows = []
    for text in texts:
        # bytes.lower() changes A-Z alone
        data = text.encode().lower()
        row = [len(data)]
        for base, prime in zip(BASES, PRIMES):
            row += [chunk_hash(data, base, prime), pow(base, len(data), prime)]
        rows.append((*row, hashlib.sha256(data).digest()))
    return pd.DataFrame(rows, columns=["n_bytes", "hash_a", "shift_a", "hash_b", "shift_b", "digest"])


def fingerprint(text: str) -> Column:
    return pandas_udf(hash_rows, HASHED)(text)


def chunks_of(text: Column, size: int) -> Column:
    """The chunks of a text, in order; an empty text has one empty chunk."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(size)) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def combine(parts: Column, which: str, prime: int) -> Column:
    """Fold the chunk hashes of a document in chunk order."""
    return F.aggregate(
        parts,
        F.lit(0).cast("long"),
        lambda left, part: (left * part[f"shift_{which}"] + part[f"hash_{which}"]) % prime,
    )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row, written once: row, id, quick, n_bytes, print_a, print_b and the SHA-256 digest.

    ``quick`` is a 64-bit key that equal texts share. A text of one chunk is hashed where it is read. The
    chunks of longer ones are dealt out by (row, chunk), so that one huge document is hashed by many tasks;
    its digest is computed where it is read, as SHA-256 does not combine.
    """
    bounded_batches(docs.sparkSession)
    text = text_of(text_column)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), quick_key(text).alias("quick"), text.alias("text"))
    short = rows.filter(F.length("text") <= chunk).withColumn("part", fingerprint("text"))
    short = short.select(
        "row", "id", "quick", "part.digest", "part.n_bytes", F.col("part.hash_a").alias("print_a"), F.col("part.hash_b").alias("print_b")
    )
    long = rows.filter(F.length("text") > chunk)
    digest = F.unhex(F.sha2(F.translate("text", UPPER, LOWER).cast("binary"), 256))
    parts = long.select("row", "id", "quick", digest.alias("digest"), F.posexplode(chunks_of(F.col("text"), chunk)).alias("no", "chunk"))
    hashed = parts.repartition("row", "no").withColumn("part", fingerprint("chunk")).drop("chunk")
    long = (
        hashed.groupBy("row")
        .agg(
            F.first("id").alias("id"),
            F.first("quick").alias("quick"),
            F.first("digest").alias("digest"),
            F.sum("part.n_bytes").alias("n_bytes"),
            F.sort_array(F.collect_list(F.struct("no", "part.hash_a", "part.shift_a", "part.hash_b", "part.shift_b"))).alias("parts"),
        )
        .select(
            "row", "id", "quick", "digest", "n_bytes",
            combine(F.col("parts"), "a", PRIMES[0]).alias("print_a"),
            combine(F.col("parts"), "b", PRIMES[1]).alias("print_b"),
        )
    )
    return cut(short.unionByName(long))


def quick_key(text: Column) -> Column:
    """Equal for texts that are equal after lower-casing A-Z, as they are then also equal in lower case."""
    return F.xxhash64(F.lower(text))


def uneven_keys(docs: DataFrame, repeated: DataFrame, text_column: str, chunk: int) -> DataFrame:
    """Of the ``repeated`` quick keys, those whose texts differ in some chunk or in the number of chunks."""
    rows = docs.select(quick_key(text_of(text_column)).alias("quick"), F.col(text_column)).join(repeated, "quick", "left_semi")
    parts = rows.select("quick", chunks_of(normalised(text_column), chunk).alias("chunks")).select(
        "quick", F.size("chunks").alias("n"), F.posexplode("chunks").alias("no", "chunk")
    )
    compared = parts.groupBy("quick", "no").agg(
        F.min("chunk").alias("least"), F.max("chunk").alias("most"), F.min("n").alias("few"), F.max("n").alias("many")
    )
    return compared.filter((F.col("least") != F.col("most")) | (F.col("few") != F.col("many"))).select("quick").distinct()


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: id, quick, keep_id, group_size, kept, digest."""
    prints = fingerprints(docs, id_column, text_column, chunk)
    # only texts whose key and fingerprint occur twice are read again and compared
    print_key = ["quick", "n_bytes", "print_a", "print_b"]
    repeated = prints.groupBy(*print_key).count().filter("count > 1").select("quick").distinct()
    uneven = uneven_keys(docs, cut(repeated), text_column, chunk).withColumn("uneven", F.lit(True))
    told = prints.join(uneven, "quick", "left").withColumn("apart", F.when(F.col("uneven"), F.col("digest"))).drop("uneven")
    key = [*print_key, "apart"]
    groups = told.groupBy(*key).agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    same = F.lit(True)
    for name in key:
        same = same & (F.col(f"t.{name}").eqNullSafe(F.col(f"g.{name}")) if name == "apart" else F.col(f"t.{name}") == F.col(f"g.{name}"))
    return (
        told.alias("t")
        .join(groups.alias("g"), same)
        .select(
            "t.id", "t.quick", F.col("g.best.id").alias("keep_id"), "g.group_size",
            (F.col("t.row") == F.col("g.best.row")).alias("kept"), "t.digest",
        )
    )


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document, dropped ones too: which of the equal texts stays, the group's size, the digest."""
    return exact_groups(docs, id_column, text_column, chunk).select(
        F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with one row of each group of equal texts, in the columns of the input."""
    digest = fresh(docs, "_digest")
    text = normalised(text_column)
    kept = exact_groups(docs, id_column, text_column).filter("kept").select(F.col("id").alias("_keep"), F.col("digest").alias("_same"))
    rows = docs.withColumn(digest, F.unhex(F.sha2(text.cast("binary"), 256)))
    stays = rows.join(kept, F.col(id_column).eqNullSafe(F.col("_keep")) & (F.col(digest) == F.col("_same")), "left_semi")
    return stays.dropDuplicates([id_column, digest]).select(*docs.columns)
