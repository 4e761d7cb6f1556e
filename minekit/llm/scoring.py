"""Language-model scores from a weighted backoff automaton over n-grams of a given order.

A state is a history of up to ``order - 1`` tokens that training has seen; the root is the empty one, and a text
starts in the state of the end mark. An n-gram ``h w`` seen in training is an arc from the state ``h`` with the
smoothed probability ``(c(h w) + mass * p(w | h')) / (c(h) + mass)``, where ``h'`` is ``h`` without its first token; it
leads to the longest state that ends the n-gram. Any other word is read over the state's failure arc, which weighs
``mass / (c(h) + mass)`` and leads to the state ``h'``, and so on down to the root, where ``p(w) = (c(w) + 1) / (N + V
+ 1)``. Over all words, a spare one for the unknown included, the probabilities of a state add up to one.

A text is read once from left to right. The state carried into a place is the longest one that the arc before it
ends with, so the states of all places of a block are laid out along its texts as one array; places whose state
lacks the arc then follow failure arcs, together, one step at a time.

The counts are those of the whole training part and so grow with it; no task holds them all. Documents are dealt to
blocks of bounded text. A block lists its distinct n-grams with its own training counts, in parts by hash; each
part adds up the counts of all blocks and sends back what the other blocks add to each n-gram, in the order of the
block's list and so without the keys. With these, the block builds the part of the automaton that its texts can
reach, and scores them.

Defined cases: a null or empty text is the end mark alone; a null id is in the training part; repeated rows are
counted and scored each; without training rows N and V are 0 and every probability is that of an unknown word; an
empty table gives no rows; further columns are not read; a text longer than a block makes a block of its own size.
N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import bounded_batches, remainder, text_of
from minekit.llm.words import ODD_A, hashed_words, mixed

#: Strength of the unigram prior, in tokens.
MASS = 400.0
#: Characters of a block, and hashed n-grams of a part at two for each token, both on average.
BLOCK_CHARS, PART_KEYS = 10_000_000, 2_000_000
END = np.uint64(0xE0D0F7E870000001)
WORD_SALT, PAIR_SALT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def token_hashes(text: str) -> np.ndarray:
    return np.append(hashed_words(text), END)


def keys_of(tokens: np.ndarray, places: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of each length that end at every token; a document starts after one end mark.

    ``places`` are the tokens' places in their documents. The n-gram of length k is there from place ``k - 2`` on.
    """
    keys = [mixed(tokens ^ WORD_SALT)]
    with np.errstate(over="ignore"):
        for _ in range(1, order):
            # the token before a document is the end mark of the one before
            first = mixed(np.array([END ^ WORD_SALT])) if len(keys) == 1 else np.zeros(1, dtype=np.uint64)
            before = np.concatenate([first, keys[-1][:-1]])
            keys.append(mixed((before * ODD_A) ^ tokens ^ PAIR_SALT))
    return [key[places >= k - 1] for k, key in enumerate(keys)]


def distinct(keys: np.ndarray) -> np.ndarray:
    # counts make numpy sort, which is many times faster here than its hash table
    return np.unique(keys, return_counts=True)[0]


def split_tokens(docs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, their places in the texts, and whether their text is for training."""
    tokens = [token_hashes(text) for text in docs["text"]]
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.concatenate(tokens)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return flat, places, np.repeat(docs["train"].to_numpy(dtype=bool), lengths)


def distinct_keys(docs: pd.DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block, in order, and how often its training documents have each."""
    flat, places, trained = split_tokens(docs)
    listed = keys_of(flat, places, order)
    learnt, counts = np.unique(np.concatenate([key[trained[places >= k - 1]] for k, key in enumerate(listed)]), return_counts=True)
    keys = distinct(np.concatenate(listed))
    own = np.zeros(len(keys), dtype=np.int64)
    own[np.searchsorted(keys, learnt)] = counts
    return keys, own


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has some of the keys, with the numbers of these keys in order."""
    part = (keys % np.uint64(parts)).astype(np.min_scalar_type(parts))
    order = np.argsort(part, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
    for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > a:
            yield p, order[a:b]


class Block:
    """The n-grams of a block of documents: its distinct keys and how often its training documents have each.

    ``grams[k]`` holds, for every token, the number of the key of the n-gram of ``k + 1`` tokens that ends there, or -1.
    """

    def __init__(self, docs: pd.DataFrame, order: int) -> None:
        flat, self.places, trained = split_tokens(docs)
        self.starts = np.flatnonzero(self.places == 0)
        self.lengths = np.diff(self.starts, append=len(flat))
        listed = keys_of(flat, self.places, order)
        sizes = np.cumsum([len(key) for key in listed])[:-1]
        listed = np.concatenate(listed)
        self.keys, where = np.unique(listed, return_inverse=True)
        del listed
        self.own, self.grams = np.zeros(len(self.keys), dtype=np.int64), []
        for k, key in enumerate(np.split(where, sizes)):
            there = self.places >= k - 1
            self.own += np.bincount(key[trained[there]], minlength=len(self.keys))
            gram = np.full(len(flat), -1, dtype=np.int32)
            gram[there] = key
            self.grams.append(gram)


class Automaton:
    """The states, arcs and failure arcs that the texts of a block can reach; all are numbered like its keys.

    ``arc`` is the log10 probability of the last token of an n-gram after the others, ``failure`` the log10 weight
    of the failure arc of the state that the n-gram is as a history.
    """

    def __init__(self, block: Block, count: np.ndarray, size: int, mass: float) -> None:
        self.block, self.count = block, count
        self.failure = mass / (count + mass)
        np.log10(self.failure, out=self.failure)
        weight = np.empty(len(count))
        words = block.grams[0]
        weight[words] = (count[words] + 1) / size
        for k in range(1, len(block.grams)):
            at = np.flatnonzero(block.grams[k] >= 0)
            gram, shorter, history = block.grams[k][at], block.grams[k - 1][at], self.history(k)[at]
            weight[gram] = (count[gram] + mass * weight[shorter]) / (count[history] + mass)
        self.arc = np.log10(weight, out=weight)

    def history(self, length: int) -> np.ndarray:
        """The key of the ``length`` tokens before every token, or -1; a document starts after one end mark."""
        gram, block = self.block.grams[length - 1], self.block
        # every document ends with the end mark, so the last token is one
        before = np.concatenate([gram[-1:], gram[:-1]])
        return before if length == 1 else np.where(block.places > 0, before, -1)

    def scores(self) -> np.ndarray:
        """Of every token, the log10 weight of the arcs that read it."""
        grams, block = self.block.grams, self.block
        order = len(grams)
        # tokens of the longest n-gram in training that ends at each place, and of the state carried into the place
        matched = np.zeros(len(block.places), dtype=np.int64)
        for k, gram in enumerate(grams):
            matched[(gram >= 0) & (self.count[gram] > 0)] = k + 1
        state = np.minimum(np.concatenate([[0], matched[:-1]]), order - 1)
        state[block.starts] = min(order - 1, int(self.count[grams[0][-1]] > 0))
        out = np.zeros(len(matched))
        for length in range(order - 1, 0, -1):
            # the state lacks the arc: over its failure arc to the next shorter one
            fails = np.flatnonzero((state == length) & (matched <= length))
            out[fails] += self.failure[self.history(length)[fails]]
            state[fails] = length - 1
        for length in range(order):
            reads = np.flatnonzero(state == length)
            out[reads] += self.arc[grams[length][reads]]
        return out


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeezed_texts(texts: pd.Series) -> pd.Series:
    """Texts as they go to their blocks, in fewer bytes than the exchange itself would take."""
    return texts.map(lambda text: squeezed(text.encode()))


def with_texts(docs: pd.DataFrame) -> pd.DataFrame:
    return docs.assign(text=docs["text"].map(lambda data: opened(data).decode()))


def shortened(values: np.ndarray) -> bytes:
    """The bytes of numbers without the leading zero bytes that all have; bytes of one rank stand together."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    table = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return squeezed(bytes([width]) + table.T.tobytes())


def lengthened(data: bytes) -> np.ndarray:
    data = opened(data)
    width, table = data[0], np.frombuffer(data, dtype=np.uint8, offset=1)
    out = np.zeros((len(table) // width, 8), dtype=np.uint8)
    out[:, :width] = table.reshape(width, -1).T
    return out.view("<u8").ravel()


def packed_keys(keys: np.ndarray, parts: int) -> bytes:
    """Sorted keys of one part as the steps between them; their remainder is the part's number."""
    return shortened(np.diff(keys // np.uint64(parts), prepend=np.uint64(0)))


def unpacked_keys(data: bytes, part: int, parts: int) -> np.ndarray:
    return np.cumsum(lengthened(data), dtype=np.uint64) * np.uint64(parts) + np.uint64(part)


def packed_counts(counts: np.ndarray) -> bytes:
    return shortened(counts)


def unpacked_counts(data: bytes) -> np.ndarray:
    return lengthened(data).astype(np.int64)


def listed(parts: int, order: int):
    def run(docs: pd.DataFrame) -> pd.DataFrame:
        number, (keys, counts) = int(docs["block"].iloc[0]), distinct_keys(with_texts(docs), order)
        rows = [(p, number, packed_keys(keys[own], parts), packed_counts(counts[own])) for p, own in by_part(keys, parts)]
        return pd.DataFrame(rows, columns=["part", "block", "keys", "counts"])

    return run


def added_up(parts: int):
    """What the other blocks add to each key of a block, in the order of its list."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        keys = [unpacked_keys(k, part, parts) for k in group["keys"]]
        counts = [unpacked_counts(c) for c in group["counts"]]
        ends = np.cumsum([len(k) for k in keys])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, np.concatenate(counts)).astype(np.int64)[where]
        rows = [(int(block), part, packed_counts(totals[end - len(own) : end] - own)) for block, own, end in zip(group["block"], counts, ends)]
        return pd.DataFrame(rows, columns=["of", "part", "more"])

    return run


def scored(train_tokens: int, train_words: int, mass: float, parts: int, order: int):
    size = train_tokens + train_words + 1

    def run(docs: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if docs.empty:
            return pd.DataFrame(columns=columns)
        block, more = Block(with_texts(docs), order), dict(zip(others["part"], others["more"]))
        count = block.own
        for part, own in by_part(block.keys, parts):
            count[own] += unpacked_counts(more[part])
        words = count[block.grams[0]]
        return pd.DataFrame({
            "id": docs["id"], "held_out": docs["held_out"], "n_tokens": block.lengths,
            "n_known": np.add.reduceat((words > 0).astype(np.int64), block.starts),
            "base_score": np.add.reduceat(np.log10((words + 1) / size), block.starts),
            "score": np.add.reduceat(Automaton(block, count, size, mass).scores(), block.starts),
        })

    return run


def distinct_words(parts: int):
    """Distinct word keys of a task, by part, and its tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, tokens, waiting, size = np.empty(0, dtype=np.uint64), 0, [], 0
        for batch in batches:
            for text in batch["text"]:
                words = np.append(hashed_words(text), END)
                tokens += len(words)
                waiting.append(words)
                size += len(words)
            if size > PART_KEYS:
                seen, waiting, size = distinct(np.concatenate([seen, *waiting])), [], 0
        seen = distinct(np.concatenate([seen, *waiting]))
        part = (seen % np.uint64(parts)).astype(np.int64)
        rows = [(p, packed_keys(seen[part == p], parts), 0) for p in np.unique(part).tolist()]
        rows.append((0, packed_keys(seen[:0], parts), tokens))
        yield pd.DataFrame(rows, columns=["part", "keys", "tokens"])

    return run


def union_size(parts: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked_keys(k, int(p), parts) for p, k in zip(group["part"], group["keys"])]
        return pd.DataFrame({"words": [len(distinct(np.concatenate(keys)))], "tokens": [int(group["tokens"].sum())]})

    return run


def language_model_scores(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", mass: float = MASS, block_chars: int = BLOCK_CHARS,
    part_keys: int = PART_KEYS, order: int = 2,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type, text = docs.schema[id_column].dataType, text_of(text_column)
    chars = docs.agg(F.sum(F.length(text).cast("long") + 1)).first()[0] or 0
    # words have some six characters, and hardly more than one n-gram of each length is new to its block at a token
    blocks, parts = max(1, -(-chars // block_chars)), max(1, -(-chars * order // (12 * part_keys)))
    held_out = remainder(id_column, 7) == 2
    train = docs.filter(~held_out).select(text.alias("text"))
    words = train.mapInPandas(distinct_words(parts), "part int, keys binary, tokens long")
    rows = docs.select(
        F.col(id_column).cast("string").alias("id"), held_out.alias("held_out"), (~held_out).alias("train"), pandas_udf(squeezed_texts, "binary")(text).alias("text"),
        F.pmod(F.xxhash64(id_column, text_column), F.lit(blocks)).cast("int").alias("block"),
    )
    size = words.groupBy("part").applyInPandas(union_size(parts), "words long, tokens long").agg(F.sum("words"), F.sum("tokens")).first()
    train_words, train_tokens = (size[0] or 0), (size[1] or 0)
    lists = rows.groupBy("block").applyInPandas(listed(parts, order), "part int, block int, keys binary, counts binary")
    others = lists.groupBy("part").applyInPandas(added_up(parts), "of int, part int, more binary")
    schema = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = rows.groupBy("block").cogroup(others.groupBy("of")).applyInPandas(scored(train_tokens, train_words, mass, parts, order), schema)
    return out.select(
        F.col("id").cast(id_type).alias(id_column), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
