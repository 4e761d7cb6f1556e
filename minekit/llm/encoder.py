"""The public tokenizer inside tasks, with the words that were met kept in bounded caches.

The tokenizer drops white space and never joins what white space parts: its normaliser, its splitting
pattern, its merges and its special strings all stay inside a run of other characters. So the ids of a
text are the ids of its runs, one after another. Runs are cut at the six ASCII white-space bytes only;
any other white space stays inside a run, where the tokenizer itself treats it.

A run of Latin letters and signs is cut further by the tokenizer's own splitting pattern after lower-casing,
as merges stay inside the parts; many runs share their parts ("Word," and "word"). Only runs for which
lower-casing and composing are plain go this way, all others are encoded as they are.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from minekit.llm.words import held

#: Runs and parts a worker remembers; the older half goes when they are too many.
RUNS, PARTS = 1_200_000, 600_000
#: Bytes of texts whose runs are looked up and learnt together; a longer text goes by itself.
TOGETHER = 8_000_000
#: Fixed value: the mark of a token that ends a word.
WORD_END = "</w>"
#: Fixed value: the splitting pattern in the tokenizer's file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII signs and letters, and the Latin letters of one code point each; the capital I with a dot lower-cases to two.
PLAIN = r"[!-~¡-¬®-įı-ɏ]+"


class Remembered:
    """A map of two halves; what is asked for moves to the newer one."""

    def __init__(self, size: int) -> None:
        self.half, self.newer, self.older = max(size // 2, 1), {}, {}

    def get(self, key):
        found = self.newer.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def get_all(self, keys: list) -> list:
        """The values of many keys, None where one is not known; the newer half is asked in one go."""
        found = list(map(self.newer.get, keys))
        if None in found and self.older:
            older = self.older.get
            for at in [i for i, value in enumerate(found) if value is None]:
                value = older(keys[at])
                if value is not None:
                    # this may let the older half go; what is lost with it is learnt again
                    self.put(keys[at], value)
                    older = self.older.get
                    found[at] = value
        return found

    def among(self, keys: list) -> list:
        """The values of distinct keys, None where one is not known; what only the older half has moves in one go."""
        found = list(map(self.newer.get, keys))
        if self.older:
            older, again = self.older.get, {}
            for at in [i for i, value in enumerate(found) if value is None]:
                value = older(keys[at])
                if value is not None:
                    found[at] = again[keys[at]] = value
            self.put_all(again)
        return found

    def put(self, key, value) -> None:
        if len(self.newer) >= self.half:
            self.older, self.newer = self.newer, {}
        self.newer[key] = value

    def put_all(self, values: dict) -> None:
        """Many at once; the newer half may exceed its size by what comes in one go."""
        if len(self.newer) >= self.half:
            self.older, self.newer = self.newer, {}
        self.newer.update(values)


def blocks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``TOGETHER`` bytes of text; a longer text goes by itself."""
    waiting, size = [], 0
    for batch in batches:
        start = 0
        for at, length in enumerate(pc.binary_length(batch[column]).to_pylist()):
            if size and size + length > TOGETHER:
                waiting.append(batch.slice(start, at - start))
                yield pa.concat_batches(waiting)
                waiting, size, start = [], 0, at
            size += length
        waiting.append(batch.slice(start))
    if sum(batch.num_rows for batch in waiting):
        yield pa.concat_batches(waiting)


class RunEncoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str, runs: int = RUNS, parts: int = PARTS) -> None:
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs, self.parts = Remembered(runs), Remembered(parts)
        # tokens that end a word say so
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith(WORD_END)
        self.split, self.plain = regex.compile(SPLIT).findall, regex.compile(PLAIN).fullmatch

    def ids(self, text: str) -> bytes:
        return next(self.ids_of_all([text]))

    def ids_of_all(self, texts) -> Iterator[bytes]:
        """The ids of each text; what is not known yet is learnt for many texts at once."""
        texts = pa.record_batch({"text": pa.array(texts, pa.large_string())})
        for block in blocks([texts], "text"):
            ids, ends = self.ids_of_block(block["text"])
            for start, end in zip([0, *ends], ends):
                yield ids[start:end].tobytes()

    def ids_of_block(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts one after another, and where those of each text end; each distinct run is looked up once."""
        lists = pc.ascii_split_whitespace(texts)
        runs = lists.flatten().dictionary_encode()
        known = self._known(runs.dictionary.to_pylist())
        ids, lengths = np.frombuffer(b"".join(known), dtype="<u4"), np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        which = runs.indices.to_numpy()
        many = lengths[which]
        ends = np.concatenate([[0], np.cumsum(many)])
        places = np.repeat((np.cumsum(lengths) - lengths)[which] - ends[:-1], many)
        places += np.arange(len(places))
        offsets = lists.offsets.to_numpy()
        return ids[places], ends[offsets[1:] - offsets[0]].tolist()

    def _known(self, runs: list[str]) -> list[bytes]:
        known = self.runs.among(runs)
        missing = [at for at, ids in enumerate(known) if ids is None]
        if missing:
            for at, ids in zip(missing, self._learn([runs[at] for at in missing])):
                known[at] = ids
        return known

    def _learn(self, runs: list[str]) -> list[bytes]:
        single, pieces, others = {}, {}, set()
        # a word of plain letters is one part, in small letters; a sign or digit behind it is another
        for run in runs:
            if run.isalpha() and (run.isascii() or self.plain(run)):
                single[run] = run.lower()
            elif run.isascii() and run[:-1].isalpha() and "!" <= run[-1] <= "~":
                pieces[run] = [run[:-1].lower(), run[-1]]
            elif self.plain(run) and "<|" not in run:
                pieces[run] = self.split(run.lower())
            else:
                single[run] = run
                others.add(run)
        parts = list(set(single.values()).union(*pieces.values()))
        known = dict(zip(parts, self.parts.among(parts)))
        missing = [part for part, ids in known.items() if ids is None]
        words, rest = [part for part in missing if part not in others], [part for part in missing if part in others]
        learnt = dict(zip(words, self._words(words)))
        learnt.update(zip(rest, self._batch(rest)))
        self.parts.put_all(learnt)
        known.update(learnt)
        out = {run: known[part] for run, part in single.items()}
        for run, parts in pieces.items():
            out[run] = b"".join([known[part] for part in parts])
        self.runs.put_all(out)
        return [out[run] for run in runs]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of parts that the splitting pattern leaves whole: encoded as one text, parted at the tokens that end words."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._batch(words)
        data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(encoding.ids, dtype="<u4").tobytes() for encoding in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str) -> RunEncoder:
    """One per worker and file, until the worker goes on to another operator."""
    return held(f"encoder of {path}", lambda: RunEncoder(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
