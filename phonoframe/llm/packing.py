"""Packing by concatenate and cut.

All token ids stand in one imaginary stream: partition by partition, documents
in the order in which a partition read them. The first pass tokenises, keeps
the ids and notes where a document starts within its partition. A prefix sum
over the partition totals (one row per partition) turns that into global
offsets; the second pass cuts the stream at multiples of the window.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoframe.llm.common import binary_rows, kept, slices, table, utf8, written

WINDOW = 4096
END_ID = 2
#: Different words, and their bytes, that a Python worker remembers; beyond that it starts afresh.
CACHED_WORDS, CACHED_BYTES = 450_000, 16 << 20
#: Words of letters (ASCII or Latin-1, as UTF-8) and ASCII marks after them or none.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]{0,8})")
#: Bytes of text encoded at once, and new words per call of the tokenizer.
_SLICE, _CALL = 1 << 20, 4000


class Numbers(dict):
    """Words by number; one that is asked for first gets the next number and is listed as new."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordIds:
    """Ids of whole texts for a tokenizer that drops white space and never joins words across it.

    The ids of a text are then those of its words one after the other, and each
    different word is encoded once. Where the vocabulary marks the ends of words
    and ignores case, letters and a final mark are units of their own, so that
    "Word" and "word," share one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        ids = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        # Other tokenizers (of bytes with their leading space, say) aren't sums of words.
        for text in ("one  two\nthree", "Ab, cd. é\tx1", "a-b 12 c'd"):
            if ids(text) != list(chain.from_iterable(ids(w) for w in text.split())):
                raise ValueError(f"{path} doesn't encode words apart from each other")
        self.parts = bool(suffix) and all(ids(f"Abcé{m} xyz") == ids("abcé") + ids(m) + ids("XYZ") for m in (",", ".", "***", "'"))
        self.forget()

    def forget(self) -> None:
        #: word -> number; unit of its letters and of its mark (0: nothing). unit -> number; ids back to back.
        self.code = Numbers()
        self.held = 0
        self.word_units = np.zeros((0, 2), np.int64)
        self.units: dict[bytes, int] = {b"": 0}
        self.sizes, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def add_units(self, units: list[bytes], plain: bool) -> None:
        """New units, joined by spaces; their tokens are told apart by marked ends (plain letters) or by where they start."""
        sizes, flat = [self.sizes], [self.flat]
        for i in range(0, len(units), _CALL):
            some = [w.decode() for w in units[i : i + _CALL]]
            if plain:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                sizes.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
                if len(sizes[-1]) != len(some):
                    raise ValueError("a word of letters isn't one unit of the tokenizer")
            else:
                got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                starts = np.cumsum([0] + [len(w) + 1 for w in some])
                at = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
                ids = np.array(got.ids, np.uint32)
                sizes.append(np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(some)))
            flat.append(ids)
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units)), strict=True))
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)

    def learn(self) -> None:
        """Units of the words that are new."""
        words, self.code.new = self.code.new, []
        self.held += sum(map(len, words))
        match = PLAIN.fullmatch if self.parts else lambda w: None
        found = list(map(match, words))
        first = [m[1].lower() if m else w for m, w in zip(found, words, strict=True)]
        mark = [m[2] if m else b"" for m in found]
        letters = {u for u, m in zip(first, found, strict=True) if m}
        self.add_units(list(letters.difference(self.units)), True)
        self.add_units(list(set(first).union(mark).difference(self.units)), False)
        n = len(words)
        units = np.stack([np.fromiter(map(self.units.__getitem__, x), np.int64, n) for x in (first, mark)], 1)
        self.word_units = np.concatenate([self.word_units, units])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and where each text begins (n + 1 numbers)."""
        gc.disable()  # millions of small objects, no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))  # empty words, at the ends of a text, have no ids
        words = split.values.dictionary_encode()
        if len(self.code) > CACHED_WORDS or self.held > CACHED_BYTES:
            self.forget()
        n_words = np.diff(split.offsets)
        different = words.dictionary.cast(pa.binary()).to_pylist()
        codes = np.fromiter(map(self.code.__getitem__, different), np.int64, len(different))[words.indices.to_numpy()]
        if self.code.new:
            self.learn()
        units = self.word_units[codes].ravel()
        sizes, starts = self.sizes[units], (np.cumsum(self.sizes) - self.sizes)[units]
        unit_at = np.concatenate([[0], np.cumsum(sizes)])
        text_at = 2 * np.concatenate([[0], np.cumsum(n_words)])
        cuts = unit_at[text_at] + np.arange(len(texts) + 1)
        out = np.full(int(cuts[-1]), END_ID, np.uint32)
        keep = np.ones(len(out), bool)
        keep[cuts[1:] - 1] = False
        out[keep] = self.flat[np.arange(unit_at[-1]) + np.repeat(starts - unit_at[:-1], sizes)]
        return out, cuts


def word_ids(path: str) -> WordIds:
    """One per Python worker, which serves many tasks."""
    return kept(f"words {path}", lambda: WordIds(path))


def tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """part, start (within the part), doc_id, doc_tokens and ids (little-endian unsigned 32-bit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for i, j in slices(at, _SLICE):
                ids, cuts = words.encode([raw[at[k] : at[k + 1]].tobytes() for k in range(i, j)])
                yield pa.record_batch(
                    [pa.array(np.full(j - i, part, np.int64)), pa.array(start + cuts[:-1]), batch.column(0).slice(i, j - i), pa.array(np.diff(cuts)), binary_rows(ids, cuts)],
                    names=["part", "start", "doc_id", "doc_tokens", "ids"],
                )
                start += int(cuts[-1])

    return docs.select("doc_id", "text").mapInArrow(run, "part long, start long, doc_id long, doc_tokens long, ids binary")


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces of every document; `tokens` as `tokenised` returns it, written."""
    totals = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("doc_tokens")).alias("total"))
    # One row per partition of the input: a bound that the number of files sets, not the rows.
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before")).fillna(0, ["before"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(0).to_numpy()
            n = batch.column(2).to_numpy()
            last = first + n - 1
            pieces = last // window - first // window + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[doc] // window + k
            start = np.maximum(seq * window, first[doc]) - first[doc]
            end = np.minimum((seq + 1) * window, first[doc] + n[doc]) - first[doc]
            ids = batch.column(3)
            crc, at, view = np.empty(len(doc), np.int64), -1, memoryview(b"")
            for i, (d, s, e) in enumerate(zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)):
                if d != at:
                    at, view = d, memoryview(ids[d].as_buffer())
                crc[i] = zlib.crc32(view[4 * s : 4 * e])
            yield pa.record_batch(
                [batch.column(1).take(pa.array(doc)), pa.array(start), pa.array(end - start), pa.array(crc), pa.array(n[doc]), pa.array(seq), pa.array(first[doc] + start - seq * window)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    stream = tokens.join(F.broadcast(before), "part").select((F.col("before") + F.col("start")).alias("first"), "doc_id", "doc_tokens", "ids")
    return stream.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, END_ID alone. Documents without tokens
    don't exist, so every row appears; repeated rows are packed one by one; an
    empty table gives no pieces. Only the last sequence of all is not full.
    """
    return cut(written(tokenised(docs, tokenizer_path), "packing"), window)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer_path: Callable[[], str] = default_tokenizer) -> DataFrame:
    """All documents in sequences of 4096 tokens (the contract of ``packed``)."""
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
