"""Token ids of documents in Huffman-coded files, written in ascending order of doc_id and read back by block.

A file holds a range of doc_ids. All numbers are little-endian:

    header   MAGIC, u32 number of symbols, u32 each symbol, u8 each code length
    blocks   as ``huffman.encode`` returns them, BLOCK ids each but for the last
    footer   for each block: u64 place, u64 first id, u32 ids, u32 bytes, u32 CRC-32;
             for each document: i64 doc_id, u8 whether it has one, u64 ids
    trailer  u64 ids before the file, u64 blocks, u64 documents, u64 place of the
             footer, u32 CRC-32 of footer and these four, MAGIC

One code, from the counts of all ids of all documents, serves all files. Blocks
are independent, and their checkpoints let a reader begin at any id. Documents
end where the directory says, as the end id may occur in a text too.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm.common import binary_rows, removed_at_exit, scratch_path, table, utf8, written
from phonoframe.llm.huffman import Code, decode
from phonoframe.llm.packing import default_tokenizer, word_ids
from phonoframe.operators import ranges
from phonoframe.operators.grouping import tasks_of

END_ID = 1
MAGIC = b"TOKENS1\n"
#: Ids of a block, and ids that one reading task takes of a file, about.
BLOCK, PART_IDS = 1 << 18, 1 << 23
#: A file holds at least so many documents, about.
LEAST_DOCUMENTS = 500
#: Bytes of text encoded at once; longer texts are cut at white space.
_SLICE = 4 << 20
_BLOCKS = np.dtype([("at", "<u8"), ("first", "<u8"), ("ids", "<u4"), ("bytes", "<u4"), ("crc", "<u4")])
_DOCUMENTS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("ids", "<u8")])
_TRAILER = struct.Struct("<QQQQI8s")
_SPACES = bytes([0x20, *range(0x09, 0x0E)])


class Writer:
    """Writes one file to `out`, holding a block of ids and the directory."""

    def __init__(self, out, code: Code, before: int, block: int = BLOCK):
        self.out, self.code, self.before, self.block = out, code, before, block
        self.blocks: list[tuple] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.at = 0
        self._write(MAGIC + struct.pack("<I", len(code.symbols)) + code.symbols.astype("<u4").tobytes() + code.lengths.tobytes())

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def document(self, doc_id: int | None) -> None:
        """The ids that follow belong to a new document."""
        self.doc_ids.append(doc_id)
        self.sizes.append(0)

    def add(self, ids: np.ndarray) -> None:
        self.sizes[-1] += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._write_block(ids[i : i + self.block])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _write_block(self, ids: np.ndarray) -> None:
        raw = self.code.encode(ids)
        self.blocks.append((self.at, self.n_ids, len(ids), len(raw), zlib.crc32(raw)))
        self._write(raw)
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.n_held:
            self._write_block(np.concatenate(self.held))
        directory = np.zeros(len(self.sizes), _DOCUMENTS)
        directory["doc_id"] = [x or 0 for x in self.doc_ids]
        directory["known"] = [x is not None for x in self.doc_ids]
        directory["ids"] = self.sizes
        at, footer = self.at, np.array(self.blocks, _BLOCKS).tobytes() + directory.tobytes()
        numbers = (self.before, len(self.blocks), len(directory), at)
        self._write(footer)
        self._write(_TRAILER.pack(*numbers, zlib.crc32(footer + struct.pack("<QQQQ", *numbers)), MAGIC))


class Reader:
    """One file through read(offset, length) and its size. ValueError for what isn't such a file, or is damaged."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        if size < _TRAILER.size:
            raise ValueError("no token file")
        *numbers, crc, magic = _TRAILER.unpack(read(size - _TRAILER.size, _TRAILER.size))
        self.before, n_blocks, n_docs, at = numbers
        footer = read(at, size - _TRAILER.size - at) if at <= size else b""
        if magic != MAGIC or crc != zlib.crc32(footer + struct.pack("<QQQQ", *numbers)):
            raise ValueError("no token file, or its footer is damaged")
        self.blocks = np.frombuffer(footer, _BLOCKS, n_blocks)
        self.documents = np.frombuffer(footer, _DOCUMENTS, n_docs, n_blocks * _BLOCKS.itemsize)
        self.starts = np.concatenate([[0], np.cumsum(self.documents["ids"].astype(np.int64))])
        head = read(0, len(MAGIC) + 4)
        n = struct.unpack_from("<I", head, len(MAGIC))[0]
        raw = read(len(head), 5 * n)
        self.code = Code(np.frombuffer(raw, "<u4", n), np.frombuffer(raw, np.uint8, n, 4 * n))
        self.table = self.code.table()

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids start to start + n of the file, block by block; only blocks and lanes that hold them are decoded."""
        first = self.blocks["first"].astype(np.int64)
        for k in range(int(np.searchsorted(first, start, "right")) - 1, int(np.searchsorted(first, start + n))):
            b = self.blocks[k]
            raw = self.read(int(b["at"]), int(b["bytes"]))
            if zlib.crc32(raw) != b["crc"]:
                raise ValueError("a block is damaged")
            low, high = max(0, start - int(first[k])), min(int(b["ids"]), start + n - int(first[k]))
            yield decode(raw, int(b["ids"]), self.code, self.table, low, high)


def text_pieces(text: memoryview, most: int) -> Iterator[bytes]:
    """A text's bytes in pieces of about `most` bytes, cut before white space; a longer word isn't cut. One piece at least."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield bytes(text[at:end])
        at = end
    yield bytes(text[at:])


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, piece_bytes: int = _SLICE) -> DataFrame:
    """part, doc_id, row (a number of its own for every document), piece, n and ids (16 bits each, or 32 if the vocabulary needs them): the ids of every text and its end, very long ones in several pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = word_ids(tokenizer_path), TaskContext.get().partitionId() << 40
        kind = id_type(len(words.ends))

        def encoded(some: list[tuple]) -> pa.RecordBatch:
            parts, doc_ids, rows, pieces, last, texts = zip(*some, strict=True)
            ids, cuts = words.encode(list(texts))
            last = np.array(last)
            keep = np.ones(len(ids), bool)
            keep[cuts[1:] - 1] = last  # the encoder ends every text
            ids[cuts[1:] - 1] = end_id
            n = np.diff(cuts) - ~last
            at = np.concatenate([[0], np.cumsum(n)])
            return pa.record_batch(
                [pa.array(parts, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(pieces, pa.int64()), pa.array(n), binary_rows(ids[keep].astype(kind), at)],
                names=["part", "doc_id", "row", "piece", "n", "ids"],
            )

        some, held = [], 0
        for batch in batches:
            raw, at = utf8(batch.column(2))
            view = memoryview(raw)
            for i, (part, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                pieces = list(text_pieces(view[at[i] : at[i + 1]], piece_bytes))
                for k, piece in enumerate(pieces):
                    some.append((part, doc_id, row, k, k == len(pieces) - 1, piece))
                    held += len(piece)
                    if held >= piece_bytes:
                        yield encoded(some)
                        some, held = [], 0
                row += 1
        if some:
            yield encoded(some)

    slim = docs.select("doc_id", "text")
    cuts = ranges.bounds(slim.select("doc_id"), "doc_id", parts=tasks_of(docs), least_rows=LEAST_DOCUMENTS)
    dealt = slim.select(ranges.part(slim, cuts, "doc_id").cast("int").alias("part"), "doc_id", "text")
    return dealt.mapInArrow(run, "part int, doc_id long, row long, piece long, n long, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def counts(tokens: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids that occur, ascending, and how often: a row for each id of the vocabulary at most reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw, _ = utf8(batch.column(0))
            own = np.bincount(np.frombuffer(raw, kind))
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def write_files(tokens: DataFrame, folder: str, kind: str, block: int = BLOCK) -> DataFrame:
    """Writes a file for each part of `tokens` (a written table) and returns the manifest (path, part, n_ids, n_docs, n_bytes), written.

    Files bear names of their own; readers see those that a finished task has reported.
    """
    spark = tokens.sparkSession
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per file
    ends = np.cumsum([r["n"] for r in totals])
    before = {r["part"]: int(end) - r["n"] for r, end in zip(totals, ends, strict=True)}
    sent = spark.sparkContext.broadcast((Code.of(*counts(tokens, kind)), before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, before = sent.value
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, row, path, file, writer = None, None, "", None, None

        def closed() -> pa.RecordBatch:
            writer.close()
            file.close()
            return pa.record_batch([pa.array([path]), pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (writer.n_ids, len(writer.sizes), writer.at))], names=["path", "part", "n_ids", "n_docs", "n_bytes"])

        for batch in batches:
            raw, at = utf8(batch.column(4))
            at = at // np.dtype(kind).itemsize
            ids = np.frombuffer(raw, kind)
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for i, (its_part, doc_id, its_row) in enumerate(zip(*columns, strict=True)):
                if its_part != part:
                    if writer:
                        yield closed()
                    part, row, path = its_part, None, f"{root}/{uuid.uuid4().hex}.tokens"
                    file = fs.open_output_stream(path)
                    writer = Writer(file, code, before[part], block)
                if its_row != row:
                    row = its_row
                    writer.document(doc_id)
                writer.add(ids[at[i] : at[i + 1]])
        if writer:
            yield closed()

    dealt = tokens.repartition(tasks_of(tokens), "part").sortWithinPartitions("part", "doc_id", "row", "piece")
    files = dealt.select("part", "doc_id", "row", "piece", "ids").mapInArrow(run, "path string, part int, n_ids long, n_docs long, n_bytes long")
    return written(files, "tokenfile-manifest")


def read_files(manifest: DataFrame, folder: str, part_ids: int = PART_IDS) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of the manifest. Large files are read by several tasks, each the documents that start in its share."""
    shares = F.greatest(F.lit(1), F.ceil(F.col("n_ids") / part_ids)).cast("int")
    listed = manifest.select("path", shares.alias("shares"))
    tasks = int(listed.agg(F.sum("shares")).first()[0] or 1)
    # A manifest is tiny beside what it lists: its rows are dealt to as many tasks.
    spots = listed.select("path", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).repartition(tasks, "path", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, share in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as f:
                    reader = Reader(lambda at, n: f.read_at(n, at), f.size())  # noqa: B023
                    starts = reader.starts
                    low, high = np.searchsorted(starts[:-1], [share * part_ids, (share + 1) * part_ids]).tolist()
                    if low == high:
                        continue
                    crcs, doc, at = np.zeros(high - low, np.int64), low, int(starts[low])
                    for ids in reader.ids(at, int(starts[high]) - at):
                        view, end = memoryview(ids.astype("<u4", copy=False)).cast("B"), at + len(ids)
                        while doc < high and starts[doc] < end:
                            upto = min(int(starts[doc + 1]), end)
                            crcs[doc - low] = zlib.crc32(view[4 * (max(int(starts[doc]), at) - (end - len(ids))) : 4 * (upto - (end - len(ids)))], int(crcs[doc - low]))
                            if upto < starts[doc + 1]:
                                break
                            doc += 1
                        at = end
                    docs = reader.documents[low:high]
                    yield pa.record_batch(
                        [pa.array(docs["doc_id"].astype(np.int64), mask=docs["known"] == 0), pa.array(starts[low:high] + reader.before), pa.array(np.diff(starts[low : high + 1])), pa.array(crcs)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spots.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, block: int = BLOCK, part_ids: int = PART_IDS, piece_bytes: int = _SLICE) -> DataFrame:
    """Writes the ids of all documents to files under `folder` (default: the shared folder), a file for each range of doc_ids, and reads them back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty: their end alone. Null doc_ids come first. Rows that share
    a doc_id are documents of their own, one after the other in no stated order. An
    empty table gives no files and no rows.
    """
    own = folder is None
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    kind = id_type(len(word_ids(tokenizer_path).ends))
    manifest = write_files(written(tokenised(docs, tokenizer_path, end_id, piece_bytes), "tokenfile-ids"), folder, kind, block)
    if own:
        removed_at_exit(docs.sparkSession, folder)
    return read_files(manifest, folder, part_ids)


def op13_huffman_tokens(spark: SparkSession, sf_dir: str, tokenizer_path: Callable[[], str] = default_tokenizer) -> DataFrame:
    """The ids of all documents, written in ascending order of doc_id and read back (the contract of ``stored``)."""
    return stored(table(spark, sf_dir, "documents"), tokenizer_path())
