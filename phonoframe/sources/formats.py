"""Spark data sources of corpus files and of a caller's own corpus, and a sink that shows its files only when all are written.

    register(spark)
    spark.read.format(FILES).option("pattern", "*.lab").load("hdfs://.../corpus")
    contents.write.format(FILES).mode("append").save("hdfs://.../corpus")
    spark.dataSource.register(source_of("my_corpus", MyCorpus))
    spark.read.format("my_corpus").option("path", "...").load()

Folders may be in any store that pyarrow knows. A listing is made by one process, as
that of Spark's own file sources is; contents are read by partitions of about
`partitionBytes`.
"""

from __future__ import annotations

import fnmatch
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: The name of the source and sink of files.
FILES = "phonoframe_files"
PARTITION_BYTES, PARTITION_FILES = 16 << 20, 10_000
#: Partitions of a read at most, about: beyond, shares grow, as a task of few small files costs more than the files.
MOST_PARTITIONS = 4096
#: Files and bytes of a batch; threads that move files.
BATCH_FILES, BATCH_BYTES, MOVERS = 1024, 16 << 20, 8
_PENDING = "_pending-"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSource)


def listed(root: str, pattern: str = "*") -> list[pafs.FileInfo]:
    """Files below a folder whose names match, by path; nothing in folders or of names that begin with _ or a dot."""
    fs, base = pafs.FileSystem.from_uri(root)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    hidden = lambda path: any(x[:1] in ("_", ".") for x in path[len(base) :].strip("/").split("/"))
    return sorted((f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and not hidden(f.path)), key=lambda f: f.path)


@dataclass
class Some(InputPartition):
    """What one task reads."""

    items: list

    def __init__(self, items: list):
        super().__init__(len(items))
        self.items = items


def shares(items: Sequence, sizes: Sequence[int], most: int, most_items: int = PARTITION_FILES) -> list[Some]:
    """Consecutive items, so many that their sizes reach `most`; more, if there would be over ``MOST_PARTITIONS`` shares."""
    out, some, held = [], [], 0
    most, most_items = max(most, sum(sizes) / MOST_PARTITIONS), max(most_items, len(items) // MOST_PARTITIONS)
    for item, size in zip(items, sizes, strict=True):
        if some and (held + size > most or len(some) >= most_items):
            out.append(Some(some))
            some, held = [], 0
        some.append(item)
        held += size
    return [*out, Some(some)] if some else out


class FileSource(DataSource):
    """path, name (without its extension), folder, size and content of the files below a folder. Options: pattern of names (*), partitionBytes, content (false: null, files aren't opened)."""

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self) -> str:
        return "path string, name string, folder string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if {"name", "content"} - set(schema.fieldNames()):
            raise ValueError("files have the columns name and content")
        return FileWriter(dict(self.options), overwrite)


class FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.most, self.content = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES))), options.get("content", "true").lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        found = listed(self.root, self.pattern)
        return shares([(f.path, f.size) for f in found], [f.size for f in found], self.most) or [Some([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        some, held = [], 0
        for path, size in partition.items:
            folder, _, base = path.rpartition("/")
            content = None
            if self.content:
                with fs.open_input_stream(path) as f:
                    content = f.read()
                held += len(content)
            some.append((path, base.rpartition(".")[0] or base, folder, size, content))
            if len(some) >= BATCH_FILES or held >= BATCH_BYTES:
                yield _batch(some)
                some, held = [], 0
        if some:
            yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [("path", pa.string()), ("name", pa.string()), ("folder", pa.string()), ("size", pa.int64()), ("content", pa.binary())]
    return pa.record_batch([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


@dataclass
class Pending(WriterCommitMessage):
    """Where a task's files wait."""

    folder: str


class FileWriter(DataSourceArrowWriter):
    """Files by name (a path below the folder) and content. Tasks write to a hidden folder of their own; the files are moved to their names when all tasks have ended well, and removed otherwise."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite, self.pending = options["path"], overwrite, _PENDING + uuid.uuid4().hex
        # Made here and by no task: a task that is late when all has been removed finds no folder.
        fs, base = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(f"{base}/{self.pending}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = pafs.FileSystem.from_uri(self.root)
        folder, made = f"{base}/{self.pending}/{uuid.uuid4().hex}", set()
        local = isinstance(fs, pafs.LocalFileSystem)  # whose plain files open much faster
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a path below the folder: {name!r}")
                at = f"{folder}/{name}"
                parent = at.rpartition("/")[0]
                if parent not in made:
                    parts = parent[len(folder) :].split("/")
                    for k in range(len(parts)):
                        if (x := folder + "/".join(parts[: k + 1])) not in made:
                            fs.create_dir(x, recursive=False)
                            made.add(x)
                    made.add(parent)
                with open(at, "wb") if local else fs.open_output_stream(at) as f:
                    f.write(content or b"")
        return Pending(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(base, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(base)):
                if f.base_name != self.pending:
                    (fs.delete_dir if f.type == pafs.FileType.Directory else fs.delete_file)(f.path)
        # Folders that were there, with the names in them; a name that two tasks wrote is the later one's.
        there: dict[str, set[str] | None] = {base: None}
        for folder in (m.folder for m in messages if m is not None):
            found = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File]
            moves = [(path, base + path[len(folder) :]) for path in found]
            for parent in {at.rpartition("/")[0] for _, at in moves}:
                if there.get(parent) is None:
                    old = fs.get_file_info(pafs.FileSelector(parent, allow_not_found=True))
                    there[parent] = {f.path for f in old if f.type == pafs.FileType.File}
                    fs.create_dir(parent, recursive=True)

            def moved(some: list[tuple[str, str]]) -> None:
                for path, at in some:
                    if at in there[at.rpartition("/")[0]]:
                        fs.delete_file(at)
                    fs.move(path, at)

            if isinstance(fs, pafs.LocalFileSystem):  # one folder's entries change one after the other there
                moved(moves)
            else:
                with ThreadPoolExecutor(MOVERS) as pool:
                    list(pool.map(moved, [moves[k::MOVERS] for k in range(MOVERS)]))
            for _, at in moves:
                there[at.rpartition("/")[0]].add(at)
        self._clean(fs, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*pafs.FileSystem.from_uri(self.root))

    def _clean(self, fs: pafs.FileSystem, base: str) -> None:
        at = f"{base}/{self.pending}"
        for wait in (0.05, 0.2, 0.5, 1, 2, None):
            if fs.get_file_info(at).type != pafs.FileType.Directory:
                return
            try:
                fs.delete_dir(at)
            except OSError:  # a task that is being stopped has just written into it
                if wait is None:
                    raise
                time.sleep(wait)


class Corpus(ABC):
    """A corpus that a caller writes: its items, and how to make features of one. Made from the reader's options."""

    def __init__(self, options: dict):
        self.options = options

    @abstractmethod
    def items(self) -> Sequence[tuple[str, object]]:
        """(utt, what features() needs) of every utterance; runs once, before the tasks."""

    @abstractmethod
    def features(self, item: object) -> np.ndarray:
        """(T, D) of one; runs in the tasks."""

    def size(self, item: object) -> int:
        """How much of a task's share an item takes."""
        return 1


def _frames(some: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """utt, frame, features of several utterances' matrices."""
    rows = [len(x) for _, x in some]
    utts = pa.array([utt for utt, _ in some], pa.string()).take(pa.array(np.repeat(np.arange(len(some)), rows)))
    widths = np.repeat([x.shape[1] for _, x in some], rows)
    at = pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32))
    values = pa.array(np.concatenate([x.ravel() for _, x in some]))
    return pa.record_batch([utts, pa.array(np.concatenate([np.arange(n) for n in rows])), pa.ListArray.from_arrays(at, values)], names=["utt", "frame", "features"])


def source_of(name: str, corpus: type[Corpus]) -> type[DataSource]:
    """A data source (utt, frame, features) to register, which reads a corpus by partitions of `share` (option; 100) in its sizes."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.corpus, self.most = corpus(options), int(options.get("share", 100))

        def partitions(self) -> Sequence[InputPartition]:
            items = list(self.corpus.items())
            return shares(items, [self.corpus.size(x) for _, x in items], self.most) or [Some([])]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            some, held = [], 0
            for utt, item in partition.items:
                x = np.atleast_2d(np.asarray(self.corpus.features(item), float))
                some.append((utt, x))
                held += x.nbytes
                if len(some) >= BATCH_FILES or held >= BATCH_BYTES:
                    yield _frames(some)
                    some, held = [], 0
            if some:
                yield _frames(some)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "utt string, frame long, features array<double>"

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source
