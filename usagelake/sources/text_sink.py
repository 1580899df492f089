"""A sink for ordered lines of text, in batch and as a stream, that commits all of it or nothing.

    lines.write.format("ordered_text").mode("append").save(folder)
    stream.writeStream.format("ordered_text").option("checkpointLocation", ...).start(folder)

Tasks write their lines below `_staged`, each attempt to a file of its own; the commit moves the files of the attempts that
counted into place, in the order of the partitions, and names the commit in `_commits`.  A task that is killed, and a job that fails,
leave nothing that a reader sees: at most files below `_staged`.  Parts joined in the order of their names are the whole text: a line feed stands between two
lines and none after the last, as RFC 4180 leaves it open.  Only file names pass through the driver, but for the first part of a
text without a header, which is copied in pieces without its first line feed.

A streamed batch is committed by its id: a batch that is run again after its commit changes nothing.

Options: path; `column` (line); `header`, a first line for a text that may have no other.  Folders may be of any store that
pyarrow's file systems reach.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

STAGED, COMMITS = "_staged", "_commits"


@dataclass
class Part(WriterCommitMessage):
    """A staged file; name is None where the partition was empty."""

    partition: int
    name: str | None
    lines: int


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and folder of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}") if path.startswith("/") else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Text:
    """What both writers share."""

    def __init__(self, options, job: str, overwrite: bool):
        self.path, self.column, self.header, self.overwrite = options["path"], options.get("column", "line"), options.get("header"), overwrite
        self.job = job

    def stage(self, batches) -> Part:
        files, root = place(self.path)
        context = TaskContext.get()
        partition, attempt = context.partitionId(), context.taskAttemptId()
        name, lines, out = f"{root}/{STAGED}/{self.job}/{partition:06d}-{attempt}-{uuid.uuid4().hex}", 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    files.create_dir(posixpath.dirname(name), recursive=True)
                    out = files.open_output_stream(name)
                text = [x for x in batch.column(batch.schema.get_field_index(self.column)).to_pylist() if x is not None]
                lines += len(text)
                out.write("".join(f"\n{x}" for x in text).encode("utf-8", "surrogatepass"))  # each line brings the feed before it
        finally:
            if out is not None:
                out.close()
        return Part(partition, name if lines else None, lines)

    def publish(self, messages: list[Part], mark: str) -> None:
        """Move the parts into place and set the mark, unless it is set; then forget what was staged."""
        files, root = place(self.path)
        done = f"{root}/{COMMITS}/{mark}"
        if files.get_file_info(done).type == fs.FileType.NotFound:
            before = [] if files.get_file_info(root).type == fs.FileType.NotFound else self.parts(files, root)
            half = [p for p in before if posixpath.basename(p).startswith(f"part-{mark}-")]  # of a commit that broke off
            for p in before if self.overwrite else half:
                files.delete_file(p)
            first = self.overwrite or len(before) == len(half)
            files.create_dir(f"{root}/{COMMITS}", recursive=True)
            if first:
                self.head(files, f"{root}/part-{mark}-000000", messages)
            kept = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition)
            for n, m in enumerate(kept, 1):
                if first and n == 1 and self.header is None:
                    self.unfed(files, m.name, f"{root}/part-{mark}-{n:06d}")
                else:
                    files.move(m.name, f"{root}/part-{mark}-{n:06d}")
            with files.open_output_stream(done) as out:
                out.write(f"{sum(m.lines for m in kept)}\n".encode())
        self.discard()

    def head(self, files, name: str, messages) -> None:
        if self.header is not None:
            with files.open_output_stream(name) as out:
                out.write(self.header.encode())

    @staticmethod
    def unfed(files, name: str, to: str) -> None:
        """The text's first part: without the line feed before its first line, copied in pieces."""
        with files.open_input_stream(name) as source, files.open_output_stream(to) as out:
            source.read(1)
            while piece := source.read(1 << 20):
                out.write(piece)

    @staticmethod
    def parts(files, root: str) -> list[str]:
        return sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.startswith("part-"))

    def discard(self) -> None:
        files, root = place(self.path)
        staged = f"{root}/{STAGED}/{self.job}"
        if files.get_file_info(staged).type != fs.FileType.NotFound:
            files.delete_dir(staged)


class Batch(_Text, DataSourceArrowWriter):
    def write(self, iterator):
        return self.stage(iterator)

    def commit(self, messages) -> None:
        self.publish(messages, self.job)

    def abort(self, messages) -> None:
        self.discard()


class Stream(_Text, DataSourceStreamArrowWriter):
    def write(self, iterator):
        return self.stage(iterator)

    def commit(self, messages, batchId: int) -> None:
        self.publish(messages, f"batch-{batchId:09d}")

    def abort(self, messages, batchId: int) -> None:
        self.discard()


class OrderedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def schema(self) -> str:
        return f"{self.options.get('column', 'line')} string"

    def writer(self, schema, overwrite: bool) -> Batch:
        return Batch(self.options, f"{time.time_ns():020d}-{uuid.uuid4().hex}", overwrite)  # later texts sort behind

    def streamWriter(self, schema, overwrite: bool) -> Stream:
        return Stream(self.options, uuid.uuid4().hex, False)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OrderedText)


def committed(path: str) -> list[str]:
    """The parts of a text in their order; joined, they are the text."""
    files, root = place(path)
    return _Text.parts(files, root)


def read_text(path: str) -> bytes:
    """A whole small text, for views and tests; large ones are read part by part."""
    files, _ = place(path)
    out = b""
    for p in committed(path):
        with files.open_input_stream(p) as f:
            out += f.read()
    return out
