"""A streaming source that tails JSONL files by byte offset.

Whole lines alone are read; a file that has shrunk starts again; lines that are
not UTF-8 are skipped.  The offset is the map of path to bytes.  The driver looks
at the ends of files only; a long unread range is read in pieces, a task each.
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

DEPTH = 8


def log_files(folder: str, suffix: str) -> list[str]:
    """Files under folder, to a depth of 8; folders that can't be read are skipped."""
    out, base = [], folder.rstrip("/").count("/")
    for top, dirs, names in os.walk(folder, onerror=lambda e: None):
        if top.count("/") - base >= DEPTH:
            dirs[:] = []
        out += [os.path.join(top, n) for n in names if n.endswith(suffix)]
    return sorted(out)


#: Bytes of one step back from a file's end, and of one task's piece of a file.
STEP, PIECE = 65_536, 64_000_000


def whole_lines(path: str, start: int, end: int, first: bool = True):
    """(position, line) of the lines that begin in [start, end); of a later piece, the line that start falls into belongs to the one before.

    One line at a time is held. A file that has gone gives none.
    """
    try:
        f = open(path, "rb")
    except OSError:
        return
    with f:
        at = start
        if not first:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        f.seek(at)
        while at < end:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                break
            here, at = at, at + len(raw)
            if not raw.strip():
                continue
            try:
                yield here, raw[:-1].decode("utf-8").rstrip("\r")
            except UnicodeDecodeError:
                continue


def last_line_end(path: str, start: int) -> int | None:
    """Offset after the last complete line at or after start, searched backwards; a file that has shrunk starts again; None if it has gone."""
    try:
        size = os.path.getsize(path)
        begin = start if size >= start else 0
        with open(path, "rb") as f:
            upto = size
            while upto > begin:
                low = max(begin, upto - STEP)
                f.seek(low)
                cut = f.read(upto - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                upto = low
    except OSError:
        return None
    return begin


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


def shares(wants: dict[str, int], budget: int) -> dict[str, int]:
    """The budget over the files that want more bytes: files that want little get all of it, the others equal shares of what is left."""
    out, left = {}, budget
    for n, (path, want) in enumerate(sorted(wants.items(), key=lambda x: (x[1], x[0]))):
        out[path] = min(want, left // (len(wants) - n))
        left -= out[path]
    return out


def line_end(path: str, start: int, upto: int, most: int) -> int:
    """Offset after the last whole line in [start, upto), or after the first line if that is longer; never beyond `most`."""
    try:
        with open(path, "rb") as f:
            at = upto
            while at > start:
                low = max(start, at - STEP)
                f.seek(low)
                cut = f.read(at - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                at = low
            f.seek(upto)
            at = upto
            while at < most:  # a line longer than the share is read whole
                piece = f.read(min(STEP, most - at))
                cut = piece.find(b"\n")
                if cut >= 0:
                    return at + cut + 1
                if not piece:
                    break
                at += len(piece)
    except OSError:
        return start
    return most


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.budget = int(options["maxBytesPerTrigger"]) if options.get("maxBytesPerTrigger") else None
        self.most = max(int(options.get("catchUpBytesPerTrigger") or 0), self.budget or 0)
        self.allowed = self.budget
        self.progress = options.get("progress")
        if self.budget is not None and not self.progress:
            raise ValueError("maxBytesPerTrigger needs the option progress, a file that tells a restarted stream where it stands")
        self.known: dict[str, int] = {}
        if self.progress and os.path.exists(self.progress):
            with open(self.progress, encoding="utf-8") as f:
                self.known = json.load(f)

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        ends = {}
        for path in log_files(self.folder, self.suffix):
            end = last_line_end(path, self.known.get(path, 0))
            if end is not None:  # a file that has gone keeps its offset
                ends[path] = end
        if self.budget is not None:
            begins = {p: self.known.get(p, 0) if self.known.get(p, 0) <= e else 0 for p, e in ends.items()}
            wants = {p: e - begins[p] for p, e in ends.items() if e > begins[p]}
            part = shares(wants, self.allowed)
            self.allowed = min(2 * self.allowed, self.most) if sum(wants.values()) > self.allowed else self.budget
            part = part if any(part.values()) or not part else {min(part): 1}  # a budget below a byte a file still goes on
            ends |= {p: line_end(p, begins[p], begins[p] + n, ends[p]) if n else begins[p] for p, n in part.items() if n < ends[p] - begins[p]}
        self.known |= ends
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**new, **self.known}
        if self.progress:  # Spark plans a batch after it has logged its end, so this is where the stream goes on from
            os.makedirs(os.path.dirname(self.progress), exist_ok=True)
            with open(f"{self.progress}.new", "w", encoding="utf-8") as f:
                json.dump(new, f)
            os.replace(f"{self.progress}.new", self.progress)
        out = []
        for path, upto in new.items():
            begin = old.get(path, 0)
            begin = begin if begin <= upto else 0
            out += [Piece(path, at, min(at + PIECE, upto), at == begin) for at in range(begin, upto, PIECE)]
        return out

    def read(self, partition: Piece):
        for at, line in whole_lines(partition.path, partition.start, partition.end, partition.first):
            yield partition.path, at, line


class JsonlTail(DataSource):
    """spark.readStream.format("jsonl_tail").load(folder) -> (file, pos, value)

    Options: suffix (.jsonl); maxBytesPerTrigger with progress, a file of the stream's own: a micro-batch then reads some so many
    bytes, dealt fairly over the files that have grown.  A line is never cut: one that is longer than its file's share is read
    whole.  catchUpBytesPerTrigger: while more is left than a micro-batch takes, each takes twice what the one before did, up to so
    many bytes; the stream is back at maxBytesPerTrigger when it has caught up or starts again.  Without them a micro-batch reads all there is.  A trigger of what is available now makes one micro-batch.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, pos long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(JsonlTail)
