"""Commit logs as a data source of Spark, in batch and as a stream.

A folder holds the exports of many repositories (see history.py for their format), each in segments below
`repo=<name>/`, or in one file named after the repository. A batch scan deals them out as byte ranges of whole records, so
that a large repository is read by many tasks; filters on repo and committed_at are pushed: the first prunes partitions,
the second drops commits before their changes are parsed. A stream's offset is the set of tips: for each repository the
segment, the length and the sha it was last read up to. What lies between two sets of tips is read once; where a log was
rewritten, so that the known tip is not at its place, the repository is read anew, which loads by key skip.

Segments may be gzip files (.gz), put into place whole or appended to by whole gzip members. Such a segment is one range, so
that a large repository wants many of them; its tip is the trailer, which holds the checksum and length of what was packed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import accumulate
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .history import changes_of

SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
ROWS = 500
#: How far back the record before a known tip is looked for.
TAIL_BYTES = 1 << 22
#: A byte of gzip stands for at most 1,032 of what was packed: places in a packed segment are numbered with that much room.
PACKED, ROOM, TRAILER = ".gz", 1 << 11, 8

_HEAD, _END = b"\x01", b"\x00"
_CHANGE = "struct<path: string, change_type: string, old_path: string, similarity: long, insertions: long, deletions: long, is_binary: boolean>"
SCHEMA = f"repo string, nr long, sha string, parents array<string>, author_name string, author_email string, authored_at timestamp, committer_name string, committer_email string, committed_at timestamp, subject string, body string, is_merge boolean, changes array<{_CHANGE}>"
_CHANGES = pa.list_(
    pa.struct([("path", pa.string()), ("change_type", pa.string()), ("old_path", pa.string()), ("similarity", pa.int64()), ("insertions", pa.int64()), ("deletions", pa.int64()), ("is_binary", pa.bool_())])
)
_TIME = pa.timestamp("us", "UTC")
_ARROW = pa.schema([
    ("repo", pa.string()), ("nr", pa.int64()), ("sha", pa.string()), ("parents", pa.list_(pa.string())), ("author_name", pa.string()), ("author_email", pa.string()), ("authored_at", _TIME),
    ("committer_name", pa.string()), ("committer_email", pa.string()), ("committed_at", _TIME), ("subject", pa.string()), ("body", pa.string()), ("is_merge", pa.bool_()), ("changes", _CHANGES),
])


class Segment(NamedTuple):
    repo: str
    name: str
    size: int


class LogRange(InputPartition):
    """The records of a segment that begin at start or later and before end; base numbers them after earlier segments."""

    def __init__(self, repo: str, path: str, start: int, end: int, base: int):
        super().__init__((repo, path, start, end))
        self.repo, self.path, self.start, self.end, self.base = repo, path, start, end, base


def _open(folder: str):
    """(filesystem, path) of a folder given as a path or a URI that pyarrow knows."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), folder


def segments(folder: str) -> list[Segment]:
    """All segments below a folder, by repository and name; hidden files aside."""
    from pyarrow import fs

    store, root = _open(folder)
    root = root.rstrip("/")
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
        name = info.path[len(root) + 1 :]
        if info.type != fs.FileType.File or any(part.startswith(("_", ".")) for part in name.split("/")):
            continue
        top = name.split("/")[0]
        plain = name.removesuffix(PACKED)
        repo = unquote(top[5:]) if top.startswith("repo=") else unquote(plain.rpartition("/")[2].rpartition(".")[0] or plain)
        found.append(Segment(repo, name, info.size))
    return sorted(found)


def _records(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, record) of the records that begin in [start, end); the last one may reach beyond end."""
    if file.seekable():
        file.seek(start)
    at, rest, inside = start, b"", False
    while True:
        piece = file.read(max(READ_BYTES, len(rest)))
        *parts, rest = (rest + piece).split(_HEAD)
        for part in [*parts, rest] if not piece else parts:
            if inside:
                if at - 1 >= end:
                    return
                yield at - 1, part
            inside = True
            at += len(part) + 1
        if not inside:  # what comes before the first head belongs to the range before
            at, rest = at + len(rest), b""
        if not piece or at - inside >= end:
            return


def _placed(part: LogRange) -> Iterator[tuple[int, bytes]]:
    """(number, record) of the records of a range; the range of a packed segment holds whole gzip members."""
    store, path = _open(part.path)
    with store.open_input_file(path) as file:
        if path.endswith(PACKED):
            base, found = part.base + part.start * ROOM, _records(pa.CompressedInputStream(file.get_stream(part.start, part.end - part.start), "gzip"), 0, sys.maxsize)
        else:
            base, found = part.base, _records(file, part.start, part.end)
        for at, record in found:
            yield base + at, record


def _time(text: str) -> datetime:
    """A time with its offset; the epoch for what is none."""
    try:
        found = datetime.fromisoformat(text.strip())
    except ValueError:
        return datetime.fromtimestamp(0, UTC)
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def _split_renames(change: tuple, least: int) -> list[tuple]:
    """A rename or copy less similar than least is a new file and, for a rename, the deletion of the old one."""
    path, kind, old, similarity, *lines = change
    if kind not in "RC" or similarity is None or similarity >= least:
        return [change]
    gone = [(old, "D", None, None, 0, 0, lines[2])] if kind == "R" else []
    return [(path, "A", None, None, *lines), *gone]


class Options(NamedTuple):
    """merges: keep merges; similarity: least percentage of a rename; newest: nr falls along the log; since, until: bounds on committed_at."""

    merges: bool
    similarity: int
    newest: bool
    bounds: tuple = ()

    def takes(self, time: datetime) -> bool:
        return all(test(time) for test in self.bounds)


def _rows(part: LogRange, options: Options) -> Iterator[tuple]:
    """The commits of a range that options take, heads of fewer than nine fields left out."""
    for nr, record in _placed(part):
        head, *items = record.rstrip(_END).decode("utf-8", "replace").split("\x00")
        f = head.rstrip("\n").split("\x1f")
        if len(f) < 9:
            continue
        parents, committed_at = f[1].split(), _time(f[7])
        if (len(parents) > 1 and not options.merges) or not options.takes(committed_at):
            continue
        changes = [c for change in changes_of(items) for c in _split_renames(change, options.similarity)]
        yield (part.repo, -nr if options.newest else nr, f[0].strip(), parents, f[2], f[3].strip().lower(), _time(f[4]), f[5], f[6].strip().lower(), committed_at, f[8], f[9] if len(f) > 9 else "", len(parents) > 1, changes)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        *columns, changes = zip(*held, strict=True)
        kind, every = _CHANGES.value_type, [change for some in changes for change in some]
        flat = zip(*every, strict=True) if every else [()] * kind.num_fields
        structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kind, strict=True)], fields=list(kind))
        lists = pa.ListArray.from_arrays(pa.array(accumulate(map(len, changes), initial=0), pa.int32()), structs)
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=False)), lists], schema=_ARROW)

    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def _ranges(folder: str, found: list[Segment], split: int) -> list[LogRange]:
    """Segments cut into ranges of split bytes, packed ones as one; a repository's segments are numbered one after the other."""
    out, base, repo = [], 0, None
    for segment in found:
        base = base if segment.repo == repo else 0
        repo = segment.repo
        packed = segment.name.endswith(PACKED)
        out += [LogRange(repo, f"{folder.rstrip('/')}/{segment.name}", at, min(at + split, segment.size), base) for split in [segment.size or 1 if packed else split] for at in range(0, segment.size, split)]
        base += segment.size * (ROOM if packed else 1)
    return out


class Bound:
    """A comparison of a time with a fixed one."""

    def __init__(self, kind: type, value: datetime):
        self.kind, self.value = kind, value if value.tzinfo else value.replace(tzinfo=UTC)

    def __call__(self, time: datetime) -> bool:
        if self.kind is GreaterThan:
            return time > self.value
        if self.kind is GreaterThanOrEqual:
            return time >= self.value
        return time < self.value if self.kind is LessThan else time <= self.value


class LogReader(DataSourceReader):
    def __init__(self, folder: str, options: Options, split: int):
        self.folder, self.options, self.split, self.repos = folder, options, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists of repo, and bounds of committed_at; all others stay with Spark."""
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("repo",):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.repos = values if self.repos is None else self.repos & values
            elif isinstance(one, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and one.attribute == ("committed_at",) and isinstance(one.value, datetime):
                self.options = self.options._replace(bounds=(*self.options.bounds, Bound(type(one), one.value)))
            elif not (isinstance(one, IsNotNull) and one.attribute[0] in ("repo", "sha", "committed_at")):  # these never are null
                yield one

    def partitions(self) -> list[LogRange]:
        return _ranges(self.folder, [s for s in segments(self.folder) if self.repos is None or s.repo in self.repos], self.split)

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        return _batches(_rows(partition, self.options))


class LogStream(DataSourceStreamReader):
    """Offsets are {"tips": {repo: [segment, length, sha]}}; a length ends with a whole record."""

    def __init__(self, folder: str, options: Options, split: int):
        self.folder, self.options, self.split = folder, options, split

    def initialOffset(self) -> dict:
        return {"tips": {}}

    def latestOffset(self) -> dict:
        last = {segment.repo: segment for segment in segments(self.folder)}
        return {"tips": {repo: list(tip) for repo, segment in last.items() if (tip := self._tip(segment))}}

    def _tip(self, segment: Segment) -> tuple[str, int, str] | None:
        """The last whole record of a segment: one that ends with a NUL."""
        length, sha = self._before(segment.name, segment.size)
        return (segment.name, length, sha) if sha else None

    def _before(self, name: str, length: int) -> tuple[int, str]:
        """(where it ends, sha) of the last whole record before a place in a segment, of a packed one the place and its trailer; no sha where there is none."""
        store, path = _open(f"{self.folder.rstrip('/')}/{name}")
        with store.open_input_file(path) as file:
            size = min(length, file.size())
            if name.endswith(PACKED):
                file.seek(max(0, size - TRAILER))
                return (size, file.read(size - file.tell()).hex()) if size > TRAILER else (0, "")
            start = max(0, size - TAIL_BYTES)
            file.seek(start)
            tail = file.read(size - start)
        whole = tail.rfind(_END) + 1
        head = tail.rfind(_HEAD, 0, whole)
        return (start + whole, tail[head + 1 :].split(b"\x1f")[0].decode("utf-8", "replace").strip()) if head >= 0 else (0, "")

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        """What lies between two sets of tips; the whole log of a repository whose known tip is not where it was."""
        found, out = segments(self.folder), []
        for repo, (name, length, _) in end["tips"].items():
            own = [s if s.name != name else s._replace(size=length) for s in found if s.repo == repo and s.name <= name]
            known = start["tips"].get(repo)
            if known and any(s.name == known[0] and s.size >= known[1] for s in own) and self._before(known[0], known[1]) == (known[1], known[2]):
                ranges = [r for r in _ranges(self.folder, own, self.split) if r.path[len(self.folder.rstrip("/")) + 1 :] >= known[0]]
                for r in ranges:
                    if r.path.endswith("/" + known[0]):
                        r.start = max(r.start, known[1])
                out += [r for r in ranges if r.start < r.end]
            else:
                out += _ranges(self.folder, own, self.split)
        return out

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        return _batches(_rows(partition, self.options))


class CommitLog(DataSource):
    """Options: path; merges (false), rename_similarity (50), order (oldest or newest), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return SCHEMA

    def _of(self, kind: type):
        given = self.options
        order = given.get("order", "oldest")
        if order not in ("oldest", "newest"):
            raise ValueError("order is oldest or newest")
        options = Options(given.get("merges", "false").lower() == "true", int(given.get("rename_similarity", 50)), order == "newest")
        return kind(given["path"], options, int(given.get("split_bytes", SPLIT_BYTES)))

    def reader(self, schema) -> LogReader:
        return self._of(LogReader)

    def streamReader(self, schema) -> LogStream:
        return self._of(LogStream)


def read_log(spark: SparkSession, folder: str, stream: bool = False, **options) -> DataFrame:
    """The commits of all repositories below folder, with their changes; see CommitLog for the options.

    nr orders a repository's commits: along its log, or against it for order newest. Without merges those are left out;
    with rename_similarity renames below it are additions and deletions. Bytes that are no UTF-8 become replacement
    characters, heads of fewer than nine fields are left out, bad times are the epoch, a path comes once in a commit. The
    pushing of filters is switched on in the session, as Spark leaves it off unless asked.
    """
    spark.dataSource.register(CommitLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = (spark.readStream if stream else spark.read).format("commit_log").option("path", folder)
    return reader.options(**options).load()


def write_log(commits: DataFrame, folder: str, mode: str = "error", ranged: bool = False) -> None:
    """Exports commits (repo, segment, nr, head, items) as packed segments of logs: head has the ten fields, items the records.

    Commits are dealt out in ranges of nr, unless they are so already (ranged), and lie in the order of nr: each task writes a
    part of every repository, and none a repository as a whole.
    """
    from pyspark.sql import functions as F

    record = F.concat(F.lit("\x01"), F.array_join(F.concat(F.array(F.array_join("head", "\x1f")), "items"), "\x00"))
    rows = (commits if ranged else commits.repartitionByRange("nr")).sortWithinPartitions("repo", "segment", "nr")
    rows.select("repo", "segment", record.alias("value")).write.mode(mode).partitionBy("repo", "segment").option("lineSep", "\x00").option("compression", "gzip").text(folder)
