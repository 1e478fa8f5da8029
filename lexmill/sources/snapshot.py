"""A data source of snapshots: sorted JSON lines in a file per range of keys, below a folder per group.

    spark.dataSource.register(SnapshotSource)
    sorted_for_snapshot(df, "lang", "doc_id").write.format("lexmill_snapshot").option("path", p).option("group", "lang").mode("append").save()
    spark.read.format("lexmill_snapshot").option("path", p).option("group", "lang").schema(...).load()

Equal tables give equal bytes in each group, read in the order of file names. Tasks write below
`_staged` and nothing is seen until the driver commits: files then move into place, or are
deleted if a task failed. A reader plans one partition a file and leaves out groups that a
pushed filter rules out; its schema names the fields it parses, so `columns` that nobody asked for are never built.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

STAGED = "_staged"
_NULL = "__null__"


def sorted_for_snapshot(df: DataFrame, group: str, key: str, files: int | None = None) -> DataFrame:
    """df in ranges of (group, key), sorted within; the whole row decides among equal keys."""
    rest = [F.to_json(F.struct(*sorted(df.columns)))]
    ranges = files or df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(ranges, group, key, *rest).sortWithinPartitions(group, key, *rest)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    where, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where, base.rstrip("/")


def _folder(group) -> str:
    return "group=" + (_NULL if group is None else urllib.parse.quote(str(group), safe=""))


def _group(folder: str) -> str | None:
    name = folder.removeprefix("group=")
    return None if name == _NULL else urllib.parse.unquote(name)


@dataclass
class Written(WriterCommitMessage):
    """part: the number of the task's range; files: (group folder, staged path, rows)."""

    part: int
    files: list[tuple[str, str, int]]


class SnapshotWriter(DataSourceWriter):
    def __init__(self, path: str, group: str, overwrite: bool):
        self.path, self.group, self.overwrite, self.run = path, group, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        context, (where, base) = TaskContext.get(), _open(self.path)
        staged = f"{base}/{STAGED}/{self.run}/{context.partitionId():06d}-{context.taskAttemptId()}"
        files, out, have = [], None, None
        for row in iterator:
            fields = row.asDict(recursive=True)
            folder = _folder(fields[self.group])
            if folder != have:  # rows come sorted by group
                if out is not None:
                    out.close()
                if any(f == folder for f, _, _ in files):
                    raise ValueError("rows of a task aren't sorted by their group")
                where.create_dir(staged, recursive=True)
                files.append([folder, f"{staged}/{len(files):06d}.jsonl", 0])
                out, have = where.open_output_stream(files[-1][1], compression=None), folder
            out.write(json.dumps(fields, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str).encode() + b"\n")
            files[-1][2] += 1
        if out is not None:
            out.close()
        return Written(context.partitionId(), [tuple(f) for f in files])

    def commit(self, messages) -> None:
        where, base = _open(self.path)
        if self.overwrite:
            for info in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.base_name.startswith("group="):
                    where.delete_dir(info.path)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for folder, staged, _ in m.files:
                where.create_dir(f"{base}/{folder}", recursive=True)
                where.move(staged, f"{base}/{folder}/{m.part:06d}-{self.run if not self.overwrite else 'part'}.jsonl")
        self._clear(where, base)

    def abort(self, messages) -> None:
        self._clear(*_open(self.path))

    def _clear(self, where: fs.FileSystem, base: str) -> None:
        if where.get_file_info(f"{base}/{STAGED}/{self.run}").type != fs.FileType.NotFound:
            where.delete_dir(f"{base}/{STAGED}/{self.run}")


class SnapshotFile(InputPartition):
    def __init__(self, path: str, group: str | None):
        self.path, self.group = path, group


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str, group: str, schema: StructType):
        self.path, self.group, self.schema = path, group, schema
        self.allowed: set | None = None  # groups that the filters so far let through

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == (self.group,):
                found = {f.value}
            elif isinstance(f, In) and f.attribute == (self.group,):
                found = set(f.value)
            elif isinstance(f, IsNull) and f.attribute == (self.group,):
                found = {None}
            elif isinstance(f, IsNotNull) and f.attribute == (self.group,):
                yield f  # cheap, and often comes along with the others
                continue
            else:
                yield f
                continue
            self.allowed = found if self.allowed is None else self.allowed & found

    def partitions(self):
        where, base = _open(self.path)
        found = where.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted(i.path for i in found if i.is_file and i.path.endswith(".jsonl") and f"/{STAGED}/" not in i.path)
        own = [SnapshotFile(p, _group(p.split("/")[-2])) for p in files]
        return [x for x in own if self.allowed is None or x.group in {None if a is None else str(a) for a in self.allowed}]

    def read(self, partition):
        if partition is None or not partition.path:
            return
        where, _ = _open(self.path)
        names = self.schema.fieldNames()
        rest = b""
        with where.open_input_stream(partition.path, compression=None) as lines:
            while block := lines.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    fields = json.loads(line)
                    yield tuple(fields.get(n) for n in names)


class SnapshotSource(DataSource):
    """Options: path, group (the column that names the groups, text or integers)."""

    @classmethod
    def name(cls) -> str:
        return "lexmill_snapshot"

    def schema(self):
        raise ValueError("name the columns to read by .schema(...)")

    def reader(self, schema: StructType) -> SnapshotReader:
        return SnapshotReader(self.options["path"], self.options["group"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(self.options["path"], self.options["group"], overwrite)
