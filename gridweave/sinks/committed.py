"""Trace documents of any size, written by many tasks and published at once.

1. Events are range-partitioned by (document, order), and each task writes its documents' lines as members, gzip ones or plain, into a staging folder beside the target. A member is
   named by its task attempt, so what a lost attempt leaves is never read. A document that begins and ends inside a task, so neither its first nor its last one, is whole, and staged at once.
2. One task for each of the others copies its members, in order, between the document's head and tail: a gzip file may have any number of members. It holds one block of bytes at a time.
3. Commit moves the staged documents to the target in one rename; abort deletes the staging folder, so a job that fails leaves nothing.

Files are reached through the file system of the path's scheme, as pyarrow knows it, from executors and driver alike.
"""

from __future__ import annotations

import contextlib
import gzip as gz
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .reports import FIELDS

HEAD, TAIL, BETWEEN = b'{"traceEvents":[\n', b"\n]}\n", b",\n"
#: Bytes that a copy holds at once; rows of text that are compressed at once.
BLOCK = 1 << 20
_MEMBERS = "name string, first long, member string, begun boolean, lines long"


def file_system(uri: str):
    """(file system, path in it) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class Member:
    """One task's lines of one document, in a file of its own."""

    def __init__(self, files, path: str, compress: bool, begun: bool):
        self.out, self.count, self.begun = files.open_output_stream(path), 0, begun
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31) if compress else None
        if begun:
            self.write(HEAD)

    def write(self, text: bytes) -> None:
        self.out.write(self.packer.compress(text) if self.packer else text)

    def add(self, lines: list[str]) -> None:
        self.write(((BETWEEN.decode() if self.count else "") + BETWEEN.decode().join(lines)).encode())
        self.count += len(lines)

    def close(self) -> None:
        if self.packer:
            self.out.write(self.packer.flush())
        self.out.close()


def _members(folder: str, out: str, compress: bool):
    """Members and whole documents; the latter have no member."""

    def run(batches):
        task = TaskContext.get()
        files, base = file_system(folder)
        name, member, where, done = None, None, None, 0

        def ended(more: bool) -> tuple:
            whole = member.begun and more
            if whole:
                member.write(TAIL)
            member.close()
            if whole:
                files.move(f"{base}/{where}", f"{base}/{out}/{name}")  # a second attempt replaces the first one's, which has the same contents
            return name, (task.partitionId() << 32) + done, None if whole else where, member.begun, member.count

        def rows(found: list[tuple]):
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in _MEMBERS.split(", ")])

        for batch in batches:
            names, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin, found = 0, []
            for k in range(1, len(names) + 1):
                if k < len(names) and names[k] == names[begin]:
                    continue
                if member is None or names[begin] != name:
                    if member is not None:
                        found.append(ended(True))
                        done += 1
                    name, where = names[begin], f"m-{task.partitionId()}-{task.taskAttemptId()}-{done}"
                    member = Member(files, f"{base}/{where}", compress, done > 0)
                member.add(lines[begin:k])
                begin = k
            if found:
                yield rows(found)
        if member is not None:
            yield rows([ended(False)])

    return run


def _documents(folder: str, out: str, compress: bool):
    pack = gz.compress if compress else bytes

    def run(table: pa.Table) -> pa.Table:
        files, base = file_system(folder)
        table = table.sort_by("first")
        name, attempt = table["name"][0].as_py(), TaskContext.get().taskAttemptId()
        temporary = f"{base}/d-{attempt}-{uuid.uuid4().hex}"
        with files.open_output_stream(temporary) as to:
            if not table["begun"][0].as_py():
                to.write(pack(HEAD))
            for k, member in enumerate(table["member"].to_pylist()):
                if k:
                    to.write(pack(BETWEEN))
                with files.open_input_stream(f"{base}/{member}") as own:
                    while block := own.read(BLOCK):
                        to.write(block)
            to.write(pack(TAIL))
        files.move(temporary, f"{base}/{out}/{name}")  # a second attempt replaces the first one's, which has the same contents
        return pa.table({"name": [name], "lines": pa.array([sum(table["lines"].to_pylist())], pa.int64())})

    return run


def file_name(value, gzip: bool):
    """A document's file: letters, digits, marks and the like as they are, other bytes as %XX; a null has a name no value can have."""
    ends = ".json.gz" if gzip else ".json"
    return F.when(value.isNull(), F.lit("%null" + ends)).otherwise(F.concat(F.replace(F.url_encode(value.cast("string")), F.lit("*"), F.lit("%2A")), F.lit(ends)))


def write_documents(events: DataFrame, path: str, by: str | None = None, gzip: bool = True, overwrite: bool = False) -> int:
    """Writes one trace document of the events, or one for each value of `by`, into the folder `path`; returns how many lines. Events stand by start, track and text.

    The folder appears, whole, when all documents are written. It must not exist, unless overwrite is set. Events without documents, so an empty input, give an empty folder.
    """
    files, base = file_system(path)
    from pyarrow import fs

    if not overwrite and files.get_file_info(base).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    folder = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    staged = file_system(folder)[1]
    line = F.to_json(F.struct(*(c for c in FIELDS if c in events.columns))).alias("line")
    name = file_name(F.lit("trace") if by is None else F.col(by), gzip).alias("name")
    keys = [F.col(c).alias(f"__{c}") for c in ("ts", "tid") if c in events.columns]
    order = ["name", *(f"__{c}" for c in ("ts", "tid") if c in events.columns), "line"]
    files.create_dir(f"{staged}/out", recursive=True)
    try:
        lines = events.select(name, *keys, line)
        members = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("name", "line").mapInArrow(_members(folder, "out", gzip), _MEMBERS)
        members = materialise(members, "members")
        materialise(members.where("member is not null").groupBy("name").applyInArrow(_documents(folder, "out", gzip), "name string, lines long"), "documents")
        total = members.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
        if overwrite:
            with contextlib.suppress(FileNotFoundError):
                files.move(base, f"{staged}/old")
        files.move(f"{staged}/out", base)
        return total
    finally:
        files.delete_dir(staged)
