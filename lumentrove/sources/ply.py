"""PLY point files as a Spark data source: a splittable reader and a writer with a two-phase commit.

Reading.  The driver lists files and cuts them into byte ranges by their sizes; it
opens only the first one, for the schema.  A task reads the header of its own
file, which fixes the width of a binary record, moves the ends of its range to
whole records and hands them on as Arrow batches.  Lines of an ASCII body have no
fixed width; a line belongs to the range in which it starts, and ``read_points``
numbers the lines from the counts of the ranges before.

    spark.dataSource.register(PlySource)
    spark.read.format("ply").load("/clouds")              # a file or a folder
    df.write.format("ply").mode("overwrite").save("/out")

Columns: path, the record's number (``vertex``), and one column for each scalar
property of the element ``vertex``, whatever its name, with the type of the file;
a property that a file lacks is null.  Other elements are passed over if they
follow the vertices or have records of fixed width.

A body that is shorter than its header says is an error, or gives its whole
records with the option ``truncated`` set to ``keep``; ``point_files`` tells announced
from present records without failing.

Writing.  A task counts its rows while it writes their records to a file of its
own, puts the header with that count before them, and leaves the file under a
name of its attempt.  The commit moves the files of the attempts that the driver
accepted to their places, and removes all others, so a repeated or failed task
leaves nothing.  Rows never pass the driver.  ``join_points`` makes one file of the
parts: the sum of the counts fixes the header, the counts fix each part's place,
and tasks copy their parts there.

Defined cases: an empty table writes one file without records; null is NaN in a
float property and an error in a whole-number one, which has no value for it;
LONG, DECIMAL and nested columns have no PLY type and are refused.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .stores import open_store

# The format's type names, old and new, with numpy codes and Spark types.
TYPES = {"char": ("i1", "tinyint"), "uchar": ("u1", "smallint"), "short": ("i2", "smallint"), "ushort": ("u2", "int"), "int": ("i4", "int"), "uint": ("u4", "bigint"), "float": ("f4", "float"), "double": ("f8", "double")}
ALIASES = {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "float64": "double"}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}
WRITTEN = {"byte": "char", "tinyint": "char", "smallint": "short", "int": "int", "float": "float", "double": "double"}
# The properties of a splat without view-dependent colour, as published with 3D Gaussian splatting (Kerbl et al., 2023).
SPLAT = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]

MOST_HEADER = 1 << 20
SPLIT_BYTES = 64 << 20
BATCH_RECORDS = 1 << 16
SPOOL_BYTES = 32 << 20
OWN = ("path", "vertex")


class PlyError(ValueError):
    """A file that is no PLY file, or not a whole one."""


@dataclass
class Header:
    """What a header says of the vertices and where their records start."""

    order: str
    vertices: int
    properties: dict[str, str]
    start: int

    @property
    def record(self) -> np.dtype:
        return np.dtype([(name, (self.order or "<") + TYPES[kind][0]) for name, kind in self.properties.items()])


def parse_header(head: bytes, path: str) -> Header:
    """Of the first bytes of a file; raises ``PlyError`` where there is no header that can be read."""
    end = re.search(rb"^end_header[ \t]*\r?\n", head, re.M)
    if not head.startswith(b"ply") or end is None:
        raise PlyError(f"{path}: no PLY header")
    order, elements = None, []
    for line in head[: end.start()].decode("iso-8859-1").splitlines()[1:]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "format" and len(word) >= 2 and word[1] in ORDERS:
            order = ORDERS[word[1]]
        elif word[0] == "element" and len(word) == 3 and word[2].isdigit():
            elements.append((word[1], int(word[2]), {}))
        elif word[0] == "property" and elements and len(word) == 3 and ALIASES.get(word[1], word[1]) in TYPES:
            elements[-1][2][word[2]] = ALIASES.get(word[1], word[1])
        elif word[0] == "property" and elements and len(word) == 5 and word[1] == "list":
            elements[-1][2][word[4]] = "list"
        else:
            raise PlyError(f"{path}: cannot read the header line {line!r}")
    if order is None:
        raise PlyError(f"{path}: unknown format")
    start = end.end()
    for name, count, properties in elements:
        listed = "list" in properties.values()
        if name == "vertex":
            if listed:
                raise PlyError(f"{path}: a vertex property is a list")
            return Header(order, count, properties, start)
        if count and (listed or not order):
            raise PlyError(f"{path}: records of unknown width before the vertices")
        start += count * sum(np.dtype(TYPES[kind][0]).itemsize for kind in properties.values()) if count else 0
    return Header(order, 0, {}, start)


def read_header(source: pa.NativeFile, path: str) -> Header:
    """Reads no more of a file than its header, rounded up to some kilobytes."""
    head = b""
    while len(head) < MOST_HEADER:
        more = source.read(16384)
        head += more
        if not more or re.search(rb"^end_header[ \t]*\r?\n", head, re.M):
            break
    return parse_header(head, path)


def ply_files(path: str) -> list[tuple[str, int]]:
    """(URI or path, size) of a file, or of the ``.ply`` files below a folder, hidden ones excepted."""
    store, inside = open_store(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    base = path.rstrip("/")
    found = store.get_file_info(fs.FileSelector(inside, recursive=True))
    below = ((f.path[len(inside.rstrip("/")) + 1 :], f.size) for f in found if f.type == fs.FileType.File)
    return sorted((f"{base}/{name}", size) for name, size in below if name.endswith(".ply") and not any(part[0] in "._" for part in name.split("/")))


class Range(InputPartition):
    """Bytes [first, last) of a file."""

    def __init__(self, path: str, size: int, first: int, last: int) -> None:
        self.path, self.size, self.first, self.last = path, size, first, last


def ascii_lines(source: pa.NativeFile, first: int, last: int, start: int, size: int) -> Iterator[list[bytes]]:
    """Lists of the lines that start in [first, last); the body starts at ``start``."""
    at = max(first, start)
    if at > start:  # the line before belongs to the range before, unless it ends right here
        source.seek(at - 1)
        rest = source.read(1) != b"\n"
    else:
        source.seek(at)
        rest = False
    kept = b""
    while at < last or kept or rest:
        block = source.read(min(1 << 20, size - at)) if at < size else b""
        if rest:
            cut = block.find(b"\n")
            if cut < 0 and block:
                at += len(block)
                continue
            rest = False
            at, block = at + cut + 1, block[cut + 1 :]
            if at >= last:
                return
        data = kept + block
        first_at = at - len(kept)  # place of data[0]
        at += len(block)
        if at < size and len(block):
            cut = data.rfind(b"\n") + 1
            lines, kept = data[:cut], data[cut:]
        else:
            lines, kept = data, b""
        if first_at + len(lines) > last:  # the line at the end of the range is the last one
            stop = lines.find(b"\n", max(0, last - first_at - 1))
            if stop >= 0:
                lines, kept, at = lines[: stop + 1], b"", last
        found = [x for x in lines.splitlines() if x.strip()]
        if found:
            yield found
        if at >= last and not kept or not len(block) and not kept:
            return


class PlyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict) -> None:
        self.path, self.columns, self.schema = path, schema.fieldNames(), schema
        self.keep = options.get("truncated", "error") == "keep"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.ascii_only = options.get("only", "") == "ascii"

    def partitions(self) -> list[Range]:
        return [Range(path, size, at, min(at + self.split, size)) for path, size in ply_files(self.path) for at in range(0, max(size, 1), self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        store, inside = open_store(part.path)
        with store.open_input_file(inside) as source:
            header = read_header(source, part.path)
            if self.ascii_only and header.order:
                return
            chunks = self.binary(source, header, part) if header.order else self.text(source, header, part)
            for first, nth, rows in chunks:
                many = len(rows)
                own = {"path": lambda n=many: pa.array([part.path] * n), "vertex": lambda n=many, a=first: pa.nulls(n, pa.int64()) if a is None else pa.array(np.arange(a, a + n)), "_range": lambda n=many: pa.array(np.full(n, part.first)), "_nth": lambda n=many, a=nth: pa.array(np.arange(a, a + n)), "_announced": lambda n=many: pa.array(np.full(n, header.vertices))}
                made = []
                for field in arrow:
                    if field.name in header.properties and field.name not in OWN:
                        values = rows[field.name]
                        made.append(pa.array(values.astype(values.dtype.newbyteorder("="))).cast(field.type))
                    else:
                        made.append(own[field.name]().cast(field.type) if field.name in own else pa.nulls(many, field.type))
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    def binary(self, source: pa.NativeFile, header: Header, part: Range) -> Iterator[tuple[int | None, int, np.ndarray]]:
        width = header.record.itemsize
        if not width:
            return
        there = min(header.vertices, max(0, part.size - header.start) // width)
        if there < header.vertices and not self.keep:
            raise PlyError(f"{part.path}: {there} of {header.vertices} vertices are there")
        place = lambda byte: min(there, max(0, -(-(byte - header.start) // width)))
        at, end = place(part.first), place(part.last) if part.last < part.size else there
        source.seek(header.start + at * width)
        nth = 0
        while at < end:
            n = min(BATCH_RECORDS, end - at)
            yield at, nth, np.frombuffer(source.read(n * width), header.record, n)
            at, nth = at + n, nth + n

    def text(self, source: pa.NativeFile, header: Header, part: Range) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Vertices are numbered only where the range holds the body's start; the others are by ``read_points``."""
        names, nth = list(header.properties), 0
        for lines in ascii_lines(source, part.first, part.last, header.start, part.size):
            if part.first <= header.start:
                lines = lines[: max(0, header.vertices - nth)]
            words = [x.split() for x in lines]
            if part.first > header.start:  # what follows the vertices may be of another shape and is left out by number
                words = [w if len(w) == len(names) else [b"0"] * len(names) for w in words]
            rows = np.zeros(len(words), header.record)
            for i, name in enumerate(names):
                try:
                    rows[name] = np.array([w[i] for w in words]).astype(rows[name].dtype) if words else []
                except (IndexError, ValueError) as problem:
                    raise PlyError(f"{part.path}: a line without {len(names)} numbers") from problem
            if words:
                yield (nth if part.first <= header.start else None), nth, rows
            nth += len(words)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        refused = [f.name for f in schema if f.dataType.simpleString() not in WRITTEN]
        if refused or not len(schema):
            raise ValueError(f"no PLY type for the columns {refused}" if refused else "a PLY file needs a column")
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.kinds = {f.name: WRITTEN[f.dataType.simpleString()] for f in schema}

    def header(self, rows: int) -> bytes:
        properties = "".join(f"property {kind} {name}\n" for name, kind in self.kinds.items())
        return f"ply\nformat binary_little_endian 1.0\nelement vertex {rows}\n{properties}end_header\n".encode()

    @property
    def record(self) -> np.dtype:
        return np.dtype([(name, "<" + TYPES[kind][0]) for name, kind in self.kinds.items()])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        rows = 0
        with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as body:  # of this task only
            for batch in iterator:
                out = np.zeros(batch.num_rows, self.record)
                for name, kind in self.kinds.items():
                    column = batch.column(batch.schema.get_field_index(name))
                    if column.null_count:
                        if kind not in ("float", "double"):
                            raise ValueError(f"null in the whole-number property {name}")
                        column = column.fill_null(float("nan"))
                    out[name] = column.to_numpy(zero_copy_only=False)
                body.write(out.tobytes())
                rows += batch.num_rows
            body.seek(0)
            name = f"_job-{self.job}/part-{task.partitionId():05d}-{task.taskAttemptId()}.ply"
            store, inside = open_store(f"{self.path}/{name}")
            store.create_dir(inside.rpartition("/")[0], recursive=True)
            with store.open_output_stream(inside) as out:
                out.write(self.header(rows))
                while block := body.read(1 << 20):
                    out.write(block)
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for path, _ in ply_files(self.path):
                store.delete_file(open_store(path)[1])
        kept = [m for m in messages if m is not None and m.rows]
        for m in kept:
            name = m.path.rpartition("/")[2]
            store.move(f"{root}/{m.path}", f"{root}/{name.rpartition('-')[0]}-{self.job}.ply")
        if not kept:
            with store.open_output_stream(f"{root}/part-00000-{self.job}.ply") as out:
                out.write(self.header(0))
        self.clear()
        with store.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        store, root = open_store(f"{self.path}/_job-{self.job}")
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        """Of the first file; give a schema to ``spark.read`` where files differ."""
        found = ply_files(self.options["path"])
        properties: dict[str, str] = {}
        if found:
            store, inside = open_store(found[0][0])
            with store.open_input_file(inside) as source:
                properties = read_header(source, found[0][0]).properties
        return ", ".join(["path string", "vertex bigint", *[f"`{name}` {TYPES[kind][1]}" for name, kind in properties.items() if name not in OWN]])

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema, overwrite)


def read_points(spark: SparkSession, path: str, schema: str | None = None, truncated: str = "error", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, vertex, properties): every vertex with its number, of binary and ASCII files alike."""
    spark.dataSource.register(PlySource)
    reader = lambda: spark.read.format("ply").option("truncated", truncated).option("splitBytes", split_bytes)
    found = reader().load(path) if schema is None else reader().schema(schema).load(path)
    own = reader().schema(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields] + ["_range bigint", "_nth bigint", "_announced bigint"])).load(path)
    # Lines of ASCII files by range; of binary files only the headers are read for this.
    per_range = reader().option("only", "ascii").schema("path string, _range bigint").load(path).groupBy("path", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    if per_range.isEmpty():
        return found
    before = Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_range.select("path", "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    numbered = own.join(bases, ["path", "_range"], "left").withColumn("vertex", F.coalesce("vertex", F.col("_base") + F.col("_nth")))
    return numbered.filter(F.col("vertex") < F.col("_announced")).select(*found.columns)


def point_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, announced, present, problem) of every file; tasks read the headers, and count the lines of ASCII bodies."""
    files = spark.createDataFrame(ply_files(path) or [], "path string, size long").repartition(max(1, spark.sparkContext.defaultParallelism))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inside = open_store(name)
                with store.open_input_file(inside) as source:
                    try:
                        header = read_header(source, name)
                    except PlyError as problem:
                        rows.append((name, None, None, None, str(problem).partition(": ")[2]))
                        continue
                    width = header.record.itemsize
                    lines = ascii_lines(source, 0, size, header.start, size)
                    there = max(0, size - header.start) // width if header.order and width else sum(map(len, lines)) if not header.order else 0
                there = min(there, header.vertices)
                rows.append((name, next(k for k, v in ORDERS.items() if v == header.order), header.vertices, there, None if there == header.vertices else "truncated"))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "format", "announced", "present", "problem"])

    return files.mapInArrow(probe, "path string, format string, announced long, present long, problem string")


def write_points(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """A folder of PLY files, one for each task that has rows."""
    df.sparkSession.dataSource.register(PlySource)
    df.write.format("ply").mode(mode).save(folder)


def join_points(spark: SparkSession, folder: str, target: str) -> int:
    """Makes one file of the parts in ``folder``, in the order of their names, and returns its vertices.

    The header needs the sum of the counts and each part its place, both known from
    the parts' own headers; tasks then copy the bodies, a part each, so nothing but
    counts passes the driver.  A repeated task writes the same bytes to the same
    place.  The target must be on a mounted file system, as places are written
    out of order.
    """
    parts = []
    for path, size in ply_files(folder):
        store, inside = open_store(path)
        with store.open_input_file(inside) as source:
            parts.append((path, size, read_header(source, path)))
    kinds = {tuple(h.properties.items()) for *_, h in parts if h.vertices} or {tuple(parts[0][2].properties.items())}
    if len(kinds) > 1 or any(h.order != "<" for *_, h in parts):
        raise PlyError("the parts differ in their properties or are not little-endian")
    total = sum(h.vertices for *_, h in parts)
    properties = "".join(f"property {kind} {name}\n" for name, kind in next(iter(kinds)))
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {total}\n{properties}end_header\n".encode()
    local = open_store(target)[1]
    copies, at = [], len(head)
    for path, _, h in parts:
        size = h.vertices * h.record.itemsize
        if size:
            copies.append((path, h.start, size, at))
        at += size
    with open(local + ".part", "wb") as out:
        out.write(head)
        out.truncate(at)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inside = open_store(row["path"])
                with store.open_input_file(inside) as source, open(local + ".part", "r+b") as out:
                    source.seek(row["start"])
                    out.seek(row["at"])
                    left = row["size"]
                    while left:
                        block = source.read(min(left, 1 << 20))
                        out.write(block)
                        left -= len(block)
            yield pa.RecordBatch.from_pydict({"copied": pa.array([batch.num_rows], pa.int64())})

    if copies:
        jobs = spark.createDataFrame(copies, "path string, start long, size long, at long").repartition(len(copies), "path")
        jobs.mapInArrow(copy, "copied long").agg(F.sum("copied")).first()
    fs.LocalFileSystem().move(local + ".part", local)
    return total
