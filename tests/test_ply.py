"""PLY files: written, split, read back, cut short and written twice."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrove.functions.binary import ply_vertex_count
from lumentrove.sources import ply

N = 1000


def cloud(n: int = N) -> np.ndarray:
    rng = np.random.default_rng(1)
    out = np.zeros(n, [("x", "<f4"), ("y", "<f8"), ("red", "u1"), ("odd-name", "<i2"), ("k", "<u4")])
    for name in out.dtype.names:
        out[name] = rng.normal(0, 50, n) if out.dtype[name].kind == "f" else rng.integers(0, 200, n)
    out["k"] += 3_000_000_000
    return out


NAMES = {"f4": "float", "f8": "double", "u1": "uchar", "i2": "int16", "u4": "uint32"}


def ply_bytes(rows: np.ndarray, kind: str, announced: int | None = None, before: bytes = b"", header: str = "", newline: str = "\n", after: bytes = b"") -> bytes:
    properties = [f"property {NAMES[rows.dtype[name].str[1:]]} {name}" for name in rows.dtype.names]
    head = newline.join(["ply", f"format {kind} 1.0", "comment made by hand", *header.split("\n"), f"element vertex {len(rows) if announced is None else announced}", *properties, "element face 1", "property list uchar int vertex_indices", "end_header", ""]).replace(newline * 2, newline)
    if kind == "ascii":
        body = "".join(" ".join(repr(v.item()) if v.dtype.kind == "f" else str(v) for v in row) + newline for row in rows).encode()
    else:
        body = rows.astype(rows.dtype.newbyteorder("<" if "little" in kind else ">")).tobytes()
    return head.encode() + before + body + after


def as_tuples(df, names):
    return sorted(tuple(r[c] for c in ("vertex", *names)) for r in df.collect())


def expected(rows):
    return [(i, *(v.item() for v in row)) for i, row in enumerate(rows)]


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_any_split_reads_the_same_rows(spark, tmp_path, kind, newline):
    rows = cloud()
    rows["x"] = np.round(rows["x"], 2)
    face = b"3 0 1 2" + newline.encode() if kind == "ascii" else struct.pack("<B3i", 3, 0, 1, 2)
    data = ply_bytes(rows, kind, newline=newline, after=face)
    (tmp_path / "one.ply").write_bytes(data)
    for split in (1 << 26, len(data) // 10 + 1, 997):
        df = ply.read_points(spark, f"{tmp_path}/one.ply", split_bytes=split)
        assert df.rdd.getNumPartitions() >= 1 and as_tuples(df, rows.dtype.names) == expected(rows)
    assert dict(df.dtypes) == {"path": "string", "vertex": "bigint", "x": "float", "y": "double", "red": "smallint", "odd-name": "smallint", "k": "bigint"}


def test_ten_ranges_are_ten_partitions(spark, tmp_path):
    data = ply_bytes(cloud(), "binary_little_endian")
    (tmp_path / "one.ply").write_bytes(data)
    spark.dataSource.register(ply.PlySource)
    df = spark.read.format("ply").option("splitBytes", len(data) // 10 + 1).load(f"{tmp_path}/one.ply")
    counts = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 10 and sum(counts) == N and max(counts) <= 110


def test_folders_unlike_files_and_chosen_columns(spark, tmp_path):
    rows = cloud(20)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.ply").write_bytes(ply_bytes(rows, "binary_big_endian", header="element camera 2\nproperty float fov", before=b"\0" * 8))
    (tmp_path / "two.ply").write_bytes(ply_bytes(rows[["x", "k"]].astype([("x", "<f4"), ("k", "<u4")]), "ascii"))
    for hidden in ("_three.ply", ".four.ply", "five.txt"):
        (tmp_path / hidden).write_bytes(b"nothing")
    df = ply.read_points(spark, str(tmp_path), "path string, vertex bigint, k bigint, red int, none double", split_bytes=50)
    got = {(r["path"][-9:], r["vertex"]): (r["k"], r["red"], r["none"]) for r in df.collect()}
    assert got == {("a/one.ply", i): (row["k"], row["red"], None) for i, row in enumerate(rows)} | {(f"{str(tmp_path)[-1]}/two.ply", i): (row["k"], None, None) for i, row in enumerate(rows)}


def test_truncated_and_broken_files(spark, tmp_path):
    rows = cloud(50)
    whole = ply_bytes(rows, "binary_little_endian", announced=60)
    (tmp_path / "cut.ply").write_bytes(whole[:-3])
    (tmp_path / "lines.ply").write_bytes(ply_bytes(rows, "ascii", announced=60))
    (tmp_path / "none.ply").write_bytes(b"")
    (tmp_path / "other.ply").write_bytes(b"plx\nend_header\n")
    (tmp_path / "list.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int v\nend_header\n1 2\n")
    (tmp_path / "whole.ply").write_bytes(ply_bytes(rows, "binary_big_endian"))
    got = {r["path"].rpartition("/")[2]: (r["format"], r["announced"], r["present"], r["problem"]) for r in ply.point_files(spark, str(tmp_path)).collect()}
    assert got["cut.ply"] == ("binary_little_endian", 60, 49, "truncated") and got["lines.ply"] == ("ascii", 60, 50, "truncated") and got["whole.ply"] == ("binary_big_endian", 50, 50, None)
    assert got["none.ply"] == got["other.ply"] == (None, None, None, "no PLY header") and got["list.ply"][3] == "a vertex property is a list"
    with pytest.raises(Exception, match="49 of 60 vertices"):
        ply.read_points(spark, f"{tmp_path}/cut.ply").collect()
    for split in (1 << 20, 100):
        kept = ply.read_points(spark, f"{tmp_path}/cut.ply", truncated="keep", split_bytes=split)
        assert as_tuples(kept, rows.dtype.names) == expected(rows)[:49]
    (tmp_path / "word.ply").write_bytes(ply_bytes(rows, "ascii").replace(b"\n", b"\nbad ", 14)[:400])
    with pytest.raises(Exception, match="PLY|numbers|header"):
        ply.read_points(spark, f"{tmp_path}/word.ply").collect()


def test_written_rows_come_back(spark, tmp_path):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 100).cast("tinyint").alias("a"), F.col("id").cast("int").alias("b"), (F.col("id") / 3).cast("float").alias("c"), F.when(F.col("id") % 5 > 0, F.sqrt("id")).alias("d e".replace(" ", "_")))
    out = f"{tmp_path}/out"
    ply.write_points(df, out)
    names = df.columns
    key = lambda r: tuple("nan" if v is None or v != v else v for v in r)
    back = ply.read_points(spark, out)
    assert back.columns == ["path", "vertex", *names]
    assert sorted(map(key, back.select(*names).collect()), key=str) == sorted(map(key, df.collect()), key=str)
    heads = spark.read.format("binaryFile").load(f"{out}/*.ply").select(ply_vertex_count(F.col("content")).alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert tuple(heads) == (5000, 7)
    ply.write_points(df.limit(10), out, "append")
    assert ply.read_points(spark, out).count() == 5010
    ply.write_points(df.filter("false"), out)
    assert ply.read_points(spark, out).count() == 0 and ply.point_files(spark, out).first()["problem"] is None
    assert sorted(x for x in os.listdir(out) if not x.startswith(".")) == sorted(["_SUCCESS", *[x for x in os.listdir(out) if x.startswith("part-")]])


def test_parts_become_one_file(spark, tmp_path):
    df = spark.range(0, 3000, 1, 6).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).cast("double").alias("x"))
    ply.write_points(df, f"{tmp_path}/parts")
    assert ply.join_points(spark, f"{tmp_path}/parts", f"{tmp_path}/whole.ply") == 3000
    got = ply.read_points(spark, f"{tmp_path}/whole.ply", split_bytes=1000).orderBy("vertex").collect()
    assert [r["k"] for r in got] == list(range(3000)) == [r["vertex"] for r in got] and os.listdir(tmp_path) and not os.path.exists(f"{tmp_path}/whole.ply.part")


def test_only_accepted_attempts_are_committed(spark, tmp_path, monkeypatch):
    """Two attempts wrote the same rows; the driver accepted the second."""
    import pyarrow as pa

    schema = spark.createDataFrame([(1.0,)], "x double").schema
    writer = ply.PlyWriter(f"{tmp_path}/out", schema, True)

    class Task:
        attempt = 0

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return self.attempt

    task = Task()
    monkeypatch.setattr(ply.TaskContext, "get", staticmethod(lambda: task))
    rows = lambda: iter([pa.RecordBatch.from_pydict({"x": [1.0, None, 3.0]})])
    writer.write(rows())
    task.attempt = 9
    second = writer.write(rows())
    with pytest.raises(ValueError, match="null"):
        ply.PlyWriter(f"{tmp_path}/out", spark.createDataFrame([(1,)], "k int").schema, True).write(iter([pa.RecordBatch.from_pydict({"k": pa.array([None], pa.int32())})]))
    writer.commit([second, None])
    assert [x for x in os.listdir(f"{tmp_path}/out") if not x.startswith("_")] == [f"part-00003-{writer.job}.ply"]
    assert not any(x.startswith(f"_job-{writer.job}") for x in os.listdir(f"{tmp_path}/out"))
    monkeypatch.undo()
    assert ply.read_points(spark, f"{tmp_path}/out").count() == 3
    failed = ply.PlyWriter(f"{tmp_path}/out", schema, True)
    failed.abort([])
    assert ply.read_points(spark, f"{tmp_path}/out").count() == 3


def test_columns_without_a_type_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no PLY type"):
        ply.write_points(spark.range(3), f"{tmp_path}/out")
