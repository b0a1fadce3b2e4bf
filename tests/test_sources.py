"""Sources on files of a temporary folder."""

import base64
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumentrove.functions import binary, markup
from lumentrove.operators import compositing, images, rules
from lumentrove.sources import files, listing, stores


@pytest.fixture
def site(tmp_path):
    for name, body in {".nojekyll": b"", "LICENSE": b"free", "web/app.js": b"let a;", "web/_x/.hidden": b"h", "assets/a.png": b"\x89PNG", **{f"many/{i:03d}.txt": str(i).encode() for i in range(60)}}.items():
        (tmp_path / "site" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / name).write_bytes(body)
    os.symlink("LICENSE", tmp_path / "site" / "web" / "link")
    os.symlink("..", tmp_path / "site" / "web" / "up")
    (tmp_path / "site" / "empty").mkdir()
    return str(tmp_path / "site")


def test_listing_has_hidden_files_and_links_and_is_sorted(spark, site):
    rows = listing.list_files(spark, site, content=True).collect()
    want = sorted([".nojekyll", "LICENSE", "web/app.js", "web/_x/.hidden", "assets/a.png", "web/link", "web/up", *(f"many/{i:03d}.txt" for i in range(60))])
    assert [r["path"] for r in rows] == want
    kinds = {r["path"]: (r["kind"], r["listed_as"]) for r in rows}
    assert kinds["web/link"] == ("link", "web/link (not a regular file)") and kinds["web/up"][0] == "link" and kinds[".nojekyll"] == ("file", ".nojekyll")
    assert {r["path"]: bytes(r["content"]) for r in rows if r["path"] in ("LICENSE", "many/042.txt")} == {"LICENSE": b"free", "many/042.txt": b"42"}
    assert listing.list_files(spark, site).filter("content is not null").count() == 0


def test_listing_deals_a_large_folder_to_several_tasks(site):
    reader = listing.ListingReader(site, content=False)
    parts = reader.partitions()
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(sizes) == 67 and max(sizes) < 40


def test_listing_by_the_store_of_pyarrow_is_the_mounted_one(spark, site):
    """The way of remote stores, on a folder that is mounted too; it follows no kinds but files and folders."""
    key = lambda r: (r["path"], r["length"], bytes(r["content"] or b""))
    for link in ("web/link", "web/up"):
        os.unlink(f"{site}/{link}")
    mounted = [key(r) for r in listing.list_files(spark, f"file://{site}", content=True).collect()]
    assert mounted == [key(r) for r in listing.list_files(spark, f"file://{site}", content=True, store="arrow").collect()] and len(mounted) == 65
    reader = listing.ListingReader(site, content=False, mounted=False)
    assert max(sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()) < 40


def test_stores_by_their_uris():
    assert stores.open_store("file:///tmp/a%20b")[1] == "/tmp/a b" and stores.open_store("/tmp//x/")[1] == "/tmp/x"
    assert stores.is_known("s3://bucket/x") and not stores.is_known("viewfs://x/y")


class Session:
    """What ``shared_folder`` asks of a session."""

    def __init__(self, master, named=None, at=None):
        self.conf, self.sparkContext, self.master, self.at = {"spark.checkpoint.dir": named} if named else {}, self, master, at

    def getCheckpointDir(self):
        return self.at


def test_a_cluster_must_name_its_shared_folder():
    assert stores.shared_folder(Session("local[4]")) == "/tmp/checkpoints"
    assert stores.shared_folder(Session("spark://one:7077", named="hdfs://x/y/")) == "hdfs://x/y" and stores.shared_folder(Session("yarn", at="s3://z/1")) == "s3://z/1"
    for master in ("spark://one:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stores.shared_folder(Session(master))


def test_parity_of_repeated_paths(spark):
    side = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    source = side([("a", b"1"), ("a", b"1"), ("b", b"1"), ("b", b"2"), ("c", None), ("d", b"1")])
    artifact = side([("a", b"1"), ("a", b"1"), ("b", b"1"), ("b", b"2"), ("c", None), ("e", b"1")])
    got = {r["path"]: tuple(r)[1:] for r in rules.content_parity(source, artifact).collect()}
    assert got == {"a": (True, True, True), "b": (True, True, False), "c": (True, True, False), "d": (True, False, False), "e": (False, True, False)}


def jpeg(orientation: int, order: str, offset: int = 8, entries: int = 1, tag: int = 0x0112, before: bytes = b"", cut: int = 0) -> bytes:
    import struct

    mark = {"<": b"II", ">": b"MM"}[order]
    tiff = mark + struct.pack(order + "HI", 42, offset) + b"\0" * (offset - 8 if offset < 99 else 0) + struct.pack(order + "H", entries) + struct.pack(order + "HHIHH", tag, 3, 1, orientation, 0) + b"\0" * 4
    body = b"Exif\0\0" + tiff[: len(tiff) - cut]
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2"


def test_orientation_of_jpeg_headers(spark):
    other = b"\xff\xe1\0\x0aother\0\0\0"
    cases = [(jpeg(i, order), i) for i in range(1, 9) for order in "<>"]
    cases += [(jpeg(3, ">", before=other * 40), 3), (jpeg(6, "<", offset=20), 6), (jpeg(0, "<"), None), (jpeg(9, ">"), None), (jpeg(5, "<", offset=70_000), None), (jpeg(5, ">", offset=50), 5), (jpeg(5, "<", tag=0x0113), None), (jpeg(5, ">", entries=0), None)]
    cases += [(jpeg(5, "<", entries=60_000), 5), (jpeg(5, "<", cut=12), None), (b"", None), (None, None), (b"\xff\xd8", None), (b"\x89PNG", None), (b"\xff\xd8\xff\xda" + jpeg(2, "<")[2:], None), (b"\xff\xd8" + b"\xff\xe1\0\0" * 9, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = {r["i"]: r["orientation"] for r in binary.with_exif_orientation(df, F.col("content")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_sizes_within_a_bound(spark):
    df = spark.createDataFrame([(8000, 2000, 6), (100, 4096, 1), (5, 9000, None), (0, 0, 3)], "w int, h int, o int").filter("w > 0")
    w, h = binary.displayed_size(F.col("w"), F.col("h"), F.col("o"))
    small, large = binary.bounded_size(w, h, 4096), binary.bounded_size(w, h, 10_000, enlarge=True)
    assert [tuple(r) for r in df.select(w, h, *small, *large).collect()] == [(2000, 8000, 1024, 4096, 2500, 10_000), (100, 4096, 100, 4096, 244, 10_000), (5, 9000, 2, 4096, 6, 10_000)]


@pytest.mark.parametrize(("w", "h", "tw", "th"), [(7, 5, 3, 2), (4, 4, 4, 4), (3, 2, 8, 9), (10, 1, 1, 1), (5, 6, 7, 4)])
def test_resampling_keeps_mass_and_matches_plain_overlaps(spark, w, h, tw, th):
    rng = np.random.default_rng(w * h)
    image = rng.normal(0, 10, (h, w))
    rows = [(x, y, float(image[y, x])) for y in range(h) for x in range(w)] + [(w, 0, 99.0), (-1, 0, 99.0)]
    df = spark.createDataFrame(rows, "x int, y int, v double").withColumns({c: F.lit(v) for c, v in (("w", w), ("h", h), ("tw", tw), ("th", th))})
    out = images.resample(df, [], *[F.col(c) for c in ("x", "y", "w", "h", "tw", "th")], {"v": F.col("v")}).collect()
    share = lambda n, m: np.array([[max(0.0, min(i + 1, (j + 1) * m / n) - max(i, j * m / n)) for j in range(n)] for i in range(m)])
    want = share(h, th) @ image @ share(w, tw).T
    got = np.full((th, tw), np.nan)
    for r in out:
        got[r["y"], r["x"]] = r["v"]
        assert abs(r["coverage"] - 1) < 1e-9
    assert np.allclose(got, want, atol=1e-9) and abs(got.sum() - image.sum() * tw * th / (w * h)) < 1e-9


def test_draw_order_and_compositing_of_one_hot_view(spark, request):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2990, F.concat(F.lit("v"), (F.col("id") % 40).cast("string"))).alias("view"), (F.col("id") * 7919 % 50).cast("double").alias("depth"), "id", (F.col("id") % 10 / 1000).alias("a"), (F.col("id") % 17).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on tables that fill their partitions
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    cut = compositing.in_blocks(df, ["view"], ["id"]).groupBy("_block").count().collect()
    assert len(cut) > 1 and max(r["count"] for r in cut) < 2500
    w = Window.partitionBy("view").orderBy(F.desc("depth"), "id")
    got = {tuple(r) for r in compositing.depth_order(df, ["view"], F.col("depth"), "id").select("id", "draw_order").collect()}
    assert got == {tuple(r) for r in df.select("id", F.row_number().over(w) - 1).collect()}
    stacks = {}
    for r in df.orderBy("id").collect():
        n, light, color, cover = stacks.get(r["view"], (0, 1.0, 0.0, 0.0))
        stacks[r["view"]] = n + 1, light * (1 - r["a"]), color + light * r["a"] * r["v"], cover + light * r["a"]
    for r in compositing.composite(df, ["view"], ["id"], F.col("a"), F.col("v")).collect():
        n, _, color, cover = stacks[r["view"]]
        assert r["layers"] == n and abs(r["color"] - color) < 1e-9 and abs(r["coverage"] - cover) < 1e-9


def test_artifact_rules_over_listings(spark, site, tmp_path):
    names = [".nojekyll", "LICENSE", "web/app.js", "web/link", "absent.md"]
    required = spark.createDataFrame([(n,) for n in names], "path string")
    (tmp_path / "source" / "web").mkdir(parents=True)
    for name, body in {".nojekyll": b"", "LICENSE": b"free", "web/app.js": b"let b;", "web/link": b"free"}.items():
        (tmp_path / "source" / name).write_bytes(body)
    source, artifact = (listing.list_files(spark, p, content=True) for p in (f"{tmp_path}/source", site))
    found = {(r["path"], r["rule"]): r["passed"] for r in rules.artifact_rules(required, source, artifact).collect()}
    assert all(found[n, rule] for n in (".nojekyll", "LICENSE") for rule in ("regular source file", "regular artifact file", "byte parity"))
    assert found["web/app.js", "regular artifact file"] and not found["web/app.js", "byte parity"]
    assert found["web/link", "regular source file"] and not found["web/link", "regular artifact file"]
    assert found["absent.md", "missing"] is False and found["web/link", "missing"] is False
    assert found["web/link (not a regular file)", "unexpected"] is False and found["many/000.txt", "unexpected"] is False


def test_texts_binaries_and_ply(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 1234\nend_header\n"
    contents = {"a.ply": head + b"\0" * 9, "deep/b.ply": b"", "deep/c.ply": b"no header", "note.txt": "naïve\ntext".encode()}
    for name, body in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    texts = files.read_texts(spark, {"note": f"{tmp_path}/note.txt", "again": f"{tmp_path}/note.txt"}).collect()
    assert {(r["name"], r["text"]) for r in texts} == {("note", "naïve\ntext"), ("again", "naïve\ntext")}
    assert files.read_binaries(spark, str(tmp_path)).count() == 3  # without the empty one
    found = {r["path"].rpartition("/")[2]: (r["accepted"], r["vertices"], r["sha256"]) for r in files.read_ply(spark, str(tmp_path)).collect()}
    assert found == {"a.ply": (True, 1234.0, hashlib.sha256(contents["a.ply"]).hexdigest()), "b.ply": (False, 0.0, hashlib.sha256(b"").hexdigest()), "c.ply": (True, 0.0, hashlib.sha256(b"no header").hexdigest())}


def test_ply_header_at_the_end_of_the_prefix(spark):
    line = b"element vertex 77\n"
    pad = lambda n: b"ply\n" + b"x" * (n - 5) + b"\n"
    rows = [(0, pad(4096 - len(line)) + line), (1, pad(4096 - len(line) + 2) + line), (2, b"ply\r\nelement vertex 77\r\n"), (3, None), (4, b"element vertex 9 \nelement vertex 8\n")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "n int, c binary").select("n", binary.ply_vertex_count(F.col("c"))).collect()}
    # A number that the end of the prefix cuts counts as far as it goes; carriage returns end lines.
    assert got == {0: 77.0, 1: 7.0, 2: 77.0, 3: 0.0, 4: 8.0}


def test_data_url_bytes(spark):
    url = "data:image/jpeg;base64," + base64.b64encode(b"\xff\xd8abc").decode()
    rows = [(0, url), (1, "data:,plain"), (2, None), (3, "data:;base64,!!")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "n int, u string").select("n", binary.data_url_bytes(F.col("u"))).collect()}
    assert bytes(got.pop(0)) == b"\xff\xd8abc" and got == {1: None, 2: None, 3: None}


def test_literal_tables_and_their_ids(spark):
    assert [tuple(r) for r in files.ordered_values(spark, ["b", "a"]).orderBy("ord").collect()] == [(0, "b"), (1, "a")]


def test_relative_paths_and_order_of_places(spark):
    rows = spark.createDataFrame([("/a/b/c.txt", "/a/b/"), ("C:\\x\\y", "C:\\x"), ("/q", "/a")], "p string, r string")
    assert [r[0] for r in rows.select(markup.relative_path(F.col("p"), F.col("r"))).collect()] == ["c.txt", "y", "/q"]
    text = spark.createDataFrame([("first second",), ("second first",), ("second",)], "t string")
    assert [r[0] for r in text.select(markup.occurs_before(F.col("t"), "first", "second")).collect()] == [True, False, False]
