"""Probes of binary headers as native expressions on BINARY columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signatures and the prefix that is searched for a header.
PNG_SIGNATURE = "89504E470D0A1A0A"
PLY_PREFIX_BYTES = 4096
VERTEX_LINE = r"(?m)^element vertex (\d+)$"


def big_endian(content: Column, offset: int, size: int) -> Column:
    """Unsigned big-endian number at a byte offset (from 0)."""
    return F.conv(F.hex(F.substring(content, offset + 1, size)), 16, 10).try_cast("long")


def ply_vertex_count(content: Column) -> Column:
    """Vertices that a PLY header announces; 0 where none is found in the first 4096 bytes."""
    head = F.decode(F.substring(content, 1, PLY_PREFIX_BYTES), "ISO-8859-1")
    found = F.regexp_extract(head, VERTEX_LINE, 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))


def is_ply_payload(content: Column) -> Column:
    """Whether there are bytes at all, which is all that ingestion asks of a PLY file."""
    return F.coalesce(F.octet_length(content) > 0, F.lit(False))


def is_png(content: Column) -> Column:
    return F.coalesce((F.octet_length(content) >= 24) & (F.hex(F.substring(content, 1, 8)) == PNG_SIGNATURE), F.lit(False))


def png_width(content: Column) -> Column:
    return F.when(is_png(content), big_endian(content, 16, 4))


def png_height(content: Column) -> Column:
    return F.when(is_png(content), big_endian(content, 20, 4))


def is_screenshot(content: Column, width: int = 1280, height: int = 720, most_bytes: int = 1 << 20) -> Column:
    """A PNG of an exact size that is not too large a file."""
    return is_png(content) & (F.octet_length(content) <= most_bytes) & (png_width(content) == width) & (png_height(content) == height)


def data_url_bytes(url: Column) -> Column:
    """Bytes of a base64 data URL; null where there is no such payload."""
    return F.when(F.contains(url, F.lit("base64,")), F.try_to_binary(F.substring_index(url, "base64,", -1), F.lit("base64")))


def walked(start: Column, step: Callable[[Column], Column], first: int, room: Column) -> Column:
    """Where ``step`` leads from ``start``: ``first`` times, and where it has not ended then, as often again as the content has room for.

    A place is negative once it is the last, so that what is left of the steps costs nothing.
    """
    onward = lambda at, _: F.when(at < 0, at).otherwise(step(at))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, onward)
    rest = lambda at: F.aggregate(F.sequence(F.lit(1), room.cast("int") + 1), at, onward)
    return once(near, lambda at: F.when(at < 0, at).otherwise(rest(at)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def jpeg_frame(content: Column) -> Column:
    """STRUCT(height, width, components) of a JPEG's first frame header; null if there is none.

    The segments before it are skipped by their lengths: 64 at first, and where
    these do not reach it, as many more as the content has room for.
    """
    byte = lambda at: F.hex(F.substring(content, at + 1, F.lit(1)))
    pair = lambda at: F.conv(F.hex(F.substring(content, at + 1, F.lit(2))), 16, 10).try_cast("int")

    def step(at: Column) -> Column:
        marker = byte(at + 1)
        frame = F.startswith(marker, F.lit("C")) & ~marker.isin("C4", "C8", "CC")
        return F.when(frame | (marker == ""), -at).otherwise(at + 2 + F.coalesce(pair(at + 2), F.lit(0)))

    jpeg = F.coalesce(F.hex(F.substring(content, 1, 2)) == "FFD8", F.lit(False))
    at = F.abs(walked(F.lit(2), step, 64, F.octet_length(content) / 2))
    frame = lambda at: F.when(F.startswith(byte(at + 1), F.lit("C")), F.struct(pair(at + 5).alias("height"), pair(at + 7).alias("width"), F.conv(byte(at + 9), 16, 10).try_cast("int").alias("components")))
    return F.when(jpeg, once(at, frame))


# The name of the segment that holds a picture's orientation, and the turns by a quarter.
EXIF_NAME = "457869660000"
QUARTER_TURNS = (5, 6, 7, 8)


def with_exif_orientation(df: DataFrame, content: Column, out: str = "orientation") -> DataFrame:
    """Adds the orientation (1 to 8) of JPEG content: the tag in the first directory of the first Exif segment, of either byte order.

    Null where there is no such segment or tag, where an offset or length leads out of
    the segment, or where the value is none of the eight.  Segments are passed over
    by their lengths, up to the first scan: 32 at first, and where these do not
    reach it, as many more as the content has room for.
    """
    c = F.col("_c")
    pair = lambda at: F.conv(F.hex(F.substring(c, at + 1, F.lit(2))), 16, 10).try_cast("int")

    def step(at: Column) -> Column:
        head = F.hex(F.substring(c, at + 1, F.lit(2)))
        exif = (head == "FFE1") & (F.hex(F.substring(c, at + 5, F.lit(6))) == EXIF_NAME)
        stop = exif | ~F.startswith(head, F.lit("FF")) | head.isin("FFDA", "FFD9") | (F.length(head) < 4)
        return F.when(stop, -at).otherwise(at + 2 + F.greatest(F.lit(2), F.coalesce(pair(at + 2), F.lit(2))))

    jpeg = F.hex(F.substring(c, 1, 2)) == "FFD8"
    made = df.withColumn("_c", content).withColumn("_at", F.when(jpeg, F.abs(walked(F.lit(2), step, 32, F.octet_length(c) / 4))))
    found = (F.hex(F.substring(c, F.col("_at") + 1, F.lit(2))) == "FFE1") & (F.hex(F.substring(c, F.col("_at") + 5, F.lit(6))) == EXIF_NAME)
    made = made.withColumn("_h", F.when(found, F.hex(F.substring(c, F.col("_at") + 11, pair(F.col("_at") + 2) - 8))))  # the directory's bytes as hexadecimal digits
    made = made.withColumn("_le", F.startswith("_h", F.lit("4949")))

    def number(at: Column, size: int) -> Column:
        raw = F.substring(F.col("_h"), at.cast("int") * 2 + 1, F.lit(2 * size))
        turned = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
        return F.when(F.length(raw) == 2 * size, F.conv(F.when(F.col("_le"), turned).otherwise(raw), 16, 10).cast("long"))

    known = (F.startswith("_h", F.lit("4949")) | F.startswith("_h", F.lit("4D4D"))) & (number(F.lit(2), 2) == 42)
    made = made.withColumn("_t", F.when(known, number(F.lit(4), 4)))
    made = made.withColumn("_t", F.when(F.col("_t") < 65536, F.col("_t"))).withColumn("_n", number(F.col("_t"), 2))
    tag = F.when(F.col("_le"), "1201").otherwise("0112")
    entry = F.filter(F.sequence(F.lit(0), F.col("_n").cast("int") - 1), lambda i: F.substring(F.col("_h"), (F.col("_t").cast("int") + 2 + i * 12) * 2 + 1, F.lit(4)) == tag)
    made = made.withColumn("_e", F.when(F.col("_n") > 0, F.get(entry, F.lit(0)))).withColumn("_v", number(F.col("_t") + 2 + F.col("_e") * 12 + 8, 2))
    return made.withColumn(out, F.when(F.col("_v").between(1, 8), F.col("_v").cast("int"))).drop("_c", "_at", "_h", "_le", "_t", "_n", "_e", "_v")


def displayed_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height as shown: exchanged where the orientation is a quarter turn; unknown ones turn nothing."""
    turned = F.coalesce(orientation.isin(*QUARTER_TURNS), F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def bounded_size(width: Column, height: Column, longest: Column | int, enlarge: bool = False) -> tuple[Column, Column]:
    """Width and height with a long side of at most (``enlarge``: exactly) ``longest``, the aspect kept to a pixel."""
    bound = longest if isinstance(longest, Column) else F.lit(longest)
    scale = bound / F.greatest(width, height)
    scale = scale if enlarge else F.least(F.lit(1.0), scale)
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("int")
    return side(width), side(height)


def digest(content: Column) -> Column:
    """SHA-256 in lower-case hexadecimal."""
    return F.sha2(content, 256)
