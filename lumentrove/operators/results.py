"""What a session may export, by the run that it completed last.

The reference describes this in prose only; this follows the prose and claims no
parity beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import carried

# The algorithms by documented capability.
IMAGE_EXPORT = ("planar", "rectangle", "brush", "virtual-camera")
POINT_EXPORT = ("planar", "virtual-camera")
TILT = ("virtual-camera",)
# What ends a result, besides the next completed run.
ENDS = ("reset", "clear", "image-replaced")


def eligibility(events: DataFrame, keys: list[str], order: list[Column], kind: Column, algorithm: Column) -> DataFrame:
    """Adds ``result_algorithm``, ``image_export``, ``point_export`` and ``tilt`` as of each event.

    A session's result is that of its last ``completed`` event, until one of ``ENDS``.  All
    other events, the choice of an algorithm for the next run among them, change
    nothing.  Without a result, or for an algorithm that is null or unknown, nothing
    may be exported.  An event counts for itself; events at the same place of the order have no defined order.
    """
    bound = F.when(kind == "completed", F.struct(algorithm.alias("name"))).when(kind.isin(*ENDS), F.struct(F.lit(None).cast("string").alias("name")))
    out = carried(events, keys, order, bound, "_result").withColumn("result_algorithm", F.col("_result.name"))
    name = F.col("result_algorithm")
    may = lambda names: F.coalesce(name.isin(*names), F.lit(False))
    return out.select(*events.columns, "result_algorithm", may(IMAGE_EXPORT).alias("image_export"), may(POINT_EXPORT).alias("point_export"), may(TILT).alias("tilt"))
