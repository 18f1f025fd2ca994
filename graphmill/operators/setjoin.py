"""Set queries over triples: selections with wildcards, and joins of two properties.

Sets of node numbers are kept as bitmaps: one binary per (key, bucket of 32768 numbers),
so that unions and intersections are aggregates over small binaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(edges: DataFrame) -> DataFrame:
    """(num, rid, rtid): nodes of the edges with a number of their own, dense and in the order of type and id.

    Numbers come from two-level counts: rows per range of ids first, then the place within.
    """
    from pyspark.sql import Window

    ends = edges.select(F.col("rid1").alias("rid"), F.col("rtid1").alias("rtid")).union(edges.select("rid2", "rtid2")).distinct()
    ends = ends.withColumn("part", F.floor(F.col("rid") / 65536))
    before = Window.orderBy("rtid", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.groupBy("rtid", "part").count().select("rtid", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("rtid", "part").orderBy("rid"))
    return ends.withColumn("rn", within).join(starts, ["rtid", "part"]).select((F.col("start") + F.col("rn")).alias("num"), "rid", "rtid")


def bitmap_index(edges: DataFrame, numbers: DataFrame, by: tuple[str, ...], of: str) -> DataFrame:
    """(key columns, bucket, bits): which nodes stand at the end ``of`` (subject or object) for each key."""
    end = {"subject": "1", "object": "2"}[of]
    num = numbers.select("num", F.col("rid").alias(f"rid{end}"), F.col("rtid").alias(f"rtid{end}"))
    placed = edges.join(num, [f"rid{end}", f"rtid{end}"])
    return placed.groupBy(*by, F.expr("bitmap_bucket_number(num)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(num))").alias("bits"))


def members(bitmaps: DataFrame, numbers: DataFrame) -> DataFrame:
    """(rid, rtid) of the set bits of (bucket, bits)."""
    at = F.explode(F.sequence(F.lit(0), F.lit(32767)))
    byte = F.conv(F.hex(F.expr("substring(bits, k div 8 + 1, 1)")), 16, 10).cast("int")
    bits = bitmaps.select("bucket", "bits", at.alias("k")).where(F.expr("k div 8 < length(bits)"))
    found = bits.where(byte.bitwiseAND(F.expr("shiftleft(1, k % 8)")) > 0)
    num = found.select(((F.col("bucket") - 1) * 32768 + F.col("k") + 1).alias("num"))
    return num.join(numbers, "num").select("rid", "rtid")


def _wanted(edges: DataFrame, **values: int | None) -> DataFrame:
    for column, value in values.items():
        if value is not None and value > 0:
            edges = edges.where(F.col(column) == value)
    return edges


def select_objects(edges: DataFrame, pid: int | None = None, subject: tuple[int, int] | None = None) -> DataFrame:
    """Distinct objects (rid, rtid) for a property and a subject; None means any."""
    rid, rtid = subject or (None, None)
    return _wanted(edges, pid=pid, rid1=rid, rtid1=rtid).select(F.col("rid2").alias("rid"), F.col("rtid2").alias("rtid")).distinct()


def select_subjects(edges: DataFrame, pid: int | None = None, object_: tuple[int, int] | None = None) -> DataFrame:
    """Distinct subjects for a property and an object."""
    rid, rtid = object_ or (None, None)
    return _wanted(edges, pid=pid, rid2=rid, rtid2=rtid).select(F.col("rid1").alias("rid"), F.col("rtid1").alias("rtid")).distinct()


def select_properties(edges: DataFrame, subject: tuple[int, int] | None = None, object_: tuple[int, int] | None = None) -> DataFrame:
    """Distinct properties (pid) between a subject and an object."""
    (r1, t1), (r2, t2) = subject or (None, None), object_ or (None, None)
    return _wanted(edges, rid1=r1, rtid1=t1, rid2=r2, rtid2=t2).select("pid").distinct()


def property_join(edges: DataFrame, pid1: int, pid2: int, kind: str) -> DataFrame:
    """Nodes (rid, rtid) at an end of one property and at an end of the other: ``ss``, ``so`` or ``oo``. An empty side gives an empty set."""
    if kind not in ("ss", "so", "oo"):
        raise ValueError(f"unknown join {kind!r}")
    side = {"s": select_subjects, "o": select_objects}
    left, right = side[kind[0]](edges, pid1), side[kind[1]](edges, pid2)
    return left.join(right, ["rid", "rtid"], "left_semi")


def union_of(bits: Column) -> Column:
    return F.bitmap_or_agg(bits)


def common_of(bits: Column) -> Column:
    return F.bitmap_and_agg(bits)
