"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, shipped

#: Words of a text, as a Java and RE2 regular expression.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch at most: texts are long, and a worker holds a batch or two at once.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame, *own: F.Column) -> DataFrame:
    """The rows as one struct column ``row`` beside columns computed from it, so that no name clashes with the operator's."""
    whole = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns))
    return docs.select(whole.alias("row"), *own)


def unpacked(docs: DataFrame, replaced: tuple[str, ...] = ()) -> list[F.Column]:
    """The columns of ``row`` by the names of ``docs``, but for those that the operator's own columns replace."""
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in replaced]


__all__ = ["WORD", "n_words", "packed", "saved", "shipped", "table", "unpacked"]
