"""An index of terms on disk: trigram postings for parts of terms and edit distances, a sorted dictionary for prefixes.

Postings lie in folders by a hash of their trigram, so that a search reads the folders of its own
trigrams only; the dictionary is sorted over all its files, so that the bounds in their footers
leave a prefix one or few of them. Candidates are verified, so the rows are those of a scan.

Letters are compared in lower case. Texts below three letters, and distances that allow every
trigram to differ, are looked up in the dictionary by length.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

GRAM = 3
#: Folders of postings.
FOLDERS = 64


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class TermIndex:
    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        """(gram, term, key, folder): ``key`` is the term in lower case."""
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def dictionary(self) -> DataFrame:
        """(key, term, size)"""
        return self.spark.read.parquet(f"{self.path}/dictionary")


def build(terms: DataFrame, column: str = "term", path: str | None = None) -> TermIndex:
    """Write the index of the different terms of a column; nulls are left out."""
    spark = terms.sparkSession
    path = path or f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    rows = terms.select(F.col(column).alias("term")).where("term is not null").distinct().withColumn("key", F.lower("term"))
    rows.withColumn("size", F.length("key")).repartitionByRange("key", "term").sortWithinPartitions("key", "term").write.parquet(f"{path}/dictionary")
    grams = F.transform(F.sequence(F.lit(1), F.length("key") - GRAM + 1), lambda k: F.substring(F.col("key"), k, F.lit(GRAM)))
    found = rows.where(F.length("key") >= GRAM).select("term", "key", F.explode(F.array_distinct(grams)).alias("gram")).withColumn("folder", _folder(F.col("gram")))
    # A gram that every term has is dealt over several files.
    found.repartition("folder", F.pmod(F.xxhash64("term"), F.lit(8))).write.partitionBy("folder").parquet(f"{path}/postings")
    return TermIndex(spark, path)


def _candidates(index: TermIndex, text: str, least: int) -> DataFrame:
    """(term, key) of the terms that hold at least ``least`` of the text's trigrams, counted as often as the text has them."""
    grams = Counter(text[k : k + GRAM] for k in range(len(text) - GRAM + 1))
    wanted = index.spark.createDataFrame(sorted(grams.items()), "gram string, times int")  # as many rows as the text has letters
    folders = [r[0] for r in wanted.select(_folder(F.col("gram"))).distinct().collect()]
    met = index.postings.where(F.col("folder").isin(folders) & F.col("gram").isin(sorted(grams))).join(F.broadcast(wanted), "gram")
    return met.groupBy("term", "key").agg(F.sum("times").alias("met")).where(F.col("met") >= least).select("term", "key")


def containing(index: TermIndex, text: str) -> DataFrame:
    """(term): terms that hold the text, in any case."""
    text = text.lower()
    if len(text) < GRAM:
        rows = index.dictionary
    else:
        rows = _candidates(index, text, len(text) - GRAM + 1)
    return rows.where(F.col("key").contains(text)).select("term")


def starting(index: TermIndex, prefix: str) -> DataFrame:
    """(term): terms that begin with the prefix, in any case; a range of the dictionary."""
    return index.dictionary.where(F.col("key").startswith(prefix.lower())).select("term")


def similar(index: TermIndex, text: str, distance: int) -> DataFrame:
    """(term, distance): terms within an edit distance of the text, in lower case.

    An edit touches three trigrams of the text at most, so all others occur in the term.
    """
    text = text.lower()
    least = len(text) - GRAM + 1 - GRAM * distance
    rows = _candidates(index, text, least) if least > 0 else index.dictionary.where(F.col("size").between(len(text) - distance, len(text) + distance))
    return rows.withColumn("distance", F.levenshtein("key", F.lit(text))).where(F.col("distance") <= distance).select("term", F.col("distance").cast("long"))
