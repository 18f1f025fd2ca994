"""Text functions: pattern escapes, literal normalisation, dotted paths, quoted lists."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ESCAPE = "#"


def like_escaped(text: str) -> str:
    """User text as a LIKE pattern that matches only itself, with ``#`` as the escape."""
    return "".join(ESCAPE + c if c in "%_#" else c for c in text)


def matches(column: Column | str, text: str, prefix: bool = False) -> Column:
    """Whether a column contains the text, or begins with it, whatever the case."""
    column = F.col(column) if isinstance(column, str) else column
    pattern = ("" if prefix else "%") + like_escaped(text.lower()) + "%"
    return F.like(F.lower(column), F.lit(pattern), F.lit(ESCAPE))


@F.pandas_udf(StringType())
def _nfd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")


def normalized_literal(column: Column | str) -> Column:
    """Tabs as spaces, canonical decomposition, and each run of white space, ``|`` or non-ASCII characters as one space."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(_nfd(F.translate(column, "\t", " ")), r"[\s|\x{80}-\x{10FFFF}]+", " ")


def path_ids(path: Column | str) -> Column:
    """Ids of a dotted path, root first."""
    return F.transform(F.split(path, r"\."), lambda x: x.cast("long"))


def last_ancestors(path: Column | str, level: int) -> Column:
    """The last ``level`` ids of a space-separated root path before the node itself, root first (0: all)."""
    ids = F.transform(F.split(path, " "), lambda x: x.cast("long"))
    above = F.slice(ids, 1, F.size(ids) - 1)
    return above if not level else F.slice(above, F.greatest(F.size(above) - level + 1, F.lit(1)), level)


def quoted(column: Column) -> Column:
    """A part of a composed label, in quotes if it holds a comma or a space."""
    return F.when(F.regexp_like(column, F.lit("[, ]")), F.concat(F.lit("'"), column, F.lit("'"))).otherwise(column)


def split_terms(text: str) -> list[str]:
    """Terms of a ``;`` list; a backslash takes the next character as it is."""
    terms, current, k = [], "", 0
    while k < len(text):
        if text[k] == "\\" and k + 1 < len(text):
            k += 1
            current += text[k]
        elif text[k] == ";":
            terms.append(current)
            current = ""
        else:
            current += text[k]
        k += 1
    return [t for t in (*terms, current) if t]


def joined(values: Column, separator: str = ";") -> Column:
    """String aggregate of the distinct values, in order."""
    return F.array_join(F.array_sort(F.collect_set(values)), separator)
