"""Column expressions on texts, words and arrays that several native operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as it stands between words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, between: str = SPACE) -> Column:
    """The non-empty pieces between matches of ``between``; none for an empty text."""
    return F.array_remove(F.split(text, between), "")


def pairwise(array: Column, distance: int, combine) -> Column:
    """``combine(a[i], a[i + distance])`` for every i that has both."""
    length = F.greatest(F.size(array) - distance, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), length), F.slice(array, F.lit(distance + 1), length), combine)


def hash_each(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def doubled(df: DataFrame, name: str, width: int, combine) -> DataFrame:
    """Replace the array ``name`` by ``combine`` over all windows of ``width`` neighbours, by doubling.

    Each step is a projection of its own, so that an array is computed once however often the next step reads it.
    """
    done = 1
    while done < width:
        step = min(done, width - done)
        df = df.withColumn(name, pairwise(F.col(name), step, combine))
        done += step
    return df
