"""A bounded draw of labelled rows, brought to the texts instead of the texts to the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 200_000
_SPAN = 1 << 30


def _hash(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(_SPAN))


def drawn_labels(labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """(_id, _n0, _n1): how often each drawn doc_id is labelled 0 and 1; about `most` ids at most, those with the smallest hashes.

    Null ids, null labels and labels other than 0 and 1 are left out. An id is one row however often it
    is labelled, so the size is bounded whatever the table holds.
    """
    valid = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).where("_id is not null and _label in (0, 1)")
    least = min(_SPAN, int(_SPAN * most / max(1, valid.count())) + 1)
    return valid.where(_hash("_id") < least).groupBy("_id").agg(F.count(F.when(F.col("_label") == 0, 1)).alias("_n0"), F.count(F.when(F.col("_label") == 1, 1)).alias("_n1"))


def labelled_rows(docs: DataFrame, drawn: DataFrame, train: Column, id_col: str, *columns: Column) -> DataFrame:
    """_n0, _n1 and the given columns of the docs that are drawn, where train holds. The texts stay where they are: drawn has a bounded size and goes to them."""
    named = docs.where(train).select(F.col(id_col).alias("_key"), *columns)
    return named.join(F.broadcast(drawn), F.col("_key") == F.col("_id")).select("_n0", "_n1", *[c for c in named.columns if c != "_key"])
