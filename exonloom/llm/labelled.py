"""A bounded, deterministic sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", where=None) -> DataFrame:
    """(doc, text, label 0 or 1): of class k the ``most[k]`` ids with the smallest hashes, with their texts.

    Labels that are null, and rows with null ids, don't count; an id with several labels has the majority's, 1 at a
    tie.  ``where`` maps the id column to a condition on ids.  The sample's ids are at most sum(most) rows,
    which is the bound that lets them be broadcast.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{label_col}`").cast("double").alias("y")).filter("doc is not null and y is not null")
    if where is not None:
        own = own.filter(where(F.col("doc")))
    own = own.groupBy("doc").agg((F.avg("y") >= 0.5).cast("int").alias("label"))
    picks = [own.filter(F.col("label") == k).orderBy(F.xxhash64("doc"), "doc").limit(most[k]) for k in (0, 1)]
    ids = picks[0].unionByName(picks[1])
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc")
