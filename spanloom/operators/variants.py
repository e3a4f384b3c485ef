"""Variant indexes: the written forms behind each canonical key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import case_fold, word_counts


def variant_index(docs: DataFrame, keep: str = "word-like", forms_per_key: int = 5, key=case_fold) -> DataFrame:
    """(key, total, forms, top_forms): counts per canonical key; ``top_forms`` lists the commonest forms.

    Forms are counted first, then gathered by key, so a key gathers at most its distinct forms.
    """
    forms = word_counts(docs, keep=keep).withColumnsRenamed({"raw": "form", "count": "n"}).withColumn("key", key(F.col("form")))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "form")))
    grouped = forms.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("forms"), ranked.alias("r"))
    shown = F.transform(F.slice("r", 1, forms_per_key), lambda x: F.concat(x["form"], F.lit(":"), (-x["order"]).cast("string")))
    return grouped.select("key", "total", "forms", F.array_join(shown, " ").alias("top_forms"))
