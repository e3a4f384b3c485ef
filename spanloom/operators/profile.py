"""Surface profiles: sizes, character classes, scans, normalization flags, profile comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import kernels, text, ucd

from .facts import char_ngrams


def summary(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", text.code_units(t).alias("code_units"), text.code_points(t).alias("code_points"), text.utf8_bytes(t).alias("bytes"))


def general_categories(docs: DataFrame) -> DataFrame:
    """(category, count) over all code points: characters are counted first, then named."""
    chars = docs.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return chars.groupBy(ucd.of(F.col("c"), "General_Category").alias("category")).agg(F.sum("n").alias("count"))


def char_classes(docs: DataFrame, name: str) -> DataFrame:
    """(value, count) of script or another character property over all code points."""
    chars = docs.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    value = ucd.of(F.col("c"), name) if name in ("script", "script_extensions", *ucd.CLASSES) else kernels.char_property(F.col("c"), name)
    return chars.groupBy(value.alias("value")).agg(F.sum("n").alias("count"))


def punctuation_whitespace(docs: DataFrame) -> DataFrame:
    """(punctuation, whitespace) totals by general category P* and Z*; line ends and tabs are neither."""
    named = general_categories(docs)
    total = lambda letter: F.coalesce(F.sum(F.when(F.col("category").startswith(letter), F.col("count"))), F.lit(0)).cast("long")
    return named.agg(total("P").alias("punctuation"), total("Z").alias("whitespace"))


def safety(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", text.count_class(t, text.CONTROL).alias("control_chars"), text.count_class(t, text.INVISIBLE).alias("invisible_chars"), F.lit(0).cast("long").alias("unpaired_surrogates"))


def integrity(docs: DataFrame) -> DataFrame:
    """doc_id and findings of each kind, and whether there are bidi controls."""
    t = F.col("text")
    kinds = [text.count_class(t, chars).alias(kind) for kind, chars in text.INTEGRITY_KINDS.items()]
    return docs.select("doc_id", *kinds, text.has_bidi_controls(t).alias("has_bidi_controls"))


def normalization_flags(docs: DataFrame) -> DataFrame:
    """doc_id, is_nfc, is_nfd, is_nfkc, is_nfkd."""
    return docs.select("doc_id", kernels.normal_forms(F.col("text")).alias("f")).select("doc_id", "f.*")


def compare_profiles(left: DataFrame, right: DataFrame, sizes: tuple[int, ...] = (2, 3), k: int = 50) -> DataFrame:
    """Per n: exact ratios of the character n-gram profiles (the ``k`` commonest grams of each side).

    shared / union of gram sets, and dot**2 / (norm_left * norm_right) as decimal strings.
    """
    a = char_ngrams(left, sizes, k).withColumnRenamed("count", "x")
    b = char_ngrams(right, sizes, k).withColumnRenamed("count", "y")
    both = a.join(b, ["n", "gram"], "full_outer").select("n", *[F.coalesce(c, F.lit(0)).cast("decimal(18,0)").alias(c) for c in ("x", "y")])
    return both.groupBy("n").agg(
        F.sum(((F.col("x") > 0) & (F.col("y") > 0)).cast("long")).alias("shared"),
        F.count(F.lit(1)).alias("union"),
        F.sum(F.col("x") * F.col("y")).cast("string").alias("dot"),
        F.sum(F.col("x") * F.col("x")).cast("string").alias("norm_left"),
        F.sum(F.col("y") * F.col("y")).cast("string").alias("norm_right"),
    )
