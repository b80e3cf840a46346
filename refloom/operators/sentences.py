"""Sentences of documents: split, with the citations they hold and the sentences around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = r"\[CITATION #b(\d+)\]"


def split_sentences(c: Column) -> Column:
    """sentences of a paragraph; abbreviations and initials don't end one."""
    guarded = F.regexp_replace(c, r"\b(al|e\.g|i\.e|cf|Fig|Figs|Eq|Eqs|Ref|Refs|Dr|Prof|vs|No|Vol|pp|St|[A-Z])\.(?=\s)", "$1")
    parts = F.split(guarded, r"(?<=[.!?])\s+(?=[\p{Lu}\d\[(“\"])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit(""), F.lit(".")))), lambda s: s != "")


def expand_ranges(c: Column) -> Column:
    """citations of a sentence as numbers; a range of markers gives all between."""
    spans = F.regexp_extract_all(c, F.lit(rf"{MARKER}(?:\s*[-–]\s*\[CITATION #b\d+\])?"), F.lit(0))
    ends = F.transform(spans, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"#b(\d+)"), F.lit(1)), lambda x: x.cast("int")))
    return F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(F.array_min(e), F.array_max(e)))))


def citing_sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, i, sentence, before, after, refs) for sentences with citations; context within a paragraph.

    The context is taken from the paragraph's own array, so no sentence is shuffled for it.
    """
    paragraphs = documents.select(key, F.posexplode_outer(F.split(F.col(text), r"\n\s*\n")).alias("paragraph", "p")).filter(F.col("p").isNotNull())
    s = paragraphs.select(key, "paragraph", split_sentences(F.regexp_replace("p", r"\s*\n\s*", " ")).alias("s"))
    one = s.select(key, "paragraph", "s", F.posexplode_outer("s").alias("i", "sentence")).filter(F.col("sentence").contains("[CITATION #b"))
    return one.select(key, "paragraph", "i", "sentence", F.slice("s", F.lit(1), F.col("i")).alias("before"), F.slice("s", F.col("i") + 2, F.size("s")).alias("after"), expand_ranges(F.col("sentence")).alias("refs"))


def running_index(sentences: DataFrame, key: str) -> DataFrame:
    """The place of each citing sentence in its document."""
    return sentences.withColumn("sent_index", F.row_number().over(Window.partitionBy(key).orderBy("paragraph", "i")))
