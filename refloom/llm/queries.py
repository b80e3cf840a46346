"""Queries of the training-data operators, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.keys import journal_key
from refloom.llm import canonical_list, entities, leakage, lookalike, names, packing, quality, scans
from refloom.operators.packed import explode_packed
from refloom.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query()
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and arXiv records whose titles read the same although they are not the same characters."""
    entries = read(spark, sf, "cited_sent").select("cited_id", "title").filter(F.col("title").isNotNull())
    records = read(spark, sf, "arxiv").select("arxiv_id", "title_norm").filter(F.col("title_norm").isNotNull()).distinct()
    plain = F.trim(F.regexp_replace(F.lower("title"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return lookalike.reads_like(entries, records, "title", "title_norm").filter(plain != F.col("title_norm")).select("cited_id", "arxiv_id").distinct()


@query()
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents the larger part of which is no prose."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return quality.with_quality(docs, "text").filter(~F.col("quality.is_prose")).select("doc_id").distinct()


@query()
def p9_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of every document."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return quality.with_quality(docs, "text").select("doc_id", "quality.*").distinct()


@query()
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose journal is typed freely, with the identity of the journal meant or 'unmatched'."""
    alias, acronym, journal = (read(spark, sf, t) for t in ("alias", "acronym", "journal"))
    rows = read(spark, sf, "cited_sent").select("cited_id", "journal").filter(F.length(F.trim("journal")) > 0).withColumn("key", journal_key(F.col("journal")))
    rows = rows.join(alias.select(F.col("name_norm").alias("key")), "key", "left_anti").select("cited_id", "journal")
    names = canonical_list.resolve(rows, "journal", alias, acronym, journal).withColumnRenamed("value", "journal")
    return rows.join(names, "journal").select("cited_id", "identity").distinct()


@query()
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the evaluation items of which they hold a passage."""
    return leakage.find_leaks(read(spark, sf, "documents"), read(spark, sf, "heldout"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id").distinct()


def _spellings(spark: SparkSession, sf: str) -> DataFrame:
    """The single names in cited_sent.authors and the first authors of biblio, each once."""
    packed = read(spark, sf, "cited_sent").select("authors").distinct()
    single = explode_packed(packed, "authors", "name").select("name")
    return single.unionByName(read(spark, sf, "biblio").select(F.col("author1").alias("name"))).distinct()


@query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every two spellings of the same person or organisation."""
    return names.pairs(names.link_names(_spellings(spark, sf), "name"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    entries = read(spark, sf, "cited_sent").select("cited_id", "title", "year", "volume", "pages")
    works = read(spark, sf, "oa").select("oa_id", "title_norm", "year", "volume", "first_page")
    return entities.match(entries, works, ("cited_id", "title", "year", "volume", "pages"), ("oa_id", "title_norm", "year", "volume", "first_page"))


@query()
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and the works of oa that they refer to."""
    return _matches(spark, sf).select("cited_id", "oa_id").distinct()


@query()
def p1_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the posterior of each match."""
    return _matches(spark, sf).select("cited_id", "oa_id", F.round("confidence", 6).alias("confidence"))


def _repaired(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["title", "authors", "journal", "volume", "pages", "year", "publisher"]
    return scans.repair(read(spark, sf, "cited_sent"), "cited_id", "citation", fields, "journal")


@query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of flaws that a page and its scanner left in each entry."""
    return scans.flaws(_repaired(spark, sf), "cited_id")


@query()
def p5_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry as one continuous readable text."""
    return _repaired(spark, sf).select("cited_id", "text").distinct()


@query()
def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document, or of its pieces, for each capacity."""
    docs = packing.with_tokens(read(spark, sf, "documents").select("doc_id", "text"), "text")
    packed = packing.pack(docs.select(F.col("doc_id").alias("id"), "tokens"), read(spark, sf, "pack_size"))
    return packed.withColumnRenamed("id", "doc_id")
