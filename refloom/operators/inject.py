"""Test cases put into real bibliographies: invented entries and wrong details, chosen by seed and key."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.operators.sampling import nested_sample, order_key


def inject_fakes(refs: DataFrame, pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N entries of the pool in each paper; ``_is_fake`` tells them.  Columns of refs: paper, i, title."""
    # Places in order of a digest, so every entry of the pool can be drawn.
    held = pool.select(F.col("title").alias("fake")).distinct()
    size = held.count()
    if not size or n <= 0:
        return refs.withColumn("_is_fake", F.lit(False))
    ranked = held.rdd.map(lambda r: r["fake"]).sortBy(lambda t: hashlib.md5(t.encode()).hexdigest()).zipWithIndex().toDF("fake string, slot bigint")
    slots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.alias("k"), F.pmod(F.xxhash64("paper", k, F.lit(seed)), F.lit(size)).alias("slot"))))
    drawn = refs.select("paper").distinct().select("paper", slots.alias("d")).select("paper", "d.k", "d.slot").join(ranked, "slot")
    fakes = drawn.select("paper", (-F.col("k")).alias("i"), F.col("fake").alias("title"), F.lit(True).alias("_is_fake"))
    return refs.select("paper", "i", "title", F.lit(False).alias("_is_fake")).unionByName(fakes)


def inject_mismatches(refs: DataFrame, per_paper: int = 2, seed: int = 42) -> DataFrame:
    """Of each paper some references with longer titles, their year moved by seven; with the original."""
    long = refs.filter((F.length("title") >= 50) & F.col("y").isNotNull())
    return nested_sample(long, ["paper"], "cited_id", per_paper, seed).select("paper", "cited_id", F.col("y").alias("original_year"), (F.col("y") + 7).alias("corrupted_year"))


def synthetic_biblio(refs: DataFrame, key: str) -> DataFrame:
    """A volume and a page from the key alone."""
    h = F.conv(F.substring(order_key(F.col(key), "biblio"), 1, 8), 16, 10).cast("bigint")
    return refs.withColumn("volume", (h % 90 + 1).cast("string")).withColumn("first_page", (h % 1500 + 1).cast("string"))


def planted_dois(real: DataFrame, doi: str) -> DataFrame:
    """(raw) identifiers made of real ones: as they are, damaged, cut off, inside a text, invented, of an archive."""
    d = F.col(doi)
    forms = F.array(F.concat(d, F.lit(".183")), F.concat(F.lit("10.99999/none."), F.substring(F.md5(d.cast("binary")), 1, 8)), F.concat(F.lit("10.48550/arxiv.2101."), F.substring(d, F.length(d) - 4, F.lit(5))), F.concat(F.lit("see "), d), d, F.substring(d, F.lit(1), F.length(d) - 1))
    return real.select(F.explode(forms).alias("raw")).distinct()


def references_of_truth(truth: DataFrame, paper: str, titles: str) -> DataFrame:
    """(paper, i, title, volume, first_page) of a list of titles for each paper."""
    rows = truth.select(paper, F.posexplode(titles).alias("i", "title")).withColumn("i", F.col("i") + 1)
    return synthetic_biblio(rows, "title").select(paper, "i", "title", "volume", "first_page")
