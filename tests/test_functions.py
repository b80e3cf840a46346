from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refloom.functions import keys, rules, similarity, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_keys(spark):
    assert one(spark, "The Naïve & Sons: Review", keys.journal_key) == "naïve and sons review"
    assert one(spark, "Café  Économies—II", keys.ascii_key) == "cafe economies ii"
    assert one(spark, "Café", keys.arxiv_key) == "caf"
    assert one(spark, "https://doi.org/10.1000/AbC).", keys.doi_key) == "10.1000/abc"
    assert [one(spark, v, keys.page_key) for v in ("e0012", "000", "12", "E7")] == ["12", "0", "12", "7"]
    assert one(spark, "36(1)", keys.volume_key) == "36"
    assert one(spark, "van der Smith, Ann", keys.surname) == "smith"
    assert one(spark, "Journal of the Physics of Ice", keys.acronym) == "jpi"
    assert one(spark, "On the low- rank ice", keys.content_tokens) == ["lowrank", "ice"]
    assert one(spark, "ab", keys.trigrams) == [] and one(spark, "abcd", keys.trigrams) == ["abc", "bcd"]
    for f in (keys.journal_key, keys.ascii_key, keys.doi_key, keys.page_key, keys.volume_key, keys.surname):
        assert one(spark, None, f) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_keys_are_idempotent(spark, values):
    df = spark.createDataFrame([(v.replace("\x00", ""),) for v in values], "x string")
    for f in (keys.ascii_key, keys.arxiv_key):
        k = df.select(f(F.col("x")).alias("a")).select("a", f(F.col("a")).alias("b"))
        assert k.filter("a <> b").count() == 0


def test_golden_keys(spark):
    import unicodedata

    import pandas as pd

    # The ASCII key is what is left of the decomposed text when everything else is deleted.
    for t in ("Smørrebrød ế Ąžuolas İstanbul", "Ｆｕｌｌ ﬁelds Ⅻ²", "Poincaré λ-type", "各国 ice"):
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        if "Ⅻ" not in t:
            assert one(spark, t, keys.ascii_key) == " ".join("".join(c if c.isalnum() else " " for c in plain).split()), t
    got = keys.title_key(pd.Series(["A &amp;amp; <b>B</b>: Straße_Ⅳ é", "各国の Жук", None])).tolist()
    assert got[:2] == ["a b strasse iv e", "各国の жук"] and got[2] is None


def test_text(spark):
    assert one(spark, "Smith (2019), repr. 2021", text.year_in) == 2019
    assert one(spark, "see doi:10.1234/ab.c), p. 3", text.doi_in) == "10.1234/ab.c"
    assert one(spark, "arXiv: 1706.03762v5", text.arxiv_doi) == "10.48550/arxiv.1706.03762"
    assert one(spark, "hep-th/9901001", text.arxiv_doi) == "10.48550/arxiv.hep-th/9901001"
    assert one(spark, "PMID: 1234567", text.pmid) == "1234567"
    assert one(spark, "bioRxiv 2020.01.02.123456", text.preprint_doi) == "10.1101/2020.01.02.123456"
    assert one(spark, "10.1000/x.accessed may", text.doi_variants) == ["10.1000/x.accessed may", "10.1000/x"]
    assert one(spark, "ﬁeld 12±19", text.repaired_ligatures) == "field 12-19"
    assert one(spark, "CafÃ©", text.repaired_mojibake) == "Café" and one(spark, "Café", text.repaired_mojibake) == "Café"
    assert one(spark, "Beta decay", text.greek_symbols) == "β decay"
    assert one(spark, "see https://a.b/c).", text.url_in) == "https://a.b/c"
    assert one(spark, "pp. 12-19", text.pages_in) == "12-19"
    assert "dye labeled probes" in one(spark, "dyelabeled probes", text.demerged)
    assert one(spark, "a title [CITATION #b3] of (Smith, 2019) it.", text.without_citations) == "a title of it."
    assert one(spark, "plain", text.arxiv_doi) is None and one(spark, None, text.year_in) is None


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["a"], "smith", "smyth")], "a array<string>, b array<string>, s string, t string")
    r = df.select(similarity.containment(F.col("a"), F.col("b")).alias("c"), similarity.jaccard(F.col("a"), F.col("b")).alias("j"), similarity.surnames_match(F.col("s"), F.col("t")).alias("m"), similarity.sequence_ratio("s", "t").alias("q")).first()
    assert (round(r["c"], 4), r["j"], r["m"], round(r["q"], 2)) == (0.6667, 0.5, True, 0.8)


def test_rules(spark):
    rows = [
        ("Ann Lee. Ice manual, https://x.y accessed 2020", None, "Ice manual", None, None, "url", "non_article"),
        ("PhD thesis, Ostmark, a long enough text to be no debris at all, 2019", None, "On tides", "J", None, "thesis", "non_article"),
        ("A. Lee, Layered ice sheets under constant load, J. Ice 3 (2019) 4-9", None, "Layered ice sheets under constant load", "J. Ice", "3", None, "fab_candidate"),
        ("short", None, None, None, None, "debris", "no_title"),
        (None, "10.1/x", "One two", None, None, None, "short_title"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "raw string, doi string, title string, journal string, volume string")
    c = F.col
    got = df.select(rules.nonacademic_rule(c("raw"), c("doi"), c("title"), c("journal"), c("volume")).alias("a"), rules.not_found_reason(c("raw"), c("title"), c("doi")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [r[5:] for r in rows]
    t = spark.createDataFrame([("layered ice sheets growth", "moth migration in towns"), ("layered ice sheets growth", "layered ice sheets"), (None, None)], "a string, b string")
    assert [r[0] for r in t.select(rules.title_hijack(c("a"), c("b"))).collect()] == [True, False, False]
