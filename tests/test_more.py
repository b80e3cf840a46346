import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.functions import rules, similarity, text
from refloom.operators import inject, match, rates, sampling, stats, vector
from refloom.sources import tei
from refloom.streaming.ingest import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_titles_and_identifiers(spark):
    assert one(spark, "ATLAS Collaboration: Tides of ice", text.without_leading_author) == "Tides of ice"
    assert one(spark, "Doe, J. et al. Tides of ice", text.without_leading_author) == "Tides of ice"
    got = one(spark, "Doe, J. et al. Beta ﬁelds of dyelabeled ice", text.title_repair_variants)
    assert "Beta fields of dyelabeled ice" in got and "Beta fields of dye labeled ice" in got and len(set(got)) == len(got)
    assert one(spark, "low- rank: ice beds", text.retry_variants) == ["low- rank: ice beds", "lowrank: ice beds", "low rank: ice beds", "low  rank: ice beds"] or one(spark, "low- rank: ice beds", text.retry_variants)[1] == "lowrank: ice beds"
    assert one(spark, "A first half of a title – one. And a second half of it", text.search_variants)[1:] == ["A first half of a title - one", "And a second half of it"]
    for raw, want in {"10.1000/ab{c}": "10.1000/abc", "https://doi.org/10.1000/x,5": "10.1000/x", "10.1000/x.mr12": "10.1000/x", "10.1000/abc10.1000/abc": "10.1000/abc", "none": None}.items():
        assert one(spark, raw, text.cleaned_doi)["doi"] == want, raw
    assert one(spark, "10.48550/arXiv.1", text.cleaned_doi)["datacite"] and one(spark, None, text.cleaned_doi)["doi"] is None
    assert one(spark, "2019", lambda c: text.year_or_raw(c, F.lit("x 1985"), 2026)) == 2019 and one(spark, "20x", lambda c: text.year_or_raw(c, F.lit("x 1985"), 2026)) == 1985
    assert one(spark, "\\\\\"{o} \\\\emph{ice}".replace("\\\\", "\\"), text.without_latex) == "o ice"


def test_free_text(spark):
    p = one(spark, 'Doe, A. "On the tides of ice," J. Ice 3 (2019) 4-9. doi:10.1000/x', text.parsed_citation)
    assert (p["title"], p["year"], p["doi"], p["pages"]) == ("On the tides of ice", 2019, "10.1000/x", "4-9")
    assert one(spark, "Doe, A. and Roe, B. (2019). On the slow tides of polar ice. J. Ice, 3.", text.parsed_citation)["title"] == "On the slow tides of polar ice"
    assert one(spark, "[1] Doe, A. On ice beds, 2019. CrossRef\n[2] Roe, B. On tides of\n ice, 2020.", text.citation_blocks) == ["Doe, A. On ice beds, 2019.", "Roe, B. On tides of ice, 2020."]
    assert one(spark, "Doe, A. On ice beds, 2019.\n\nRoe, B. On tides\nof ice, 2020.", text.citation_blocks) == ["Doe, A. On ice beds, 2019.", "Roe, B. On tides of ice, 2020."]
    assert one(spark, "Text.\nReferences\n[1] Doe, A. evi-\ndence\n17\n[2] Roe", text.reference_section) == "[1] Doe, A. evidence\n\n[2] Roe"
    assert one(spark, "abcdefghij", text.reference_section) == "hij"
    assert one(spark, "x1 %% On the tides of ice, q# a b", text.readable_fragment) == "On the tides of ice"
    assert one(spark, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b c d", text.garbled_share) == 0.25
    assert [one(spark, v, text.similarity_band, "double") for v in (0.95, 0.8, 0.1, None)] == ["green", "yellow", "red", None]
    assert one(spark, "", text.shortened) is None and one(spark, "abc", lambda c: text.shortened(c, 2)) == "ab"
    assert one(spark, "Smith, J.; Doe, A.", text.author_list) == ["Smith, J.", "Doe, A."]
    assert one(spark, "On the tides of ice", text.looks_like_title) and not one(spark, "Ice 2019;3 of tides", text.looks_like_title)
    full = one(spark, "x", lambda c: text.formatted(F.lit("ieee"), authors=F.lit("A. Doe"), title=F.lit("On ice"), journal=F.lit("J. Ice"), year=F.lit("2019"), volume=F.lit("3"), pages=F.lit(None).cast("string")))
    assert full == 'A. Doe, "On ice," J. Ice, vol. 3, 2019.'
    df = spark.createDataFrame([("j ice", "journal ice", True), ("jnl ice", "journal ice", True), ("ice j", "journal ice", False), ("j ice x", "journal ice", False)], "a string, b string, w boolean")
    assert all(r["g"] == r["w"] for r in df.select(text.abbreviates(F.col("a"), F.col("b")).alias("g"), "w").collect())


def test_small_rules(spark):
    assert one(spark, "cs.CL", rules.field_of) == "cs" and one(spark, "hep-th", rules.field_of) == "hep" and one(spark, "nlin.CD", rules.field_of) == "physics-other"
    assert one(spark, "A patent, US 1,234,567", lambda c: rules.composition(c, F.lit("t"), F.lit(None).cast("string"))) == "patent"
    assert one(spark, 0, lambda c: stats.rule_of_three(c, F.lit(60)), "int") == 5.0 and one(spark, 1, lambda c: stats.rule_of_three(c, F.lit(60)), "int") is None
    df = spark.createDataFrame([("Jour. Ice", "Journal of Ice", True), ("Journal of Tides A", "Journal of Tides B", False), ("", "x", True), ("Ice", "Tides", False)], "a string, b string, w boolean")
    assert [r["g"] for r in df.select(match.same_journal(F.col("a"), F.col("b")).alias("g")).collect()] == [True, False, True, False]


def test_authority_and_output(spark, tmp_path):
    src = spark.createDataFrame([("1", "Journal of Ice", None, ["Ice J"], ["J Ice"]), ("2", "Tides", None, None, None)], "identity string, display_name string, abbreviated string, synonyms array<string>, alt array<string>")
    rec = src.select("identity", "display_name", "synonyms", F.transform("alt", lambda x: F.struct(x.alias("name"))).alias("synonyms_detail"))
    alias, acronym = tei.journal_authority(tei.authority_from_records(rec))
    assert {tuple(r) for r in alias.select("name_norm", "identity").collect()} == {("journal of ice", "1"), ("ice j", "1"), ("j ice", "1"), ("tides", "2")}
    assert {tuple(r) for r in acronym.collect()} == {("ji", "1")}
    df = spark.createDataFrame([(1, "2001"), (2, "2002")], "id int, month string")
    for _ in range(2):
        tei.write_by_month(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    tei.write_tsv(df, str(tmp_path / "t"), ["id"])
    assert tei.read_csv(spark, str(tmp_path / "t"), "id int, month string", sep="\t").count() == 2
    assert [r["line"] for r in tei.report(df, ["id", "month"], 4).orderBy("line").collect()] == ["1    2001", "2    2002"]


def test_reference_sources(spark):
    works = spark.createDataFrame([(1, json.dumps({"reference": [{"DOI": "10.1/A", "article-title": "On ice", "year": "2019b", "first-page": "7-9", "author": "Doe, A."}, {"unstructured": "see doi:10.1234/B."}]}))], "id int, j string")
    works = works.select("id", F.from_json("j", tei.CROSSREF_LIST).alias("r")).select("id", "r.reference")
    a, b = tei.crossref_references(works, "id").orderBy("i").collect()
    assert (a["doi"], a["title"], a["year"], a["first_page"], a["author"], b["doi"]) == ("10.1/a", "On ice", 2019, "7", "Doe", "10.1234/b")
    xml = "<article><ref-list><ref><element-citation><article-title>On ice</article-title><source>J Ice</source><year>2019</year><fpage>7</fpage><name><surname>Doe</surname></name><pub-id pub-id-type='doi'>10.1/A</pub-id></element-citation></ref></ref-list></article>"
    (r,) = tei.jats_references(spark.createDataFrame([(1, xml), (2, "<x"), (3, None)], "id int, x string"), "id", "x").collect()
    assert (r["title"], r["year"], r["first_author"], r["doi"]) == ("On ice", 2019, "Doe", "10.1/a")
    refs = spark.createDataFrame([(1, "Journal of Ice 12", None), (2, "On the slow tides. Journal of Ice", None), (3, "On tides", "Tides"), (4, "Tides", "Tides"), (5, None, None)], "id int, title string, journal string")
    got = {x["id"]: (x["title"], x["journal"]) for x in tei.demoted_titles(refs, spark.createDataFrame([("journal of ice",)], "name string")).collect()}
    assert got == {1: (None, "Journal of Ice 12"), 2: ("On the slow tides", "Journal of Ice"), 3: ("On tides", "Tides"), 4: (None, "Tides"), 5: (None, None)}
    page = "Doe, A. On the evi-\n   dence of ice, 2019.\nRoe, B. On tides\n   of ice."
    assert [x["reference"] for x in tei.segmented(spark.createDataFrame([(1, page), (2, None)], "id int, t string"), "id", "t").orderBy("i").collect()] == ["Doe, A. On the evidence of ice, 2019.", "Roe, B. On tides of ice."]
    s = spark.createDataFrame([(d, i == 0) for d in (1, 2) for i in range(10)] + [(3, True)], "id int, citing boolean")
    h = spark.createDataFrame([(1, "T", ["A"]), (2, None, ["A"]), (3, "T", ["A"])], "id int, title string, authors array<string>")
    assert [x["id"] for x in tei.publishable(s, h, "id").collect()] == [1]


def test_samples_and_files(spark):
    df = spark.createDataFrame([("a", "2001", 1), ("b", "2001", 2), ("b", "2002", 3)], "f string, m string, v int")
    assert {r["v"] for r in sampling.first_file_owns(df, "f", "m").collect()} == {1, 3}
    s = spark.range(300)
    small, large = ([r["id"] for r in sampling.seeded_take(s, "id", k).collect()] for k in (5, 40))
    assert large[:5] == small
    pool = spark.createDataFrame([(f"f{i}",) for i in range(40)], "title string")
    refs = spark.createDataFrame([(f"p{i}", 0, "t") for i in range(200)], "paper string, i int, title string")
    got = inject.inject_fakes(refs, pool, 3).filter("_is_fake")
    assert got.count() == 600 and got.select("title").distinct().count() == 40


def test_cells_recall(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 16))
    v = (centre[rng.integers(0, 20, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(1500)] + [(9999, None)], "id int, v array<float>")
    q = df.filter("id % 50 = 0")
    c = vector.fit_cells(df, "id", "v", 24)
    exact = {(r["query"], r["id"]) for r in vector.nearest(q, df, "id", "v", k=10).collect()}
    found = {(r["query"], r["id"]) for r in vector.nearest_in_cells(q, df, "id", "v", c, k=10, probes=8).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(exact) == 300


def test_year_required(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 2000), (2, [1.0, 0.1], None), (3, [1.0, 0.2], 2001), (4, [1.0, 0.3], 2009)], "id int, v array<double>, y int")
    ids = lambda **k: [r["id"] for r in vector.nearest(df.filter("id = 1"), df, "id", "v", year="y", **k).orderBy("rank").collect()]
    assert ids() == [2, 3] and ids(year_required=True) == [3]


def test_a_key_delivered_again_stands_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "id int, month string, t int, v string"
    for batch in ([(1, "2001", 1, "a"), (2, "2001", 1, "b")], [(1, "2002", 2, "c"), (2, "2001", 0, "old")], [(3, "2001", 1, "d")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, schema, out, ck, "id", "t")
    assert {(r["id"], r["month"], r["v"]) for r in spark.read.schema(schema).parquet(out).collect()} == {(1, "2002", "c"), (2, "2001", "b"), (3, "2001", "d")}


def test_excess_forms(spark):
    s = spark.createDataFrame([(2000.0 + i, 0.05 + 0.4 * float(np.exp(-0.3 * i)) + (0.02 if i >= 15 else 0.0), 100) for i in range(20)], "x double, y double, w int")
    r = stats.excess_forms(s, "x", "y", "w", 2015.0).first()
    assert r["rate"] == 0.3 and abs(r["over_exp"] - 0.02) < 1e-4 and r["over_flat"] < 0 and r["verdict"] == "sign flips"


def test_prefixes_of_any_length(spark):
    values = spark.createDataFrame([("a" * n,) for n in range(10, 900)], "v string")
    index = spark.createDataFrame([("a" * 850 + "b",)], "d string")
    assert match.prefix_exists(values, "v", index, "d").count() == 850 - 14 + 1


def test_similarities(spark):
    assert spark.createDataFrame([("abc", None)], "a string, b string").select(similarity.sequence_ratio("a", "b")).first()[0] is None
    assert rates.months(spark.createDataFrame([("0111", "0202")], "a string, b string"), "a", "b").count() == 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_fuzzy_rescue_resolves_references_once(spark, monkeypatch):
    from refloom import session
    from refloom.plans import facts, studies

    calls, resolved = [], facts.resolved
    monkeypatch.setattr(session, "_MADE", {})
    monkeypatch.setattr(facts, "resolved", lambda *a: calls.append(a) or resolved(*a))
    rows = studies.fuzzy_rescue_by_year(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and all(r["fuzzy_failed"] <= r["exact_failed"] for r in rows) and rows
