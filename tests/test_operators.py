import datetime
import json
import random

import numpy as np
from pyspark.sql import functions as F

from refloom.functions.keys import content_tokens, trigrams
from refloom.functions.similarity import containment, good, jaccard
from refloom.operators import inject, match, rates, sampling, sentences, stats, vector
from refloom.sources import tei
from refloom.streaming.ingest import ingest


def test_cascade_prefers_the_first_phase(spark):
    a = spark.createDataFrame([(1, "x")], "cited_id int, matched string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "cited_id int, matched string")
    assert {tuple(r) for r in match.cascade(None, [("a", a), ("b", b)]).collect()} == {(1, "a", "x"), (2, "b", "z")}


def test_federate_keeps_sources(spark):
    l = spark.createDataFrame([("d1", 2000, None), ("d2", None, "v")], "doi string, year int, venue string")
    r = spark.createDataFrame([("d1", 2001, "w"), ("d3", 1999, None)], "doi string, year int, venue string")
    got = {x["doi"]: x for x in match.federate(l, r, "doi", ["year", "venue"]).collect()}
    assert got["d1"]["year"] == 2000 and got["d1"]["sources"] == {"year": "left", "venue": "right"}
    assert got["d3"]["in_left"] is False and got["d3"]["year"] == 1999


def test_samples_nest(spark):
    df = spark.range(500).withColumn("g", (F.col("id") % 3).cast("string"))
    small, large = ({r["id"] for r in sampling.nested_sample(df, ["g"], "id", k).collect()} for k in (4, 20))
    assert small < large and len(small) == 12 and len(large) == 60
    assert len(sampling.quota_sample(df, "g", "id", {"0": 2, "1": 5}).collect()) == 7


def test_bootstrap_holds_the_rate(spark):
    p = spark.range(400).select(F.concat(F.lit("p"), "id").alias("paper"), F.lit("g").alias("g"), (F.col("id") % 4 == 0).cast("int").alias("bad"), F.lit(1).alias("total"))
    r = stats.cluster_bootstrap(p, "paper", "bad", "total", ["g"]).first()
    assert r["low"] < 0.25 < r["high"] and abs(r["se"] - (0.25 * 0.75 / 400) ** 0.5) < 0.006


def test_excess_of_a_straight_line_is_zero(spark):
    s = spark.createDataFrame([(2010.0 + i, 0.1 + 0.01 * i, 100) for i in range(14)], "x double, y double, w int")
    r = stats.excess(s, "x", "y", "w", 2020.0).first()
    assert abs(r["over_linear"]) < 1e-6 and r["over_flat"] > 0.05


def test_power(spark):
    r = spark.range(1).select(stats.power(F.lit(2.8), F.lit(1.0)).alias("p"), stats.normal_cdf(F.lit(0.0)).alias("h")).first()
    assert abs(r["p"] - 0.80) < 0.01 and abs(r["h"] - 0.5) < 1e-6


def test_nearest_agrees_with_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], 2000 + i % 7) for i in range(60)], "id int, v array<float>, y int")
    got = {(r["query"], r["rank"]): r["id"] for r in vector.nearest(df.filter("id < 5"), df, "id", "v", year="y", k=3).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(5):
        order = [j for j in np.argsort(-(n @ n[q])) if j != q and abs(j % 7 - q % 7) <= 2 and n[j] @ n[q] >= 0][:3]
        assert [got.get((q, k + 1)) for k in range(len(order))] == order


def test_sentences(spark):
    text = "Ice melts, cf. Fig. 2 of J. Doe. We saw it [CITATION #b2]–[CITATION #b4]. It ended.\n\nNo marks here."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    r = sentences.citing_sentences(df, "doc_id", "text").collect()
    assert len(r) == 1 and r[0]["refs"] == [2, 3, 4] and len(r[0]["before"]) == 1 and r[0]["after"] == ["It ended."]


def test_injection(spark):
    refs = spark.createDataFrame([("a", 0, "t"), ("b", 0, "u")], "paper string, i int, title string")
    pool = spark.createDataFrame([("f1",), ("f2",)], "title string")
    got = inject.inject_fakes(refs, pool, 2).collect()
    assert sum(r["_is_fake"] for r in got) == 4 and len(got) == 6


def test_tei(spark):
    xml = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><listBibl><biblStruct xml:id="b0"><analytic><title level="a">Ice on lakes</title><author><persName><surname>Doe</surname></persName></author><idno type="DOI">https://doi.org/10.1/A</idno></analytic>
    <monogr><title level="j">J. Ice</title><imprint><biblScope unit="volume">3</biblScope><biblScope unit="page" from="7" to="9"/><date when="2019-02"/></imprint></monogr></biblStruct></listBibl></TEI>"""
    df = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "id int, xml string")
    (r,) = tei.references(df, "id", "xml").collect()
    assert (r["xml_id"], r["title"], r["journal"], r["year"], r["volume"], r["first_page"], r["first_author"], r["doi"]) == ("b0", "Ice on lakes", "J. Ice", 2019, "3", "7", "Doe", "10.1/a")


def test_jsonl_and_index_rows(spark, tmp_path):
    good = {"DOI": "10.1/A", "container-title": ["The Ice"], "volume": "3", "page": "7-9", "issued": {"date-parts": [[2019, 1]]}, "author": [{"family": "Doe"}]}
    (tmp_path / "x.jsonl").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"DOI": "10.1/b"}) + "\n")
    (r,) = tei.biblio_rows(tei.read_jsonl(spark, str(tmp_path), tei.CROSSREF)).collect()
    assert (r["doi"], r["journal_norm"], r["year"], r["first_page"], r["author1"]) == ("10.1/a", "ice", 2019, "7", "Doe")


def test_ingest_takes_every_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    at = datetime.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, "2001", at, "a"), (1, "2001", at + datetime.timedelta(1), "b"), (2, "2002", at, "c")], "id int, month string, t timestamp, v string")
    df.write.parquet(src)
    for _ in range(2):
        ingest(spark, src, df.schema, out, ck, "id", "t")
    assert {(r["id"], r["v"]) for r in spark.read.parquet(out).collect()} == {(1, "b"), (2, "c")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "paper string, month string, found boolean, nonacademic boolean, has_title boolean, has_doi boolean, reason string, identity string")
    for f in (rates.per_paper, rates.per_month, rates.channels, rates.reason_mix, rates.paper_level):
        assert f(empty).count() == 0


def test_fuzzy_title_agrees_with_brute_force(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(2, 4))) for _ in range(60)]
    works = [(f"W{i:03}", " ".join(draw.sample(vocabulary, draw.randint(1, 9)))) for i in range(300)]
    words = [w[1].split() for w in works]
    refs = [(i, " ".join(w[: max(1, len(w) * 2 // 3)])) for i, w in enumerate(words)]
    refs += [(1000 + i, " ".join([*w[1:], draw.choice(vocabulary), draw.choice(w)])) for i, w in enumerate(words)]
    refs += [(2000, "on the gap filling of mean field r"), (2001, "gap"), (2002, "of the"), (2003, None)]
    works += [("X", "on the gap filling of mean field survey weights under intermittent supply")]
    a, b = spark.createDataFrame(refs, "cited_id int, title string"), spark.createDataFrame(works, "oa_id string, title_norm string")
    t, u = content_tokens(F.col("title")), content_tokens(F.col("title_norm"))
    # All pairs; those with enough of the words are candidates for certain, so the best pair is never worse than theirs.
    every = a.crossJoin(b).select("cited_id", "oa_id", F.round(containment(t, u), 6).alias("c"), F.round(jaccard(trigrams(F.col("title")), trigrams(F.col("title_norm"))), 6).alias("g")).filter("c >= 0.6")
    want = {r["cited_id"]: (r["g"], r["c"]) for r in every.groupBy("cited_id").agg(F.max(F.struct("g", "c")).alias("m")).select("cited_id", "m.*").collect()}
    got = {r["cited_id"]: r for r in match.fuzzy_title(a, b).collect()}
    assert len(want) > 550 and want.keys() <= got.keys()
    assert all((got[i]["grams"], got[i]["contained"]) >= m for i, m in want.items())
    assert got[2000]["oa_id"] == "X" and not {2002, 2003} & got.keys()


def test_fuzzy_title_compares_distinct_titles_and_joins_no_pair_that_cannot_win(spark):
    # 300 references and 300 works have the same two titles: once each, however many rows there are.
    title = "on the gap filling of mean field survey weights under intermittent supply"
    refs = spark.createDataFrame([(i, title.replace("supply", "suply")) for i in range(300)], "cited_id int, title string")
    works = spark.createDataFrame([(f"W{i:03}", title) for i in range(300)], "oa_id string, title_norm string")
    assert match._title_marks(works.select("title_norm").distinct(), "title_norm").count() == 1
    assert {(r["cited_id"], r["oa_id"]) for r in match.fuzzy_title(refs, works).collect()} == {(i, "W000") for i in range(300)}


def test_promising_keeps_every_pair_that_can_win(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(2, 4))) for _ in range(40)]
    rows = [(" ".join(draw.choices(words, k=draw.randint(1, 9))),) for _ in range(150)] + [("",), ("ab",)]
    marks = match._title_marks(spark.createDataFrame(rows, "title string").distinct(), "title", "tokens", "words")
    x, y = marks.alias("x"), marks.alias("y")
    c, g = F.round(containment(F.col("x.tokens"), F.col("y.words")), 6), F.round(jaccard(F.col("x.grams"), F.col("y.grams")), 6)
    for best in (0.0, 0.3, 0.5):
        pairs = marks.withColumn("best", F.lit(best)).alias("x").crossJoin(y).select(match._promising().alias("kept"), (good(c, g) & (F.coalesce(g, F.lit(0.0)) >= best)).alias("wins"))
        n = {(r["kept"], r["wins"]): r["count"] for r in pairs.groupBy("kept", "wins").count().collect()}
        assert (False, True) not in n and n[(False, False)] > 5 * n[(True, False)]
