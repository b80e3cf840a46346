import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.llm import canonical_list, entities, leakage, lookalike, names, packing, quality, scans
from refloom.session import cut


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


# Look-alikes


def test_canonical_segments_agree_with_whole_text():
    import unicodedata

    draw = random.Random(3)
    alphabet = "abc é́ëﬁｅ​а ν-A⁠ⅷ"
    for _ in range(2000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 12)))
        plain = lookalike._IGNORABLE.sub("", text)
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", plain).translate(lookalike._table()))
        assert lookalike.canonical(text) == whole, ascii(text)


def test_reads_like(spark):
    a = spark.createDataFrame([(1, "Ｈｅаrt​ valves: II"), (2, "heart valves"), (3, None), (4, ""), (5, "---"), (1, "Ｈｅаrt​ valves: II")], "id int, t string")
    b = spark.createDataFrame([("x", "heart valves ii"), ("w", "heartvalves ii"), ("v", "heart val ves"), ("y", None), ("z", "")], "k string, n string")
    assert rows(lookalike.reads_like(a, b, "t", "n"), "id", "k") == {(1, "x")}
    assert lookalike.with_canonical(a, "t", "t").filter("id = 1").first()["t"] == "Heart valves: II"
    stable = {"各国の統計": True, "żółć naïve": True, "ждём": False, "ﬁn": False, "e\u0301": False, "a\u200bb": False, "a\u00a0b": False, "": True}
    c = spark.createDataFrame([(k,) for k in stable], "t string")
    assert {r["t"]: r["s"] for r in c.select("t", lookalike.is_stable(F.col("t")).alias("s")).collect()} == stable


# Canonical list


def test_resolve(spark):
    alias = spark.createDataFrame([("annals of cryometrics", "1"), ("ann cryomet", "1"), ("studies in ice", "1"), ("studies in ice", "2"), ("journal of tides a", "3"), ("journal of tides b", "4")], "name_norm string, identity string")
    journal = spark.createDataFrame([("1", "Annals of Cryometrics"), ("3", "Journal of Tides A"), ("4", "Journal of Tides B"), ("2", "Ice Letters")], "identity string, display_name string")
    acronym = spark.createDataFrame([("ac", "1"), ("ac", "9"), ("jta", "3")], "acr string, identity string")
    want = {
        "Annals of Cryomterics": "1", "Cryometrics, Annals of": "1", "AnnalsofCryometrics": "1", "Anls of Cryometrics (Online)": "1", "Ann. Cryom.": "1", "Annals Cryometrics, vol. 12": "1",
        "Jnl of Tides A": "3", "Journal of Tides B": "4", "Journal of Tides": "unmatched", "AC": "unmatched", "J.T.A.": "3", "Annals of Xenography": "unmatched", "-": "unmatched", "to appear": "unmatched",
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,), (" ",), ("AC",)], "j string")
    assert {r["value"]: r["identity"] for r in canonical_list.resolve(df, "j", alias, acronym, journal).collect()} == want


def test_pigeonhole_finds_all_near_strings(spark):
    draw = random.Random(1)
    words = {"".join(draw.choice("abcd") for _ in range(draw.randint(5, 9))) for _ in range(120)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b, d) for a in words for b in words if a < b and (d := distance(a, b)) <= 2}
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert rows(names.similar_strings(df, "s"), "a", "b", "distance") == want


# Names


def test_names(spark):
    same = ["Smith, Elizabeth P.", "E. P. Smith", "Smith EP", "Smith, Liz", "Elizabeth Smith", "Smith Elizabeth", "SMITH E", "Smiht, Elizabeth", "Smith, E."]
    other = ["Smith, Robert", "R. Smith"]
    umlaut = ["Zinlörno, Karl-Heinz", "K.-H. Zinlorno", "Zinloerno, Karl-Heinz", "Zinlörno KH"]
    van = ["van der Doe, Anna", "A. VanDerDoe", "VAN DER DOE A", "Doe, Anna van der"]
    org = ["The Ferro Working Group on Ice & Snow", "Ferro WG on Ice & Snow", "Working Group Ferro on Ice & Snow"]
    filler = [f"{f}, {g}" for f in ("Karst", "Lumen", "Mirov") for g in ("Elizabeth", "Robert", "Anna")]
    df = spark.createDataFrame([(n,) for n in same + other + umlaut + van + org + filler + ["Zinloerno", "Karst", "Nobody", "Mirov DA", "Mirov, DA", "D. A. Mirov"] + [None, "", " ", "Anonymous", "Smith, E."]], "n string")
    got = {r["name"]: r["entity"] for r in names.link_names(df, "n").collect()}
    # A family name alone is linked where but one is known by it.
    assert got["Zinloerno"] == got[umlaut[0]] and got["Karst"] == "karst|" and got["Nobody"] == "nobody|"
    assert len({got[n] for n in ("Mirov DA", "Mirov, DA", "D. A. Mirov")}) == 1
    for group in (same, other, umlaut, van, org):
        assert len({got[n] for n in group}) == 1, [(n, got[n]) for n in group]
    assert len({got[g[0]] for g in (same, other, umlaut, van, org)}) == 5
    assert "Anonymous" not in got
    assert rows(names.pairs(names.link_names(df.limit(0), "n")), "name_a") == set()


def test_a_link_does_not_depend_on_the_number_of_spellings(spark):
    forms = ["{}, Elizabeth", "E. {}", "{} E", "{}, E.", "{}, Liz", "{}, Elizabeth P.", "E. P. {}"]
    true, slip, other = ([f.format(n) for f in forms] for n in ("Carstensen", "Carstenson", "Carstansen"))
    other = [n.replace("Elizabeth", "Eduardo").replace("Liz", "Eduardo") for n in other]
    df = spark.createDataFrame([(n,) for n in true + slip + other], "n string")
    got = {r["name"]: r["entity"] for r in names.link_names(df, "n").collect()}
    assert len({got[n] for n in true + slip}) == 1 and got[other[0]] != got[true[0]]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("x", "y")], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(31)] + [("x",), ("y",), ("z",)], "v string")
    got = dict(rows(names.components(nodes, edges, "v"), "v", "label"))
    assert {got[f"n{i:02}"] for i in range(31)} == {"n00"} and got["y"] == "x" and got["z"] == "z"


# Entities


def test_match(spark):
    draw = random.Random(5)
    parts = [["ice", "tide", "moth", "peat", "dune", "salt"], ["layers", "growth", "drift", "sorting", "mapping"], ["under", "near", "after"], ["constant", "cyclic", "partial", "strong"], ["load", "shade", "fields", "storms"]]
    works, seen = [], set()
    while len(works) < 150:
        t = "on the " + " ".join(draw.choice(p) for p in parts) + f" of {draw.choice('abcdefgh')}{draw.choice('lmnop')}ic {draw.choice(['beds', 'rings', 'sheets', 'gels'])}"
        if t not in seen:
            seen.add(t)
            works.append((f"W{len(works)}", t, 1990 + len(works) % 30, str(len(works) % 40 + 1), str(100 + 7 * len(works))))
    works += [(None, None, None, None, None), ("We", "erratum " + works[0][1], 1990, "9", "3"), ("Wc", works[1][1] + " ii", 1991, "8", "4")]
    entries = [(i, w[1].title().replace("Ice", "lce" if i % 9 == 0 else "Ice"), str(w[2]), w[3] if i % 5 else None, f"{w[4]}-{int(w[4]) + 9}" if i % 4 else "") for i, w in enumerate(works[:120])]
    entries += [(900, None, "1990", None, None), (901, "", "", "", ""), (902, None, str(works[7][2]), works[7][3], works[7][4])]
    a = spark.createDataFrame(entries + entries[:3], "id int, t string, y string, v string, p string")
    b = spark.createDataFrame(works, "w string, t string, y int, v string, p string")
    got = entities.match(a, b, ("id", "t", "y", "v", "p"), ("w", "t", "y", "v", "p")).collect()
    right = {(i, f"W{i}") for i in range(120)}
    found = {(r["id"], r["w"]) for r in got}
    assert len(found & right) >= 116 and len(found - right - {(902, "W7")}) <= 3
    assert not any(w in ("We", "Wc") for _, w in found) and all(0.5 <= r["confidence"] <= 1 for r in got)


def test_mistyped_titles_are_candidates(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(2, 4)))
    works = [(f"W{i}", " ".join(word() for _ in range(8)), 2000, str(i), str(100 + i)) for i in range(200)]

    def typed(title, errors):
        words = title.split()
        for k in draw.sample(range(8), errors):
            at = draw.randrange(1, len(words[k]))
            words[k] = words[k][:at] + "x" + words[k][at + draw.randint(0, 1) :]
        return " ".join(words)

    two = [(i, typed(w[1], 2), None, None, None) for i, w in enumerate(works)]
    begun = [(1000 + i, " ".join(w[1].split()[:4]) + " " + w[1].split()[4][:1], None, None, None) for i, w in enumerate(works)]
    # Year and volume agree, the page is missing or wrong, and the title has one word left.
    issue = [(2000 + i, w[1].split()[5], str(w[2]), w[3], None if i % 2 else "7") for i, w in enumerate(works)]
    a = spark.createDataFrame(two + begun + issue, "id int, t string, y string, v string, p string")
    b = spark.createDataFrame(works, "w string, t string, y int, v string, p string")
    (l, l_keys), (r, r_keys) = entities._records(a, "id", "t", "y", "v", "p"), entities._records(b, "w", "t", "y", "v", "p")
    found = entities.candidates(l, r).join(l_keys.withColumnRenamed("rid", "l"), "l").join(r_keys.select(F.col("rid").alias("r"), F.col("key").alias("w")), "r")
    found = rows(found, "key", "w")
    assert sum((i, f"W{i}") in found for i in range(200)) >= 198
    assert all((k + i, f"W{i}") in found for k in (1000, 2000) for i in range(200))
    assert len(found) < 3000


def test_unlike_titles_of_the_same_phrases(spark, monkeypatch):
    # Without figures; before, all pairs that share a band were candidates, as the square of the titles.
    parts = [["towards ", "study of ", "on the "], ["thermal ", "bounded ", "passive "], ["age dating of ", "site ranking of "], ["cold atoms ", "heart valves ", "coral rubble "], ["at the percolation threshold", "under mechanical agitation", "with correlated noise"]]
    titles = ["".join(p) for p in itertools.product(*parts)]
    a = spark.createDataFrame([(i, t.replace("percolation", "percolatoin") if i % 2 else t) for i, t in enumerate(titles)], "id int, t string").selectExpr("id", "t", "cast(null as string) y", "cast(null as string) v", "cast(null as string) p")
    (l, l_keys), (r, r_keys) = entities._records(a, "id", "t", "y", "v", "p"), entities._records(a.withColumn("t", F.lower("t")), "id", "t", "y", "v", "p")
    texts = entities.titles(l, r).localCheckpoint()
    brute = texts.filter("side % 2 = 1").select(F.col("tid").alias("tl"), F.struct("text").alias("a")).crossJoin(texts.select(F.struct("text").alias("b")))
    assert brute.filter(entities._alike("a", "b") != (entities._title_step("a", "b") >= entities.ALIKE)).count() == 0
    whole = entities.title_pairs(texts).localCheckpoint()
    unlike = whole.filter("title < 10").count()
    assert unlike > 1000 and whole.agg(F.max("weight")).first()[0] == 1
    monkeypatch.setattr(entities, "SAMPLED", 20)
    drawn = entities.title_pairs(texts).localCheckpoint()
    assert rows(drawn.filter("title >= 10"), "tl", "tr") == rows(whole.filter("title >= 10"), "tl", "tr")
    sample = drawn.filter("title < 10")
    assert sample.count() < 0.4 * unlike and abs(sample.agg(F.sum("weight")).first()[0] - unlike) < 0.25 * unlike
    # Titles that are unlike aren't matched for their titles, whatever was drawn.
    found = entities.candidates(l, r)
    assert found.filter("own").filter("cast(split(cell, '[|]')[0] as int) < 10").count() == 0


def test_words_are_split_once_and_sources_filtered_before_titles_meet(spark, monkeypatch):
    # Before, words were split again for each neighbour and each minimum, and titles of the same source met in the join.
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    a = spark.createDataFrame([(i, f"ice beds of lake {i}", "2000", "3", str(i)) for i in range(9)], "id int, t string, y string, v string, p string")
    (l, _), (r, _) = entities._records(a, "id", "t", "y", "v", "p"), entities._records(a, "id", "t", "y", "v", "p")
    texts = entities.titles(l, r).localCheckpoint()
    records = l.join(texts.select("tid", "s1", "s2"), "tid").localCheckpoint()
    assert [plan(entities._figure_blocks(records, left)).count("split(text") for left in (True, False)] == [1, 1]
    plans = []
    monkeypatch.setattr(entities, "cut", lambda df, free=False: plans.append(plan(df)) or df)
    entities.title_pairs(texts)
    met = plans[:-1]
    assert len(met) == -(-entities.BANDS // entities.PASS) + 1 and met[-1].count("split(text") == 2
    assert all(re.search(rf"Filter .*side#\d+ & {bit}\) > 0", p) for p in met for bit in (1, 2))


def test_shuffle_files_end_with_what_they_were_for(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = {files.apply(i).getName() for i in range(files.size())}
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    frame = spark.range(20_000).groupBy((F.col("id") % 77).alias("k")).count()
    before = shuffled()
    kept = cut(frame, free=True)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert kept.count() == 77 and frame.count() == 77 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


# Scans


@pytest.mark.parametrize(
    ("citation", "fields", "text", "kinds"),
    [
        ("Doe, A. On fermen-\r\ntation of ice.", "On fermentation of ice Doe, A.", "Doe, A. On fermentation of ice.", (True, False, False)),
        ("Doe, A. On low-\nrank ice, J. Ice 3, 12-\n19", "On low-rank ice Doe, A. J. Ice 3 12-19", "Doe, A. On low-rank ice, J. Ice 3, 12-19", (False, False, False)),
        ("Doe, A. On ice\n\n— 829 —\n\nbeds, 2019.", "On ice beds Doe, A. 2019", "Doe, A. On ice beds, 2019.", (False, False, True)),
        ("Doe, A. On evi-\n\nREFERENCES (continued)    88\n\ndence of ice", "On evidence of ice Doe, A.", "Doe, A. On evidence of ice", (True, True, True)),
        ("JOURNAL OF ICE\nDoe, A. On beds. Journal of Ice 3\n2019", "On beds Doe, A. Journal of Ice 3 2019", "Doe, A. On beds. Journal of Ice 3 2019", (False, True, False)),
        ("Doe, A. On beds, J. Ice\n(2019)\n1817", "On beds Doe, A. J. Ice 2019 1817", "Doe, A. On beds, J. Ice (2019) 1817", (False, False, False)),
        ("", "", "", (False, False, False)),
    ],
)
def test_repair_page(citation, fields, text, kinds):
    got = scans.repair_page(citation, fields)
    assert got[0] == text and got[1:4] == kinds


def test_misread(spark):
    clean = [(i, f"Doe, A. On layered beds near {w}. Ice {i}", f"On layered beds near {w}", "Doe, A.", "Ice") for i, w in enumerate(["lakes", "towns", "coasts"] * 6)]
    bad = [(100, "Doe, A. On 1ayered beds\nncar lakes. Ice 3", "On layered beds near lakes", "Doe, A.", "Ice"), (101, "Doe, A. On layered bcds\nnear lakes", "On layered bcds near lakes", "Doe, A.", "Ice"), (102, None, None, None, None)]
    df = spark.createDataFrame(clean + bad, "id int, c string, t string, a string, j string")
    got = {r["id"]: r for r in scans.repair(df, "id", "c", ["t", "a", "j"], "j").collect()}
    assert got[100]["misread"] and got[100]["text"] == "Doe, A. On layered beds near lakes. Ice 3"
    assert not got[101]["misread"] and not got[0]["misread"] and 102 not in got


def test_misread_without_fields(spark):
    draw = random.Random(9)
    rest = ["lakes", "towns", "coasts", "peaks"]
    clean = [(i, f"Doe, A. On layered beds near {draw.choice(rest)}. Ice {i}", "Doe, A.", None) for i in range(120)]
    bad = [(500, "Doe, A. On 1ayered beds near lakes. Ice 3", "Doe, A.", None), (501, "Doe, A. On layered bods near lakes. Ice 3", "Doe, A.", None), (502, "Doe, A. On layered bcds near lakes. Ice 3", "Doe, A.", None)]
    typed = [(503, "Roe, B. On bcds", "On bcds", None)]
    df = spark.createDataFrame(clean + bad + typed, "id int, c string, a string, j string")
    got = {r["id"]: r["misread"] for r in scans.repair(df, "id", "c", ["a", "j"], "j").collect()}
    # What fits its context is misread though no field shows it; another word, or one that some field has as it stands, isn't.
    assert got[500] and not got[501] and not got[502] and not got[503] and not any(got[i] for i in range(120))


# Packing


def test_pack(spark):
    draw = random.Random(2)
    sizes = [draw.choice([0, 5, 40, 100, 333, 511, 512, 513, 1500]) for _ in range(900)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id bigint, tokens int")
    packs = spark.createDataFrame([(1, 512), (2, 2048), (3, None), (4, 0)], "pack_id int, capacity int")
    got = packing.pack(items, packs).toPandas()
    assert set(got["pack_id"]) == {1, 2}
    for p, capacity in ((1, 512), (2, 2048)):
        g = got[got["pack_id"] == p]
        assert g.groupby("id")["tokens"].sum().tolist() == sizes
        assert g.groupby("container")["tokens"].sum().max() <= capacity
        assert all(n == max(1, -(-sizes[i] // capacity)) for i, n in g.groupby("id").size().items())
        assert g["container"].nunique() <= 1.03 * sum(sizes) / capacity + 1


def test_pack_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK", 100)
    items = spark.createDataFrame([(i, 60 if i % 2 else 39) for i in range(1000)], "id bigint, tokens int")
    got = packing.pack(items, spark.createDataFrame([(1, 100)], "pack_id int, capacity int")).toPandas()
    assert len(got) == 1000 and got.groupby("container")["tokens"].sum().max() <= 100 and got["container"].nunique() <= 560


def test_pack_of_nothing_and_many_capacities(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_PACKS", 2)
    items = spark.createDataFrame([(i, 0 if i < 50 else 10) for i in range(60)] + [(99, None)], "id bigint, tokens int")
    got = packing.pack(items, spark.createDataFrame([(k, 10) for k in range(5)], "pack_id int, capacity int")).toPandas()
    assert set(got["pack_id"]) == set(range(5)) and len(got) == 5 * 61
    assert got.groupby(["pack_id", "container"])["id"].size().max() <= 8


# Leakage


def test_leaks(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}x" for i in range(400)]
    item = lambda: [draw.choice(vocabulary) for _ in range(60)]
    items = [item() for _ in range(20)]
    filler = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    docs, want = [(900, None), (901, ""), (902, filler(3000))], set()
    for k in range(60):
        words = list(items[k % 20][k % 30 : k % 30 + 24])
        words[7], words[16] = "changed", "words"
        docs.append((k, f"{filler(400)} {' '.join(words).upper()}, {filler(400)}"))
        want.add((k, k % 20))
    docs += [(800, f"{filler(50)} {' '.join(items[0][5:14])} {filler(50)}")]
    a = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, "Choose the best answer. " + " ".join(w) + ".") for i, w in enumerate(items)] + [(99, None)], "item_id bigint, text string")
    assert rows(leakage.find_leaks(a, b, "doc_id", "text", "item_id", "text"), "doc_id", "item_id") == want


def test_items_of_every_length_are_found(spark):
    draw = random.Random(6)
    vocabulary = [f"w{i}x" for i in range(500)]
    filler = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = {n: filler(n) for n in range(1, 31)}
    docs = [(n, f"{' '.join(['other'] * 40)} {t}, {' '.join(['words'] * 90)}") for n, t in items.items()] + [(100, filler(4))]
    a = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame(list(items.items()), "item_id int, text string")
    got = rows(leakage.find_leaks(a, b, "doc_id", "text", "item_id", "text"), "doc_id", "item_id")
    assert {(n, n) for n in items} <= got
    # A document holds a short item exactly if its words stand there one behind the other.
    want = {(d, n) for d, x in docs for n, t in items.items() if n < 9 and f" {t} " in f" {x.replace(',', '')} "}
    assert {x for x in got if x[1] < 9} == want


def test_alignment_of_few_places_agrees_with_the_dense_one():
    draw = np.random.default_rng(12)
    for k in range(1500):
        item, doc = draw.integers(1, 3 + k % 40, draw.integers(0, 70)), draw.integers(0, 3 + k % 40, draw.integers(0, 200))
        if k % 3 == 0 and len(item) and len(doc):
            # A passage with changed, missing and added words.
            doc = np.concatenate([doc, np.delete(item, draw.integers(0, len(item), 2)), doc[:3], item[5:25], doc[:9]])
        assert leakage.longest_passage(item, doc) == leakage._dense(item, doc)


def test_chance_candidates_cost_little():
    # Before, every place of the stretch was scored for every word of the item.
    draw, items = np.random.default_rng(13), []
    for _ in range(40):
        item, doc = draw.integers(1, 400, 80), draw.integers(0, 400, 110)
        doc[50:59] = item[20:29]
        items.append((item, doc))

    def seconds():
        began = time.process_time()
        assert all(leakage.longest_passage(*x)[1] >= 9 for x in items)
        return time.process_time() - began

    def by_rows(item, doc):
        for w in item:
            for _ in range(16):
                np.where(doc == w, 1, 0)

    own = min(seconds() for _ in range(3))
    began = time.process_time()
    for x in items:
        by_rows(*x)
    assert own < (time.process_time() - began) / 2


# Quality


def test_quality(spark):
    prose = "We found that the samples were kept at low temperature until they had been used. It would be wrong to conclude that this is all."
    texts = {
        prose: True, prose.lower().replace(".", ""): True, "1) " + prose: True, "> " + prose: True, "Es ist bekannt, dass die Quote von der Zeit abhängt.": True,
        "- moth migration\n- ice coring\n- peat bogs in mixed stands": False, "a,b,c\n1,2,3\n4,5,6": False, "ha ha ha ha ha ha ha ha": False, "[1] A. Doe. Ice beds. J. Ice 3, 4-9 (2019).\n[2] B. Roe. Tides. J. Sea 7, 2-3 (2001).": False,
        "Badania pokazały wyraźnie iż próbki lodu trzymano zawsze w bardzo niskiej temperaturze. Wszyscy uczestnicy otrzymali później identyczne wyniki końcowe oraz krótkie podsumowanie całości.": True,
        "これは氷の試料を低温で保存した研究である。結果は前の年と同じであった。": True, (prose + "\n") * 6: False, "Lodowiec, Brzeg, Morze, Wydma, Torfowisko\nRzeka, Jezioro, Staw": False,
        prose + "\n" + "| a | 1 |\n" * 60: False, None: None, " ": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = quality.with_quality(df, "t").collect()
    assert {r["t"]: r["quality"]["is_prose"] for r in got} == texts
    dup = quality.describe("same line here\nsame line here\n\nother line")
    assert abs(dict(zip(quality.STATS.fieldNames(), dup))["dup_line_share"] - 14 / 38) < 1e-9
    assert quality.describe("word " * 200_000)[1] == 200_000


def test_empty_and_null_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string")
    assert leakage.find_leaks(docs, items, "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.find_leaks(spark.createDataFrame([(1, "x y z")], "doc_id bigint, text string"), items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert quality.with_quality(docs, "text").count() == 0
    assert packing.pack(docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("tokens")), spark.createDataFrame([(1, 10)], "pack_id int, capacity int")).count() == 0
    a = spark.createDataFrame([(1, None, None, None, None)], "id int, t string, y string, v string, p string")
    assert entities.match(a, a.withColumnRenamed("id", "w"), ("id", "t", "y", "v", "p"), ("w", "t", "y", "v", "p")).count() == 0
    c = spark.createDataFrame([(1, None, None, None)], "id int, c string, t string, j string")
    assert scans.repair(c, "id", "c", ["t"], "j").count() == 0
    assert names.link_names(spark.createDataFrame([(None,)], "n string"), "n").count() == 0
    none = spark.createDataFrame([], "name_norm string, identity string, acr string, display_name string")
    got = canonical_list.resolve(spark.createDataFrame([("Annals of Ice",), (None,)], "j string"), "j", none.select("name_norm", "identity"), none.select("acr", "identity"), none.select("identity", "display_name"))
    assert rows(got, "value", "identity") == {("Annals of Ice", "unmatched")}


def test_none_missing_is_no_missing_word(spark):
    draw = random.Random(8)
    words = "a study of weakly bound desorption barley roots granulation moraine ridges under thermal drift with limited labels".split()
    slip = lambda w: w[:2] + w[3:] if draw.random() < 0.3 else w
    rows = []
    for _ in range(300):
        a = draw.sample(words, draw.randint(1, 7))
        rows.append((" ".join(a), " ".join(slip(w) for w in draw.choice([a, a[1:] or a, a[:-1] + draw.sample(words, 1)]))))
    df = spark.createDataFrame(rows, "x string, y string").select(F.struct(F.col("x").alias("text")).alias("a"), F.struct(F.col("y").alias("text")).alias("b"))
    got = {(r["n"], r["m"]): r["count"] for r in df.groupBy(entities._none_missing("a", "b").alias("n"), (entities._missing("a", "b") == 0).alias("m")).count().collect()}
    assert set(got) == {(True, True), (False, False)} and min(got.values()) > 30
