"""References resolved against indexes of works: each lookup is one join over all references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions import text
from refloom.functions.keys import arxiv_key, ascii_key, content_tokens, doi_key, journal_key, page_key, surname, volume_key
from refloom.functions.similarity import containment, good, jaccard, trigram_marks
from refloom.session import cut


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of rows with the same key the last version; of equal versions one."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("__row")).select(key, *[F.col("__row")[c].alias(c) for c in others])


def with_reference_keys(cited: DataFrame) -> DataFrame:
    """Adds the keys that references are looked up by."""
    year = F.try_to_number(F.regexp_extract("year", r"(1[89]\d{2}|20\d{2})", 1), F.lit("9999")).cast("int")
    key = ascii_key(F.col("title"))
    none = lambda c: F.nullif(c, F.lit(""))
    page = none(page_key(F.regexp_extract(F.trim("pages"), r"^([^-–\s]+)", 1)))
    return cited.withColumns({"y": year, "title_key": F.when(F.size(F.split(key, " ")) >= 4, key), "journal_key": none(journal_key(F.col("journal"))), "vol": none(volume_key(F.col("volume"))), "page": page, "doi_key": doi_key(F.col("doi")), "s": surname(F.col("authors"))})


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of rows with the same key the one of the last version, by one sort of each partition."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def reference_keys(cited: DataFrame) -> DataFrame:
    """The last version of each reference with its keys."""
    rows = cited.select("cited_id", "paper", "i", "month", "title", "authors", "year", "citation", "pages", "journal", "volume", "doi", "loaded_at")
    return with_reference_keys(newest(rows, "cited_id", "loaded_at"))


def unique_identities(alias: DataFrame, key: str = "name_norm") -> DataFrame:
    """Names that belong to one identity only."""
    return alias.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("name")).agg(F.min("identity").alias("identity"), F.count_distinct("identity").alias("n")).filter("n = 1").drop("n")


def resolve_journals(names: DataFrame, column: str, alias: DataFrame, acronym: DataFrame) -> DataFrame:
    """Adds ``identity``: of the alias if it is unique, null if it is not, else of a unique acronym of 2 to 10 letters."""
    known = alias.select(F.col("name_norm").alias("__key")).filter(F.col("__key").isNotNull()).distinct().withColumn("__known", F.lit(True))
    a, b = unique_identities(alias).select(F.col("name").alias("__key"), F.col("identity").alias("__alias")), unique_identities(acronym, "acr").select(F.col("name").alias("__acr"), F.col("identity").alias("__acronym"))
    rows = names.withColumn("__key", journal_key(F.col(column))).withColumn("__acr", F.replace("__key", F.lit(" "), F.lit("")))
    rows = rows.join(a, "__key", "left").join(known, "__key", "left").join(b, "__acr", "left")
    short = F.length("__acr").between(2, 10)
    return rows.withColumn("identity", F.when(F.col("__known"), F.col("__alias")).when(short, F.col("__acronym"))).drop("__key", "__acr", "__alias", "__known", "__acronym")


def same_journal(a: Column, b: Column) -> Column:
    """J13b without the authority: equal keys, or every word of the shorter begins one of the longer; missing never rejects."""
    words = lambda c: F.filter(F.split(journal_key(c), " "), lambda w: F.length(w) >= 3)
    letter = lambda c: F.regexp_extract(journal_key(c), r" ([a-z])$", 1)
    x, y = words(a), words(b)
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    begins = F.forall(short, lambda s: F.exists(long, lambda l: F.startswith(l, s) | F.startswith(s, l)))
    letters = (letter(a) == "") | (letter(b) == "") | (letter(a) == letter(b))
    single = F.size(short) <= 1
    return F.when(F.coalesce(a, F.lit("")) == "", True).when(F.coalesce(b, F.lit("")) == "", True).otherwise(letters & F.when(single, F.array_sort(F.array_distinct(short)) == F.array_sort(F.array_distinct(long))).otherwise(begins))


def by_doi(refs: DataFrame, index: DataFrame, doi: str = "doi_key", rank: str = "oa_id") -> DataFrame:
    """(cited_id, matched) by DOI, the first record of each DOI."""
    one = index.withColumn("doi_key", doi_key(F.col("doi"))).filter(F.col("doi_key").isNotNull()).groupBy("doi_key").agg(F.min(rank).alias("matched"))
    return refs.select("cited_id", F.col(doi).alias("doi_key")).join(one, "doi_key").select("cited_id", "matched")


def by_biblio(refs: DataFrame, biblio: DataFrame) -> DataFrame:
    """(cited_id, matched DOI) by journal, year and volume with a page; without a page by author if only one DOI fits."""
    b = biblio.select(F.col("doi").alias("matched"), F.col("journal_norm").alias("journal_key"), F.col("year").alias("y"), volume_key(F.col("volume")).alias("vol"), page_key(F.col("first_page")).alias("p1"), page_key(F.col("article_num")).alias("p2"), surname(F.col("author1")).alias("sur")).distinct()
    both = refs.select("cited_id", "journal_key", "y", "vol", "page", "s").join(b, ["journal_key", "y", "vol"])
    paged = (F.col("page") == F.col("p1")) | (F.col("page") == F.col("p2"))
    named = F.col("page").isNull() & (F.col("s") == F.col("sur"))
    hit = lambda c: F.when(c, F.col("matched"))
    found = both.groupBy("cited_id").agg(F.min(hit(paged)).alias("p"), F.min(hit(named)).alias("n"), F.count_distinct(hit(named)).alias("k"))
    return found.select("cited_id", F.coalesce("p", F.when(F.col("k") == 1, F.col("n"))).alias("matched")).filter("matched IS NOT NULL")


def by_metadata(refs: DataFrame, oa: DataFrame, least: float = 0.4) -> DataFrame:
    """(cited_id, matched) by journal, year and volume: the only work with the page, else with the author, else at all.

    A work whose title shares too few words with the reference's is taken back; where either has none it stays.
    """
    w = oa.select("oa_id", F.col("journal_norm").alias("journal_key"), F.col("year").alias("y"), volume_key(F.col("volume")).alias("vol"), page_key(F.col("first_page")).alias("p"), surname(F.col("author1")).alias("sur"), "title_norm").distinct()
    both = refs.select("cited_id", "journal_key", "y", "vol", "page", "s", "title").join(w, ["journal_key", "y", "vol"])
    steps = {"page": F.col("p") == F.col("page"), "author": F.col("sur") == F.col("s"), "sole": F.lit(True)}
    hit = lambda c, x: F.when(c, x)
    aggs = [a for k, c in steps.items() for a in (F.count_distinct(hit(c, F.col("oa_id"))).alias(f"n_{k}"), F.min(hit(c, F.struct("oa_id", "title_norm"))).alias(f"w_{k}"))]
    found = both.groupBy("cited_id").agg(F.min("title").alias("title"), *aggs)
    chosen = F.coalesce(*[F.when(F.col(f"n_{k}") == 1, F.col(f"w_{k}")) for k in steps])
    found = found.select("cited_id", "title", chosen.alias("w")).filter("w IS NOT NULL")
    a, b = F.array_distinct(content_tokens(F.col("title"))), F.array_distinct(content_tokens(F.col("w.title_norm")))
    apart = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) < least * F.size(F.array_union(a, b)))
    return found.filter(~apart).select("cited_id", F.col("w.oa_id").alias("matched"))


def by_title(refs: DataFrame, oa: DataFrame) -> DataFrame:
    """(cited_id, matched) by equal title; works with a DOI first, then the nearest year, then the smallest id."""
    w = oa.select("oa_id", F.col("title_norm").alias("title_key"), "year", F.col("doi").isNull().cast("int").alias("bare")).distinct()
    both = refs.filter(F.col("title_key").isNotNull()).select("cited_id", "title_key", "y").join(w, "title_key")
    return both.groupBy("cited_id").agg(F.min(F.struct("bare", F.abs(F.coalesce("year", F.lit(0)) - F.coalesce("y", "year", F.lit(0))).alias("d"), "oa_id")).alias("b")).select("cited_id", F.col("b.oa_id").alias("matched"))


def by_repaired_title(refs: DataFrame, oa: DataFrame) -> DataFrame:
    """(cited_id, matched) by a repaired form of the title, the first that is known; works in the order of ``by_title``."""
    t = F.col("title")
    forms = F.array(text.written_ligatures(t), text.without_leading_author(t), text.greek_symbols(t))
    v = refs.filter(t.isNotNull()).select("cited_id", "y", F.posexplode(F.transform(forms, ascii_key)).alias("k", "title_key")).filter(F.size(F.split("title_key", " ")) >= 4)
    w = oa.select("oa_id", F.col("title_norm").alias("title_key"), "year", F.col("doi").isNull().cast("int").alias("bare")).distinct()
    best = F.min(F.struct("k", "bare", F.abs(F.coalesce("year", F.lit(0)) - F.coalesce("y", "year", F.lit(0))).alias("d"), "oa_id")).alias("b")
    return v.join(w, "title_key").groupBy("cited_id").agg(best).select("cited_id", F.col("b.oa_id").alias("matched"))


def by_arxiv_title(refs: DataFrame, arxiv: DataFrame) -> DataFrame:
    """(cited_id, matched) by the title authority, titles of four words or more, the smallest identifier."""
    a = arxiv.select(arxiv_key(F.col("title")).alias("k"), "arxiv_id").filter(F.size(F.split("k", " ")) >= 4).groupBy("k").agg(F.min("arxiv_id").alias("matched"))
    return refs.select("cited_id", arxiv_key(F.col("title")).alias("k")).join(a, "k").select("cited_id", "matched")


def cascade(refs: DataFrame, phases: list[tuple[str, DataFrame]]) -> DataFrame:
    """(cited_id, method, matched): of all phases the first that found something; one shuffle for all of them."""
    found = None
    for k, (name, hits) in enumerate(phases):
        part = hits.select("cited_id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("method"), F.col("matched")).alias("hit"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("cited_id").agg(F.min("hit").alias("hit")).select("cited_id", "hit.method", "hit.matched")


def federate(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records of two sources by key, the left one's values first, with the source of every value."""
    l = left.select(key, *[F.col(f).alias(f"__l_{f}") for f in fields], F.lit(True).alias("in_left"))
    r = right.select(key, *[F.col(f).alias(f"__r_{f}") for f in fields], F.lit(True).alias("in_right"))
    both = l.join(r, key, "full_outer")
    source = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"__l_{f}").isNotNull() | F.col(f"__r_{f}").isNotNull(), F.struct(F.lit(f), F.when(F.col(f"__l_{f}").isNotNull(), "left").otherwise("right"))) for f in fields])))
    return both.select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"), *[F.coalesce(f"__l_{f}", f"__r_{f}").alias(f) for f in fields], source.alias("sources"))


def prefix_exists(values: DataFrame, column: str, index: DataFrame, other: str, least: int = 14) -> DataFrame:
    """Values that begin some entry of the index; prefixes of each needed length are made, so the join is equal."""
    long = values.filter(F.length(column) >= least)
    # The lengths that occur, between the shortest and the longest; an entry gives its beginnings of these lengths alone.
    lengths = long.agg(F.array_sort(F.collect_set(F.length(column))).alias("lengths"))
    ends = F.filter("lengths", lambda n: n <= F.length(other))
    heads = index.join(F.broadcast(lengths)).select(F.explode(F.transform(ends, lambda n: F.substring(F.col(other), F.lit(1), n))).alias(column)).distinct()  # one row
    return long.join(heads, column, "left_semi")


def duplicate_conflicts(works: DataFrame, key: str = "doi") -> DataFrame:
    """Keys with several records, and whether these disagree in year or venue."""
    return works.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("oa_id").alias("records"), (F.max("year") - F.min("year")).alias("year_spread"), F.count_distinct("journal_norm").alias("venues")).filter("records > 1")


#: Passes of ``fuzzy_title`` over the bands of titles, and over parts of their words.
BAND_PASSES, WORD_PASSES = (range(0, 8), range(8, 24), range(24, 40)), range(4)


def _title_marks(df: DataFrame, title: str, *kept: str) -> DataFrame:
    """(tid, k, n, wb, g1, g2, grams, bands; kept of tokens and words) of distinct titles: their words, trigrams, and bits that show of most
    pairs that they share too few of them."""
    plain = F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "")
    made = df.select(F.xxhash64(title).alias("tid"), content_tokens(F.col(title)).alias("tokens"), trigram_marks(plain).alias("m"))
    made = made.withColumn("words", F.array_sort(F.array_distinct("tokens")))
    bits = F.expr("aggregate(words, 0L, (t, w) -> t | shiftleft(1L, cast(pmod(xxhash64(w), 64) as int)))")
    return cut(made.select("tid", *kept, F.size("tokens").alias("k"), F.size("m.grams").alias("n"), bits.alias("wb"), "m.g1", "m.g2", "m.grams", "m.bands"), free=True)


def _promising(least_contained: float = 0.6, least_jaccard: float = 0.5) -> Column:
    """Whether two titles x and y can be good and no worse than the best of x so far, by their bits: a bit that one has and
    the other has not is a word or a trigram that they don't share, so nothing that can be better is lost."""
    missing = lambda a, b: f"bit_count({a}.g1 & ~{b}.g1) - bit_count({a}.g2 & ~{b}.g2)"
    shared = f"least(x.n - {missing('x', 'y')}, y.n - {missing('y', 'x')})"
    # Similarities are compared as rounded to six places.
    grams = lambda t: f"{shared} * (1 + {t}) >= (x.n + y.n) * ({t} - 1e-6)"
    return F.expr(f"{grams('x.best')} AND (x.k - bit_count(x.wb & ~y.wb) >= x.k * {least_contained - 1e-6:e} OR {grams(f'{least_jaccard:e}')})")


def fuzzy_title(refs: DataFrame, works: DataFrame) -> DataFrame:
    """Candidates by inverted indexes, verified by containment and trigrams, the best for each reference.

    Every work that holds enough of a reference's words is a candidate: whatever the shared words are, the three rarest
    of them lie in the prefix that is left when as many of the commonest words are taken away as may be needed for the
    threshold, so the prefix's triples are looked up among all triples of the works; where fewer than three words may be
    enough, single words are.  Works that share trigrams but not words come from MinHash bands.

    Distinct titles are compared, in passes over the blocks: what a pass finds is the least that later ones look for, and
    pairs that cannot be good or better are dropped where they meet.
    """

    # References come out of long plans, and are needed at both ends.
    refs = cut(refs.filter("title IS NOT NULL").select("cited_id", "title"), free=True)
    l = _title_marks(refs.select("title").distinct(), "title", "tokens")
    # Of works with the same title the first stands for all.
    firsts = works.filter("title_norm IS NOT NULL").groupBy("title_norm").agg(F.min("oa_id").alias("oa_id"))
    r = _title_marks(firsts.select("title_norm"), "title_norm", "words")
    ids = firsts.select(F.xxhash64("title_norm").alias("tr"), "oa_id")

    known = r.select(F.explode("words").alias("w"))
    counted = l.select("tid", F.col("k").alias("n"), F.explode("tokens").alias("w")).groupBy("tid", "n", "w").agg(F.count("*").alias("m"))
    ranked = counted.join(known.groupBy("w").agg(F.count("*").alias("df")), "w", "left").groupBy("tid", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w", "m"))).alias("ws"))
    ranked = ranked.withColumns({"least": F.ceil(F.col("n") * 0.6 - 1e-9), "most": F.array_max(F.transform("ws", lambda x: x["m"]))}).withColumn("by3", 2 * F.col("most") < F.col("least"))
    least = F.col("least") - F.when(F.col("by3"), 2 * F.col("most")).otherwise(0)
    rest = lambda i: F.aggregate(F.slice("ws", i + 1, F.size("ws")), F.lit(0).cast("bigint"), lambda t, x: t + x["m"])
    probes = ranked.withColumn("head", F.filter("ws", lambda x, i: (x["df"] > 0) & (rest(i) >= least))).select("tid", "by3", F.array_sort(F.transform("head", lambda x: x["w"])).alias("head"))
    probes = cut(probes, free=True)

    def triples(words: Column) -> Column:
        return F.flatten(F.transform(words, lambda a: F.flatten(F.transform(F.filter(words, lambda b: b > a), lambda b: F.transform(F.filter(words, lambda c: c > b), lambda c: F.xxhash64(a, b, c))))))

    single = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    bands = lambda d, own: d.withColumn("blocks", F.slice("bands", own.start + 1, len(own)))
    part = lambda d, blocks, i: d.withColumn("blocks", F.filter(blocks, lambda b: F.pmod(b, F.lit(len(WORD_PASSES))) == i))
    # The first bands find the best of most references, so fewer pairs are left for the others.
    sides = [(bands(l, own), bands(r, own)) for own in BAND_PASSES]
    worded = l.join(probes, "tid")
    sides += [(part(worded, F.when(F.col("by3"), triples(F.col("head"))).otherwise(single(F.col("head"))), i), part(r, F.concat(triples(F.col("words")), single(F.col("words"))), i)) for i in WORD_PASSES]
    shown = ["tid", "k", "n", "wb", "g1", "g2"]
    best = None
    for x, y in sides:
        x = x.select(*shown, F.explode("blocks").alias("block"))
        x = x.withColumn("best", F.lit(0.0)) if best is None else x.join(best.select(F.col("tl").alias("tid"), F.col("b.grams").alias("best")), "tid", "left").fillna(0.0, ["best"])
        y = y.select(*[c for c in shown if c != "k"], F.explode("blocks").alias("block"))
        pairs = x.alias("x").join(y.alias("y"), (F.col("x.block") == F.col("y.block")) & _promising()).select(F.col("x.tid").alias("tl"), F.col("y.tid").alias("tr")).distinct()
        both = pairs.join(l.select(F.col("tid").alias("tl"), "tokens", F.col("grams").alias("gl")), "tl").join(r.select(F.col("tid").alias("tr"), "words", F.col("grams").alias("gr")), "tr")
        contained = containment(F.col("tokens"), F.col("words"))
        grams = jaccard(F.col("gl"), F.col("gr"))
        kept = both.select("tl", "tr", F.round(contained, 6).alias("contained"), F.round(grams, 6).alias("grams")).filter(good(F.col("contained"), F.col("grams"))).join(ids, "tr")
        found = kept.select("tl", F.struct((-F.coalesce("grams", F.lit(-1.0))).alias("o"), (-F.coalesce("contained", F.lit(-1.0))).alias("p"), "oa_id", "contained", "grams").alias("b"))
        own = found.groupBy("tl").agg(F.min("b").alias("b"))
        best = cut(own if best is None else best.unionByName(own).groupBy("tl").agg(F.min("b").alias("b")), free=True)
    return refs.select("cited_id", F.xxhash64("title").alias("tl")).join(best, "tl").select("cited_id", "b.oa_id", "b.contained", "b.grams")


def best_overlap(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str, left_words: str, right_words: str, least: float = 0.4) -> DataFrame:
    """For each row of the left its row of the right in the same group that holds most of its words, from ``least`` on.

    Words are joined, not rows, so rows that share nothing never meet; equal overlaps go to the smallest key.
    """
    l = left.select(group, left_key, F.size(F.array_distinct(left_words)).alias("__n"), F.explode(F.array_distinct(left_words)).alias("__w"))
    r = right.select(group, right_key, F.explode(F.array_distinct(right_words)).alias("__w"))
    shared = l.join(r, [group, "__w"]).groupBy(group, left_key, right_key, "__n").agg(F.count("*").alias("__k"))
    scored = shared.withColumn("overlap", F.round(F.col("__k") / F.col("__n"), 6)).filter(F.col("overlap") >= least)
    return scored.groupBy(group, left_key).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(right_key).alias("r"))).alias("b")).select(group, left_key, F.col("b.r").alias(right_key), (-F.col("b.o")).alias("overlap"))


def by_citation(refs: DataFrame, oa: DataFrame) -> DataFrame:
    """(cited_id, method, matched) by DOI, title and year, title, variants of the title."""
    w = oa.select("oa_id", F.col("title_norm").alias("title_key"), F.col("year").alias("y")).distinct()
    dated = refs.select("cited_id", "title_key", "y").join(w, ["title_key", "y"]).groupBy("cited_id").agg(F.min("oa_id").alias("matched"))
    return cascade(refs, [("doi", by_doi(refs, oa)), ("title_year", dated), ("title", by_title(refs, oa)), ("variant", by_repaired_title(refs, oa))])


def by_venue(refs: DataFrame, oa: DataFrame, names: DataFrame, span: int = 1) -> DataFrame:
    """J6s: (cited_id, matched) by identity of the journal, volume and year, ``span`` off at most: the only work with the page,
    else the only one.  A mark "(R)" behind a page doesn't count."""
    p = F.regexp_replace(page_key(F.col("first_page")), r"\(r\)$", "")
    w = oa.join(names, F.col("journal_norm") == F.col("name")).select("oa_id", "identity", F.col("year").alias("wy"), volume_key(F.col("volume")).alias("vol"), p.alias("p")).distinct()
    # Equal years are joined, once for each year allowed, so the join needs no range.
    years = F.explode(F.sequence(F.col("wy") - span, F.col("wy") + span)).alias("y")
    both = refs.select("cited_id", "identity", "vol", "y", "page").join(w.select("oa_id", "identity", "vol", "p", years), ["identity", "vol", "y"])
    paged = F.when(F.col("p") == F.col("page"), F.col("oa_id"))
    g = both.groupBy("cited_id").agg(F.count_distinct(paged).alias("k"), F.min(paged).alias("with_page"), F.count_distinct("oa_id").alias("n"), F.min("oa_id").alias("sole"))
    return g.select("cited_id", F.when(F.col("k") == 1, F.col("with_page")).when(F.col("n") == 1, F.col("sole")).alias("matched")).filter("matched IS NOT NULL")


def filter_acceptance(refs: DataFrame, oa: DataFrame) -> DataFrame:
    """By filter the references that one, no or several works are left of."""
    w = oa.select("oa_id", F.col("journal_norm").alias("journal_key"), F.col("year").alias("y"), volume_key(F.col("volume")).alias("vol"), page_key(F.col("first_page")).alias("p"), surname(F.col("author1")).alias("sur")).distinct()
    both = refs.select("cited_id", "journal_key", "y", "vol", "page", "s").join(w, ["journal_key", "y", "vol"])
    hits = {"plain": F.col("oa_id"), "page": F.when(F.col("p") == F.col("page"), F.col("oa_id")), "author": F.when(F.col("s") == F.col("sur"), F.col("oa_id"))}
    h = both.groupBy("cited_id").agg(*[F.count_distinct(c).alias(k) for k, c in hits.items()])
    each = h.select(F.explode(F.array(*[F.struct(F.lit(k).alias("filter"), F.col(k).alias("hits")) for k in hits])).alias("x")).select("x.*")
    return each.groupBy("filter").agg(F.count("*").alias("refs"), F.count_if(F.col("hits") == 1).alias("one"), F.count_if(F.col("hits") == 0).alias("none"), F.count_if(F.col("hits") > 1).alias("several"), F.percentile("hits", F.lit(0.5)).alias("median_hits"))


def authority_status(names: DataFrame, column: str, alias: DataFrame) -> DataFrame:
    """Adds ``status``: OK, ABSENT or AMBIGUOUS(n)."""
    n = alias.filter(F.col("name_norm").isNotNull()).groupBy(F.col("name_norm").alias(column)).agg(F.count_distinct("identity").alias("__n"))
    status = F.when(F.col("__n").isNull(), "ABSENT").when(F.col("__n") == 1, "OK").otherwise(F.concat(F.lit("AMBIGUOUS("), F.col("__n"), F.lit(")")))
    return names.join(n, column, "left").withColumn("status", status).drop("__n")


def venues(alias: DataFrame, journal: DataFrame) -> DataFrame:
    """(name, identities, canonical, venues) of every listed name."""
    both = alias.filter(F.col("name_norm").isNotNull()).select(F.col("name_norm").alias("name"), "identity").distinct().join(journal.select("identity", "display_name", "venue_id").distinct(), "identity")
    return both.groupBy("name").agg(F.count_distinct("identity").alias("identities"), F.min("display_name").alias("canonical"), F.array_sort(F.collect_set("venue_id")).alias("venues"))


def patched(rows: DataFrame, patch: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Rows with the columns of a patch, defaults where it has none."""
    return rows.join(patch, key, "left").fillna(defaults)


def doi_verdicts(values: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Adds ``verdict``: unrepairable, archive, real, real_after_cleaning, real_prefix or invented; known has lower-case ``doi``."""
    d = F.lower(column)
    v = values.withColumn("__d", d).withColumn("__cut", F.regexp_replace(d, r"\.[0-9]{1,4}$", ""))
    hit = lambda c, name: known.select(F.col("doi").alias(c), F.lit(True).alias(name))
    heads = prefix_exists(v.select("__d").distinct(), "__d", known, "doi").withColumn("__head", F.lit(True))
    v = v.join(hit("__d", "__real"), "__d", "left").join(hit("__cut", "__clean"), "__cut", "left").join(heads, "__d", "left")
    verdict = F.when(~F.col("__d").rlike(r"^10\.[0-9]{4,9}/\S+$"), "unrepairable").when(F.col("__d").rlike(r"^10\.(?:48550|13140|5281)/"), "archive").when(F.col("__real"), "real").when(F.col("__clean"), "real_after_cleaning").when(F.col("__head"), "real_prefix").otherwise("invented")
    return v.withColumn("verdict", verdict).select(*values.columns, "verdict")


def residual_buckets(rows: DataFrame, oa: DataFrame) -> DataFrame:
    """Adds ``bucket`` to unresolved references."""
    head = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 5), " ")
    titles = oa.select(F.col("title_norm").alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    heads = titles.filter(F.size(F.split("__t", " ")) >= 5).select(head(F.col("__t")).alias("__h")).distinct().withColumn("__begins", F.lit(True))
    r = rows.withColumn("__t", ascii_key(F.col("title"))).withColumn("__h", head(F.col("__t")))
    r = r.join(titles.withColumn("__exact", F.lit(True)), "__t", "left").join(heads, "__h", "left")
    bucket = F.when(~F.col("has_title"), "no_title").when(F.col("nonacademic"), "noncitation").when(F.col("__exact"), "exact_key_present").when(F.size(content_tokens(F.col("title"))) < 4, "too_generic").when(F.col("__begins"), "beginning_present").otherwise("absent")
    return r.withColumn("bucket", bucket).select(*rows.columns, "bucket")


def refined(rows: DataFrame, oa: DataFrame) -> DataFrame:
    """Adds ``verdict`` to candidates: cleared as no article, cleared by a known title with one of its authors, or kept."""
    from refloom.functions.rules import NO_ARTICLE

    works = oa.filter(F.col("title_norm").isNotNull() & F.col("author1").isNotNull()).select(F.col("title_norm").alias("__t"), F.lower("author1").alias("__a")).distinct()
    named = rows.select("cited_id", "authors", ascii_key(F.col("title")).alias("__t")).join(works, "__t").filter(F.contains(F.lower(F.coalesce("authors", F.lit(""))), F.col("__a"))).select("cited_id").distinct().withColumn("__named", F.lit(True))
    r = rows.join(named, "cited_id", "left")
    return r.withColumn("verdict", F.when(F.coalesce(F.col("title"), F.lit("")).rlike(NO_ARTICLE), "cleared_nonarticle").when(F.col("__named"), "cleared_repairmatch").otherwise("keep")).drop("__named")
