"""Queries over the fact table and the indexes, by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import keys, rules, text
from refloom.operators import match, rates, sampling, stats
from refloom.plans import facts as base
from refloom.plans.catalog import AUTHOR_HIJACKS, BOOTSTRAP, query
from refloom.plans.facts import FACTS, RESOLVED
from refloom.session import read

_YEAR = "2000 + substring(month,1,2)::INT"


def _year():
    return rates.citing_year(F.col("month")).alias("year")


def _rate(bad, total, name="rate"):
    return rates.rate(bad, total).alias(name)


# Rates.


@query(f"WITH {AUTHOR_HIJACKS} SELECT {_YEAR} AS year, count(*) AS linked, count(author_hijack) AS judged, count_if(author_hijack) AS flagged, round(count_if(author_hijack) / nullif(count(author_hijack),0), 6) AS rate FROM ah GROUP BY 1")
def hijacks_by_year(spark, sf):
    """Of references linked by title those that can be judged and those whose authors are others."""
    from refloom.plans.catalog import author_hijacks

    h = author_hijacks(spark, sf).join(base.keyed(spark, sf).select("cited_id", "month"), "cited_id")
    return h.groupBy(_year()).agg(F.count("*").alias("linked"), F.count("author_hijack").alias("judged"), F.count_if("author_hijack").alias("flagged"), _rate(F.count_if("author_hijack"), F.count("author_hijack")))


@query(f"WITH {FACTS} SELECT {_YEAR} AS year, count(*) AS total, count_if(NOT found AND reason = 'fab_candidate') AS candidates, round(count_if(NOT found AND reason = 'fab_candidate') / count(*), 6) AS rate FROM facts WHERE NOT nonacademic GROUP BY 1")
def candidate_rate_by_year(spark, sf):
    """A7."""
    return rates.candidate_rate(base.facts(spark, sf), [_year()])


@query(
    f"WITH {FACTS}, s AS (SELECT {_YEAR} AS year, * FROM facts WHERE NOT nonacademic AND y IS NOT NULL) SELECT year, coalesce(count_if(y <= year - 2),0) AS lagged, coalesce(count_if(y <= year - 2 AND NOT found),0) AS lagged_bad, coalesce(count_if(y > year - 2),0) AS recent, coalesce(count_if(y > year - 2 AND NOT found),0) AS recent_bad, count_if(has_title AND y <= year - 2 AND NOT found AND reason = 'fab_candidate') AS candidates, count_if(has_doi AND y <= year - 2) AS with_doi FROM s GROUP BY 1"
)
def lag_controlled_rates(spark, sf):
    """References to works at least two years old, which an index has had time to take in."""
    return rates.lag_controlled(base.facts(spark, sf))


@query(f"WITH {FACTS}, s AS (SELECT {_YEAR} AS year, coalesce(p.src,'none') AS field, found FROM facts f JOIN (SELECT id, min(tei_source) AS src FROM papers GROUP BY 1) p ON p.id = f.paper WHERE NOT nonacademic) SELECT field, count_if(year < 2018) AS pre_total, count_if(year >= 2018) AS post_total, round(count_if(year < 2018 AND NOT found) / nullif(count_if(year < 2018),0), 6) AS pre, round(count_if(year >= 2018 AND NOT found) / nullif(count_if(year >= 2018),0), 6) AS post FROM s GROUP BY 1 HAVING count_if(year < 2018) > 50 AND count_if(year >= 2018) > 50")
def source_pre_post(spark, sf):
    """By what the paper was read from, before and after 2018; groups with few references on either side left out."""
    p = read(spark, sf, "papers").groupBy(F.col("id").alias("paper")).agg(F.coalesce(F.min("tei_source"), F.lit("none")).alias("field"))
    return rates.pre_post(base.facts(spark, sf).join(p, "paper"), "field", 2018, least=50)


@query(f"WITH {FACTS} SELECT {_YEAR} AS year, count(*) AS total, count_if(has_doi OR has_title) AS cleaned, round(count_if(NOT found) / count(*), 6) AS rate, round(count_if((has_doi OR has_title) AND NOT found) / nullif(count_if(has_doi OR has_title),0), 6) AS cleaned_rate FROM facts WHERE NOT nonacademic GROUP BY 1")
def cleaned_rates(spark, sf):
    """Rates over all academic references and over those that have something to be found by."""
    a = base.facts(spark, sf).filter(~F.col("nonacademic"))
    usable = F.col("has_doi") | F.col("has_title")
    return a.groupBy(_year()).agg(F.count("*").alias("total"), F.count_if(usable).alias("cleaned"), _rate(F.count_if(~F.col("found")), F.count("*")), _rate(F.count_if(usable & ~F.col("found")), F.count_if(usable), "cleaned_rate"))


@query(
    f"WITH {FACTS}, p AS (SELECT paper, month, {_YEAR} AS year, count(*) AS total, count_if(NOT found) AS bad FROM facts GROUP BY 1,2), t AS (SELECT CASE WHEN total < 5 THEN 'small' WHEN total < 50 THEN 'medium' ELSE 'large' END AS tier, sum(CASE WHEN year < 2018 THEN bad END)/sum(CASE WHEN year < 2018 THEN total END) AS pre, sum(CASE WHEN year >= 2018 THEN bad END)/sum(CASE WHEN year >= 2018 THEN total END) AS post FROM p GROUP BY 1) SELECT tier, round(pre,6) AS pre, round(post,6) AS post, CASE WHEN post > pre THEN 'up' WHEN post < pre THEN 'down' ELSE 'flat' END AS direction FROM t"
)
def tier_pre_post(spark, sf):
    """By the size of the paper's bibliography."""
    p = rates.per_paper(base.facts(spark, sf)).withColumn("year", rates.citing_year(F.col("month")))
    tier = F.when(F.col("total") < 5, "small").when(F.col("total") < 50, "medium").otherwise("large")
    side = lambda c, v: F.sum(F.when(c, F.col(v)))
    pre, post = ((side(c, "not_found") / side(c, "total")) for c in (F.col("year") < 2018, F.col("year") >= 2018))
    t = p.groupBy(tier.alias("tier")).agg(pre.alias("pre"), post.alias("post"))
    return t.select("tier", F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"), F.when(F.col("post") > F.col("pre"), "up").when(F.col("post") < F.col("pre"), "down").otherwise("flat").alias("direction"))


@query(f"WITH {FACTS}, p AS (SELECT {_YEAR} AS year, count_if(NOT found) / count(*) AS r FROM facts GROUP BY month, paper) SELECT year, count(*) AS papers, round(quantile_cont(r,0.5),6) AS median, round(quantile_cont(r,0.9),6) AS p90 FROM p GROUP BY 1")
def paper_rate_medians(spark, sf):
    """Medians of the papers' rates."""
    p = rates.per_paper(base.facts(spark, sf)).select(_year(), (F.col("not_found") / F.col("total")).alias("r"))
    return p.groupBy("year").agg(F.count("*").alias("papers"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("r", F.lit(0.9)), 6).alias("p90"))


@query(f"WITH {FACTS}, c AS (SELECT {_YEAR} AS year, count(*)::DOUBLE AS n, count_if(NOT found AND reason = 'fab_candidate')::DOUBLE AS k FROM facts WHERE NOT nonacademic AND month IS NOT NULL GROUP BY 1) SELECT count(*) AS points, round(regr_slope(k/n, year),6) AS slope, round(sum(CASE WHEN year < 2018 THEN k END)/sum(CASE WHEN year < 2018 THEN n END),6) AS pre, round(sum(CASE WHEN year >= 2018 THEN k END)/sum(CASE WHEN year >= 2018 THEN n END),6) AS post FROM c")
def candidate_trend(spark, sf):
    """A21."""
    c = rates.candidate_rate(base.facts(spark, sf).filter(F.col("month").isNotNull()), [_year()]).withColumn("r", F.col("candidates") / F.col("total"))
    side = lambda c_, v: F.sum(F.when(c_, F.col(v)))
    early, late = F.col("year") < 2018, F.col("year") >= 2018
    return c.agg(F.count("*").alias("points"), F.round(F.regr_slope("r", "year"), 6).alias("slope"), F.round(side(early, "candidates") / side(early, "total"), 6).alias("pre"), F.round(side(late, "candidates") / side(late, "total"), 6).alias("post"))


@query()
def fuzzy_rescue_by_year(spark, sf):
    """Of references that exact keys leave unresolved, those that no similar title resolves either."""
    from refloom.plans.catalog import similar_titles

    f = base.facts(spark, sf).filter(~F.col("found") & F.col("title_key").isNotNull()).select("cited_id", "month", "title_key")
    hits = similar_titles(spark, sf, f.select("cited_id", F.col("title_key").alias("title"))).select("cited_id", F.lit(1).alias("hit"))
    return f.join(hits, "cited_id", "left").groupBy(_year()).agg(F.count("*").alias("exact_failed"), F.count_if(F.col("hit").isNull()).alias("fuzzy_failed"), _rate(F.count_if(F.col("hit").isNull()), F.count("*"), "share"))


@query(f"WITH {FACTS}, e AS (SELECT CASE WHEN {_YEAR} < 2020 THEN 'control' ELSE 'late' END AS era, count(*)::DOUBLE AS n, count_if(NOT found AND reason = 'fab_candidate')::DOUBLE AS k FROM facts WHERE NOT nonacademic AND month IS NOT NULL GROUP BY 1) SELECT era, k::BIGINT AS k, n::BIGINT AS n, round((k/n + 3.8416/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n), 6) AS low, round((k/n + 3.8416/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n), 6) AS high FROM e")
def candidate_eras(spark, sf):
    """The rate of candidates before 2020 and since, with its interval."""
    era = F.when(rates.citing_year(F.col("month")) < 2020, "control").otherwise("late").alias("era")
    e = rates.candidate_rate(base.facts(spark, sf).filter(F.col("month").isNotNull()), [era]).select("era", F.col("candidates").alias("k"), F.col("total").alias("n"))
    low, high = stats.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return e.select("era", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"WITH {BOOTSTRAP}, tt AS (SELECT year, sum(bad)::DOUBLE AS bad, sum(total)::DOUBLE AS total FROM pp GROUP BY 1), d AS (SELECT se*se / nullif(bad/total*(1-bad/total)/total, 0) AS deff FROM boot JOIN tt USING (year)) SELECT count(*) AS groups, round(quantile_cont(deff,0.5),3) AS median_deff FROM d WHERE deff IS NOT NULL")
def design_effects(spark, sf):
    """M2."""
    from refloom.plans.catalog import bootstrap_by_year

    t = base.facts(spark, sf).groupBy(_year()).agg(F.count_if(~F.col("found")).cast("double").alias("bad"), F.count("*").cast("double").alias("total"))
    return stats.design_effect(bootstrap_by_year(spark, sf), t, "year")


_SERIES = f"SELECT {_YEAR} + (substring(month,3,2)::INT - 0.5)::DOUBLE/12 - 2018.0 AS x, avg((NOT found)::INT) AS y, count(*)::DOUBLE AS w FROM facts WHERE month IS NOT NULL GROUP BY month"
_SHAPES = "SELECT 'flat' AS form, 0.0::DOUBLE AS k UNION ALL SELECT 'linear', 0.0 UNION ALL SELECT 'exp', unnest([" + ",".join(map(str, stats.RATES)) + "])::DOUBLE"


@query(
    f"""WITH {FACTS}, c0 AS ({_SERIES}), c AS (SELECT *, min(x) OVER () AS x0 FROM c0), s AS (SELECT form, k, x, y, w, CASE form WHEN 'flat' THEN 0.0 WHEN 'linear' THEN x ELSE exp(-k*(x-x0)) END AS z, CASE form WHEN 'flat' THEN w ELSE w*w END AS v FROM c, ({_SHAPES}) f),
    m AS (SELECT form, k, sum(v) AS s0, sum(v*z) AS sz, sum(v*y) AS sy, sum(v*z*z) AS szz, sum(v*z*y) AS szy FROM s WHERE x < 0 GROUP BY 1,2), b AS (SELECT *, CASE form WHEN 'flat' THEN 0.0 ELSE (s0*szy-sz*sy)/nullif(s0*szz-sz*sz,0) END AS slope FROM m),
    e AS (SELECT s.form, s.k, sum(CASE WHEN x < 0 THEN w*pow(y-(sy-slope*sz)/s0-slope*z,2) END) AS sse, sum(CASE WHEN x >= 0 THEN w*(y-(sy-slope*sz)/s0-slope*z) END)/sum(CASE WHEN x >= 0 THEN w END) AS over FROM s JOIN b ON b.form = s.form AND b.k = s.k GROUP BY 1,2),
    r AS (SELECT form, arg_min(k, sse) AS k, arg_min(over, sse) AS over FROM e GROUP BY 1), o AS (SELECT max(CASE WHEN form='flat' THEN over END) AS f, max(CASE WHEN form='linear' THEN over END) AS l, max(CASE WHEN form='exp' THEN over END) AS e, max(CASE WHEN form='exp' THEN k END) AS rate FROM r)
    SELECT round(f,6) AS over_flat, round(l,6) AS over_linear, round(e,6) AS over_exp, rate, CASE WHEN sign(f) = sign(l) AND sign(l) = sign(e) THEN 'same sign' ELSE 'sign flips' END AS verdict FROM o"""
)
def excess_by_form(spark, sf):
    """M7 whole: flat, linear and exponential baselines and their verdict."""
    c = base.facts(spark, sf).filter(F.col("month").isNotNull()).groupBy("month").agg(F.avg((~F.col("found")).cast("int")).alias("r"), F.count("*").alias("n")).withColumn("t", rates.decimal_year(F.col("month")))
    return stats.excess_forms(c, "t", "r", "n", 2018.0)


@query(f"WITH {FACTS}, d AS (SELECT cited_id, month, row_number() OVER (PARTITION BY month ORDER BY substring(md5('7:' || cited_id),1,16), cited_id) AS k FROM facts), s AS (SELECT {_YEAR.replace('month', 'd.month')} AS year, count_if(NOT found) AS k, count(*) AS n FROM d JOIN facts USING (cited_id) WHERE k <= 10 GROUP BY 1), p AS (SELECT {_YEAR} AS year, count(*) AS population FROM facts GROUP BY 1) SELECT p.year, k, n, population, round(population * k / n)::BIGINT AS estimate FROM p JOIN s ON p.year IS NOT DISTINCT FROM s.year")
def extrapolated_by_year(spark, sf):
    """Ten references a month carried on to all."""
    f = base.facts(spark, sf)
    s = sampling.nested_sample(f.select("month", "cited_id", "found"), ["month"], "cited_id", 10, seed=7).groupBy(_year()).agg(F.count_if(~F.col("found")).alias("k"), F.count("*").alias("n")).withColumnRenamed("year", "__y")
    p = f.groupBy(_year()).agg(F.count("*").alias("population"))
    return p.join(s, F.col("year").eqNullSafe(F.col("__y"))).select("year", "k", "n", "population", stats.extrapolated(F.col("k"), F.col("n"), F.col("population")).alias("estimate"))


# Compositions and funnels.

_COMPOSED = rf"""CASE WHEN {base._has(rules.URL)} AND NOT {base._has(rules.OWN_URL)} THEN 'web' WHEN {base._has(rules.PATENT)} THEN 'patent' WHEN {base._has(rules.REPORT)} THEN 'techreport' WHEN {base._has(rules.THESIS)} THEN 'thesis' WHEN {base._has(rules.STANDARD)} THEN 'standard'
  WHEN {base._has(rules.PUBLISHER)} OR {base._has(rules.BOOKISH)} THEN 'book' WHEN {base._has('(?i)arxiv[:\\s]')} AND {base._T} = '' THEN 'arxiv_id_only' WHEN {base._T} = '' AND coalesce(journal,'') <> '' THEN 'titleless_journal' WHEN {base._T} = '' THEN 'no_title_parsed' WHEN length({base._T}) < 15 THEN 'parse_damage' ELSE 'article_like' END"""


@query(f"WITH {FACTS}, c AS (SELECT {_YEAR} AS year, {_COMPOSED} AS kind FROM facts WHERE NOT found AND month IS NOT NULL), n AS (SELECT year, kind, count(*) AS n FROM c GROUP BY 1,2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS share FROM n), e AS (SELECT min(year) AS a, max(year) AS b FROM n) SELECT kind, sum(n)::BIGINT AS n, round(coalesce(sum(CASE WHEN year = b THEN share END),0) - coalesce(sum(CASE WHEN year = a THEN share END),0), 6) AS shift FROM s, e GROUP BY 1")
def composition_shift(spark, sf):
    """What unresolved references are made of, and how the shares shift from the first year to the last."""
    raw = base.references(spark, sf).select("cited_id", "citation")
    f = base.facts(spark, sf).filter(~F.col("found") & F.col("month").isNotNull()).join(raw, "cited_id")
    return rates.shifted_shares(f.select(_year(), rules.composition(F.col("citation"), F.col("title"), F.col("journal")).alias("kind")), "year", "kind")


@query(f"WITH {FACTS} SELECT count(*) AS refs, count_if(found) AS found, count_if(method = 'oa_meta') AS by_metadata, count_if(method = 'oa_meta' AND has_title) AS with_title, count_if(method = 'oa_meta' AND len({base.content_sql('title')}) >= 4) AS long_title, count_if(method = 'oa_meta' AND len({base.content_sql('title')}) >= 4 AND lower(trim(title)) IS DISTINCT FROM lower(trim(journal))) AS eligible FROM facts")
def title_check_funnel(spark, sf):
    """How many references are left at each step before their title can be checked."""
    f, long = base.facts(spark, sf), F.size(keys.content_tokens(F.col("title"))) >= 4
    meta = F.coalesce(F.col("method") == "oa_meta", F.lit(False))
    own = ~F.lower(F.trim("title")).eqNullSafe(F.lower(F.trim("journal")))
    return f.agg(F.count("*").alias("refs"), F.count_if("found").alias("found"), F.count_if(meta).alias("by_metadata"), F.count_if(meta & F.col("has_title")).alias("with_title"), F.count_if(meta & long).alias("long_title"), F.count_if(meta & long & own).alias("eligible"))


@query(
    f"""WITH {RESOLVED}, h AS (SELECT cited_id, count(DISTINCT oa_id) AS plain, count(DISTINCT CASE WHEN p = page THEN oa_id END) AS page, count(DISTINCT CASE WHEN s = sur THEN oa_id END) AS author FROM jo GROUP BY 1),
    f AS (SELECT unnest(['plain','page','author']) AS filter, unnest([plain, page, author]) AS hits FROM h) SELECT filter, count(*) AS refs, count_if(hits = 1) AS one, count_if(hits = 0) AS none, count_if(hits > 1) AS several, quantile_cont(hits,0.5) AS median_hits FROM f GROUP BY 1"""
)
def filter_acceptance(spark, sf):
    """How many references exactly one work is left of, with no filter, with the page's and with the author's."""
    return match.filter_acceptance(base.keyed(spark, sf), read(spark, sf, "oa"))


@query("SELECT count(*) AS rows, count(DISTINCT oa_id) AS works, count(DISTINCT doi) AS dois, count(DISTINCT journal_norm) AS journals, count(DISTINCT title_norm) AS titles FROM oa")
def distinct_sets(spark, sf):
    """A26."""
    d = F.count_distinct
    return read(spark, sf, "oa").agg(F.count("*").alias("rows"), d("oa_id").alias("works"), d("doi").alias("dois"), d("journal_norm").alias("journals"), d("title_norm").alias("titles"))


# Authorities.


@query(f"WITH {base.REFS}, k AS (SELECT journal_key, count(*) AS refs FROM refs WHERE journal_key IS NOT NULL GROUP BY 1), a AS (SELECT name_norm, count(DISTINCT identity) AS n FROM alias WHERE name_norm IS NOT NULL GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'ABSENT' WHEN n = 1 THEN 'OK' ELSE 'AMBIGUOUS(' || n || ')' END AS status, count(*) AS names, sum(refs)::BIGINT AS refs, count_if(starts_with(journal_key,'journal of ')) AS with_prefix FROM k LEFT JOIN a ON a.name_norm = k.journal_key GROUP BY 1")
def authority_status(spark, sf):
    """Names of journals as the authority knows them, and how many begin alike."""
    k = base.keyed(spark, sf).filter(F.col("journal_key").isNotNull()).groupBy("journal_key").agg(F.count("*").alias("refs"))
    return match.authority_status(k, "journal_key", read(spark, sf, "alias")).groupBy("status").agg(F.count("*").alias("names"), F.sum("refs").alias("refs"), F.count_if(F.startswith("journal_key", F.lit("journal of "))).alias("with_prefix"))


@query(
    f"""WITH {base.REFS}, {base.IDENTITY}, v AS (SELECT DISTINCT name_norm, identity FROM alias WHERE name_norm IS NOT NULL), r AS (SELECT count(*) AS variants, count_if(al.n = 1) AS resolved, count_if(al.n = 1 AND al.identity = v.identity) AS correct FROM v JOIN al USING (name_norm)),
    c AS (SELECT count(journal_key) AS refs, count_if({base._ID} IS NOT NULL) AS covered FROM refs r LEFT JOIN al ON al.name_norm = r.journal_key LEFT JOIN ac ON ac.acr = replace(r.journal_key,' ','')) SELECT variants, resolved, correct, refs, covered, round(covered / refs, 6) AS coverage FROM r, c"""
)
def authority_validation(spark, sf):
    """Of the listed names those that resolve and resolve rightly, and the share of references that are covered."""
    alias, acronym = read(spark, sf, "alias"), read(spark, sf, "acronym")
    v = alias.filter(F.col("name_norm").isNotNull()).distinct().select(F.col("name_norm"), "identity")
    known = match.unique_identities(alias).select(F.col("name").alias("name_norm"), F.col("identity").alias("found"))
    r = v.join(known, "name_norm", "left").agg(F.count("*").alias("variants"), F.count("found").alias("resolved"), F.count_if(F.col("found") == F.col("identity")).alias("correct"))
    c = match.resolve_journals(base.keyed(spark, sf), "journal", alias, acronym).agg(F.count("journal_key").alias("refs"), F.count("identity").alias("covered"))
    return r.join(F.broadcast(c)).withColumn("coverage", rates.rate(F.col("covered"), F.col("refs")))  # one row each


@query("WITH a AS (SELECT DISTINCT name_norm, identity FROM alias WHERE name_norm IS NOT NULL) SELECT name_norm AS name, count(DISTINCT a.identity) AS identities, min(display_name) AS canonical, list_aggregate(list_sort(list(DISTINCT venue_id)),'string_agg',',') AS venues FROM a JOIN journal j ON j.identity = a.identity GROUP BY 1")
def venues_of_names(spark, sf):
    """Of every listed name its canonical form and its venues, those of all identities where there are several."""
    return match.venues(read(spark, sf, "alias"), read(spark, sf, "journal")).withColumn("venues", F.array_join("venues", ","))


# Lookups.


@query("SELECT doi, count(DISTINCT oa_id) AS n, list_aggregate(list_sort(list(DISTINCT oa_id)),'string_agg',',') AS works FROM oa WHERE doi IS NOT NULL GROUP BY 1")
def records_of_dois(spark, sf):
    """All works of a DOI."""
    return read(spark, sf, "oa").filter(F.col("doi").isNotNull()).groupBy("doi").agg(F.array_sort(F.collect_set("oa_id")).alias("w")).select("doi", F.size("w").alias("n"), F.array_join("w", ",").alias("works"))


@query(
    f"""WITH {RESOLVED}, ty AS (SELECT r.cited_id, min(w.oa_id) AS matched FROM refs r JOIN oa w ON r.title_key = w.title_norm AND r.y = w.year GROUP BY 1),
    h AS (SELECT cited_id, 1 AS k, 'title_year' AS method, matched FROM ty UNION ALL SELECT cited_id, 2, 'title', oa_id FROM jt WHERE rn = 1 UNION ALL SELECT cited_id, 3, 'variant', oa_id FROM jr WHERE rn = 1)
    SELECT cited_id, arg_min(method, k) AS method, arg_min(matched, k) AS matched FROM h GROUP BY 1"""
)
def by_citation(spark, sf):
    """DOI, then title with year, then title, then its variants."""
    return match.by_citation(base.keyed(spark, sf), read(spark, sf, "oa"))


@query(
    f"""WITH {base.REFS}, {base.IDENTITY}, w AS (SELECT DISTINCT oa_id, al.identity, year, {base.volume_key_sql('volume')} AS vol, regexp_replace({base.page_key_sql('first_page')},'\\(r\\)$','') AS p FROM oa JOIN al ON al.name_norm = oa.journal_norm AND al.n = 1),
    b AS (SELECT r.cited_id, w.oa_id, w.p = r.page AS paged FROM (SELECT r.*, {base._ID} AS identity FROM refs r LEFT JOIN al ON al.name_norm = r.journal_key LEFT JOIN ac ON ac.acr = replace(r.journal_key,' ','')) r JOIN w ON w.identity = r.identity AND w.vol = r.vol AND w.year BETWEEN r.y - 1 AND r.y + 1)
    SELECT cited_id, CASE WHEN count(DISTINCT CASE WHEN paged THEN oa_id END) = 1 THEN min(CASE WHEN paged THEN oa_id END) ELSE min(oa_id) END AS matched FROM b GROUP BY 1 HAVING count(DISTINCT CASE WHEN paged THEN oa_id END) = 1 OR count(DISTINCT oa_id) = 1"""
)
def by_venue(spark, sf):
    """J6s: by the journal's identity, the volume and the year, one off at most."""
    refs = match.resolve_journals(base.keyed(spark, sf), "journal", read(spark, sf, "alias"), read(spark, sf, "acronym"))
    return match.by_venue(refs, read(spark, sf, "oa"), match.unique_identities(read(spark, sf, "alias")))


@query(f"WITH {base.REFS}, c AS (SELECT paper, count(*) AS counted FROM refs GROUP BY 1), p AS (SELECT id, max(refs) AS swept FROM papers GROUP BY 1) SELECT id AS paper, coalesce(swept,0) AS swept, coalesce(counted,0) AS counted, coalesce(swept,0) - coalesce(counted,0) AS drift FROM p LEFT JOIN c ON c.paper = p.id WHERE id IS NOT NULL")
def patched_papers(spark, sf):
    """Counts as swept, patched with those of the references that are here; zero where there is none."""
    p = read(spark, sf, "papers").filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("paper")).agg(F.max("refs").alias("swept"))
    c = base.keyed(spark, sf).groupBy("paper").agg(F.count("*").alias("counted"))
    return match.patched(p, c, "paper", {"counted": 0}).select("paper", F.coalesce("swept", F.lit(0)).alias("swept"), "counted", (F.coalesce("swept", F.lit(0)) - F.col("counted")).alias("drift"))


@query("WITH d AS (SELECT DISTINCT journal_norm, year, oa_id FROM oa WHERE doi IS NOT NULL AND doi NOT IN (SELECT doi FROM biblio WHERE doi IS NOT NULL)) SELECT journal_norm, year, oa_id FROM (SELECT *, row_number() OVER (PARTITION BY journal_norm, year ORDER BY substring(md5('9:' || oa_id),1,16), oa_id) AS k FROM d) WHERE k <= 2")
def sample_by_journal_year(spark, sf):
    """Two works of each journal and year that the bibliographic index hasn't."""
    works = read(spark, sf, "oa").filter(F.col("doi").isNotNull()).join(read(spark, sf, "biblio").select("doi"), "doi", "left_anti")
    return sampling.nested_sample(works.select("journal_norm", "year", "oa_id").distinct(), ["journal_norm", "year"], "oa_id", 2, seed=9)


@query("SELECT oa_id, title_norm FROM (SELECT DISTINCT oa_id, title_norm FROM oa WHERE year >= 2010) ORDER BY substring(md5('3:' || oa_id),1,16), oa_id, title_norm LIMIT 100")
def matched_sample(spark, sf):
    """A hundred works of those that fit, drawn by seed."""
    return sampling.seeded_take(read(spark, sf, "oa").filter("year >= 2010").select("oa_id", "title_norm").distinct(), "oa_id", 100, seed=3)


# Classifiers.


@query(
    """WITH b AS (SELECT DISTINCT doi FROM biblio WHERE doi IS NOT NULL), p AS (SELECT doi || '.183' AS raw FROM b UNION ALL SELECT '10.99999/none.' || substring(md5(doi),1,8) FROM b UNION ALL SELECT '10.48550/arxiv.2101.' || substring(doi,length(doi)-4) FROM b UNION ALL SELECT 'see ' || doi FROM b UNION ALL SELECT doi FROM b UNION ALL SELECT substring(doi,1,length(doi)-1) FROM b),
    c AS (SELECT DISTINCT raw, lower(raw) AS d FROM p), k AS (SELECT DISTINCT lower(doi) AS doi FROM oa WHERE doi IS NOT NULL UNION SELECT lower(doi) FROM biblio WHERE doi IS NOT NULL),
    v AS (SELECT raw, d, regexp_replace(d,'\\.[0-9]{1,4}$','') AS cut FROM c)
    SELECT CASE WHEN NOT regexp_matches(d,'^10\\.[0-9]{4,9}/\\S+$') THEN 'unrepairable' WHEN regexp_matches(d,'^10\\.(48550|13140|5281)/') THEN 'archive' WHEN d IN (SELECT doi FROM k) THEN 'real' WHEN cut IN (SELECT doi FROM k) THEN 'real_after_cleaning'
      WHEN length(d) >= 14 AND EXISTS (SELECT 1 FROM k WHERE starts_with(k.doi, v.d)) THEN 'real_prefix' ELSE 'invented' END AS verdict, count(*) AS n FROM v GROUP BY 1"""
)
def doi_verdicts(spark, sf):
    """Planted identifiers (real, damaged, cut off, invented, of an archive) told apart."""
    from refloom.operators.inject import planted_dois

    b, o = (read(spark, sf, t).select("doi").filter(F.col("doi").isNotNull()) for t in ("biblio", "oa"))
    planted = planted_dois(b.distinct(), "doi")
    return match.doi_verdicts(planted, "raw", b.unionByName(o).select(F.lower("doi").alias("doi")).distinct()).groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FACTS}, c AS (SELECT cited_id, list_filter([CASE WHEN {base._T} = '' THEN 'no_title' END, CASE WHEN regexp_matches({base._T},'^[0-9]{{4}}[a-z]?$') THEN 'title_is_year' END, CASE WHEN {base._T} <> '' AND lower({base._T}) = lower(trim(coalesce(journal,''))) THEN 'title_is_journal' END, CASE WHEN length({base._T}) BETWEEN 1 AND 9 THEN 'short_title' END, CASE WHEN y IS NULL AND trim(coalesce(year,'')) <> '' THEN 'bad_year' END, CASE WHEN regexp_matches(coalesce(authors,''),'[0-9@]') THEN 'bad_author' END, CASE WHEN regexp_matches(coalesce(title,''),'[{{}}<>]') THEN 'noise' END], lambda x: x IS NOT NULL) AS flaws FROM refs) SELECT flaw, count(*) AS n FROM (SELECT unnest(flaws) AS flaw FROM c) GROUP BY 1"""
)
def parse_audit(spark, sf):
    """What went wrong in parsing, counted."""
    c = F.col
    flaws = rules.parse_flaws(c("title"), c("journal"), c("year"), c("y"), c("authors"))
    return base.references(spark, sf).select(F.explode(flaws).alias("flaw")).groupBy("flaw").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FACTS}, loose AS (SELECT DISTINCT title_norm FROM oa WHERE title_norm IS NOT NULL), short AS (SELECT DISTINCT array_to_string(string_split(title_norm,' ')[1:5],' ') AS head FROM loose WHERE len(string_split(title_norm,' ')) >= 5)
    SELECT CASE WHEN NOT has_title THEN 'no_title' WHEN nonacademic THEN 'noncitation' WHEN {base.ascii_key_sql('title')} IN (SELECT title_norm FROM loose) THEN 'exact_key_present' WHEN len({base.content_sql('title')}) < 4 THEN 'too_generic' WHEN array_to_string(string_split({base.ascii_key_sql('title')},' ')[1:5],' ') IN (SELECT head FROM short) THEN 'beginning_present' ELSE 'absent' END AS bucket, nonacademic, count(*) AS n FROM facts WHERE NOT found GROUP BY 1,2"""
)
def residual_buckets(spark, sf):
    """Why references are left over: no title, no citation, key present, too generic, beginning present, absent."""
    return match.residual_buckets(base.facts(spark, sf).filter(~F.col("found")), read(spark, sf, "oa")).groupBy("bucket", "nonacademic").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FACTS}, a AS (SELECT DISTINCT title_norm, lower(author1) AS au FROM oa WHERE title_norm IS NOT NULL), ok AS (SELECT DISTINCT f.cited_id FROM facts f JOIN refs r USING (cited_id) JOIN a ON a.title_norm = {base.ascii_key_sql('f.title')} AND contains(lower(coalesce(r.authors,'')), a.au))
    SELECT cited_id, CASE WHEN {base._has(rules.NO_ARTICLE, 'title')} THEN 'cleared_nonarticle' WHEN cited_id IN (SELECT cited_id FROM ok) THEN 'cleared_repairmatch' ELSE 'keep' END AS verdict FROM facts WHERE NOT found AND reason IN ('fab_candidate','short_title')"""
)
def refined_candidates(spark, sf):
    """Candidates cleared where they are no articles, or where a title with one of its authors is known."""
    f = base.facts(spark, sf).filter(~F.col("found") & F.col("reason").isin("fab_candidate", "short_title")).join(base.references(spark, sf).select("cited_id", "authors"), "cited_id")
    return match.refined(f, read(spark, sf, "oa")).select("cited_id", "verdict")


@query(f"WITH {FACTS}, m AS (SELECT DISTINCT paper FROM cited_sent WHERE _is_fake) SELECT f.paper, count(*) AS refs, count_if(NOT found) AS not_found FROM facts f WHERE f.paper IN (SELECT paper FROM m) GROUP BY 1")
def contaminated_papers(spark, sf):
    """C14: papers with an invented entry, and all their references."""
    m = read(spark, sf, "cited_sent").filter("_is_fake").select("paper").distinct()
    return base.facts(spark, sf).join(m, "paper", "left_semi").groupBy("paper").agg(F.count("*").alias("refs"), F.count_if(~F.col("found")).alias("not_found"))



@query(f"WITH {FACTS} SELECT reason, {' '.join(['CASE', *[f'WHEN reason = {base._p(k)} THEN {base._p(v)}' for k, v in rules.REASON_LABELS.items()], 'END'])} AS label, count(*) AS n FROM facts WHERE reason IS NOT NULL GROUP BY 1,2")
def reason_labels(spark, sf):
    """C17: reasons under the codes that labellers use."""
    return base.facts(spark, sf).filter(F.col("reason").isNotNull()).groupBy("reason", rules.label_of(F.col("reason")).alias("label")).agg(F.count("*").alias("n"))


# Text.


@query(f"WITH t AS (SELECT DISTINCT arxiv_id, title FROM arxiv WHERE title IS NOT NULL), p AS (SELECT arxiv_id, 'The Tide Collaboration: ' || title AS title FROM t UNION ALL SELECT arxiv_id, 'Smith, J. et al. ' || title FROM t UNION ALL SELECT arxiv_id, replace(title,'fi','ﬁ') FROM t UNION ALL SELECT arxiv_id, replace(title,'β','Beta') FROM t) SELECT DISTINCT arxiv_id, {base.ligatures_sql('title')} AS ligatures, {base.no_author_sql('title')} AS no_author, {base.greek_sql('title')} AS greek FROM p")
def repaired_titles(spark, sf):
    """F5, F7, F8 on planted damage."""
    t = read(spark, sf, "arxiv").select("arxiv_id", "title").filter(F.col("title").isNotNull()).distinct()
    c = F.col("title")
    damaged = F.array(F.concat(F.lit("The Tide Collaboration: "), c), F.concat(F.lit("Smith, J. et al. "), c), F.replace(c, F.lit("fi"), F.lit("ﬁ")), F.replace(c, F.lit("β"), F.lit("Beta")))
    return t.select("arxiv_id", F.explode(damaged).alias("t")).select("arxiv_id", text.written_ligatures(F.col("t")).alias("ligatures"), text.without_leading_author(F.col("t")).alias("no_author"), text.greek_symbols(F.col("t")).alias("greek")).distinct()


@query(
    r"""WITH t AS (SELECT DISTINCT cited_id, title, authors, journal, year, volume, pages FROM cited_sent), p AS (SELECT *, CASE WHEN coalesce(authors,'') <> '' THEN authors || ' ' ELSE '' END || CASE WHEN coalesce(year,'') <> '' THEN '(' || year || '). ' ELSE '' END || CASE WHEN coalesce(title,'') <> '' THEN title || '. ' ELSE '' END || coalesce(journal,'') || CASE WHEN coalesce(volume,'') <> '' THEN ', ' || volume ELSE '' END || CASE WHEN coalesce(pages,'') <> '' THEN ', ' || pages ELSE '' END || '.' AS apa FROM t)
    SELECT DISTINCT cited_id, apa, nullif(substring(apa,1,80),'') AS head, regexp_replace(apa,'(https?://[^\s]+)','','g') = apa AS plain, CASE WHEN len(list_filter(regexp_split_to_array(trim(title),'\s+'), lambda w: w <> '')) >= 4 AND NOT regexp_matches(title,'\d{4};|\d+\(\d+\):') THEN true WHEN title IS NULL THEN NULL ELSE false END AS like_title FROM p"""
)
def printed_references(spark, sf):
    """F29, F42, F45."""
    c = F.col
    apa = text.formatted(F.lit("apa"), authors=c("authors"), title=c("title"), journal=c("journal"), year=c("year"), volume=c("volume"), pages=c("pages"))
    t = read(spark, sf, "cited_sent").select("cited_id", "title", apa.alias("apa"))
    return t.select("cited_id", "apa", text.shortened(c("apa"), 80).alias("head"), text.url_in(c("apa")).isNull().alias("plain"), text.looks_like_title(c("title")).alias("like_title")).distinct()


@query("SELECT paper, i, title, volume, first_page FROM (SELECT paper, unnest(fakes) AS title, generate_subscripts(fakes,1) AS i FROM (SELECT paper, list_sort(list(DISTINCT title)) AS fakes FROM cited_sent WHERE _is_fake AND title IS NOT NULL GROUP BY 1)) JOIN (SELECT DISTINCT title AS t2, (('0x' || substring(md5('biblio:' || title),1,8))::BIGINT % 90 + 1)::VARCHAR AS volume, (('0x' || substring(md5('biblio:' || title),1,8))::BIGINT % 1500 + 1)::VARCHAR AS first_page FROM cited_sent) ON t2 = title")
def ground_truth_references(spark, sf):
    """The invented titles of each paper as references with details made up from the title."""
    from refloom.operators.inject import references_of_truth

    truth = read(spark, sf, "cited_sent").filter(F.col("_is_fake") & F.col("title").isNotNull()).groupBy("paper").agg(F.array_sort(F.collect_set("title")).alias("fakes"))
    return references_of_truth(truth, "paper", "fakes")


@query(f"WITH m AS (SELECT DISTINCT month FROM cited_sent WHERE month IS NOT NULL), e AS (SELECT min(month) AS a, max(month) AS b FROM m), r AS (SELECT unnest(generate_series(make_date(2000 + substring(a,1,2)::INT, substring(a,3,2)::INT, 1), make_date(2000 + substring(b,1,2)::INT, substring(b,3,2)::INT, 1), INTERVAL 1 MONTH)) AS d FROM e) SELECT strftime(d,'%y%m') AS month, (strftime(d,'%y%m') IN (SELECT month FROM m)) AS present FROM r")
def month_calendar(spark, sf):
    """every month between the first and the last, and whether it has references."""
    m = read(spark, sf, "cited_sent").select("month").filter(F.col("month").isNotNull()).distinct()
    every = rates.months(m.agg(F.min("month").alias("a"), F.max("month").alias("b")), "a", "b")
    return every.join(m.withColumn("present", F.lit(True)), "month", "left").fillna(False, ["present"])
