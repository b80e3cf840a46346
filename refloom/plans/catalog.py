"""Queries of the core, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import keys, rules, similarity, text
from refloom.operators import match, rates, sampling, stats, vector
from refloom.operators.packed import explode_packed
from refloom.plans import facts as base
from refloom.plans.facts import FACTS, RESOLVED
from refloom.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose authors hold two or more names: each name with its position.

    Redelivered rows repeat an entry, so (cited_id, pos) comes out once for each distinct reading of it.
    """
    rows = read(spark, sf, "cited_sent").select("cited_id", "authors").distinct()
    return explode_packed(rows, "authors", "author", "pos", at_least=2).select("cited_id", "pos", "author")


METHODS = ("doi", "biblio_meta", "oa_meta", "title_exact", "title_repaired", "arxiv_title")

# Keys and scalars.


@query(
    f"""SELECT DISTINCT cited_id, {base.ascii_key_sql('title')} AS ascii_key, trim(regexp_replace(lower(title),'[^a-z0-9]+',' ','g')) AS arxiv_key, {base.journal_key_sql('journal')} AS journal_key,
    {base.page_key_sql('pages')} AS page_key, {base.volume_key_sql('volume')} AS volume_key, {base.surname_sql('authors')} AS surname FROM cited_sent"""
)
def keys_of_references(spark, sf):
    """K3-K9."""
    c = F.col
    return read(spark, sf, "cited_sent").select("cited_id", keys.ascii_key(c("title")).alias("ascii_key"), keys.arxiv_key(c("title")).alias("arxiv_key"), keys.journal_key(c("journal")).alias("journal_key"), keys.page_key(c("pages")).alias("page_key"), keys.volume_key(c("volume")).alias("volume_key"), keys.surname(c("authors")).alias("surname")).distinct()


@query("SELECT identity, string_agg(substring(w,1,1),'' ORDER BY k) AS acronym FROM (SELECT identity, unnest(ws) AS w, generate_subscripts(ws,1) AS k FROM (SELECT DISTINCT identity, list_filter(string_split(" + base.journal_key_sql("display_name") + ",' '), lambda x: x <> '' AND x NOT IN (" + ",".join(f"'{w}'" for w in keys.ACRONYM_STOP) + ")) AS ws FROM journal) WHERE len(ws) >= 2) GROUP BY 1")
def acronym_of_journals(spark, sf):
    """K10."""
    return read(spark, sf, "journal").select("identity", keys.acronym(F.col("display_name")).alias("acronym")).filter(F.col("acronym").isNotNull()).distinct()


@query(f"SELECT DISTINCT cited_id, len({base.content_sql('title')}) AS n, list_aggregate({base.content_sql('title')}, 'string_agg', ' ') AS tokens FROM cited_sent WHERE title IS NOT NULL AND len({base.content_sql('title')}) > 0")
def content_tokens_of_titles(spark, sf):
    """K11."""
    t = keys.content_tokens(F.col("title"))
    return read(spark, sf, "cited_sent").filter(F.col("title").isNotNull()).select("cited_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens")).filter("n > 0").distinct()


@query()
def unicode_title_keys(spark, sf):
    """K1; SQL has no compatibility decomposition and no entities, so it is tested on golden rows."""
    return read(spark, sf, "cited_sent").filter(F.col("title").isNotNull()).select("cited_id", keys.unicode_key("title").alias("title_key")).distinct()


@query(
    r"""SELECT DISTINCT cited_id, TRY_CAST(coalesce(list_extract(regexp_extract_all(citation,'\((1[89][0-9]{2}|20[012][0-9])[a-z]?\)',1),-1), list_extract(regexp_extract_all(citation,'\b(1[89][0-9]{2}|20[012][0-9])\b',1),-1)) AS INT) AS year_in,
    nullif(regexp_extract(citation,'(\d+\s?-\s?\d+)',1),'') AS pages_in FROM cited_sent WHERE citation IS NOT NULL"""
)
def years_and_pages_in_citations(spark, sf):
    """F3, F22."""
    return read(spark, sf, "cited_sent").filter(F.col("citation").isNotNull()).select("cited_id", text.year_in(F.col("citation")).alias("year_in"), text.pages_in(F.col("citation")).alias("pages_in")).distinct()


@query(
    r"""SELECT DISTINCT doi, regexp_replace(lower(trim('https://doi.org/' || doi || ').')),'^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)','') AS raw, CASE WHEN doi IS NOT NULL THEN regexp_replace(regexp_extract('see doi:' || doi || '), p. 3','(10\.[0-9]{4,}/[^\s,;)\]>]+)',1),'[.,;)]+$','') END AS found FROM biblio"""
)
def dois_in_text(spark, sf):
    """F2, K6."""
    d = F.col("doi")
    return read(spark, sf, "biblio").select("doi", F.regexp_replace(F.lower(F.trim(F.concat(F.lit("https://doi.org/"), d, F.lit(").")))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "").alias("raw"), text.doi_in(F.concat(F.lit("see doi:"), d, F.lit("), p. 3"))).alias("found")).distinct()


@query(r"SELECT DISTINCT arxiv_id, '10.48550/arxiv.' || arxiv_id AS doi FROM arxiv WHERE regexp_matches(arxiv_id,'^[0-9]{4}\.[0-9]{4,5}$')")
def arxiv_dois(spark, sf):
    """F13."""
    return read(spark, sf, "arxiv").select("arxiv_id", text.arxiv_doi(F.concat(F.lit("arXiv: "), F.col("arxiv_id"), F.lit("v2"))).alias("doi")).filter(F.col("doi").isNotNull()).distinct()


@query(
    r"""WITH d AS (SELECT DISTINCT doi, lower(trim(doi)) || '.183' AS x FROM biblio WHERE doi IS NOT NULL), v AS (SELECT doi, unnest(list_distinct([regexp_replace(x,'\.+$',''), regexp_replace(regexp_replace(x,'\.(?:ac-?cessed|accessed|retrieved|available)\b.*$',''),'\.+$',''), regexp_replace(regexp_replace(x,'^1(10\.[0-9]{4})','\1'),'\.+$',''), regexp_replace(regexp_replace(x,'\.[0-9]{1,4}$',''),'\.+$','')])) AS variant FROM d)
    SELECT DISTINCT v.doi, v.variant FROM v JOIN (SELECT DISTINCT lower(doi) AS doi FROM biblio) b ON b.doi = v.variant WHERE regexp_matches(variant,'^10\.[0-9]{4,9}/')"""
)
def recovered_dois(spark, sf):
    """Damaged identifiers with a variant that the index knows."""
    b = read(spark, sf, "biblio").select("doi").filter(F.col("doi").isNotNull()).distinct()
    damaged = b.select("doi", F.explode(text.doi_variants(F.concat("doi", F.lit(".183")))).alias("variant"))
    return damaged.join(b.select(F.lower("doi").alias("variant")).distinct(), "variant", "left_semi").select("doi", "variant")


@query(r"""SELECT DISTINCT doc_id, len(regexp_extract_all(text,'\[CITATION #b(\d+)\]',1)) AS markers, list_aggregate(regexp_extract_all(text,'\[CITATION #b(\d+)\]',1),'string_agg',',') AS refs FROM documents WHERE contains(text,'[CITATION #b')""")
def citation_markers(spark, sf):
    """F24."""
    m = F.regexp_extract_all("text", F.lit(r"\[CITATION #b(\d+)\]"), F.lit(1))
    return read(spark, sf, "documents").filter(F.col("text").contains("[CITATION #b")).select("doc_id", F.size(m).alias("markers"), F.array_join(m, ",").alias("refs")).distinct()


@query(
    f"""WITH s AS (SELECT DISTINCT cited_id, {base.content_sql('title')} AS a, {base.content_sql('citation')} AS b FROM cited_sent WHERE title IS NOT NULL AND citation IS NOT NULL)
    SELECT cited_id, round(len(list_filter(a, lambda x: list_contains(b, x))) / len(a), 6) AS contained, round(len(list_intersect(a,b)) / len(list_distinct(list_concat(a,b))), 6) AS jaccard FROM s WHERE len(a) > 0"""
)
def title_in_citation(spark, sf):
    """F32, F34."""
    a, b = keys.content_tokens(F.col("title")), keys.content_tokens(F.col("citation"))
    rows = read(spark, sf, "cited_sent").filter(F.col("title").isNotNull() & F.col("citation").isNotNull()).select("cited_id", a.alias("a"), b.alias("b")).distinct()
    return rows.filter(F.size("a") > 0).select("cited_id", F.round(similarity.containment(F.col("a"), F.col("b")), 6).alias("contained"), F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# Resolution.


@query(f"WITH {RESOLVED} SELECT cited_id, method, matched FROM resolved")
def resolved_references(spark, sf):
    """The cascade."""
    return base.resolved(spark, sf)


@query(f"WITH {base.REFS}, {base.IDENTITY} SELECT r.cited_id, {base._ID} AS identity FROM refs r LEFT JOIN al ON al.name_norm = r.journal_key LEFT JOIN ac ON ac.acr = replace(r.journal_key,' ','')")
def journal_identities(spark, sf):
    """J13."""
    return match.resolve_journals(base.references(spark, sf), "journal", read(spark, sf, "alias"), read(spark, sf, "acronym")).select("cited_id", "identity")


@query(
    "WITH b AS (SELECT doi, min(year) AS year, min(journal_norm) AS journal_norm FROM biblio WHERE doi IS NOT NULL GROUP BY 1), o AS (SELECT doi, min(year) AS year, min(journal_norm) AS journal_norm FROM oa WHERE doi IS NOT NULL GROUP BY 1) "
    "SELECT coalesce(b.doi,o.doi) AS doi, b.doi IS NOT NULL AS in_left, o.doi IS NOT NULL AS in_right, coalesce(b.year,o.year) AS year, coalesce(b.journal_norm,o.journal_norm) AS journal_norm, CASE WHEN b.year IS NOT NULL THEN 'left' WHEN o.year IS NOT NULL THEN 'right' END AS year_source FROM b FULL JOIN o ON b.doi = o.doi"
)
def federated_records(spark, sf):
    """J14."""
    one = lambda t: read(spark, sf, t).filter(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("year").alias("year"), F.min("journal_norm").alias("journal_norm"))
    return match.federate(one("biblio"), one("oa"), "doi", ["year", "journal_norm"]).withColumn("year_source", F.try_element_at("sources", F.lit("year"))).drop("sources")


@query("SELECT doi, count(DISTINCT oa_id) AS records, max(year) - min(year) AS year_spread, count(DISTINCT journal_norm) AS venues FROM oa WHERE doi IS NOT NULL GROUP BY 1 HAVING count(DISTINCT oa_id) > 1")
def duplicate_dois(spark, sf):
    """J23."""
    return match.duplicate_conflicts(read(spark, sf, "oa"))


@query("SELECT (year // 10) * 10 AS decade, count(*) AS missing FROM (SELECT DISTINCT doi, year FROM biblio WHERE doi IS NOT NULL AND year IS NOT NULL) b WHERE NOT EXISTS (SELECT 1 FROM oa WHERE oa.doi = b.doi) GROUP BY 1")
def missing_by_decade(spark, sf):
    """J22, A32."""
    b = read(spark, sf, "biblio").select("doi", "year").filter(F.col("doi").isNotNull() & F.col("year").isNotNull()).distinct()
    return b.join(read(spark, sf, "oa").select("doi"), "doi", "left_anti").groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("missing"))


@query("SELECT DISTINCT substring(b.doi,1,length(b.doi)-2) AS head FROM biblio b WHERE length(b.doi) - 2 >= 14 AND EXISTS (SELECT 1 FROM oa WHERE starts_with(oa.doi, substring(b.doi,1,length(b.doi)-2)))")
def doi_prefixes_known(spark, sf):
    """J17."""
    heads = read(spark, sf, "biblio").select(F.expr("substring(doi, 1, length(doi) - 2)").alias("head")).filter(F.col("head").isNotNull()).distinct()
    return match.prefix_exists(heads, "head", read(spark, sf, "oa").select("doi").filter(F.col("doi").isNotNull()).distinct(), "doi")


@query("SELECT arxiv_id, arg_max(title, fetched) AS title, arg_max(year, fetched) AS year, max(fetched) AS fetched FROM arxiv GROUP BY 1")
def arxiv_authority(spark, sf):
    """The last record of each identifier."""
    return match.latest(read(spark, sf, "arxiv").select("arxiv_id", "title", "year", "fetched"), "arxiv_id", "fetched")


@query()
def fuzzy_title_matches(spark, sf):
    """Unresolved references and the most similar work."""
    refs = base.keyed(spark, sf).filter(F.col("title_key").isNotNull())
    left = refs.join(base.resolved(spark, sf), "cited_id", "left_anti").select("cited_id", F.col("title_key").alias("title"))
    return similar_titles(spark, sf, left)


def similar_titles(spark, sf, left):
    """J9 for references (cited_id, title)."""
    works = read(spark, sf, "oa").select("oa_id", "title_norm").filter(F.col("title_norm").isNotNull()).distinct()
    return match.fuzzy_title(left, works)


# Classification.


@query(f"WITH {FACTS} SELECT cited_id, found, nonacademic_rule, reason FROM facts")
def classified_references(spark, sf):
    """C1, C2 over E12."""
    return base.facts(spark, sf).select("cited_id", "found", "nonacademic_rule", "reason")


@query(
    f"""WITH {RESOLVED}, t AS (SELECT r.cited_id, {base.content_sql('r.title')} AS ct, list_distinct({base.content_sql('r.title')}) AS a, list_distinct({base.content_sql('o.title_norm')}) AS b FROM refs r JOIN jo_one v USING (cited_id) JOIN (SELECT oa_id, min(title_norm) AS title_norm FROM oa GROUP BY 1) o ON o.oa_id = v.matched)
    SELECT cited_id FROM t WHERE len(ct) >= 4 AND len(b) > 0 AND len(list_intersect(a,b)) / len(a) < 0.3 AND len(list_intersect(a,b)) / len(b) < 0.3"""
)
def title_hijacks(spark, sf):
    """C4: references whose title contradicts the work with their journal, year and volume (no title guard)."""
    oa = read(spark, sf, "oa")
    works = oa.groupBy("oa_id").agg(F.min("title_norm").alias("title_norm"))
    refs = base.keyed(spark, sf)
    hits = match.by_metadata(refs, oa, least=0.0).join(works, F.col("matched") == F.col("oa_id")).join(refs.select("cited_id", "title"), "cited_id")
    return hits.filter(rules.title_hijack(F.col("title"), F.col("title_norm"))).select("cited_id")


_TOKENS = "list_filter(regexp_split_to_array(lower({}),'[^a-z]+'), lambda w: length(w) >= 3)"
AUTHOR_HIJACKS = rf"""{base.REFS}, wk AS (SELECT title_norm, list(DISTINCT author1) AS au FROM oa WHERE title_norm IS NOT NULL AND author1 IS NOT NULL GROUP BY 1),
ah0 AS (SELECT r.cited_id, r.month, citation, substring(citation,1,130) AS head, {_TOKENS.format("coalesce(citation,'')")} AS mine, list_filter(list_transform(wk.au, lambda a: {_TOKENS.format('a').replace('lambda w: length(w)', 'lambda v: length(v)')}), lambda x: len(x) > 0) AS theirs, {_TOKENS.format('wk.title_norm')} AS tt FROM refs r JOIN wk ON r.title_key = wk.title_norm),
ah AS (SELECT cited_id, month, CASE WHEN length(citation) < 40 OR len(theirs) = 0 THEN NULL WHEN len(list_filter(theirs, lambda a: list_has_any(a, mine))) > 0 THEN false
  WHEN regexp_matches(head,'^\s*(?:[A-Z]\.[-\s]*){{1,4}}[A-Z]?[a-z]') OR regexp_matches(head,'^\s*[A-Z][a-z]+\s+[A-Z]\s*,') OR regexp_matches(head,'^\s*[A-Z][a-z]+\s+[A-Z]\.?[,\s]+(?:and\s+)?[A-Z][a-z]+\s+[A-Z]\b[,.\s]')
    OR len(list_filter(regexp_split_to_array(head,'[^A-Za-z]+'), lambda w: length(w) >= 4 AND regexp_matches(w,'^[A-Z]') AND NOT list_contains(tt, lower(w)))) < 2 OR len(list_filter(theirs, lambda a: list_max(list_transform(a, lambda u: length(u))) >= 5)) = 0 THEN NULL ELSE true END AS author_hijack FROM ah0)"""


@query(f"WITH {AUTHOR_HIJACKS} SELECT cited_id, author_hijack FROM ah")
def author_hijacks(spark, sf):
    """By reference whether no author of the works with its title stands in it; null where that can't be said."""
    works = read(spark, sf, "oa").filter(F.col("title_norm").isNotNull() & F.col("author1").isNotNull()).groupBy("title_norm").agg(F.collect_set("author1").alias("known_authors"))
    hits = base.references(spark, sf).join(works, F.col("title_key") == F.col("title_norm"))
    return hits.select("cited_id", rules.author_hijack(F.col("citation"), F.col("known_authors"), F.col("title_norm")).alias("author_hijack"))


@query(f"WITH {FACTS} SELECT CASE WHEN y IS NULL THEN 'unknown' WHEN y < 1990 THEN 'pre1990' WHEN y < 2000 THEN '1990s' WHEN y < 2010 THEN '2000s' WHEN y < 2015 THEN '2010-14' WHEN y < 2020 THEN '2015-19' ELSE '2020+' END AS band, count(*) AS n, round(avg((NOT found)::INT), 6) AS rate FROM facts GROUP BY 1")
def rate_by_cited_band(spark, sf):
    """F40, A19."""
    return base.facts(spark, sf).groupBy(rules.cited_band(F.col("y")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg((~F.col("found")).cast("int")), 6).alias("rate"))


@query(f"WITH {FACTS} SELECT nonacademic_rule, count(*) AS n FROM facts WHERE nonacademic GROUP BY 1")
def nonacademic_rules(spark, sf):
    """C1a counted."""
    return base.facts(spark, sf).filter("nonacademic").groupBy("nonacademic_rule").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FACTS}, s AS (SELECT cited_id, 0.30 + CASE WHEN coalesce(trim(journal),'') <> '' THEN 0.25 ELSE 0 END + CASE WHEN coalesce(trim(journal),'') <> '' AND coalesce(trim(volume),'') <> '' AND coalesce(trim(pages),'') <> '' THEN 0.20 ELSE 0 END + CASE WHEN y >= 2020 THEN 0.20 WHEN y < 2005 THEN -0.15 ELSE 0 END AS score FROM facts WHERE NOT found)
    SELECT round(greatest(0, least(1, score))::DOUBLE, 2) AS score, count(*) AS n FROM s GROUP BY 1"""
)
def likelihood_scores(spark, sf):
    """C13 counted."""
    c = F.col
    score = rules.likelihood(c("found"), c("journal"), c("volume"), c("pages"), c("y"))
    return base.facts(spark, sf).filter(~c("found")).groupBy(F.round(score.cast("double"), 2).alias("score")).agg(F.count("*").alias("n"))


# Rates.


@query(f"WITH {FACTS} SELECT paper, month, count(*) AS total, count_if(found) AS found, count_if(NOT found) AS not_found, count_if(NOT found AND NOT nonacademic) AS not_found_academic, count_if(nonacademic) AS heuristic_filtered FROM facts GROUP BY 1,2")
def paper_counts(spark, sf):
    """A1."""
    return rates.per_paper(base.facts(spark, sf))


@query(f"WITH {FACTS} SELECT month, count(DISTINCT paper) AS n_papers, count(*) AS sum_refs, count_if(NOT found) AS sum_not_found, count_if(NOT found AND NOT nonacademic) AS sum_nf_academic, round(count_if(NOT found AND NOT nonacademic) / count(*), 6) AS unmatched_rate FROM facts GROUP BY 1")
def month_rollup(spark, sf):
    """A2."""
    return rates.per_month(base.facts(spark, sf))


@query(f"WITH {FACTS} SELECT month, count(*) AS a_total, count_if(NOT found) AS a_bad, count_if(has_doi) AS b_total, count_if(has_doi AND NOT found) AS b_bad, count_if(has_title AND NOT found) AS c_total, count_if(has_title AND NOT found AND reason = 'fab_candidate') AS c_bad FROM facts WHERE NOT nonacademic GROUP BY 1 HAVING count(*) >= 20")
def month_channels(spark, sf):
    """A4."""
    return rates.channels(base.facts(spark, sf), least=20)


@query(f"WITH {FACTS}, s AS (SELECT 2000 + substring(month,1,2)::INT AS year, coalesce(identity,'unknown') AS venue, found FROM facts) SELECT year, venue, count(*) AS total, count_if(NOT found) AS not_found, round(count_if(NOT found) / count(*), 6) AS rate FROM s GROUP BY GROUPING SETS ((year),(venue),(year,venue))")
def year_venue_sets(spark, sf):
    """A3."""
    return rates.by_grouping_sets(base.facts(spark, sf))


@query(f"WITH {FACTS}, s AS (SELECT 2000 + substring(month,1,2)::INT AS year, coalesce(reason,'none') AS reason, count(*) AS n FROM facts WHERE NOT found AND NOT nonacademic GROUP BY 1,2) SELECT year, reason, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM s")
def reason_mix(spark, sf):
    """A6."""
    return rates.reason_mix(base.facts(spark, sf))


@query(f"WITH {FACTS}, p AS (SELECT month, paper, bool_or(NOT found) AS hit FROM facts WHERE NOT nonacademic GROUP BY 1,2) SELECT month, count(*) AS papers, count_if(hit) AS with_unmatched, round(count_if(hit) / count(*), 6) AS share FROM p GROUP BY 1")
def paper_level_rate(spark, sf):
    """A11."""
    return rates.paper_level(base.facts(spark, sf))


@query(
    f"""WITH {FACTS}, c AS (SELECT 2000 + substring(month,1,2)::INT AS year, CASE WHEN y IS NULL THEN 'unknown' WHEN y < 2010 THEN 'old' ELSE 'new' END AS band, count(*) AS n, count_if(NOT found) AS bad FROM facts WHERE NOT nonacademic GROUP BY 1,2),
    o AS (SELECT band, sum(n) AS weight FROM c GROUP BY 1), a AS (SELECT year, round(sum(bad / n * weight) / sum(weight), 6) AS adjusted FROM c JOIN o USING (band) WHERE n >= 10 GROUP BY 1)
    SELECT c.year, round(sum(c.bad) / sum(c.n), 6) AS crude, max(a.adjusted) AS adjusted FROM c LEFT JOIN a ON a.year IS NOT DISTINCT FROM c.year GROUP BY 1"""
)
def standardised_rate(spark, sf):
    """A13."""
    y = F.col("y")
    return rates.standardised(base.facts(spark, sf), F.when(y.isNull(), "unknown").when(y < 2010, "old").otherwise("new"), least=10)


@query(f"WITH {FACTS}, p AS (SELECT count_if(NOT found) / count(*) AS r FROM facts GROUP BY paper, month) SELECT least(floor(round(r / 0.05, 9))::INT, 19) AS bin, count(*) AS n FROM p GROUP BY 1")
def paper_rate_histogram(spark, sf):
    """A17."""
    p = rates.per_paper(base.facts(spark, sf)).withColumn("r", F.col("not_found") / F.col("total"))
    return rates.histogram(p, "r", [])


@query(f"WITH {FACTS} SELECT count_if(f._is_fake AND NOT found) AS tp, count_if(NOT f._is_fake AND NOT found) AS fp, count_if(f._is_fake AND found) AS fn, count_if(NOT f._is_fake AND found) AS tn, round(count_if(f._is_fake AND NOT found) / nullif(count_if(f._is_fake),0), 6) AS recall, round(count_if(f._is_fake AND NOT found) / nullif(count_if(NOT found),0), 6) AS precision, round(count_if(NOT f._is_fake AND NOT found) / nullif(count_if(NOT f._is_fake),0), 6) AS fpr FROM facts JOIN (SELECT DISTINCT cited_id, _is_fake FROM cited_sent WHERE _is_fake IS NOT NULL) f USING (cited_id)")
def fake_confusion(spark, sf):
    """Not found as a sign of an invented entry."""
    truth = read(spark, sf, "cited_sent").select("cited_id", "_is_fake").filter(F.col("_is_fake").isNotNull()).distinct()
    labelled = base.facts(spark, sf).join(truth, "cited_id").withColumn("flagged", ~F.col("found"))
    return rates.confusion(labelled, "_is_fake", "flagged")


@query("SELECT journal, count(*) AS n FROM cited_sent WHERE journal IS NOT NULL GROUP BY 1 ORDER BY n DESC, journal LIMIT 20")
def top_journals(spark, sf):
    """A report of the twenty most frequent."""
    return rates.top_k(read(spark, sf, "cited_sent"), "journal", 20)


@query(f"WITH {FACTS} SELECT 2000 + substring(month,1,2)::INT AS year, {', '.join(f"coalesce(count_if(method = '{m}'),0) AS {m}" for m in METHODS)} FROM facts GROUP BY 1")
def method_mix(spark, sf):
    """A14."""
    f = base.facts(spark, sf).withColumn("year", rates.citing_year(F.col("month")))
    return f.groupBy("year").agg(*[F.count_if(F.col("method") == m).alias(m) for m in METHODS])


# Statistics.


@query(f"WITH {FACTS}, c AS (SELECT 2000 + substring(month,1,2)::INT AS year, count_if(NOT found)::DOUBLE AS k, count(*)::DOUBLE AS n FROM facts GROUP BY 1) SELECT year, round((k/n + 3.8416/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n), 6) AS low, round((k/n + 3.8416/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n), 6) AS high FROM c")
def wilson_by_year(spark, sf):
    """M12."""
    c = base.facts(spark, sf).groupBy(rates.citing_year(F.col("month")).alias("year")).agg(F.count_if(~F.col("found")).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("year", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"WITH {FACTS}, c AS (SELECT 2000 + substring(month,1,2)::INT AS year, avg((NOT found)::INT) AS r FROM facts GROUP BY 1) SELECT count(*) AS points, round(regr_slope(r, year), 6) AS slope, round(regr_intercept(r, year), 4) AS intercept FROM c HAVING count(*) >= 3")
def yearly_trend(spark, sf):
    """M8."""
    c = base.facts(spark, sf).groupBy(rates.citing_year(F.col("month")).alias("year")).agg(F.avg((~F.col("found")).cast("int")).alias("r"))
    return stats.trend(c, "year", "r")


@query(
    f"""WITH {FACTS}, c AS (SELECT 2000 + substring(month,1,2)::INT + (substring(month,3,2)::INT - 0.5)::DOUBLE/12 - 2018.0 AS x, avg((NOT found)::INT) AS y, count(*)::DOUBLE AS w FROM facts GROUP BY month),
    b AS (SELECT sum(w*y)/sum(w) AS flat, sum(w*w) AS s0, sum(w*w*x) AS sx, sum(w*w*y) AS sy, sum(w*w*x*x) AS sxx, sum(w*w*x*y) AS sxy FROM c WHERE x < 0),
    l AS (SELECT flat, (s0*sxy-sx*sy)/nullif(s0*sxx-sx*sx,0) AS slope, (sy-(s0*sxy-sx*sy)/nullif(s0*sxx-sx*sx,0)*sx)/s0 AS icpt FROM b)
    SELECT round(sum(w*(y-flat))/sum(w),6) AS over_flat, round(sum(w*(y-slope*x-icpt))/sum(w),6) AS over_linear, round(sum(w*y)/sum(w),6) AS post_mean FROM c, l WHERE x >= 0"""
)
def excess_over_baseline(spark, sf):
    """M7, M10."""
    c = base.facts(spark, sf).groupBy("month").agg(F.avg((~F.col("found")).cast("int")).alias("r"), F.count("*").alias("n")).withColumn("t", rates.decimal_year(F.col("month")))
    return stats.excess(c, "t", "r", "n", 2018.0)


@query(f"WITH {FACTS}, c AS (SELECT avg((NOT found)::INT) AS y, count(*) AS n FROM facts GROUP BY month) SELECT count(*) AS periods, round(stddev_samp(y), 6) AS spread, round(var_samp(y) - avg(y*(1-y)/n), 8) AS excess_variance FROM c")
def between_month_spread(spark, sf):
    """M3."""
    c = base.facts(spark, sf).groupBy("month").agg(F.avg((~F.col("found")).cast("int")).alias("y"), F.count("*").alias("n"))
    return stats.between_spread(c, "y", "n")


BOOTSTRAP = f"""{FACTS}, pp AS (SELECT 2000 + substring(month,1,2)::INT AS year, paper, count_if(NOT found) AS bad, count(*) AS total FROM facts GROUP BY month, paper),
u AS (SELECT year, bad, total, b.r AS replicate, ('0x' || substring(md5(paper || ':' || b.r || ':0'),1,8))::BIGINT / 4294967296.0 AS u FROM pp, (SELECT unnest(range(1,201)) AS r) b),
bw AS (SELECT *, CASE WHEN u < {stats.POISSON[0]!r} THEN 0 {' '.join(f'WHEN u < {c!r} THEN {k}' for k, c in enumerate(stats.POISSON) if k)} ELSE 9 END AS w FROM u),
bs AS (SELECT year, replicate, sum(w*bad)/sum(w*total) AS rate FROM bw GROUP BY 1,2 HAVING sum(w*total) > 0),
boot AS (SELECT year, count(*) AS replicates, round(stddev_samp(rate),6) AS se, round(quantile_cont(rate,0.025),6) AS low, round(quantile_cont(rate,0.975),6) AS high FROM bs GROUP BY 1)"""


@query(f"WITH {BOOTSTRAP} SELECT * FROM boot")
def bootstrap_by_year(spark, sf):
    """M1."""
    p = rates.per_paper(base.facts(spark, sf)).withColumn("year", rates.citing_year(F.col("month")))
    return stats.cluster_bootstrap(p, "paper", "not_found", "total", ["year"])


# Samples and vectors.


@query("SELECT month, cited_id FROM (SELECT month, cited_id, row_number() OVER (PARTITION BY month ORDER BY substring(md5('42:' || cited_id),1,16), cited_id) AS k FROM (SELECT DISTINCT month, cited_id FROM cited_sent)) WHERE k <= 5")
def sample_by_month(spark, sf):
    """Five references a month."""
    return sampling.nested_sample(read(spark, sf, "cited_sent").select("month", "cited_id").distinct(), ["month"], "cited_id", 5)


@query("SELECT month, ntile(12) OVER (ORDER BY month) AS shard FROM (SELECT DISTINCT month FROM cited_sent WHERE month IS NOT NULL)")
def month_shards(spark, sf):
    """P5."""
    return sampling.shards(read(spark, sf, "cited_sent"), "month", 12)


@query(
    "WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.query, e.vec_id, list_cosine_similarity(q.a, e.embedding::DOUBLE[]) AS sim FROM q JOIN embeddings e ON e.vec_id <> q.query AND abs(e.label - q.label) <= 2) "
    "SELECT query, vec_id, round(sim, 5) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s WHERE sim >= 0) WHERE rank <= 5"
)
def nearest_vectors(spark, sf):
    """V2-V5: every vector whose id 50 divides, against all."""
    e = read(spark, sf, "embeddings")
    return vector.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", year="label", k=5).withColumn("similarity", F.round("similarity", 5))


# Sentences, injections, events.


@query()
def citing_sentences(spark, sf):
    """F23, F24, F26, W2."""
    from refloom.operators.sentences import citing_sentences as run, running_index

    s = running_index(run(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")
    return s.select("doc_id", "sent_index", "sentence", F.size("before").alias("n_before"), F.size("after").alias("n_after"), F.array_join("refs", ",").alias("refs"))


@query(
    f"WITH {base.REFS}, s AS (SELECT paper, cited_id, y, row_number() OVER (PARTITION BY paper ORDER BY substring(md5('42:' || cited_id),1,16), cited_id) AS k FROM refs WHERE length(title) >= 50 AND y IS NOT NULL) SELECT paper, cited_id, y AS original_year, y + 7 AS corrupted_year FROM s WHERE k <= 2"
)
def injected_mismatches(spark, sf):
    """I2."""
    from refloom.operators.inject import inject_mismatches

    return inject_mismatches(base.references(spark, sf))


@query(f"WITH {base.REFS} SELECT cited_id, (('0x' || substring(md5('biblio:' || cited_id),1,8))::BIGINT % 90 + 1)::VARCHAR AS volume, (('0x' || substring(md5('biblio:' || cited_id),1,8))::BIGINT % 1500 + 1)::VARCHAR AS first_page FROM refs")
def synthetic_details(spark, sf):
    """F41, I4."""
    from refloom.operators.inject import synthetic_biblio

    return synthetic_biblio(base.references(spark, sf).select("cited_id"), "cited_id").select("cited_id", "volume", "first_page")


@query("SELECT to_timestamp((epoch(ts)::BIGINT // 604800) * 604800)::TIMESTAMP AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def weekly_events(spark, sf):
    """Windows over arrival times, as on a stream."""
    from refloom.streaming.ingest import windowed_counts

    return windowed_counts(read(spark, sf, "events").select("ts"), "ts", "7 days")


@query(
    f"WITH {FACTS} SELECT nonacademic_rule, reason, CASE WHEN found THEN NULL WHEN NOT nonacademic AND reason = 'fab_candidate' THEN 'not_found_candidate' END AS flag, count(*) AS n FROM facts GROUP BY 1,2,3"
)
def flags(spark, sf):
    """C5 counted; hijacks are queries of their own."""
    f = base.facts(spark, sf)
    flag = rules.fab_flag(F.lit(False), F.lit(False), F.col("found"), F.col("nonacademic"), F.col("reason"))
    return f.groupBy("nonacademic_rule", "reason", flag.alias("flag")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS}, s AS (SELECT CASE WHEN y >= 2018 THEN 'late' ELSE 'early' END AS era, CASE WHEN found THEN 1.0 ELSE 0.0 END + i / 1000.0 AS score, found FROM facts), t AS (SELECT unnest([0.2,0.5,1.0]) AS threshold) SELECT threshold::DOUBLE AS threshold, count_if(found AND score >= threshold) AS kept, count_if(NOT found AND score >= threshold) AS leaked FROM s, t GROUP BY 1")
def threshold_sweep(spark, sf):
    """A20."""
    s = base.facts(spark, sf).select((F.col("found").cast("double") + F.col("i") / 1000.0).alias("score"), "found")
    return rates.threshold_sweep(s, "score", "found", [0.2, 0.5, 1.0])


# Disagreements and compositions.

_ISSUES = f"""{FACTS}, w AS (SELECT oa_id, min(year) AS wy, min(journal_norm) AS wj, min({base.volume_key_sql('volume')}) AS wv FROM oa GROUP BY 1),
wi AS (SELECT w.*, CASE WHEN al.n = 1 THEN al.identity END AS wid FROM w LEFT JOIN al ON al.name_norm = w.wj),
issues AS (SELECT f.cited_id, f.month, list_filter([CASE WHEN abs(f.y - wi.wy) > 1 THEN 'year' END, CASE WHEN f.identity <> wi.wid THEN 'journal' END, CASE WHEN f.vol <> wi.wv THEN 'volume' END], lambda x: x IS NOT NULL) AS issues FROM facts f JOIN wi ON wi.oa_id = f.matched)"""


def _issues(spark, sf):
    works = read(spark, sf, "oa").groupBy("oa_id").agg(F.min("year").alias("wy"), F.min("journal_norm").alias("wj"), F.min(keys.volume_key(F.col("volume"))).alias("wv"))
    known = match.unique_identities(read(spark, sf, "alias")).withColumnRenamed("identity", "wid")
    works = works.join(known, F.col("wj") == F.col("name"), "left")
    f = base.facts(spark, sf).join(works, F.col("matched") == F.col("oa_id"))
    none = F.array().cast("array<string>")
    issues = rules.metadata_issues(F.col("y"), F.col("identity"), F.col("vol"), none, F.col("wy"), F.col("wid"), F.col("wv"), F.lit(""))
    return f.select("cited_id", "month", issues.alias("issues"))


@query(f"WITH {_ISSUES} SELECT cited_id, array_to_string(issues, ',') AS issues, len(issues) >= 2 OR len(list_filter(issues, lambda x: x <> 'year')) > 0 AS mismatch FROM issues")
def metadata_issues(spark, sf):
    """C6, C7."""
    return _issues(spark, sf).select("cited_id", F.array_join("issues", ",").alias("issues"), rules.is_mismatch(F.col("issues")).alias("mismatch"))


@query(f"WITH {_ISSUES}, t AS (SELECT 2000 + substring(month,1,2)::INT AS year, count(*) AS found, count_if(len(issues) >= 2 OR len(list_filter(issues, lambda x: x <> 'year')) > 0) AS bad FROM issues GROUP BY 1) SELECT year, found, bad, round(bad / found, 6) AS rate FROM t")
def mismatch_by_year(spark, sf):
    """A15."""
    t = _issues(spark, sf).groupBy(rates.citing_year(F.col("month")).alias("year")).agg(F.count("*").alias("found"), F.count_if(rules.is_mismatch(F.col("issues"))).alias("bad"))
    return t.withColumn("rate", rates.rate(F.col("bad"), F.col("found")))


@query(f"WITH {_ISSUES} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM issues) GROUP BY 1")
def issue_composition(spark, sf):
    """A24, A28."""
    return _issues(spark, sf).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT DISTINCT cited_id, regexp_replace(citation,'[\r\n]+',' ','g') AS citation FROM cited_sent WHERE citation IS NOT NULL), s AS (SELECT DISTINCT cited_id, CASE WHEN regexp_matches(citation,'^\s*\[\d+\]') THEN 'ieee' WHEN regexp_matches(citation,'\d{4};\s*\d*(?:\(\d+\))?:') THEN 'vancouver' WHEN regexp_matches(citation,'\(\d{4}[a-z]?\)\.\s') THEN 'apa' WHEN regexp_matches(citation,'["“].+["”].*\(\d{4}\)') THEN 'chicago' WHEN regexp_matches(citation,'["“].+["”].*\b\d{4}\b') THEN 'mla' ELSE 'unknown' END AS style FROM c) SELECT style, count(*) AS n FROM s GROUP BY 1""")
def citation_styles(spark, sf):
    """line ends count as blanks."""
    c = F.regexp_replace("citation", r"[\r\n]+", " ")
    s = read(spark, sf, "cited_sent").filter(F.col("citation").isNotNull()).select("cited_id", rules.style_of(c).alias("style")).distinct()
    return s.groupBy("style").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS}, c AS (SELECT 2000 + substring(month,1,2)::INT AS year, avg((NOT found)::INT) AS r FROM facts WHERE month IS NOT NULL GROUP BY 1), l AS (SELECT regr_slope(r,year) AS b, regr_intercept(r,year) AS a FROM c WHERE year < 2018) SELECT year, round(r - a - b*year, 6) AS excess FROM c, l")
def detrended_by_year(spark, sf):
    """M9."""
    c = base.facts(spark, sf).filter(F.col("month").isNotNull()).groupBy(rates.citing_year(F.col("month")).alias("year")).agg(F.avg((~F.col("found")).cast("int")).alias("r"))
    return stats.detrended(c, "year", "r", 2018)


@query(f"WITH {FACTS}, p AS (SELECT 2000 + substring(month,1,2)::INT AS year, count_if(NOT found)::DOUBLE AS bad, count(*)::DOUBLE AS total FROM facts WHERE month IS NOT NULL GROUP BY month, paper), g AS (SELECT year, sum(bad)/sum(total) AS mean, sum(total*(bad/total)*(bad/total))/sum(total) - (sum(bad)/sum(total))*(sum(bad)/sum(total)) AS var, count(*) AS n FROM p GROUP BY 1), z AS (SELECT mean AS m0, var AS v0, n AS n0 FROM g WHERE year = 2020) SELECT year, round(mean - m0, 6) AS effect, round(sqrt(var/n + v0/n0), 6) AS se FROM g, z")
def year_effects(spark, sf):
    """M11."""
    p = rates.per_paper(base.facts(spark, sf)).filter(F.col("month").isNotNull()).withColumn("year", rates.citing_year(F.col("month")))
    return stats.year_effects(p, "year", "not_found", "total", 2020)


@query(f"WITH {FACTS}, m AS (SELECT 2000 + substring(month,1,2)::INT AS x, count_if(NOT found) AS bad, count(*) AS total FROM facts WHERE month IS NOT NULL GROUP BY 1), s AS (SELECT unnest([2015.0,2018.0,2021.0])::DOUBLE AS onset) SELECT onset, round(sum(CASE WHEN x < onset THEN bad END)/sum(CASE WHEN x < onset THEN total END),6) AS pre, round(sum(CASE WHEN x >= onset THEN bad END)/sum(CASE WHEN x >= onset THEN total END),6) AS post, round(sum(CASE WHEN x >= onset THEN bad END)/sum(CASE WHEN x >= onset THEN total END) - sum(CASE WHEN x < onset THEN bad END)/sum(CASE WHEN x < onset THEN total END),6) AS difference FROM m, s GROUP BY 1")
def onset_sweep(spark, sf):
    """M5."""
    m = base.facts(spark, sf).filter(F.col("month").isNotNull()).groupBy(rates.citing_year(F.col("month")).alias("x")).agg(F.count_if(~F.col("found")).alias("bad"), F.count("*").alias("total"))
    return stats.onset_sweep(m, "x", "bad", "total", [2015.0, 2018.0, 2021.0])


@query(
    f"""WITH a AS (SELECT DISTINCT paper, cited_id, list_distinct({base.content_sql('title')}) AS w FROM cited_sent WHERE _is_fake AND title IS NOT NULL), b AS (SELECT DISTINCT paper, cited_id AS other, list_distinct({base.content_sql('title')}) AS w FROM cited_sent WHERE NOT coalesce(_is_fake,false) AND title IS NOT NULL),
    s AS (SELECT a.paper, a.cited_id, b.other, round(len(list_intersect(a.w,b.w))/len(a.w),6) AS overlap FROM a JOIN b ON a.paper = b.paper WHERE len(list_intersect(a.w,b.w)) > 0)
    SELECT paper, cited_id, other, overlap FROM (SELECT *, row_number() OVER (PARTITION BY paper, cited_id ORDER BY overlap DESC, other) AS k FROM s WHERE overlap >= 0.4) WHERE k = 1"""
)
def fake_alignment(spark, sf):
    """Each invented entry and the real one of its paper that it is most like."""
    c = read(spark, sf, "cited_sent").filter(F.col("title").isNotNull()).select("paper", "cited_id", "_is_fake", keys.content_tokens(F.col("title")).alias("w")).distinct()
    real = c.filter(~F.coalesce("_is_fake", F.lit(False))).select("paper", F.col("cited_id").alias("other"), F.col("w").alias("v"))
    return match.best_overlap(c.filter("_is_fake"), real, "paper", "cited_id", "other", "w", "v")
