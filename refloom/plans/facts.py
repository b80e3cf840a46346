"""The fact table: every reference, resolved and classified; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import rules, text
from refloom.functions.keys import ACCENTED, PLAIN, STROKED, TITLE_STOP, UNSTROKED
from refloom.operators import match
from refloom.session import made_once, read


def references(spark: SparkSession, sf: str) -> DataFrame:
    """References with their keys and their text."""
    return match.reference_keys(read(spark, sf, "cited_sent"))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    """References with their keys and what rules say of their text, without the text: one pass over it, written once."""

    def make() -> DataFrame:
        c = F.col
        # The last versions first: their shuffle spreads the rows evenly for the rules, whatever the files are like.
        rows = match.with_reference_keys(match.newest(read(spark, sf, "cited_sent").drop("sentences", "publisher"), "cited_id", "loaded_at"))
        rule = rules.nonacademic_rule(c("citation"), c("doi_key"), c("title"), c("journal"), c("volume"))
        reason = rules.not_found_reason(c("citation"), c("title"), c("doi_key"))
        has_title = F.coalesce(F.trim("title"), F.lit("")) != ""
        return rows.select("cited_id", "paper", "i", "month", "title", "journal", "volume", "pages", "y", "title_key", "journal_key", "vol", "page", "doi_key", "s", rule.alias("nonacademic_rule"), reason.alias("reason0"), has_title.alias("has_title"))

    return made_once(spark, sf, "keyed", ("cited_sent",), make)


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """(cited_id, method, matched): DOI, then biblio metadata, works metadata, title, repaired title, arXiv's titles."""
    refs, oa = keyed(spark, sf), read(spark, sf, "oa")
    arxiv = read(spark, sf, "arxiv")
    phases = [("doi", match.by_doi(refs, oa)), ("biblio_meta", match.by_biblio(refs, read(spark, sf, "biblio"))), ("oa_meta", match.by_metadata(refs, oa)), ("title_exact", match.by_title(refs, oa)), ("title_repaired", match.by_repaired_title(refs, oa)), ("arxiv_title", match.by_arxiv_title(refs, arxiv))]
    return match.cascade(refs, phases)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each reference; written once by month, so that what is counted from it reads its columns alone."""

    def make() -> DataFrame:
        refs = match.resolve_journals(keyed(spark, sf), "journal", read(spark, sf, "alias"), read(spark, sf, "acronym"))
        rows = refs.join(resolved(spark, sf), "cited_id", "left")
        rows = rows.withColumns({"found": F.col("method").isNotNull(), "nonacademic": F.col("nonacademic_rule").isNotNull(), "has_doi": F.col("doi_key").isNotNull()})
        return rows.withColumn("reason", F.when(~F.col("found") & ~F.col("nonacademic"), F.col("reason0"))).drop("reason0", "s")

    return made_once(spark, sf, "facts", ("cited_sent", "oa", "biblio", "arxiv", "alias", "acronym"), make)


# The same for DuckDB.  Patterns are the library's own text, so that both engines run the same rules.
def _p(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def journal_key_sql(c: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(regexp_replace(replace(lower({c}),'&',' and '),'[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]',' ','g'),'\s+',' ','g')),'^the ','')"


def ascii_key_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace(regexp_replace(translate({ligatures_sql(c)},'{ACCENTED}','{PLAIN}'),'[\p{{P}}\p{{Z}}\p{{S}}]+',' ','g'),'[^\x00-\x7F]+','','g')),'[^a-z0-9]+',' ','g'))"


def page_key_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(trim({c})),'^e([0-9]+)$','\1'),'^0+(.)','\1')"


def volume_key_sql(c: str) -> str:
    return f"lower(regexp_extract(trim({c}),'^([0-9A-Za-z]+)',1))"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(translate({c},'{ACCENTED + STROKED}','{PLAIN + UNSTROKED}')),'[^a-z]+'), lambda x: length(x) >= 3)"


def surname_sql(c: str) -> str:
    w = words_sql(c)
    return f"list_extract(list_filter({w}, lambda y: length(y) = list_max(list_transform({w}, lambda z: length(z)))), 1)"


def content_sql(c: str) -> str:
    stop = ",".join(f"'{w}'" for w in TITLE_STOP)
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({c},''),'(\w)-\s*(\w)','\1\2','g')),'[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({stop}))"


def ligatures_sql(c: str) -> str:
    for a, b in text.LIGATURES.items():
        c = f"replace({c},'{a}','{b}')"
    return c


def no_author_sql(c: str) -> str:
    for p in text.LEADING_AUTHOR:
        c = f"regexp_replace({c},{_p(p)},'')"
    return c


def greek_sql(c: str) -> str:
    for word, letter in text.GREEK.items():
        c = rf"regexp_replace({c},'(?i)\b{word}\b','{letter}','g')"
    return c


REFS = f"""refs AS (
  SELECT cited_id, paper, i, month, title, authors, year, citation, pages, journal, volume,
    TRY_CAST(nullif(regexp_extract(year,'(1[89][0-9]{{2}}|20[0-9]{{2}})',1),'') AS INT) AS y,
    CASE WHEN len(string_split({ascii_key_sql('title')},' ')) >= 4 THEN {ascii_key_sql('title')} END AS title_key,
    nullif({journal_key_sql('journal')},'') AS journal_key, nullif({volume_key_sql('volume')},'') AS vol,
    nullif({page_key_sql("regexp_extract(trim(pages),'^([^-–\\s]+)',1)")},'') AS page
  FROM (SELECT *, row_number() OVER (PARTITION BY cited_id ORDER BY loaded_at DESC) AS rn FROM cited_sent) WHERE rn = 1)"""

RESOLVED = f"""{REFS}, jb AS (
  SELECT r.cited_id, r.page, b.doi AS matched, b.p1, b.p2, {surname_sql('r.authors')} AS s, b.sur FROM refs r JOIN (
    SELECT DISTINCT doi, journal_norm, year, {volume_key_sql('volume')} AS vol, {page_key_sql('first_page')} AS p1, {page_key_sql('article_num')} AS p2, {surname_sql('author1')} AS sur FROM biblio) b
  ON r.journal_key = b.journal_norm AND r.y = b.year AND r.vol = b.vol),
jb_hit AS (SELECT cited_id, min(matched) AS matched FROM jb WHERE page = p1 OR page = p2 GROUP BY 1
  UNION ALL SELECT cited_id, min(matched) FROM jb WHERE page IS NULL AND s = sur GROUP BY 1 HAVING count(DISTINCT matched) = 1),
jo AS (SELECT r.cited_id, r.page, w.oa_id, w.p, {surname_sql('r.authors')} AS s, w.sur FROM refs r JOIN (SELECT DISTINCT oa_id, journal_norm, year, {volume_key_sql('volume')} AS vol, {page_key_sql('first_page')} AS p, {surname_sql('author1')} AS sur FROM oa) w
  ON r.journal_key = w.journal_norm AND r.y = w.year AND r.vol = w.vol),
jo_one AS (SELECT cited_id, CASE WHEN count(DISTINCT CASE WHEN p = page THEN oa_id END) = 1 THEN min(CASE WHEN p = page THEN oa_id END) WHEN count(DISTINCT CASE WHEN s = sur THEN oa_id END) = 1 THEN min(CASE WHEN s = sur THEN oa_id END) WHEN count(DISTINCT oa_id) = 1 THEN min(oa_id) END AS matched FROM jo GROUP BY 1),
jo_hit AS (SELECT cited_id, matched FROM (SELECT j.cited_id, j.matched, list_distinct({content_sql('r.title')}) AS a, list_distinct({content_sql('t.title_norm')}) AS b FROM jo_one j JOIN refs r USING (cited_id) JOIN (SELECT oa_id, min(title_norm) AS title_norm FROM oa GROUP BY 1) t ON t.oa_id = j.matched)
  WHERE len(a) = 0 OR len(b) = 0 OR len(list_intersect(a,b)) >= 0.4 * len(list_distinct(list_concat(a,b)))),
jt AS (SELECT r.cited_id, w.oa_id, row_number() OVER (PARTITION BY r.cited_id ORDER BY (w.doi IS NULL)::INT, abs(coalesce(w.year,0) - coalesce(r.y, w.year, 0)), w.oa_id) AS rn
  FROM refs r JOIN (SELECT DISTINCT oa_id, title_norm, year, doi FROM oa) w ON r.title_key = w.title_norm),
jv AS (SELECT cited_id, y, k, {ascii_key_sql('v')} AS key FROM (SELECT cited_id, y, unnest([1,2,3]) AS k, unnest([{ligatures_sql('title')}, {no_author_sql('title')}, {greek_sql('title')}]) AS v FROM refs WHERE title IS NOT NULL)),
jr AS (SELECT v.cited_id, w.oa_id, row_number() OVER (PARTITION BY v.cited_id ORDER BY v.k, (w.doi IS NULL)::INT, abs(coalesce(w.year,0) - coalesce(v.y, w.year, 0)), w.oa_id) AS rn
  FROM jv v JOIN (SELECT DISTINCT oa_id, title_norm, year, doi FROM oa) w ON v.key = w.title_norm WHERE len(string_split(v.key,' ')) >= 4),
ja AS (SELECT r.cited_id, min(a.arxiv_id) AS matched FROM refs r JOIN arxiv a ON trim(regexp_replace(lower(r.title),'[^a-z0-9]+',' ','g')) = trim(regexp_replace(lower(a.title),'[^a-z0-9]+',' ','g')) WHERE len(string_split(trim(regexp_replace(lower(r.title),'[^a-z0-9]+',' ','g')),' ')) >= 4 GROUP BY 1),
hits AS (SELECT cited_id, 0 AS k, 'biblio_meta' AS method, matched FROM jb_hit UNION ALL SELECT cited_id, 1, 'oa_meta', matched FROM jo_hit UNION ALL SELECT cited_id, 2, 'title_exact', oa_id FROM jt WHERE rn = 1
  UNION ALL SELECT cited_id, 3, 'title_repaired', oa_id FROM jr WHERE rn = 1 UNION ALL SELECT cited_id, 4, 'arxiv_title', matched FROM ja),
resolved AS (SELECT cited_id, method, matched FROM (SELECT *, row_number() OVER (PARTITION BY cited_id ORDER BY k, method, matched) AS rn FROM hits) WHERE rn = 1)"""

_RAW = "coalesce(citation,'')"
_T = "trim(coalesce(title,''))"


def _has(pattern: str, c: str = _RAW) -> str:
    return f"regexp_matches({c},{_p(pattern)})"


RULE = f"""CASE WHEN {_has(rules.URL)} AND NOT {_has(rules.OWN_URL)} AND ({_has(rules.ACCESS)} OR NOT {_has(rules.JOURNAL)}) THEN 'url'
  WHEN {_has(rules.SOFTWARE)} THEN 'software' WHEN {_has(rules.ACCESS)} AND NOT {_has(rules.JOURNAL)} THEN 'access' WHEN {_has(rules.PATENT)} THEN 'patent'
  WHEN {_has(rules.THESIS)} THEN 'thesis' WHEN {_has(rules.REPORT)} THEN 'report' WHEN {_has(rules.STANDARD)} THEN 'standard'
  WHEN ({_has(rules.PUBLISHER)} OR {_has(rules.BOOKISH)}) AND NOT {_has(rules.JOURNAL)} AND NOT {_has(rules.CONFERENCE)} THEN 'book'
  WHEN {_has(rules.AFFILIATION)} AND {_has(rules.ADDRESS)} AND NOT {_has(rules.CITING)} THEN 'affiliation'
  WHEN length(trim({_RAW})) < 15 AND coalesce(title,'') = '' THEN 'debris'
  WHEN length(trim({_RAW})) < 60 AND NOT {_has(rules.CITING)} AND coalesce(journal,'') = '' AND coalesce(volume,'') = '' THEN 'debris_no_citation' END"""

_LETTERS = rf"regexp_replace({_T},'[^\p{{L}}]','','g')"
REASON = f"""CASE WHEN {_T} = '' THEN 'no_title'
  WHEN {_has(rules.JUNK, _T)} OR {_has(rules.JUNK, f"substring({_RAW},1,200)")} OR {_has(rules.JUNK_START, _T)} THEN 'parse_junk'
  WHEN {_has(rules.NO_ARTICLE, _T)} OR {_has(rules.NO_ARTICLE)} THEN 'non_article'
  WHEN length(regexp_replace({_LETTERS},'[A-Za-z]','','g')) / nullif(length({_LETTERS}),0) > 0.15 THEN 'foreign_language'
  WHEN len({content_sql(_T)}) < 4 THEN 'short_title' ELSE 'fab_candidate' END"""

IDENTITY = f"""al AS (SELECT name_norm, min(identity) AS identity, count(DISTINCT identity) AS n FROM alias WHERE name_norm IS NOT NULL GROUP BY 1),
ac AS (SELECT acr, min(identity) AS identity FROM acronym WHERE acr IS NOT NULL GROUP BY 1 HAVING count(DISTINCT identity) = 1)"""
_ID = "CASE WHEN al.name_norm IS NOT NULL THEN CASE WHEN al.n = 1 THEN al.identity END WHEN length(replace(r.journal_key,' ','')) BETWEEN 2 AND 10 THEN ac.identity END"

FACTS = f"""{RESOLVED}, {IDENTITY}, facts0 AS (
  SELECT r.*, v.method, v.matched, v.method IS NOT NULL AS found, {RULE} AS nonacademic_rule, false AS has_doi, {_T} <> '' AS has_title, {_ID} AS identity
  FROM refs r LEFT JOIN resolved v USING (cited_id) LEFT JOIN al ON al.name_norm = r.journal_key LEFT JOIN ac ON ac.acr = replace(r.journal_key,' ','')),
facts1 AS (SELECT *, nonacademic_rule IS NOT NULL AS nonacademic FROM facts0),
facts AS (SELECT *, CASE WHEN NOT found AND NOT nonacademic THEN {REASON} END AS reason FROM facts1)"""
