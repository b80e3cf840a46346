"""Rule classifiers of references, as ordered conditions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.keys import content_tokens
from refloom.functions.similarity import containment

# Markers of what is no article, for C1.
URL = r"(?i)https?://|www\."
OWN_URL = r"(?i)arxiv\.org|doi\.org|dx\.doi\.org"
ACCESS = r"(?i)\baccessed\b|\bretrieved\b|available (at|from|online)|\blast visited\b"
PATENT = r"(?i)\bpatent\b|\bUS\s?\d{1,2},?\d{3},?\d{3}\b"
THESIS = r"(?i)\bph\.?\s?d\.?\s+(thesis|dissertation)\b|\bmaster'?s? thesis\b|\bdissertation\b|\bdiss\.\s"
REPORT = r"(?i)\btech(nical)?\.?\s*rep(ort|\.)|white paper|working paper|\bpreprint server\b|\bpolicy brief\b"
STANDARD = r"(?i)\bRFC\s?\d+\b|\bISO[/\s-]?\d+|\bIEEE\s+Std\b|\bITU-[RT]\b|\bANSI\b|\brecommendation\s+[A-Z]\.\d+"
SOFTWARE = r"(?i)github\.com|gitlab\.com|\bpypi\b|\bCRAN\b|\bzenodo\.org\b"
PUBLISHER = r"(?i)\b(springer|wiley|elsevier|pearson|mcgraw[- ]hill|academic press|cambridge univ|oxford univ|princeton univ|mit press|crc press|nova science|world scientific)\b"
BOOKISH = r"(?i)\b\d+(st|nd|rd|th)\s+edition\b|\bISBN\b|\b\d{2,4}\s?pp?\.\b|\bchapter\b|\bhandbook\b|\bencyclopedia\b|\bmonograph\b|\bin:\s|\(ed(s|itors)?\.?\)|\bedited by\b|\beds?\.\s|\bsupplementary material\b|\bin\s+[A-Z][a-z]+\s+[IVXL]+\b"
CONFERENCE = r"(?i)\bproceedings\b|\bconf(erence|\.)|\bsymposium\b|\bworkshop\b|\bin proc\b|\bLNCS\b|\bNeurIPS\b|\bICML\b|\bICLR\b|\bCVPR\b|\bECCV\b|\bICCV\b|\bAAAI\b|\bIJCAI\b|\bBMVC\b|\bSIGKDD\b|\bneural information processing\b|\badvances in neural\b|\bcurran associates\b|\bpmlr\b|\bannual meeting\b|\bin\s+proc(\.|eedings)"
AFFILIATION = r"(?i)\b(institute|university|universit[ée]|academy of sciences|department of|faculty of|laborator(y|ies)|school of)\b"
ADDRESS = r"(?i)\b\d{1,4}\s+[A-Z][a-z]+\s+(St|Street|Ave|Avenue|Rd|Road|Blvd)\b|\b\d{5,6},?\s+[A-Z][a-z]+|\bP\.?O\.?\s?Box\b"
CITING = r"(?i)\bvol\.?\s?\d+|\bpp?\.\s?\d+|\(\d{4}\)|\b(19|20)\d{2}[a-z]?[.,;]|\bdoi\s*:|\barxiv\s*:|https?://"
JOURNAL = r"(?i)\bvol\.?\s?\d+|\bno\.?\s?\d+|\bissue\s?\d+|\bdoi\s*:|\barxiv\s*:"
# Markers for C2.
NO_ARTICLE = r"(?i)https?://|www\.|github|gitlab|\bmanual\b|datasheet|white ?paper|documentation|\bwiki\b|readme|user guide|toolkit|repository|\bdataset\b|R package|version \d|technical report|tech\. rep|\bstandard\b|\bRFC\b|patent|\bthesis\b|dissertation|\bhandbook\b|\bencyclopedia\b|lecture notes|market (research|report)|play\.google|app store|\bbook\b|monograph|private communication|to appear|in press"
JUNK = r"(?i)[{}<>]=?|:-|::|\)\s*:|_[a-z]+\(|->|instruction:|\bdef \b|MUST |labels:|score:|### |as an ai\b|let's first|carefully review|respond to the"
JUNK_START = r"(?i)^(proof|remark|definition|lemma|theorem|corollary|note|figure|table|eq|step|a:|q:|based on|use a|share|respond|stay|although|notice that|given that|if a|start-pos|non-empty|email address|affiliated|his main|her main|dr\.)"
DATACITE = r"(?i)10\.48550/|10\.13140/"


def nonacademic_rule(raw: Column, doi: Column, title: Column, journal: Column, volume: Column) -> Column:
    """The first rule that says a reference is no article, or null; a DOI answers all."""
    raw = F.coalesce(raw, F.lit(""))
    has = lambda p: raw.rlike(p)
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    bare = F.length(F.trim(raw))
    return (
        F.when(~missing(doi), None)
        .when(has(URL) & ~has(OWN_URL) & (has(ACCESS) | ~has(JOURNAL)), "url")
        .when(has(SOFTWARE), "software")
        .when(has(ACCESS) & ~has(JOURNAL), "access")
        .when(has(PATENT), "patent")
        .when(has(THESIS), "thesis")
        .when(has(REPORT), "report")
        .when(has(STANDARD), "standard")
        .when((has(PUBLISHER) | has(BOOKISH)) & ~has(JOURNAL) & ~has(CONFERENCE), "book")
        .when(has(AFFILIATION) & has(ADDRESS) & ~has(CITING), "affiliation")
        .when((bare < 15) & missing(title), "debris")
        .when((bare < 60) & ~has(CITING) & missing(journal) & missing(volume), "debris_no_citation")
    )


def not_found_reason(raw: Column, title: Column, doi: Column) -> Column:
    """Why a reference was not found; the first that holds."""
    raw, t = F.coalesce(raw, F.lit("")), F.trim(F.coalesce(title, F.lit("")))
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    foreign = F.length(F.regexp_replace(letters, r"[A-Za-z]", "")) / F.nullif(F.length(letters), F.lit(0))
    return (
        F.when(t == "", "no_title")
        .when(doi.rlike(DATACITE), "datacite_preprint")
        .when(t.rlike(JUNK) | F.substring(raw, 1, 200).rlike(JUNK) | t.rlike(JUNK_START), "parse_junk")
        .when(t.rlike(NO_ARTICLE) | raw.rlike(NO_ARTICLE), "non_article")
        .when(foreign > 0.15, "foreign_language")
        .when(F.size(content_tokens(t)) < 4, "short_title")
        .otherwise("fab_candidate")
    )


def title_hijack(title: Column, matched: Column) -> Column:
    """C4: four content words or more, and less than 0.3 of either title's in the other's; false where it can't be said."""
    a, b = F.array_distinct(content_tokens(title)), F.array_distinct(content_tokens(matched))
    return (F.size(content_tokens(title)) >= 4) & (F.size(b) > 0) & (F.coalesce(containment(a, b), F.lit(1.0)) < 0.3) & (F.coalesce(containment(b, a), F.lit(1.0)) < 0.3)


def author_hijack(raw: Column, authors: Column, matched_title: Column) -> Column:
    """Whether none of the index's authors stands in the reference; null where style or index don't allow to say."""
    tokens = lambda c: F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda w: F.length(w) >= 3)
    mine = tokens(F.coalesce(raw, F.lit("")))
    theirs = F.transform(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.size(tokens(a)) > 0), tokens)
    head = F.substring(raw, 1, 130)
    names = F.filter(F.split(head, r"[^A-Za-z]+"), lambda w: (F.length(w) >= 4) & w.rlike("^[A-Z]") & ~F.array_contains(tokens(F.coalesce(matched_title, F.lit(""))), F.lower(w)))
    initials = head.rlike(r"^\s*(?:[A-Z]\.[-\s]*){1,4}[A-Z]?[a-z]")
    reversed_ = head.rlike(r"^\s*[A-Z][a-z]+\s+[A-Z]\s*,") | head.rlike(r"^\s*[A-Z][a-z]+\s+[A-Z]\.?[,\s]+(?:and\s+)?[A-Z][a-z]+\s+[A-Z]\b[,.\s]")
    short = F.forall(theirs, lambda a: F.array_max(F.transform(a, lambda w: F.length(w))) < 5)
    return F.when((F.length(raw) < 40) | (F.size(theirs) == 0), None).when(F.exists(theirs, lambda a: F.arrays_overlap(a, mine)), False).when(initials | reversed_ | (F.size(names) < 2) | short, None).otherwise(True)


def fab_flag(author: Column, title: Column, found: Column, nonacademic: Column, reason: Column) -> Column:
    """The strongest sign, or null."""
    return F.when(found & author, "author_hijack").when(found & title, "title_hijack").when(~found & ~nonacademic & (reason == "fab_candidate"), "not_found_candidate")


def field_of(category: Column) -> Column:
    """the field of an archive's category."""
    c = F.split_part(category, F.lit("."), F.lit(1))
    return (
        F.when(c.isin("hep-th", "hep-ph", "hep-ex", "hep-lat"), "hep").when(c == "astro-ph", "astro").when(c.isin("q-fin", "econ"), "econ/q-fin").when(c.isin("math", "math-ph"), "math")
        .when(c.isin("cond-mat", "cs", "stat", "eess", "q-bio"), c).otherwise("physics-other")
    )


def cited_band(year: Column) -> Column:
    """the band of a cited year."""
    return F.when(year.isNull(), "unknown").when(year < 1990, "pre1990").when(year < 2000, "1990s").when(year < 2010, "2000s").when(year < 2015, "2010-14").when(year < 2020, "2015-19").otherwise("2020+")


def composition(raw: Column, title: Column, journal: Column) -> Column:
    """What an unresolved reference is made of; the first that holds."""
    has = lambda p: F.coalesce(raw, F.lit("")).rlike(p)
    t = F.trim(F.coalesce(title, F.lit("")))
    return (
        F.when(has(URL) & ~has(OWN_URL), "web").when(has(PATENT), "patent").when(has(REPORT), "techreport").when(has(THESIS), "thesis").when(has(STANDARD), "standard").when(has(PUBLISHER) | has(BOOKISH), "book")
        .when(has(r"(?i)arxiv[:\s]") & (t == ""), "arxiv_id_only").when((t == "") & (F.coalesce(journal, F.lit("")) != ""), "titleless_journal").when(t == "", "no_title_parsed")
        .when(F.length(t) < 15, "parse_damage").otherwise("article_like")
    )


def likelihood(found: Column, journal: Column, volume: Column, pages: Column, year: Column) -> Column:
    """A score from 0 to 1 of how likely an unresolved reference is invented; null for found ones."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    score = F.lit(0.30) + F.when(filled(journal), 0.25).otherwise(0.0) + F.when(filled(journal) & filled(volume) & filled(pages), 0.20).otherwise(0.0) + F.when(year >= 2020, 0.20).when(year < 2005, -0.15).otherwise(0.0)
    return F.when(~found, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def style_of(c: Column) -> Column:
    """the style of a printed reference; the first that fits."""
    return (
        F.when(c.rlike(r"^\s*\[\d+\]"), "ieee").when(c.rlike(r"\d{4};\s*\d*(?:\(\d+\))?:"), "vancouver").when(c.rlike(r"\(\d{4}[a-z]?\)\.\s"), "apa")
        .when(c.rlike(r"[\"“].+[\"”].*\(\d{4}\)"), "chicago").when(c.rlike(r"[\"“].+[\"”].*\b\d{4}\b"), "mla").otherwise("unknown")
    )


def metadata_issues(year: Column, journal: Column, volume: Column, author_words: Column, their_year: Column, their_journal: Column, their_volume: Column, their_author: Column) -> Column:
    """What of a reference disagrees with its record: identities of journals, keys of volumes; what is missing never does."""
    issue = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(issue(F.abs(year - their_year) > 1, "year"), issue(journal != their_journal, "journal"), issue(volume != their_volume, "volume"), issue((F.size(author_words) > 0) & ~F.array_contains(author_words, their_author), "author")))


def is_mismatch(issues: Column) -> Column:
    """Two issues, or one that isn't the year."""
    return (F.size(issues) >= 2) | F.exists(issues, lambda x: x != "year")


def parse_flaws(title: Column, journal: Column, year: Column, parsed_year: Column, authors: Column) -> Column:
    """What speaks for an error in parsing."""
    t = F.trim(F.coalesce(title, F.lit("")))
    flaw = lambda c, name: F.when(c, F.lit(name))
    own = F.lower(t) == F.lower(F.trim(F.coalesce(journal, F.lit(""))))
    return F.array_compact(F.array(
        flaw(t == "", "no_title"), flaw(t.rlike(r"^[0-9]{4}[a-z]?$"), "title_is_year"), flaw((t != "") & own, "title_is_journal"), flaw(F.length(t).between(1, 9), "short_title"),
        flaw(parsed_year.isNull() & (F.trim(F.coalesce(year, F.lit(""))) != ""), "bad_year"), flaw(F.coalesce(authors, F.lit("")).rlike("[0-9@]"), "bad_author"), flaw(F.coalesce(title, F.lit("")).rlike("[{}<>]"), "noise"),
    ))


#: Codes of the labels that reasons stand for.
REASON_LABELS = {"no_title": "NR", "datacite_preprint": "PP", "parse_junk": "NR", "non_article": "RP", "foreign_language": "JA", "short_title": "JA", "fab_candidate": "JA"}


def label_of(reason: Column) -> Column:
    """C17: the label of a reason."""
    return F.create_map(*[F.lit(x) for kv in REASON_LABELS.items() for x in kv])[reason]
