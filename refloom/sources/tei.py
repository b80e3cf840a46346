"""TEI and text sources: bibliographies of parsed papers, one row per reference."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = "{http://www.tei-c.org/ns/1.0}"
_YEAR = re.compile(r"\b(1[89]\d{2}|20[012]\d)\b")
REFERENCE = T.StructType([T.StructField(n, T.IntegerType() if n == "year" else T.StringType()) for n in ("xml_id", "title", "journal", "year", "volume", "first_page", "first_author", "doi", "raw")])


def _text(node) -> str | None:
    t = " ".join("".join(node.itertext()).split()) if node is not None else ""
    return t or None


def parse_bibliography(xml: str | None) -> list[tuple]:
    """The references of one document; none for malformed XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    out = []
    for b in root.iter(f"{_NS}biblStruct"):
        titles = {t.get("level"): _text(t) for t in reversed(list(b.iter(f"{_NS}title")))}
        title = next((t for t in (titles.get("a"), titles.get("j"), titles.get("m")) if t and len(t.split()) >= 2), None)
        journal = titles.get("j") if titles.get("j") != title else None
        date = b.find(f".//{_NS}date")
        year = _YEAR.search(f"{date.get('when') or ''} {_text(date) or ''}") if date is not None else None
        scopes = {s.get("unit"): s for s in b.iter(f"{_NS}biblScope")}
        page = scopes.get("page")
        first = (page.get("from") or re.split(r"[-–]", _text(page) or "")[0].strip() or None) if page is not None else None
        doi = next((_text(i) for i in b.iter(f"{_NS}idno") if i.get("type") == "DOI"), None)
        doi = re.sub(r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "", doi.strip(), flags=re.I).rstrip(".,;)").lower() if doi else None
        raw = next((_text(n) for n in b.iter(f"{_NS}note") if n.get("type") == "raw_reference"), None)
        out.append((b.get("{http://www.w3.org/XML/1998/namespace}id"), title, journal if journal and len(journal) > 2 else None, int(year[1]) if year else None, _text(scopes.get("volume")), first, _text(b.find(f".//{_NS}surname")), doi, raw))
    return out


@F.pandas_udf(T.ArrayType(REFERENCE))
def _parse(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = REFERENCE.fieldNames()
    for s in parts:
        yield s.map(lambda x: [dict(zip(names, r)) for r in parse_bibliography(x)])


def references(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, i, fields): the references of every document, in order."""
    return documents.select(key, F.posexplode(_parse(F.col(xml))).alias("i", "r")).select(key, "i", "r.*")


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """S1 over files: one document a file."""
    return references(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), "file", "value")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, compressed or not, by an explicit schema; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


CROSSREF = "DOI string, title array<string>, `container-title` array<string>, volume string, page string, `article-number` string, author array<struct<family:string,given:string>>, issued struct<`date-parts`:array<array<int>>>, published struct<`date-parts`:array<array<int>>>"


def biblio_rows(crossref: DataFrame) -> DataFrame:
    """Rows of the bibliographic index; without DOI, journal, or year and volume a record gives none."""
    from refloom.functions.keys import journal_key

    year = F.coalesce(*[F.try_element_at(F.try_element_at(F.col(f"{c}.date-parts"), F.lit(1)), F.lit(1)) for c in ("published", "issued")])
    rows = crossref.select(F.lower("DOI").alias("doi"), journal_key(F.try_element_at("container-title", F.lit(1))).alias("journal_norm"), year.alias("year"), "volume", F.regexp_extract("page", r"^([^-–]+)", 1).alias("first_page"), F.col("article-number").alias("article_num"), F.try_element_at("author", F.lit(1))["family"].alias("author1"))
    return rows.filter(F.col("doi").isNotNull() & (F.coalesce("journal_norm", F.lit("")) != "") & F.col("year").isNotNull() & F.col("volume").isNotNull())


def authority_from_records(journals: DataFrame) -> DataFrame:
    """(identity, display_name, abbreviated, alternates) of records with synonyms and their details."""
    names = F.array_distinct(F.concat(F.coalesce("synonyms", F.array().cast("array<string>")), F.coalesce(F.transform("synonyms_detail", lambda d: d["name"]), F.array().cast("array<string>"))))
    return journals.select("identity", "display_name", F.lit(None).cast("string").alias("abbreviated"), names.alias("alternates"))


def journal_authority(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, acronym) from (identity, display_name, abbreviated, alternates)."""
    from refloom.functions.keys import acronym, journal_key

    names = F.explode(F.array_compact(F.concat(F.array("display_name", "abbreviated"), F.coalesce("alternates", F.array().cast("array<string>")))))
    alias = sources.select("identity", names.alias("n")).select(journal_key(F.col("n")).alias("name_norm"), "identity").filter("name_norm <> ''").distinct()
    return alias, sources.select(acronym(F.col("display_name")).alias("acr"), "identity").filter(F.col("acr").isNotNull()).distinct()


def write_by_month(rows: DataFrame, path: str) -> None:
    """Rows by month; only the months written are replaced, so a run again repeats nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


CROSSREF_LIST = "reference array<struct<DOI:string,unstructured:string,`article-title`:string,`volume-title`:string,`journal-title`:string,year:string,volume:string,`first-page`:string,author:string>>"


def crossref_references(works: DataFrame, key: str) -> DataFrame:
    """S3: (key, i, doi, title, journal, year, volume, first_page, author, raw) of the reference lists of Crossref records."""
    from refloom.functions.keys import doi_key
    from refloom.functions.text import doi_in

    r = works.select(key, F.posexplode("reference").alias("i", "r"))
    c = lambda n: F.col("r").getField(n)
    first = F.regexp_extract(c("first-page"), r"^([^-–]+)", 1)
    return r.select(key, "i", F.coalesce(doi_key(c("DOI")), doi_in(c("unstructured"))).alias("doi"), F.coalesce(c("article-title"), c("volume-title")).alias("title"), c("journal-title").alias("journal"), F.try_to_number(F.nullif(F.regexp_extract(c("year"), r"(1[89]\d{2}|20[012]\d)", 1), F.lit("")), F.lit("9999")).cast("int").alias("year"), c("volume").alias("volume"), F.nullif(first, F.lit("")).alias("first_page"), F.trim(F.split_part(c("author"), F.lit(","), F.lit(1))).alias("author"), c("unstructured").alias("raw"))


def demoted_titles(refs: DataFrame, names: DataFrame) -> DataFrame:
    """References whose journal stands in the place of the title put right; names holds the ``name`` keys of journals.

    A title that is the journal, or a known journal (also without a number behind it), becomes the journal; of "head.
    Journal" with a known journal and a head of three words or more the head is the title.
    """
    from refloom.functions.keys import journal_key

    known = names.select(F.col("name").alias("__k")).distinct().withColumn("__known", F.lit(True))
    head, tail = F.regexp_extract("title", r"(?s)^(.*)\. ([^.]+)\.?$", 1), F.regexp_extract("title", r"(?s)^(.*)\. ([^.]+)\.?$", 2)
    r = refs.withColumn("__whole", journal_key(F.regexp_replace("title", r"[\s,]*\d+\s*$", ""))).withColumn("__tail", journal_key(tail))
    for c in ("__whole", "__tail"):
        r = r.join(known.select(F.col("__k").alias(c), F.col("__known").alias(f"{c}_known")), c, "left")
    same = F.lower(F.trim("title")) == F.lower(F.trim("journal"))
    as_journal = F.coalesce(same, F.lit(False)) | F.coalesce("__whole_known", F.lit(False))
    split = F.coalesce("__tail_known", F.lit(False)) & (F.size(F.split(F.trim(head), r"\s+")) >= 3)
    title = F.when(as_journal, None).when(split, head).otherwise(F.col("title"))
    journal = F.when(as_journal, F.coalesce(F.nullif(F.trim("journal"), F.lit("")), F.col("title"))).when(split, F.coalesce(F.nullif(F.trim("journal"), F.lit("")), tail)).otherwise(F.col("journal"))
    return r.withColumns({"title": title, "journal": journal}).select(*refs.columns)


def parse_jats(xml: str | None) -> list[tuple]:
    """(title, journal, year, volume, first page, first surname, DOI, text) of each reference of a JATS article."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    out = []
    for ref in root.iter("ref"):
        c = next((x for n in ("element-citation", "mixed-citation", "citation") for x in ref.iter(n)), ref)
        one = lambda n: _text(c.find(f".//{n}"))  # noqa: B023, E731
        doi = next((_text(i) for i in c.iter("pub-id") if i.get("pub-id-type") == "doi"), None)
        year = _YEAR.search(one("year") or "")
        out.append((one("article-title"), one("source"), int(year[1]) if year else None, one("volume"), one("fpage"), one("surname"), doi.lower() if doi else None, _text(c)))
    return out


JATS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "year" else T.StringType()) for n in ("title", "journal", "year", "volume", "first_page", "first_author", "doi", "raw")]))


@F.pandas_udf(JATS)
def _jats(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = JATS.elementType.fieldNames()
    for s in parts:
        yield s.map(lambda x: [dict(zip(names, r)) for r in parse_jats(x)])


def jats_references(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, i, fields) of JATS articles."""
    return documents.select(key, F.posexplode(_jats(F.col(xml))).alias("i", "r")).select(key, "i", "r.*")


def segmented(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, reference) of pages of references: line numbers out, lines that hang joined to the one they belong to."""
    lines = F.split(F.regexp_replace(text, r"(?m)^\s*\d{1,4}\s{2,}", ""), r"\r?\n")
    # A reference begins at the margin with a capital or a number; what is indented or begins small goes on.
    marked = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.when(x.rlike(r"^(?:\[?\d+[\].]?\s+)?\p{Lu}"), F.concat(F.lit("\x1e"), F.trim(x))).otherwise(F.concat(F.lit(" "), F.trim(x))))
    joined = F.split(F.regexp_replace(F.array_join(marked, ""), r"(\p{Ll})- (\p{Ll})", "$1$2"), "\x1e")
    one = F.filter(F.transform(joined, F.trim), lambda x: F.length(x) > 0)
    return documents.select(key, F.posexplode_outer(one).alias("i", "reference")).filter("reference IS NOT NULL")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited files with a header, by an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def write_tsv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order, tabs between, by ranges of the first columns."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def report(rows: DataFrame, fields: list[str], width: int = 24) -> DataFrame:
    """(line) of a plain text report, one for each row."""
    cells = [F.rpad(F.substring(F.coalesce(F.col(f).cast("string"), F.lit("-")), 1, width), width, " ") for f in fields]
    return rows.select(F.rtrim(F.concat_ws(" ", *cells)).alias("line"))


def publishable(sentences: DataFrame, headers: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Keys of documents worth writing: ``least`` sentences, a title, an author and a citing sentence; columns
    sentences(key, citing), headers(key, title, authors)."""
    n = sentences.groupBy(key).agg(F.count("*").alias("n"), F.count_if("citing").alias("citing")).filter((F.col("n") >= least) & (F.col("citing") > 0))
    h = headers.filter((F.coalesce(F.trim("title"), F.lit("")) != "") & (F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0))
    return n.join(h, key, "left_semi").select(key)
