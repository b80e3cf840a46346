"""Scanned entries made continuous and readable: furniture of the page out, cut words joined, misread characters put right.

Skip-gram vectors are learned over all entries; a word is linked to the more frequent words that plausible glyph edits
make of it (equality of glyph skeletons, so no pairs of words are tried out), and of several the one that fits best into
its context is taken.  It is a misread word if the linked one fits its context well enough, is much more frequent, and no
entry's fields have the word as it stands; what the entry's own fields show in the linked form is misread however well it
fits.  Lines that belong to the page are removed and the rest is reflowed.

Defined results: null gives null, '' and blank give ''; an entry without line ends has no page to come from and stays as
it is but for misread words; an entry may be nothing but furniture and is then ''.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.lookalike import canonical
from refloom.operators.packed import let
from refloom.session import cut

# Characters that scanners take for others, and the one that stands for both in a skeleton.
GLYPHS, SKELETON = "@!051|l+$9£8c", "aiosiiitsgfbe"
# The same for groups of characters.
GROUPS = (("vv", "w"), ("rn", "m"), ("h", "ii"), ("tt", "ii"), ("u", "ii"), ("d", "ei"))
#: How much more frequent, in entries and fields, the word must be that a rarer one is linked to; and how much more in
#: entries alone, and how near to its context, where the entry's own fields don't show it.
RATIO, RARE, FIT = 2, 8, 0.1
#: Size of the vectors, words that get one (the count is a share of all words, at least two).
DIMENSIONS, MIN_SHARE = 24, 1e-5

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,40}>")
_WORD = re.compile(r"[^\W\d_@!+$£|](?:[^\W_]|[@!+$£|])+|[@!+$£|0-9](?:[^\W_]|[@!+$£|])*[^\W\d_@!+$£|](?:[^\W_]|[@!+$£|])*")
_MARKS = "-¬\u00ad‐‑"
_PAGE = re.compile(r"^(?:page\s+\d+\s+of\s+\d+|(?:page|p\.|s\.)\s*\d+|[-—–]\s*\d+\s*[-—–]|\[\s*\d+\s*\]|\(\s*\d+\s*\)|\d{1,4}|[ivxlc]+)$", re.IGNORECASE)
_FURNITURE_WORDS = frozenset("references bibliography literature cited notes contents continued index appendix".split())
_STRONG = re.compile(r"^(?:references|bibliography|literature cited|notes|contents|appendix)(?: \(continued\))?$|^.{2,60} and others\b.*:", re.IGNORECASE)
_ET_AL = re.compile(r"\bET AL\.?$")
_VOLUME = re.compile(r"^[^\d]{4,80}, vol\. ?\d+$", re.IGNORECASE)
_NEUTRAL = frozenset("vol pp no and und et the art".split())
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


_TO_SKELETON = str.maketrans(GLYPHS, SKELETON)


@lru_cache(maxsize=1 << 16)
def skeleton(word: str) -> str:
    word = word.lower().translate(_TO_SKELETON)
    for a, b in GROUPS:
        word = word.replace(a, b)
    return word


def skeleton_column(c: Column) -> Column:
    c = F.translate(F.lower(c), GLYPHS, SKELETON)
    for a, b in GROUPS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _cut_end(text: str) -> tuple[str, int] | None:
    """The begun word and the place of the mark, if the text ends with a mark behind a word with letters."""
    end = len(text.rstrip(" \t"))
    if not end or text[end - 1] not in _MARKS:
        return None
    at = end - 1
    while at and not text[at - 1].isspace():
        at -= 1
    word = text[at : end - 1]
    return (word, end - 1) if any(c.isalpha() for c in word) else None


def repair_page(citation: str, fields: str, journal: str | None = "?") -> tuple[str, bool, bool, bool, str]:
    """(text without furniture, reflowed; whether words were cut, a header, a page number stood in it; fields in one form)."""
    known = canonical(_TAG.sub(" ", _ESCAPE.sub(lambda m: chr(int(m[1], 16)), fields)))
    known_words = {skeleton(w) for w in _words(known)}
    joined_words = {skeleton(w) for w in re.findall(r"[^\s.,;:()\[\]\"“”'’<>/|]+", known.lower())}
    numbers = Counter(re.findall(r"\d+", known))
    lines = [x.strip(" \t\f\v ") for x in re.split(r"\r\n|\r|\n", _TAG.sub(" ", citation))]
    in_text = Counter(skeleton(w) for w in _words(" ".join(lines)))
    digits = Counter(re.findall(r"\d+", " ".join(lines)))
    header = page = hyphen = False

    def is_page(x: str) -> bool:
        if not _PAGE.match(x):
            return False
        found = re.findall(r"\d+", x)
        if not found:
            return x.islower() and x.upper() not in fields
        # A number of the entry's own fields is its own, unless it stands there once more.
        return "of" in x.lower() or all(n not in numbers or digits[n] > max(1, numbers[n]) for n in found)

    def is_header(x: str, before: str) -> bool:
        if _STRONG.match(x) or (x.isupper() and _ET_AL.search(x)):
            return True
        words = _words(x)
        seen = [in_text[skeleton(w)] > 1 or skeleton(w) not in known_words for w in words if len(w) > 2 and w not in _NEUTRAL]
        if _VOLUME.match(x) and seen and all(seen):
            return True
        if before and words:
            words = words[1:]
        if x and x[-1] in _MARKS and words:
            words = words[:-1]
        words = [w for w in words if len(w) > 2 and w not in _NEUTRAL]
        if not words:
            return False
        strange = [w for w in words if skeleton(w) not in known_words]
        if len(words) == 1:
            return bool(strange) and words[0] in _FURNITURE_WORDS and len(x) < 25
        # Words of the entry's fields that stand nowhere else speak for a line of the entry.
        if any(skeleton(w) in known_words and in_text[skeleton(w)] < 2 and len(w) > 3 for w in words):
            return False
        if len(strange) >= 0.6 * len(words):
            # Where the journal's name is missing from the fields, a name may be it; a remark has words in lower case.
            return bool((journal or "").strip()) or x.isupper() or sum(w.islower() for w in re.findall(r"[^\W\d_]{4,}", x)) >= 3
        # The journal's name once more, in capitals or with a volume of its own.
        again = all(in_text[skeleton(w)] > 1 or w in strange for w in words)
        return again and (x.isupper() or re.search(r", vol\. ?\d+$", x, re.IGNORECASE) is not None)

    kept: list[str] = []
    for line in lines:
        if not line:
            continue
        before = kept[-1] if kept and _cut_end(kept[-1]) else ""
        parts = [p for p in re.split(r" {2,}|\t+", line) if p]
        ends = [i for i in (0, len(parts) - 1) if len(parts) > 1 and is_page(parts[i])]
        if is_page(line):
            page = True
        elif ends and is_header(" ".join(p for i, p in enumerate(parts) if i != ends[0]), ""):
            header = page = True
        elif is_header(line, before):
            header = True
        else:
            kept.append(line)
    text = ""
    for line in kept:
        m = _cut_end(text)
        tail = re.match(r"[^\s.,;:()\[\]\"“”'’]+", line)
        if m and tail and re.match(r"[^\W\d_]|[@!+$£|0-9]+[^\W\d_]", line):
            first, mark = re.split(r"[(“\"]", m[0])[-1].lower(), text[m[1]]
            whole, own = first + tail[0].lower(), f"{first}{mark}{tail[0].lower()}"
            soft = mark in "¬\u00ad"
            plain = {skeleton(w) for w in re.split(r"[\-¬\u00ad‐‑]", whole)}
            is_own = skeleton(own) in joined_words or skeleton(first + mark) in joined_words
            if soft or (not is_own and (skeleton(whole) in joined_words or plain <= known_words or any(w.startswith(skeleton(first)) and len(w) > len(first) for w in known_words))):
                hyphen = True
                text = text[: m[1]] + line
                continue
            text = text[: m[1] + 1] + line
            continue
        if text and text[-1] in "-–" and line[:1].isdigit():
            text += line
        else:
            text = f"{text} {line}" if text else line
    return text, hyphen, header, page, known


PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("hyphenation", T.BooleanType()), T.StructField("header", T.BooleanType()), T.StructField("page_number", T.BooleanType()), T.StructField("known", T.StringType())])
FOUND = ("hyphenation", "header", "page_number")


@F.pandas_udf(PAGE)
def _repair(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for citations, fields, journals in parts:
        yield pd.DataFrame([repair_page(*x) for x in zip(citations, fields, journals)], columns=PAGE.fieldNames())


def _tokens(text: Column) -> Column:
    """Words in lower case, glyphs inside kept, other punctuation at their ends dropped."""
    plain = F.regexp_replace(F.lower(text), r"</?[a-z][^<>]{0,40}>|[.,;:()\[\]\"“”'’<>/]", " ")
    return F.filter(F.split(plain, r"[\s ]+"), lambda w: w.rlike(r"\p{L}"))


def repair(df: DataFrame, key: str, citation: str, fields: list[str], journal: str) -> DataFrame:
    """(key, text, hyphenation, header, page_number, misread) for each distinct entry; text is continuous."""
    c = F.col(f"`{citation}`")
    rows = df.select(F.col(key).alias("key"), c.alias("citation"), F.concat_ws(" ", *[F.col(f"`{f}`").cast("string") for f in fields]).alias("fields"), F.col(f"`{journal}`").alias("journal")).filter(c.isNotNull()).distinct()
    paged = F.col("citation").rlike(r"[\r\n]")
    plain = rows.filter(~paged).select("key", F.col("citation").alias("text"), "fields", *[F.lit(False).alias(n) for n in FOUND])
    scanned = rows.filter(paged).withColumn("r", _repair("citation", "fields", "journal")).select("key", "r.text", F.col("r.known").alias("fields"), *[f"r.{n}" for n in FOUND])
    both = cut(plain.unionByName(scanned).withColumn("rid", F.xxhash64("key", "text", "fields")).withColumn("words", _tokens(F.col("text"))))

    # How often each word stands in entries (n) and in fields (f).
    each = lambda words, own: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(own).alias("own")))
    stands = both.select(F.explode(F.concat(each(F.col("words"), False), each(_tokens(F.col("fields")), True))).alias("x")).select("x.w", "x.own")
    counts = cut(stands.groupBy("w").agg(F.count_if(~F.col("own")).alias("n"), F.count_if("own").alias("f")).withColumn("skeleton", skeleton_column(F.col("w"))))
    # Links: words of one skeleton, the rarer to the more frequent.
    shared = counts.join(counts.groupBy("skeleton").agg(F.count("*").alias("k")).filter("k > 1").select("skeleton"), "skeleton")
    links = shared.filter("n > 0").select("skeleton", "w", "n", "f").join(shared.select("skeleton", F.col("w").alias("to"), F.col("n").alias("m"), F.col("f").alias("g")), "skeleton")
    links = links.filter((F.col("w") != F.col("to")) & (F.col("m") + F.col("g") >= RATIO * F.col("n")) & F.col("to").rlike(r"^[\p{L}\p{M}-]+$"))
    links = links.select("w", "to", "m", ((F.col("f") == 0) & (F.col("m") >= RARE * F.col("n"))).alias("rare"))

    # Words that the row's own fields show as they stand are no errors of the scanner.
    places = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    strange = let(_tokens(F.col("fields")), lambda own: F.filter(places, lambda x: ~F.array_contains(own, x["w"])))
    # The outer form keeps the optimizer from computing the array again in an inferred filter.
    strange = both.select("rid", "fields", "words", F.explode_outer(strange).alias("p")).filter(F.col("p").isNotNull())
    around = F.transform(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)]), lambda d: F.when(F.col("p.i") + d >= 0, F.get("words", F.col("p.i") + d)))
    strange = strange.select("rid", "fields", "p.w", F.filter(around, lambda w: w.isNotNull()).alias("context"))
    linked = cut(strange.join(links, "w"))

    total = counts.agg(F.sum("n")).first()[0] or 0  # one row
    scored = linked.withColumn("fit", F.lit(0.0))
    if total and not linked.isEmpty():
        least = max(2, int(MIN_SHARE * total))
        model = Word2Vec(vectorSize=DIMENSIONS, minCount=least, maxIter=1, numPartitions=6, windowSize=2, seed=5, inputCol="words", outputCol="v").fit(both.select("words"))
        vectors = model.getVectors().select(F.col("word"), F.vector_to_array("vector").alias("v")) if hasattr(F, "vector_to_array") else _as_arrays(model.getVectors())
        around = linked.select("rid", "w", F.explode("context").alias("word")).distinct().join(vectors, "word")
        around = around.groupBy("rid", "w").agg(*[F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(DIMENSIONS)]).select("rid", "w", F.array(*[f"c{i}" for i in range(DIMENSIONS)]).alias("c"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        scored = linked.join(around, ["rid", "w"], "left").join(vectors.withColumnRenamed("word", "to"), "to", "left")
        scored = scored.withColumn("fit", F.coalesce(dot("v", "c") / F.greatest(F.sqrt(dot("v", "v") * dot("c", "c")), F.lit(1e-9)), F.lit(0.0)))
    # Corrected in context: the linked word that fits best, the more frequent one where they fit alike; words of the row's fields first.
    shown = F.array_contains(_tokens(F.col("fields")), F.col("to"))
    sure = shown | (F.col("rare") & (F.col("fit") >= FIT))
    best = scored.withColumn("shown", shown).withColumn("sure", sure).groupBy("rid", "w").agg(F.max_by(F.struct("to", "sure"), F.struct("shown", F.round("fit", 3), "m", "to")).alias("b")).select("rid", "w", "b.to", "b.sure")
    fixes = best.groupBy("rid").agg(F.collect_list(F.struct("w", "to")).alias("fixes"), F.max("sure").alias("misread"))
    out = both.join(fixes, "rid", "left")
    text = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<w:string,to:string>>")), F.col("text"), lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}@!+$£|-])\Q"), x["w"], F.lit(r"\E(?![\p{L}\p{N}@!+$£|-])")), x["to"]))
    return out.select(F.col("key").alias(key), text.alias("text"), *FOUND, F.coalesce("misread", F.lit(False)).alias("misread"))


def _as_arrays(vectors: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return vectors.select("word", vector_to_array("vector").alias("v"))


def flaws(repaired: DataFrame, key: str) -> DataFrame:
    """(key, flaw), one row for each kind found."""
    kinds = ("hyphenation", "misread", "header", "page_number")
    each = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]))
    return repaired.select(key, F.explode(each).alias("flaw")).distinct()
