"""Values typed freely, mapped to the one entry of a reference list that they name.

Partition-based pigeonhole join: a reference string that may differ in k edits is cut into k + 1 segments, one of which
must stand unchanged in the value, near its own place.  Segments and the substrings of values at those places are joined
by equality, the pairs verified with the built-in levenshtein, and what is left over comes from an anti-join.  Built-in
functions only, so all of it stays in the JVM; values are made distinct first, so a frequent value costs as much as a
rare one, and written once, since several joins read them.

Short forms of words are learned from the list: words that the full names of several entries have in common (journal,
annals, letters and the like) are what a shorter word means that is no word of the list itself, if it begins just one of
them, or holds letters of just one in their order, from the first.

Defined results: null and blank values give no row; a value that comes equally close to several identities, and an
acronym of several, is unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.keys import deaccent, journal_key
from refloom.session import cut

#: Identities whose full names must have a word in common for it to be what short forms mean.
COMMON = 2
STOP = r"\b(?:of|in|on|the|and|for|to|de|der|des|du|la|le|für)\b"
#: What may follow a name: an edition, a volume.
_TAIL = r"(?i)[\s,;:.\[(]*(?:\b(?:online|print|new ser(?:ies)?|n\.? ?s|formerly new series|vol(?:ume)?\.?\s*\d+[a-z]?|no\.?\s*\d+|\d+(?:\s*\(\d+\))?))[\])\s.,;]*$"
#: Most edits between a value and a reference string.
MOST_EDITS = 4


def edits(length: Column, full: Column) -> Column:
    """Edits that a reference string of this length may differ in; short forms have few letters to spare."""
    return F.when(full & (length >= 14), 4).when(full & (length >= 10), 3).when(length >= 7, 2).otherwise(0)


def _close(body: Column, form: Column, k: Column) -> Column:
    """The distance, where it is small enough: the last edit only counts between strings of the same letters (swaps)."""
    distance = F.levenshtein(body, form)
    letters = F.array_sort(F.split(body, "")) == F.array_sort(F.split(form, ""))
    return F.when((distance < k) | (distance == 0) | ((distance == k) & letters), distance)


def _name(c: Column) -> Column:
    """The normal form without what follows the name, inversions turned round, words run together cut at capitals."""
    c = F.regexp_replace(F.trim(c), _TAIL, "")
    c = F.regexp_replace(c, _TAIL, "")
    c = F.regexp_replace(c, r"(?s)^([^,]+),\s*(.*\b(?:of|in|on|for|de|der))\s*$", "$2 $1")
    c = F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return deaccent(journal_key(c))


def _letter(name: Column) -> Column:
    return F.regexp_extract(name, r" ([a-h])$", 1)


def expanded(names: DataFrame, full: DataFrame) -> DataFrame:
    """(name, text): distinct names without their section letter, short forms of words written out; full has the names of
    the list in full, with their ``identity``."""
    words = lambda c: F.filter(F.split(F.regexp_replace(c, r" [a-h]$", ""), " "), lambda w: w != "")
    listed = full.select("identity", F.explode(words(F.col("name"))).alias("long")).groupBy("long").agg(F.count_distinct("identity").alias("n"))
    long = listed.filter((F.length("long") > 3) & ~F.col("long").rlike(rf"^{STOP}$")).select("long", "n", F.substring("long", 1, 1).alias("first"))
    each = names.select("name").filter("name IS NOT NULL").distinct().select("name", F.posexplode(words(F.col("name"))).alias("i", "w"))
    short = each.select("w").filter(~F.col("w").rlike(rf"^{STOP}$")).distinct().join(listed.select(F.col("long").alias("w")), "w", "left_anti")
    # A plural of a short form ends like one.
    stem = F.when(F.length("w") > 2, F.regexp_replace("w", "s$", "")).otherwise(F.col("w"))
    met = short.withColumn("first", F.substring("w", 1, 1)).join(long, "first").filter(F.length("w") < F.length("long"))
    begins = F.startswith("long", stem)
    inside = (F.length("w") > 1) & F.rlike("long", F.concat(F.lit("^"), F.regexp_replace("w", r"(\w)", "$1.*")))
    best = met.withColumn("rank", F.when(begins, 0).when(inside, 1)).filter("rank IS NOT NULL").groupBy("w").agg(F.collect_set(F.struct("rank", "long", "n")).alias("all"))
    first = F.filter("all", lambda x: x["rank"] == F.array_min("all")["rank"])
    means = best.select("w", first.alias("f")).filter((F.size("f") == 1) & (F.get("f", F.lit(0))["n"] >= COMMON)).select("w", F.get("f", F.lit(0))["long"].alias("long"))
    told = each.join(means, "w", "left").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("long", "w").alias("w")))).alias("ws"))
    return told.select("name", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("text"))


def _body(text: Column) -> Column:
    """What is compared: small words and blanks dropped."""
    return F.replace(F.regexp_replace(text, STOP, ""), F.lit(" "), F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, STOP, " "), " "), lambda w: w != "")


def _stem_key(words: Column) -> Column:
    """Equal for a name and its forms with words cut short after three letters or more."""
    return F.concat_ws(" ", F.transform(words, lambda w: F.substring(w, 1, 3)))


def shown_names(journal: DataFrame) -> DataFrame:
    """(identity, name): the names in full."""
    return journal.select("identity", deaccent(journal_key(F.col("display_name"))).alias("name")).filter(F.col("name").isNotNull() & F.col("identity").isNotNull()).distinct()


def reference_names(alias: DataFrame, journal: DataFrame) -> DataFrame:
    """(identity, name): the names of the list."""
    return alias.select("identity", deaccent(F.col("name_norm")).alias("name")).filter(F.col("name").isNotNull() & F.col("identity").isNotNull()).unionByName(shown_names(journal)).distinct()


def with_fullness(names: DataFrame, shown: DataFrame) -> DataFrame:
    """(name, text, letter, identity, full): full says that none of the name's words is cut short; names have their text."""
    longest = names.join(shown, ["identity", "name"], "left_semi").groupBy("identity").agg(F.max(F.length(_body(F.col("text")))).alias("longest"))
    full = F.length(_body(F.col("text"))) >= F.coalesce(F.col("longest"), F.lit(0)) - 1
    return names.join(longest, "identity", "left").select("name", "text", _letter(F.col("name")).alias("letter"), "identity", full.alias("full"))


def reference_forms(names: DataFrame) -> DataFrame:
    """(form, letter, identity, full): every string a name may be compared with, without and with its small words."""
    whole = names.select(_body(F.col("text")).alias("form"), "letter", "identity", "full")
    together = names.select(F.replace("text", F.lit(" "), F.lit("")).alias("form"), "letter", "identity", "full")
    return whole.unionByName(together).filter(F.length("form") > 0).groupBy("form", "letter", "identity").agg(F.max("full").alias("full"))


def _place(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of segment i of k + 1; the last ones take the rest."""
    base, rest = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
    longer = F.greatest(F.lit(0), i - 1 - (k + 1 - rest))
    return (i - 1) * base + longer + 1, base + F.when(i > k + 1 - rest, 1).otherwise(0)


def _segments(forms: DataFrame) -> DataFrame:
    """The k + 1 segments of every form: (form_length, k, i, segment)."""
    s = forms.withColumn("form_length", F.length("form")).withColumn("k", edits(F.col("form_length"), F.col("full")))
    s = s.select("*", F.explode(F.sequence(F.lit(1), F.col("k") + 1)).alias("i"))
    start, size = _place(F.col("form_length"), F.col("k"), F.col("i"))
    return s.withColumn("segment", F.substring(F.col("form"), start, size))


def _probes(values: DataFrame) -> DataFrame:
    """The substrings of every body where a segment of a form of some length could stand, for each number of edits."""
    p = values.withColumn("n", F.length("body")).select("body", "letter", "n", F.explode(F.sequence(F.lit(-MOST_EDITS), F.lit(MOST_EDITS))).alias("d"))
    p = p.withColumn("form_length", F.col("n") - F.col("d")).filter(F.col("form_length") > 0)
    p = p.select("*", F.explode(F.array_distinct(F.array(edits(F.col("form_length"), F.lit(True)), edits(F.col("form_length"), F.lit(False))))).alias("k"))
    p = p.filter(F.abs("d") <= F.col("k"))
    p = p.select("*", F.explode(F.sequence(F.lit(1), F.col("k") + 1)).alias("i"))
    start, size = _place(F.col("form_length"), F.col("k"), F.col("i"))
    p = p.withColumn("start", start).withColumn("size", size)
    left, right = F.col("i") - 1, F.col("k") + 1 - F.col("i")
    low = F.greatest(F.lit(1), F.col("start") - left, F.col("start") + F.col("d") - right)
    high = F.least(F.col("n") - F.col("size") + 1, F.col("start") + left, F.col("start") + F.col("d") + right)
    p = p.withColumn("low", low).withColumn("high", high).filter(F.col("low") <= F.col("high"))
    p = p.select("body", "letter", "form_length", "k", "i", "size", F.explode(F.sequence("low", "high")).alias("at"))
    return p.select("body", "letter", "form_length", "k", "i", F.substring(F.col("body"), F.col("at"), F.col("size")).alias("segment"))


def _one(identity: str = "identity") -> Column:
    return F.when(F.count_distinct(identity) == 1, F.min(identity))


def resolve(values: DataFrame, column: str, alias: DataFrame, acronym: DataFrame, journal: DataFrame) -> DataFrame:
    """(value, identity) for each distinct value that is not blank; identity is 'unmatched' where none or several fit."""
    v = values.select(F.col(f"`{column}`").alias("value")).filter(F.length(F.trim("value")) > 0).distinct().withColumn("name", _name(F.col("value")))
    names, shown = reference_names(alias, journal), shown_names(journal)
    texts = cut(expanded(v.select("name").unionByName(names.select("name")), shown))
    names = cut(with_fullness(names.join(texts, "name"), shown))
    v = v.join(texts, "name", "left").fillna("", ["text"])
    v = cut(v.select("value", "text", _letter(F.col("name")).alias("letter"), _body(F.col("text")).alias("body"), F.replace("name", F.lit(" "), F.lit("")).alias("compact")))

    # Acronyms: as a whole; of several identities none is taken.
    acr = acronym.filter(F.col("acr").isNotNull()).groupBy(deaccent(F.lower("acr")).alias("compact")).agg(_one().alias("identity"))
    short = cut(v.join(acr, "compact").select("value", "identity"))
    rest = v.join(short, "value", "left_anti")

    bodies = rest.select("body", "letter").filter(F.length("body") > 0).distinct()
    segments = _segments(reference_forms(names)).select("form", "letter", "identity", "k", "form_length", "i", "segment")
    pairs = _probes(bodies).join(segments, ["letter", "form_length", "k", "i", "segment"])
    # Verified before they are made distinct: the distance is cheaper than a shuffle of all pairs.
    near = pairs.withColumn("distance", _close(F.col("body"), F.col("form"), F.col("k"))).filter(F.col("distance").isNotNull())
    near = near.groupBy("body", "letter", "identity").agg(F.min("distance").alias("distance"))
    near = rest.join(near, ["body", "letter"]).select("value", "identity", F.struct("distance", F.lit(False).alias("cut")).alias("rank"))

    # Words cut short: every word of the value begins the word of the name at its place.
    whole = names.filter("full").select(_words(F.col("text")).alias("whole"), "letter", "identity").withColumn("stems", _stem_key(F.col("whole")))
    begun = rest.select("value", "letter", _words(F.col("text")).alias("words")).withColumn("stems", _stem_key(F.col("words")))
    begun = begun.join(whole, ["stems", "letter"]).filter(F.forall(F.arrays_zip("words", "whole"), lambda x: F.startswith(x["whole"], x["words"])))
    begun = begun.select("value", "identity", F.struct(F.lit(0).alias("distance"), F.lit(True).alias("cut")).alias("rank"))

    # The nearest name decides, if it is the name of one identity; a name in full goes before one cut short.
    near = near.unionByName(begun).groupBy("value").agg(F.collect_set(F.struct("rank", "identity")).alias("all"))
    first = F.filter("all", lambda x: x["rank"] == F.array_min("all")["rank"])
    near = near.select("value", first.alias("first")).filter(F.size("first") == 1).select("value", F.get("first", F.lit(0))["identity"].alias("identity"))
    matched = near.unionByName(short.filter(F.col("identity").isNotNull()))
    unmatched = v.select("value").join(matched, "value", "left_anti").select("value", F.lit("unmatched").alias("identity"))
    return matched.unionByName(unmatched)
