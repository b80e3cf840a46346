"""Spellings of names of persons and organisations, linked where they mean the same one.

A spelling is normalised: its parts in one order, the family name and the initial of the given name (of its formal form,
where a nickname stands); an organisation as its own word and its kind.  Spellings with equal normal forms are copies of
one.  A pigeonhole segment join over the whole normal forms finds those that differ by a typing error: each is cut into
k + 1 segments, substrings at shifted places are looked up in the index of segments, and the pairs are verified with a
banded edit distance and with the given names that the spellings have in full.  Groups linked that way are merged by their
smallest label, round by round, until nothing changes.  A family name alone is linked to the only one known by it.

Everything but the rounds is built-in expressions over distinct spellings; a name that a third of all rows share is one
spelling.  Pairs within a group are joined by the group, so their number is that of the pairs asked for.

Defined results: null, blank and "Anonymous" are no names; a family name alone that belongs to several, or to none, links
to nothing but the same name alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.keys import deaccent
from refloom.session import cut

# Nicknames and the names they stand for.
NICKNAMES = {
    "bill": "william", "will": "william", "billy": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "dick": "richard", "rick": "richard", "rich": "richard",
    "ned": "edward", "ed": "edward", "eddie": "edward", "ted": "theodore", "theo": "theodore", "tony": "anthony", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth",
    "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "hetty": "henrietta", "etta": "henrietta", "bella": "isabella", "sasha": "alexander", "alex": "alexander", "sandy": "alexander", "larry": "lawrence",
    "debbie": "deborah", "deb": "deborah", "vicky": "victoria", "tori": "victoria", "sue": "susanne", "susie": "susanne", "fran": "frances", "gerry": "gerald", "jon": "jonathan", "mike": "michael", "mick": "michael", "nat": "nathaniel", "nate": "nathaniel",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "ray": "raymond", "sam": "samuel", "chris": "christopher", "kit": "christopher", "jim": "james", "jack": "john", "harry": "henry", "hank": "henry", "chuck": "charles", "charlie": "charles",
    "tom": "thomas", "dan": "daniel", "dave": "david", "joe": "joseph", "steve": "stephen", "greg": "gregory", "ben": "benjamin", "nick": "nicholas", "andy": "andrew", "matt": "matthew", "phil": "philip", "ron": "ronald", "polly": "mary", "molly": "mary", "nancy": "ann", "sally": "sarah", "nell": "eleanor", "gus": "gustavo",
}
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "du", "la", "le", "ten", "ter", "zu", "af", "jr", "sr", "ii", "iii", "iv")
# Words that organisations call themselves by, short and in full.
KINDS = {
    "collaboration": "collaboration", "collab": "collaboration", "consortium": "consortium", "institute": "institute", "inst": "institute", "institut": "institute", "survey": "survey", "team": "team", "group": "group", "wg": "group", "working": "group",
    "laboratory": "laboratory", "lab": "laboratory", "university": "university", "univ": "university", "society": "society", "soc": "society", "committee": "committee", "network": "network", "project": "project", "council": "council", "association": "association", "assoc": "association",
}
_SMALL = ("the", "for", "on", "of", "and", "in", "&")
#: Edits between two spellings of a family name: one, or two neighbours swapped.
EDITS = 2


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return deaccent(F.lower(c))


def _umlauts(c: Column) -> Column:
    """Umlauts written out as two vowels as one."""
    return F.regexp_replace(c, r"(?<=\p{L})([aou])e(?=\p{L}|$)", "$1")


def _own(words: Column) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.isin(*PARTICLES))


def _initial(given: Column) -> Column:
    """First letter of a given name in its formal form."""
    return F.substring(F.coalesce(_map(NICKNAMES)[given], given), 1, 1)


def readings(spellings: DataFrame) -> DataFrame:
    """(name, family, given, initial, sure): how each spelling may be read; two ways where its order is open.

    A family name alone has no initial.
    """
    n = spellings.select("name", F.regexp_replace(F.trim("name"), r"\s+", " ").alias("n"))
    for _ in range(2):
        n = n.withColumn("n", F.regexp_replace("n", r"\b(Van|Von|De|Der|Den|Del|Di|Da|Du|La|Le)(?=\p{Lu}\p{Ll})", "$1 "))
    n = n.withColumn("words", F.split(F.regexp_replace(F.lower("n"), r"[.,]", " "), " +"))
    kind = F.array_compact(F.transform("words", lambda w: _map(KINDS)[w]))
    n = n.withColumn("kinds", kind).withColumn("own", F.filter(F.transform("words", fold), lambda w: (w != "") & ~w.isin(*KINDS, *_SMALL)))
    # Of an organisation the first word of its own and the first kind; what it is for tells it apart only by its kind.
    organisation = (F.size("kinds") > 0) & (F.size("own") > 0) & ~F.col("n").contains(",")
    lead = F.filter("own", lambda w: F.length(w) > 3)
    org = n.filter(organisation).select("name", F.coalesce(F.get(lead, F.lit(0)), F.get("own", F.lit(0))).alias("family"), F.lit("").alias("given"), F.concat(F.lit("#"), F.get("kinds", F.lit(0))).alias("initial"), F.lit(True).alias("sure"))

    p = n.filter(~organisation).withColumn("comma", F.col("n").contains(","))
    p = p.withColumn("left", F.when(F.col("comma"), F.regexp_extract("n", r"^([^,]*)", 1))).withColumn("right", F.when(F.col("comma"), F.regexp_extract("n", r"^[^,]*,\s*(.*)$", 1)))
    # Behind a comma a particle in capitals is initials.
    letters = F.filter(F.split(F.regexp_replace(F.col("right"), r"[.,]", " "), "[ ]+"), lambda w: (w != "") & (w.rlike(r"^\p{Lu}+$") | ~F.lower(w).isin(*PARTICLES)))
    with_comma = p.filter("comma").select("name", F.array_join(_own(F.transform(F.split("left", " "), fold)), " ").alias("family"), F.coalesce(fold(F.get(letters, F.lit(0))), F.lit("")).alias("given"))
    with_comma = with_comma.select("name", "family", "given", _initial(F.col("given")).alias("initial"), F.lit(True).alias("sure"))

    bare = p.filter(~F.col("comma")).withColumn("tokens", F.split("n", " "))
    # Initials: any number of capitals with dots, up to three without; a particle only as capitals at the end of a name
    # that is not in capitals itself.
    last = F.when(F.exists("tokens", lambda x: x.rlike(r"\p{Ll}")), F.element_at("tokens", -1))
    particle = lambda w: F.lower(w).isin(*PARTICLES) & ~F.coalesce((w == last) & w.rlike(r"^\p{Lu}+$"), F.lit(False))
    is_initials = lambda w: w.rlike(r"^(?:(?:\p{Lu}\.?-?){1,3}|(?:\p{Lu}\.-?)+)$") & ~particle(w)
    # Where nothing else is left, three capitals without a dot are a short family name.
    loose = F.exists("tokens", lambda w: ~is_initials(w) & ~F.lower(w).isin(*PARTICLES))
    taken = lambda w: is_initials(w) & (F.col("loose") | ~w.rlike(r"^\p{Lu}{3}$"))
    bare = bare.withColumn("loose", loose)
    bare = bare.withColumn("initials", F.filter("tokens", taken)).withColumn("rest", _own(F.transform(F.filter("tokens", lambda w: ~taken(w)), fold)))
    bare = bare.withColumn("first", F.lower(F.substring(F.coalesce(F.get("initials", F.lit(0)), F.lit("")), 1, 1)))
    single = bare.filter(F.size("rest") == 1).select("name", F.get("rest", F.lit(0)).alias("family"), F.lit("").alias("given"), "first", F.lit(True).alias("sure")).withColumnRenamed("first", "initial")
    many = bare.filter(F.size("rest") > 1).withColumn("west", F.struct(F.element_at("rest", -1).alias("family"), F.get("rest", F.lit(0)).alias("given")))
    many = many.withColumn("east", F.struct(F.get("rest", F.lit(0)).alias("family"), F.element_at("rest", -1).alias("given")))
    led = F.lower(F.get("tokens", F.lit(0))).isin(*PARTICLES)
    open_order = (F.size("initials") == 0) & (F.size("rest") == 2) & (led | ~F.exists("tokens", lambda w: F.lower(w).isin(*PARTICLES)))
    many = many.select("name", F.explode(F.when(led, F.array("east")).when(open_order, F.array("west", "east")).otherwise(F.array("west"))).alias("r"), F.when(open_order & ~led, False).otherwise(True).alias("sure"))
    many = many.select("name", "r.family", "r.given", _initial(F.col("r.given")).alias("initial"), "sure")
    return org.unionByName(with_comma).unionByName(single).unionByName(many).filter(F.col("family") != "")


def _settled(r: DataFrame) -> DataFrame:
    """One reading for each spelling: of two, the one whose family name and given name the sure readings know better."""
    sure = r.filter("sure")
    known = sure.groupBy("family", "initial").agg(F.count("*").alias("known"))
    as_family = sure.groupBy("family").agg(F.count("*").alias("families"))
    as_given = sure.filter(F.length("given") > 2).groupBy("given").agg(F.count_distinct("family").alias("givens"))
    open_ = r.filter(~F.col("sure")).join(known, ["family", "initial"], "left").join(as_family, "family", "left").join(as_given, "given", "left").fillna(0, ["known", "families", "givens"])
    score = F.struct(F.col("known") > 0, F.col("givens"), F.col("families"), F.col("known"), F.col("family"))
    best = open_.groupBy("name").agg(F.max_by(F.struct("family", "given", "initial"), score).alias("b")).select("name", "b.family", "b.given", "b.initial")
    return sure.select("name", "family", "given", "initial").unionByName(best)


def similar_strings(strings: DataFrame, column: str, edits: int = EDITS) -> DataFrame:
    """(a, b, distance) for different strings within ``edits`` edits, by pigeonhole segments; a < b."""
    s = strings.select(F.col(f"`{column}`").alias("s")).filter(F.length("s") > edits).distinct().withColumn("n", F.length("s"))
    start = F.floor((F.col("i") - 1) * F.col("m") / (edits + 1)).cast("int") + 1
    size = F.floor(F.col("i") * F.col("m") / (edits + 1)).cast("int") - start + 1
    parts = F.explode(F.sequence(F.lit(1), F.lit(edits + 1)))
    index = s.select(F.col("s").alias("a"), F.col("n").alias("m"), parts.alias("i")).withColumn("segment", F.substring("a", start, size)).select("a", "m", "i", "segment")
    probe = s.select("s", "n", F.explode(F.sequence(F.col("n") - edits, F.col("n") + edits)).alias("m")).filter(F.col("m") > edits).select("s", "n", "m", parts.alias("i"))
    probe = probe.withColumn("start", start).withColumn("size", size).withColumn("d", F.col("n") - F.col("m"))
    left, right = F.col("i") - 1, F.lit(edits + 1) - F.col("i")
    low = F.greatest(F.lit(1), F.col("start") - left, F.col("start") + F.col("d") - right)
    high = F.least(F.col("n") - F.col("size") + 1, F.col("start") + left, F.col("start") + F.col("d") + right)
    probe = probe.withColumn("low", low).withColumn("high", high).filter("low <= high").select("s", "m", "i", "size", F.explode(F.sequence("low", "high")).alias("at"))
    probe = probe.select("s", "m", "i", F.substring("s", F.col("at"), F.col("size")).alias("segment"))
    pairs = probe.join(index, ["m", "i", "segment"]).filter(F.col("a") < F.col("s"))
    pairs = pairs.withColumn("distance", F.levenshtein("a", "s", edits)).filter(F.col("distance") >= 0)
    return pairs.select("a", F.col("s").alias("b"), "distance").distinct()


def _swapped(a: Column, b: Column) -> Column:
    return (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))


def components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) lead to; labels jump to the label of their label each round."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        new = labels.join(near, "v").select("v", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = new.join(labels.select(F.col("v").alias("to"), F.col("label").alias("far")), "to", "left").select("v", F.least("to", F.coalesce("far", "to")).alias("label"), "old")
        jump = cut(jump)
        labels = jump.select("v", "label")
        if jump.filter(F.col("label") != F.col("old")).isEmpty():
            break
    return nodes.select(F.col(node).alias("v")).distinct().join(labels, "v", "left").select(F.col("v").alias(node), F.coalesce("label", "v").alias("label"))


def link_names(spellings: DataFrame, column: str) -> DataFrame:
    """(name, entity): the spellings of a column, those of one person or organisation under one entity."""
    # Written out: what follows reads the names, their readings and the groups several times each.
    names = cut(spellings.select(F.trim(F.col(f"`{column}`"), F.lit(" \t\r\n\u00a0")).alias("name")).filter((F.col("name") != "") & (F.lower("name") != "anonymous")).distinct())
    both = cut(readings(names))
    alone = both.filter("initial = ''").select("name", "family").distinct()
    read = cut(_settled(both.filter("initial <> ''")).withColumn("node", F.concat_ws("|", "family", "initial")))
    size = read.groupBy("node", "family", "initial").agg(F.count("*").alias("spellings"), F.collect_set(F.when(F.length("given") > 2, F.coalesce(_map(NICKNAMES)[F.col("given")], F.col("given")))).alias("givens"))
    size = cut(size)

    x, y = (size.select(*[F.col(c).alias(f"{k}_{c}") for c in size.columns]) for k in "xy")
    near = similar_strings(size, "node").join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
    near = cut(near.filter((F.col("distance") == 1) | _swapped(F.col("a"), F.col("b"))))
    # Given names decide, not how many spellings there are: that grows with the tables.
    agree = (F.size("x_givens") == 0) | (F.size("y_givens") == 0) | F.exists("x_givens", lambda g: F.exists("y_givens", lambda h: F.levenshtein(g, h) <= 2))
    slip = lambda g, h: (F.levenshtein(g, h) <= 1) | _swapped(g, h)
    # A slip in the first letter of a given name moves it to another initial of the same family name.
    moved = F.exists("x_givens", lambda g: F.exists("y_givens", lambda h: slip(g, h)))
    typed = near.filter(F.when(F.col("x_initial") == F.col("y_initial"), agree).when(F.col("x_family") == F.col("y_family"), moved).otherwise(False)).select("a", "b")
    same = size.select("node", F.struct(_umlauts(F.col("family")).alias("f"), "initial").alias("key"))
    written = same.select(F.col("node").alias("a"), "key").join(same.select(F.col("node").alias("b"), "key"), "key").filter("a < b").select("a", "b")
    labels = cut(components(size, typed.unionByName(written), "node"))
    linked = read.join(labels, "node").select("name", F.col("label").alias("entity"))
    return linked.unionByName(_alone(alone, size.join(labels, "node").select("family", "label")))


def _alone(alone: DataFrame, known: DataFrame) -> DataFrame:
    """(name, entity) for family names alone: the only one known by the name, else by one a typing error away."""
    one = lambda d: d.groupBy("name").agg(F.min("label").alias("label"), F.count_distinct("label").alias("n"))
    key = lambda d: d.withColumn("key", _umlauts(F.col("family")))
    known = cut(key(known).select("key", "label").distinct())
    alone = cut(key(alone))
    exact = cut(one(alone.join(known, "key")))
    rest = alone.join(exact, "name", "left_anti")
    families = known.select("key").unionByName(rest.select("key")).distinct()
    near = similar_strings(families, "key").filter((F.col("distance") == 1) | _swapped(F.col("a"), F.col("b"))).select("a", "b")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    typed = one(rest.join(near, F.col("key") == F.col("a")).join(known.select(F.col("key").alias("b"), "label"), "b"))
    found = exact.unionByName(typed).filter("n = 1").select("name", "label")
    return alone.join(found, "name", "left").select("name", F.coalesce("label", F.concat("key", F.lit("|"))).alias("entity"))


def pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point, for every two spellings of an entity."""
    a = linked.select("entity", F.col("name").alias("name_a"))
    b = linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()
