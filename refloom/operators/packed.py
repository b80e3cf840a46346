"""Several values packed in one field: one value per row, with its position.

Quoted spans become indexed placeholders, the remaining delimiters are split, the spans are put back by array lookup
and the array is exploded with positions.  Everything is a Spark expression; no row leaves the JVM.

Defined results: null, '' and blank fields hold no value (no row); empty places between delimiters hold none and take no
position; unbalanced quotes are ordinary characters; a field without delimiters holds one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opens a placeholder; the digit behind it says of what kind.  0-3 stand for the four characters below as found in the
#: text itself, 9 for a quoted span, so that no text can collide with a placeholder.
MARK = "\ue000"
#: A comma inside a name, while the commas between names are split.
INNER = "\ue001"
#: Guards a joining word inside the name of an organisation.
JOIN = "\ue002"
#: An end of a value that was written as a word.
CUT = "\ue003"

_DELIM = rf",;|/\n\r\t{CUT}"
_WORD = r"\p{L}[\p{L}\p{M}'’‐‑-]*+"
_PARTICLE = r"(?i:van|von|de|der|den|del|della|di|da|du|la|le|ten|ter|zu|zur|af)"
_INITIALS = r"\p{Lu}\p{M}?\.?(?:[ \u00a0‐‑-]*\p{Lu}\p{M}?\.?)*+"
_SURNAME = rf"(?:{_PARTICLE} +)*+{_WORD}"
_END = rf"(?= *(?:$|[{_DELIM}]))"
#: A given name, initials, or both, with a particle left behind ("Lawrence van").
_GIVEN = rf"(?:{_INITIALS}|{_WORD}(?: +{_INITIALS})?)(?: +{_PARTICLE})*"
_AND = r"(?:and|AND|And|und|Und|et|&)"
_BLANK = " \u00a0\r\n\t\f\v"
_QUOTE = r'(?<![^\s,;|\[])"([^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+)"(?=\s*(?:$|[\],;|]|and\s|&\s))'
_SINGLE = r"(?<![^\s,;|\[])'([^'\\]*+(?:\\.[^'\\]*+)*+)'(?=\s*(?:$|[\],;|]))"


def _escaped(c: Column) -> Column:
    for i, ch in enumerate((MARK, INNER, JOIN, CUT)):
        c = F.replace(c, F.lit(ch), F.lit(f"{MARK}{i}"))
    return c


def _restored(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit(INNER), F.lit(",")), F.lit(JOIN), F.lit(""))
    for i, ch in reversed(list(enumerate((MARK, INNER, JOIN, CUT)))):
        c = F.replace(c, F.lit(f"{MARK}{i}"), F.lit(ch))
    return c


def _decoded(spans: Column, escapes: Column) -> Column:
    """Spans without their quotes: JSON escapes in list notation, doubled quotes elsewhere."""
    as_json = F.transform(
        spans,
        lambda s: F.when(
            s.startswith("'"),
            F.concat(
                F.lit('"'),
                F.replace(F.replace(F.regexp_replace(s, r"(?s)^'(.*)'$", "$1"), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')),
                F.lit('"'),
            ),
        ).otherwise(s),
    )
    as_json = F.transform(as_json, lambda s: F.regexp_replace(s, r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2"))
    parsed = F.from_json(F.concat(F.lit("["), F.array_join(as_json, ","), F.lit("]")), "array<string>")
    plain = F.transform(spans, lambda s: F.replace(F.regexp_replace(s, r"""(?s)^["'](.*)["']$""", "$1"), F.lit('""'), F.lit('"')))
    return F.when(escapes & (F.size(parsed) == F.size(spans)) & ~F.exists(parsed, lambda x: x.isNull()), parsed).otherwise(plain)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_quotes(text: Column, listed: Column) -> Column:
    """struct(spans, bare): the quoted spans, decoded, and the text with a placeholder for each."""
    either, double = F.lit(rf"(?s){_QUOTE}|{_SINGLE}"), F.lit(rf"(?s){_QUOTE}")
    spans = F.when(listed, F.regexp_extract_all(text, either, F.lit(0))).otherwise(F.regexp_extract_all(text, double, F.lit(0)))
    bare = F.when(listed, F.regexp_replace(text, either, F.lit(f"{MARK}9_"))).otherwise(F.regexp_replace(text, double, F.lit(f"{MARK}9_")))
    numbered = F.array_join(F.transform(F.split(bare, f"{MARK}9_"), lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit(f"{MARK}9"), (i - 1).cast("string"), F.lit("_"), s))), "")
    quoted = F.struct(let(spans, lambda s: _decoded(s, listed)).alias("spans"), numbered.alias("bare"))
    return F.when(text.contains('"') | listed, quoted).otherwise(F.struct(F.array().cast("array<string>").alias("spans"), text.alias("bare")))


def _pieces(held: Column) -> Column:
    held = F.regexp_replace(held, r"(^|[\s,;|/&])[Ee]t\.? al\b\.?", f"$1{CUT}")
    held = F.regexp_replace(held, rf"(\b(?:for|on|of|in|für|pour|sur)\s+{_WORD})(\s+)(and|&|und|et)(?=\s+{_WORD}\s*(?:$|[{_DELIM}]|{_AND}\s))", f"$1$2{JOIN}$3{JOIN}")
    held = F.regexp_replace(held, rf"(^|[\s{_DELIM}]){_AND}(?=\s)", f"$1{CUT}")
    held = F.regexp_replace(held, rf"(^|[{_DELIM}])(\s*(?:{_SURNAME}|{_SURNAME} +{_WORD}(?=\s*,\s*\p{{Lu}}\.))\s*),(\s*{_GIVEN}){_END}", f"$1$2{INNER}$3")
    return F.filter(F.transform(F.split(held, rf"[{_DELIM}]"), lambda s: F.trim(s, F.lit(_BLANK))), lambda s: s != "")


def split_names(packed: Column) -> Column:
    """The names of a packed field, in order; null and blank fields give an empty array.

    Understood: semicolons, bars, slashes, tabs and line ends; joining words and "&" (not inside an organisation's name,
    as in "Institute for Tides and Currents"); lists in JSON or Python notation; quoted values; commas, where a comma
    between a surname and its given name or initials stays inside the name.  "et al." is dropped.
    """

    def of(text: Column) -> Column:
        listed = text.rlike(r"(?s)^\s*\[.*\]\s*$")
        return let(
            _without_quotes(F.when(listed, F.regexp_replace(text, r"(?s)^\s*\[(.*)\]\s*$", "$1")).otherwise(text), listed),
            lambda q: F.transform(_pieces(q["bare"]), lambda s: F.when(s.rlike(rf"^{MARK}9\d+_$"), F.get(q["spans"], F.regexp_extract(s, rf"^{MARK}9(\d+)_$", 1).cast("int"))).otherwise(s)),
        )

    values = let(_escaped(F.coalesce(packed, F.lit(""))), of)
    values = F.transform(values, lambda s: F.trim(_restored(s), F.lit(_BLANK)))
    return F.filter(values, lambda s: (s != "") & ~s.rlike(r"(?i)^(?:et\.?\s+al\.?|and\s+others|u\.\s?a\.)$"))


def explode_packed(df: DataFrame, column: str, value: str = "value", pos: str = "pos", at_least: int = 1) -> DataFrame:
    """One row per value packed in ``column``, with its position from 1; other columns stay.

    ``value`` and ``pos`` replace columns of the same names.  Rows with fewer than ``at_least`` values give none.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (value, pos)]
    values = let(split_names(F.col(f"`{column}`")), lambda v: F.when(F.size(v) >= at_least, v))
    # The outer form keeps the optimizer from computing the array a second time in an inferred filter.
    out = df.select(*rest, F.posexplode_outer(values).alias("__pos", "__value")).filter(F.col("__value").isNotNull())
    return out.select(*rest, (F.col("__pos") + 1).cast("int").alias(pos), F.col("__value").alias(value))
