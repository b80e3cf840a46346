"""Statistics of each text, and from them which texts are not natural prose.

A text is cut into lines (very long lines into sentences).  A line counts as prose by its words that carry clauses
(auxiliaries, pronouns, conjunctions, articles), together with the lines around it, so that wrapped sentences are told
from lists of phrases; lines of symbols, figures or markup, and marked items that are no sentences, are not prose.  Where a
text has hardly any of these words it is in a language that the list doesn't hold: then its form decides, sentences that end
as such, of many words in small letters (of letters without capitals and blanks, of many letters).

Repetition is no prose: characters of lines and paragraphs that stood before, and what the dominant n-gram covers, where
they make up a large part, are taken from the share of prose.

Defined results: null and blank texts give null statistics and are neither prose nor not; repeated rows give repeated
results; a text of any length is read as a whole, line by line.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Common words.  Clause words mark sentences; articles occur in long titles as well and count half.
CLAUSE = frozenset(
    """
is are was were be been being am has have had having do does did can could may might must shall should will would cannot
i we you he she it they me us him them who whom which that this these those there here what when where why how while because if unless until although though
not no nor neither either but than then so yet only also as since whether once after before where's every each some any both another
und oder aber nicht kein keine ist sind war waren wird werden wurde wurden worden hat haben hatte hatten kann können konnte soll sollte muss ich wir er sie es man sich
dass daß weil wenn ob als dabei damit noch nur auch so dies diese dieser dieses jede jeder wie wo wir uns ihre ihr auf haben gilt
et ou mais ne pas n est sont était étaient être a ont avait été peut peuvent nous vous il elle ils elles on se s que qui qu dont où si car lorsque quand ce cette ces plus
y o pero no es son fue fueron era ser está están ha han había puede pueden nosotros se que quien cuyo donde si porque cuando este esta estos estas más muy solo también
che non è sono era essere ha hanno noi si quando perché se não são foi uma het een niet zijn wordt werd dat die wij ze
""".split()
)
ARTICLE = frozenset("the a an der die das den dem des ein eine einer einem eines le la les un une des du l el los las una unos lo il gli i".split()) - {"i"}
#: Labels that pages put around a text.
FURNITURE = frozenset("home pdf next previous help login sign up cookie settings skip content metrics export share cite menu search contact privacy terms download".split())
_WORD = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"^\s*(?:\d{1,3}[.)]\s+)?(?:>\s*)+|(?<=\s)>\s+")
_BULLET = re.compile(r"^\s*(?:[-*•–—·▪◦‣+o]\s|->|=>|→|#+\s|\(?[a-zA-Z][.)]\s)")
_NUMBER = re.compile(r"^\s*(?:\(?\d{1,3}[.):]\s|\[\d+\])")
_SENTENCE_END = re.compile(r"""[.!?…。！？؟।]["'”’»)\]]*\s*(?:\[[^\]]*\]\s*\.?)?$""")
_CUT = re.compile(r"(?<=[.!?…])\s+")


def _class_of(categories: frozenset[str], more: str) -> re.Pattern:
    """A pattern for the characters of the Basic Multilingual Plane that are of the categories, or in more."""
    points = [i for i in range(0x10000) if unicodedata.category(chr(i)) in categories or chr(i) in more]
    ranges: list[list[int]] = []
    for i in points:
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]")


#: Symbols that sentences hardly hold.
_ODD = _class_of(frozenset(("So", "Sk", "Sc", "Sm", "Co", "Cn")), "|\\{}<>=_~^#*@\ufffd")
#: Longer lines are judged sentence by sentence.
LONG = 400
#: Clause words a word, from which words count as sentences; below which a text is in another language.
DENSITY, FOREIGN = 0.14, 0.02
#: Shares of repeated lines or paragraphs, and of the dominant n-gram, from which repetition counts.
DUPLICATE, DOMINANT = 0.5, 0.4

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_chars", "n_words", "n_lines")]
    + [
        T.StructField(n, T.DoubleType())
        for n in ("mean_word_length", "symbol_ratio", "end_punct_share", "common_word_share", "dup_line_share", "dup_paragraph_share", "top_2gram_share", "top_3gram_share", "list_share", "furniture_share", "prose_share")
    ]
    + [T.StructField("is_prose", T.BooleanType())]
)


def _dup_share(parts: list[str]) -> float:
    """Share of the characters in parts that stand before in the same text."""
    seen: set[str] = set()
    again = total = 0
    for p in parts:
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _top_gram(words: list[str], n: int) -> float:
    """Share of the letters that the most frequent n-gram covers, if it comes more than once."""
    if len(words) < 2 * n:
        return 0.0
    counts = Counter(zip(*(words[i:] for i in range(n))))
    count = max(counts.values())
    if count < 2:
        return 0.0
    # Of grams that come equally often the longest counts.
    longest = max(sum(map(len, g)) for g, k in counts.items() if k == count)
    return min(1.0, count * longest / sum(map(len, words)))


def _segments(text: str) -> Iterator[tuple[int, str]]:
    """(paragraph, line); long lines in sentences."""
    paragraph = 0
    for line in text.split("\n"):
        if not line.strip():
            paragraph += 1
        elif len(line) > LONG:
            for s in _CUT.split(line):
                yield paragraph, s
        else:
            yield paragraph, line


def _like_sentence(line: str, words: list[str]) -> bool:
    """Whether a line has the form of a sentence in any language: many words, few in capitals or figures, or many letters of
    a script without capitals and blanks."""
    if not words:
        return False
    letters = sum(map(len, words))
    if not any(c.lower() != c.upper() for c in line):
        return letters >= 12
    tokens = line.split()
    capital = sum(t[:1].isupper() for t in tokens[1:])
    return len(words) >= 8 and capital <= 0.3 * len(tokens) and 2.5 <= letters / len(words) <= 12 and sum(map(str.isdigit, line)) <= 0.05 * len(line)


def describe(text: str | None) -> tuple | None:
    """The statistics of one text, as STATS; None for null and blank."""
    if text is None or not text.strip():
        return None
    rows, every, common = [], [], 0
    for paragraph, line in _segments(text):
        if ">" in line:
            line = _QUOTED.sub("", line)
        words = _WORD.findall(line.lower())
        every += words
        solid = len(line) - line.count(" ") - line.count("\t")
        letters = sum(map(len, words))
        odd = len(_ODD.findall(line))
        clauses = sum(map(CLAUSE.__contains__, words))
        articles = sum(map(ARTICLE.__contains__, words))
        common += clauses + articles
        weight = clauses + 0.5 * articles
        # A numbered line may hold a passage of sentences; other marks stand before phrases.
        bullet = _BULLET.match(line) is not None or (len(words) < 8 and _NUMBER.match(line) is not None)
        end = _SENTENCE_END.search(line) is not None
        hard = letters < 0.6 * solid or odd > 0.12 * solid or (bullet and not end)
        rows.append((paragraph, len(line.strip()), len(words), weight, bullet, end, hard, line, words))
    total = prose = listed = ended = 0
    foreign = common < FOREIGN * len(every)
    for i, (paragraph, size, n, weight, bullet, end, hard, line, words) in enumerate(rows):
        total += size
        ended += end
        if hard:
            listed += size if bullet else 0
            continue
        if not bullet:
            for j in (i - 1, i + 1):
                if 0 <= j < len(rows) and rows[j][0] == paragraph and not rows[j][4] and not rows[j][6]:
                    n, weight = n + rows[j][2], weight + rows[j][3]
        if (n and weight >= DENSITY * n) or (foreign and end and _like_sentence(line, words)):
            prose += size
        elif bullet or not end:
            listed += size
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    n_words, letters = len(every), sum(map(len, every))
    solid = sum(map(len, text.split()))
    gram2, gram3 = _top_gram(every, 2), _top_gram(every, 3)
    again, blocks = _dup_share(lines), _dup_share([p.strip() for p in text.split("\n\n") if p.strip()])
    share = prose / total
    # In few words one n-gram that comes twice covers much already, so more is allowed there.
    if max(gram2, gram3) > DOMINANT + 2.4 / max(n_words, 4):
        share = min(share, 1 - max(gram2, gram3))
    if max(again, blocks) > DUPLICATE:
        share = min(share, 1 - max(again, blocks))
    return (
        len(text), n_words, len(lines), letters / n_words if n_words else 0.0, 1 - letters / solid if solid else 0.0, ended / len(rows),
        min(1.0, common / n_words) if n_words else 0.0, again, blocks,
        gram2, gram3, listed / total, sum(map(FURNITURE.__contains__, every)) / n_words if n_words else 0.0, share, share >= 0.5,
    )


@F.pandas_udf(STATS)
def _describe(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = STATS.fieldNames()
    for s in parts:
        # Null for the whole struct isn't possible here; its fields are null instead.
        yield pd.DataFrame([describe(x) or (None,) * len(names) for x in s], columns=names).astype({n: "object" for n in names})


def with_quality(df: DataFrame, column: str, out: str = "quality") -> DataFrame:
    """Adds the statistics of ``column`` as a struct; replaces a column named ``out``."""
    return df.withColumn(out, _describe(F.col(f"`{column}`")))
