import pytest
from pyspark.sql import functions as F

from refloom.operators.packed import MARK, explode_packed, split_names

CASES = {
    None: [],
    "": [],
    "  ": [],
    "et al.": [],
    "Smith, J.": ["Smith, J."],
    "Smith, J.; Doe, A.": ["Smith, J.", "Doe, A."],
    "Smith, J.;;Doe, A.; ": ["Smith, J.", "Doe, A."],
    "Smith, J., Doe, A. B., & Roe, K.-H.": ["Smith, J.", "Doe, A. B.", "Roe, K.-H."],
    "Smith, Jane and van Doe, Ann and Roe, K.": ["Smith, Jane", "van Doe, Ann", "Roe, K."],
    "A. Smith, B C Doe, and Roe K et al.": ["A. Smith", "B C Doe", "Roe K"],
    '["Smith, J.", "D\\u00f6e, A."]': ["Smith, J.", "Döe, A."],
    "['Smith, J.', \"O'Doe, A.\"]": ["Smith, J.", "O'Doe, A."],
    "['O\\'Doe, A.', 'Roe, B.']": ["O'Doe, A.", "Roe, B."],
    '"Smith, J."; "Doe ""Jack"" A."': ["Smith, J.", 'Doe "Jack" A.'],
    "Institute for Tides and Currents; Team on Ice & Snow": ["Institute for Tides and Currents", "Team on Ice & Snow"],
    "Institute for Tides and Currents and J. Doe": ["Institute for Tides and Currents", "J. Doe"],
    "J. Smith // A. Doe|B. Roe\tC. Poe\nand D. Moe": ["J. Smith", "A. Doe", "B. Roe", "C. Poe", "D. Moe"],
    "Riharazu ET; Doe A": ["Riharazu ET", "Doe A"],
    f"Sm{MARK}9_ith; D{MARK}oe": [f"Sm{MARK}9_ith", f"D{MARK}oe"],
    'unbalanced "quote; Doe, A.': ['unbalanced "quote', "Doe, A."],
    "Doe, Lawrence van; Roe, B.": ["Doe, Lawrence van", "Roe, B."],
}


def test_notations(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "a string")
    for row in df.select("a", split_names(F.col("a")).alias("v")).collect():
        assert list(row["v"]) == CASES[row["a"]], row["a"]


def test_positions_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "A. Smith; B. Doe", "x"), (2, "A. Smith", "y"), (3, None, "z")], "id int, authors string, pos string")
    rows = {tuple(r) for r in explode_packed(df, "authors", "author", "pos", at_least=2).select("id", "pos", "author").collect()}
    assert rows == {(1, 1, "A. Smith"), (1, 2, "B. Doe")}
    assert explode_packed(df.limit(0), "authors").count() == 0


def test_long_text(spark):
    names = [f"A. Name{i}" for i in range(3000)]
    df = spark.createDataFrame([("; ".join(names),), ('["' + '", "'.join(names) + '"]',)], "a string")
    # Digits end no name here; every name comes out, however many there are.
    assert [r["n"] for r in df.select(F.size(split_names(F.col("a"))).alias("n")).collect()] == [3000, 3000]
