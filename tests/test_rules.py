"""Rule sets by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quern.functions import rules as R


def test_units_by_hand(spark):
    cases = {
        "3 km": ("3", "km"), "3km": ("3", "km"), "5 square feet": ("5", "ft^2"), "2 ft^{2}": ("2", "ft^2"), "2 ft ^ 3": ("2", "ft^3"), "4 m²": ("4", "m^2"), "60 miles per hour": ("60", "mi/h"), "60mph": ("60", "mi/h"), "90^\\circ": ("90", "deg"), "90°": ("90", "deg"),
        "7 team": ("7 team", None), "12": ("12", None), "\\$5": ("5", "USD"), "5 cents more": ("5", "cent"), "8 Inches less": ("8", "in"), "\\text m": ("\\text", "m"), "\\m": ("\\m", None), "m": ("m", None), "1.5 cubic centimetres": ("1.5", "cm^3"), "": ("", None),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r.k: r for r in R.units_of(df, "k", "t").collect()}
    assert {t: (got[k].value, got[k].unit) for k, t in enumerate(cases)} == cases
    by = {t: got[k] for k, t in enumerate(cases)}
    assert by["5 cents more"].direction == "more" and by["8 Inches less"].direction == "less" and by["3 km"].direction is None
    assert by["60mph"].size == pytest.approx(0.44704) and by["1.5 cubic centimetres"].size == pytest.approx(1e-6) and by["5 square feet"].dimension == "L2"


def test_every_spelling_is_found(spark):
    table = R.unit_table()
    rows = [(i, f"7 {a}") for i, a in enumerate(table)]
    got = {r.k: r.unit for r in R.units_of(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    wrong = [a for i, a in enumerate(table) if got[i] != table[a][0]]
    assert wrong == []


def test_singular_forms_and_goals(spark):
    words = {"knives": "knife", "leaves": "leaf", "batteries": "battery", "boxes": "box", "glass": "glass", "pillows": "pillow", "mug": "mug", "as": "as"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", R.singular("w").alias("s"))
    assert {r.w: r.s for r in df.collect()} == words
    obj, place = R.goal_of("g", F.array(F.lit("go to shelf 2"), F.lit("go to Shelf 1")))
    goals = {"put a clean mug on shelf": ("mug", "shelf 2"), "heat some eggs and put it in the fridge": ("egg", "fridge 1"), "look around": ("", ""), "Examine the pens with lamp": ("pen", "")}
    df = spark.createDataFrame([(g,) for g in goals], "g string").select("g", obj.alias("o"), place.alias("p"))
    assert {r.g: (r.o, r.p) for r in df.collect()} == goals


def test_cases_of_assertions(spark):
    codes = {"assert f(1) == True\nassert f(2) == False": (2, 1, True, False), "assert f(1, 2.5) == 3": (1, 2, False, True), "assert f([1]) == 3": (1, 1, False, False), "assert f(x) == 3": (0, 0, False, False), "not code (": (0, 0, False, False), None: (0, 0, False, False)}
    df = spark.createDataFrame([(c,) for c in codes], "c string").select("c", R.assert_cases("c").alias("a"))
    assert {r.c: tuple(r.a) for r in df.collect()} == codes


def test_exact_24(spark):
    rows = [("(8-2)*4/1", [1, 2, 4, 8], True), ("8*3", [3, 8, 1, 1], False), ("(1+1+1)*8 = 24", [1, 1, 1, 8], True), ("8/(3-8/3)", [3, 3, 8, 8], True), ("24*1*1*1", [24, 1, 1, 1], True), ("__import__('os')", [1, 2, 3, 4], False), ("1/0+24", [0, 1, 24, 1], False), (None, [1, 2, 3, 4], None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "e string, n array<long>").select(R.makes_24("e", "n").alias("ok"))
    assert [r.ok for r in df.collect()] == [w for _, _, w in rows]


def test_unknown_features_never_match(spark):
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    have = names("prime", "integer")
    cases = [(("prime",), (), (), True), (("prime",), ("integer",), ("area",), True), (("area",), (), (), False), (("prime",), ("area",), (), False), (("prime",), (), ("integer",), False), (("prime",), ("unheard",), (), False), (("prime", "unheard"), (), (), False)]
    got = spark.range(1).select(*[R.skill_matches(have, names(*t), names(*r), names(*x)).alias(f"c{i}") for i, (t, r, x, _) in enumerate(cases)]).first()
    assert list(got) == [w for *_, w in cases]
