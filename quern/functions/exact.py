"""Exact equality of written answers: fractions, linear forms in any order, intervals with their ends."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

_FRACTION = re.compile(r"\\frac\{([-+]?\d+)\}\{([-+]?\d+)\}|([-+]?\d+)/([-+]?\d+)|([-+]?\d+)")
_TERM = re.compile(r"[-+]?(?:\d*x|\d+)")
_INTERVAL = re.compile(r"([\[(])([-+]?\d+),([-+]?\d+)([\])])")


def value_of(text: str) -> tuple | None:
    """(kind, value) of an answer; None for what isn't a fraction, a sum of multiples of x and numbers, or an interval of whole numbers."""
    t = re.sub(r"\s+", "", text)
    if m := _FRACTION.fullmatch(t):
        n, d = (m[1] or m[3] or m[5]), (m[2] or m[4] or "1")
        return ("number", Fraction(int(n), int(d))) if int(d) else None
    if m := _INTERVAL.fullmatch(t):
        return "interval", (m[1], int(m[2]), int(m[3]), m[4])
    t = t.replace("+-", "-").replace("-+", "-").replace("--", "+")  # a sign behind another
    terms = _TERM.findall(t)
    if "x" in t and "".join(terms) == t and all(s[0] in "+-" for s in terms[1:]):
        at = {"x": 0, "1": 0}
        for s in terms:
            number = s.rstrip("x")
            at["x" if s.endswith("x") else "1"] += int(number) if number not in ("", "+", "-") else int(f"{number}1")
        return "linear", (at["x"], at["1"])
    return None


@pandas_udf(BooleanType())
def same_value(a, b):
    """Whether two answers are equal, exactly; false for two kinds, null where one can't be read."""

    def same(x, y):
        p, q = (value_of(v) if v is not None else None for v in (x, y))
        return None if p is None or q is None else p == q

    return a.combine(b, same)
