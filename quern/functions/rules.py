"""Rule sets over question, skill and answer text, whole: features, units, subjects, task patterns, roles, goals, planner reasons."""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from . import text as N
from .scoring import reasons


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def four(x: Column) -> Column:
    """Four decimal places, halves up, by the same arithmetic in any engine."""
    return F.floor(x * 10000.0 + 0.5) / 10000.0


# questions ----------------------------------------------------------------------------------------------------------

#: Question features and the patterns that show them in lower-case text.
FEATURES = {
    "prime": r"\bprime\b|素数", "modular": r"modulo|remainder|congruen|\\pmod|余数", "divisibility": r"divisi|divid|整除", "gcd_lcm": r"\bgcd\b|\blcm\b|greatest common", "polynomial": r"polynomial|多项式", "quadratic": r"quadratic|\^\{?2|平方", "equation": r"equation|solve.*=|方程",
    "factorization": r"factor|因式", "rational": r"\\frac|fraction|rational", "triangle": r"triangle|三角形", "circle": r"circle|圆", "area": r"area|面积", "counting": r"ways|choose|combination|排列", "probability": r"probability|概率", "trigonometric": r"\\sin|\\cos|trigonometric",
    "unit_rate": r"per |each |每", "ratio": r"ratio|比例", "composition": r"composition|f\(f\(", "integer": r"integer|整数", "positive": r"positive|正数", "nonzero": r"nonzero|non-zero|非零",
}


def question_features(c: str | Column) -> Column:
    """Names of the features that a question shows, in the order of the table."""
    t = F.lower(_col(c))
    return reasons(**{name: t.rlike(p) for name, p in FEATURES.items()})


def skill_matches(features: Column, trigger: Column, required: Column, excluded: Column) -> Column:
    """A skill fits a question if every feature that it names is known, one of its triggers is there, all required ones are, and none of the excluded."""
    known = F.array(*map(F.lit, FEATURES))
    named = F.array_union(F.array_union(trigger, required), excluded)
    return (F.size(F.array_except(named, known)) == 0) & F.arrays_overlap(trigger, features) & (F.size(F.array_except(required, features)) == 0) & ~F.arrays_overlap(excluded, features)


#: Subjects, and words of which one set alone names a subject.
SUBJECTS = ("prealgebra", "algebra", "intermediate_algebra", "geometry", "number_theory", "counting_probability", "precalculus")
SUBJECT_WORDS = {"geometry": ("triangle", "circle", "perimeter"), "number_theory": ("prime", "divisib", "remainder", "modulo", "\\pmod"), "counting_probability": ("probability", "permutation", "choose"), "precalculus": ("\\sin", "\\cos", "trigonometric"), "algebra": ("polynomial", "quadratic", "equation")}


def subject_of(declared: str | Column, question: str | Column) -> tuple[Column, Column]:
    """(subject, source): the declared subject under any of its spellings, else the only one whose words the question holds, else null."""
    given = F.replace(F.lower(F.trim(_col(declared))), F.lit("_"), F.lit(" "))
    spelt = {s.replace("_", " "): s for s in SUBJECTS} | {"counting & probability": "counting_probability", "counting and probability": "counting_probability"}
    alias = F.coalesce(*[F.when(given == k, F.lit(v)) for k, v in spelt.items()])
    t = F.lower(_col(question))
    hits = reasons(**{s: F.coalesce(*[F.when(t.contains(w), True) for w in words], F.lit(False)) for s, words in SUBJECT_WORDS.items()})
    one = F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))
    return F.coalesce(alias, one), F.when(alias.isNotNull(), "metadata").when(one.isNotNull(), "rule").otherwise("unknown")


# task patterns ------------------------------------------------------------------------------------------------------

#: Words of word problems, first set first; words and beginnings of names of code tasks; words of formulas.
WORD_PROBLEMS = (
    ("gsm8k_percentage", ("percent", "%", "discount", "tax", "interest", "tip")),
    ("gsm8k_counting_combinatorics", ("combination", "combinations", "permutation", "arrangement", "ways", "choose")),
    ("gsm8k_rate_ratio", ("ratio", "rate", "per ", "each hour", "each minute", "mph")),
    ("gsm8k_time_money", ("dollar", "dollars", "cent", "cents", "price", "cost", "money", "hour", "minute", "day", "week")),
    ("gsm8k_algebraic_word_problem", ("remaining", "left", "twice", "half", "sum of", "difference", "equation")),
)
SORTING = ("sort", "ascending", "descending", "ordered", "rearrange")
COUNTING = ("count", "number of", "digits", "digit", "frequency", "occurrence", "ways")
FORMULA = ("angle", "area", "volume", "radius", "perimeter", "distance", "power", "temperature", "double", "triple", "formula")
FORMULA_NAMES = ("area", "volume", "find_", "even_", "double", "third_", "convert_")
SEARCHING = ("check", "find", "search", "whether", "valid", "sum of", "minimum", "maximum", "divisor", "angle", "area", "volume")
_CASES = StructType([StructField("n", IntegerType()), StructField("arity", IntegerType()), StructField("all_bool", BooleanType()), StructField("all_number", BooleanType())])


@pandas_udf(_CASES)
def assert_cases(c):
    """Of the `assert f(...) == literal` lines of a test: how many, the most arguments, and whether all expected values are truth values, or all are numbers and all arguments plain."""

    def read(code):
        found = []
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            tree = ast.parse("")
        for node in ast.walk(tree):
            test = node.test if isinstance(node, ast.Assert) else None
            if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], (ast.Eq, ast.Is)) and isinstance(test.left, ast.Call):
                try:
                    found.append(([ast.literal_eval(a) for a in test.left.args], ast.literal_eval(test.comparators[0])))
                except (ValueError, TypeError, SyntaxError, RecursionError, MemoryError):
                    pass
        plain = lambda v: not isinstance(v, (list, tuple, dict, set, str, bytes))
        return {
            "n": len(found), "arity": max((len(a) for a, _ in found), default=0), "all_bool": bool(found) and all(isinstance(e, bool) for _, e in found),
            "all_number": bool(found) and all(isinstance(e, (int, float)) and not isinstance(e, bool) and all(map(plain, a)) for a, e in found),
        }

    import pandas as pd

    return pd.DataFrame([read(x) for x in c], columns=["n", "arity", "all_bool", "all_number"])


def _any(t: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(t.contains(w), True) for w in words], F.lit(False))


def task_pattern(benchmark: str | Column, prompt: str | Column, entry: str | Column, test: str | Column) -> Column:
    """The coarse kind of a task: word problems by their words, code tasks by words, names and the shape of their assertions."""
    b, e = _col(benchmark), F.coalesce(_col(entry), F.lit(""))
    t = F.lower(F.concat_ws("\n", _col(prompt), _col(test)))
    begins = lambda names: F.coalesce(*[F.when(F.startswith(e, F.lit(x)), True) for x in names], F.lit(False))
    words = F.coalesce(*[F.when(_any(t, w), F.lit(name)) for name, w in WORD_PROBLEMS], F.lit("gsm8k_arithmetic"))

    def code(cases: Column) -> Column:
        single = cases["arity"] <= 1
        formula = cases["all_number"] & (_any(t, FORMULA) | begins(FORMULA_NAMES))
        return (
            F.when(_any(t, SORTING) | begins(("sort",)), "sort")
            .when(_any(t, COUNTING) | begins(("count",)), "count")
            .when(cases["all_bool"], F.when(single, "scalar_guard_predicate").otherwise("multiarg_relation_or_classifier"))
            .when(formula, F.when(single, "numeric_formula_single_arg").otherwise("numeric_formula_multi_arg"))
            .when(_any(t, SEARCHING) | begins(("find",)), "predicate_or_search")
            .otherwise("mbpp_general")
        )

    return F.when(b == "humaneval", "function_synthesis").when(b == "gsm8k", words).otherwise(N.let(assert_cases(_col(test)), code))


# units --------------------------------------------------------------------------------------------------------------

#: Unit, dimension, size in the dimension's own unit, spellings.
UNITS = (
    ("m", "L", 1.0, ("m", "meter", "meters", "metre", "metres")), ("cm", "L", 1 / 100, ("cm", "centimeter", "centimeters", "centimetre", "centimetres")), ("km", "L", 1000.0, ("km", "kilometer", "kilometers", "kilometre", "kilometres")), ("mm", "L", 1 / 1000, ("mm", "millimeter", "millimeters")),
    ("in", "L", 127 / 5000, ("in", "inch", "inches")), ("ft", "L", 381 / 1250, ("ft", "foot", "feet")), ("mi", "L", 201168 / 125, ("mi", "mile", "miles")),
    ("s", "T", 1.0, ("s", "sec", "second", "seconds")), ("min", "T", 60.0, ("min", "minute", "minutes")), ("h", "T", 3600.0, ("h", "hr", "hour", "hours")),
    ("kg", "M", 1.0, ("kg", "kilogram", "kilograms")), ("g", "M", 1 / 1000, ("g", "gm", "gram", "grams")), ("lb", "M", 45359237 / 100000000, ("lb", "lbs", "pound", "pounds")),
    ("deg", "angle", math.pi / 180, ("deg", "degree", "degrees", "°")), ("rad", "angle", 1.0, ("rad", "radian", "radians")),
    ("USD", "currency:USD", 1.0, ("dollar", "dollars", "usd")), ("cent", "currency:USD", 1 / 100, ("cent", "cents")), ("cal", "energy", 523 / 125, ("calorie", "calories", "cal")), ("unit", "abstract_length", 1.0, ("unit", "units")),
)
#: Lengths with squares and cubes, lengths and times of speeds, and spellings of their own.
POWERED, SPEEDS = ("m", "cm", "km", "mm", "in", "ft", "mi", "unit"), (("m", "cm", "km", "in", "ft", "mi"), ("s", "min", "h"))
EXTRA = (("mph", "mi/h"), ("kmph", "km/h"), ("kph", "km/h"), (r"^\circ", "deg"), (r"^{\circ}", "deg"))


def unit_table() -> dict[str, tuple[str, str, float]]:
    """Every spelling of every unit, powers and speeds built by rule: alias -> (unit, dimension, size)."""
    base = {name: (dim, size, spelt) for name, dim, size, spelt in UNITS}
    out = {a: (name, dim, size) for name, (dim, size, spelt) in base.items() for a in spelt}
    for name in POWERED:
        dim, size, spelt = base[name]
        for power, word, sign in ((2, "square", "²"), (3, "cubic", "³")):
            for a in spelt:
                for alias in (f"{word} {a}", f"{a}^{power}", f"{a}^{{{power}}}", a + sign):
                    out[alias] = (f"{name}^{power}", f"{dim}{power}", size**power)
    for length in SPEEDS[0]:
        for time in SPEEDS[1]:
            unit = (f"{length}/{time}", "L/T", base[length][1] / base[time][1])
            out |= {alias: unit for a in base[length][2] for b in base[time][2] for alias in (f"{a} per {b}", f"{a}/{b}")}
    named = {v[0]: v for v in out.values()}
    return out | {alias: named[name] for alias, name in EXTRA}


def units_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value, unit, dimension, size, direction): the longest spelling of a unit that ends a text and isn't the end of a longer word, and what stands before it; a last "less" or
    "more" is its direction. Without a unit the value is the whole text. The spellings are a table of the library, of fixed size, met by the ends of the text."""
    spark: SparkSession = rows.sparkSession
    aliases = [(a, *u) for a, u in unit_table().items()]
    table = spark.createDataFrame(aliases, "alias string, unit string, dimension string, size double")
    t = F.regexp_replace(F.trim(_col(text)), r"\s*\^\s*", "^")
    direction = F.lower(N.found(F.regexp_extract(t, r"(?i)\s+(less|more)\z", 1)))
    bare = rows.select(key, direction.alias("direction"), F.trim(F.regexp_replace(t, r"(?i)\s+(?:less|more)\z", "")).alias("_t")).filter("_t is not null")
    longest = max(map(len, unit_table()))
    # ends of the text that could be a spelling, with the character before
    starts = F.sequence(F.greatest(F.lit(2), F.length("_t") - (longest - 1)), F.length("_t"))
    ends = bare.filter("length(_t) >= 2").select(key, "_t", F.explode(starts).alias("_at"))
    ends = ends.select(key, "_t", "_at", F.lower(F.substr("_t", F.col("_at"))).alias("alias"), F.substr("_t", F.col("_at") - 1, F.lit(1)).alias("_before"))
    hits = ends.join(F.broadcast(table), "alias").filter(~F.col("_before").rlike(r"[\p{L}\\]") & (F.trim(F.substring("_t", F.lit(1), F.col("_at") - 1)) != ""))
    best = hits.groupBy(key).agg(F.min_by(F.struct("_at", "unit", "dimension", "size"), "_at").alias("_b"))
    met = bare.join(best, key, "left")
    money = F.startswith(F.col("_t"), F.lit(r"\$"))
    value = F.when(money, F.trim(F.substr("_t", F.lit(3)))).when(F.col("_b").isNotNull(), F.trim(F.substring("_t", F.lit(1), F.col("_b._at") - 1))).otherwise(F.col("_t"))
    pick = lambda name, usd: F.when(money, F.lit(usd)).otherwise(F.col(f"_b.{name}")).alias(name)
    return met.select(key, value.alias("value"), pick("unit", "USD"), pick("dimension", "currency:USD"), pick("size", 1.0), "direction")


# skills and goals ---------------------------------------------------------------------------------------------------

#: Words that give a skill its role, first set first, and words of what a skill touches.
ROLES = {"repair": r"\b(repair|fix|patch|debug|correct)\b", "formatter": r"\b(format|formatter|serialize|markdown|json|csv|pretty)\b", "guard": r"\b(check|guard|validate|verify|assert|sanity)\b", "verifier": r"verifier|unit test"}
AFFORDANCES = {
    "file_path": r"\b(file|path|directory|folder|stdin|stdout|json|csv|os_path|filepath|filename)\b", "string": r"\b(string|strings|text|substring|character|characters|letter|letters|word|words)\b",
    "numeric": r"\b(number|numbers|integer|integers|digit|digits|count|counts|sum|product|prime)\b", "list": r"\b(list|lists|array|arrays|sequence|sequences|tuple|tuples)\b", "grid": r"\b(grid|matrix|board|maze|row|rows|column|columns)\b", "code_transform": r"\b(code|python|function|refactor|transform|rewrite|syntax|ast)\b",
}


def skill_metadata(said: str | Column, exact: Column, direct: Column, risk: Column, family: Column) -> dict[str, Column]:
    """role, affordances, mode, risk label and family of a skill from its text, its flags and its risk score."""
    t = F.lower(_col(said))
    role = F.coalesce(*[F.when(t.rlike(p), F.lit(r)) for r, p in ROLES.items()], F.lit("solver"))
    touched = reasons(**{a: t.rlike(p) for a, p in AFFORDANCES.items()})
    touched = F.when(F.array_contains(touched, "file_path"), F.concat(F.array(F.lit("file_path"), F.lit("io")), F.array_remove(touched, "file_path"))).otherwise(touched)
    paths = (role == "guard") & F.array_contains(touched, "file_path")
    mode = F.when(role == "verifier", "verifier_only").when(role == "formatter", "soft_hint").when(role == "guard", "local_guard").when(exact | direct, "hard_skeleton").otherwise("soft_hint")
    label = F.when(paths | (risk >= 1.25), "high").when(risk >= 0.55, "medium").otherwise("low")
    named = N.found(family)
    own = F.when(paths, "file_path_guard").when(role.isin("guard", "verifier"), F.concat_ws("_", F.coalesce(named, F.lit("generic")), role)).otherwise(F.coalesce(named, F.lit("generic_solver")))
    return {"role": role, "affordances": touched, "mode": mode, "risk_label": label, "skill_family": own}


#: What a goal says of its object and of its place, first pattern first, and endings of plurals with what takes their place.
GOAL_OBJECTS = (r"(?:put|place)\s+(?:a|an|some|the|two)\s+(?:clean|hot|cold|cool|heated|cooled)?\s*(\w+)", r"(?:examine|look at)\s+(?:a|an|some|the)\s+(\w+)", r"(?:heat|cool|clean)\s+(?:a|an|some|the)\s+(\w+)", r"(?:find)\s+(?:a|an|some|the|two)\s+(\w+)")
GOAL_PLACES = (r"(?:put|place)\s+it\s+(?:in|on|into)\s+(?:a|an|the)?\s*(\w+)", r"\b(?:in|on)\s+(\w+)\s*\.?\s*$")
PLURALS = (("ives", 3, "fe"), ("ves", 3, "f"), ("ies", 3, "y"), ("ses", 2, ""), ("xes", 2, ""), ("zes", 2, ""), ("ss", 0, ""), ("s", 1, ""))


def singular(c: str | Column) -> Column:
    w = _col(c)
    out = F.coalesce(*[F.when(F.endswith(w, F.lit(end)), F.concat(F.left(w, F.length(w) - cut), F.lit(new))) for end, cut, new in PLURALS], w)
    return F.when(F.length(w) < 3, w).otherwise(out)


def goal_of(goal: str | Column, commands: Column) -> tuple[Column, Column]:
    """(object, target) of a goal: the object in its singular form, the place as the first admissible "go to" that names it, else its first instance; empty without one."""
    t = F.lower(_col(goal))
    first = lambda patterns: F.coalesce(*[N.found(F.regexp_extract(t, p, 1)) for p in patterns])
    place = first(GOAL_PLACES)
    fits = F.filter(commands, lambda c: F.startswith(c, F.lit("go to ")) & F.contains(F.lower(c), place))
    seen = F.when(F.size(fits) > 0, F.substr(F.get(fits, F.lit(0)), F.lit(7)))
    return F.coalesce(singular(first(GOAL_OBJECTS)), F.lit("")), F.coalesce(seen, F.concat(place, F.lit(" 1")), F.lit(""))


# planner ------------------------------------------------------------------------------------------------------------

#: Fixed value: the compatibility that the planner's hard gate asks for.
COMPATIBLE = 0.55


def _vetoes(veto: Column, compatibility: Column, gate: Column, reason: str) -> Column:
    """Reasons of the hard gate where there is an assessment (compatibility isn't null)."""
    low = F.when(F.coalesce(compatibility, F.lit(0.0)) < COMPATIBLE, F.array(F.lit(reason))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.coalesce(veto, F.array().cast("array<string>")), lambda v: F.concat(F.lit("planner_veto:"), v))
    return F.when(gate & veto.isNotNull(), F.concat(named, low)).otherwise(F.array().cast("array<string>"))


def direct_rejections(score: Column, threshold: Column | float, compat: Column, exact: Column, signature: Column, eligible: Column, abstain: Column, veto: Column, compatibility: Column, gate: Column) -> Column:
    """Why a candidate isn't executed directly, all reasons in order; veto null: no assessment was made."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    own = reasons(below_direct_threshold=score < threshold, direct_compat_below_threshold=compat < 1.5, missing_direct_signature_compatibility=~(exact | signature), direct_not_eligible=~eligible, selector_low_confidence_abstain=abstain)
    return F.concat(own, _vetoes(veto, compatibility, gate, "planner_compatibility_below_direct_threshold"))


def seed_rejections(off: Column, score: Column, threshold: Column | float, compat: Column, abstain: Column, veto: Column, compatibility: Column, gate: Column, filtered: Column, soft_only: Column, soft_first: Column, mismatch: Column, mode: Column) -> Column:
    """Why a candidate doesn't seed a solution, all reasons in order; mode: the seed mode that its transfer utility reaches; off: seeding is switched off."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    own = reasons(below_seed_threshold=score < threshold, seed_compat_below_threshold=compat < 0.5, selector_low_confidence_abstain=abstain)
    full = mode.isin("skeleton_only_seed", "code_excerpt_seed")
    late = reasons(
        hard_filter_failed=filtered, planner_compatibility_soft_hint_only=veto.isNotNull() & full & soft_only, soft_aware_prefers_hint_only=soft_first & full, seed_type_profile_mismatch=mismatch, transfer_utility_below_threshold=mode == "no_seed",
    )
    return F.when(off, F.array(F.lit("skill_seeded_disabled"))).otherwise(F.concat(own, _vetoes(veto, compatibility, gate, "planner_compatibility_below_seed_threshold"), late))


# answers ------------------------------------------------------------------------------------------------------------


def yes_no_label(c: str | Column) -> Column:
    """An option label where yes and no are the numbers of their options, 0 and 1."""
    t = N.option_label(c)
    return F.when(t == "yes", "0").when(t == "no", "1").otherwise(t)


@pandas_udf(BooleanType())
def makes_24(expressions, numbers):
    """Whether an expression uses each of the given numbers once and has the value 24, exactly; + - * / and brackets only."""
    from fractions import Fraction

    ops = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}

    def value(node, used):
        if isinstance(node, ast.BinOp) and type(node.op) in ops:
            return ops[type(node.op)](value(node.left, used), value(node.right, used))
        if isinstance(node, ast.Constant) and type(node.value) is int:
            used.append(node.value)
            return Fraction(node.value)
        raise ValueError

    def check(text, given):
        if text is None or given is None:
            return None
        head = re.split(r"[\n=]", text, maxsplit=1)[0].strip()
        used: list[int] = []
        try:
            return len(head) <= 400 and value(ast.parse(head, mode="eval").body, used) == 24 and sorted(used) == sorted(int(x) for x in given)
        except (SyntaxError, ValueError, ZeroDivisionError, RecursionError, MemoryError):
            return False

    return expressions.combine(numbers, check)


