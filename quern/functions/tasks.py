"""Task and solution text: entry points, subjects, units, cues, parameters, grading rules."""

from __future__ import annotations

import ast
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import text as N


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_hash(c: str | Column) -> Column:
    """Sixteen hex digits of the digest of code without blank lines and trailing blanks."""
    lines = F.filter(F.transform(F.split(_col(c), "\n"), lambda x: F.rtrim(x)), lambda x: x != "")
    return F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16)


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of the JSON object of the fields in name order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


#: Subject aliases.
SUBJECTS = {"algebra": "algebra", "intermediate algebra": "algebra", "prealgebra": "prealgebra", "number theory": "number_theory", "counting & probability": "counting_probability", "geometry": "geometry", "precalculus": "precalculus"}
#: Subject rules: one hit only names a subject.
SUBJECT_RULES = {"geometry": r"triangle|circle|polygon|angle", "number_theory": r"\bprime\b|remainder|divisi", "counting_probability": r"probability|how many ways|choose", "algebra": r"equation|polynomial|quadratic"}


def subject(given: str | Column, question: str | Column) -> Column:
    """The alias of the given subject, else the one rule that fits the question, else null."""
    g = F.lower(F.trim(_col(given)))
    alias = F.coalesce(*[F.when(g == k, F.lit(v)) for k, v in SUBJECTS.items()])
    hits = F.array_compact(F.array(*[F.when(F.lower(_col(question)).rlike(p), F.lit(k)) for k, p in SUBJECT_RULES.items()]))
    return F.coalesce(alias, F.when(F.size(hits) == 1, F.get(hits, F.lit(0))))


def entry_point(prompt: str | Column, test: str | Column) -> Column:
    """The last defined function of the prompt, else the first asserted one, else solve."""
    defs = F.regexp_extract_all(_col(prompt), F.lit(r"def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)
    asserted = N.found(F.regexp_extract(_col(test), r"assert\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1))
    return F.coalesce(F.when(F.size(defs) > 0, F.element_at(defs, -1)), asserted, F.lit("solve"))


def arity(test: str | Column) -> Column:
    """Arguments of the first asserted call by its commas; null without one."""
    call = F.regexp_extract(_col(test), r"assert\s+[A-Za-z_][A-Za-z0-9_]*\((.*?)\)", 1)
    return F.when(_col(test).rlike(r"assert\s+[A-Za-z_][A-Za-z0-9_]*\(.*?\)"), F.when(F.trim(call) == "", 0).otherwise(F.length(call) - F.length(F.replace(call, F.lit(","), F.lit(""))) + 1))


@pandas_udf(StringType())
def assert_literals(c):
    """Arguments and expected value of `assert f(...) == value` as JSON, literals only; null for anything else."""

    def parse(code):
        try:
            node = ast.parse((code or "").strip()).body[0]
            test = node.test
            if not (isinstance(node, ast.Assert) and isinstance(test, ast.Compare) and isinstance(test.ops[0], ast.Eq) and isinstance(test.left, ast.Call)):
                return None
            return json.dumps({"args": [ast.literal_eval(a) for a in test.left.args], "expected": ast.literal_eval(test.comparators[0])})
        except (SyntaxError, ValueError, IndexError, AttributeError, TypeError, RecursionError, MemoryError):
            return None

    return c.map(parse)


#: Unit aliases to canonical unit and factor.
UNITS = (("kilometers", "m", 1000.0), ("kilometer", "m", 1000.0), ("km", "m", 1000.0), ("meters", "m", 1.0), ("meter", "m", 1.0), ("cm", "m", 0.01), ("m", "m", 1.0), ("hours", "s", 3600.0), ("hour", "s", 3600.0), ("minutes", "s", 60.0), ("minute", "s", 60.0), ("seconds", "s", 1.0), ("s", "s", 1.0), ("dollars", "usd", 1.0), ("dollar", "usd", 1.0), ("cents", "usd", 0.01), ("degrees", "deg", 1.0))


def unit_split(c: str | Column) -> tuple[Column, Column]:
    """(value in canonical units, unit) of a number with the longest unit that ends it; unit null and plain value without."""
    t = F.lower(F.trim(_col(c)))
    value = unit = None
    for alias, canon, factor in sorted(UNITS, key=lambda u: -len(u[0])):
        m = F.regexp_extract(t, rf"^(-?\d+(?:\.\d+)?)\s*{alias}\z", 1)
        value = [*(value or []), F.when(m != "", m.try_cast("double") * factor)]
        unit = [*(unit or []), F.when(m != "", F.lit(canon))]
    return F.coalesce(*value, t.try_cast("double")), F.coalesce(*unit)


def paragraphs(c: str | Column) -> Column:
    """Paragraphs with the offset (characters, from 0) where each begins."""
    parts = F.split(_col(c), "\n")
    start = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out")), lambda s, p: F.struct((s["at"] + F.length(p) + 1).alias("at"), F.when(F.trim(p) == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), p.alias("text"))))).alias("out")))
    return start["out"]


#: Cues of candidate answers, checks and revisions.
CUES = {"candidate": r"(?i)\b(?:answer is|therefore|thus)\b", "check": r"(?i)\b(?:check|verify|confirm)\b", "revision": r"(?i)\b(?:wait|actually|instead|mistake)\b"}


def cue_counts(c: str | Column) -> list[Column]:
    return [F.regexp_count(_col(c), F.lit(p)).alias(k) for k, p in CUES.items()]


def ordered_stages(c: str | Column, stages: list[str]) -> Column:
    """Places (from 1) of stage cues, each after the one before; null if one is missing."""
    at, out, ok = F.lit(1), [], F.lit(True)
    low = F.lower(_col(c))
    for s in stages:
        p = F.locate(s, F.substring(low, F.lit(1), F.length(low)), 1) if not out else F.when(F.locate(s, F.substr(low, at)) > 0, F.locate(s, F.substr(low, at)) + at - 1).otherwise(0)
        ok = ok & (p > 0)
        out.append(p)
        at = p + len(s)
    return F.when(ok, F.array(*out))


def base_name(c: str | Column) -> Column:
    """A place name without its trailing number."""
    return F.regexp_replace(_col(c), r"\s*\d+\z", "")


def action_parts(c: str | Column) -> tuple[Column, Column, Column]:
    """(verb, object, place) of an action: first word, and `take X from Y`."""
    t = F.trim(_col(c))
    take = r"^take (.+?) from (.+)\z"
    return F.get(F.split(t, " "), F.lit(0)), N.found(F.regexp_extract(t, take, 1)), N.found(F.regexp_extract(t, take, 2))


def goal_parameters(c: str | Column) -> tuple[Column, Column]:
    """(object, target) of a goal by the first pattern that fits."""
    t = F.lower(_col(c))
    # a goal that changes the object also says where to put it, so the plain "put" comes last
    patterns = [
        r"(?:clean|heat|cool) (?:a |an |the |some )?(.+?) and put it (?:in|on) (?:a |an |the )?(.+?)\.?\z",
        r"examine (?:a |an |the )?(.+?) with (?:a |an |the )?(.+?)\.?\z",
        r"put (?:a |an |the |some )?(.+?) (?:in|on) (?:a |an |the )?(.+?)\.?\z",
    ]
    return tuple(F.coalesce(*[N.found(F.regexp_extract(t, p, g)) for p in patterns]) for g in (1, 2))


def skill_role(c: str | Column) -> tuple[Column, Column]:
    """(role, insertion mode) of a skill description."""
    t = F.lower(_col(c))
    role = F.when(t.rlike("repair|fix|patch"), "repair").when(t.rlike("format|render|pretty"), "formatter").when(t.rlike("guard|check|validate"), "guard").when(t.rlike("verifier|unit test"), "verifier").otherwise("solver")
    mode = F.when(role == "verifier", "verifier_only").when(role == "guard", "local_guard").otherwise("soft_hint")
    return role, mode


def strip_asked_units(value: str | Column, question: str | Column) -> Column:
    """Percent, currency, degree and gram marks go where the question asks for them."""
    v, q = F.trim(_col(value)), F.lower(_col(question))
    v = F.regexp_replace(v, r"(?<=\d),(?=\d{3}(?:\D|\z))", "")
    v = F.when(q.rlike("percent"), F.replace(F.replace(v, F.lit(r"\%"), F.lit("")), F.lit("%"), F.lit(""))).otherwise(v)
    v = F.when(q.rlike(r"dollar|\$|nearest cent"), F.regexp_replace(F.replace(v, F.lit("$"), F.lit("")), r"(?i)\s*dollars?\.?\z", "")).otherwise(v)
    v = F.when(q.rlike("degrees|angle"), F.replace(F.replace(v, F.lit(r"^\circ"), F.lit("")), F.lit("°"), F.lit(""))).otherwise(v)
    v = F.when(q.contains("grams"), F.regexp_replace(v, r"(?i)\s*grams?\z", "")).otherwise(v)
    return F.trim(v)


def verdict(prediction: str | Column, reference: str | Column) -> Column:
    """Three-valued grade: equal in comparable form or within 1e-3 true, both readable and different false, else unknown."""
    unknown = _col(prediction).isNull() | _col(reference).isNull()

    def grade(x: Column) -> Column:
        p, r, a, b = x["p"], x["r"], x["a"], x["b"]
        same = F.when(p == r, True).when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-3)
        return F.coalesce(same, F.when(N.option_label(p) == N.option_label(r), True).when(F.length(p) <= 2, False))

    forms = F.struct(N.normalize_answer(prediction).alias("p"), N.normalize_answer(reference).alias("r"))
    read = lambda x: F.struct(x["p"].alias("p"), x["r"].alias("r"), N.parse_number(x["p"]).alias("a"), N.parse_number(x["r"]).alias("b"))
    return F.when(~unknown, N.let(N.let(forms, read), grade))


@pandas_udf(StringType())
def arithmetic(c):
    """Exact value of + - * / over numbers and brackets (no names, no calls, no powers), null for anything else."""
    from fractions import Fraction

    ops = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}

    def value(n):
        if isinstance(n, ast.Expression):
            return value(n.body)
        if isinstance(n, ast.BinOp) and type(n.op) in ops:
            return ops[type(n.op)](value(n.left), value(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -value(n.operand)
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return Fraction(str(n.value))
        raise ValueError

    def run(t):
        try:
            if not t or len(t) > 400:
                return None
            return str(value(ast.parse(t.strip(), mode="eval")))
        except (SyntaxError, ValueError, ZeroDivisionError, RecursionError, MemoryError):
            return None

    return c.map(run)


def anti_unify(a: str | Column, b: str | Column) -> Column:
    """The common pattern of two token lists: equal tokens stay, others become ?, different lengths give null."""
    x, y = F.split(_col(a), " "), F.split(_col(b), " ")
    return F.when(F.size(x) == F.size(y), F.array_join(F.zip_with(x, y, lambda p, q: F.when(p == q, p).otherwise(F.lit("?"))), " "))


def operation_rows(traces: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each `a op b = c` step of a trace: (key, step, left, op, right, result)."""
    pattern = r"(-?\d+(?:\.\d+)?) ?([-+*/]) ?(-?\d+(?:\.\d+)?) ?= ?(-?\d+(?:\.\d+)?)"
    found = traces.select(key, F.posexplode(F.regexp_extract_all(_col(text), F.lit(f"({pattern})"), 1)).alias("step", "_m"))
    g = lambda i: F.regexp_extract("_m", pattern, i)
    return found.select(key, "step", g(1).try_cast("double").alias("left"), g(2).alias("op"), g(3).try_cast("double").alias("right"), g(4).try_cast("double").alias("result"))


def register(spark: SparkSession) -> list[str]:
    """Make the UDF-backed functions callable from SQL; returns their names."""
    udfs = {"quern_boxed": N.boxed_balanced, "quern_rational": N.rational, "quern_unescape": N.unescape_html, "quern_nfkc": N.nfkc, "quern_ratio": N.sequence_ratio, "quern_indel": N.indel_ratio, "quern_arithmetic": arithmetic, "quern_literals": assert_literals}
    for name, f in udfs.items():
        spark.udf.register(name, f)
    return sorted(udfs)


#: Scorers by name: (prediction, reference) to a score column.
SCORERS = {
    "exact": lambda p, r: (_col(p) == _col(r)).cast("double"),
    "option": lambda p, r: (N.option_label(p) == N.option_label(r)).cast("double"),
    "numeric": lambda p, r: F.coalesce((F.abs(N.last_number(p) - N.last_number(r)) <= 1e-6).cast("double"), F.lit(0.0)),
    "normalized": lambda p, r: (N.normalize_answer(p) == N.normalize_answer(r)).cast("double"),
    "math": lambda p, r: F.coalesce(verdict(p, r).cast("double"), F.lit(0.0)),
}


ANSWER_MARKER = r"(?i)(?:\b(?:the )?(?:final )?answer\s*(?:is|:)\s*|\b(?:therefore|hence|thus)\b[, :]*)([^\n]+)"


def visible_answer(text: str | Column, finish: str | Column) -> tuple[Column, Column]:
    """(answer, source) of what a response shows: nothing of cut-off responses, open hidden blocks or open boxes; else the
    last marked answer or the last box, whichever comes later, else the last line. No reference takes part."""
    raw = _col(text)
    t = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    hidden = t.rlike(r"(?i)<think>")
    boxes = F.regexp_extract_all(t, F.lit(N.NESTED_BOXED), 1)
    open_box = t.rlike(r"\\boxed\s*\{") & (F.size(boxes) == 0)
    marked = F.regexp_extract_all(t, F.lit(ANSWER_MARKER), 1)
    unread = (_col(finish) == "length") | hidden | (F.trim(t) == "") | open_box
    after = F.regexp_extract(t, r"(?s).*(\\boxed\{.*)", 1).rlike(ANSWER_MARKER)  # a marker follows the last box
    use_mark = (F.size(marked) > 0) & ((F.size(boxes) == 0) | after)
    said = F.regexp_replace(F.trim(F.element_at(marked, -1)), r"^\$(.*)\$\.?\z", "$1")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    answer = F.when(unread, None).when(use_mark, said).when(F.size(boxes) > 0, F.trim(F.try_element_at(boxes, F.lit(-1)))).otherwise(F.try_element_at(lines, F.lit(-1)))
    source = F.when(unread, "incomplete").when(use_mark, "marker").when(F.size(boxes) > 0, "box").otherwise("last_line")
    return answer, source


def answer_spec(question: str | Column) -> Column:
    """The kind of answer a question asks for, first rule first."""
    q = F.lower(_col(question))
    rules = {"choice": r"\(a\).*\(b\)|which of the following", "base_numeral": r"in base|base \d+", "percent": r"percent|%", "fraction": r"common fraction|fraction", "interval": r"interval notation", "set": r"all (?:real |integer )?(?:values|solutions)", "expression": r"express.*in terms of|simplify", "integer": r"how many|integer", "decimal": r"nearest|decimal"}
    return F.coalesce(*[F.when(q.rlike(p), F.lit(k)) for k, p in rules.items()], F.lit("number"))


def candidate_events(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, candidate, occurrences): boxed and marked candidate answers of a reasoning text in order, with the number of
    times the same comparable form occurs."""
    from pyspark.sql import Window

    found = F.regexp_extract_all(_col(text), F.lit(r"\\boxed\{([^{}]+)\}|(?i:(?:answer|result) (?:is|would be|=|:) ?)([^\n.;]+)"), 0)
    x = rows.select(key, F.posexplode(found).alias("position", "_m"))
    bare = F.coalesce(N.found(F.regexp_extract("_m", r"\\boxed\{([^{}]+)\}", 1)), F.regexp_replace("_m", r"(?i)^(?:answer|result) (?:is|would be|=|:) ?", ""))
    x = x.select(key, "position", N.normalize_answer(bare).alias("candidate"))
    return x.withColumn("occurrences", F.count(F.lit(1)).over(Window.partitionBy(key, "candidate")))


@pandas_udf(StringType())
def top_level_parts(c):
    """Parts between commas outside all brackets, as a JSON list; null where brackets don't balance."""
    pairs = {")": "(", "]": "[", "}": "{"}

    def split(t):
        if t is None:
            return None
        stack, out, last = [], [], 0
        for i, ch in enumerate(t):
            if ch in "([{":
                stack.append(ch)
            elif ch in pairs:
                if not stack or stack.pop() != pairs[ch]:
                    return None
            elif ch == "," and not stack:
                out.append(t[last:i].strip())
                last = i + 1
        return None if stack else json.dumps([*out, t[last:].strip()], ensure_ascii=False)

    return c.map(split)
