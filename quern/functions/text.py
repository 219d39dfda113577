"""Text functions as Column expressions: normalisers, ids, chunks, tokens, answer extraction and record parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

#: ASCII punctuation that answer normalisation drops.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """White space of any kind trimmed."""
    return F.regexp_replace(_col(c), r"^\s+|\s+\z", "")


def let(c: Column, body) -> Column:
    """body(c) with c computed once, where body uses it many times: keeps generated code small."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def squeeze(c: str | Column) -> Column:
    """White space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def word_count(c: str | Column) -> Column:
    """Words between white space; 0 for blank."""
    t = squeeze(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def content_id(c: str | Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.md5(F.trim(_col(c))))


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 100, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Overlapping word chunks: (id, chunk_order_index, tokens, content, chunk_id). The last one may lie inside its predecessor; empty texts give none."""
    step = size - overlap
    w = docs.select(id_col, F.split(_col(text), r"\s+").alias("_w")).filter(F.trim(F.array_join("_w", "")) != "")
    at = w.select(id_col, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))).alias("_i"))
    cut = at.select(id_col, (F.col("_i") / step).cast("int").alias("chunk_order_index"), F.slice("_w", F.col("_i") + 1, size).alias("_c"))
    content = F.array_join("_c", " ")
    return cut.select(id_col, "chunk_order_index", F.size("_c").alias("tokens"), content.alias("content"), F.concat(F.lit("chunk-"), F.md5(content)).alias("chunk_id"))


def qa_normalize(c: str | Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    t = F.translate(F.lower(_col(c)), PUNCTUATION, "")
    return squeeze(F.regexp_replace(t, r"\b(a|an|the)\b", " "))


def digit_mask(c: str | Column) -> Column:
    """Squeezed lower-case text with numbers as #."""
    return F.regexp_replace(squeeze(F.lower(_col(c))), r"\d+(\.\d+)?", "#")


def split_markers(c: str | Column, markers: list[str]) -> Column:
    """Parts between any of the markers, trimmed, blanks dropped."""
    pattern = "|".join(re.escape(m) for m in markers)
    return F.filter(F.transform(F.split(_col(c), pattern), lambda x: F.trim(x)), lambda x: x != "")


def is_float(c: str | Column) -> Column:
    return _col(c).rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def strip_controls(c: str | Column) -> Column:
    """Trimmed text without C0, DEL and C1 control characters."""
    return F.regexp_replace(F.trim(_col(c)), r"[\x00-\x1f\x7f-\x9f]", "")


@pandas_udf(StringType())
def unescape_html(c):
    """HTML character references decoded by the full entity table."""
    from html import unescape

    return c.map(lambda x: None if x is None else unescape(x))


@pandas_udf(StringType())
def nfkc(c):
    """NFKC, lower case, single blanks."""
    import unicodedata

    return c.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).lower())


def token_estimate(c: str | Column) -> Column:
    """A third of the UTF-8 bytes, rounded up; 0 only for empty."""
    return F.ceil(F.octet_length(_col(c)) / 3)


def identifiers(c: str | Column) -> Column:
    """Distinct lower-case identifiers of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([a-z_][a-z0-9_]+)"), 1))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two distinct arrays; 0 where both are empty."""
    a, b = _col(a), _col(b)
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


@pandas_udf(DoubleType())
def sequence_ratio(a, b):
    """Matching-blocks ratio without junk heuristics."""
    from difflib import SequenceMatcher

    return a.combine(b, lambda x, y: SequenceMatcher(None, x or "", y or "", autojunk=False).ratio())


def _indel(x: str | None, y: str | None) -> float:
    x, y = x or "", y or ""
    if not x and not y:
        return 1.0
    # bit-parallel longest common subsequence: one bit a character of x
    where: dict[str, int] = {}
    for i, ch in enumerate(x):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for ch in y:
        m = row & where.get(ch, 0)
        row = (row + m | row - m) & full
    return 2 * (len(x) - row.bit_count()) / (len(x) + len(y))


@pandas_udf(DoubleType())
def indel_ratio(a, b):
    """Twice the longest common subsequence over both lengths; 1 for two empty texts."""
    return a.combine(b, _indel)


def sequence_ratio_from(a: str | Column, b: str | Column, least: float) -> Column:
    """sequence_ratio where it reaches ``least``, else null. Matching blocks are a common subsequence, so the cheaper
    insertion-deletion ratio bounds theirs and leaves few pairs to be matched."""
    from difflib import SequenceMatcher

    @pandas_udf(DoubleType())
    def run(x, y):
        def ratio(p, q):
            if _indel(p, q) < least:
                return None
            r = SequenceMatcher(None, p or "", q or "", autojunk=False).ratio()
            return r if r >= least else None

        return x.combine(y, ratio)

    return run(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


# answers ------------------------------------------------------------------------------------------------------------

BOXED = r"\\boxed\{([^}]+)\}"
NESTED_BOXED = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
NUMBER = r"-?\d[\d,]*\.?\d*"


def found(c: Column) -> Column:
    """A regex group, null instead of empty."""
    return F.when(c != "", c)


def boxed_first(c: str | Column) -> Column:
    return F.trim(found(F.regexp_extract(_col(c), BOXED, 1)))


def boxed_or_last_line(c: str | Column) -> Column:
    return F.coalesce(boxed_first(c), F.trim(F.element_at(F.split(F.trim(_col(c)), "\n"), -1)))


def boxed_nested_last(c: str | Column) -> Column:
    """The last box with at most one inner level, else the last sentence."""
    boxes = F.regexp_extract_all(_col(c), F.lit(NESTED_BOXED), 1)
    sentences = F.filter(F.transform(F.split(_col(c), r"(?<!\d)[.!?]\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(boxes) > 0, F.trim(F.element_at(boxes, -1))).when(F.size(sentences) > 0, F.element_at(sentences, -1)).otherwise("")


def hash_answer(c: str | Column) -> Column:
    """What follows #### on its line, without commas; else the trimmed text."""
    m = found(F.regexp_extract(_col(c), r"####\s*([^\n]+)", 1))
    return F.coalesce(F.replace(F.trim(m), F.lit(","), F.lit("")), F.trim(_col(c)))


def last_number(c: str | Column) -> Column:
    """The last number, thousands commas allowed, as a double; null without one."""
    all_ = F.regexp_extract_all(_col(c), F.lit(r"([-+]?\d+(?:,\d{3})*(?:\.\d+)?)"), 1)
    return F.when(F.size(all_) > 0, F.replace(F.element_at(all_, -1), F.lit(","), F.lit("")).try_cast("double"))


def answer_cascade(c: str | Column) -> Column:
    """Box, else 'the answer is', else last number, else last line."""
    c = _col(c)
    numbers = F.regexp_extract_all(c, F.lit(f"({NUMBER})"), 1)
    no_commas = lambda x: F.replace(x, F.lit(","), F.lit(""))
    said = F.trim(found(F.regexp_extract(c, r"[Tt]he answer is[:\s]*(.+?)[.\n]", 1)))
    return F.coalesce(boxed_first(c), no_commas(said), F.when(F.size(numbers) > 0, no_commas(F.element_at(numbers, -1))), F.trim(F.element_at(F.split(F.trim(c), "\n"), -1)))


def normalize_answer(c: str | Column) -> Column:
    """Answers for comparison: LaTeX wrappers, commas, currency and trailing units go; whole numbers lose their point."""
    a = F.trim(_col(c))
    for drop in (r"\left", r"\right", r"\(", r"\)", r"\[", r"\]"):
        a = F.replace(a, F.lit(drop), F.lit(""))
    for frac in (r"\dfrac", r"\tfrac"):
        a = F.replace(a, F.lit(frac), F.lit(r"\frac"))
    a = F.translate(a, ",$%", "")
    bare = lambda a: F.coalesce(found(F.regexp_extract(a, r"^(-?\d+\.?\d*)\s+[a-zA-Z]", 1)), a)

    def form(a: Column) -> Column:
        def number(v: Column) -> Column:
            whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
            return F.when(whole, v.cast("long").cast("string")).when(v.isNotNull(), v.cast("string")).otherwise(F.trim(F.lower(a)))

        return let(F.trim(a).try_cast("double"), number)

    return let(let(a, bare), form)


def option_label(c: str | Column) -> Column:
    """(A), [A], A) and A. to a, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(_col(c), r"[\(\[\{]([A-Za-z])[\)\]\}]|([A-Za-z])[.:\)]", "$1$2")))


def parse_number(c: str | Column) -> Column:
    """Digits without commas, percent as a share; null if it isn't a number."""
    t = F.replace(_col(c), F.lit(","), F.lit(""))
    share = F.when(F.endswith(t, F.lit("%")), F.regexp_replace(t, r"\\?%$", "").try_cast("double") / 100)
    return F.coalesce(t.try_cast("double"), share)


@pandas_udf(StringType())
def boxed_balanced(c):
    """The content of the last box whose braces balance, at any depth."""

    def scan(text):
        if text is None:
            return None
        at = len(text)
        while (at := text.rfind("\\boxed{", 0, at)) >= 0:
            depth = 0
            for i in range(at + 6, len(text)):
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                if depth == 0:
                    return text[at + 7 : i].strip()
        return None

    return c.map(scan)


@pandas_udf(StringType())
def rational(c):
    """Exact canonical form n or n/d of decimals, fractions and \\frac; other text loses its blanks."""
    from decimal import Decimal, InvalidOperation
    from fractions import Fraction

    whole = re.compile(r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?")
    tex = re.compile(r"\\d?frac\{(-?\d+)\}\{(-?\d+)\}")
    slash = re.compile(r"(-?\d+)\s*/\s*(-?\d+)")

    def form(text):
        if text is None:
            return None
        t = re.sub(r"\\(?:left|right|,|!|;|quad)", "", text.strip().strip("$"))
        if whole.fullmatch(t):
            t = t.replace(",", "")
        try:
            if m := tex.fullmatch(t) or slash.fullmatch(t):
                return str(Fraction(int(m[1]), int(m[2])))
            if len(t) > 400 or "e" in t.lower():
                raise ValueError
            return str(Fraction(Decimal(t)))
        except (ValueError, ZeroDivisionError, InvalidOperation, OverflowError):
            return re.sub(r"\s+", "", t.replace("\\dfrac", "\\frac"))

    return c.map(form)


def xml_field(c: str | Column, name: str) -> Column:
    """Trimmed content of the first <name> element, null without one."""
    return strip(found(F.regexp_extract(_col(c), rf"(?s)<{name}>(.*?)</{name}>", 1)))


def code_fence(c: str | Column) -> Column:
    """Content of the first code fence, else the trimmed text."""
    return F.coalesce(strip(found(F.regexp_extract(_col(c), r"(?s)```(?:\w+)?\n(.*?)```", 1))), strip(c))


def json_slice(c: str | Column) -> Column:
    """From the first { to the last }."""
    return found(F.regexp_extract(_col(c), r"(?s)(\{.*\})", 1))


#: Fixed value: what separates the fields of an extraction record.
FIELD_DELIMITER = "<|>"


def parse_records(rows: DataFrame, raw: str, delimiter: str = FIELD_DELIMITER, record: str = "##", end: str = "<END>") -> DataFrame:
    """Extraction output to rows: entities need four fields, relations five; names are upper case, the weight is the last
    field if it is a number, else 1. Adds record, name, kind, tgt, description, keywords, weight."""
    part = F.explode(split_markers(raw, [record, end]))
    body = rows.withColumn("_r", part).withColumn("_f", F.split(F.regexp_extract("_r", r"(?s)^\((.*)\)$", 1), re.escape(delimiter)))
    f = lambda i: strip_controls(F.get("_f", F.lit(i)))
    entity = (F.get("_f", F.lit(0)) == '"entity"') & (F.size("_f") >= 4) & (f(1) != "")
    relation = (F.get("_f", F.lit(0)) == '"relationship"') & (F.size("_f") >= 5)
    last = F.element_at("_f", -1)
    return (
        body.filter(entity | relation)
        .withColumns(
            {
                "record": F.when(entity, "entity").otherwise("relationship"),
                "name": F.upper(f(1)),
                "kind": F.when(entity, F.upper(f(2))),
                "tgt": F.when(relation, F.upper(f(2))),
                "description": f(3),
                "keywords": F.when(relation, f(4)),
                "weight": F.when(relation, F.when(is_float(last), last.try_cast("double")).otherwise(1.0)),
            }
        )
        .drop("_r", "_f")
    )
