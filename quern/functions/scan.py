"""One-pass scanners of marked-up reasoning texts: boxes, maths spans, and boundaries that cut no formula."""

from __future__ import annotations

import re

from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())]))
#: What opens and closes a maths environment; a lone dollar isn't one behind a backslash.
OPENERS = {"\\[": "\\]", "\\(": "\\)", "$$": "$$", "$": "$"}
_BOX = re.compile(r"\\(?:boxed|fbox)\s*\{")
_GAP = re.compile(r"\n\s*\n")


def box_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Boxes whose braces balance, nested ones too, by one walk with a stack of open braces."""
    opens = {m.end() - 1: m.start() for m in _BOX.finditer(text)}
    if not opens:
        return []
    stack: list[int] = []
    out = []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            at = stack.pop()
            if at in opens:
                out.append(("boxed", opens[at], m.end(), text[at + 1 : m.start()]))
        # a closing brace without an open one closes nothing
    return sorted(out, key=lambda x: x[1])


def maths_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Maths environments from left to right; one that isn't closed is text, and what follows its opener is read on."""
    out, at, missing = [], 0, set()
    while at < len(text):
        m = _OPEN.search(text, at)
        if not m:
            break
        opener = m.group()
        if opener == "$" and m.start() and text[m.start() - 1] == "\\":
            at = m.end()
            continue
        end = -1
        for mark in (opener, "$") if opener == "$$" else (opener,):  # an unclosed $$ may be an empty pair of lone ones
            begin = m.start() + len(mark)
            end = -1 if mark in missing else _close(text, mark, begin)
            if end >= 0:
                break
            missing.add(mark)
        if end < 0:
            at = m.start() + 1
            continue
        close = end + len(OPENERS[mark])
        out.append(("maths", m.start(), close, text[begin:end]))
        at = close
    return out


_OPEN = re.compile(r"\\\[|\\\(|\$\$|\$")


def _close(text: str, mark: str, begin: int) -> int:
    """Place of the closing mark, or -1; a lone dollar doesn't close behind a backslash."""
    at = text.find(OPENERS[mark], begin)
    while mark == "$" and at > 0 and text[at - 1] == "\\":
        at = text.find("$", at + 1)
    return at


def safe_ends(text: str) -> list[int]:
    """Ends of paragraphs, but the last, that lie outside braces and maths: everything opened before is closed."""
    out, counts, last, dollars = [], [0, 0, 0], 0, [0, 0]
    begin = 0
    for m in _GAP.finditer(text):
        part = text[last : m.start()]
        last = m.start()
        for i, (a, b) in enumerate((("{", "}"), ("\\[", "\\]"), ("\\(", "\\)"))):
            counts[i] += part.count(a) - part.count(b)
        pairs = part.count("$$")
        dollars[0] += pairs
        dollars[1] += part.count("$") - 2 * pairs
        if text[begin : m.start()].strip() and not any(counts) and dollars[0] % 2 == 0 and dollars[1] % 2 == 0:
            out.append(m.start())
        begin = m.end()
    return out


@pandas_udf(_SPANS)
def spans(c):
    """Boxes and maths environments of a text by place: (kind, start, end, value), ends exclusive, in characters."""

    def run(t):
        if t is None:
            return None
        found = sorted(box_spans(t) + maths_spans(t), key=lambda x: (x[1], -x[2]))
        return [{"kind": k, "start": a, "end": z, "value": v} for k, a, z, v in found]

    return c.map(run)


@pandas_udf(ArrayType(IntegerType()))
def safe_boundaries(c):
    """Where a text may be cut between paragraphs without cutting a formula."""
    return c.map(lambda t: None if t is None else safe_ends(t))
