"""Votes by groups of equivalent answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equivalence_votes(answers: DataFrame, task: str, candidate: str, answer: str, alike: Callable[[str, str], bool], usable: str | None = None) -> DataFrame:
    """(task, chosen, group, votes): the smallest candidate of the largest group of equivalent answers, ties by the smallest candidate.

    Candidates join, in their order, the first group whose first answer is ``alike`` theirs (pair verdicts need not be transitive, so the order counts); unusable or null
    answers join none, and where no candidate is usable the smallest one is chosen with 0 votes. Equal answers of a task are one row with its candidates before anything is
    compared, and tasks stream through the workers in key order, so what is held is one task's distinct answers."""
    ok = (F.col(usable) if usable else F.lit(True)) & F.col(answer).isNotNull()
    own = answers.select(F.col(task).alias("_t"), F.col(candidate).cast("long").alias("_c"), F.when(ok, F.col(answer).cast("string")).alias("_a"))
    one = own.groupBy("_t", "_a").agg(F.min("_c").alias("_c"), F.count(F.lit(1)).alias("_n"))
    kind = one.schema["_t"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list] = []  # [smallest candidate, votes, answers]
        state = {"task": None, "any": False, "least": None}

        def done() -> tuple:
            if groups:
                best = min(groups, key=lambda g: (-g[1], g[0]))
                return state["task"], best[0], sorted(best[2]), best[1]
            return state["task"], state["least"], [], 0

        for b in batches:
            out = []
            for t, a, c, n in zip(*(b.column(k).to_pylist() for k in ("_t", "_a", "_c", "_n"))):
                if not state["any"] or t != state["task"]:
                    if state["any"]:
                        out.append(done())
                    groups = []
                    state.update(task=t, any=True, least=c)
                state["least"] = min(state["least"], c)
                if a is None:
                    continue
                home = next((g for g in groups if alike(a, g[2][0])), None)
                if home is None:
                    groups.append([c, n, [a]])
                else:
                    home[0], home[1] = min(home[0], c), home[1] + n
                    home[2].append(a)
            if out:
                yield rows(out)
        if state["any"]:
            yield rows([done()])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (None, pa.int64(), pa.list_(pa.string()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["task", "chosen", "answers", "votes"])

    dealt = one.repartition("_t").sortWithinPartitions("_t", "_c", "_a")
    return dealt.mapInArrow(run, f"task {kind}, chosen long, answers array<string>, votes long").withColumnRenamed("task", task)


def near_numbers(tolerance: float) -> Callable[[str, str], bool]:
    """Verdict on two answers: equal texts, or numbers within the tolerance."""

    def alike(a: str, b: str) -> bool:
        if a == b:
            return True
        try:
            return abs(float(a) - float(b)) <= tolerance
        except ValueError:
            return False

    return alike
