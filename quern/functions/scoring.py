"""Scores and decision rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def reasons(**rules: Column) -> Column:
    """Names of the rules that hold, in order; an unknown rule doesn't hold."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def first_reason(**rules: Column) -> Column:
    """The first rule that holds, null if none does."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def trigger(tree: dict | str | bool | None, facts: dict[str, Column]) -> Column:
    """A trigger tree compiled to three-valued logic: {'all_of': [...]}, {'any_of': [...]}, {'not': x}, {'optional': x} (true),
    {'guard': x} (true), or the name of a fact; unknown facts are null."""
    if isinstance(tree, str):
        return facts.get(tree, F.lit(None).cast("boolean"))
    if tree is None or isinstance(tree, bool):
        return F.lit(tree).cast("boolean")
    (kind, body), = tree.items()
    if kind in ("optional", "guard"):
        return F.lit(True)
    if kind == "not":
        return ~trigger(body, facts)
    parts = [trigger(x, facts) for x in body]
    out = F.lit(kind == "all_of")
    for p in parts:
        out = out & p if kind == "all_of" else out | p
    return out


def episode_score(success: Column, direct_hit: Column, seeded: Column, skill_admitted: Column, primitive_admitted: Column, attempts: Column, tokens: Column, latency_ms: Column, broken: Column, fallback: Column) -> Column:
    """One episode by success, reuse, growth and efficiency."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    return (
        F.when(success, 1.0).otherwise(-0.5)
        + flag(direct_hit, 0.4)
        + flag(seeded & success, 0.25)
        + flag(skill_admitted, 0.3)
        + flag(primitive_admitted, 0.2)
        - 0.05 * F.greatest(attempts - 1, F.lit(0))
        - F.least(F.lit(0.5), tokens / 5000.0)
        - F.least(F.lit(0.25), latency_ms / 20000.0)
        - flag(broken, 0.4)
        - flag(fallback, 0.1)
    )


def positive_transfer(count: Column, seeded_success: Column, seeded_uses: Column, first_attempt: Column, retry: Column) -> Column:
    """Historical positive transfer, at most 2.5."""
    rate = seeded_success / F.greatest(seeded_uses, F.lit(1))
    return F.least(0.35 * count + 0.75 * rate + 0.40 * F.greatest(first_attempt, F.lit(0.0)) + 0.25 * F.greatest(-retry, F.lit(0.0)), F.lit(2.5))


def negative_risk(count: Column, consecutive: Column, toxicity: Column) -> Column:
    """Negative transfer risk, at most 3."""
    return F.least(0.45 * count + 0.20 * consecutive + 0.60 * toxicity, F.lit(3.0))


def seed_cost(helpers: Column, assertions: Column, lines: Column) -> Column:
    """Estimated token cost of a seed, at most 1.25."""
    return F.least(0.25 + 0.03 * F.least(helpers, F.lit(5)) + 0.04 * F.least(assertions, F.lit(2)) + 0.015 * F.least(lines, F.lit(15)), F.lit(1.25))


def distillation_score(utility: Column, positive: Column, negative: Column, first_attempt: Column, retry: Column, tokens: Column, direct: Column) -> Column:
    zero = F.lit(0.0)
    return utility + 0.35 * positive - 0.45 * negative + 0.40 * F.greatest(first_attempt, zero) + 0.20 * F.greatest(-retry, zero) + 0.0005 * F.greatest(-tokens, zero) + 0.05 * direct


def lexical_overlap(task: Column, description: Column, pattern: Column, entry: Column, verifier: Column) -> Column:
    """Weighted sizes of token intersections."""
    n = lambda other: F.size(F.array_intersect(task, other))
    return 0.2 * n(description) + 0.4 * n(pattern) + 0.6 * n(entry) + 0.6 * n(verifier)


def compatibility(guard: Column, high_risk: Column, hits: Column, entry_mismatch: Column, affordance_mismatch: Column) -> Column:
    """1 minus penalties, between 0 and 1.2."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    s = 1.0 - flag(guard, 0.15) - flag(high_risk, 0.25) - F.when(hits > 0, F.least(F.lit(0.45), 0.25 * hits)).otherwise(0.0) - flag(entry_mismatch, 0.15) - flag(affordance_mismatch, 0.2)
    return clamp(s, 0.0, 1.2)


def skill_status(status: Column, utility: Column, failures: Column, audit_fails: Column, least: float = 0.35, most: int = 2, prune: int = 2) -> Column:
    """Status machine: draft, shadow and pruned stay; suppressed with enough failed audits is pruned; else by utility and streak."""
    return (
        F.when(status.isin("draft", "shadow", "pruned"), status)
        .when((status == "suppressed") & (audit_fails >= prune), "pruned")
        .when((utility < least) | (failures >= most), "suppressed")
        .otherwise("active")
    )


def transfer_control(positive: Column, negative: Column, utility: Column) -> Column:
    """Governance action, first match: prune, suppress, demote; null if none."""
    return (
        F.when((negative >= 3) & (positive <= 1) & (utility < 0.35), "prune")
        .when((negative >= 2) & (positive == 0), "suppress")
        .when((positive > 0) & (negative > positive), "demote")
    )


def public_action(environment: Column, truncated: Column, compile_failed: Column, public_failed: Column, contradiction: Column, missing_final: Column) -> Column:
    """Recovery action from public flags; null: none."""
    return F.when(environment, None).when(truncated, "continue").when(compile_failed | public_failed | contradiction, "repair").when(missing_final, "continue")


def decayed(severity: Column, age_hours: Column, scale: float = 72.0) -> Column:
    """severity x exp(-age / scale), age 0 at least."""
    return severity * F.exp(-F.greatest(age_hours, F.lit(0.0)) / scale)


def confidence(n: Column) -> Column:
    return n / (n + 10)


def transfer_utility(score: Column, exact: Column, compatible: Column, positive: Column, cost: Column, risk: Column, mismatch: Column) -> Column:
    """Worth of seeding a candidate: retrieval, signature and history against cost, risk and a wrong type."""
    signature = F.when(exact, 1.25).when(compatible, 0.85).otherwise(-0.75)
    return 0.18 * score + signature + 0.90 * positive - 1.15 * cost - 1.00 * risk - F.when(mismatch, 1.25).otherwise(0.0)


#: Seed modes from least to most, each with the utility it needs.
SEED_MODES = (("no_seed", None), ("guard_only_seed", 2.6), ("skeleton_only_seed", 3.5), ("code_excerpt_seed", 4.6))


def seed_mode(utility: Column, override: Column) -> Column:
    """The fullest mode that the utility reaches, or the override where it is a lesser one."""
    rank = lambda c: F.array_position(F.array(*[F.lit(m) for m, _ in SEED_MODES]), c)
    reached = F.coalesce(*[F.when(utility >= least, F.lit(m)) for m, least in reversed(SEED_MODES) if least is not None], F.lit(SEED_MODES[0][0]))
    return F.when((rank(override) > 0) & (rank(override) < rank(reached)), override).otherwise(reached)


def skill_total(family: Column, benchmark: Column, entry: Column, signature: Column, pattern: Column, overlap: Column, language: Column, function: Column, utility: Column, direct: Column) -> Column:
    """Recall plus rerank score of a skill for a code task."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    meaning = flag(family, 1.0) + flag(benchmark, 1.0) + flag(entry, 3.0) + flag(signature, 0.75) + flag(pattern, 1.0) + overlap
    fit = flag(benchmark, 1.0) + flag(language, 0.5) + flag(function, 0.5) + F.when(entry, 1.0).when(signature, 0.5).otherwise(-0.75) + flag(pattern, 0.5)
    return meaning + fit + utility + flag(benchmark & function & direct, 0.25)


def tokens_after(tokens: Column, end: Column, length: Column) -> Column:
    """Tokens behind a place of a text, by its share of the characters."""
    return tokens * (length - end) / length


def answers_equal(a: str | Column, b: str | Column) -> Column:
    """Equal as text, as numbers within 0.001, without spaces beside operators, or as sums in another order of terms."""
    a, b = _col(a), _col(b)
    number = lambda c: F.try_to_number(F.replace(F.trim(c), F.lit(","), F.lit("")), F.lit("S" + "9" * 20 + "D" + "9" * 10)).cast("double")
    tight = lambda c: F.regexp_replace(F.trim(c), r"\s*([-+*/^])\s*", "$1")
    terms = lambda c: F.array_sort(F.transform(F.split(F.trim(c), r"\+"), lambda t: F.trim(t)))
    x, y = number(a), number(b)
    near = F.abs(x - y) <= F.greatest(1e-9 * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-3))
    return (a == b) | F.when(x.isNotNull() & y.isNotNull(), near).otherwise((tight(a) == tight(b)) | (terms(a) == terms(b)))
