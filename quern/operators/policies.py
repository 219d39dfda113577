"""Routing policies that episodes move: deltas in four dimensions and directives, as folds in batch and as keyed state in streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import clamped_fold

#: What an episode of each kind moves. (kind, dimension, channel, step, also by subtype, directive)
RULES = (
    ("fresh", "pattern", "direct", -0.05, True, ""),
    ("seeded", "benchmark", "seeded", 0.1, True, "prefer selective seed reuse when prior fits"),
    ("seeded", "pattern", "seeded", 0.1, True, "prefer selective seed reuse when prior fits"),
    ("seeded", "skill", "seeded", 0.1, True, "prefer reuse of this successful seed carefully"),
    ("direct", "benchmark", "direct", 0.05, True, ""),
    ("direct", "pattern", "direct", 0.05, True, ""),
    ("direct", "skill", "direct", 0.05, True, ""),
    ("seed_failed", "benchmark", "seeded", -0.1, True, ""),
    ("seed_failed", "pattern", "seeded", -0.1, True, "avoid over-relying on seed code"),
    ("seed_failed", "skill", "seeded", -0.1, True, "avoid over-relying on this seed code"),
    ("suppressed", "skill", "direct", -0.5, False, "avoid suppressed skill reuse"),
    ("suppressed", "skill", "seeded", -0.5, False, "avoid suppressed skill reuse"),
    ("pruned", "skill", "direct", -0.5, False, "avoid pruned skill reuse"),
    ("pruned", "skill", "seeded", -0.5, False, "avoid pruned skill reuse"),
)
_STEP = "array<struct<place:int,dimension:string,name:string,channel:string,subtype:string,step:double,directive:string>>"


def kinds() -> dict[str, Column]:
    """Which kinds an episode (provenance, success, mode, reuse, status_after, skill) is of."""
    c = F.col
    return {
        "fresh": (c("provenance") == "pure_dynamic_success") & c("reuse"),
        "seeded": c("provenance") == "seeded_dynamic_success",
        "direct": (c("provenance") == "direct_skill_reuse") & c("success"),
        "seed_failed": (c("mode") == "skill_seeded_dynamic") & ~c("success"),
        "suppressed": c("status_after") == "suppressed",
        "pruned": c("status_after") == "pruned",
    }


def policy_steps(episodes: DataFrame) -> DataFrame:
    """(ts, seq, place, dimension, name, channel, subtype, step, directive) of episodes (ts, seq, benchmark, pattern, skill, subtype, ...): one row a moved delta; an
    empty subtype is the dimension's own. Episodes without a skill move no skill."""
    is_, out = kinds(), []
    for place, (kind, dimension, channel, step, by_subtype, directive) in enumerate(RULES):
        on = is_[kind] & F.col(dimension).isNotNull()
        for n, subtype in enumerate((F.lit(""), F.col("subtype"))[: 2 if by_subtype else 1]):
            row = F.struct(
                F.lit(2 * place + n).alias("place"), F.lit(dimension).alias("dimension"), F.col(dimension).cast("string").alias("name"), F.lit(channel).alias("channel"), subtype.alias("subtype"), F.lit(step).alias("step"), F.lit(directive).alias("directive")
            )
            out.append(F.when(on & (subtype != "") if n else on, row))
    rows = F.filter(F.array(*out).cast(_STEP), lambda x: x.isNotNull())
    return episodes.select("ts", "seq", F.explode(rows).alias("_s")).select("ts", "seq", "_s.*")


def policy_deltas(steps: DataFrame) -> DataFrame:
    """(dimension, name, channel, subtype, delta): every delta after all its steps, clamped to [-1, 1] at each, to four places."""
    by = ["dimension", "name", "channel", "subtype"]
    keyed = steps.withColumn("key", F.struct(*by)).withColumn("block", F.date_trunc("hour", "ts"))
    out = clamped_fold(keyed, "key", "block", ["ts", "seq", "place"], "step", 0.0, -1.0, 1.0)
    return out.select("key.*", F.round("value", 4).alias("delta"))


def policy_directives(steps: DataFrame) -> DataFrame:
    """(dimension, name, subtype, directive, place): distinct directives in the order in which they first came."""
    from pyspark.sql import Window

    first = steps.filter("directive <> ''").groupBy("dimension", "name", "subtype", "directive").agg(F.min(F.struct("ts", "seq", "place")).alias("_at"))
    # a few directives a key
    return first.withColumn("place", F.row_number().over(Window.partitionBy("dimension", "name", "subtype").orderBy("_at"))).drop("_at")


STREAMED = "dimension string, name string, channel string, subtype string, delta double, directives array<string>"


def policy_stream(steps: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """STREAMED rows of every delta that a trigger has moved, with the directives of its subtype so far. State: a map of deltas and a list of directives for each (dimension, name);
    with ``ttl_ms`` directives that nothing repeats for so long are forgotten."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Policy(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.deltas = handle.getMapState("deltas", "channel string, subtype string", "delta double")
            self.said = handle.getMapState("said", "subtype string, directive string", "place long", **({"ttlDurationMs": ttl_ms} if ttl_ms else {}))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            moved: dict[tuple, float] = {}
            order: dict[tuple, int] = {tuple(k): v[0] for k, v in self.said.iterator()}
            top = max(order.values(), default=0)
            batch = pd.concat(list(rows)).sort_values(["ts", "seq", "place"])
            for channel, subtype, step, directive in zip(batch.channel, batch.subtype, batch.step, batch.directive):
                at = (channel, subtype)
                if at not in moved:
                    moved[at] = self.deltas.getValue(at)[0] if self.deltas.containsKey(at) else 0.0
                moved[at] = round(max(-1.0, min(1.0, moved[at] + step)), 4)
                if directive and (subtype, directive) not in order:
                    top += 1
                    order[subtype, directive] = top
                    self.said.updateValue((subtype, directive), (top,))
                elif directive and ttl_ms:
                    self.said.updateValue((subtype, directive), (order[subtype, directive],))
            for at, value in moved.items():
                self.deltas.updateValue(at, (value,))
            lines = [(*key, c, s, v, [d for (of, d), _ in sorted(order.items(), key=lambda x: x[1]) if of == s]) for (c, s), v in moved.items()]
            yield pd.DataFrame(lines, columns=["dimension", "name", "channel", "subtype", "delta", "directives"])

        def close(self) -> None:
            pass

    return steps.groupBy("dimension", "name").transformWithStateInPandas(statefulProcessor=Policy(), outputStructType=STREAMED, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


# generator state ----------------------------------------------------------------------------------------------------

#: What makes a skill a macro action, a motif active, a pattern's skills worth preferring, and a strategy worth telling.
MACRO_RATE, MACRO_USES, MOTIF_SUPPORT, PREFER_UTILITY = 0.7, 3, 3, 0.7
RELIABLE = (0.8, 2, 0.7)  # utility, direct uses, direct success rate
SEEDING = (3, 0.4, 0.7)  # seeded uses, rates below and from which it is told
RISKY_TRANSFERS = 3


def skill_uses(episodes: DataFrame) -> DataFrame:
    """A row for each skill that an episode used (used: array), with what it adds to the skill's counts."""
    seeded, direct = F.col("mode") == "skill_seeded_dynamic", F.col("provenance") == "direct_skill_reuse"
    n = lambda c: c.cast("long")
    return episodes.select(
        F.explode(F.array_distinct("used")).alias("skill"), "ts", "seq", "pattern", "status_after", n(seeded).alias("seeded"), n(seeded & F.col("success")).alias("seeded_ok"), n(direct).alias("direct"), n(direct & F.col("success")).alias("direct_ok"),
    )


def action_layer(uses: DataFrame) -> DataFrame:
    """(skill, role, insertion, direct_rate, seeded_rate) after all uses. A use makes its skill a macro action once seeding has worked often enough so far, or suppressed where the skill is by then; the last such
    use counts, and a skill that ever was suppressed stays disabled. Counts so far are taken in hours first, so that no skill's uses are sorted in one task."""
    from pyspark.sql import Window

    hour = F.date_trunc("hour", "ts")
    u = uses.withColumn("_hour", hour)
    sums = u.groupBy("skill", "_hour").agg(F.sum("seeded").alias("_s"), F.sum("seeded_ok").alias("_k"))
    past = Window.partitionBy("skill").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("skill", "_hour", F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_k").over(past), F.lit(0)).alias("_k0"))
    inside = Window.partitionBy("skill", "_hour").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    now = u.withColumn("_s", F.sum("seeded").over(inside)).withColumn("_k", F.sum("seeded_ok").over(inside)).join(before, ["skill", "_hour"])
    n, k = F.col("_s0") + F.col("_s"), F.col("_k0") + F.col("_k")
    gone = F.col("status_after").isin("suppressed", "pruned")
    turn = F.when(gone, "suppressed").when((n >= MACRO_USES) & (k / F.greatest(n, F.lit(1)) > MACRO_RATE), "macro_action")
    rate = lambda ok, n: F.round(F.when(F.sum(n) > 0, F.sum(ok) / F.sum(n)).otherwise(0.0), 4)
    out = now.withColumn("_turn", turn).groupBy("skill").agg(
        F.max_by("_turn", F.when(F.col("_turn").isNotNull(), F.struct("ts", "seq"))).alias("role"), F.bool_or(gone).alias("gone"), rate("direct_ok", "direct").alias("direct_rate"), rate("seeded_ok", "seeded").alias("seeded_rate")
    )
    return out.select("skill", F.coalesce("role", F.lit("planning_prior")).alias("role"), F.when(F.col("gone"), "disabled").otherwise("soft_hint").alias("insertion"), "direct_rate", "seeded_rate")


def motif_layer(episodes: DataFrame) -> DataFrame:
    """(motif, pattern, skills, support, active): sets of skills of successful seeded episodes by task pattern, named by the first episode's order."""
    good = episodes.filter((F.col("mode") == "skill_seeded_dynamic") & F.col("success") & (F.size("used") > 0))
    g = good.groupBy("pattern", F.array_sort(F.array_distinct("used")).alias("skills")).agg(F.count(F.lit(1)).alias("support"), F.min_by("used", F.struct("ts", "seq")).alias("_first"))
    name = F.concat_ws("_", F.lit("motif"), "pattern", F.array_join(F.slice("_first", 1, 3), "_"))
    return g.select(name.alias("motif"), "pattern", "skills", "support", (F.col("support") >= MOTIF_SUPPORT).alias("active"))


def bias_layer(episodes: DataFrame) -> DataFrame:
    """(name, delta): the generator's own two deltas after all episodes, clamped at each."""
    is_ = kinds()
    moves = (("seeded_delta", "seeded", 0.1), ("direct_skill_delta", "direct", 0.05), ("seeded_delta", "seed_failed", -0.1))
    rows = F.array_compact(F.array(*[F.when(is_[kind], F.struct(F.lit(name).alias("name"), F.lit(i).alias("place"), F.lit(step).alias("step"))) for i, (name, kind, step) in enumerate(moves)]))
    steps = episodes.select("ts", "seq", F.explode(rows).alias("_m")).select("ts", "seq", "_m.*").withColumn("block", F.date_trunc("hour", "ts"))
    return clamped_fold(steps, "name", "block", ["ts", "seq", "place"], "step", 0.0, -1.0, 1.0).select("name", F.round("value", 4).alias("delta"))


def directive_layer(cards: DataFrame, episodes: DataFrame) -> DataFrame:
    """(directive): what the bank's statistics say to later episodes. cards: (skill, pattern, utility, direct_ok, direct, seeded_ok, seeded, positive, negative), the active ones."""
    p = cards.groupBy("pattern").agg(F.avg("utility").alias("utility"), *[F.sum(c).alias(c) for c in ("direct_ok", "direct", "seeded_ok", "seeded", "positive", "negative")])
    seen = p.join(episodes.select("pattern").distinct(), "pattern", "left_semi")
    prefer = seen.filter(F.col("utility") > PREFER_UTILITY).select(F.concat(F.lit("prefer skill-conditioned generation for "), "pattern").alias("directive"))
    avoid = cards.filter("negative > positive and negative > 0").select(F.concat(F.lit("avoid "), "skill", F.lit(" for seeded generation")))
    told = lambda text, *args: F.concat(F.lit("[strategy] pattern '"), F.col("pattern"), F.lit("': "), F.format_string(text, *args))
    rate = F.col("seeded_ok") / F.greatest("seeded", F.lit(1))
    reliable = (F.col("utility") >= RELIABLE[0]) & (F.col("direct") >= RELIABLE[1]) & (F.col("direct_ok") / F.greatest("direct", F.lit(1)) >= RELIABLE[2])
    enough = F.col("seeded") >= SEEDING[0]
    lines = F.array_compact(F.array(
        F.when(reliable, told("direct skill reuse is reliable (%d/%d success)", "direct_ok", "direct")),
        F.when(enough & (rate < SEEDING[1]), told("avoid seeded generation -- historical seeded success only %d/%d", "seeded_ok", "seeded")),
        F.when(enough & (rate >= SEEDING[2]), told("seeded generation is effective (%d/%d success)", "seeded_ok", "seeded")),
        F.when((F.col("negative") >= RISKY_TRANSFERS) & (F.col("negative") > F.col("positive")), told("high negative transfer risk -- consider fresh dynamic generation instead of skill reuse")),
    ))
    return prefer.union(avoid).union(p.select(F.explode(lines)))
