"""Exact similarity joins of texts, and choices of rows that no two alike ones are among.

``similar_texts`` finds every pair with an insertion-deletion ratio of ``least`` or more by a positional index of q-grams. A pair of lengths n <= m at the
ratio is at most (1 - least)(n + m) single insertions and deletions apart. A deletion destroys at most q of the n - q + 1 gram places of a text, an insertion
q - 1, and what is kept stands in the same order at nearly the same place in the other. So with the places of every text ordered by how rare their grams are,
the first l + 1 places (l: the most that may be lost) of either text hold the rarest kept one of both: only these places are joined, within bands of
lengths and by the difference of the places. Texts too short for that promise meet by their band alone.

Short texts that may lose two characters at most need no grams: they meet in what they have left after so many deletions, so only true pairs meet (``short_pairs``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as N
from .lineage import checkpointed

#: Most rows of either side of a bucket that meet in one place.
SUB = 2048
#: Most characters of a text that meets others by deletions, and most deletions.
SHORT, LOST = 32, 2
_TINY = 1e-9
#: Characters that are counted one by one to bound what two texts share.
_LETTERS = " etaoinshrdlucmfwypvbgkjqxz"


def grams(text: str | Column, q: int) -> Column:
    """Every run of q characters, in order."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.length(t) - (q - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(t, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def in_sub_blocks(a: DataFrame, b: DataFrame, keys: list[str], by_a: str, by_b: str, sub: int = SUB) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with further key columns that cut every bucket (equal ``keys``) into blocks of about sub x sub rows, and the keys to join on.

    Each row of a goes to one stripe of its bucket and to every stripe of b's, so that all pairs still meet, once; small buckets have one block."""
    n = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb")), keys)
    n = n.select(*keys, F.ceil(F.col("_na") / sub).cast("int").alias("_ca"), F.ceil(F.col("_nb") / sub).cast("int").alias("_cb"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = a.join(n, keys).withColumn("_i", F.pmod(F.xxhash64(by_a), F.col("_ca")).cast("int")).withColumn("_j", every("_cb")).drop("_ca", "_cb")
    right = b.join(n, keys).withColumn("_j", F.pmod(F.xxhash64(by_b), F.col("_cb")).cast("int")).withColumn("_i", every("_ca")).drop("_ca", "_cb")
    return left, right, [*keys, "_i", "_j"]


def _whole(x: Column) -> Column:
    return F.floor(x + _TINY).cast("int")


def short_length(least: float) -> int:
    """The longest texts of which the ratio leaves all but ``LOST`` characters, whatever they are paired with."""
    most = lambda n: math.floor(2 * (1 - least) / (2 - least) * n + _TINY)
    return max(n for n in range(SHORT + 1) if most(n) <= LOST)


def short_pairs(one: DataFrame, least: float) -> DataFrame:
    """(_a, _b, _r): all pairs of texts up to ``short_length`` that reach the ratio, with it, from distinct texts (_k, _t, _yes, _no); a pair has a _yes on one side and a _no on the other.

    Texts of lengths n and m whose longest common subsequence has L characters both leave it after n - L and m - L deletions, so the longest text
    that both leave gives the ratio: nothing meets but pairs that reach it, and no text travels to be compared."""
    texts = one.filter(F.length("_t") <= short_length(least)).select("_k", "_t", "_yes", "_no", F.length("_t").alias("_n"))
    lengths = [r[0] for r in texts.select("_n").distinct().collect()]  # SHORT + 1 at most
    apart = lambda n, m: math.floor((1 - least) * (n + m) + _TINY)
    # deletions that a text of a length needs for the lengths there are
    needed = {n: sorted({k for m in lengths for k in range(LOST + 1) if 0 <= m - (n - k) <= apart(n, m) - k}) for n in lengths}
    t, n = F.col("_t"), F.col("_n")
    without = lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n))
    without_two = lambda i, j: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, j - i - 1), F.substring(t, j + 1, n))
    none = F.array().cast("array<string>")
    ones = F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), without)).otherwise(none)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.sequence(i + 1, F.greatest(n, F.lit(2))), lambda j: without_two(i, j))))
    left = [F.array(t), ones, F.when(n >= 2, pairs).otherwise(none)]
    asked = [n.isin([x for x, ks in needed.items() if k in ks]) for k in range(LOST + 1)]
    rest = F.concat(*[F.when(ask, F.array_distinct(c)).otherwise(none) for ask, c in zip(asked, left)])
    v = texts.select("_k", "_n", "_yes", "_no", F.explode(rest).alias("_v"))
    a, b = v.toDF("_a", "_na", "_ya", "_xa", "_v"), v.toDF("_b", "_nb", "_yb", "_xb", "_v")
    both = F.col("_na") + F.col("_nb")
    fits = (F.col("_a") < F.col("_b")) & (both - 2 * F.length("_v") <= _whole((1 - least) * both)) & ((F.col("_ya") & F.col("_xb")) | (F.col("_xa") & F.col("_yb")))
    met = a.join(b, "_v").filter(fits)
    return met.groupBy("_a", "_b").agg(F.max(2 * F.length("_v") / both).alias("_r"))


def candidate_pairs(one: DataFrame, least: float, q: int = 3, over: int = -1) -> DataFrame:
    """(_a, _b): numbers of texts that may reach the ratio, from distinct texts (_k, _t), the longer one of more than ``over`` characters; _a is the shorter one, of equal lengths the smaller number."""
    n = F.length("_t")
    one = one.filter(n * (2 - least) + 1 > over * least)  # others are too short for any such partner
    # most places lost of the shorter and of the longer text, as shares of its length: largest where both are equally long or differ as far as the ratio allows
    equal = (2 * q - 1) * (1 - least)
    short, long = _whole(max(equal, 2 * (q - 1) * (1 - least) / least) * n), _whole(max(equal, 2 * q * (1 - least) / (2 - least)) * n)
    band = lambda c: F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / math.log((2 - least) / least) + _TINY).cast("int") if least < 1 else c
    texts = one.select("_k", n.alias("_n"), grams("_t", q).alias("_g"), short.alias("_s"), long.alias("_l"))
    places = texts.select("_k", F.posexplode("_g").alias("_at", "_gram"))
    often = places.groupBy("_gram").agg(F.count(F.lit(1)).alias("_c"))
    ordered = places.join(often, "_gram").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_c", "_gram", "_at"))).alias("_o"))
    r = texts.select("_k", "_n", "_s", "_l").join(ordered, "_k", "left").withColumn("_o", F.coalesce("_o", F.array().cast("array<struct<_c:bigint,_gram:string,_at:int>>")))
    r = checkpointed(r)
    kept = lambda most: F.transform(F.slice("_o", 1, F.col(most) + 1), lambda p: F.struct(p["_gram"].alias("gram"), p["_at"].alias("at")))
    # a text whose places may all be destroyed makes no promise: it also stands under no gram, with its band alone
    bare = lambda most: F.when(F.size("_o") <= F.col(most), F.array(F.struct(F.lit("").alias("gram"), F.lit(0).alias("at")))).otherwise(F.array().cast("array<struct<gram:string,at:int>>"))
    side = lambda most: F.explode(F.concat(kept(most), bare(most))).alias("_p")
    # a longer text lies in the band of the shorter one or in the next
    a = r.select(F.col("_k").alias("_a"), F.col("_n").alias("_na"), side("_s"), band(F.col("_n")).alias("_x")).select("_a", "_na", "_p.*", F.explode(F.array(F.col("_x"), F.col("_x") + 1)).alias("band"))
    b = r.select(F.col("_k").alias("_b"), F.col("_n").alias("_nb"), side("_l"), band(F.col("_n")).alias("band")).filter(F.col("_nb") > over).select("_b", "_nb", "_p.*", "band")
    a, b = a.withColumnRenamed("at", "_ata"), b.withColumnRenamed("at", "_atb")
    a, b, keys = in_sub_blocks(a, b, ["gram", "band"], "_a", "_b")
    apart = _whole((1 - least) * (F.col("_na") + F.col("_nb")))  # insertions and deletions
    longer = F.col("_nb") - F.col("_na")
    moved = F.col("_ata") - F.col("_atb")
    fits = (longer >= 0) & ((longer > 0) | (F.col("_a") < F.col("_b"))) & (longer <= apart)
    near = (F.col("gram") == "") | ((moved <= F.floor((apart - longer) / 2)) & (-moved <= F.floor((apart + longer) / 2)))
    return a.join(b, keys).filter(fits & near).select("_a", "_b").distinct()


def similar_texts(rows: DataFrame, key: str, text: str, least: float, q: int = 3, across: str | None = None) -> DataFrame:
    """(left, right, ratio), left < right: all pairs of distinct texts with an insertion-deletion ratio of ``least`` (over 0) or more. Copies of one text stand for
    the smallest key, null texts take no part. across: a boolean column; only pairs of one text with a true row and another with a false one."""
    sides = [F.bool_or(across).alias("_yes"), F.bool_or(~F.col(across)).alias("_no")] if across else [F.lit(True).alias("_yes"), F.lit(True).alias("_no")]
    one = checkpointed(rows.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("_t")).agg(F.min(key).alias("_k"), *sides))
    over = short_length(least)
    found = candidate_pairs(one, least, q, over)
    a = one.select(F.col("_k").alias("_a"), F.col("_t").alias("_ta"), F.col("_yes").alias("_ya"), F.col("_no").alias("_xa"))
    b = one.select(F.col("_k").alias("_b"), F.col("_t").alias("_tb"), F.col("_yes").alias("_yb"), F.col("_no").alias("_xb"))
    met = found.join(a, "_a").join(b, "_b").filter((F.col("_ya") & F.col("_xb")) | (F.col("_xa") & F.col("_yb")))
    # few rows that cost much each: spread, where the bytes alone would put them in one task
    met = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_a", "_b")
    met = met.select("_a", "_b", N.indel_ratio("_ta", "_tb").alias("_r")).union(short_pairs(one, least))
    scored = met.select(F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"), "_r")
    return scored.filter(F.col("_r") >= least - 1e-12).select("left", "right", F.round("_r", 9).alias("ratio"))


def first_apart(order: DataFrame, pairs: DataFrame, quota: int | None = None) -> DataFrame:
    """(key, chosen) of the greedy choice in a fixed order: a row is chosen if no chosen row before it is alike and its stratum isn't full.

    order: (key, place, stratum) with distinct places, a stratum's rows in a row of places; pairs: (left, right) keys that are alike; quota: most chosen rows of a stratum. Rows are
    decided in rounds: a row is out once a row before it that is alike is in, in once all those are out or past their full strata and fewer rows than
    the quota are left before it in its own. The first undecided row is decided in every round, chains of n alike rows
    take n rounds at most, and all rows without a pair are decided in the first. Rounds are cut by checkpoints; only a count reaches the driver."""
    ends = pairs.select("left", "right").union(pairs.select("right", "left")).toDF("_x", "_y").distinct()
    at = order.select("key", "place", "stratum")
    x, y = at.toDF("_x", "_px", "_sx"), at.toDF("_y", "_py", "_sy")
    before = checkpointed(ends.join(x, "_x").join(y, "_y").filter("_py < _px").select(F.col("_x").alias("later"), F.col("_y").alias("earlier")))
    hit = before.select(F.col("later").alias("key")).distinct().withColumn("_hit", F.lit(True))
    rows = at.join(hit, "key", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    if quota is not None:
        # a stratum has chosen its quota within its first quota rows and as many more as may be out
        from .curation import ranked

        rows = ranked(rows, ["stratum"], F.floor(F.col("place") / 4096), [F.col("place")]).drop("_size")
        outs = rows.groupBy("stratum").agg(F.count_if("_hit").alias("_outs"))
        rows = rows.join(outs, "stratum").filter(F.col("_r") <= quota + F.col("_outs")).drop("_r", "_outs")
    state = checkpointed(rows.withColumn("fate", F.when(~F.col("_hit") & F.lit(quota is None), F.lit("in"))).drop("_hit"))
    while True:
        if quota is None:
            now = state.withColumn("_left", F.lit(0)).withColumn("_had", F.lit(0))
            few = F.lit(quota is None)
            full = F.lit(False)
        else:
            w = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
            open_ = F.coalesce(F.sum(F.when(F.coalesce(F.col("fate") != "out", F.lit(True)), 1).otherwise(0)).over(w), F.lit(0))
            had = F.coalesce(F.sum(F.when(F.col("fate") == "in", 1).otherwise(0)).over(w), F.lit(0))
            now = state.withColumn("_left", open_).withColumn("_had", had)
            few, full = F.col("_left") < quota, F.col("_had") >= quota
        now = now.withColumn("_fate", F.coalesce("fate", F.when(full, "past")))
        seen = before.join(now.select(F.col("key").alias("earlier"), F.col("_fate").alias("was"), F.lit(True).alias("_known")), "earlier", "left")
        # rows cut before the rounds are past their full strata
        was = F.when(F.col("_known").isNull(), F.lit("past")).otherwise(F.col("was"))
        sums = seen.groupBy("later").agg(F.bool_or(was.eqNullSafe(F.lit("in"))).alias("_in"), F.bool_or(was.isNull()).alias("_open"))
        new = now.join(sums, now["key"] == sums["later"], "left").select(
            "key", "place", "stratum",
            F.coalesce("_fate", F.when(F.coalesce("_in", F.lit(False)), "out").when(~F.coalesce("_open", F.lit(False)) & few, "in")).alias("fate"),
        )
        state = checkpointed(new)
        if state.filter("fate is null").limit(1).count() == 0:
            break
    return at.select("key").join(state.select("key", "fate"), "key", "left").select("key", F.coalesce(F.col("fate") == "in", F.lit(False)).alias("chosen"))


def nearest_by_words(rows: DataFrame, key: str, words: str, least: float) -> DataFrame:
    """(key, other, sim): the other row of highest word Jaccard at or above ``least`` (over 0), ties by smallest key.

    Exact prefix filter by falling bounds: sets of Jaccard similarity s share one of the rarest n - ceil(s n) + 1 words of either, so rows first look for a
    partner at a high similarity, where only rare words meet; whoever has found one is done, and the others look again at half the bound."""
    r = rows.select(F.col(key).alias("_k"), F.array_distinct(words).alias("_f")).filter(F.size("_f") > 0)
    w = r.select("_k", F.explode("_f").alias("_w"))
    often = w.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    o = checkpointed(w.join(often, "_w").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_o")).select("_k", F.transform("_o", lambda x: x["_w"]).alias("_f")))
    todo, done, bound = o, None, 0.8
    while True:
        bound = max(bound, least)
        n = F.size("_f")
        front = lambda d: d.select("_k", n.alias("_n"), F.explode(F.slice("_f", 1, (n - F.ceil(F.lit(bound) * n - _TINY) + 1).cast("int"))).alias("_w"))  # noqa: B023, E731
        a = front(todo).toDF("_a", "_na", "_w")
        b = front(o).toDF("_b", "_nb", "_w")
        a, b, keys = in_sub_blocks(a, b, ["_w"], "_a", "_b")
        met = a.join(b, keys).filter((F.col("_a") != F.col("_b")) & (F.least("_na", "_nb") >= bound * F.greatest("_na", "_nb") - _TINY)).select("_a", "_b").distinct()
        met = met.join(o.toDF("_a", "_fa"), "_a").join(o.toDF("_b", "_fb"), "_b")
        both = F.size(F.array_intersect("_fa", "_fb"))
        sim = F.round(both / (F.size("_fa") + F.size("_fb") - both), 9)
        found = met.select("_a", "_b", sim.alias("_sim")).filter(F.col("_sim") >= F.round(F.lit(bound), 9))
        best = checkpointed(found.groupBy("_a").agg(F.min_by(F.struct("_b", "_sim"), F.struct((-F.col("_sim")).alias("s"), "_b")).alias("_best")).select(F.col("_a").alias(key), F.col("_best._b").alias("other"), F.col("_best._sim").alias("sim")))
        done = best if done is None else done.union(best)
        if bound <= least:
            return done
        todo = checkpointed(todo.join(best.select(F.col(key).alias("_k")), "_k", "left_anti"))
        bound /= 2


def block_pairs(one: DataFrame, least: float, blocks, sub: int = 256) -> DataFrame:
    """(_a, _ta, _b, _tb): pairs of distinct texts (_k, _t) of a common block that may reach the insertion-deletion ratio, each once; _a is the shorter one, of equal lengths the smaller key.

    Only rows of blocks with two rows or more travel, each once a block. They meet within bands of lengths, blocks of any size in sub x sub rows at once. A pair stays if the characters that both
    hold, whatever their order, would reach the ratio."""
    n = F.length("_t")
    band = F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log((2 - least) / least) + _TINY).cast("int") if least < 1 else n
    uses = [n - F.length(F.replace("_t", F.lit(c))) for c in _LETTERS]
    uses = F.array(*uses, n - sum(uses[1:], uses[0]))  # the last one: all other characters
    rows = one.select("_k", "_t", n.alias("_n"), band.alias("band"), F.array_distinct(blocks("_t")).alias("_bs"))
    rows = rows.withColumn("_block", F.explode("_bs"))
    rows = rows.join(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_block"), "_block", "left_semi").withColumn("_u", uses)
    names = ["_k", "_t", "_n", "_bs", "_u"]
    # a longer text lies in the band of the shorter one or in the next
    a = rows.select("_block", *[F.col(c).alias(f"{c}a") for c in names], F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    b = rows.select("_block", *[F.col(c).alias(f"{c}b") for c in names], "band")
    a, b, keys = in_sub_blocks(a, b, ["_block", "band"], "_ka", "_kb", sub)
    longer = F.col("_nb") - F.col("_na")
    fits = ((longer > 0) | ((longer == 0) & (F.col("_ka") < F.col("_kb")))) & (longer <= _whole((1 - least) * (F.col("_na") + F.col("_nb"))))
    first = F.get(F.array_intersect("_bsa", "_bsb"), 0) == F.col("_block")  # pairs of several blocks meet in one
    common = [F.least(F.get("_ua", i), F.get("_ub", i)) for i in range(len(_LETTERS) + 1)]
    met = a.join(b, keys).filter(fits & first & (2 * sum(common[1:], common[0]) >= (least - _TINY) * (F.col("_na") + F.col("_nb"))))
    return met.select(F.col("_ka").alias("_a"), F.col("_ta").alias("_ta"), F.col("_kb").alias("_b"), F.col("_tb").alias("_tb"))


def similar_in_blocks(rows: DataFrame, key: str, text: str, least: float, blocks) -> DataFrame:
    """(left, right, ratio): pairs of distinct texts of a common block whose matching-blocks ratio is ``least`` or more; blocks: (text) -> array of block names.

    That ratio is at most the insertion-deletion one, which is cheaper and leaves few pairs to be matched."""
    one = checkpointed(rows.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("_t")).agg(F.min(key).alias("_k")))
    met = block_pairs(one, least, blocks)
    # few rows that cost much each: spread, where the bytes alone would put them in one task
    met = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_a", "_b")
    turned = F.col("_a") > F.col("_b")
    x, y = F.when(turned, F.col("_tb")).otherwise(F.col("_ta")), F.when(turned, F.col("_ta")).otherwise(F.col("_tb"))
    scored = met.select(F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"), F.round(N.sequence_ratio_from(x, y, least - _TINY), 9).alias("ratio"))
    return scored.filter(F.col("ratio") >= least)
