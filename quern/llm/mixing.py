"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Sources in code-point order weigh 5, 2, 1, repeating, and share the words of the whole table; a target stops at ``MOST`` times its
source's words and the excess goes to the others by weight until none is above. Every source is a stream of words: its documents in the
order of a digest, a new order for each pass, cut into blocks of ``BLOCK`` words up to the target (the last one is shorter). The
schedule has as many slots as there are blocks: slot k falls at the point k / golden ratio modulo 1 (in exact integers), which picks the source whose
share of the cumulative blocks holds it, so that every stretch of the mix is near the weights. The r-th slot of a source takes
its r-th block. Low discrepancy leaves a few slots too many or too few of a source: the former are left out, the latter follow at the end, so
each source's taken words equal its rounded target and no word is taken more than ``MOST`` times.

Scale: texts are read once and leave as (source, id, digest, size). Ranks of slots, places of documents and ranks of sources are counted in
parts (of the slot number, of the digest, of the range of names), so a source that holds a third of all rows is never in one task;
points meet the shares by cells of the cumulative blocks, an equality join; nothing is broadcast by hint or collected
but one row of sums a round of sharing.

Edge cases: null texts and texts without a word have size 0 and are taken 0 times; a null source is a source, the last; null ids are rows like
any other; repeated rows are told apart by a number each, so that results don't depend on which is which; a table without words
gives targets of 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.curation import hash_part, ranked
from .common import checkpointed

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that the mix takes a source's words.
MOST = 3
#: Words of a block.
BLOCK = 1024
#: Slots of a cell in which points meet shares, and of a part in which a source's slots are ranked.
CELL, PART = 64, 1 << 14
#: The golden ratio's fraction in 40 bits (made odd, so that all points differ within a period).
_BITS, _GOLDEN = 40, round((5**0.5 - 1) / 2 * 2**40) | 1
_HALF = 1 << 20


def word_count(text: str | Column = "text") -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def point(k: Column) -> Column:
    """k times the golden ratio's fraction, modulo 1, as an integer of 40 bits; the product is taken in halves that fit 64 bits."""
    low, high = k % _HALF, F.floor(k / _HALF) % _HALF
    return (low * _GOLDEN + (high * _GOLDEN % _HALF) * _HALF) % (1 << _BITS)


def numbered(docs: DataFrame) -> DataFrame:
    """(source, doc_id, digest, copy, size): a row for each document; ``copy`` numbers rows of one source, id and text."""
    src = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"), word_count().alias("size"))
    n = src.groupBy("source", "doc_id", "digest", "size").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "doc_id", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), "size")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Each round shares what the stopped sources leave among the others by weight and stops those above ``most`` times their size. Sums are
    of whole numbers, so the shares don't depend on the order of adding."""
    order = F.col("source").asc_nulls_last()
    ranged = checkpointed(sizes.repartitionByRange(order).withColumn("at", F.spark_partition_id()))
    place = ranked(ranged, [], F.col("at"), [order])
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("_r") - 1) % len(weights)).cast("int")).cast("long")
    known = checkpointed(place.select("source", "source_size", weight.alias("weight")))
    total = known.agg(F.sum("source_size").alias("n")).first().n or 0
    share = 0.0
    while True:
        stopped = most * F.col("source_size") < share * F.col("weight")
        left = known.agg(F.coalesce(F.sum(F.when(stopped, most * F.col("source_size"))), F.lit(0)).alias("gone"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight")).first()
        new = (total - left.gone) / left.weight if left.weight else share
        if new <= share:
            break
        share = new
    return known.withColumn("target", F.least(F.col("source_size") * float(most), F.lit(share) * F.col("weight")))


def shares(goals: DataFrame, block: int) -> DataFrame:
    """goals with need (words to take), blocks, and from_block: the blocks of the sources before, in any fixed order."""
    need = F.floor(F.col("target") + 0.5)
    g = goals.withColumn("need", need).withColumn("blocks", F.ceil(F.col("need") / block))
    at = F.xxhash64("source")
    ranged = g.withColumn("_part", F.pmod(at, F.lit(4096)))
    n = ranged.groupBy("_part").agg(F.sum("blocks").alias("_n")).select(F.col("_part").alias("_of"), (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.sum("blocks").over(Window.partitionBy("_part").orderBy(at, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks")
    return ranged.withColumn("_inside", inside).join(n, F.col("_part") == F.col("_of")).withColumn("from_block", F.col("_before") + F.col("_inside")).drop("_part", "_of", "_before", "_inside")


def schedule(goals: DataFrame) -> DataFrame:
    """(slot, source, rank): the order of the mix and the block of the source that each slot takes, from (source, blocks, from_block)."""
    spark = goals.sparkSession
    slots = goals.agg(F.sum("blocks").alias("n")).first().n or 0
    k = spark.range(slots).withColumnRenamed("id", "slot")
    at = F.floor(point(F.col("slot")) * (slots / 2**_BITS))
    points = k.withColumn("at", F.least(at, F.lit(max(slots - 1, 0)))).withColumn("cell", F.floor(F.col("at") / CELL))
    own = goals.filter("blocks > 0").select("source", "from_block", "blocks")
    cells = own.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from_block") / CELL), F.floor((F.col("from_block") + F.col("blocks") - 1) / CELL))))
    met = points.join(cells, "cell").filter((F.col("at") >= F.col("from_block")) & (F.col("at") < F.col("from_block") + F.col("blocks")))
    placed = ranked(met.select("slot", "source", "blocks"), ["source"], F.floor(F.col("slot") / PART), [F.col("slot")])
    kept = placed.filter(F.col("_r") <= F.col("blocks")).select("slot", "source", (F.col("_r") - 1).alias("rank"))
    had = met.groupBy("source").agg(F.count(F.lit(1)).alias("had")).withColumnRenamed("source", "_source")
    short = own.join(had, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).filter("had < blocks")
    rest = short.select("source", "from_block", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("rank"))
    return kept.unionByName(rest.select((slots + F.col("from_block") + F.col("rank")).alias("slot"), "source", "rank"))


def passages(rows: DataFrame, goals: DataFrame, block: int, most: int = MOST) -> DataFrame:
    """(source, rank, doc_id, digest, copy, round, start, words): what each block of a source's stream holds, word ranges of documents."""
    own = goals.select(F.col("source").alias("_source"), "source_size", "need")
    met = rows.filter("size > 0").join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rounds = F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))
    met = met.withColumn("round", F.explode(rounds)).filter(F.col("round") * F.col("source_size") < F.col("need"))
    met = met.withColumn("order", F.md5(F.concat_ws("|", F.col("round").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"))))
    met = met.withColumn("part", hash_part(F.col("order")))
    n = met.groupBy("source", "round", "part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "round").orderBy("part")) - F.col("n")
    n = n.select(F.col("source").alias("_source"), F.col("round").alias("_round"), F.col("part").alias("_part"), before.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source", "round", "part").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    met = met.withColumn("inside", inside).join(n, F.col("source").eqNullSafe(F.col("_source")) & (F.col("round") == F.col("_round")) & (F.col("part") == F.col("_part")))
    met = met.withColumn("from", F.col("round") * F.col("source_size") + F.col("before") + F.col("inside")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("need"))).filter(F.col("from") < F.col("to"))
    cut = met.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    first, last = F.greatest(F.col("rank") * block, F.col("from")), F.least((F.col("rank") + 1) * block, F.col("to"))
    return cut.select("source", "rank", "doc_id", "digest", "copy", "round", (first - F.col("from")).alias("start"), (last - first).alias("words"))


def mixed(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, the documents and the sources.

    mix: (slot, source, rank, doc_id, digest, copy, round, start, words), to be read by slot, round, start; documents: (source, doc_id, digest, copy, size); sources:
    (source, source_size, weight, target, need, blocks, from_block)."""
    rows = checkpointed(numbered(docs))
    goals = checkpointed(shares(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), block))
    slots = schedule(goals).select("slot", F.col("source").alias("_source"), F.col("rank").alias("_rank"))
    mix = passages(rows, goals, block, most).join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("rank") == F.col("_rank"))).drop("_source", "_rank")
    return mix, rows, goals


def taken(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): a row for each document with the words that the mix takes of it."""
    mix, rows, goals = mixed(docs, block, weights, most)
    by = ["source", "doc_id", "digest", "copy"]
    got = mix.groupBy(*by).agg(F.sum("words").alias("taken")).toDF(*[f"_{c}" for c in by], "taken")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = goals.select(F.col("source").alias("_of"), "source_size", "target")
    out = rows.join(got, same, "left").join(own, F.col("source").eqNullSafe(F.col("_of")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: DuckDB SQL for taken() without the source: where a document's words stand in its source's stream decides how many are taken, whatever slot takes them.
TAKEN_SQL = r"""
with rows as (
  select source, doc_id, md5(coalesce(text, '')) as digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    row_number() over (partition by source, doc_id, md5(coalesce(text, ''))) as copy
  from documents
), sizes as (
  select source, sum(size)::bigint as source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from rows group by source
), walk as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as share
  from sizes window before as (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), goals as (
  select source, source_size, least(3.0::double * source_size, weight * (select coalesce(max(share), 0) from walk)) as target
  from sizes
), copies as (
  select r.*, g.source_size, g.target, floor(g.target + 0.5)::bigint as need, p.pass
  from rows r join goals g on r.source is not distinct from g.source, (select unnest([0, 1, 2]) as pass) p
), placed as (
  select *, pass * source_size + sum(size) over (partition by source, pass
    order by md5(pass || '|' || coalesce(doc_id::varchar, '') || '|' || digest || '|' || copy)) - size as start
  from copies
)
select doc_id, size, source_size, target, sum(greatest(least(need - start, size), 0))::bigint as taken
from placed group by source, doc_id, digest, copy, size, source_size, target"""
