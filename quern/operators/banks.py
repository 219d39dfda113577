"""A bank of strategy cards under numbered operations: every card version with the operations between which it holds, and the lineage of merged and split cards.

cards: (card, subject, features array<string>, sources array<string>), the bank at operation 0, version 1, status candidate.
ops: (at long, action, cards array<string>, into, features array<string>, status, harmful boolean, saving double, enough boolean), at distinct and over 0:
  merge       the cards become the new card ``into``: candidate, a version above the highest of theirs, their sources together; they retire
  split       one row for each child (its own at): ``into`` of the one card, features a part of its; the card goes to quarantine
  transition  the cards take ``status``, which can't be active
  maintain    quarantine where ``harmful``, else retired where ``enough`` is known and ``saving`` is 0 or less, else no change"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def _checked(ok, what: str, value):
    """value where ok, else an error that stops the query."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col("into"), F.lit("-")), F.lit(" at "), F.col("at").cast("string"))))


def bank_history(cards: DataFrame, ops: DataFrame) -> DataFrame:
    """(card, version, status, subject, features, sources, valid_from, valid_to): valid_to is the operation that ends the row, null for the newest.

    Parents are read as they stood before the operation. Versions and sources run through chains of merges and splits in rounds of one generation, cut by
    checkpoints, until no card is left; a card's own operations are its only window."""
    ops = checkpointed(ops)
    base = cards.select("card", F.lit(0).cast("long").alias("born"), "subject", "features", F.array_sort(F.array_distinct("sources")).alias("sources"), F.lit(1).alias("version"))
    made = ops.filter(F.col("action").isin("merge", "split")).select("at", "action", "into", "features", F.explode("cards").alias("parent"))
    births = base.select("card", "born").union(ops.filter(F.col("action").isin("merge", "split")).select(F.col("into"), F.col("at"))).distinct()
    # the parent that a card's name meant at the operation
    earlier = made.join(births.toDF("parent", "parent_born"), "parent", "left").filter("parent_born < at or parent_born is null")
    links = earlier.groupBy("into", "at", "action", "features", "parent").agg(F.max("parent_born").alias("parent_born"))
    links = checkpointed(links.withColumn("parent_born", _checked(F.col("parent_born").isNotNull(), "no such card", F.col("parent_born"))))
    n = links.groupBy("into", "at").agg(F.count(F.lit(1)).alias("parents"))
    known, todo = checkpointed(base), n
    while todo.limit(1).count():
        met = links.join(todo.select("into", "at"), ["into", "at"]).join(known.select(F.col("card").alias("parent"), F.col("born").alias("parent_born"), "subject", F.col("features").alias("_features"), "sources", "version"), ["parent", "parent_born"])
        one = met.groupBy("into", "at", "action", "features").agg(
            F.count(F.lit(1)).alias("found"), F.min("subject").alias("subject"), F.max("subject").alias("_last"), F.max("version").alias("version"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.first("_features").alias("_features"),
        )
        whole = one.join(n, ["into", "at"]).filter("found = parents")
        subject = F.when(F.col("action") == "merge", _checked(F.col("subject") == F.col("_last"), "merge of several subjects", F.col("subject"))).otherwise(F.col("subject"))
        narrow = F.size(F.array_except("features", "_features")) == 0
        features = F.when(F.col("action") == "split", _checked(narrow, "a split must narrow the features", F.col("features"))).otherwise(F.col("features"))
        new = checkpointed(whole.select(F.col("into").alias("card"), F.col("at").alias("born"), subject.alias("subject"), features.alias("features"), "sources", (F.col("version") + 1).alias("version")))
        if new.limit(1).count() == 0:
            raise ValueError("operations wait for each other: a number stands twice")
        known = checkpointed(known.union(new))
        todo = checkpointed(todo.join(new.select(F.col("card").alias("into"), F.col("born").alias("at")), ["into", "at"], "left_anti"))
    changes = ops.select("at", "into", "action", F.explode("cards").alias("card"), "status", "harmful", "saving", "enough")
    manual = _checked(F.col("status") != "active", "activation needs admission", F.col("status"))
    kept_up = F.when(F.col("harmful"), "quarantine").when(F.col("enough") & (F.col("saving") <= 0), "retired")
    status = F.when(F.col("action") == "merge", F.when(F.col("card") != F.col("into"), "retired")).when(F.col("action") == "split", "quarantine").when(F.col("action") == "transition", manual).when(F.col("action") == "maintain", kept_up)
    moved = changes.select("card", "at", status.alias("status")).filter("status is not null").withColumn("_new", F.lit(False))
    events = known.select("card", F.col("born").alias("at"), F.lit("candidate").alias("status"), F.lit(True).alias("_new")).union(moved)
    own = Window.partitionBy("card").orderBy("at", F.desc("_new"))
    lasting = events.withColumn("valid_to", F.lead("at").over(own)).withColumn("born", F.max(F.when(F.col("_new"), F.col("at"))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = lasting.join(known, ["card", "born"])
    return out.select("card", "version", "status", "subject", "features", "sources", F.col("at").alias("valid_from"), "valid_to").filter("valid_to is null or valid_to > valid_from")


def bank_as_of(history: DataFrame, at: int) -> DataFrame:
    """The bank as it stood after operation ``at``."""
    return history.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
