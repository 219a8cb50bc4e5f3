"""Mixing sources to target weights with DataFrame functions only.

Targets are weights' shares of all words, no target above `cap` times its source's words, the rest
shared again by weight until none is above (solved in one pass over the sources sorted by the
share at which each is full). Blocks of `block` words are then apportioned by Sainte-Lague: seat s
of a party with v votes has the quotient v / (2 s + 1), and the highest quotients win. Sources get
blocks by their targets, then each source's shards get blocks by their words. In a shard the
documents of a source stand in a seeded order and its blocks are taken from there in turn, over
again from the start where a source repeats.

Only quotients near the outcome are ranked: rounding votes / block gives all but about one seat a
party, so that seats well below are given and seats well above are not, whatever the size.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own,
last; rows that repeat are documents of their own; an empty table gives an empty one. Columns of
the input other than those returned are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stored, text_of

WEIGHTS, CAP, BLOCK, SEED, SHARD_WORDS = (5, 2, 1), 3, 32, 7, 1 << 23


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("place"),
    )


def targets(by_source: DataFrame, total: int, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source_key, source_size, turn, target) of a table with a row per source."""
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("full", "turn")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights)).cast("int") + 1).cast("double")
    level = (F.lit(float(total)) - F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    found = by_source.withColumn("turn", F.row_number().over(turn) - 1).withColumns({"weight": weight, "most": F.col("source_size") * F.lit(float(cap))})
    found = found.withColumn("full", F.col("most") / F.col("weight")).withColumn("level", level)
    found = found.withColumn("share", F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(Window.partitionBy(F.lit(0))))
    return found.select("source_key", "source_size", "turn", F.round(F.least("most", F.coalesce(F.col("share") * F.col("weight"), F.col("most"))), 6).alias("target"))


def apportioned(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """parties with `quota`: its seats of the `seats` that each group has, by the highest quotients (ties: the lesser party)."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    frame = parties.withColumns({"all_votes": F.sum(votes).over(whole), "n_parties": F.count("*").over(whole)})
    fair = F.when(F.col("all_votes") > 0, F.col(votes) * F.col(seats) / F.col("all_votes")).otherwise(F.lit(0.0))
    frame = frame.withColumns({"near": F.floor(fair + 0.5), "slack": F.ceil(F.when(F.col("all_votes") > 0, F.col(votes) / F.col("all_votes")).otherwise(0.0) * F.col("n_parties")) + 2})
    frame = frame.withColumn("least", F.greatest(F.lit(0), F.col("near") - F.col("slack")))
    frame = frame.withColumn("open", F.col(seats) - F.sum("least").over(whole))
    quotients = frame.where(F.col(votes) > 0).select("*", F.explode(F.sequence("least", F.col("near") + F.col("slack"))).alias("seat"))
    ranked = quotients.withColumn("rank", F.row_number().over((whole).orderBy((F.col(votes) / (2 * F.col("seat") + 1)).desc(), party, "seat")))
    won = ranked.groupBy(*group, party).agg((F.first("least") + F.count(F.when(F.col("rank") <= F.col("open"), 1))).alias("quota"))
    return parties.join(won, [*group, party], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per document."""
    sized = stored(sizes(docs, seed))
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    by_source = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").cast("double").alias("source_size"))
    sources = stored(apportioned(targets(by_source, total, weights, cap).withColumn("blocks", F.lit(round(total / block))), [], "turn", "target", "blocks"))

    sharded = sized.withColumn("shard", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % shards)
    piles = sharded.groupBy("source_key", "shard").agg(F.sum("size").alias("pile"))
    piles = apportioned(piles.join(sources.select("source_key", F.col("quota").alias("blocks")), "source_key"), ["source_key"], "shard", "pile", "blocks")
    piles = piles.select("source_key", "shard", "pile", F.least(F.col("quota") * block, F.col("pile") * cap).alias("wanted"))
    piles = piles.withColumn("rounds", F.when(F.col("pile") > 0, F.expr("wanted div pile")).otherwise(F.lit(0)))

    seeded = Window.partitionBy("source_key", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sharded.withColumn("before", F.sum("size").over(seeded) - F.col("size"))
    rest = F.col("wanted") - F.col("rounds") * F.col("pile") - F.col("before")
    taken = (F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))).cast("long")
    return (
        placed.join(piles, ["source_key", "shard"])
        .join(sources.select("source_key", F.col("source_size").cast("long").alias("source_size"), "target"), "source_key")
        .select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
    )
