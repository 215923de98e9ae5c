"""Mixing sources to target weights over packed blocks.

The words of a source's documents follow each other and are packed into blocks of BLOCK words. Every source gets
slots: as many whole passes over its blocks as its target holds, and a last pass that ends at the target. For every
output shard the number of slots of each source is drawn: multinomial over the shards, given that a source's total meets its
target (``drawn``). A shard's slots of a source are a range of slot numbers; a slot's place in its pass goes through the
source's pseudorandom permutation of block numbers, so a pass takes each block once at most, and blocks are joined to
slots by (source, block). The last slot of a pass that ends within a block takes the first words of it, so totals meet
targets to a word.

Hot sources: positions come from sums per (source, bucket of doc_id), and windows run inside such buckets.
Null text or no words: size 0, taken 0. Null source: a source of its own. Rows with equal doc_ids, null ones included, stay
apart. Very long texts cover many blocks. An empty table gives an empty result; extra columns are left out
(``mixed_documents`` keeps them, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, only, stored, table
from .feistel import feistel

BLOCK = 64
BUCKETS = 256
SHARDS = 16
WEIGHTS = (3, 1, 2)
SLOTS_A_TASK = 65_536
FEW_SOURCES = 2_000


def sized(docs: DataFrame) -> DataFrame:
    """docs with size (words), skey (source, null told apart), bucket and tie (order among equal doc_ids)."""
    return docs.select(
        "*",
        F.coalesce(F.expr(f"cast(regexp_count(text, r'{WORD}') as bigint)"), F.lit(0)).alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
        F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.xxhash64("text").alias("tie"),
    )


def targets(sums: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Target words of every source, one row each: skey, source_size, target.

    Level l with sum(least(most * size, l * weight)) = share * sum(size): sources in ascending order of
    cap / weight stop at their cap until the rest, shared by weight, lies below the next cap.
    The windows run over one row a source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sums.groupBy("skey", "source").agg(F.sum("part").alias("source_size")).withColumn("w", w)
    t = t.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", "skey")
    t = t.withColumn("total", share * F.sum("source_size").over(every)).withColumn("below", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("level", (F.col("total") - F.col("below")) / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey"))).over(every))
    return t.select("skey", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def packed(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """rows with ``start``, the number of words of their source before them."""
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    firsts = sums.select("skey", "bucket", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(firsts, ["skey", "bucket"]).withColumn("start", F.col("first") + F.coalesce(F.sum("size").over(own), F.lit(0))).drop("first")


def drawn(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """sources (one row each: skey, key, n_slots, ...) with ``cuts``: the slot number at which each shard's slots end."""

    def draw(batches):
        for t in batches:
            cuts = [np.cumsum(np.random.default_rng([int(k) % 2**64, seed]).multinomial(int(n), [1 / shards] * shards)).tolist() for k, n in zip(t["key"], t["n_slots"], strict=True)]
            yield t.assign(cuts=pd.Series(cuts, dtype="object", index=t.index))

    return sources.mapInPandas(draw, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields) + ", cuts array<long>")


def slots(goals: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """The mix as slots: skey, slot, shard, place (in the shard's slots of its source), block, take (words, the first
    ones of the block)."""
    g = goals.filter("source_size > 0").withColumn("want", F.round("target").cast("long"))
    g = g.withColumn("nb", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("passes", F.expr("want div source_size")).withColumn("rest", F.expr("want % source_size"))
    g = g.withColumn("key", F.expr(f"xxhash64(skey, {seed})")).withColumn("tail_at", F.expr(feistel("nb - 1", "nb", "key", inverse=True)))
    # Slots of the last pass: up to the one at which its words are reached, with a source's short last block or without.
    g = g.withColumn("tail", F.expr(f"(rest + {block - 1}) div {block}"))
    g = g.withColumn("tail", F.expr(f"if(tail_at < tail, (rest + nb * {block} - source_size + {block - 1}) div {block}, tail)")).withColumn("n_slots", F.expr("nb * passes + tail")).filter("n_slots > 0")
    g = drawn(g.select("skey", "source_size", "nb", "passes", "rest", "key", "tail_at", "n_slots"), shards, seed)
    g = g.withColumn("part", F.explode(F.expr(f"sequence(0, (n_slots - 1) div {SLOTS_A_TASK})")))
    g = g.repartition(int(goals.sparkSession.conf.get("spark.sql.shuffle.partitions")), "skey", "part")  # few rows, but much is made of each
    s = g.withColumn("slot", F.explode(F.expr(f"sequence(part * {SLOTS_A_TASK}, least((part + 1) * {SLOTS_A_TASK}, n_slots) - 1)")))
    s = s.withColumn("j", F.expr("slot % nb")).withColumn("block", F.expr(feistel("j", "nb", "key")))
    long = F.expr(f"least({block}, source_size - block * {block})")
    done = F.expr(f"j * {block} - if(tail_at < j, nb * {block} - source_size, 0)")
    s = s.withColumn("take", F.when(F.expr("slot div nb < passes"), long).otherwise(F.least(long, F.greatest(F.col("rest") - done, F.lit(0)))))
    s = s.withColumn("shard", F.expr("size(filter(cuts, c -> c <= slot))")).withColumn("place", F.expr("slot - if(shard = 0, 0, element_at(cuts, shard))"))
    return s.filter("take > 0").select("skey", "slot", "shard", "place", "block", "take")


def mix_pieces(starts: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the mix takes of each document: skey, start (the document), slot, shard, place, block, word_from, n_words.

    ``starts`` needs skey, start and size.
    """
    p = starts.filter("size > 0").select("skey", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    p = p.withColumn("lo", F.expr(f"greatest(start, block * {block})")).withColumn("hi", F.expr(f"least(start + size, (block + 1) * {block})"))
    # Both sides grow with the words; sizes guessed before the slots are made must not turn one into a broadcast.
    m = slots(goals, block).hint("merge").join(p, ["skey", "block"]).withColumn("n_words", F.expr(f"least(hi, block * {block} + take) - lo"))
    return m.filter("n_words > 0").select("skey", "start", "slot", "shard", "place", "block", F.expr("lo - start").alias("word_from"), "n_words")


def plan_mix(docs: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows without text but with the columns ``keep``, sums by source and bucket, targets), all stored."""
    rows = stored(sized(only(docs, "doc_id", "text", "source", *keep)).drop("text"))
    sums = stored(rows.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("part")))
    goals = stored(targets(sums))
    return rows, sums, goals


def with_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Join one row a source; broadcast only up to FEW_SOURCES of them, else left to a shuffled join."""
    return rows.join(F.broadcast(goals) if goals.count() <= FEW_SOURCES else goals, "skey")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sums, goals = plan_mix(table(spark, sf_dir, "documents"))
    starts = stored(packed(rows, sums))
    taken = mix_pieces(starts, goals).groupBy("skey", "start").agg(F.sum("n_words").alias("taken"), F.bit_count(F.bit_or(F.expr("shiftleft(1, shard)"))).alias("n_shards"))
    # Only documents with words have pieces, and for these (source, start) is a key.
    some = with_goals(starts.filter("size > 0").join(taken, ["skey", "start"], "left"), goals)
    none = with_goals(starts.filter("size = 0").withColumn("taken", F.lit(None).cast("long")).withColumn("n_shards", F.lit(0)), goals)
    return some.unionByName(none.select(*some.columns)).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("int").alias("n_shards"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for every pass that takes words of a document, with the words that it takes.

    A pass that takes a whole document keeps its text as it is; else the taken words stand as in the text, with what
    follows each of them up to the next word. ``n_chars`` follows the text; all other columns are the document's.
    """
    names = docs.columns
    docs = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text", "source", F.monotonically_increasing_id().alias("row_key")))
    rows, sums, goals = plan_mix(docs, "row_key")
    starts = stored(packed(rows, sums))
    nb = goals.select("skey", F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}").alias("nb"))
    cut = with_goals(mix_pieces(starts, goals), nb).withColumn("turn", F.expr("slot div nb"))
    cut = cut.groupBy("skey", "start", "turn").agg(F.sum("n_words").alias("taken"), F.sort_array(F.collect_list(F.struct("word_from", "n_words"))).alias("parts"))
    cut = cut.join(starts.filter("size > 0").select("skey", "start", "size", "row_key"), ["skey", "start"]).select("row_key", "taken", "size", "parts")
    full = docs.select("row_key", "row", F.col("row.text").alias("text")).join(cut, "row_key")
    # Words with the blanks behind them; what stands before the first word is dropped.
    words = F.expr(rf"regexp_extract_all(text, r'{WORD}[\x20\x09-\x0D]*', 0)")
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["word_from"] + 1).cast("int"), p["n_words"].cast("int")))), "")
    full = full.withColumn("text", F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(F.regexp_replace(some, r"[\x20\x09-\x0D]+$", "")))
    out = {c: F.col("row")[c] for c in names} | {"text": F.col("text")}
    if "n_chars" in names:
        out["n_chars"] = F.length("text").cast(docs.schema["row"].dataType["n_chars"].dataType)
    return full.select(*[out[c].alias(c) for c in names])
