"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

1. Each source gets a target number of words by weight, capped at MOST times
   its own size; the excess is shared again by weight (water filling in closed
   form: the capped sources are a prefix of the order by size / weight).
2. Blocks of BLOCK words are apportioned to sources by the highest quotients
   target / (2k + 1).
3. Each source's blocks are apportioned in the same way to its shards, by the
   shards' words.
4. In each shard a seeded order of documents is cut into blocks; whole rounds
   take everything and the rest takes the first blocks of that order.

Only ids and sizes are shuffled; the number of shards of a source grows with
its documents, so that a source with a third of all rows is many groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import SPACE, own, unused

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK, MOST, SHARD_DOCS, SLICE, SEED = 32, 3, 2_000, 4_096, "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: str, tag: str) -> Column:
    """A 60-bit number from the md5 of tag, seed and id; the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def beside(rows: DataFrame, totals: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of totals, which has a row for each group; a null group is a group."""
    names = {g: f"_g{i}" for i, g in enumerate(group)}
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in names.items()]
    return rows.join(totals.withColumnsRenamed(names), reduce(Column.__and__, same), how).drop(*names.values())


def highest_quotients(rows: DataFrame, group: list[str], item: str, votes: str, seats: str, most: str) -> DataFrame:
    """Sainte-Lague within each group: adds column `quota`, the item's number of seats.

    votes: double; seats: long, the same for a group; most: long, seats an item
    can take at most. With m items and V votes every divisor between
    V / (seats + m/2 + 1) and V / (seats - m/2 - 1) is tried implicitly: seats
    below the first bound are sure, so at most 2m + 2 quotients a group are
    ranked, however many seats there are. They are dealt into slices of about
    SLICE by size, and ranked within a slice, so that a group of very many items
    is many tasks; only equal quotients always share a slice. Ties go to the
    smaller item.
    """
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("_m"), F.sum(votes).alias("_v"))
    at = lambda d: F.when((d > 0) & (F.col("_v") > 0), F.floor(F.col(votes) * d / F.col("_v") + 0.5)).otherwise(0).cast("long")
    bounded = beside(rows, sums, group).withColumn("_low", F.least(at(F.col(seats) - F.col("_m") / 2 - 1), F.col(most)))
    bounded = bounded.withColumn("_high", F.greatest(F.least(at(F.col(seats) + F.col("_m") / 2 + 1), F.col(most)), F.col("_low")))
    bounded = materialise(bounded.drop("_m", "_v"), "mix-seats")
    # the largest and the smallest quotient of a group, and how many there are, before any is listed
    some = lambda divisor: F.when(F.col("_high") > F.col("_low"), F.col(votes) / divisor)
    span = bounded.groupBy(*group).agg(
        F.sum("_low").alias("_sure"), F.max(some(2 * F.col("_low") + 1)).alias("_top"), F.min(some(2 * F.col("_high") - 1)).alias("_end"), F.ceil(F.sum(F.col("_high") - F.col("_low")) / SLICE).alias("_slices"))
    quotients = beside(bounded.filter(F.col("_high") > F.col("_low")), span, group).withColumn("_k", F.explode(F.sequence("_low", F.col("_high") - 1)))
    quotients = quotients.withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    width = F.col("_top") - F.col("_end")
    place = F.when(width > 0, F.floor((F.col("_top") - F.col("_q")) / width * F.col("_slices"))).otherwise(0).cast("long")
    dealt = materialise(quotients.select(*group, item, "_k", "_q", (F.col(seats) - F.col("_sure")).alias("_left"), place.alias("_slice")), "mix-quotients")
    upto = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).drop("_c")
    rank = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(F.desc("_q"), F.col(item).asc_nulls_last(), "_k"))
    open_seats = beside(dealt, before, [*group, "_slice"]).filter(F.col("_before") < F.col("_left"))
    won = open_seats.withColumn("_r", F.col("_before") + rank).filter(F.col("_r") <= F.col("_left")).groupBy(*group, item).agg(F.count(F.lit(1)).alias("_won"))
    return beside(bounded, won, [*group, item], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_low", "_high", "_won")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, docs) -> adds target double. Sources by code point, null last, take the weights in turn."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size").cast("double") * most)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_before": F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)), "_after": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)), "_all": F.sum("source_size").over(everything).cast("double")})
    # the share that each weight unit gets if exactly the sources before this one are capped
    rows = rows.withColumn("_unit", (F.col("_all") - F.col("_before")) / F.col("_after"))
    unit = F.min(F.when(F.col("_unit") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_unit")))).over(everything).getField("_unit")
    return rows.withColumn("_u", unit).select("source", "source_size", "docs", F.coalesce(F.least(F.col("_cap"), F.col("_u") * F.col("_w")), F.col("_cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, most: int = MOST, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    size counts the words of the whole text (null or empty: 0, and then nothing
    is taken). A null source is a source, the last. Rows that repeat an id are
    rows of their own; which of two equal rows takes the cut block is open, but
    the result as a bag of rows is the same on every run. An empty table gives
    an empty result. Other columns are ignored.
    """
    rows = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")  # texts are read once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = source_targets(sizes, weights, most)
    targets = targets.withColumns({"_one": F.lit(1), "_seats": F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"), "_most": F.ceil(F.col("source_size") * most / block).cast("long")})
    quotas = highest_quotients(targets, ["_one"], "source", "target", "_seats", "_most").select(
        F.col("source").alias("_s"), "source_size", "target", F.col("quota").alias("_seats"), F.ceil(F.col("docs") / shard_docs).cast("long").alias("_shards"))
    placed = (
        rows.join(quotas, rows["source"].eqNullSafe(quotas["_s"]))
        .withColumn("shard", seeded(F.col("doc_id"), seed, "shard") % F.col("_shards"))
        .select("doc_id", "source", "size", "source_size", "target", "_seats", "shard", seeded(F.col("doc_id"), seed, "order").alias("_o"))
    )
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("_words"), F.first("_seats").alias("_seats"))
    shards = shards.withColumns({"_votes": F.col("_words").cast("double"), "_most": F.ceil(F.col("_words") * most / block).cast("long")})
    shares = highest_quotients(shards, ["source"], "shard", "_votes", "_seats", "_most").select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), F.col("_words"), F.least(F.col("quota") * block, F.col("_words") * most).alias("_quota"))
    run = Window.partitionBy("source", "shard").orderBy("_o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.withColumn("_end", F.sum("size").over(run))
    joined = cut.join(shares, cut["source"].eqNullSafe(shares["_s"]) & (cut["shard"] == shares["_h"]))
    rounds = F.when(F.col("_words") > 0, F.floor(F.col("_quota") / F.col("_words"))).otherwise(0).cast("long")
    rest = F.col("_quota") - rounds * F.col("_words")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    return joined.select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Mix all documents by the weights 5, 2, 1 in turn."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same steps in SQL; quotients are listed in full here, where the operator bounds them first.
OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM rows GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size::DOUBLE * 3 AS cap FROM sizes
), unit AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE - coalesce(sum(cap) OVER f, 0.0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER f, 0.0)) AS unit
  FROM w WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, docs, coalesce(least(cap, (SELECT unit FROM unit WHERE unit * w <= cap ORDER BY cap / w, unit LIMIT 1) * w), cap) AS target FROM unit
), seats AS (
  SELECT *, ceil(source_size * 3 / 32.0::DOUBLE)::BIGINT AS most FROM targets
), q AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS r
  FROM (SELECT source, target, unnest(range(0, most)) AS k FROM seats)
), quotas AS (
  SELECT s.*, (SELECT count(*) FROM q WHERE q.source IS NOT DISTINCT FROM s.source AND r <= (SELECT round(sum(target) / 32.0)::BIGINT FROM targets)) AS blocks, ceil(docs / 2000.0)::BIGINT AS shards FROM seats s
), placed AS (
  SELECT r.doc_id, r.source, r.size, s.source_size, s.target, s.blocks,
    ('0x' || substr(md5('shard:mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % s.shards AS shard,
    ('0x' || substr(md5('order:mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS o
  FROM rows r JOIN quotas s ON r.source IS NOT DISTINCT FROM s.source
), shards AS (
  SELECT source, shard, sum(size)::BIGINT AS words, any_value(blocks) AS blocks FROM placed GROUP BY source, shard
), sq AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard, k) AS r, blocks
  FROM (SELECT *, unnest(range(0, ceil(words * 3 / 32.0::DOUBLE)::BIGINT)) AS k FROM shards)
), shares AS (
  SELECT s.*, least((SELECT count(*) FROM sq WHERE sq.source IS NOT DISTINCT FROM s.source AND sq.shard = s.shard AND r <= sq.blocks) * 32, words * 3) AS quota FROM shards s
), cut AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM placed
)
SELECT c.doc_id, c.size, c.source_size, c.target,
  CAST(CASE WHEN h.words > 0 THEN h.quota // h.words ELSE 0 END * c.size
    + greatest(0, least(c.size, CASE WHEN h.words > 0 THEN h.quota % h.words ELSE 0 END - (c.stop - c.size))) AS BIGINT) AS taken
FROM cut c JOIN shares h ON c.source IS NOT DISTINCT FROM h.source AND c.shard = h.shard
"""


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs, all columns unchanged, each as often as the mix takes its words: taken / size rounded, at most `most` times.

    Rows that share an id share what is taken of them. A document of which less
    than half is taken goes, so a cut block shifts a shard by half a document
    at most. A null or empty text has no words and goes; an empty table stays
    empty; columns may have any names.
    """
    at, copy, number = unused(docs, "_id", "_copies", "_k")
    taken = materialise(mix(docs, **how).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("z")), "mix-taken")
    copies = taken.filter("2 * t >= z and z > 0").select(F.col("doc_id").alias(at), F.round(F.col("t") / F.col("z")).cast("int").alias(copy))
    # the ids grow with the documents, so they are never broadcast
    both = docs.join(copies.hint("merge"), docs["doc_id"].eqNullSafe(copies[at]))
    return both.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*own(docs))
