"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

All of it is DataFrame and SQL functions. The token size of every document is found in one
pass over the texts and kept as a narrow table; what follows works on that table.

1. Targets. The words of all sources are shared out by weight; a source takes at most ``cap``
   times its own size. The fixed point of resharing the excess is a water level: sources in
   order of capacity over weight are full until the first that stays below the level.
2. Source quotas. Targets are votes and equal-token blocks are seats. A highest-quotient
   allocation gives seat j of a party the quotient votes / (2j - 1). Seats that are certain
   under a slightly larger divisor are given at once; only about two seats a party are
   ranked, so that the cost follows the number of parties and not that of blocks.
3. Shard quotas. A source is cut into shards of about ``shard_tokens`` words by a seeded hash
   of the document, and its blocks go to them by the same allocation. Hence no window holds
   more than a shard, however large the source.
4. Selection. A shard's documents stand in seeded order as one stream of blocks. It gives
   whole rounds while the quota exceeds its size, and then the first blocks of the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castleflow.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
SEED = 20240607


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, doc_id: Column) -> Column:
    """A number of 60 bits that depends on the seed and the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size) with the columns party, weight and target added."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("party", F.row_number().over(by_name)).withColumn("weight", F.element_at(table, (F.col("party") - 1) % len(weights) + 1))
    room = F.lit(cap) * F.col("source_size")
    filled = Window.orderBy("fullness", "party")
    before, everyone = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum(room).over(before), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = named.withColumn("fullness", room / F.col("weight")).withColumn("level", level).withColumn("place", F.row_number().over(filled))
    at = F.min(F.when(F.col("fullness") >= F.col("level"), F.struct("place", "level"))).over(everyone)
    water = levels.withColumn("water", at.getField("level"))
    return water.select("source", "source_size", "party", "weight", F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("water"), F.col("fullness")) * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, key: list[str], party: str, votes: str, house: str) -> DataFrame:
    """``parties`` with ``seats``: ``house`` seats of each group ``key`` by highest quotients.

    Ties go to the smaller party. Parties without votes get no seat.
    """
    group = Window.partitionBy(*key)
    v, h = F.col(votes).cast("double"), F.col(house).cast("double")
    slack = F.col("_n") / 2 + 1
    share = lambda seats: F.floor(v * F.greatest(seats, F.lit(0.0)) / F.col("_all") + 0.5).cast("long")
    bounds = (
        parties.withColumn("_all", F.sum(v).over(group))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_sure", F.when(v > 0, share(h - slack)).otherwise(F.lit(0)))
        .withColumn("_most", F.when(v > 0, share(h + slack)).otherwise(F.lit(0)))
        .withColumn("_open", F.col(house) - F.sum("_sure").over(group))
    )
    seat = F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most"))))
    ranked = bounds.select(*key, party, votes, "_open", seat.alias("_seat")).withColumn(
        "_rank", F.row_number().over(group.orderBy((v / (2 * F.col("_seat") - 1)).desc(), party, "_seat"))
    )
    won = ranked.where(F.col("_rank") <= F.col("_open")).groupBy(*key, party).agg(F.count(F.lit(1)).alias("_won"))
    seats = F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))
    return bounds.join(won, [*key, party], "left").select(*parties.columns, seats.alias("seats"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, block_tokens: int = 64, shard_tokens: int = 1_000_000, seed: int = SEED) -> DataFrame:
    """Words that a mix of all sources takes from each document.

    ``docs`` needs doc_id, text and source; other columns are ignored. Returns one row per
    input row: doc_id, size, source, source_size, target, taken. A null or empty text has size
    0 and gives nothing; a null source is a source of its own, last in order; repeated rows
    count as documents of their own; rows equal in all three columns are interchangeable, so
    that their order does not matter. An empty table gives an empty result. Blocks hold
    ``block_tokens`` words, fewer where the smallest target would be under 200 blocks.
    """
    order = seeded(seed, F.col("doc_id"))
    sized = stash(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), order.alias("draw")), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, float(cap))
    everyone = Window.partitionBy()
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everyone)
    block = F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(F.coalesce(smallest, F.lit(0.0)) / 200))).cast("long")
    sources = sources.withColumn("block", block).withColumn("house", F.round(F.sum("target").over(everyone) / F.col("block")).cast("long"))
    sources = apportion(sources, [], "party", "target", "house").withColumnRenamed("seats", "blocks")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_tokens))).cast("long"))
    sources = stash(sources.select("source", "party", "source_size", "target", "block", "blocks", "shards"), "mix-sources")

    s = sources.withColumnRenamed("source", "_source")
    placed = sized.join(s, sized["source"].eqNullSafe(s["_source"])).drop("_source").withColumn("shard", F.pmod(F.col("draw"), F.col("shards")))
    shards = placed.groupBy("party", "shard", "blocks", "block").agg(F.sum("size").alias("shard_size"))
    quotas = apportion(shards, ["party"], "shard", "shard_size", "blocks").select("party", "shard", "shard_size", (F.col("seats") * F.col("block")).alias("quota"))

    stream = Window.partitionBy("party", "shard").orderBy("draw", "doc_id", "tie", "size")
    end = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("quota") - rounds * F.col("shard_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    taken = F.least(F.lit(cap) * F.col("size"), rounds * F.col("size") + more).cast("long")
    return placed.withColumn("_end", end).join(quotas, ["party", "shard"]).select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"))


#: DuckDB SQL for mix with its defaults, where doc_id is unique: the same shares, seats by ranking all quotients.
ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || left(md5('{SEED}:' || doc_id), 15) AS BIGINT) AS draw FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS party, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS room FROM sizes),
levels AS (SELECT *, room / weight AS fullness, row_number() OVER (ORDER BY room / weight, party) AS place, (sum(source_size) OVER () - coalesce(sum(room) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level FROM named
  WINDOW before AS (ORDER BY room / weight, party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, place) AS water FROM levels WHERE fullness >= level),
aimed AS (SELECT source, source_size, party, least(room, coalesce(water, fullness) * weight) AS target FROM levels LEFT JOIN water ON true),
blocks AS (SELECT *, CAST(greatest(1, least(64, floor(coalesce(min(target) FILTER (target > 0) OVER (), 0.0) / 200))) AS BIGINT) AS block, greatest(1, CAST(ceil(source_size / 1000000) AS BIGINT)) AS shards FROM aimed),
houses AS (SELECT *, CAST(round(sum(target) OVER () / block) AS BIGINT) AS house FROM blocks),
won AS (SELECT party, count(*) AS blocks FROM (SELECT party, house, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, party, j) AS place FROM (SELECT *, unnest(generate_series(1, CAST(ceil(target * house / (SELECT sum(target) FROM houses)) AS BIGINT) + (SELECT count(*) FROM houses))) AS j FROM houses WHERE target > 0)) WHERE place <= house GROUP BY party),
sources AS (SELECT h.*, coalesce(w.blocks, 0) AS won FROM houses h LEFT JOIN won w USING (party)),
placed AS (SELECT d.*, s.source_size, s.target, s.party, s.block, s.won, d.draw % s.shards AS shard FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
shards AS (SELECT party, shard, any_value(won) AS house, any_value(block) AS block, CAST(sum(size) AS BIGINT) AS shard_size FROM placed GROUP BY ALL),
seats AS (SELECT party, shard, count(*) AS seats FROM (SELECT party, shard, house, row_number() OVER (PARTITION BY party ORDER BY shard_size / (2 * j - 1) DESC, shard, j) AS place
  FROM (SELECT *, unnest(generate_series(1, CAST(ceil(shard_size * house / (SELECT sum(x.shard_size) FROM shards x WHERE x.party = shards.party)) AS BIGINT) + (SELECT count(*) FROM shards x WHERE x.party = shards.party))) AS j FROM shards WHERE shard_size > 0)) WHERE place <= house GROUP BY ALL),
quotas AS (SELECT h.party, h.shard, h.shard_size, coalesce(q.seats, 0) * h.block AS quota FROM shards h LEFT JOIN seats q USING (party, shard)),
streams AS (SELECT p.*, q.shard_size, q.quota, sum(size) OVER (PARTITION BY p.party, p.shard ORDER BY draw, doc_id) AS upto, CASE WHEN q.shard_size > 0 THEN q.quota // q.shard_size ELSE 0 END AS rounds FROM placed p JOIN quotas q USING (party, shard))
SELECT doc_id, size, source_size, target, CAST(least(3 * size, rounds * size + greatest(0, least(size, quota - rounds * shard_size - (upto - size)))) AS BIGINT) AS taken FROM streams
"""
