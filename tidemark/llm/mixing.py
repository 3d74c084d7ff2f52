"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

1. Words per (source, bucket), a bucket being one of `buckets` (4,096) hash ranges of the id: one pass, combined on the
   map side. Everything up to step 4 works on that table, of at most 4,096 rows a source.
2. Targets: sources share all words by weight; a target stops at `repeat` times its source, the excess is reshared
   by weight (water filling, as one running sum over sources ordered by limit / weight).
3. Sources get blocks of `block_words` words by highest quotients target / (2k + 1). A divisor gives all but about
   two blocks a source at once; only the rest are listed and ranked. Sources are cut into shards of about
   `shard_words` words, and a source's blocks go to its shards by the same rule: first to at most `buckets` of them, and where one of these
   has more than eight times `shard_words`, from there to as many smaller ones as it takes.
4. In a shard, documents stand in a seeded order and their words form one stream of blocks (the last one may be
   short). Block j is taken floor(((j + 1) q + u) / n) - floor((j q + u) / n) times, q being the shard's quota, n
   its blocks and u seeded: exactly q blocks, none over `repeat` times, and a document's share needs no list of
   blocks.

No key is hot: buckets spread a source's rows, shards bound what a window holds however large the source is. One task holds one row for each
source (to put them in order and to fill their targets), no other holds more than a shard or `buckets` rows. Only DataFrame functions.

Defined results: a null text has no words; null is a source of its own, the last; sources without words get target 0;
rows with one id are ordered by size, and equal rows share what falls on them in any order; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table, written

BUCKETS = 4096


def _apportion(rows: DataFrame, within: list[str], weight: str, seats: str, order: list[str], out: str) -> DataFrame:
    """rows with out: how many of `seats` (one number within each group) go to the row by highest weight / (2k + 1).

    With n rows, total weight t and s seats, rounding weight / d to the nearest gives at most s at d = t / (s - n / 2) and at
    least s at d = t / (s + n / 2); what lies between, about 2n quotients, is listed and ranked (ties: by `order`).
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_t", F.sum(weight).over(group).cast("double")).withColumn("_n", F.count(F.lit(1)).over(group))
    share = F.col(weight).cast("double") / F.col("_t")
    few = F.col(seats) - F.col("_n") / 2
    low = F.greatest(F.lit(0), F.floor(share * F.greatest(F.lit(0.0), few) + 0.5) - 1)
    high = F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1
    some = (F.col("_t") > 0) & (F.col(weight) > 0)
    rows = rows.withColumn("_low", F.when(some, low).otherwise(0).cast("long")).withColumn("_high", F.when(some, high).otherwise(0).cast("long"))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    listed = rows.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))))
    quotient = F.col(weight).cast("double") / (2 * F.col("_k") + 1)
    ranked = listed.withColumn("_rank", F.row_number().over(group.orderBy(quotient.desc_nulls_last(), *order, "_k")))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    keep = [c for c in rows.columns if not c.startswith("_") or c == "_low"]
    return ranked.groupBy(*keep).agg(won.alias("_won")).withColumn(out, F.col("_low") + F.col("_won")).drop("_low", "_won")


def _targets(sources: DataFrame, repeat: int) -> DataFrame:
    """sources (source, source_size) with rank, weight and target; a table of one row a source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sources.withColumn("source_no", F.row_number().over(by_name)).withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    rows = rows.withColumn("cap", F.lit(repeat) * F.col("source_size"))
    before = everything.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("words", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    rows = rows.withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("full", F.col("cap") * F.col("open") < F.col("weight") * F.col("left"))
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    held = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything)
    rest = (F.col("weight") * (F.col("words") - taken)).cast("double") / (F.col("weights") - held)
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest))
    return rows.select("source", "source_no", "source_size", "weight", "target", "words")


def _prefix(x: Column, block_words: int) -> Column:
    """Words taken of the first x words of a shard."""
    j = F.expr("0") + F.floor(x / F.lit(block_words))
    before = lambda i: F.floor((i * F.col("quota") + F.col("offset")) / F.col("blocks"))
    return before(j) * block_words + (before(j + 1) - before(j)) * (x - j * block_words)


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, block_words: int = 32, shard_words: int = 65536, repeat: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, shard and part, start (its first word in the
    part's stream), quota and blocks (of the part), offset, taken."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("place"),
    ).withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int") % buckets)
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = _targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), repeat)
    targets = targets.withColumn("seats", F.round(F.col("words") / block_words).cast("long"))
    targets = _apportion(targets, [], "target", "seats", ["source_no"], "source_quota")
    targets = targets.withColumn("shards", F.least(F.lit(buckets), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("int"))
    in_shards = by_bucket.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    in_shards = in_shards.withColumn("shard", F.floor(F.col("bucket") * F.col("shards") / buckets).cast("int"))
    shards = in_shards.groupBy("source", "source_no", "source_quota", "shard").agg(F.sum("bucket_size").alias("shard_size"))
    shards = _apportion(shards, ["source_no"], "shard_size", "source_quota", ["shard"], "shard_quota")
    shards = shards.withColumn("n_parts", F.greatest(F.lit(1), F.floor(F.col("shard_size") / (8 * shard_words))).cast("long"))
    # one row a bucket of a source: all that documents need
    plan = in_shards.select("source", "bucket", "shard", "source_no", "source_size", "target").join(shards.select("source_no", "shard", "shard_size", "shard_quota", "n_parts"), ["source_no", "shard"])
    plan = written(plan.withColumnsRenamed({"source": "s", "bucket": "b"}), "mixing-plan")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    parts = plan.select("source_no", "shard", F.lit(0).cast("long").alias("part"), F.col("shard_size").alias("part_size"), F.col("shard_quota").alias("quota"), "n_parts").distinct()
    if parts.where("n_parts > 1").take(1):
        part = F.floor(F.conv(F.substring("place", 4, 8), 16, 10).cast("long") * F.col("n_parts") / F.lit(1 << 32)).cast("long")
        placed = placed.withColumn("part", F.when(F.col("n_parts") > 1, part).otherwise(0))
        sizes = placed.where(F.col("n_parts") > 1).groupBy("source_no", "shard", "shard_quota", "part").agg(F.sum("size").alias("part_size"))
        sizes = _apportion(sizes, ["source_no", "shard"], "part_size", "shard_quota", ["part"], "quota").select("source_no", "shard", "part", "part_size", "quota")
        parts = parts.where("n_parts = 1").drop("n_parts").unionByName(sizes)
    else:
        placed = placed.withColumn("part", F.lit(0).cast("long"))
    parts = parts.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("part_size") / block_words)).cast("long"))
    name = F.concat(F.lit(f"{seed}:"), F.col("source_no").cast("string"), F.lit(":"), F.col("shard").cast("string"), F.when(F.col("part") > 0, F.concat(F.lit(":"), F.col("part").cast("string"))).otherwise(""))
    parts = parts.withColumn("quota", F.least("quota", F.lit(repeat) * F.col("blocks"))).withColumn("offset", F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % F.col("blocks"))
    placed = placed.join(parts.select("source_no", "shard", "part", "quota", "blocks", "offset"), ["source_no", "shard", "part"])
    stream = Window.partitionBy("source_no", "shard", "part").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.withColumn("taken", (_prefix(F.col("end"), block_words) - _prefix(F.col("start"), block_words)).cast("long"))
    return placed.select(F.col("key").alias(key), "source", "size", "source_size", "target", "shard", "part", "start", "quota", "blocks", "offset", "taken")


def block_spans(mixed: DataFrame, block_words: int = 32) -> DataFrame:
    """mixed with spans: the ranges of a document's words that the mix takes, each with its number of copies."""
    copies = "floor(((j + 1) * quota + offset) / blocks) - floor((j * quota + offset) / blocks)"
    blocks = f"sequence(cast(start div {block_words} as long), cast((start + size - 1) div {block_words} as long))"
    span = f"transform({blocks}, j -> named_struct('first', greatest(j * {block_words} - start, 0L), 'last', least((j + 1) * {block_words} - start, size), 'copies', {copies}))"
    return mixed.withColumn("spans", F.expr(f"case when size > 0 then filter({span}, x -> x.copies > 0) else array() end"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_APPORTION_SQL = """
{name}_t AS (SELECT *, CAST(sum({weight}) OVER g AS DOUBLE) AS _t, count(*) OVER g AS _n FROM {rows} WINDOW g AS (PARTITION BY {within})),
{name}_b AS (SELECT *,
    CASE WHEN _t > 0 AND {weight} > 0 THEN CAST(greatest(0, floor(CAST({weight} AS DOUBLE) / _t * greatest(0.0, {seats} - _n / 2) + 0.5) - 1) AS BIGINT) ELSE 0 END AS _low,
    CASE WHEN _t > 0 AND {weight} > 0 THEN CAST(floor(CAST({weight} AS DOUBLE) / _t * ({seats} + _n / 2) + 0.5) + 1 AS BIGINT) ELSE 0 END AS _high FROM {name}_t),
{name}_l AS (SELECT *, {seats} - sum(_low) OVER (PARTITION BY {within}) AS _left FROM {name}_b),
{name}_k AS (SELECT *, unnest(range(_low, greatest(_high, _low + 1))) AS _k FROM {name}_l),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY CASE WHEN _high > _low THEN CAST({weight} AS DOUBLE) / (2 * _k + 1) END DESC NULLS LAST, {order}, _k) AS _rank FROM {name}_k),
{name} AS (SELECT {keep}, _low + sum(CASE WHEN _high > _low AND _rank <= _left THEN 1 ELSE 0 END) AS {out} FROM {name}_r GROUP BY {keep}, _low)
"""

OP5_SQL = (
    r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
placed AS (SELECT *, CAST('0x' || substr(place, 1, 3) AS BIGINT) AS bucket FROM sized),
buckets AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS bucket_size FROM placed GROUP BY ALL),
s0 AS (SELECT source, CAST(sum(bucket_size) AS BIGINT) AS source_size FROM buckets GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS source_no FROM s0),
s2 AS (SELECT *, (source_no - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
    sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS remaining, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS opened
    FROM s2 WINDOW b AS (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap * opened < weight * remaining AS full_up FROM s3),
s5 AS (SELECT source, source_no, source_size, CAST(round(words / 32) AS BIGINT) AS seats, CASE WHEN full_up THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * (words - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ()) AS DOUBLE) / (weights - sum(CASE WHEN full_up THEN weight ELSE 0 END) OVER ()) END AS target FROM s4),"""
    + _APPORTION_SQL.format(name="s6", rows="s5", within="1", weight="target", seats="seats", order="source_no", keep="source, source_no, source_size, target", out="source_quota")
    + r""",
s7 AS (SELECT *, CAST(least(4096, greatest(1, ceil(source_size / 65536))) AS BIGINT) AS shards FROM s6),
in_shards AS (SELECT s7.*, bucket, bucket_size, bucket * shards // 4096 AS shard FROM buckets JOIN s7 ON buckets.source IS NOT DISTINCT FROM s7.source),
h0 AS (SELECT source_no, source_quota, shard, sum(bucket_size) AS shard_size FROM in_shards GROUP BY ALL),"""
    + _APPORTION_SQL.format(name="h1", rows="h0", within="source_no", weight="shard_size", seats="source_quota", order="shard", keep="source_no, shard, shard_size", out="quota0")
    + r""",
h2 AS (SELECT *, CAST(greatest(1, ceil(shard_size / 32)) AS BIGINT) AS blocks FROM h1),
h3 AS (SELECT source_no, shard, blocks, CAST(least(quota0, 3 * blocks) AS BIGINT) AS quota, CAST('0x' || substr(md5('17:' || source_no || ':' || shard), 1, 8) AS BIGINT) % blocks AS start_at FROM h2),
joined AS (SELECT p.doc_id, p.size, i.source_size, i.target, h3.*, CAST(sum(size) OVER (PARTITION BY h3.source_no, h3.shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
    FROM placed p JOIN in_shards i ON p.source IS NOT DISTINCT FROM i.source AND p.bucket = i.bucket JOIN h3 ON h3.source_no = i.source_no AND h3.shard = i.shard),
cut AS (SELECT *, e - size AS s, e // 32 AS je, (e - size) // 32 AS js FROM joined)
SELECT doc_id, size, source_size, target, CAST(
    ((je * quota + start_at) // blocks) * 32 + (((je + 1) * quota + start_at) // blocks - (je * quota + start_at) // blocks) * (e - je * 32)
  - ((js * quota + start_at) // blocks) * 32 - (((js + 1) * quota + start_at) // blocks - (js * quota + start_at) // blocks) * (s - js * 32) AS BIGINT) AS taken FROM cut
"""
)
