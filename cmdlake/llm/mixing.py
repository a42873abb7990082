"""Operator 10: mix sources to target weights with a low-discrepancy schedule.

Every source is a stream of equal blocks of words: its documents in an order
shuffled by a hash. A slot of the mix takes one block. The slots of a source are
those whose van der Corput point falls in the source's part of the cumulative
weights (counted in blocks, so each source gets the very number of slots that its
target needs); a slot's rank among its source's slots says which block it takes.
Slots are joined with blocks by a shuffle, many slots to a task; a document's words in the
taken blocks are summed, and each of its copies has its place where the slot of its first
word is. The mix itself is written in the order of slots, so that any stretch of it holds
the sources close to their weights.

Only DataFrame operations; no window or task holds more than some thousand rows of
a source, however much of the corpus the source has: running sums go by prefixes of
the shuffling hash, 256 to a level, and ranks of slots need no ordering at all.

The table of sources (a row each, some 50 bytes) is ordered and weighed in one task.

Defined cases: null text has size 0; null sources are one source, last in order;
a document of size 0 is never taken (0); a long text lies in many blocks, so its row is
made from many; an empty table gives an empty result; repeated rows are separate
documents, and rows that are equal in id, text and source share what they get in any
order; further columns are ignored, and kept in the mix, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._shared import SPACE, SPACES, n_words, written

#: Fixed values of the contract.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: Words in a block; slots of a chunk, at least.
BLOCK, CHUNK = 512, 4096


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source (column s): total words, and its target by weight under the cap.

    A target is min(cap * size, weight * level); level is the one at which the
    targets sum to share * all words. Over sources ordered by cap * size / weight,
    it is the largest of the levels that leave the source itself uncapped."""
    every, by_name = W.partitionBy(), W.orderBy("s")
    before = W.orderBy("full_at", "s").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("full_at", "s").rowsBetween(0, W.unboundedFollowing)
    rows = sizes.groupBy("s").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("want", F.sum("source_size").over(every) * share).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    rows = rows.withColumn("level", (F.col("want") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    return rows.withColumn("target", F.least(cap * F.col("source_size"), F.coalesce(F.col("weight") * level, cap * F.col("source_size")))).select("s", "source_size", "target")


def _levels(digits: int) -> list[int]:
    return [*range(digits, 0, -2), 0]


def _bases(rows: DataFrame, digits: int) -> DataFrame:
    """Words of a source before each prefix (of so many hex digits) of the shuffling hash."""
    levels = _levels(digits)
    totals = {digits: rows.groupBy("s", F.substring("h", 1, digits).alias("p")).agg(F.sum("size").alias("n"))}
    for fine, coarse in zip(levels, levels[1:]):
        totals[coarse] = totals[fine].groupBy("s", F.substring("p", 1, coarse).alias("p")).agg(F.sum("n").alias("n"))
    base = totals[0].select("s", "p", F.lit(0).cast("long").alias("base"))
    for fine, coarse in reversed(list(zip(levels, levels[1:]))):
        up = F.substring("p", 1, coarse)
        running = F.coalesce(F.sum("n").over(W.partitionBy("s", "up").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        here = totals[fine].withColumn("up", up).withColumn("here", running)
        base = here.join(base.select("s", F.col("p").alias("up"), "base"), ["s", "up"]).select("s", "p", (F.col("base") + F.col("here")).alias("base"))
    return base


def _reversed_bits(v: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def slots(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per slot of the mix: slot (its place), s, rank, block, words.

    targets: s, source_size, target. Slot n has the point reversed bits of n / 2^bits;
    points beyond the last source's part stay idle, so places have gaps. A chunk of slots is
    made from its number alone; chunks are dealt out to tasks, some 100,000 chunks at most."""
    size, take = F.col("source_size"), F.floor("target")
    full = F.when(size > 0, F.floor(take / size)).otherwise(0)
    rows = targets.select("s", "source_size", F.ceil(size / block).alias("blocks"), full.alias("full"), (take - full * size).alias("rest"))
    rows = rows.withColumn("need", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block)).filter("need > 0")
    rows = rows.withColumn("high", F.sum("need").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, 0))).withColumn("low", F.col("high") - F.col("need"))
    total = rows.agg(F.max("high")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())

    # A source's part [low, high) as dyadic intervals: in each, the places n are those of one
    # remainder modulo a power of two, so earlier places of the source can be counted by division.
    def nodes(j: Column) -> Column:
        step = F.expr("1L") * F.pow(F.lit(2), j).cast("long")
        left, right = F.ceil(F.col("low") / step), F.floor(F.col("high") / step)
        node = lambda a: F.struct((F.lit(1 << bits) / step).cast("long").alias("m"), F.when(j == bits, F.lit(0)).otherwise(F.conv(F.reverse(F.lpad(F.bin(a), F.greatest(bits - j, F.lit(1)).cast("int"), F.lit("0"))), 2, 10)).cast("long").alias("r"))
        some = lambda a, on: F.when((left < right) & on, F.array(node(a))).otherwise(F.array().cast("array<struct<m:bigint,r:bigint>>"))
        return F.concat(some(left.cast("long"), left % 2 == 1), some((right - 1).cast("long"), right % 2 == 1))

    rows = rows.withColumn("nodes", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), nodes)))
    chunk = max(CHUNK, total // 100_000)
    rows = rows.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (need - 1) div {chunk})"))).repartition(max(1, min(2000, total // (4 * CHUNK))), "s", "chunk")
    rows = rows.withColumn("v", F.explode(F.expr(f"sequence(low + chunk * {chunk}, least(high, low + (chunk + 1) * {chunk}) - 1)")))
    rows = rows.withColumn("slot", _reversed_bits(F.col("v"), bits))
    rank = F.aggregate("nodes", F.lit(0).cast("long"), lambda n, x: n + F.when(F.col("slot") > x.r, F.floor((F.col("slot") - 1 - x.r) / x.m) + 1).otherwise(0))
    rows = rows.withColumn("rank", rank)
    last = F.col("rank") == F.col("need") - 1
    at = F.col("rank") % F.col("blocks")
    whole = F.least(F.lit(block), F.col("source_size") - at * block)
    left = F.when(last & (F.col("rest") > 0), F.col("rest") - at * block).otherwise(whole)
    turn = F.floor(F.col("rank") / F.col("blocks")).cast("int")
    return rows.select("slot", "s", "rank", at.alias("block"), turn.alias("turn"), left.cast("long").alias("words"))


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, source, size, text_key, s, source_size, target, taken, copies.

    text_key (xxhash64 of the text) tells documents of one id apart; copies has per copy, the last perhaps cut, the slot
    that holds its first word and the place of that word in it."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sizes = written(docs.select("doc_id", "source", _source_key(F.col("source")).alias("s"), n_words(F.col("text")).alias("size"), h.alias("h"), F.xxhash64("text").alias("text_key")), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, cap), "mix-targets")
    rows = sizes.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / 256, 16))) if rows > 256 else 1
    # The prefixes of a hot source are as many as those of any other: this join has no hot key.
    bases = _bases(sizes, digits).join(targets, "s").select("s", "p", "base", "source_size", "target")
    order = W.partitionBy("s", "p").orderBy("h", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("p", F.substring("h", 1, digits)).withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(bases, ["s", "p"]).withColumn("start", F.col("start") + F.col("base"))
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))))
    a, b = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    # A document without words is in no block; a key of its own keeps such rows apart.
    pieces = pieces.withColumn("block", F.coalesce("block", -1 - F.abs(F.xxhash64("doc_id", "text_key") % 1_000_000)))
    # The plan grows with the corpus: it is never broadcast.
    plan = slots(targets, block).select("s", "block", "turn", "slot", "words").hint("merge")
    joined = pieces.join(plan, ["s", "block"], "left").withColumn("got", F.when(F.col("size") > 0, F.greatest(F.least(b, F.coalesce("words", F.lit(0))) - a, F.lit(0))).otherwise(0))
    first = F.when((F.col("got") > 0) & (F.col("block") * block <= F.col("start")), F.struct("turn", "slot", (F.col("start") % block).alias("place")))
    keys = ["doc_id", "source", "s", "size", "text_key", "source_size", "target", "start"]
    some = joined.filter("size > 0").groupBy(*keys).agg(F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("taken"), F.sort_array(F.collect_list(first)).alias("copies")).drop("start")
    none = placed.filter("size = 0").select(*keys[:-1], F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<turn:int,slot:bigint,place:bigint>>").alias("copies"))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as the mix takes it, the last time cut after the
    words that are still taken; in the order of the schedule, by partitions and within them."""
    columns, n = docs.columns, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    took = mix_sources(docs, **options).filter("taken > 0")
    took = took.select("doc_id", "s", "text_key", "size", "taken", "copies", F.row_number().over(W.partitionBy("doc_id", "s", "text_key").orderBy("size")).alias("nth"))
    took = written(took, "mix-taken")
    last = took.agg(F.max(F.array_max(F.transform("copies", lambda x: x.slot)))).first()[0] or 0
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), _source_key(F.col("source")).alias("of"), F.xxhash64("text").alias("key"))
    rows = rows.withColumn("number", F.row_number().over(W.partitionBy("id", "of", "key").orderBy(F.lit(0))))
    rows = rows.join(took, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("s")) & (F.col("key") == F.col("text_key")) & (F.col("number") == F.col("nth")))
    rows = rows.select("row", "size", "taken", F.explode("copies").alias("copy")).select("row", "size", F.least("size", F.col("taken") - F.col("copy.turn") * F.col("size")).alias("left"), "copy")
    cut = F.array_join(F.slice(F.split(F.btrim("row.text", F.lit(SPACES)), SPACE + "+"), 1, F.col("left").cast("int")), " ")
    rows = rows.withColumn("cut", F.when(F.col("left") < F.col("size"), cut).otherwise(F.col("row.text")))
    rows = rows.repartitionById(n, F.floor(F.col("copy.slot") * n / (last + 1)).cast("int")).sortWithinPartitions("copy.slot", "copy.place")
    new = {"text": F.col("cut"), **({"n_chars": F.length("cut").cast("long")} if "n_chars" in columns else {})}
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", F.get("copies", 0).slot.alias("first_slot"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
                  md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
t AS (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END)::DOUBLE AS weight,
             (sum(source_size) OVER ())::DOUBLE * {SHARE} AS want FROM t),
f AS (SELECT *, {CAP}::DOUBLE * source_size / weight AS full_at FROM w),
l AS (SELECT *, (want - coalesce(sum({CAP}::DOUBLE * source_size) OVER (ORDER BY full_at, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY full_at, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT s, source_size, least({CAP}::DOUBLE * source_size, coalesce(weight * max(CASE WHEN level <= full_at THEN level END) OVER (), {CAP}::DOUBLE * source_size)) AS target FROM l),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY s ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g USING (s)),
n AS (SELECT s, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target) / source_size) * ceil(source_size / {BLOCK})
             + ceil((floor(target) - floor(floor(target) / source_size) * source_size) / {BLOCK}) END)::BIGINT AS need FROM g),
v AS (SELECT s, unnest(range(((sum(need) OVER (ORDER BY s)) - need)::BIGINT, (sum(need) OVER (ORDER BY s))::BIGINT)) AS v FROM n),
c AS (SELECT greatest(1, ceil(log2(greatest(sum(need), 1))))::INT AS bits FROM n),
z AS (SELECT s, list_sum([((v >> i::INT) & 1) << (bits - 1 - i)::INT for i in range(bits)])::BIGINT AS slot FROM v, c),
y AS (SELECT s, slot, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS rank FROM z),
r AS (SELECT *, (least(greatest(floor(target) - start, 0), size) + least(greatest(floor(target) - source_size - start, 0), size))::BIGINT AS taken FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM r LEFT JOIN y ON r.s = y.s AND y.rank = (r.start // {BLOCK})
"""
