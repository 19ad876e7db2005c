"""Operator 7, mixing sources to target weights: fixed-length blocks, multinomial shard counts, index permutations.

Native: DataFrame functions only. The words of a source, document after document, are cut into blocks of BLOCK words.
Targets follow from the weights by water filling under the cap. The mix has as many slots as blocks are to be taken, a
quota for each source, and every output shard has SHARD slots.

1. Each slot draws its source by a hash of its number, in proportion to the quotas, so the counts of a shard are
   multinomial and independent of all other shards.
2. Slots of a source are numbered over all shards, by prefix sums of the counts, and the numbers are permuted. Drawn
   numbers miss a source's quota by about the root of it; free draws would miss small sources' targets by much. So the
   slots whose permuted number lies beyond the quota (a random choice, spread over all shards) are handed, in the order
   of their numbers, to the sources that drew too few. Then each source has its quota exactly.
3. The r-th slot of a source with n blocks belongs to its epoch r div n, and the epoch's own permutation of 0..n-1 gives
   the block, so no block comes twice before all came once. Slots meet blocks by an equi-join on (source, block).

Permutations are keyed and without a table: an affine map, then ROUNDS rounds of swap-or-not, in which x and k - x
(modulo n) trade places where a hash of the larger one and the round says so: one-to-one for every n. Offsets of
documents and numbers of slots come from two-level prefix sums, and all expansions are dealt over a stated number of
partitions, so a hot source is no single task.

Defined cases: null or wordless text has size 0 and is taken 0 times; mixed() leaves such documents out. A null source
is a source of its own, last. A null doc_id is an id like any other, ordered first. Repeated rows are documents of their
own. Ties in doc_id are ordered by size; equal rows are interchangeable. Extra columns, of any name, are ignored by the
digest and kept by mixed(). Empty tables give an empty result; sources of size 0 have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, cut, free_name, n_words, row_key, table

BLOCK = 64
SHARD = 1_024
WEIGHTS = (1, 2, 3)
CAP = 3
BUCKETS = 4_093
#: Numbers of a cell, by which numbers meet the intervals they lie in; cells of a chunk, and shards of a group.
CELL, CHUNK, GROUP = 64, 4_096, 1_024
#: Rows of a task that expands numbers, about.
ROWS = 500_000
ROUNDS = 8


def _primes(start: int, count: int) -> list[int]:
    """The first primes from start on."""
    out: list[int] = []
    x = start | 1
    while len(out) < count:
        if all(x % d for d in range(3, int(x**0.5) + 1, 2)):
            out.append(x)
        x += 2
    return out


#: No index range (below 2**63) is divisible by all of them, and prime times index stays below 2**63 up to 18e9 blocks.
PRIMES = _primes(480_000_000, 10)


def hashed(c: Column) -> Column:
    """A hash of 60 bits of a string."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def permuted(rows: DataFrame, x: str, n: str, which: str, out: str) -> DataFrame:
    """rows with out: the place of x under permutation number which of 0..n-1. All of them are column names."""
    x_, n_, which_ = F.col(x), F.col(n), F.col(which)
    fit = F.filter(F.array(*(F.lit(p).cast("long") for p in PRIMES)), lambda p: n_ % p != 0)
    p = F.get(fit, F.pmod(which_, F.size(fit)).cast("int"))
    start = F.pmod(F.pmod(p, n_) * x_ + F.pmod(which_ * F.lit(7_919) + F.lit(12_345), n_), n_)

    def swapped(now: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(which_ * F.lit(104_729) + F.lit(1_299_709) * (k + 1), n_) + n_ - now, n_)
        coin = F.substring(F.md5(F.concat_ws(":", k, which_, F.greatest(now, other)).cast("binary")), 1, 1) < "8"
        return F.when(coin, other).otherwise(now)

    # one expression that binds each round's number: a chain of columns would be copied into itself by the optimiser
    # (and never null, or a join on it would make it once more to test for null)
    return rows.withColumn(out, F.coalesce(F.aggregate(F.array(*(F.lit(k).cast("long") for k in range(ROUNDS))), start, swapped), F.lit(-1).cast("long")))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *more)


def plan_sources(docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """For each source of sized documents: idx, source_size, target, blocks, slots, before (slots of earlier sources)."""
    of = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    of = of.withColumn("idx", F.row_number().over(order).cast("long") - 1)
    of = of.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("idx"), F.lit(len(weights))).cast("int")))
    most, share = F.lit(cap) * F.col("source_size"), F.lit(cap) * F.col("source_size") / F.col("w")
    rising = Window.orderBy("share", "idx")
    of = of.withColumns({"most": most, "share": share, "all": F.sum("source_size").over(Window.partitionBy())})
    of = of.withColumn("level", (F.col("all") - F.sum("most").over(rising) + F.col("most")) / (F.sum("w").over(Window.partitionBy()) - F.sum("w").over(rising) + F.col("w")))
    of = of.withColumn("full", F.col("level") > F.col("share"))
    of = of.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy()))
    of = of.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("w")))
    of = of.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    of = of.withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long"))
    of = of.withColumn("before", F.sum("slots").over(order) - F.col("slots"))
    return of.withColumn("total", F.sum("slots").over(Window.partitionBy())).select("source", "idx", "source_size", "target", "blocks", "slots", "before", "total")


def _cells(intervals: DataFrame, low: str, size: str, total: int) -> DataFrame:
    """intervals (low, size) by the cells of CELL numbers that they reach into: column cell beside theirs."""
    last = f"({low} + {size} - 1)"
    big = intervals.where(f"{size} > 0").withColumn("big", F.explode(F.sequence(F.expr(f"{low} div {CELL * CHUNK}"), F.expr(f"{last} div {CELL * CHUNK}"))))
    big = big.repartition(1 + total // CELL // ROWS, "big", low)
    first, end = F.greatest(F.expr(f"{low} div {CELL}"), F.col("big") * CHUNK), F.least(F.expr(f"{last} div {CELL}"), F.col("big") * CHUNK + CHUNK - 1)
    return big.withColumn("cell", F.explode(F.sequence(first, end))).drop("big")


def shard_counts(sources: DataFrame, total: int, shard: int = SHARD) -> DataFrame:
    """shard, idx, n: the multinomial counts that each output shard draws."""
    slots = sources.sparkSession.range(0, total, 1, 1 + total // ROWS).withColumn("pos", hashed(F.concat(F.lit("draw:"), F.col("id").cast("string"))) % total)
    slots = slots.select(F.expr(f"id div {shard}").alias("shard"), "pos", F.expr(f"pos div {CELL}").alias("cell"))
    of = _cells(sources.select("idx", "before", "slots"), "before", "slots", total)
    return slots.join(of, "cell").where("pos >= before AND pos < before + slots").groupBy("shard", "idx").agg(F.count("*").alias("n"))


def placements(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """idx, epoch, block, shard: a row for each slot of the mix."""
    total = sources.agg(F.max("total")).first()[0] or 0
    drawn = cut(shard_counts(sources, total, shard), "counts")
    order = Window.orderBy("idx")  # a row for each source
    of = sources.where("slots > 0").join(drawn.groupBy("idx").agg(F.sum("n").alias("drawn")), "idx", "left").fillna(0, ["drawn"])
    of = of.select("idx", "blocks", "slots", "drawn", F.greatest(F.lit(0), F.expr("drawn - slots")).alias("over"), F.greatest(F.lit(0), F.expr("slots - drawn")).alias("under"))
    of = of.withColumns({"over_before": F.sum("over").over(order) - F.col("over"), "under_before": F.sum("under").over(order) - F.col("under")})
    of = cut(of, "quotas")
    # slots of a source before each shard: those of earlier groups of shards, and those within the group
    drawn = drawn.withColumn("part", F.expr(f"shard div {GROUP}"))
    parts = drawn.groupBy("idx", "part").agg(F.sum("n").alias("m"))
    parts = parts.select("idx", "part", (F.sum("m").over(Window.partitionBy("idx").orderBy("part")) - F.col("m")).alias("ahead"))
    drawn = drawn.withColumn("within", F.sum("n").over(Window.partitionBy("idx", "part").orderBy("shard")) - F.col("n")).join(parts, ["idx", "part"]).join(of, "idx")
    spread = drawn.repartition(1 + total // ROWS, "shard", "idx")
    slots = spread.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumns({"r": F.col("ahead") + F.col("within") + F.col("k"), "which": F.col("idx") * 2 + 1})
    slots = permuted(slots, "r", "drawn", "which", "rank")
    slots = cut(slots.select("idx", "shard", "rank", "slots", "blocks", "over_before"), "slots")
    kept = slots.where("rank < slots").select("idx", "shard", "rank", "blocks")
    left = slots.where("rank >= slots").select("shard", F.expr("over_before + rank - slots").alias("e")).withColumn("cell", F.expr(f"e div {CELL}"))
    takers = _cells(of.select("idx", "blocks", "drawn", "under", "under_before"), "under_before", "under", total)
    moved = left.join(takers, "cell").where("e >= under_before AND e < under_before + under").select("idx", "shard", F.expr("drawn + e - under_before").alias("rank"), "blocks")
    rows = kept.union(moved).withColumns({"epoch": F.expr("rank div blocks"), "at": F.expr("rank % blocks")}).withColumn("which", F.col("idx") * 5 + F.col("epoch"))
    return permuted(rows, "at", "blocks", "which", "block").select("idx", "epoch", "block", "shard")


def located(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Sized documents with idx, source_size, target and start: the words of their source before them."""
    docs = docs.join(sources.select(F.col("source").alias("s"), "idx", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    docs = docs.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(BUCKETS)))
    of = docs.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    of = of.select(F.col("idx").alias("i"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("idx").orderBy("bucket")) - F.col("n")).alias("ahead"))
    within = Window.partitionBy("idx", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("within", F.sum("size").over(within) - F.col("size"))
    return docs.join(of.hint("merge"), (F.col("idx") == F.col("i")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("ahead") + F.col("within")).drop("i", "b", "bucket", "ahead", "within")


def _spans(docs: DataFrame, block: int) -> DataFrame:
    """Located documents by the blocks they reach into, with from and to: their words there, counted from their start."""
    end = F.col("start") + F.col("size")
    rows = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    return rows.withColumns({"from": F.greatest(F.col("start"), F.col("block") * block) - F.col("start"), "to": F.least(end, F.col("block") * block + block) - F.col("start")})


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard (the first output shard that holds words of it) for every row of docs."""
    own = cut(sized(docs), "sized")
    sources = cut(plan_sources(own, block), "sources")
    at = located(own, sources)
    times = placements(sources).groupBy("idx", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    spans = _spans(at, block).join(times.hint("merge"), ["idx", "block"], "left")
    sums = [F.sum((F.col("to") - F.col("from")) * F.coalesce("times", F.lit(0))).alias("taken"), F.min("shard").alias("first_shard")]
    taken = spans.groupBy("idx", "start", "doc_id", "size", "source_size", "target").agg(*sums)
    none = own.where("size = 0").join(sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    none = none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return taken.select(*none.columns).union(none)


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: rows with the columns of docs, for each document and epoch the words taken of it (its whole text where all are).

    Documents without words, and those no slot falls to, are not in it.
    """
    key = row_key(docs)
    own = cut(sized(docs, key.alias("key")), "sized")
    sources = cut(plan_sources(own, block), "sources")
    spans = _spans(located(own, sources), block).join(placements(sources).select("idx", "block", "epoch").hint("merge"), ["idx", "block"])
    parts = spans.groupBy("doc_id", "key", "idx", "start", "epoch", "size").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges"), F.sum(F.col("to") - F.col("from")).alias("n"))
    mine, theirs, taken_id, ranges = free_name(docs, "mine", "theirs", "taken_id", "ranges")
    parts = parts.select(F.col("doc_id").alias(taken_id), F.col("key").alias(theirs), F.when(F.col("n") < F.col("size"), F.col("ranges")).alias(ranges))
    keyed = docs.withColumn(mine, key)
    if not own.groupBy("doc_id", "key").count().where("count > 1").isEmpty():  # rows that repeat in all columns have parts of their own
        keyed = keyed.dropDuplicates(["doc_id", mine])
    both = keyed.join(parts, F.col("doc_id").eqNullSafe(F.col(taken_id)) & (F.col(mine) == F.col(theirs)))
    words = F.split(F.trim(F.regexp_replace("text", GAP, " ")), " ")
    taken = lambda w: F.array_join(F.flatten(F.transform(ranges, lambda r: F.slice(w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    some = F.get(F.transform(F.array(words), taken), F.lit(0))  # bound to a variable, the words are split once, not once a range
    both = both.withColumn("text", F.when(F.col(ranges).isNull(), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast("long"))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql_permuted(name: str, rows: str, x: str, n: str, which: str, out: str) -> str:
    """Common table expressions name0.. that add out, as permuted() does; the last one is called name."""
    ctes = [f"{name}0 AS (SELECT *, list_filter([{', '.join(map(str, PRIMES))}]::BIGINT[], lambda p: {n} % p <> 0) AS fit FROM {rows})"]
    ctes.append(f"{name}1 AS (SELECT * EXCLUDE (fit), ((fit[1 + {which} % len(fit)] % {n}) * {x} + ({which} * 7919 + 12345) % {n}) % {n} AS {out} FROM {name}0)")
    for k in range(ROUNDS):
        ctes.append(f"{name}a{k} AS (SELECT *, (({which} * 104729 + {1_299_709 * (k + 1)}) % {n} + {n} - {out}) % {n} AS other FROM {f'{name}b{k - 1}' if k else name + '1'})")
        swap = f"CASE WHEN substr(md5('{k}:' || {which} || ':' || greatest({out}, other)), 1, 1) < '8' THEN other ELSE {out} END"
        ctes.append(f"{name if k == ROUNDS - 1 else f'{name}b{k}'} AS (SELECT * EXCLUDE ({out}, other), {swap} AS {out} FROM {name}a{k})")
    return ", ".join(ctes)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS idx FROM d GROUP BY source
), s1 AS (
  SELECT *, CAST(1 + idx % 3 AS DOUBLE) AS w, {CAP} * source_size AS most, {CAP} * source_size / CAST(1 + idx % 3 AS DOUBLE) AS share FROM s0
), s2 AS (
  SELECT *, CAST(sum(source_size) OVER () - sum(most) OVER o + most AS DOUBLE) / (sum(w) OVER () - sum(w) OVER o + w) AS lev FROM s1 WINDOW o AS (ORDER BY share, idx)
), s3 AS (
  SELECT *, lev > share AS capped, max(CASE WHEN lev <= share THEN lev END) OVER () AS level FROM s2
), s4 AS (
  SELECT source, idx, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE level * w END AS target, CAST((source_size + {BLOCK - 1}) // {BLOCK} AS BIGINT) AS blocks FROM s3
), s AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS slots FROM s4
), draw AS (
  SELECT u.id // {SHARD} AS shard, CAST('0x' || substr(md5('draw:' || u.id), 1, 15) AS BIGINT) % u.total AS pos FROM (SELECT total, unnest(range(total)) AS id FROM (SELECT CAST(sum(slots) AS BIGINT) AS total FROM s) WHERE total > 0) u
), pool AS (
  SELECT idx, blocks, slots, CAST(sum(slots) OVER (ORDER BY idx) - slots AS BIGINT) AS before FROM s WHERE slots > 0
), dealt AS (
  SELECT p.*, draw.shard, row_number() OVER (PARTITION BY p.idx ORDER BY shard, pos) - 1 AS r, count(*) OVER (PARTITION BY p.idx) AS drawn, p.idx * 2 + 1 AS which FROM pool p JOIN draw ON pos >= before AND pos < before + slots
), {_sql_permuted("drawn", "dealt", "r", "drawn", "which", "rnk")}, quota AS (
  SELECT *, sum(greatest(0, drawn - slots)) OVER o - greatest(0, drawn - slots) AS over_before, greatest(0, slots - drawn) AS under, sum(greatest(0, slots - drawn)) OVER o - greatest(0, slots - drawn) AS under_before
  FROM (SELECT p.idx, p.blocks, p.slots, coalesce(n, 0) AS drawn FROM pool p LEFT JOIN (SELECT idx, count(*) AS n FROM dealt GROUP BY 1) c ON p.idx = c.idx) WINDOW o AS (ORDER BY idx)
), given AS (
  SELECT idx, blocks, shard, rnk FROM drawn WHERE rnk < slots
  UNION ALL SELECT t.idx, t.blocks, e.shard, t.drawn + e.e - t.under_before
  FROM (SELECT shard, q.over_before + rnk - drawn.slots AS e FROM drawn JOIN quota q ON drawn.idx = q.idx WHERE rnk >= drawn.slots) e JOIN quota t ON e >= t.under_before AND e < t.under_before + t.under
), spots AS (
  SELECT idx, blocks, shard, CAST(rnk % blocks AS BIGINT) AS pos, CAST(idx * 5 + rnk // blocks AS BIGINT) AS which FROM given
), {_sql_permuted("placed", "spots", "pos", "blocks", "which", "block")}, t AS (
  SELECT idx, block, count(*) AS times, min(shard) AS shard FROM placed GROUP BY 1, 2
), loc AS (
  SELECT d.doc_id, d.size, s.idx, s.source_size, s.target, sum(d.size) OVER (PARTITION BY s.idx ORDER BY ((coalesce(d.doc_id, -1) % {BUCKETS}) + {BUCKETS}) % {BUCKETS}, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), spans AS (
  SELECT *, unnest(range(CAST(start // {BLOCK} AS BIGINT), CAST((start + size - 1) // {BLOCK} + 1 AS BIGINT))) AS block FROM loc WHERE size > 0
), sums AS (
  SELECT doc_id, size, source_size, target, p.idx, start, CAST(sum((least(start + size, (p.block + 1) * {BLOCK}) - greatest(start, p.block * {BLOCK})) * coalesce(times, 0)) AS BIGINT) AS taken, min(shard) AS first_shard
  FROM spans p LEFT JOIN t ON p.idx = t.idx AND p.block = t.block GROUP BY ALL
)
SELECT doc_id, size, source_size, target, taken, first_shard FROM sums
UNION ALL SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT), NULL FROM loc WHERE size = 0
"""
