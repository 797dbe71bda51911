"""Mixing sources to target weights by Pfair scheduling.

Every stream (a listed source, or all others together) is cut into blocks of about equal
size. With integer weights that sum to a period H, block k (from 0) of a stream of weight
w is released at slot floor(k*H/w) and due by slot ceil((k+1)*H/w). Earliest deadline
first over the released blocks gives each slot to one block, and at every slot each
stream that has blocks left has got its share of the slots so far to within one block.

The weights of a period are used up exactly, so the schedule repeats with period H: only
one period is computed, and block k of any stream finds its slot by arithmetic and one
join with that table of H rows. Nothing is simulated over the data.

A stream that runs out leaves its later slots empty. The others keep their proportions,
no row is dropped or repeated, and ``full`` marks the slots before the first stream ran
out, where all the target weights hold at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from pairrank.llm.expressions import small
from pairrank.runtime import materialise

# Largest period. It bounds the schedule table, and so what is broadcast.
MAX_PERIOD = 10_000
# Rows that one task orders at a time; a stream is spread over as many buckets as it needs.
ROWS_PER_BUCKET = 1024
# A bucket with so many times these rows holds a key that must be told apart.
OVERFULL = 4
# Buckets whose sizes one task adds up.
BUCKETS_PER_GROUP = 1024
RESULTS = ["stream", "block", "slot", "place", "full"]


def period(spark: SparkSession, weights: list[int]) -> DataFrame:
    """One period of the schedule: ``stream``, ``nth`` (block within the period), ``slot``."""
    if any(w <= 0 or w != int(w) for w in weights):
        raise ValueError("weights are positive integers")
    total = sum(weights)
    if total > MAX_PERIOD:
        raise ValueError(f"the weights sum to {total}, above {MAX_PERIOD}")
    shares = F.array(*(F.lit(w).cast("long") for w in weights))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), len(weights)).alias("done"),
        F.expr("cast(array() as array<struct<stream: int, nth: bigint>>)").alias("slots"),
    )

    def step(state: Column, slot: Column) -> Column:
        # For each stream its next block's deadline, or null if it isn't released or none is left.
        due = F.zip_with(state["done"], shares, lambda k, w: F.when(
            (k < w) & (F.floor(k * total / w) <= slot), F.ceil((k + 1) * total / w)))
        ranked = F.transform(due, lambda d, i: F.when(d.isNotNull(), F.struct(d.alias("due"), i.alias("stream"))))
        first = F.array_min(ranked)["stream"]
        return F.struct(
            F.transform(state["done"], lambda k, i: F.when(i == first, k + 1).otherwise(k)).alias("done"),
            F.concat(state["slots"], F.array(F.struct(
                first.alias("stream"), F.get(state["done"], first).alias("nth")))).alias("slots"),
        )

    slots = F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), start, step, lambda state: state["slots"])
    return spark.range(1).select(F.posexplode(slots).alias("slot", "at")).select("at.stream", "at.nth", "slot")


def stream_of(source: Column, weights: dict[str, int]) -> Column:
    """Position of the source among the listed ones; all others share the next position."""
    listed = F.create_map(*(F.lit(x) for i, name in enumerate(weights) for x in (name, i)))
    return F.coalesce(F.element_at(listed, source.cast("string")), F.lit(len(weights)))


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def in_buckets(rows: DataFrame, buckets: Column) -> DataFrame:
    """The rows with their ``bucket``: the first 32 bits of the order, scaled to the stream's number of buckets, so buckets follow the order."""
    leading = F.coalesce(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.lit(0))
    return rows.withColumn("bucket", F.floor(leading * F.get(buckets, F.col("stream")) / F.lit(2**32)))


def without_hot_orders(rows: DataFrame, buckets: Column) -> DataFrame:
    """The rows in buckets. An order that many rows share, and that overfills its bucket, is told apart by the rows
    themselves, and where these are equal by their places in a written table."""
    cells = [F.col("row." + "`" + f.name.replace("`", "``") + "`") for f in rows.schema["row"].dataType if not isinstance(f.dataType, MapType)]
    for by_place in (False, True):
        placed = in_buckets(rows, buckets)
        full = placed.groupBy("stream", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > OVERFULL * ROWS_PER_BUCKET)
        full = materialise(full.select("stream", "bucket"), "full-buckets")
        if full.isEmpty():
            return placed
        counts = placed.join(small(full), ["stream", "bucket"], "left_semi").groupBy("stream", "order").agg(F.count("*").alias("n"))
        hot = small(materialise(counts.where(F.col("n") > ROWS_PER_BUCKET).select("stream", "order"), "hot-orders"))
        own = F.md5(F.concat_ws(":", "order", F.xxhash64(*cells)))
        shared = rows.join(hot, ["stream", "order"], "left_semi")
        if by_place:
            shared = materialise(shared.withColumn("id", F.monotonically_increasing_id()), "equal-rows")
            own = F.md5(F.concat_ws(":", "order", "id"))
        told = shared.withColumn("order", own).select(*rows.columns)
        rows = rows.join(hot, ["stream", "order"], "left_anti").select(*rows.columns).unionByName(told)
    return in_buckets(rows, buckets)


def sums_before(sums: DataFrame) -> DataFrame:
    """Size and rows of a stream before each of its buckets: within groups of buckets, and over the groups."""
    sums = sums.withColumn("group", F.floor(F.col("bucket") / BUCKETS_PER_GROUP))
    groups = sums.groupBy("stream", "group").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))

    def running(by: Window, value: str) -> Column:
        return F.coalesce(F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    over_groups = Window.partitionBy("stream").orderBy("group")
    before = groups.select("stream", "group", running(over_groups, "size").alias("group_size"), running(over_groups, "n").alias("group_rows"))
    within = Window.partitionBy("stream", "group").orderBy("bucket")
    return sums.join(before, ["stream", "group"]).select(
        "stream", "bucket", (F.col("group_size") + running(within, "size")).alias("size_before"),
        (F.col("group_rows") + running(within, "n")).alias("rows_before"))


def mix(
    documents: DataFrame, weights: dict[str, int], rest: int, block_size: int,
    source: str = "source", key: str = "doc_id", size: Column | None = None,
) -> DataFrame:
    """All rows of ``documents`` with ``stream``, ``block``, ``slot``, ``place`` and ``full``.

    Reading rows by (slot, place) gives the mixture. Within a stream rows come in the
    order of the md5 of ``key`` (then of ``key``), a fixed shuffle. A row belongs to the
    block in which it starts: block = floor(size of the rows before it / ``block_size``).
    ``size`` counts 1 a row unless given (a null or negative size counts 0), so a very long
    text simply fills several blocks. ``place`` is the row's number within its stream.

    Rows of a key that fills buckets of its own are shuffled by the md5 of key and row instead,
    so that no task orders them all; rows that are equal in all columns and as many lie among
    the others in no fixed order.

    Sources that ``weights`` does not list, null among them, form one stream of weight
    ``rest``. A null key sorts first; rows with equal keys keep some order among
    themselves and all stay. An empty table gives an empty result. Input columns that are
    named like a result column are replaced by it. ``block_size`` below 1 raises.
    """
    if block_size < 1:
        raise ValueError("block_size is at least 1")
    slots = period(documents.sparkSession, [*weights.values(), rest])
    total = sum(weights.values()) + rest
    given = F.lit(1) if size is None else size
    # What the input holds stands in one column, so none of its names meets a working name.
    rows = documents.select(
        F.struct(*(named(c) for c in documents.columns if c not in RESULTS)).alias("row"),
        stream_of(named(source), weights).alias("stream"),
        F.coalesce(F.md5(named(key).cast("string")), F.lit("")).alias("order"),
        named(key).alias("key"),
        F.greatest(F.coalesce(given.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("size"),
    )
    # One row per stream, of which there are as many as weights.
    totals = {r["stream"]: r for r in rows.groupBy("stream").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    streams = range(len(weights) + 1)
    buckets = F.array(*(F.lit(totals[i].n // ROWS_PER_BUCKET + 1 if i in totals else 1) for i in streams))
    rows = without_hot_orders(rows, buckets)
    sums = rows.groupBy("stream", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    inside = Window.partitionBy("stream", "bucket").orderBy("order", "key")
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        rows.withColumns({"ahead": ahead, "nth_row": F.row_number().over(inside)})
        .join(sums_before(sums), ["stream", "bucket"])
        .withColumn("block", F.floor((F.col("size_before") + F.col("ahead")) / block_size))
        .withColumn("place", F.col("rows_before") + F.col("nth_row") - 1)
    )
    shares = F.array(*(F.lit(w).cast("long") for w in (*weights.values(), rest)))

    def slot_of(rows: DataFrame) -> DataFrame:
        """``slot`` of ``block``; H rows at most are broadcast."""
        share = F.get(shares, F.col("stream"))
        at = slots.select("stream", "nth", F.col("slot").alias("at"))
        return (
            rows.withColumn("nth", F.col("block") % share)
            .join(F.broadcast(at), ["stream", "nth"])
            .withColumn("slot", F.floor(F.col("block") / share) * total + F.col("at"))
        )

    # The slot that each stream's first missing block would have had; the earliest ends the full mixture.
    spent = [(i, -(-totals[i]["size"] // block_size) if i in totals else 0) for i in streams]
    ends = slot_of(documents.sparkSession.createDataFrame(spent, "stream int, block bigint"))
    end = ends.agg(F.min("slot")).first()[0]
    mixed = slot_of(placed).withColumn("full", F.col("slot") < end)
    return mixed.select("row.*", *RESULTS)


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture with its rows in reading order, across and within the partitions."""
    by = ["slot", "place"]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)
