"""A versioned store of vectors, laid out so that lookups don't move it.

Entries lie in buckets of their key's hash, as Spark's own bucketed files. A merge writes
the buckets that new entries fall in, once more and whole, under a write number of its own;
then one small manifest says for each bucket which write counts. A version exists once its
manifest is there, so a merge that dies leaves the last version as it was, and who reads an
older version goes on reading the same files.

A join with the store on its key needs no shuffle of the store: Spark reads the files bucket
by bucket, sorted within, and only the keys that are asked for are brought to them. Every
file holds a Bloom filter of its keys, so a lookup of few keys skips most row groups.

Merges of one store must not overlap; the later of two fails instead of losing the other's
entries.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank import schemas as S
from pairrank.functions.text import quoted
from pairrank.models.embedders import Embedder
from pairrank.operators.embedding import embed_table
from pairrank.operators.lookup import lookup
from pairrank.operators.store import KEY, with_key
from pairrank.runtime import materialise

# Buckets of a new store. A task of a lookup reads one, so a store that will hold a billion
# vectors wants thousands of them.
BUCKETS = 64
ENTRY = "entity_id string, model_id string, text_sha string, embedding array<double>, updated_at timestamp, kind string, key string, bucket int"
MANIFEST = "buckets int, bucket int, write long, version long"


class Version(NamedTuple):
    number: int
    buckets: int
    writes: dict[int, int]  # the write that counts for each bucket that has entries


def key_of() -> Column:
    """One text for the columns of KEY, whatever they hold."""
    return F.sha2(F.to_json(F.struct(*KEY)), 256)


def bucket_of(buckets: int) -> Column:
    """The bucket in which Spark writes a key."""
    return F.pmod(F.hash("key"), F.lit(buckets))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all versions; empty if there is none yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The last version, or that of a number; None for a store without any. A manifest has one row a bucket."""
    all_ = versions(spark, path)
    number = all_.agg(F.max("version")).first()[0] if number is None else number
    rows = all_.where(F.col("version") == number).collect() if number else []
    if number and not rows:
        raise ValueError(f"there is no version {number} in {path}")
    return Version(number, rows[0].buckets, {r.bucket: r.write for r in rows}) if rows else None


def _table(spark: SparkSession, path: str, buckets: int, writes: set[int]) -> str:
    """The name under which the session knows the store's files, and as partitions of it the given writes."""
    name = f"pairrank_store_{hashlib.md5(f'{path}:{buckets}'.encode()).hexdigest()}"
    at = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({ENTRY}, write BIGINT) USING parquet "
        f"OPTIONS ('parquet.bloom.filter.enabled#key' = 'true', 'parquet.bloom.filter.max.bytes' = '{1 << 20}') "
        f"PARTITIONED BY (write) CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{at}/data'")
    if writes:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (write = {w})" for w in sorted(writes)))
    return name


def read_entries(spark: SparkSession, path: str, of: Version) -> DataFrame:
    """The entries of a version with their key and bucket, in the layout of the files."""
    writes = set(of.writes.values())
    files = spark.table(_table(spark, path, of.buckets, writes)).where(F.col("write").isin(*writes))
    # Earlier copies of a bucket may stand in a write that counts for other buckets.
    counts = spark.createDataFrame([(b, w) for b, w in of.writes.items()], "bucket int, write long")
    return files.join(F.broadcast(counts), ["bucket", "write"], "left_semi").drop("write")


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version of the store, by default the last, in the columns of a store. What is read stays the same whatever is merged meanwhile."""
    of = version(spark, path, number)
    return read_entries(spark, path, of).select(*S.STORE_SCHEMA.names) if of else spark.createDataFrame([], S.STORE_SCHEMA)


def merge(spark: SparkSession, entries: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Add entries to a store and return the number of the version that holds them.

    The last write of a key (``updated_at``) counts; among equal ones the new entry does.
    Only the buckets that new entries fall in are read and written. ``buckets`` counts for
    a store's first merge. Without entries there is no new version.
    """
    last = version(spark, path)
    buckets = last.buckets if last else buckets
    new = entries.select(*S.STORE_SCHEMA.names).withColumn("key", key_of())
    new = materialise(new.withColumns({"bucket": bucket_of(buckets), "_new": F.lit(True)}), "store-entries")
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    if not touched:
        return last.number if last else 0
    both = new
    if last and any(b in last.writes for b in touched):
        both = new.unionByName(read_entries(spark, path, last).where(F.col("bucket").isin(*touched)).withColumn("_new", F.lit(False)))
    order = F.struct("updated_at", "_new")
    kept = both.groupBy("key", "bucket").agg(F.max_by(F.struct(*S.STORE_SCHEMA.names), order).alias("_last"))
    # A number of its own, so that what a merge that died has left is never taken for this one's.
    write = uuid.uuid4().int >> 66
    rows = kept.select("_last.*", "key", "bucket", F.lit(write).cast("long").alias("write"))
    # One task for each bucket, and so one file.
    rows.repartition(buckets, "key").write.mode("append").insertInto(_table(spark, path, buckets, set()))
    number = last.number + 1 if last else 1
    counting = {**(last.writes if last else {}), **dict.fromkeys(touched, write)}
    manifest = spark.createDataFrame([(buckets, b, w) for b, w in sorted(counting.items())], "buckets int, bucket int, write long")
    manifest.coalesce(1).write.mode("error").parquet(f"{path}/versions/version={number}")
    return number


def load_from_snapshot(df: DataFrame, path: str, kind: str, id: str, model_id: str, text: str | None = None,
                       number: int | None = None, **options) -> DataFrame:
    """Add the stored ``embedding`` and ``needs_embedding`` to each row, as ``load_vectors`` does.

    Only the distinct keys of ``df`` move to the buckets; the store is read where it lies.
    """
    spark = df.sparkSession
    columns = [quoted(c) for c in df.columns if c != "embedding"]
    rows = with_key(df.drop("embedding"), kind, id, model_id, text).withColumn("key", key_of())
    of = version(spark, path, number)
    if of is None:
        return rows.select(*columns, F.lit(None).cast("array<double>").alias("embedding"), F.lit(True).alias("needs_embedding"))
    found = lookup(rows, stored_keys(rows, path, of), ["key"], **options)
    return found.select(*columns, "embedding", F.col("embedding").isNull().alias("needs_embedding"))


def stored_keys(rows: DataFrame, path: str, of: Version) -> DataFrame:
    """key and embedding of those keys of ``rows`` that a version of the store has."""
    asked = rows.where(F.col("entity_id") != "").select("key").distinct().repartition(of.buckets, "key")
    return asked.join(read_entries(rows.sparkSession, path, of).select("key", "embedding"), "key")


# --- model calls that survive the job ---------------------------------------------

# Keys of one range: what is embedded anew if its task is lost.
RANGE_KEYS = 10_000


def _ready(spark: SparkSession, run: str) -> bool:
    """Whether a run's pending texts were written to their end; a small table says so."""
    try:
        return not spark.read.schema("keys long").parquet(f"{run}/ready").isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def finish_run(spark: SparkSession, run: str, embedder: Embedder, ranges_at_once: int | None = None, **options) -> DataFrame:
    """Embed what is still open of a run's pending texts, and return all its entries.

    The pending texts lie in files of one range of keys each. A stream takes them up, some
    at a time, and its checkpoint and the log of its sink are the ledger: a range that was
    published once is never embedded again, and none is published twice.
    """
    pending = spark.read.parquet(f"{run}/pending")
    at_once = ranges_at_once or spark.sparkContext.defaultParallelism
    texts = spark.readStream.schema(pending.schema).option("maxFilesPerTrigger", at_once).parquet(f"{run}/pending")
    entries = embed_table(texts, "text", embedder, **options).select(
        "entity_id", "model_id", "text_sha", "embedding", F.current_timestamp().alias("updated_at"), "kind")
    stream = (entries.writeStream.format("parquet").option("path", f"{run}/found").option("checkpointLocation", f"{run}/ledger")
              .outputMode("append").trigger(availableNow=True).start())
    stream.awaitTermination()
    return spark.read.schema(S.STORE_SCHEMA).parquet(f"{run}/found")


def embed_with_snapshots(df: DataFrame, kind: str, id: str, text: str, embedder: Embedder, path: str, buckets: int = BUCKETS,
                         range_keys: int = RANGE_KEYS, ranges_at_once: int | None = None, **options) -> DataFrame:
    """Embed what the store lacks, merge it in, and return every row with its vector.

    If an earlier call died on the way, what it has embedded is kept: its open ranges are
    finished first, whatever ``df`` is now. Rows with a blank id are embedded but not stored.
    ``df`` is read several times, so hand in a table that is cheap to read.
    """
    spark = df.sparkSession
    last = version(spark, path)

    def run_of(of: Version | None) -> str:
        """A run belongs to the version it starts from, the model and the kind; a merge closes it."""
        name = hashlib.md5(f"{kind}:{embedder.model_id}".encode()).hexdigest()
        return f"{path}/runs/{of.number if of else 0}-{name}"

    if _ready(spark, run_of(last)):
        merge(spark, finish_run(spark, run_of(last), embedder, ranges_at_once, **options), path, buckets)
        last = version(spark, path)
    rows = with_key(df.select(quoted(id), quoted(text)), kind, id, embedder.model_id, text).withColumn("key", key_of())
    new = rows.where(F.col("entity_id") != "")
    if last:
        new = lookup(new, stored_keys(rows, path, last).select("key"), ["key"], "left_anti")
    # A key that several rows share is embedded once.
    texts = materialise(new.dropDuplicates(["key"]).select(*KEY, "key", quoted(text).alias("text")), "pending")
    keys = texts.count()
    if keys:
        ranges = texts.repartition(-(-keys // range_keys), "key").drop("key")
        ranges.write.mode("overwrite").parquet(f"{run_of(last)}/pending")
        spark.createDataFrame([(keys,)], "keys long").coalesce(1).write.mode("error").parquet(f"{run_of(last)}/ready")
        merge(spark, finish_run(spark, run_of(last), embedder, ranges_at_once, **options), path, buckets)
    loaded = load_from_snapshot(df, path, kind, id, embedder.model_id, text)
    return embed_table(loaded, text, embedder, where=F.col("needs_embedding"), **options).drop("needs_embedding")
