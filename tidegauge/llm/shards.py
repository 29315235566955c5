"""Sharding by a two-pass external shuffle: seeded scatter to small buckets, then a Fisher-Yates shuffle of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, spread, whole_text

#: Records of a bucket, about; buckets of a run of buckets that one window numbers; shards.
BUCKET_ROWS, RUN, SHARDS, SEED = 256, 4096, 8, 7

#: Slots of one file of a shard.
FILE_ROWS = 100_000


def _shuffled(seed: int):
    """Fisher-Yates over bucket_rows: for i from the last down, swap i with a keyed draw from 0 to i. Swaps move places, not records."""
    n = F.size("records_")
    draws = F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.struct(i.alias("i"), F.pmod(F.xxhash64("bucket_", i, F.lit(seed)), i + 1).cast("int").alias("j")))

    def swap(places, d):
        i, j = d["i"], d["j"]
        swapped = F.concat(F.slice(places, 1, j), F.slice(places, i + 1, 1), F.slice(places, j + 2, i - j - 1), F.slice(places, j + 1, 1), F.slice(places, i + 2, n))
        return F.when(i == j, places).otherwise(swapped)

    return F.aggregate(draws, F.sequence(F.lit(0), n - 1), swap)


def scattered(docs: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """bucket_ and record_, a struct of order_ and the columns of docs; the hash takes in what tells rows alike apart."""
    number = free_name(docs, "number_")
    order = F.xxhash64(*docs.columns, number, F.lit(seed))
    records = spread(docs, number).select(F.struct(order.alias("order_"), *docs.columns).alias("record_"))
    return records.select(F.pmod(F.col("record_.order_"), F.lit(buckets)).alias("bucket_"), "record_")


def shuffle(docs: DataFrame, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """docs with size, text_crc32, shard and slot: the rows in one seeded random order, dealt to the shards in turn.

    First pass: a seeded hash of all columns, and of what tells rows alike in all of them apart, scatters rows uniformly
    to buckets, whose number follows the rows, so that each is small however many rows are equal.
    Second pass: each bucket is put in order, then shuffled by Fisher-Yates with keyed draws; no draw depends on tasks or
    partitions, so reruns and retries agree. The row after those of all buckets before it goes to the next shard in turn:
    the shards' counts differ by one at most (the law `rows`), and slots have no gaps. Null texts have size 1 and CRC 0;
    empty tables give none. Columns of docs with clashing names give way.
    """
    docs = docs.drop("shard", "slot").withColumns({"size": (F.octet_length(whole_text()) + 1).cast("long"), "text_crc32": F.crc32(whole_text().cast("binary"))})
    buckets = docs.count() // bucket_rows + 1
    rows = scattered(docs, buckets, seed)
    filled = rows.groupBy("bucket_").agg(F.sort_array(F.collect_list("record_")).alias("records_"))
    counts = rows.groupBy("bucket_").agg(F.count("*").alias("n_")).withColumn("run_", F.floor(F.col("bucket_") / RUN))
    within = counts.withColumn("before_", F.sum("n_").over(Window.partitionBy("run_").orderBy("bucket_")) - F.col("n_"))
    runs = counts.groupBy("run_").agg(F.sum("n_").alias("run_n_")).withColumn("run_before_", F.sum("run_n_").over(Window.orderBy("run_")) - F.col("run_n_"))
    offsets = within.join(runs, "run_").select("bucket_", (F.col("before_") + F.col("run_before_")).alias("offset_"))
    out = filled.withColumn("places_", _shuffled(seed)).join(offsets, "bucket_")
    out = out.select("offset_", F.posexplode(F.transform("places_", lambda p: F.get("records_", p))).alias("at_", "r_"))
    place = F.col("offset_") + F.col("at_")
    return out.select(*(F.col(f"r_.{c}").alias(c) for c in docs.columns), (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **settings) -> None:
    """Writes docs, shuffled, as Parquet in a folder for each shard: files are runs of FILE_ROWS slots, in order, with rows by slot.

    A task writes some runs, not a shard, so shards of any size are written side by side. run_ names a run and stays a
    folder below the shard's, so that a reader finds the order; rows that come back are those of docs. An empty table gives no files.
    """
    out = shuffle(docs, **settings).withColumn("run_", F.floor(F.col("slot") / FILE_ROWS))
    out.repartition("shard", "run_").sortWithinPartitions("shard", "run_", "slot").write.partitionBy("shard", "run_").parquet(path)


def op10(docs: DataFrame) -> DataFrame:
    sized = shuffle(docs.select("doc_id", "text")).drop("text")
    return sized.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
