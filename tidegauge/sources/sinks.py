"""Results out: prepared bars, zones, episodes, statistics, sweep summaries and a run's metadata."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    """Parquet where the path ends so, else CSV with a header; arrays don't go to CSV."""
    if path.lower().endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.drop(*(n for n, kind in df.dtypes if kind.startswith("array"))).write.mode("overwrite").option("header", True).csv(path)


def zone_rows(zones: DataFrame) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c)
    return zones.select("id", "type", "level", "width", "p_value", "is_significant", F.size("touches").alias("n_touches"), iso("activation_time"), iso("expiry_time"), "symbol")


def statistics_tree(rates: DataFrame, metrics: DataFrame, intervals: DataFrame) -> dict:
    """The statistics by stratum, nested as in the JSON file; under each symbol's name where the bars have symbols. Strata are a few dozen rows a symbol."""
    out: dict = {}
    for r in rates.orderBy("symbol", "stratum").collect():
        own = out.setdefault(r["symbol"], {}).setdefault(r["stratum"], {"n_episodes": r["n_episodes"], "n_invalid_episodes": r["n_invalid"], "outcome_distribution": {}, "outcome_rates": {}, "outcome_rates_ci": {}, "bootstrapped_metrics": {}})
        if r["n_episodes"]:
            own["outcome_distribution"][r["outcome"]], own["outcome_rates"][r["outcome"]], own["outcome_rates_ci"][r["outcome"]] = r["n"], r["rate"], [r["ci_low"], r["ci_high"]]
    for r in metrics.join(intervals, ["symbol", "stratum", "metric"]).collect():
        out[r["symbol"]][r["stratum"]]["bootstrapped_metrics"][r["metric"]] = {
            "mean": r["mean"], "mean_ci": [r["mean_low"], r["mean_high"]], "median": r["median"], "median_ci": [r["median_low"], r["median_high"]], "p25": r["p25"], "p75": r["p75"],
        }
    return out[""] if set(out) == {""} else out


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


#: Bytes of a file that an executor takes whole to hash it; larger files are streamed by the driver, as SHA-256 has no parts.
WHOLE = 1 << 29


def file_hashes(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of each file, those of folders too: hashed on the executors, a row a file; only digests reach the driver, but for files that Spark's source passes over (empty and hidden ones) or that are too large for a row."""
    out, digest = {}, spark._jvm.org.apache.commons.codec.digest.DigestUtils
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        known = {r["path"]: r["digest"] for r in files.filter(F.col("length") <= WHOLE).select("path", F.sha2("content", 256).alias("digest")).collect()}
        fs, where = _at(spark, path)
        found = fs.listFiles(where, True)
        while found.hasNext():
            own = found.next().getPath()
            if own.toString() not in known:
                stream = fs.open(own)
                try:
                    known[own.toString()] = digest.sha256Hex(stream)
                finally:
                    stream.close()
        out |= known
    return out


def code_hash() -> str:
    """SHA-256 over all modules of the package, their names included."""
    root, digest = Path(__file__).resolve().parent.parent, hashlib.sha256()
    for path in sorted(root.rglob("*.py")):
        digest.update(f"{path.relative_to(root)}\0".encode() + hashlib.sha256(path.read_bytes()).digest())
    return digest.hexdigest()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, wherever the path points."""
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_metadata(spark: SparkSession, folder: str, command: str, args: dict, paths: list[str], config) -> None:
    found = {"run_timestamp_utc": datetime.now(timezone.utc).isoformat(), "command": command, "args": args, "code_sha256": code_hash(), "data_sha256": file_hashes(spark, paths), "config": dataclasses.asdict(config)}
    write_text(spark, f"{folder}/run_metadata.json", json.dumps(found, indent=2, default=str))
