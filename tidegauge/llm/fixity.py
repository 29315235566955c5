"""WARC records and their Merkle fixity audit: replicas are compared by roots, and only differing branches are descended."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import cut

#: A node has 2 ** BITS children; a WARC file holds the records of 2 ** FILE_BITS successive page ids.
BITS, FILE_BITS = 4, 12
_LANES = 4
#: A record's first line, and what ends its head and itself.
VERSION, RECORD_END = "WARC/1.1\r\n", "\r\n\r\n"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC resource record; null parts count as empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes pages as WARC files: one for each 2 ** FILE_BITS successive page ids, in a folder file=<number>, records in order of id.

    A file's bytes are its records one after the other, as warc_record() gives them. Records without an id go to file -1.
    """
    number = F.shiftright(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)), FILE_BITS)
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(number.alias("file"), F.col("page_id").cast("long").alias("id"), F.left(record, F.length(record) - len(RECORD_END)).alias("value"))
    rows = rows.repartition("file").sortWithinPartitions("file", F.col("id").asc_nulls_first(), "value")
    rows.select("file", "value").write.partitionBy("file").option("lineSep", RECORD_END).text(path)


def _records(content: bytes):
    """page_id, url, html and damaged of each record of a file's bytes, walked by Content-Length.

    Where the walk meets no head, or a body that doesn't end as a record does, one damaged record stands for what it has read,
    and the walk goes on at the next first line of a record.
    """
    start, end, at = VERSION.encode(), RECORD_END.encode(), 0
    while at < len(content):
        stop = content.find(end, at)
        length = re.findall(rb"\r\nContent-Length: ([0-9]+)$", content[at:stop]) if stop >= 0 and content.startswith(start, at) else []
        body = stop + len(end)
        to = body + int(length[0]) if length else -1
        if length and content[to : to + len(end)] == end:
            head, text = content[at:stop].decode("utf-8", "replace"), content[body:to].decode("utf-8", "replace")
            page, url = re.search("<urn:page:(-?[0-9]*)>", head), re.search("WARC-Target-URI: (.*?)\r\nContent-Type: ", head, re.DOTALL)
            yield int(page[1]) if page and page[1] not in ("", "-") else None, url[1] if url else None, text, not (page and url)
            at = to + len(end)
        else:
            yield None, None, None, True
            at = content.find(end + start, at + 1)
            at = len(content) if at < 0 else at + len(end)


def read_warc(spark: SparkSession, path: str, tell_damaged: bool = False) -> DataFrame:
    """page_id, url and html of the records of write_warc(), and damaged if asked for; null parts come back empty, a null id as null.

    A task takes whole files, some 2 ** FILE_BITS records each, and walks them by Content-Length, so that bodies may hold
    anything, a record's first line too. Bytes that are no record give a row of nulls with damaged true and fail nothing; a URL
    with line breaks isn't valid and may give such a row. Empty folders and files give no rows.
    """

    def walk(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = list(_records(content.as_py()))
                columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "html", "damaged"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    found = files.mapInArrow(walk, "page_id long, url string, html string, damaged boolean")
    return found if tell_damaged else found.drop("damaged")


def leaves(pages: DataFrame) -> DataFrame:
    """idx, start, end, n, hash, digest: a leaf for each page id, with its records' number and its byte range in its WARC file.

    A leaf's digest is that of its records' SHA-256 digests added up in lanes of 60 bits, so repeated ids, however many, are
    summed before they are shuffled and in any order; its hash covers the range too. Records without an id are leaf -1.
    Record bytes don't leave their task.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("idx"), F.octet_length(record).cast("long").alias("size"), F.sha2(record, 256).alias("d"))
    lanes = [F.sum(F.conv(F.substring("d", 16 * i + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(_LANES)]
    leaf = hashed.groupBy("idx").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.concat_ws(":", *lanes).alias("lanes"))
    place = Window.partitionBy(F.shiftright("idx", FILE_BITS)).orderBy("idx")
    leaf = leaf.withColumn("end", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    leaf = leaf.withColumn("start", F.col("end") - F.col("size"))
    leaf = leaf.withColumn("digest", F.sha2(F.concat_ws("|", "n", "lanes"), 256))
    return leaf.select("idx", "start", "end", "n", F.sha2(F.concat_ws("|", "idx", "start", "end", "n", "lanes"), 256).alias("hash"), "digest")


def parents(level: DataFrame) -> DataFrame:
    """The next level: a node hashes its children's hashes and ranges in order; at most 2 ** BITS children each."""
    child = F.sort_array(F.collect_list(F.struct("idx", "start", "end", "hash")))
    up = level.groupBy(F.shiftright("idx", BITS).alias("up")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), child.alias("c"))
    whole = F.concat_ws("|", F.transform("c", lambda x: F.concat_ws(",", x["idx"], x["start"], x["end"], x["hash"])))
    return up.select(F.col("up").alias("idx"), "start", "end", "n", F.sha2(whole, 256).alias("hash"))


def tree(pages: DataFrame, levels: int) -> list[DataFrame]:
    """The levels from the leaves up, each written to the checkpoint folder: the leaves' hashing is done once."""
    out = [cut(leaves(pages))]
    for _ in range(levels):
        out.append(cut(parents(out[-1])))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that only one side has, or whose hash, and so whose range or content, differs."""
    mine = a.select("idx", *(F.col(c).alias(f"{c}_a") for c in a.columns if c != "idx"))
    theirs = b.select("idx", *(F.col(c).alias(f"{c}_b") for c in b.columns if c != "idx"))
    return mine.join(theirs, "idx", "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, kind, n_a, n_b, start_a, end_a, start_b, end_b, hash_a, hash_b: the leaves at which two replicas of pages differ.

    kind: missing (only primary has it), extra (only replica), changed (its records differ, wherever they are), moved (the very
    same records, but their range in the file starts elsewhere). The roots are compared first; below a node only the children of differing nodes
    are read. Equal replicas, and empty ones, give no rows. Columns beside page_id, url and html take no part.
    """
    reach = [x.agg(F.max(F.abs("page_id"))).first()[0] or 0 for x in (primary, replica)]
    levels = max(1, -(-max(int(max(reach)).bit_length(), 1) // BITS))
    a, b = tree(primary, levels), tree(replica, levels)
    bad = _differing(a[-1], b[-1]).select("idx")
    for mine, theirs in zip(a[-2::-1], b[-2::-1], strict=True):
        below = lambda level: level.join(bad.select(F.col("idx").alias("up")), F.shiftright(level["idx"], BITS) == F.col("up"), "left_semi")  # noqa: B023, E731
        found = cut(_differing(below(mine), below(theirs)))
        bad = found.select("idx")
    moved = (F.col("digest_a") == F.col("digest_b")) & (F.col("start_a") != F.col("start_b"))
    kind = F.when(F.col("n_b").isNull(), "missing").when(F.col("n_a").isNull(), "extra").when(moved, "moved").otherwise("changed")
    return found.select(F.col("idx").alias("page_id"), kind.alias("kind"), "n_a", "n_b", "start_a", "end_a", "start_b", "end_b", "hash_a", "hash_b")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted faults, by page_id: % 97 = 13 has another first character, % 1999 = 1234 is gone, % 3001 = 2345 is there twice."""
    base = pages.select("page_id", "url", "html").filter(~F.coalesce(F.col("page_id") % 1999 == 1234, F.lit(False)))
    html = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring(F.coalesce("html", F.lit("")), 2, 2**31 - 1))).otherwise(F.col("html"))
    copies = F.when(F.col("page_id") % 3001 == 2345, 2).otherwise(1)
    return base.withColumn("html", html).withColumn("copy_", F.explode(F.sequence(F.lit(1), copies))).drop("copy_")


def op4(pages: DataFrame) -> DataFrame:
    return audit(pages, damaged(pages)).drop("hash_a", "hash_b")


#: kind comes from what damaged() does to a page, not from comparing the replicas.
OP4_SQL = """
WITH sized AS (SELECT coalesce(page_id, -1) AS idx, coalesce(html, '') AS body, coalesce(CAST(page_id AS VARCHAR), '') AS id, coalesce(url, '') AS url, page_id FROM pages),
both_ AS (
  SELECT 'a' AS side, idx, body, id, url FROM sized
  UNION ALL SELECT 'b', idx, CASE WHEN page_id % 97 = 13 THEN '#' || substr(body, 2) ELSE body END, id, url FROM sized WHERE coalesce(page_id % 1999 <> 1234, true)
  UNION ALL SELECT 'b', idx, CASE WHEN page_id % 97 = 13 THEN '#' || substr(body, 2) ELSE body END, id, url FROM sized WHERE page_id % 3001 = 2345),
leaf AS (
  SELECT side, idx, count(*) AS n, string_agg(sha256(body || url), ',' ORDER BY sha256(body || url)) AS digest,
    CAST(sum(strlen('WARC/1.1_WARC-Type: resource_WARC-Record-ID: <urn:page:') + 2 + strlen(id) + strlen('>_WARC-Target-URI: ') + 1 + strlen(url)
      + strlen('_Content-Type: text/html_Content-Length: ') + 2 + strlen(CAST(strlen(body) AS VARCHAR)) + 4 + strlen(body) + 4) AS BIGINT) AS size
  FROM both_ GROUP BY side, idx),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY side, idx >> 12 ORDER BY idx) AS BIGINT) AS e FROM leaf),
j AS (SELECT coalesce(a.idx, b.idx) AS page_id, a.n AS n_a, b.n AS n_b, a.e - a.size AS start_a, a.e AS end_a, b.e - b.size AS start_b, b.e AS end_b,
    a.digest AS da, b.digest AS db
  FROM (SELECT * FROM placed WHERE side = 'a') a FULL JOIN (SELECT * FROM placed WHERE side = 'b') b ON a.idx = b.idx)
SELECT page_id, CASE WHEN n_b IS NULL THEN 'missing' WHEN n_a IS NULL THEN 'extra' WHEN page_id % 97 = 13 OR page_id % 3001 = 2345 THEN 'changed' ELSE 'moved' END AS kind,
  n_a, n_b, start_a, end_a, start_b, end_b
FROM j WHERE da IS DISTINCT FROM db OR start_a IS DISTINCT FROM start_b OR n_a IS DISTINCT FROM n_b
"""
