"""Filter interaction audit: every order of some filters, by walking the trie of orders depth first and working each set of applied filters out once."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidegauge.llm.common import UPPER, whole_text, words_of
from tidegauge.session import scratch

#: The filters' thresholds: least words; least distinct words and most capitals, in per cent; characters that fail a text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
FILTERS = "ABCDE"


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: part, A to E (true: the document fails that filter), good, toxic.

    A: too few words; B: too few distinct words; C: too many capitals; D: a symbol; E: the same text under a smaller doc_id,
    wherever in the table. Null and empty texts are alike: they fail A, and E but for the first. A null doc_id is larger than
    any other; rows alike in doc_id and text don't fail each other. A null source is the empty part. labels may hold a doc_id
    several times: it is good or toxic if any of its rows says so. Only digests of texts are shuffled: the first row of each
    text is found by a grouped minimum and met again by digest and doc_id together, so that the copies of one text, however
    many, spread over all tasks.
    """
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole_text().alias("text"))
    own = own.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    slim = own.select(
        "part", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.unhex(F.sha2("text", 256)).alias("key"),
        (F.col("n") < LEAST_WORDS).alias("A"), (100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * F.col("n")).alias("B"),
        (100 * _count_of(F.col("text"), UPPER) > MOST_CAPITALS * F.length("text")).alias("C"), (_count_of(F.col("text"), SYMBOLS) > 0).alias("D"),
    )
    first = slim.groupBy("key").agg(F.min(F.struct("none", "id")).alias("at")).select("key", "at.none", "at.id", F.lit(False).alias("E"))
    slim = slim.join(first, ["key", "none", "id"], "left").withColumn("E", F.coalesce("E", F.lit(True)))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without doc_id have no label; their digest spreads them over the join's tasks.
    slim = slim.withColumn("salt", F.when(F.col("none"), F.xxhash64("key")).otherwise(0)).withColumn("none_", F.col("none"))
    found = slim.join(known.withColumns({"salt": F.lit(0).cast("long"), "none_": F.lit(False)}), ["id", "salt", "none_"], "left")
    return found.select("part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(judged: DataFrame, filters: str) -> DataFrame:
    """A row for each part, order of the filters and step: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    judged: part, a boolean column named by each letter of filters, good, toxic. It is written once. The trie of all orders is
    walked depth first; a node is the set of filters applied so far, whatever their order, and is worked out the first time it
    is reached: its survivors are filtered from those of the node above, persisted while nodes below it read them, and what
    each further filter removes from them is counted in one pass. So of n filters 2^n nodes and n * 2^(n-1) edges are run in
    place of n! orders, and n - 1 survivor tables are held at most. A lost executor's survivors are filtered again from the
    written table. Counts of edges are written too, a few rows a part, so nothing of a part's size reaches the driver.

    Steps without survivors have zeros; an empty table gives no rows. Sums are exact.
    """
    spark, folder, done = judged.sparkSession, scratch(judged.sparkSession, "audit"), set()
    judged.write.parquet(f"{folder}/verdicts")

    def walk(state: str, survivors: DataFrame) -> None:
        done.add(state)
        rest = [x for x in filters if x not in state]
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK) if len(rest) > 1 else survivors
        gone = lambda x: [F.count_if(x).alias("removed"), F.count_if(x & F.col("good")).alias("good_lost"), F.count_if(x & F.col("toxic")).alias("toxic_lost")]
        edges = [F.struct(F.lit(f"{state}>{x}").alias("edge"), F.struct(F.count("*").alias("alive"), *gone(F.col(x))).alias("counts")) for x in rest]
        survivors.groupBy("part").agg(F.array(*edges).alias("edges")).select("part", F.inline("edges")).write.mode("append").parquet(f"{folder}/edges")
        for x in rest:
            below = "".join(sorted(state + x))
            if below not in done and len(rest) > 1:
                walk(below, survivors.filter(~F.col(x)))
        if len(rest) > 1:
            survivors.unpersist()

    walk("", spark.read.parquet(f"{folder}/verdicts"))
    parts = spark.read.schema("part string, edge string, counts struct<alive: long, removed: long, good_lost: long, toxic_lost: long>").parquet(f"{folder}/edges")
    parts = parts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("edge", "counts"))).alias("edges"))
    sets = {x: ["".join(s) for s in {tuple(sorted(p[: p.index(x)])) for p in permutations(filters)}] for x in filters}
    n, zero = len(filters), F.lit(0).cast("long")
    at = lambda edge, field: F.coalesce(F.try_element_at("edges", edge)[field], zero)
    orders_of = lambda s: factorial(len(s)) * factorial(n - 1 - len(s))
    shapley = F.create_map(*(c for x in filters for c in (F.lit(x), sum((at(F.lit(f"{s}>{x}"), "removed") * orders_of(s) for s in sorted(sets[x])), zero))))
    steps = [{"filter_order": "".join(p), "step": i + 1, "filter": p[i], "state": "".join(sorted(p[:i])), "others": "".join(sorted(set(filters) - {p[i]}))} for p in permutations(filters) for i in range(n)]
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, filter: string, state: string, others: string>>")
    out = parts.withColumn("shapley_", shapley).select("part", "edges", "shapley_", F.inline(literal))
    here, only, first = F.concat("state", F.lit(">"), "filter"), F.concat("others", F.lit(">"), "filter"), F.concat(F.lit(">"), "filter")
    return out.select(
        "part", "filter_order", "step", "filter", (at(here, "alive") - at(here, "removed")).alias("kept"), at(here, "removed").alias("removed"), (at(first, "removed") - at(here, "removed")).alias("redundant"),
        at(only, "removed").alias("unique_fails"), at(here, "good_lost").alias("good_lost"), at(here, "toxic_lost").alias("toxic_lost"), F.element_at("shapley_", F.col("filter")).alias("shapley"),
    )


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(verdicts(docs, labels), FILTERS)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ORDERS = ", ".join(f"('{''.join(p)}', {i + 1}, '{p[i]}', '{''.join(sorted(p[:i]))}')" for p in permutations(FILTERS) for i in range(len(FILTERS)))
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
own AS (SELECT part, len(words) < 50 AS A, 100 * len(list_distinct(words)) < 65 * len(words) AS B, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
  doc_id > min(doc_id) OVER (PARTITION BY t) AS E, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM d LEFT JOIN labels USING (doc_id)),
classes AS (SELECT part, good, toxic, (CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END || CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM own GROUP BY ALL),
steps(filter_order, step, filter, state) AS (VALUES {_ORDERS}),
live AS (SELECT part, filter_order, step, filter, n, good, toxic, fails, contains(fails, filter) AS fail, len(list_intersect(string_split(fails, ''), string_split(state, ''))) = 0 OR fails = '' OR state = '' AS alive FROM classes CROSS JOIN steps),
found AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (alive AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (alive AND fail), 0) AS removed, coalesce(sum(n) FILTER (fail AND NOT alive), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails, coalesce(sum(n) FILTER (alive AND fail AND good), 0) AS good_lost, coalesce(sum(n) FILTER (alive AND fail AND toxic), 0) AS toxic_lost FROM live GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM found"""
