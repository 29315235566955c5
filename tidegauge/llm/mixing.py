"""Mixing sources to target weights: whole blocks of words are apportioned by highest quotients, then chosen by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import whole_text, words_of
from tidegauge.session import cut

#: Weights by rank of source, repeating; words of a block; documents of a shard, about; how often a document may be taken.
WEIGHTS, BLOCK_WORDS, SHARD_DOCS, MOST, SEED = (5, 2, 1), 64, 20_000, 3, "mix"
#: Shards whose blocks one task hashes, about.
HASHED_SHARDS = 50
#: Names that plan() gives to columns, on the way too.
OWN = (
    "size", "source_size", "target", "taken", "passes_", "picks_", "shard_", "end_", "source_", "source_quota_", "cell_", "blocks_", "quota", "start_", "last_",
)


def seeded(*parts) -> Column:
    """A number below 2^60 from MD5, which DuckDB has too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source, null last by code point.

    Targets share the whole size by weight; what a source has beyond `most` times its size is shared again by weight. Sources
    fill up in order of size over weight, so whether one is full follows from those before it: a window over one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({
        "all_": F.sum("source_size").over(Window.partitionBy()), "weights_": F.sum("weight").over(Window.partitionBy()),
        "full_": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)), "gone_": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # The level if all sources before this one are full and none from here on is; right at the first that isn't full.
    level = (F.col("all_") - F.col("full_")) / (F.col("weights_") - F.col("gone_"))
    by = by.withColumns({"place_": F.row_number().over(up), "level_": level})
    open_ = F.when(most * F.col("source_size") < F.col("weight") * F.col("level_"), F.lit(None)).otherwise(F.struct("place_", "level_"))
    by = by.withColumn("first_", F.min(open_).over(Window.partitionBy()))
    is_full = F.coalesce(F.col("place_") < F.col("first_")["place_"], F.lit(True))
    share = F.when(is_full, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("first_")["level_"])
    return by.select("source", "source_size", share.cast("double").alias("target"))


def _level(seats: Column, up, group) -> Column:
    """The level at which the claims' weight_ times level sum up to `seats`, if those before this one in order `up` are full (at cap_) and none from here on is."""
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    full, gone = F.coalesce(F.sum("cap_").over(before), F.lit(0)), F.coalesce(F.sum("weight_").over(before), F.lit(0.0))
    return F.try_divide(seats - full, F.sum("weight_").over(group) - gone)


def apportion(claims: DataFrame, over: list[str], seats: str, weight: str, most: str, order: list[str]) -> DataFrame:
    """claims with quota: within each group `over`, the integer in `seats` dealt out by Sainte-Lague's highest quotients weight / (2 s + 1), no claim above `most`.

    Equal quotients go by `order`. Claims of no weight get no seats; where the others' caps are fewer than the seats, all are
    full. Only seats that could change hands are ranked. A claim's quota is its weight times some level, rounded and capped.
    Rounding adds or takes half a seat a claim at most, so that level lies between those at which the capped shares sum up to
    half a seat a claim less and more: seats below the one are had, seats beyond the other are not, and few lie between.
    """
    group = Window.partitionBy(*over) if over else Window.partitionBy()
    has = F.coalesce(F.col(weight) > 0, F.lit(False))
    out = claims.withColumns({"weight_": F.when(has, F.col(weight)).otherwise(0.0), "cap_": F.when(has, F.col(most)).otherwise(0).cast("long")})
    fill = [F.try_divide(F.col("cap_").cast("double"), "weight_").asc_nulls_first(), *order]
    up = group.orderBy(*fill)
    half = F.count("*").over(group) / 2 + 1
    levels = {"low_": _level(F.col(seats) - half, up, group), "high_": _level(F.col(seats) + half, up, group)}
    out = out.withColumns(levels)
    for name in levels:  # of the levels at claims that aren't full there, that of the first is right, and it is the highest
        out = out.withColumn(name, F.max(F.when((F.col("weight_") > 0) & (F.col("cap_") >= F.col("weight_") * F.col(name)), F.col(name))).over(group))
    bound = lambda level, more: F.greatest(F.lit(0), F.least(F.floor(F.col("weight_") * F.col(level)) + more, F.col("cap_"))).cast("long")
    out = out.withColumns({"base_": F.coalesce(bound("low_", -1), "cap_"), "top_": F.coalesce(bound("high_", 2), "cap_")})
    out = out.withColumn("left_", F.col(seats) - F.sum("base_").over(group))
    seat = F.explode_outer(F.when(F.col("top_") > F.col("base_"), F.sequence(F.col("base_"), F.col("top_") - 1)))
    ranked = out.withColumn("s_", seat).withColumn("q_", F.when(F.col("s_").isNotNull(), F.col("weight_") / (2 * F.col("s_") + 1)))
    won = ranked.withColumn("won_", (F.row_number().over(group.orderBy(F.col("q_").desc_nulls_last(), *order, "s_")) <= F.col("left_")) & F.col("s_").isNotNull())
    return won.groupBy(*claims.columns, "base_").agg(F.count_if("won_").alias("won_")).select(*claims.columns, (F.col("base_") + F.col("won_")).alias("quota"))


def _block_hash(seed: str, source: Column, shard: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(f"{seed}-block"), source, shard, block)


def plan(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, taken, passes_ (whole copies) and picks_ (array of the word ranges beyond those).

    A document goes to a shard by a seeded hash; the shards' number follows the corpus, so that a source of a third of all
    rows is spread like any other. In a shard the words of a source, in seeded order of documents, are cut to blocks. Blocks
    are apportioned to sources by their targets, then to the source's shards; in a shard each block is taken quota // blocks times,
    and those of the least seeded hashes once more, at most `most` times. Null texts have size 0 and are taken 0 times; a null source is a source.
    Rows of one doc_id are ordered by their text's hash. Very long texts are cut to blocks like others. An empty table gives an
    empty one. Columns of docs with clashing names give way.
    """
    docs = docs.drop(*OWN).withColumn("size", F.size(words_of(whole_text())).cast("long"))
    shards = docs.count() // shard_docs + 8
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(whole_text())
    docs = docs.withColumn("shard_", F.pmod(seeded(F.lit(seed), *key), F.lit(shards)))
    cells = cut(docs.groupBy("source", "shard_").agg(F.sum("size").alias("size")))
    cells = cells.withColumn("blocks_", F.ceil(F.col("size") / block_words).cast("long"))
    by = targets(cells, weights, most).join(cells.groupBy(F.col("source").alias("source_")).agg(F.sum("blocks_").alias("n_")), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    by = by.withColumn("claim_", F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)) * F.col("n_"))
    by = by.withColumns({"seats_": F.round(F.sum("claim_").over(Window.partitionBy())).cast("long"), "most_": most * F.col("n_")})
    by = apportion(by, [], "seats_", "claim_", "most_", [F.col("source").isNull(), F.col("source")]).withColumnRenamed("quota", "source_quota_")
    by = by.select(F.col("source").alias("source_"), "source_size", "target", "source_quota_")
    cells = cells.join(by, F.col("source").eqNullSafe(F.col("source_"))).withColumns({"most_": most * F.col("blocks_"), "weight_": F.col("blocks_").cast("double")})
    quotas = apportion(cells, ["source"], "source_quota_", "weight_", "most_", [F.col("shard_")])
    quotas = quotas.select("source_", F.col("shard_").alias("cell_"), "source_size", "target", F.greatest("blocks_", F.lit(1)).alias("blocks_"), "quota")
    # The hash of the last block of a cell that is taken once more: those of its blocks, a bounded number, are sorted in its row.
    quotas = quotas.repartition(int(shards // HASHED_SHARDS + 8), "source_", "cell_")
    rest = (F.col("quota") % F.col("blocks_")).cast("int")
    hashes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1), lambda b: _block_hash(seed, F.col("source_"), F.col("cell_"), b))
    quotas = quotas.withColumn("last_", F.when(rest > 0, F.get(F.sort_array(hashes), rest - 1)))
    order = Window.partitionBy("source", "shard_").orderBy(seeded(F.lit(seed + "-order"), *key), *key).rowsBetween(Window.unboundedPreceding, 0)
    out = docs.withColumn("end_", F.sum("size").over(order))
    out = out.join(quotas, F.col("source").eqNullSafe(F.col("source_")) & (F.col("shard_") == F.col("cell_")))
    start, end, passes = F.col("end_") - F.col("size"), F.col("end_"), F.floor(F.col("quota") / F.col("blocks_"))
    out = out.withColumns({"start_": start, "passes_": passes})
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start_") / block_words), F.floor((F.col("end_") - 1) / block_words))).otherwise(F.array().cast("array<long>"))
    chosen = F.filter(numbers, lambda b: _block_hash(seed, F.col("source_"), F.col("cell_"), b) <= F.col("last_"))
    pick = lambda b: F.struct(F.greatest(b * block_words, F.col("start_")).alias("a"), F.least((b + 1) * block_words, F.col("end_")).alias("b"))
    out = out.withColumn("picks_", F.transform(chosen, pick))
    out = out.withColumn("picks_", F.transform("picks_", lambda p: F.struct((p["a"] - F.col("start_")).alias("a"), (p["b"] - F.col("start_")).alias("b"))))
    extra = F.aggregate("picks_", F.lit(0).cast("long"), lambda n, p: n + p["b"] - p["a"])
    out = out.withColumn("taken", F.col("passes_") * F.col("size") + extra)
    return out.drop("source_", "cell_", "end_", "start_", "last_", "blocks_", "quota", "shard_")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus in the columns of docs: a row for each whole copy of a document, and one for each chosen range of its
    words (space-joined) beyond those; n_chars, where docs has it, follows the text. Documents taken 0 times are left out."""
    out = plan(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row_")), **settings)
    words = words_of(whole_text())
    piece = lambda p: F.array_join(F.slice(F.col("words_"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), " ")
    out = out.withColumn("words_", F.when(F.size("picks_") > 0, words))
    texts = F.concat(F.array_repeat("text", F.col("passes_").cast("int")), F.coalesce(F.transform("picks_", piece), F.array().cast("array<string>")))
    out = out.filter(F.col("taken") > 0).withColumn("texts_", texts).select("row_", F.explode_outer("texts_").alias("text_"))
    own = {"text": F.col("text_"), "n_chars": F.length("text_")}
    return out.select(*(own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col(f"row_.{c}") for c in docs.columns))


def op8(docs: DataFrame) -> DataFrame:
    return plan(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
