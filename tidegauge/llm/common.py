"""What the corpus operators share: words, checkpoints and packed constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import cut

#: The six ASCII blanks that separate words, as characters and as a Java pattern.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows alike that one record stands for at most while they are numbered; rows alike that need no numbers; keys that are broadcast at most.
CHUNK, FEW, MOST_KEYS = 4096, 64, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spaced(text: Column) -> Column:
    """The text with each blank turned into a space."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """Array of the runs of non-blank characters; no words: an empty array. Splitting at a literal space needs no regex."""
    return F.array_remove(F.split(spaced(text), " "), "")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def packed(values, kind: str) -> Column:
    """A constant array built from one string literal, which Catalyst folds to a single literal."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df with a column that numbers rows alike in all columns from 0, whatever the partitions and the order of the input.

    Rows alike are counted before they are shuffled. Counts above CHUNK are dealt to tasks in chunks before they become rows
    again, so no task makes all the rows of one hot record.
    """
    n, chunk = free_name(df, "n_"), free_name(df, "chunk_")
    counted = df.groupBy(*df.columns).agg(F.count("*").alias(n))
    zero, last = F.lit(0).cast("long"), F.col(n) - 1
    few = counted.filter(F.col(n) <= CHUNK).withColumn(column, F.explode(F.sequence(zero, last)))
    many = counted.filter(F.col(n) > CHUNK).withColumn(chunk, F.explode(F.sequence(zero, F.floor(last / CHUNK)))).repartition(*df.columns, chunk)
    many = many.withColumn(column, F.explode(F.sequence(F.col(chunk) * CHUNK, F.least(last, F.col(chunk) * CHUNK + (CHUNK - 1)))))
    return few.select(*df.columns, column).unionByName(many.select(*df.columns, column))


def spread(df: DataFrame, column: str) -> DataFrame:
    """df with a column that tells rows alike in all columns apart where there are more than FEW of them: a hash that takes it in
    spreads them, however many. It doesn't depend on partitions or the order of the input.

    Only hashes of rows are counted for all of df. Rows whose hash comes often are numbered(), which counts them before they
    are shuffled; the others pass as they are. The hashes that come often are broadcast while they are MOST_KEYS at most (0.8 MB).
    """
    key, n = free_name(df, "key_"), free_name(df, "n_")
    keyed = df.withColumn(key, F.xxhash64(*df.columns))
    hot = cut(keyed.groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) > FEW).select(key))
    keys = hot.limit(MOST_KEYS + 1).count()
    if not keys:
        return df.withColumn(column, F.lit(0).cast("long"))
    small = F.broadcast(hot) if keys <= MOST_KEYS else hot
    few = keyed.join(small, key, "left_anti").withColumn(column, F.lit(0).cast("long"))
    many = numbered(keyed.join(small, key, "left_semi").drop(key), column)
    return few.select(*df.columns, column).unionByName(many)
