"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio between trusted documents and the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import BLANKS, free_name, packed, spaced, whole_text, words_of
from tidegauge.session import cut

SYMBOLS = "#*$%&|<>"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "gram_llr", "kept")
#: Production parameters. Buckets: one for each BUCKET_BYTES bytes of the corpus, LEAST_BUCKETS at least; up to MOST_LITERAL of
#: them are held as a constant (some 20 MB at most), more of them as a table. The labelled samples are the only bounded ones: the
#: SAMPLE_DOCS documents of least hash of each of three sets, trusted to count, trusted to hold out, rejected to hold out.
LEAST_BUCKETS, BUCKET_BYTES, MOST_LITERAL, SAMPLE_DOCS, SMOOTHING, SEED = 10_000, 200_000, 1 << 20, 20_000, 1.0, 17
#: Log ratios are held in whole parts of this size.
UNIT = 1 << 24
#: The threshold lies midway between this quantile of the held-out trusted and its counterpart of the held-out rejected, and never above the former.
TAIL = 0.02


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_buckets(hashes: Column, n_buckets: int) -> Column:
    """Buckets of all one- and two-word grams of a text, repeats included, from the hashes of its words."""
    pairs = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    two = F.transform(pairs, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))
    return F.transform(F.concat(hashes, two), lambda h: F.pmod(h, F.lit(n_buckets)).cast("int"))


def bucket_number(docs: DataFrame) -> int:
    """Buckets for the grams of docs: their number grows with the corpus, so that a bucket's share of it doesn't."""
    return max(LEAST_BUCKETS, (docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0) // BUCKET_BYTES)


def samples(labels: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """labelled_id and kind of the labelled documents in use, `most` of each kind: count and hold for trusted ones (quality 1), by a hash of doc_id; bad for the others."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min("quality").alias("q"))
    order = F.xxhash64("labelled_id", F.lit(SEED))
    named = named.select("labelled_id", F.when(F.col("q") != 1, "bad").when(F.pmod(order, F.lit(2)) == 0, "count").otherwise("hold").alias("kind"), order.alias("order_"))
    parts = [named.filter(F.col("kind") == k).orderBy("order_", "labelled_id").limit(most) for k in ("count", "hold", "bad")]
    return parts[0].union(parts[1]).union(parts[2]).select("labelled_id", "kind")


def gram_log_ratios(docs: DataFrame, trusted: DataFrame, n_buckets: int, smoothing: float = SMOOTHING) -> DataFrame:
    """bucket and ratio, log(P(bucket | trusted) / P(bucket | raw)) in whole UNITths, of each bucket that docs has.

    Whole numbers, so that a text's sum is the same in whatever order its grams are added up.

    Raw counts cover every document; trusted are those whose doc_id is among labelled_id, a set of bounded size. The counts
    meet per bucket before they are shuffled. Without trusted documents all ratios are 0.
    """
    seen = docs.select("doc_id", word_hashes(words_of(whole_text())).alias("hashes"))
    seen = seen.select("doc_id", gram_buckets(F.col("hashes"), n_buckets).alias("grams"))
    seen = seen.join(F.broadcast(trusted), seen["doc_id"] == trusted["labelled_id"], "left")
    # explode() would infer a filter on grams, and pushing that down would split the text anew for each word.
    counts = cut(
        seen.select(F.col("labelled_id").isNotNull().alias("t"), F.explode_outer("grams").alias("bucket")).filter(F.col("bucket").isNotNull())
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("t").alias("target"))
    )
    n_raw, n_target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not n_target:
        return counts.select("bucket", F.lit(0).cast("long").alias("ratio"))
    more = smoothing * n_buckets
    ratio = F.log((F.col("target") + smoothing) / (n_target + more)) - F.log((F.col("raw") + smoothing) / (n_raw + more))
    return counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("ratio"))


def with_llr(docs: DataFrame, ratios: DataFrame, n_buckets: int, literal: bool) -> DataFrame:
    """docs, which has hashes_, with gram_llr, the mean ratio of its text's grams; 0 for a text without words.

    literal: the ratios are a constant, and nothing is shuffled. Else grams meet the table of ratios in a join, by the text's
    digest, so that equal texts are one; a text's mean is the same however often it comes.
    """
    out = docs.withColumn("grams_", gram_buckets(F.col("hashes_"), n_buckets))
    if literal:
        import numpy as np

        found, dense = ratios.toArrow(), np.zeros(n_buckets, np.int64)
        dense[found["bucket"].to_numpy()] = found["ratio"].to_numpy()
        held = packed(dense.tolist(), "bigint")
        total = F.aggregate("grams_", F.lit(0).cast("long"), lambda a, b: a + F.get(held, b))
        return out.withColumn("gram_llr", F.coalesce(F.try_divide(total, F.size("grams_") * F.lit(float(UNIT))), F.lit(0.0))).drop("grams_")
    out = out.withColumn("digest_", F.md5(F.concat_ws(",", "hashes_")))
    grams = out.select("digest_", F.explode_outer("grams_").alias("bucket")).filter(F.col("bucket").isNotNull())
    means = grams.join(ratios, "bucket").groupBy("digest_").agg((F.sum("ratio") / (F.count("*") * F.lit(float(UNIT)))).alias("gram_llr"))
    return out.join(means, "digest_", "left").withColumn("gram_llr", F.coalesce("gram_llr", F.lit(0.0))).drop("grams_", "digest_")


def fitted_threshold(scored: DataFrame, tail: float = TAIL) -> float:
    """From kind, base_failed and gram_llr of the held-out documents, those that a base rule rejects set aside: midway between the tails of both kinds, but not above that of the trusted, so that few of those go where the kinds overlap; minus infinity, so that the base rules decide, where a kind has none."""
    of = lambda kind: F.when(~F.col("base_failed") & (F.col("kind") == kind), F.col("gram_llr"))
    good, bad = scored.agg(F.percentile(of("hold"), tail), F.percentile(of("bad"), 1 - tail)).first()
    return float("-inf") if good is None or bad is None else min(good, (good + bad) / 2)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and the array hashes_ of its words' hashes.

    Null and empty texts have no words: all counts 0 (symbols too), base_failed true. Each step is a projection of its own,
    so that no array is worked out again inside a lambda; nothing is shuffled.
    """
    lines = F.filter(F.split("text_", "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    plain = F.col("text_")
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    out = docs.withColumn("text_", whole_text())
    out = out.withColumns({"spaced_": spaced(F.col("text_")), "lines_": lines})
    out = out.withColumns({
        "hashes_": word_hashes(F.array_remove(F.split("spaced_", " "), "")),
        "word_chars": F.length(F.replace("spaced_", F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.length("text_") - F.length(plain)).cast("long"),
    })
    hashes = F.col("hashes_")
    out = out.withColumns({
        "windows_": F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))),
        "n_words": F.size(hashes).cast("long"),
        "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
    })
    # Only texts in which some window comes again need their windows in order.
    repeats = F.size(F.array_distinct("windows_")) < F.size("windows_")
    out = out.withColumn("order_", F.when(repeats, F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    order = F.col("order_")
    hits = F.transform(order, lambda x, k: F.when((F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"]), x["i"]))
    out = out.withColumn("hits_", F.sort_array(F.filter(hits, lambda x: x.isNotNull())))
    starts = F.col("hits_")
    covered = F.transform(starts, lambda x, k: F.coalesce(F.least(F.lit(3), x - F.get(starts, k - 1)), F.lit(3)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("text_", "spaced_", "lines_", "windows_", "order_", "hits_")


def judge(docs: DataFrame, labels: DataFrame, n_buckets: int | None = None, sample_docs: int = SAMPLE_DOCS, smoothing: float = SMOOTHING, most_literal: int = MOST_LITERAL) -> DataFrame:
    """docs with the base counts, base_failed, gram_llr and kept.

    gram_llr is the mean log ratio over the text's one- and two-word grams (0 for a text without words): how much likelier
    the trusted multinomial makes it than the raw one, whatever its length. Half of the trusted documents give the ratios;
    the threshold is fitted to the other half and to the rejected ones, which the ratios haven't seen. kept: not base_failed
    and gram_llr at or above the threshold, the same rule for every document. Columns of docs with clashing names give way;
    repeated rows are judged alike, and an empty table gives an empty one.
    """
    buckets = n_buckets or bucket_number(docs)
    named = cut(samples(labels, sample_docs))
    ratios = gram_log_ratios(docs, named.filter("kind = 'count'").select("labelled_id"), buckets, smoothing)
    literal = buckets <= most_literal
    held = docs.select("doc_id", "text").join(F.broadcast(named.filter("kind <> 'count'")), F.col("doc_id") == F.col("labelled_id"))
    threshold = fitted_threshold(with_llr(base_counts(held), ratios, buckets, literal))
    out = with_llr(base_counts(docs), ratios, buckets, literal)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("gram_llr") >= threshold)).drop("hashes_")
    # Through a generator: a filter on a result would be pushed below the projections, and each array worked out anew for every word.
    held = free_name(out, "judged_")
    return out.select(*(c for c in out.columns if c not in RESULTS), F.explode_outer(F.array(F.struct(*RESULTS))).alias(held)).select("*", f"{held}.*").drop(held)


def accepted(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs."""
    carried = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row_"))
    return judge(carried, labels, **settings).filter("kept").select("row_.*")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), labels).drop("text")
