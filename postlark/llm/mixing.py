"""Mix sources to target weights by hash thresholds, with DataFrame functions only.

Every document has a hash. A source's mix takes all its documents ``base`` times and
those with a hash under its threshold once more, so a larger budget takes a superset.
The threshold comes from histograms: words are summed by source and hash bucket, the
bucket in which the budget ends is found, and only that bucket is split further, until
it is a single hash value. Documents are never sorted.

Scale: a histogram row per source, bucket and task is all that is shuffled, so a source
with a third of all rows travels as its buckets. The table of sources goes through one
window; it has one short row per source. Joins carry no broadcast hint: the thresholds
are a stored table, which Spark broadcasts below its own size limit and otherwise joins
by shuffle, splitting skewed sources.

Defined cases: a NULL or empty text has size 0. A NULL source is a source, after all
others. A NULL ``doc_id`` is hashed by its text. Repeated rows share a hash and are taken
together. A source whose texts are all empty has target 0. An empty table gives no rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlark.llm.common import stored, unused, word_count

# Weights by the source's place, and how often all words are used.
WEIGHTS = (5, 2, 1)
BUDGET_HALVES = 3  # 150 %
MOST_REPEATS = 2

HASH_BITS = 60
LEVEL_BITS = 10


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of a document's id."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size, hash`` of every document."""
    return documents.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        document_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, base, budget`` of every source.

    Sources share the budget by weight. Filling the sources in the order of the level
    at which they are full gives what resharing the excess again and again ends at.
    All sums are whole numbers, so the result does not depend on their order.
    """
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1))
    full = reduce(lambda a, b: a * b, WEIGHTS)
    by_level = Window.orderBy("level", F.asc_nulls_last("source"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("most", MOST_REPEATS * F.col("source_size"))
        .withColumn("level", F.expr(f"most * ({full} div weight)"))
        .withColumn("twice_budget", BUDGET_HALVES * F.sum("source_size").over(every))
        .withColumn("filled", F.sum("most").over(by_level) - F.col("most"))
        .withColumn(
            "rest_weight",
            F.sum("weight").over(every) - F.sum("weight").over(by_level) + F.col("weight"),
        )
        .withColumn("left", F.col("twice_budget") - 2 * F.col("filled"))
        .withColumn("is_full", F.col("left") * F.col("weight") >= 2 * F.col("most") * F.col("rest_weight"))
    )
    first = F.min(F.when(~F.col("is_full"), F.struct("level", F.col("filled"), "left", "rest_weight")))
    share = (F.col("first.left") * F.col("weight")).cast("double") / (2 * F.col("first.rest_weight")).cast("double")
    target = F.when(
        F.col("first").isNull() | (F.col("level") < F.col("first.level")), F.col("most").cast("double")
    ).otherwise(F.least(share, F.col("most").cast("double")))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        sources.withColumn("first", first.over(every))
        .withColumn("target", target)
        .withColumn("base", base.cast("long"))
        .select(
            "source",
            "source_size",
            "target",
            "base",
            (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"),
        )
    )


def _same(left: DataFrame, right: DataFrame, column: str) -> Column:
    return left[column].eqNullSafe(right[column])


def thresholds(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, base, threshold`` of every source, stored."""
    state = stored(
        source_targets(sizes).withColumns(
            {"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "inside": F.col("source_size")}
        ),
        "mix-targets",
    )
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("hash", shift)
        keys = state.select(F.col("source").alias("of"), F.col("prefix").alias("within"))
        inside = sizes.join(
            keys,
            sizes["source"].eqNullSafe(keys["of"])
            & (F.shiftright("hash", shift + LEVEL_BITS) == keys["within"]),
        )
        histogram = inside.groupBy("of", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("of").orderBy("bucket")
        histogram = histogram.withColumn("below", F.sum("words").over(up_to) - F.col("words"))
        # The last bucket that starts within the budget is the one the budget ends in.
        started = histogram.join(state, histogram["of"].eqNullSafe(state["source"])).where(
            (F.col("before") + F.col("below") <= F.col("budget")) | (F.col("below") == 0)
        )
        last = started.groupBy("of").agg(F.max(F.struct("bucket", "below", "words")).alias("last"))
        state = stored(
            state.join(last, state["source"].eqNullSafe(last["of"]), "left").select(
                "source",
                "source_size",
                "target",
                "base",
                "budget",
                F.coalesce("last.bucket", F.lit(0).cast("long")).alias("prefix"),
                (F.col("before") + F.coalesce("last.below", F.lit(0))).alias("before"),
                F.coalesce("last.words", F.lit(0).cast("long")).alias("inside"),
            ),
            "mix-level",
        )
    # The boundary documents are taken if that ends nearer to the budget.
    short = F.col("budget") - F.col("before")
    over = F.col("before") + F.col("inside") - F.col("budget")
    return stored(
        state.select(
            "source",
            "source_size",
            "target",
            "base",
            (F.col("prefix") + F.when(over < short, 1).otherwise(0)).alias("threshold"),
        ),
        "mix-thresholds",
    )


def mix(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    sizes = stored(sized(documents), "mix-sizes")
    limits = thresholds(sizes)
    copies = F.col("base") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return sizes.join(limits, _same(sizes, limits, "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, all columns kept."""
    own = documents.columns
    limits_name, copy_name = unused("_mix_limits", own), unused("_mix_copy", own)
    limits = thresholds(stored(sized(documents), "mix-sizes")).select(
        F.struct(F.col("source").alias("of"), "base", "threshold").alias(limits_name)
    )
    same = documents["source"].eqNullSafe(F.col(f"{limits_name}.of"))
    joined = documents.join(limits, same)
    copies = F.col(f"{limits_name}.base") + F.when(
        document_hash(documents["doc_id"], documents["text"]) < F.col(f"{limits_name}.threshold"), 1
    ).otherwise(0)
    repeated = joined.withColumn(copy_name, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return repeated.select(*[documents[name] for name in own])
