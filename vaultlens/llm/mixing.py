"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is exponential, ``-ln(u) / quality``, with ``u`` from a hash of
its id: smaller keys come first, and better documents have smaller keys more
often. A source takes whole epochs of its documents first; the rest of its
target goes to the documents in key order until their sizes fill it, the last
one in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultlens.llm.text import count_words, whole
from vaultlens.session import scratch_dir

#: Weights of the sources by code point, repeating; null comes last.
WEIGHTS = (3, 1, 2)
#: Words of the mix, in percent of all words.
TOTAL_PERCENT = 150
#: No source gives more than so many times its words.
MAX_EPOCHS = 2
#: Documents of a source that are put in order within one task.
BUCKET_DOCS = 2_000


def quality(text: Column) -> Column:
    """From 0.25 for a text of symbols to 1 for one without them."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>{}=_!]"))
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column, text: Column) -> Column:
    """Between 0 and 1, both excluded, from 52 bits of the MD5 of the id, or of the text of a row without id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), text)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, docs, place): places by code point from 0, null last.

    Sources are far fewer than documents. They are put in ranges first, so that
    only one count for each range passes through a single task.
    """
    spark = sizes.sparkSession
    folder = scratch_dir(spark, "sources")
    (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        .repartitionByRange(F.col("source").isNull(), F.col("source"))
        .withColumn("part", F.spark_partition_id())
        .write.parquet(folder)
    )
    sources = spark.read.parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sources.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return (
        sources.withColumn("n", F.row_number().over(within))
        .join(starts, "part")
        .select("source", "source_size", "docs", (F.col("start") + F.col("n") - 1).alias("place"))
    )


def targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(source, source_size, docs, target): shares by weight, capped, the excess shared again."""
    spark = sizes.sparkSession
    folder = scratch_dir(spark, "targets")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    (
        ranked_sources(sizes)
        .select(
            "source",
            "source_size",
            "docs",
            F.get(cycle, (F.col("place") % len(weights)).cast("int")).alias("weight"),
            (F.col("source_size") * max_epochs).alias("cap"),
        )
        .write.parquet(folder)
    )
    sources = spark.read.parquet(folder)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * total_percent / 100
    level, closed = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > F.col("cap")
        state = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(above, 1)).alias("closed"),
        ).first()
        if not state["open"] or state["closed"] == closed:
            break
        level, closed = (total - state["capped"]) / state["open"], state["closed"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return sources.select("source", "source_size", "docs", target.alias("target"))


def sizes_and_keys(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, key); ``key`` grows with the place in the order."""
    text = whole("text")
    return documents.select(
        "doc_id",
        "source",
        count_words(text).alias("size"),
        (-F.log(uniform(F.col("doc_id"), text)) / quality(text)).alias("key"),
    )


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """One row for each document: size, its source's size and target, words taken.

    A large source is cut into buckets of the key, each put in order on its own;
    the sums of earlier buckets are added. Null texts have size 0, a null source
    is one source, rows without id draw their number from their text, repeated rows
    are taken one after the other, an empty table gives none. Sizes and keys are written to the shared folder and read.
    """
    spark = documents.sparkSession
    folder = scratch_dir(spark, "sizes")
    sizes_and_keys(documents).write.parquet(folder)
    sizes = spark.read.parquet(folder)
    shares = targets(sizes, weights, total_percent, max_epochs).withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    )
    shares = shares.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    buckets = F.ceil(F.col("docs") / F.lit(BUCKET_DOCS))
    placed = (
        sizes.alias("d")
        .join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select(
            "doc_id", "d.source", "size", "key", "source_size", "target", "epochs", "rest",
            F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets).alias("bucket"),
        )
    )
    in_order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    inside = in_order.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    )
    left = F.col("rest") - F.col("start") - F.col("inner")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return (
        placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .alias("p")
        .join(
            starts.alias("b"),
            F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket")),
        )
        .select(
            "doc_id",
            "p.source",
            "size",
            "source_size",
            "target",
            F.col("epochs").cast("int").alias("epochs"),
            part.alias("part"),
            (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        )
    )


def sample(documents: DataFrame) -> DataFrame:
    """The mix itself: each document taken, with its epochs and words of the last part.

    Rows of equal id and source take the sum of their shares in turn; documents
    of which nothing is taken go.
    """
    taken = mix(documents).filter("taken > 0")
    return taken.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", "taken")
