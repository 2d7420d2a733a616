"""License scans: an exact set-similarity join of text blocks with license notices.

A block is a window of ``BLOCK_WORDS`` words; blocks start every half window, so
a notice of at most half a window lies whole in one. A block matches a notice
when it holds enough of the notice's distinct words. Words of both sides are put
in one global order, rarest first by the number of documents that have them; a
pair that overlaps in ``o`` words must share a word among the first
``size - o + 1`` of each side, at positions that leave room for the rest. Words
of no notice cannot overlap and are left out of the blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultlens.llm.text import NOT_ALPHANUMERIC, ascii_lower, let, whole, words
from vaultlens.session import scratch_dir

#: Phrases whose words in a row give a label.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Opening words of public license notices, at most half a block each.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]

BLOCK_WORDS = 64
#: Share of a notice's distinct words that a block must hold, in percent.
MIN_PERCENT = 80


def needed(size: int, percent: int) -> int:
    """Words of a notice that make the percentage, rounded up."""
    return -(-size * percent // 100)


def lowered(text: Column) -> Column:
    """Lower case that leaves which words are ASCII as A-Z alone would.

    Two letters outside ASCII turn into ASCII ones in ``lower``; texts with
    these go through the slower mapping of A to Z.
    """
    special = text.contains("K") | text.contains("İ")
    return F.when(special, ascii_lower(text)).otherwise(F.lower(text))


def _literal(tokens: list[str]) -> Column:
    return F.array(*(F.lit(token) for token in tokens))


def _holds(present: Column, tokens: list[str], least: int) -> Column:
    return F.size(F.array_intersect(present, _literal(tokens))) >= least


def features(
    documents: DataFrame, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], percent: int
) -> DataFrame:
    """One row for each document: phrase places, notice words, and blocks.

    Blocks are formed only where the whole document holds enough words of some
    notice; no block of another document can.
    """
    sets = [sorted(set(notice.split())) for _, notice in notices]
    vocabulary = sorted({word for _, text in [*phrases, *notices] for word in text.split()})

    def places(found: Column, phrase: list[str]) -> Column:
        fits = lambda i: reduce(
            lambda x, y: x & y, (F.get(found, i + k) == word for k, word in enumerate(phrase))
        )
        return F.filter(F.sequence(F.lit(0), F.size(found) - len(phrase)), fits)

    def blocks(found: Column) -> Column:
        starts = F.sequence(
            F.lit(0), F.greatest(F.lit(0), F.size(found) - BLOCK_WORDS // 2 - 1), F.lit(BLOCK_WORDS // 2)
        )
        return F.transform(
            starts, lambda s: F.array_intersect(F.slice(found, s + 1, BLOCK_WORDS), _literal(vocabulary))
        )

    def measured(found: Column, present: Column) -> Column:
        base = [
            F.when(_holds(present, list(set(p.split())), len(set(p.split()))), places(found, p.split()))
            .otherwise(F.array().cast("array<int>"))
            .alias(f"p{n}")
            for n, (_, p) in enumerate(phrases)
        ]
        any_notice = reduce(
            lambda x, y: x | y, (_holds(present, tokens, needed(len(tokens), percent)) for tokens in sets)
        )
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            present.alias("present"),
            *base,
            F.when(any_notice, blocks(found)).alias("blocks"),
        )

    found = words(lowered(whole("text")), NOT_ALPHANUMERIC)
    m = let(found, lambda w: let(F.array_intersect(w, _literal(vocabulary)), lambda p: measured(w, p)))
    names = [f"p{n}" for n in range(len(phrases))]
    all_places = F.flatten(F.array(*(F.col(f"m.{name}") for name in names)))
    labels = F.array_distinct(
        F.flatten(
            F.array(
                *(
                    F.when(F.size(f"m.{name}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
                    for name, (label, _) in zip(names, phrases, strict=True)
                )
            )
        )
    )
    return documents.select("doc_id", m.alias("m")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "m.n_words",
        "m.present",
        "m.blocks",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        labels.alias("base"),
    )


def matches(measured: DataFrame, notices: list[tuple[str, str]], percent: int) -> DataFrame:
    """(row, block, notice, label, containment) of every pair above the threshold."""
    spark = measured.sparkSession
    frequency = (
        measured.select(F.explode("present").alias("token")).groupBy("token").agg(F.count("*").alias("docs"))
    )
    sides = spark.createDataFrame(
        [
            (n, label, sorted(set(text.split())), needed(len(set(text.split())), percent))
            for n, (label, text) in enumerate(notices)
        ],
        "notice int, label string, tokens array<string>, least int",
    )
    blocks = (
        measured.select("row", F.posexplode("blocks").alias("block", "tokens"))
        .filter(F.size("tokens") > 0)
        .dropDuplicates(["row", "tokens"])
    )

    def ordered(frame: DataFrame, *keys: str) -> DataFrame:
        rank = Window.partitionBy(*keys).orderBy(F.coalesce("docs", F.lit(0)), "token")
        return (
            frame.select("*", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
            .join(frequency, "token", "left")
            .withColumn("at", F.row_number().over(rank))
            .drop("docs")
        )

    prefix = ordered(sides, "notice").filter(F.col("at") <= F.col("size") - F.col("least") + 1)
    pairs = (
        ordered(blocks, "row", "block")
        .alias("b")
        .join(prefix.alias("n"), "token")
        .filter(F.col("b.size") >= F.col("least"))
        .filter(F.col("b.at") <= F.col("b.size") - F.col("least") + 1)
        .filter(
            1 + F.least(F.col("b.size") - F.col("b.at"), F.col("n.size") - F.col("n.at")) >= F.col("least")
        )
    )
    overlap = F.size(F.array_intersect("b.tokens", "n.tokens"))
    return (
        pairs.filter(overlap >= F.col("least"))
        .select("row", "block", "notice", "label", (overlap / F.col("n.size")).alias("containment"))
        .distinct()
    )


def scan(
    documents: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    percent: int = MIN_PERCENT,
) -> DataFrame:
    """Phrases and notices of each document.

    ``score`` is 1 with a phrase, else the largest containment of a notice,
    else 0. Null and empty texts have no words and no labels; repeated rows give
    repeated rows, an empty table none. Long texts have as many blocks as they
    need. The pass over the texts is written to the shared folder and read.
    """
    if any(len(text.split()) > BLOCK_WORDS // 2 for _, text in notices):
        raise ValueError(f"a notice may have {BLOCK_WORDS // 2} words at most")
    spark = documents.sparkSession
    folder = scratch_dir(spark, "licenses")
    features(documents, phrases, notices, percent).write.parquet(folder)
    measured = spark.read.parquet(folder)
    found = (
        matches(measured, notices, percent)
        .groupBy("row")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    )
    none = F.array().cast("array<string>")
    return measured.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0))
        .otherwise(F.coalesce("containment", F.lit(0.0)))
        .alias("score"),
    )
