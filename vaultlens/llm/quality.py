"""Quality rules: repeated lines across the documents of a host.

Lines are normalised and hashed; a line that more distinct documents of its host
hold than the limit is removed everywhere but in the host's first document, and
documents that lose too much of their words by it are rejected. The limit is a
count, lower for long lines, so it is the same in a host of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.text import SPACE, let, whole, words
from vaultlens.session import scratch_dir

#: Rules on one document.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: A line is above the limit beyond so many distinct documents of its host, a line
#: of so many words or more already beyond the smaller number.
MIN_LINE_DOCS = 20
LONG_LINE_DOCS = 10
LONG_LINE_WORDS = 20
#: Share of the host's documents that the SQL of the registered query asks for besides.
MAX_LINE_PERCENT = 10
#: A document is depleted when fewer of its words than this share are left.
MIN_LEFT_PERCENT = 30


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside windows of words that occur twice or more in the array.

    Windows are compared by 64-bit hashes of their words.
    """

    def covered(starts: Column) -> Column:
        steps = F.zip_with(
            starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(window), b - a)
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def starts_of(ordered: Column) -> Column:
        pairs = F.zip_with(
            ordered,
            F.slice(ordered, 2, F.size(ordered)),
            lambda a, b: F.when(a["hash"] == b["hash"], F.array(a["at"], b["at"])),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

    def by_windows(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(F.sort_array(placed), starts_of), covered)
        )

    def windows(hashed: Column) -> Column:
        return F.transform(
            F.slice(hashed, 1, F.size(hashed) - (window - 1)),
            lambda h, i: F.xxhash64(h, *(F.get(hashed, i + n) for n in range(1, window))),
        )

    return F.when(F.size(found) < window + 1, F.lit(0).cast("long")).otherwise(
        let(let(F.transform(found, lambda word: F.xxhash64(word)), windows), by_windows)
    )


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case with single blanks; null without a word."""
    normal = F.lower(F.trim(F.regexp_replace(line, f"{SPACE}+", " ")))
    return F.when(normal != "", F.xxhash64(normal))


def content_hash(text: Column) -> Column:
    return F.xxhash64(text)


def features(documents: DataFrame) -> DataFrame:
    """One row for each document: what the rules need, without its text."""
    text = whole("text")

    def of_words(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"), repeated_words(found).alias("n_repeat_words")
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.transform(
                lines, lambda line: F.struct(line_hash(line).alias("hash"), F.size(words(line)).alias("words"))
            ).alias("lines"),
        )

    with_a_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return documents.select(
        "doc_id",
        "source",
        content_hash(text).alias("content"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(words(text), of_words).alias("w"),
        let(with_a_word, of_lines).alias("l"),
    ).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "source",
        "content",
        "w.n_words",
        "word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.n_repeat_words",
        "l.lines",
    )


def frequent_lines(
    measured: DataFrame,
    min_docs: int = MIN_LINE_DOCS,
    max_percent: int | None = None,
    long_docs: int = LONG_LINE_DOCS,
) -> DataFrame:
    """(source, hash, n_docs, first_doc: id and content) of the lines above the limits of their host.

    Exact copies of a document count as one. ``first_doc`` has the smallest id among
    the documents with the line. Where none has an id, it is the text of the smallest
    hash, so one text keeps the line. With ``max_percent`` a line must also be
    in more than this share of the host's documents.
    """
    distinct = measured.groupBy("source", "content").agg(
        F.first(F.array_distinct("lines")).alias("lines"), F.min("doc_id").alias("doc_id")
    )
    limit = F.when(F.col("words") >= LONG_LINE_WORDS, long_docs).otherwise(min_docs)
    no_id = F.col("doc_id").isNull()
    place = F.struct(no_id.alias("no_id"), "doc_id", F.when(no_id, F.col("content")).alias("content")).alias("doc")
    lines = (
        distinct.select("source", place, F.explode("lines").alias("line"))
        .groupBy("source", F.col("line.hash").alias("hash"))
        .agg(F.count("*").alias("n_docs"), F.min("doc").alias("first_doc"), F.max("line.words").alias("words"))
        .filter(F.col("n_docs") > limit)
    )
    if max_percent is None:
        return lines.select("source", "hash", "n_docs", "first_doc")
    hosts = distinct.groupBy("source").agg(F.count("*").alias("host_docs"))
    return (
        lines.alias("f")
        .join(hosts.alias("h"), F.col("f.source").eqNullSafe(F.col("h.source")))
        .filter(F.col("n_docs") * 100 > F.col("host_docs") * max_percent)
        .select("f.source", "hash", "n_docs", "first_doc")
    )


def removed_lines(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, words_removed, hashes) of the documents that lose lines."""
    lines = measured.select("row", "doc_id", "content", "source", F.explode("lines").alias("line"))
    return (
        lines.alias("d")
        .join(
            frequent.alias("f"),
            (F.col("d.line.hash") == F.col("f.hash"))
            & F.col("d.source").eqNullSafe(F.col("f.source"))
            & ~(
                F.col("d.doc_id").eqNullSafe(F.col("f.first_doc.doc_id"))
                & (F.col("d.doc_id").isNotNull() | (F.col("d.content") == F.col("f.first_doc.content")))
            ),
        )
        .groupBy("row")
        .agg(F.sum("line.words").alias("words_removed"), F.collect_set("hash").alias("hashes"))
    )


def judge(
    documents: DataFrame,
    min_docs: int = MIN_LINE_DOCS,
    max_percent: int | None = None,
    min_left_percent: int = MIN_LEFT_PERCENT,
    long_docs: int = LONG_LINE_DOCS,
) -> DataFrame:
    """Features, ``base_failed``, ``words_removed`` and ``kept`` for each row.

    Null texts count as empty and fail for want of words. A null source is a
    host of its own. Rows without id are documents like others. Repeated rows give
    repeated rows. An empty table gives none. The features are written once to the shared folder and read from it.
    """
    spark = documents.sparkSession
    folder = scratch_dir(spark, "quality")
    features(documents).write.parquet(folder)
    measured = spark.read.parquet(folder)
    removed = removed_lines(measured, frequent_lines(measured, min_docs, max_percent, long_docs))
    lost = F.coalesce(F.col("words_removed"), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    depleted = (F.col("n_words") - lost) * 100 < F.col("n_words") * min_left_percent
    return measured.join(removed, "row", "left").select(
        "doc_id",
        "source",
        "content",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        lost.alias("words_removed"),
        "hashes",
        (~failed & ~depleted).alias("kept"),
    )


def clean(documents: DataFrame) -> DataFrame:
    """The documents kept, without the lines above the limits.

    All columns stay; ``n_chars`` follows the text. Only rejected documents and
    those that lose lines are joined, so most of the text is not shuffled when
    they are few.
    """
    verdicts = (
        judge(documents)
        .filter(~F.col("kept") | (F.size("hashes") > 0))
        .select("doc_id", "source", "content", "kept", "hashes")
        .dropDuplicates(["doc_id", "source", "content"])
    )
    given = documents.select(F.struct("*").alias("doc"))
    joined = given.join(
        verdicts.alias("v"),
        F.col("doc.doc_id").eqNullSafe(F.col("v.doc_id"))
        & F.col("doc.source").eqNullSafe(F.col("v.source"))
        & (content_hash(whole(F.col("doc.text"))) == F.col("v.content")),
        "left",
    ).filter(F.coalesce("v.kept", F.lit(True)))
    left = F.array_join(
        F.filter(
            F.split("doc.text", "\n"),
            lambda line: ~F.coalesce(F.array_contains(F.col("v.hashes"), line_hash(line)), F.lit(False)),
        ),
        "\n",
    )
    text = F.when(F.size("v.hashes") > 0, left).otherwise(F.col("doc.text"))
    return joined.select(
        *(
            text.alias(name)
            if name == "text"
            else F.when(F.size("v.hashes") > 0, F.length(left).cast("long"))
            .otherwise(F.col(f"doc.{name}"))
            .alias(name)
            if name == "n_chars"
            else F.col("doc").getField(name).alias(name)
            for name in documents.columns
        )
    )
