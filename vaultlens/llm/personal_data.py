"""Personal data by bootstrapped contextual extraction.

Entities that fixed patterns find are the seeds. The words around their occurrences
are lexical patterns of a kind; the other things that stand in the same contexts and
have the shape of the kind are instances to judge. Spark scores the graph of patterns
and instances in rounds: a pattern by the share of its instances that are believed, an
instance by the patterns that hold it. Patterns of high confidence then mark unseen
identifiers, wherever these occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.tasks import prepare
from vaultlens.session import scratch_dir, ship_package

#: Kinds in the order of their spans.
KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; each is one pass over the patterns and one over the instances.
ROUNDS = 3
#: A pattern is believed from this share of believed instances and number of seeds.
MIN_CONFIDENCE, MIN_SEEDS = 0.5, 3
#: An instance is marked from this score.
MIN_SCORE = 0.6
#: Added to the instances of a pattern, so that few of them prove little.
PRIOR = 1.0
#: Of a word beside an occurrence, the characters next to it that count.
WORD_CHARS = 40

# -- spans of the fixed patterns -------------------------------------------------

_NUMBER = re.compile(r"[0-9]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ so that time grows with the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at)):
            end = found.end()
            yield start, end
        at = text.find("@", at + 1) if end <= at else text.find("@", end)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """IP addresses: each four numbers in a row of dotted ones, parts at most 255."""
    for found in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, found.start(), found.end()))
        for n in range(0, len(parts) - 3, 4):
            four = parts[n : n + 4]
            if all(_small(part.group()) for part in four):
                yield four[0].start(), four[3].end()


def _small(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(int(d) // 5 + 2 * int(d) % 10 for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = _digits(found.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 10 <= len(_digits(found.group())) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    spans = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(a, 1, z) for a, z in addresses(text)]
        spans += [(a, 2, z) for a, z in cards(text)]
        if "+" in text:
            spans += [(a, 3, z) for a, z in phones(text)]
    return sorted(spans)


# -- instances and their contexts ---------------------------------------------------

#: What may be an identifier: a run of digits with separators, or a word with an @ or
#: one spelt out.
_RUN = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])+")
_AT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?(?=[A-Za-z0-9])[A-Za-z0-9.-]{1,255}"
    r"(?: ?(?:\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){0,8}"
)
_WORD = re.compile(r"\S+")


def shapes(value: str) -> list[int]:
    """Kinds whose shape a value has, looser than the fixed patterns."""
    if "@" in value or "at]" in value or "at)" in value:
        return [0]
    parts = value.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts):
        return [1]
    size = len(_digits(value))
    if 14 <= size <= 19:
        return [2]
    return [3] if 7 <= size <= 15 else []


def canonical(kind: int, value: str) -> str:
    """One text for an identifier however it is written: digits only, or lower case."""
    if kind >= 2:
        return _digits(value)
    return value.lower().replace(" ", "") if kind == 0 else value


def _near(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before an occurrence and the one behind it, digits as 0."""
    before = _WORD.findall(text[max(0, start - 2 * WORD_CHARS - 4) : start])[-2:]
    after = _WORD.search(text[end : end + WORD_CHARS + 4])
    words = [w[-WORD_CHARS:] for w in before]
    words = [""] * (2 - len(words)) + words + [after.group()[:WORD_CHARS] if after else ""]
    return tuple(_DIGIT.sub("0", w.lower()) for w in words)


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind, start, end, instance, seed, patterns) of seeds and of what may be one.

    Patterns are the two words before, and the word before with that behind. An
    occurrence with no word before it has none. What overlaps a seed is no candidate.
    """
    spans = [(a, z, [k], True) for a, k, z in base]
    taken = sorted((a, z) for a, _, z in base)
    found = [*_AT.finditer(text)] if ("@" in text or "at]" in text or "at)" in text) else []
    if _DIGIT.search(text):
        found += _RUN.finditer(text)
    at, last = 0, 0
    for match in sorted(found, key=lambda m: m.span()):
        a, z = match.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a < last or (at < len(taken) and taken[at][0] < z) or _inside_word(text, a, z):
            continue
        if kinds := shapes(match.group()):
            spans.append((a, z, kinds, False))
            last = z
    rows = []
    for a, z, kinds, seed in spans:
        two, one, behind = _near(text, a, z)
        patterns = [f"<{two} {one}", f"<{one}>{behind}"] if one else []
        rows += [(k, a, z, canonical(k, text[a:z]), seed, patterns) for k in kinds]
    return rows


def _inside_word(text: str, start: int, end: int) -> bool:
    """Whether a letter or digit touches the span: part of a longer code."""
    return (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())


_FOUND = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int64()),
            ("stop", pa.int64()),
            ("instance", pa.string()),
            ("seed", pa.bool_()),
            ("patterns", pa.list_(pa.string())),
        ]
    )
)
_FOUND_DDL = (
    "row long, doc_id long, found array<struct<kind:int,start:bigint,stop:bigint,instance:string,seed:boolean,"
    "patterns:array<string>>>"
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = []
        for text in texts:
            text = text or ""
            rows = occurrences(text, base_spans(text))
            found.append([dict(zip(_NAMES, values, strict=True)) for values in rows])
        rows = pa.array(range(row, row + len(texts)), pa.int64())
        row += len(texts)
        yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), pa.array(found, _FOUND)], ["row", "doc_id", "found"])


_NAMES = ("kind", "start", "stop", "instance", "seed", "patterns")


# -- the graph ----------------------------------------------------------------------


def _written(frame: DataFrame, purpose: str) -> DataFrame:
    folder = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def scored(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, instance, score) of the instances that are no seeds.

    ``edges`` has (kind, pattern, instance, seed), one row for each pair however often
    and wherever it occurs, so copies of a text add nothing. A pattern's confidence is
    the sum of the scores of its instances over their number and a prior; patterns of
    under ``MIN_SEEDS`` seeds or ``MIN_CONFIDENCE`` have none. An instance has the
    noisy-or of its patterns, and seeds stay at 1.
    """
    seeded = edges.groupBy("kind", "pattern").agg(F.count_if("seed").alias("seeds"), F.count("*").alias("held"))
    # what no pattern with enough seeds holds cannot score: the rest is left out early
    able = _written(seeded.filter((F.col("seeds") >= MIN_SEEDS) & (F.col("seeds") < F.col("held"))), "pii-patterns")
    open_edges = edges.filter(~F.col("seed")).join(able.select("kind", "pattern"), ["kind", "pattern"])
    open_edges = _written(open_edges.select("kind", "pattern", "instance"), "pii-edges")
    scores = None
    for _ in range(rounds):
        believed = able.withColumn("more", F.lit(0.0))
        if scores is not None:
            told = open_edges.join(scores, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.sum("score").alias("more"))
            believed = able.join(told, ["kind", "pattern"], "left").fillna(0.0, ["more"])
        confidence = (F.col("seeds") + F.col("more")) / (F.col("held") + F.lit(PRIOR))
        believed = believed.select("kind", "pattern", confidence.alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE)
        doubt = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence"))))
        scores = (
            open_edges.join(believed, ["kind", "pattern"])
            .groupBy("kind", "instance")
            .agg((1 - F.exp(doubt)).alias("score"))
        )
        scores = _written(scores, "pii-scores")
    return scores


def _text(span: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(":", F.get(kinds, span["kind"]), span["start"], span["stop"])


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")


def find(documents: DataFrame) -> DataFrame:
    """Base counts and digest, and all spans, of every document.

    Null and empty texts have no spans: zeros, the digest of the empty text, and an
    empty string. Ids are only carried along. Repeated rows are judged each, but one
    pattern and instance count once however many rows hold them. An empty table gives
    no rows. Texts are read whole; offsets are code points.
    """
    spark = ship_package(prepare(documents.sparkSession))
    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scanned, _FOUND_DDL)
    rows = _written(rows, "pii-rows")
    places = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    edges = places.select("kind", F.explode("patterns").alias("pattern"), "instance")
    # an instance that is a seed anywhere is one everywhere
    seeds = _written(places.filter("seed").select("kind", "instance").distinct(), "pii-seeds")
    edges = edges.select("kind", "pattern", "instance").distinct()
    edges = edges.join(seeds.withColumn("seed", F.lit(True)), ["kind", "instance"], "left").fillna(False, ["seed"])
    sure = scored(_written(edges, "pii-graph")).filter(F.col("score") >= MIN_SCORE)
    sure = sure.select("kind", "instance").unionByName(seeds)
    marked = places.filter(~F.col("seed")).join(sure, ["kind", "instance"])
    marked = marked.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("marked"))
    base = F.transform(F.filter("found", lambda f: f["seed"]), lambda f: F.struct(f["start"], f["kind"], f["stop"]))
    spans = F.array_sort(F.concat("base", F.coalesce("marked", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>"))))
    return (
        rows.select("row", "doc_id", base.alias("base"))
        .join(marked, "row", "left")
        .select(
            "doc_id",
            *(_of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
            F.sha2(F.array_join(F.transform(F.array_sort("base"), _text), ","), 256).alias("base_sha256"),
            F.array_join(F.transform(spans, _text), ",").alias("spans"),
            F.size("base").cast("long").alias("n_base"),
        )
    )
