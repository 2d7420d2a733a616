"""Benchmark decontamination with a generalised suffix automaton of the items.

Training words stream through the automaton of all items' words, which keeps the
length of the longest item passage that ends at each word. Where it reaches the
window, the passage is a hit. Items shorter than the window count as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.tasks import binaries, prepare

WINDOW = 10
#: A document of which more than this share of words is hit is dropped.
MAX_COVERAGE_PERCENT = 50
#: Item words in one automaton; more items make more automata. What they find is
#: put together before anything is decided, so their number changes no result.
BLOCK_WORDS = 100_000

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z, and every byte that is in no word to a blank.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class ItemAutomaton:
    """Suffix automaton of several word lists, with the items each state occurs in."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for name, found in items:
            codes = [self.vocabulary.setdefault(word, len(self.vocabulary)) for word in found]
            coded.append((name, codes))
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self._annotate(coded)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, parent: int, code: int) -> int:
        """The state of exactly one word more than ``parent``, cut out of its target."""
        target = self.next[parent][code]
        if self.length[target] == self.length[parent] + 1:
            return target
        own = self._state(self.length[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = own
        while parent >= 0 and self.next[parent].get(code) == target:
            self.next[parent][code] = own
            parent = self.link[parent]
        return own

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            return self._split(last, code)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, code)
        return new

    def _annotate(self, coded: list[tuple[str | None, list[int]]]) -> None:
        count = len(self.length)
        self.items: list[tuple] = [()] * count
        marked = [-1] * count
        short: dict[int, list[tuple[int, str | None]]] = {}
        for number, (name, codes) in enumerate(coded):
            at = 0
            for code in codes:
                at = self.next[at][code]
                state = at
                while state > 0 and marked[state] != number:
                    marked[state] = number
                    self.items[state] += (name,)
                    state = self.link[state]
            if 0 < len(codes) < self.window:
                short.setdefault(at, []).append((len(codes), name))
        #: For each state, the one that holds the last ``window`` words of it.
        self.of_window = list(range(count))
        #: For each state, the short items that end with it: (words, item).
        self.short: list[tuple] = [()] * count
        for state in sorted(range(1, count), key=self.length.__getitem__):
            above = self.link[state]
            if self.length[above] >= self.window:
                self.of_window[state] = self.of_window[above]
            self.short[state] = (*short.get(state, ()), *self.short[above])

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words, and the items whose windows occur."""
        following, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        spans: list[tuple[int, int]] = []
        hit: set = set()
        state = matched = 0
        for at, code in enumerate(map(self.vocabulary.get, found)):
            if code is None:
                state = matched = 0
                continue
            while state and code not in following[state]:
                state = link[state]
                matched = length[state]
            state = following[state].get(code, 0)
            if not state:
                matched = 0
                continue
            matched += 1
            if matched >= window:
                spans.append((at + 1 - matched, at + 1))
                hit.update(self.items[self.of_window[state]])
            if short[state]:
                for size, name in short[state]:
                    if matched >= size:
                        spans.append((at + 1 - size, at + 1))
                        hit.add(name)
        return merged(spans), hit


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def automata(benchmark: DataFrame, window: int, block_words: int) -> Iterator[ItemAutomaton]:
    """Automata of the distinct items, each of about ``block_words`` words at most.

    The items of one block at a time come to the driver.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit("[0-9A-Za-z\\x80-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        rows = items.filter(own == block).sort("item_id", "text").collect()
        yield ItemAutomaton([(row["item_id"], words_of(row["text"].encode())) for row in rows], window)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def mark(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc, n_words, spans, items): each row as a struct, with its hit spans of words.

    ``items`` are the ids, as text, of items with a window in the document; a
    null id is left out there, though its windows count. Null and empty texts
    have no words; an empty benchmark hits nothing; repeated rows and items
    change nothing else. Every automaton follows in the same task; the texts
    are not shuffled.
    """
    spark = prepare(documents.sparkSession)
    marked = documents.select(F.struct("*").alias("doc"))
    marked = marked.selectExpr(
        "doc",
        "cast(0 as long) as n_words",
        "cast(array() as array<struct<start:int,end:int>>) as spans",
        "cast(array() as array<string>) as items",
    )
    for automaton in automata(benchmark, window, block_words):
        shared = spark.sparkContext.broadcast(automaton)
        marked = marked.mapInArrow(_marker(shared), marked.schema)
    return marked


def _marker(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            docs = batch.column("doc")
            spans, items, counts = [], [], []
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (old, names) in zip(binaries(docs.field("text")), before, strict=True):
                found = words_of(text)
                new, hit = automaton.scan(found)
                if old:
                    new = merged([*new, *((s["start"], s["end"]) for s in old)])
                counts.append(len(found))
                spans.append([{"start": a, "end": z} for a, z in new])
                items.append(sorted({*names, *(x for x in hit if x is not None)}))
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                ["doc", "n_words", "spans", "items"],
            )

    return run


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts of hit words and items for each document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return (
        mark(documents.select("doc_id", "text"), benchmark, window)
        .select("doc.doc_id", "n_words", hit.alias("n_hit"), "items")
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def remove(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage_percent: int = MAX_COVERAGE_PERCENT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without hit spans; those with too large a share of them go.

    All columns stay; ``n_chars`` follows the text. The share is that of the words
    hit by any item in the text as given. A text is scanned again after a cut, until
    none of its words is hit by an item of any automaton.
    """
    spark = prepare(documents.sparkSession)
    # which item is hit does not matter here: equal texts are one item
    items = benchmark.select(F.lit(None).cast("string").alias("item_id"), "text")
    shared = [spark.sparkContext.broadcast(automaton) for automaton in automata(items, window, block_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [one.value for one in shared]

        def hits(found: list[bytes]) -> list[tuple[int, int]]:
            return merged([span for automaton in every for span in automaton.scan(found)[0]])

        for batch in batches:
            texts = binaries(batch.column("text"))
            changed, gone = {}, []
            for row, text in enumerate(texts):
                found = words_of(text)
                spans = hits(found)
                if not spans:
                    continue
                if 100 * sum(z - a for a, z in spans) > max_coverage_percent * len(found):
                    gone.append(row)
                    continue
                while spans:
                    text = cut(text, spans)
                    spans = hits(words_of(text))
                changed[row] = text.decode()
            if changed:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                values = columns["text"].to_pylist()
                for row, text in changed.items():
                    values[row] = text
                columns["text"] = pa.array(values, columns["text"].type)
                if "n_chars" in columns:
                    sizes = columns["n_chars"].to_pylist()
                    for row, text in changed.items():
                        sizes[row] = len(text)
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
            if gone:
                dropped = set(gone)
                batch = batch.filter(pa.array([row not in dropped for row in range(batch.num_rows)]))
            yield batch

    return documents.mapInArrow(run, documents.schema)
