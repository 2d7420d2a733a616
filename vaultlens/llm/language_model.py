"""LM scoring with a hidden Markov language model.

A word belongs to one of ``CLASSES`` classes by its hash, the end of a text to
one of its own. A latent state emits a class, and a class a word:
``p(word | class)`` follows from the training counts of all words, so that the
model is a distribution over every text, unknown words included. Tables of the
states have a fixed size; word counts may be of any number and are never held
whole: texts are packed in blocks, and each block gets the counts of its own
words.

Baum-Welch runs on all training texts. Expected counts are summed in the tasks
and then by class. A long text is cut into segments; the product of a segment's
steps is a small matrix, so entry and exit probabilities of every segment are
exact, and all segments advance together.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultlens.llm import hashing
from vaultlens.llm.tasks import batch_rows, binaries, prepare
from vaultlens.session import scratch_dir

STATES = 4
CLASSES = 8192
ROUNDS = 4
#: Tokens of a block, unless one text alone has more.
BLOCK_TOKENS = 2_000_000
#: Tokens of a segment, and segments that advance together.
SEGMENT = 128
SEGMENTS = 4096
#: Training tokens are those of texts whose id's CRC-32 has another remainder.
FOLDS, HELD_OUT = 7, 2
#: Expected counts added to every class, in proportion to its share.
PRIOR = 50.0
_SCALE_EVERY = 16

END = b""


def held_out(doc_id) -> bool:
    """Whether a text is kept out of training; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def class_of(words: list[bytes]) -> np.ndarray:
    """Class of each word; the end has the last."""
    out = np.full(len(words), CLASSES, np.int32)
    named = [n for n, word in enumerate(words) if word]
    if named:
        hashes = hashing.word_runs([words[n] for n in named], 1)
        out[named] = (hashes % np.uint64(CLASSES)).astype(np.int32)
    return out


# --- blocks of texts --------------------------------------------------------

_BLOCK = (
    "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, ids binary, classes array<int>, "
    "words array<binary>, counts array<long>"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of the block's own vocabulary, one row a block."""
    part, number = TaskContext.get().partitionId(), count()
    docs: list = []
    size = 0
    vocabulary: dict = defaultdict(count().__next__)

    def packed() -> pa.RecordBatch:
        words = list(vocabulary)
        ids = np.concatenate([d[2] for d in docs])
        train = np.concatenate([d[2] for d in docs if not d[1]] or [np.zeros(0, np.int32)])
        row = {
            "block": [part * (1 << 32) + next(number)],
            "doc_ids": [[d[0] for d in docs]],
            "held": [[d[1] for d in docs]],
            "lengths": [[len(d[2]) for d in docs]],
            "ids": [zlib.compress(ids.tobytes(), 1)],
            "classes": [class_of(words)],
            "words": [words],
            "counts": [np.bincount(train, minlength=len(words))],
        }
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        types += [pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row)
        )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text")), strict=True):
            found = tokens_of(text)
            if docs and size + len(found) > BLOCK_TOKENS:
                yield packed()
                docs, size = [], 0
                vocabulary = defaultdict(count().__next__)
            ids = np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found))
            docs.append((doc_id, held_out(doc_id), ids))
            size += len(found)
    if docs:
        yield packed()


def _lists(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    """Values of list columns of a row."""
    return [batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in names]


def _ids(batch: pa.RecordBatch, row: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(batch.column("ids")[row].as_py()), np.int32)


# --- the model --------------------------------------------------------------


class Model:
    """Start, transition and emission tables of the states."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def initial(cls, class_counts: np.ndarray) -> Model:
        """States that hold on, each with its own disturbance of the class shares."""
        random = np.random.Generator(np.random.PCG64(7))
        share = (class_counts + 1.0) / (class_counts + 1.0).sum()
        emit = share[:, None] * np.exp(random.normal(0, 1, (len(share), STATES)))
        step = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
        np.fill_diagonal(step, 0.9)
        return cls(np.full(STATES, 1 / STATES), step, emit / emit.sum(axis=0))

    @classmethod
    def estimated(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray, class_counts: np.ndarray) -> Model:
        """Tables from expected counts."""
        share = (class_counts + 1.0) / (class_counts + 1.0).sum()
        emit = emit + PRIOR * share[:, None]
        step = step + 1.0
        start = start + 1.0
        return cls(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Segments:
    """The texts of a block cut into segments, longest first."""

    def __init__(self, lengths: np.ndarray):
        per_text = -(-lengths // SEGMENT)
        self.text = np.repeat(np.arange(len(lengths)), per_text)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        begin = np.cumsum(lengths) - lengths
        self.begin = begin[self.text] + self.place * SEGMENT
        self.size = np.minimum(SEGMENT, lengths[self.text] - self.place * SEGMENT)
        self.first = np.cumsum(per_text) - per_text
        self.per_text = per_text

    def groups(self) -> Iterator[np.ndarray]:
        order = np.argsort(-self.size, kind="stable")
        for at in range(0, len(order), SEGMENTS):
            yield order[at : at + SEGMENTS]


def _active(size: np.ndarray) -> list[int]:
    """How many of the segments, longest first, have a token at each step."""
    steps = np.arange(size[0] if len(size) else 0)
    return list(np.searchsorted(-size, -steps, side="left"))


def transfers(model: Model, classes: np.ndarray, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the product of its steps, scaled, and the logarithm of the scale."""
    k = STATES
    matrix = np.empty((len(segments.size), k, k))
    scale = np.zeros(len(segments.size))
    for group in segments.groups():
        begin, size = segments.begin[group], segments.size[group]
        x = np.broadcast_to(np.eye(k), (len(group), k, k)).copy()
        log = np.zeros(len(group))
        for at, active in enumerate(_active(size)):
            emit = model.emit[classes[begin[:active] + at]]
            x[:active] = (x[:active].reshape(-1, k) @ model.step).reshape(-1, k, k) * emit[:, None, :]
            if at % _SCALE_EVERY == _SCALE_EVERY - 1:
                top = x[:active].max(axis=(1, 2))
                x[:active] /= top[:, None, None]
                log[:active] += np.log(top)
        top = x.max(axis=(1, 2))
        matrix[group] = x / top[:, None, None]
        scale[group] = log + np.log(top)
    return matrix, scale


def chained(model: Model, matrix: np.ndarray, scale: np.ndarray, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion over segments: natural log-likelihood of each text,
    and the state probabilities at the entry of each segment."""
    texts = len(segments.per_text)
    now = np.broadcast_to(model.start, (texts, STATES)).copy()
    log = np.zeros(texts)
    entry = np.empty((len(segments.size), STATES))
    order = np.argsort(-segments.per_text, kind="stable")
    for at in range(int(segments.per_text.max(initial=0))):
        texts_on = order[: np.searchsorted(-segments.per_text[order], -at, side="left")]
        own = segments.first[texts_on] + at
        entry[own] = now[texts_on]
        moved = np.einsum("ti,tij->tj", now[texts_on], matrix[own])
        total = moved.sum(axis=1)
        now[texts_on] = moved / total[:, None]
        log[texts_on] += np.log(total) + scale[own]
    return log, entry


def exits(matrix: np.ndarray, segments: Segments) -> np.ndarray:
    """Backward probabilities at the end of each segment, up to a factor."""
    out = np.ones((len(segments.size), STATES))
    order = np.argsort(-segments.per_text, kind="stable")
    for at in range(int(segments.per_text.max(initial=0)) - 2, -1, -1):
        texts_on = order[: np.searchsorted(-segments.per_text[order], -(at + 1), side="left")]
        own = segments.first[texts_on] + at
        back = np.einsum("tij,tj->ti", matrix[own + 1], out[own + 1])
        out[own] = back / back.sum(axis=1, keepdims=True)
    return out


def expected(model: Model, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected start, step and emission counts of texts, and their log-likelihood."""
    k = STATES
    start, step = np.zeros(k), np.zeros((k, k))
    emit = np.zeros((CLASSES + 1, k))
    segments = Segments(lengths)
    if not len(lengths):
        return start, step, emit, 0.0
    matrix, scale = transfers(model, classes, segments)
    log, entry = chained(model, matrix, scale, segments)
    leave = exits(matrix, segments)
    for group in segments.groups():
        begin, size = segments.begin[group], segments.size[group]
        active = _active(size)
        before = np.empty((len(active), len(group), k))
        now = entry[group].copy()
        for at, n in enumerate(active):
            before[at, :n] = now[:n]
            moved = (now[:n] @ model.step) * model.emit[classes[begin[:n] + at]]
            now[:n] = moved / moved.sum(axis=1, keepdims=True)
        back = leave[group].copy()
        emitted = []
        for at in range(len(active) - 1, -1, -1):
            n = active[at]
            seen = classes[begin[:n] + at]
            ahead = model.emit[seen] * back[:n]
            pulled = ahead @ model.step.T
            weight = 1.0 / (before[at, :n] * pulled).sum(axis=1)
            own = before[at, :n] * weight[:, None]
            step += model.step * (own.T @ ahead)
            after = (own @ model.step) * ahead
            emitted.append((seen, after))
            if at == 0:
                firsts = segments.place[group[:n]] == 0
                start += (own * pulled)[firsts].sum(axis=0)
            back[:n] = pulled / pulled.sum(axis=1, keepdims=True)
        seen = np.concatenate([x for x, _ in emitted])
        after = np.concatenate([x for _, x in emitted])
        for n in range(k):
            emit[:, n] += np.bincount(seen, weights=after[:, n], minlength=CLASSES + 1)
    return start, step, emit, float(log.sum())


# --- Spark jobs -------------------------------------------------------------


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, step = np.zeros(STATES), np.zeros((STATES, STATES))
        emit, log = np.zeros((CLASSES + 1, STATES)), 0.0
        for batch in batches:
            for row in range(batch.num_rows):
                ids = _ids(batch, row)
                lengths, held, classes = _lists(batch, row, "lengths", "held", "classes")
                kept = classes[ids][np.repeat(~held, lengths)].astype(np.int64)
                more = expected(model, kept, lengths[~held])
                start, step, emit, log = start + more[0], step + more[1], emit + more[2], log + more[3]
        keys = np.arange(-STATES - 2, CLASSES + 1)
        values = np.vstack([np.full((1, STATES), log), start, step, emit])
        used = values.any(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[used], pa.int32()), *(pa.array(values[used, n]) for n in range(STATES))],
            ["key", *(f"s{n}" for n in range(STATES))],
        )

    return run


def train(blocks: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over all training texts; also the log-likelihood before each round.

    Every round sums its counts in the tasks and by class; the driver gets one
    row a class.
    """
    spark = blocks.sparkSession
    model, told = Model.initial(class_counts), []
    columns = [f"s{n}" for n in range(STATES)]
    schema = "key int, " + ", ".join(f"{c} double" for c in columns)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        found = blocks.select("lengths", "held", "ids", "classes").mapInArrow(_trainer(shared), schema)
        table = np.zeros((CLASSES + STATES + 3, STATES))
        for row in found.groupBy("key").agg(*(F.sum(c).alias(c) for c in columns)).collect():
            table[row["key"] + STATES + 2] = [row[c] for c in columns]
        told.append(float(table[0, 0]))
        model = Model.estimated(table[1], table[2 : STATES + 2], table[STATES + 2 :], class_counts)
        shared.unpersist()
    return model, told


def block_counts(blocks: DataFrame) -> DataFrame:
    """(block, local, class, c, first): the training count of each word of each block.

    A word has one row in each block that has it, so even the commonest word has
    as many rows as there are blocks. ``first`` marks one of them.
    """
    rows = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts", "classes")).alias("local", "w"))
    own = Window.partitionBy("w.words")
    return rows.select(
        "block",
        "local",
        F.col("w.classes").alias("class"),
        F.sum("w.counts").over(own).alias("c"),
        (F.row_number().over(own.orderBy("block")) == 1).alias("first"),
    )


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, class_counts, class_words, total, distinct = shared.value
        known_word = np.log(class_counts + class_words + 1.0)
        known_word[CLASSES] = 0.0
        for batch in batches:
            for row in range(batch.num_rows):
                ids = _ids(batch, row)
                lengths, classes = _lists(batch, row, "lengths", "classes")
                counts = np.frombuffer(zlib.decompress(batch.column("found")[row].as_py()), np.int64)
                seen = classes[ids].astype(np.int64)
                begin = np.cumsum(lengths) - lengths
                sums = lambda values: np.add.reduceat(values, begin)
                base = sums(np.log(counts + 1.0)[ids]) - lengths * np.log(total + 1.0 * (distinct + 1))
                word = np.where(classes == CLASSES, 0.0, np.log(counts + 1.0) - known_word[classes])
                segments = Segments(lengths)
                log, _ = chained(model, *transfers(model, seen, segments), segments)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[row].values,
                        batch.column("held")[row].values,
                        pa.array(lengths, pa.int64()),
                        pa.array(sums((counts > 0).astype(np.int64)[ids]), pa.int64()),
                        pa.array(np.full(len(lengths), total), pa.int64()),
                        pa.array(base / np.log(10.0), pa.float64()),
                        pa.array((log + sums(word[ids])) / np.log(10.0), pa.float64()),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each block as one array, from rows in the order of block and word."""
    block, held = None, []

    def row() -> pa.RecordBatch:
        found = zlib.compress(np.concatenate(held).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([found], pa.binary())], ["block", "found"])

    for batch in batches:
        blocks, counts = batch.column("block").to_numpy(), batch.column("c").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for a, z in zip(edges, edges[1:], strict=False):
            if a == z:
                continue
            if blocks[a] != block:
                if held:
                    yield row()
                block, held = int(blocks[a]), []
            held.append(counts[a:z].astype(np.int64))
    if held:
        yield row()


def score(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Base and model scores of every text, in log10.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score. A null or empty text has its end alone. Repeated rows are scored, and
    learned from, each; an empty table gives none. Without training texts all
    words are unknown. Texts are read whole.
    """
    spark = prepare(documents.sparkSession)
    folder = scratch_dir(spark, "lm-blocks")
    documents.select("doc_id", "text").mapInArrow(_blocks, _BLOCK).write.option("compression", "zstd").parquet(folder)
    blocks = spark.read.parquet(folder)
    found = _written(block_counts(blocks), "lm-counts")
    per_class = found.filter("first AND c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    class_counts, class_words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for row in per_class.collect():
        class_counts[row["class"]], class_words[row["class"]] = row["c"], row["v"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.select("block", "local", "c").repartition(parts, "block").sortWithinPartitions("block", "local")
    with batch_rows(spark, 100_000):
        arrays = _written(ordered.select("block", "c").mapInArrow(_gathered, "block long, found binary"), "lm-arrays")
    with batch_rows(spark, 1):
        model, _ = train(blocks, class_counts, rounds)
        shared = spark.sparkContext.broadcast(
            (model, class_counts, class_words, int(class_counts.sum()), int(class_words.sum()))
        )
        joined = blocks.select("block", "doc_ids", "held", "lengths", "ids", "classes").join(arrays, "block")
        return _written(
            joined.mapInArrow(
                _score(shared),
                "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double",
            ),
            "lm-scores",
        )


def _written(frame: DataFrame, purpose: str) -> DataFrame:
    folder = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)
