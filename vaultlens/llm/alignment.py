"""Cross-tokenizer alignment with external spill counting.

Two tokenizers cut the same bytes; token occurrences whose byte ranges overlap are
linked. Tasks turn whole texts into pair-document records, radix-partitioned by the
id of the second side and written as sorted zstd runs. A tree of k-way heap merges
counts each pair; as its order has all pairs of a second-side id together, the
highest count of each id falls out of the same pass. The counts then stream back
over the runs, which add up what each document gets.

A pair has one entry in a run however many documents hold it, so a hot pair or id
reaches the merges pre-aggregated, and runs of one bucket are spread over tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.tasks import batch_rows, prepare
from vaultlens.session import scratch_dir, ship_package

#: Radix buckets of second-side ids.
BUCKETS = 64
#: Links that one run holds, and documents that one block holds at most.
RUN_LINKS, BLOCK_DOCS = 2_000_000, 50_000
#: Runs that one merge reads, and pairs in one compressed frame.
FAN_IN, FRAME = 64, 16_384
#: Characters after which a long text is cut at a blank that both tokenizers cut at.
CHUNK = 1 << 16
#: Tokens whose groups and links are worked out at once.
SLICE_TOKENS = 200_000

#: Fixed pattern: the pre-tokenizer of byte-level BPE.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose Unicode classes are the same in every engine; other texts are
#: encoded by the library of the vocabulary file.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ɏ]*\Z")
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of every id, and the decimal text of ids."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(byte_file)
        self.library.encode_special_tokens = True
        described = json.loads(Path(byte_file).read_text(encoding="utf-8"))
        byte_of = _byte_of()
        special = {token["content"] for token in described["added_tokens"] if token["special"]}
        vocabulary = {
            bytes(byte_of[c] for c in entry): n for entry, n in described["model"]["vocab"].items() if entry not in special
        }
        self.bytes_a = [b""] * (1 + max(self.library.get_vocab().values()))
        for entry, n in vocabulary.items():
            self.bytes_a[n] = entry
        # ids in the order of the merges are ranks, which encode the same and faster
        merges = [entry.split(" ") if isinstance(entry, str) else entry for entry in described["model"]["merges"]]
        made = [described["model"]["vocab"]["".join(pair)] for pair in merges]
        self.ranked = None
        if made == sorted(made) and described["pre_tokenizer"].get("use_regex"):
            self.ranked = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=vocabulary, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.bytes_b = [self._piece(n) for n in range(self.pieces.get_piece_size())]
        names = [self.pieces.id_to_piece(n) for n in range(len(self.bytes_b))]
        # a piece with a blank behind another character could span a cut
        self.cuts = not any("▁" in name.lstrip("▁") for name in names)
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        top = max(len(self.bytes_a), len(self.bytes_b))
        width = len(str(top)) + 1
        texts = [f"{n}{mark}".encode() for n in range(top) for mark in ",|;"]
        self.width_of = np.array([len(x) for x in texts], np.int64)
        self.text_of = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(-1, width)

    def _piece(self, n: int) -> bytes:
        name = self.pieces.id_to_piece(n)
        if self.pieces.is_byte(n):
            return bytes([int(name[3:5], 16)])
        return name.replace("▁", " ").encode()

    def first(self, text: str) -> list[int]:
        """Ids of the byte-level side."""
        if self.ranked is not None and _PLAIN.match(text):
            return self.ranked.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def chunks(self, text: str) -> Iterator[str]:
        """The text, cut at blanks between two letters where it is long."""
        at = 0
        while self.cuts and len(text) - at > CHUNK:
            cut = _CUT.search(text, at + CHUNK)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:] if at else text

    def encoded(self, text: str) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids of both sides for each chunk, or None where their bytes are not the text's."""
        out = []
        for chunk in self.chunks(text):
            a, b = self.first(" " + chunk), self.pieces.encode(chunk)
            whole = b" " + chunk.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) != whole:
                return None
            if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                return None
            out.append((np.array(a, np.int64), np.array(b, np.int64)))
        return out


@lru_cache(maxsize=1)
def tokenizers(byte_file: str, piece_file: str) -> Tokenizers:
    return Tokenizers(byte_file, piece_file)


class Codes:
    """Pairs as numbers in bucket-major, then second-side-major order."""

    def __init__(self, n_a: int, n_b: int, buckets: int):
        self.buckets, self.rows = buckets, -(-n_b // buckets)
        self.bits = int(n_a).bit_length()

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((b % self.buckets * self.rows + b // self.buckets) << self.bits) | a

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Where each bucket starts among sorted codes, and their end."""
        return np.searchsorted(codes, (np.arange(self.buckets + 1) * self.rows) << self.bits)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one zstd frame, each in the fewest bytes that hold it."""
    parts = []
    for values in arrays:
        top = int(values.max()) if len(values) else 0
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if top <= np.iinfo(t).max)
        kept = values.astype(kind)
        parts += [np.array([len(kept), kept.itemsize], np.int64).tobytes(), kept.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _opened(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
    while at < len(data):
        size, item = np.frombuffer(data, np.int64, 2, at)
        out.append(np.frombuffer(data, kinds[int(item)], int(size), at + 16).astype(np.int64))
        at += 16 + int(size * item)
    return out


def _framed(codes: np.ndarray, *values: np.ndarray) -> list[bytes]:
    """Sorted codes, as differences, and their values in frames."""
    return [
        _squeezed(np.diff(codes[n : n + FRAME], prepend=0), *(v[n : n + FRAME] for v in values))
        for n in range(0, len(codes), FRAME)
    ]


def _unframed(blob: bytes) -> list[np.ndarray]:
    first, *others = _opened(blob)
    return [np.cumsum(first), *others]


# -- runs -------------------------------------------------------------------

_RUN = pa.schema(
    [
        ("block", pa.int64()),
        ("run", pa.int32()),
        ("bucket", pa.int32()),
        ("pairs", pa.list_(pa.binary())),
        ("records", pa.binary()),
    ]
)
_RUN_DDL = "block long, run int, bucket int, pairs array<binary>, records binary"


class _Blocks:
    """Documents of one task: their sums, and runs of pair-document records."""

    def __init__(self, pair: Tokenizers, codes: Codes, part: int, run_links: int):
        self.pair, self.codes, self.run_links = pair, codes, run_links
        self.block = part << 32
        self._clear()

    def _clear(self) -> None:
        self.ids, self.sums, self.digests = [], [], []
        self.links, self.held, self.run = [], 0, 0
        self.chunks, self.tokens = [], 0

    def add(self, doc_id: int | None, text: str | None) -> Iterator[tuple]:
        found = self.pair.encoded(text) if text else None
        self.ids.append(doc_id)
        self.sums.append([0, 0, 0, 0])
        self.digests.append(hashlib.sha256() if found else None)
        for a, b in found or ():
            self.chunks.append((len(self.ids) - 1, a, b))
            self.tokens += len(a) + len(b)
            if self.tokens >= SLICE_TOKENS:
                self._work()
            if self.held >= self.run_links:
                yield from self._runs()
        if self.run or len(self.ids) >= BLOCK_DOCS:
            yield from self.close()

    def _work(self) -> None:
        """Groups and links of the chunks at hand."""
        docs = [doc for doc, _, _ in self.chunks]
        sizes_a = np.array([len(a) for _, a, _ in self.chunks])
        sizes_b = np.array([len(b) for _, _, b in self.chunks])
        a = np.concatenate([x for _, x, _ in self.chunks])
        b = np.concatenate([x for _, _, x in self.chunks])
        self.chunks, self.tokens = [], 0
        ends_a, ends_b = np.cumsum(self.pair.length_a[a]), np.cumsum(self.pair.length_b[b])
        ends = np.concatenate((ends_a, ends_b))
        ends.sort(kind="stable")
        last = np.append(ends[1:] != ends[:-1], True)
        shared = ends[1:][~last[:-1]]
        ends = ends[last]
        # between two neighbouring ends lies exactly one link
        starts = np.append(0, ends[:-1])
        codes = self.codes.of(a[np.searchsorted(ends_a, starts, "right")], b[np.searchsorted(ends_b, starts, "right")])
        of_chunk = ends_a[np.cumsum(sizes_a) - 1]
        links = np.diff(np.searchsorted(ends, of_chunk, "right"), prepend=0)
        groups = np.diff(np.searchsorted(shared, of_chunk, "right"), prepend=0)
        # tokens in the order of the text of groups
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        before_b = np.append(0, np.searchsorted(ends_b, shared, "right"))
        before_a = np.append(0, np.searchsorted(ends_a, shared, "right"))
        tokens = np.empty(len(a) + len(b), np.int64)
        tokens[np.arange(len(a)) + before_b[group_a]] = 3 * a + (shared[group_a] == ends_a)
        tokens[np.arange(len(b)) + before_a[group_b + 1]] = 3 * b + 2 * (shared[group_b] == ends_b)
        text = self.pair.text_of[tokens].ravel()
        text = text[text != 0].tobytes()
        stops = np.cumsum(self.pair.width_of[tokens])[np.cumsum(sizes_a + sizes_b) - 1]
        at = 0
        for n, doc in enumerate(docs):
            sums = self.sums[doc]
            if sums[0]:
                self.digests[doc].update(b";")
            for k, more in enumerate((sizes_a, sizes_b, groups, links)):
                sums[k] += int(more[n])
            self.digests[doc].update(text[at : stops[n] - 1])
            at = int(stops[n])
        self.links.append((codes, np.repeat(np.array(docs, np.int64), links)))
        self.held += len(codes)

    def _runs(self) -> Iterator[tuple]:
        """Write the links at hand as one sorted run for each bucket."""
        if not self.held:
            return
        shift = BLOCK_DOCS.bit_length()
        keys = np.concatenate([(codes << shift) | docs for codes, docs in self.links])
        self.links, self.held = [], 0
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        codes, docs = keys >> shift, keys & ((1 << shift) - 1)
        start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        pairs, sums = codes[start], np.add.reduceat(times, start)
        held = np.diff(np.append(start, len(codes)))
        edges = self.codes.edges(pairs)
        for bucket in np.flatnonzero(np.diff(edges)):
            own = slice(edges[bucket], edges[bucket + 1])
            end = start[edges[bucket + 1]] if edges[bucket + 1] < len(start) else len(codes)
            rows = slice(start[edges[bucket]], end)
            yield (
                self.block,
                self.run,
                int(bucket),
                _framed(pairs[own], sums[own]),
                _squeezed(held[own], docs[rows], times[rows]),
            )
        self.run += 1

    def close(self) -> Iterator[tuple]:
        """The rest of the links and the row of the documents; a new block follows."""
        if self.chunks:
            self._work()
        yield from self._runs()
        if self.ids:
            table = pa.table(
                {
                    "doc_id": pa.array(self.ids, pa.int64()),
                    **{name: pa.array([s[k] for s in self.sums], pa.int64()) for k, name in enumerate(_SUMS)},
                    "groups_sha256": [d.hexdigest() if d else "" for d in self.digests],
                }
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield self.block, self.run, -1, None, sink.getvalue().to_pybytes()
            self.block += 1
        self._clear()


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _runs_of(files: tuple[str, str], buckets: int, run_links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*(SparkFiles.get(name) for name in files))
        codes = Codes(len(pair.bytes_a), len(pair.bytes_b), buckets)
        blocks = _Blocks(pair, codes, TaskContext.get().partitionId(), run_links)
        for batch in batches:
            for doc_id, text in zip(*(batch.column(n) for n in (0, 1)), strict=True):
                if rows := list(blocks.add(doc_id.as_py(), text.as_py())):
                    yield _batch(rows, _RUN)
        if rows := list(blocks.close()):
            yield _batch(rows, _RUN)

    return run


# -- counting ---------------------------------------------------------------


def merged(runs: list[Iterator[list[np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and summed counts of sorted runs, in order, frame by frame.

    A heap holds the last code of the frame of each run. Up to the least of them
    every run's entries are at hand, so these are summed and passed on.
    """
    frames: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def more(k: int) -> None:
        if (frame := next(runs[k], None)) is not None:
            frames[k] = frame
            heapq.heappush(heap, (int(frame[0][-1]), k))

    for k in range(len(runs)):
        more(k)
    while heap:
        bound = heap[0][0]
        taken, ended = [], []
        for k, (codes, counts) in frames.items():
            n = int(np.searchsorted(codes, bound, "right"))
            if n:
                taken.append((codes[:n], counts[:n]))
                frames[k] = [codes[n:], counts[n:]]
        while heap and heap[0][0] == bound:
            ended.append(heapq.heappop(heap)[1])
        for k in ended:
            del frames[k]
            more(k)
        codes = np.concatenate([c for c, _ in taken])
        counts = np.concatenate([c for _, c in taken])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        yield codes[first], np.add.reduceat(counts, first)


def best_marked(frames: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Codes, counts, and whether a count is the highest of its second-side id."""

    def marked(codes, counts):
        first = np.flatnonzero(np.append(True, np.diff(codes >> bits) != 0))
        top = np.maximum.reduceat(counts, first)
        return codes, counts, (counts == np.repeat(top, np.diff(np.append(first, len(codes))))).astype(np.int64)

    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for more in frames:
        codes, counts = np.append(codes, more[0]), np.append(counts, more[1])
        done = int(np.searchsorted(codes >> bits, codes[-1] >> bits))  # the last id may go on
        if done:
            yield marked(codes[:done], counts[:done])
            codes, counts = codes[done:], counts[done:]
    if len(codes):
        yield marked(codes, counts)


_MERGED_DDL = "bucket int, slot long, seq int, pairs array<binary>"
_MERGED = pa.schema(
    [("bucket", pa.int32()), ("slot", pa.int64()), ("seq", pa.int32()), ("pairs", pa.list_(pa.binary()))]
)
#: Frames in one row of a merged run.
_ROW_FRAMES = 64


def _merge(bits: int | None):
    """Merge the runs of each (bucket, slot); with ``bits``, also mark the best."""

    def written(key: tuple[int, int], runs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        opened = [(_unframed(blob) for blob in blobs) for blobs in runs]
        frames = merged(opened) if bits is None else best_marked(merged(opened), bits)
        held, seq = [], 0
        for frame in frames:
            held += _framed(*frame)
            if len(held) >= _ROW_FRAMES:
                yield _batch([(*key, seq, held)], _MERGED)
                held, seq = [], seq + 1
        if held:
            yield _batch([(*key, seq, held)], _MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs, last = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["slot"]) != key:
                    if key is not None:
                        yield from written(key, runs)
                    key, runs, last = (row["bucket"], row["slot"]), [], None
                if row["name"] != last:
                    runs.append([])
                    last = row["name"]
                runs[-1] += row["pairs"]
        if key is not None:
            yield from written(key, runs)

    return run


def _written(frame: DataFrame, purpose: str) -> DataFrame:
    folder = scratch_dir(frame.sparkSession, purpose)
    frame.write.option("compression", "none").parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def counted(runs: DataFrame, n_runs: int, bits: int) -> DataFrame:
    """(bucket, slot, seq, pairs): the count of every pair, the best of an id marked.

    ``runs`` has bucket, name and seq, whose order is that of the frames of a run.
    Every level of the tree merges ``FAN_IN`` runs of a bucket in one task.
    """
    while True:
        slots = max(1, -(-n_runs // FAN_IN))
        own = F.pmod(F.xxhash64("name"), F.lit(slots)) if slots > 1 else F.lit(0).cast("long")
        dealt = runs.select("bucket", own.alias("slot"), "name", "seq", "pairs").repartition("bucket", "slot")
        sorted_runs = dealt.sortWithinPartitions("bucket", "slot", "name", "seq")
        last = slots == 1
        out = _written(sorted_runs.mapInArrow(_merge(bits if last else None), _MERGED_DDL), "alignment-counts")
        if last:
            return out
        runs, n_runs = out.select("bucket", F.col("slot").alias("name"), "seq", "pairs"), slots


# -- contributions ----------------------------------------------------------

_SHARE_DDL = "block long, shares binary"


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each run gives to the documents of its block; tables come before runs."""
    key, tables, table = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["bucket"], row["slot"]) != key:
                key, tables, table = (row["bucket"], row["slot"]), [], None
            if row["records"] is None:
                tables += [_unframed(blob) for blob in row["pairs"]]
                continue
            if table is None:
                table, tables = [np.concatenate(column) for column in zip(*tables, strict=True)], []
            codes = np.concatenate([_unframed(blob)[0] for blob in row["pairs"]])
            held, docs, times = _opened(row["records"])
            at = np.repeat(np.searchsorted(table[0], codes), held)
            named, own = np.unique(docs, return_inverse=True)
            best, total = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
            np.add.at(best, own, times * table[2][at])
            np.add.at(total, own, times * table[1][at])
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "shares": [_squeezed(named, best, total)]})


_OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block with the shares of all its runs; documents come last."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["docs"] is None:
                held.append(_opened(row["shares"]))
                continue
            with pa.ipc.open_stream(row["docs"]) as stream:
                table = stream.read_all()
            best, total = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
            for docs, more_best, more_total in held:
                best[docs] += more_best
                total[docs] += more_total
            held = []
            table = table.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))
            names = [part.split()[0] for part in _OUT_DDL.split(", ")]
            yield from table.select(names).combine_chunks().to_batches(max_chunksize=10_000)


def align(
    documents: DataFrame,
    byte_file: str,
    piece_file: str,
    buckets: int = BUCKETS,
    run_links: int = RUN_LINKS,
) -> DataFrame:
    """Groups, links and shares in the corpus-wide counts for every document.

    ``byte_file`` is a byte-level BPE in JSON, ``piece_file`` a sentencepiece model.
    Null and empty texts, and those whose tokens do not spell the text, have no
    tokens: zeros and an empty digest. Ids are only carried along, so null and
    repeated ones are rows of their own; repeated texts count each time. An empty
    table gives no rows. Texts are read whole; long ones are encoded in chunks cut
    where both tokenizers cut anyway.
    """
    spark = ship_package(prepare(documents.sparkSession))
    for path in (byte_file, piece_file):
        spark.sparkContext.addFile(path)
    files = (Path(byte_file).name, Path(piece_file).name)
    pair = tokenizers(byte_file, piece_file)
    codes = Codes(len(pair.bytes_a), len(pair.bytes_b), buckets)
    assert codes.bits + int(codes.rows * buckets).bit_length() + BLOCK_DOCS.bit_length() < 64
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    runs = _written(rows.mapInArrow(_runs_of(files, buckets, run_links), _RUN_DDL), "alignment-runs")
    blocks, spilled = runs.filter("bucket < 0"), runs.filter("bucket >= 0")
    n_runs = spilled.select("block", "run").distinct().count()
    with batch_rows(spark, 16):
        named = spilled.select("bucket", F.concat_ws("-", "block", "run").alias("name"), F.lit(0).alias("seq"), "pairs")
        counts = counted(named, n_runs, codes.bits)
        # the table of a bucket goes to each task that has some of its runs
        slots = max(1, -(-n_runs // FAN_IN))
        table = counts.select(
            "bucket",
            F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")).alias("slot"),
            F.lit(None).cast("long").alias("block"),
            F.col("seq").alias("run"),
            "pairs",
            F.lit(None).cast("binary").alias("records"),
        )
        own = F.pmod(F.xxhash64("block", "run"), F.lit(slots)).alias("slot")
        dealt = table.unionByName(spilled.select("bucket", own, "block", "run", "pairs", "records"))
        dealt = dealt.repartition("bucket", "slot").sortWithinPartitions("bucket", "slot", F.asc_nulls_first("block"), "run")
        shares = _written(dealt.mapInArrow(_shares, _SHARE_DDL), "alignment-shares")
        sides = shares.select("block", F.lit(0).alias("side"), "shares", F.lit(None).cast("binary").alias("docs"))
        sides = sides.unionByName(
            blocks.select("block", F.lit(1).alias("side"), F.lit(None).cast("binary").alias("shares"), F.col("records").alias("docs"))
        )
        sides = sides.repartition("block").sortWithinPartitions("block", "side").drop("side")
        return _written(sides.mapInArrow(_summed, _OUT_DDL), "alignment-documents")
