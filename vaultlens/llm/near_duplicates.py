"""MinHash near-dedup by an inverted join of signature coordinates.

A signature has ``COORDINATES`` coordinates; each coordinate with its value is a
token, and documents are posted under their tokens. A pair with a similarity of
0.75 shares ``MATCHES`` tokens or more but for a chance of some 4 in 10**8. Pairs
that share so many must share one of the first ``count - MATCHES + 1`` of a
document's tokens, rarest first; tokens of one document alone come first of all
and need no posting. Equal sets are one class before that, so copies make no
pairs.

Only links that can join components are looked for: first each posting's members
with its smallest one; then, where a posting still has members of different
components, those with each other. The merge of such a posting runs inside a task
on blocks of its members, skips pairs of one component, and emits only pairs that
a bound on the common shingles allows. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm import hashing
from vaultlens.llm.graph import components
from vaultlens.llm.tasks import binaries, prepare
from vaultlens.session import scratch_dir

SHINGLE_WORDS = 5
#: Least similarity in percent.
MIN_PERCENT = 75
COORDINATES = 32
#: Tokens that a pair must share.
MATCHES = 10
#: Bits of the map that bounds how many shingles two documents have in common.
MAP_BITS = 1024
#: Members of a posting that one task compares with as many others.
BLOCK = 4096

_SEEDS = hashing.mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_CHUNK = 1 << 14


def signature(values: np.ndarray) -> np.ndarray:
    """A token for each coordinate: the least of the set's hashes under its seed."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), _CHUNK):
        x = values[start : start + _CHUNK, None] ^ _SEEDS
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        np.minimum(least, x.min(axis=0), out=least)
    return hashing.mixed(least + _SEEDS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of the texts, beside the other columns."""
    for batch in batches:
        keys = [name for name in batch.schema.names if name != "text"]
        counts, digests, tokens = [], [], []
        for text in binaries(batch.column("text")):
            values = hashing.shingles(text, SHINGLE_WORDS)
            counts.append(len(values))
            digests.append(hashing.digest(values))
            tokens.append(signature(values).view(np.int64) if len(values) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(name) for name in keys),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(tokens, pa.list_(pa.int64())),
            ],
            [*keys, "n_shingles", "digest", "tokens"],
        )


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= MIN_PERCENT * (len(one) + len(other) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values = lru_cache(16)(lambda text: hashing.shingles(text, SHINGLE_WORDS))
    for batch in batches:
        left, right = (binaries(batch.column(name)) for name in ("left", "right"))
        keep = pa.array([similar(values(x), values(y)) for x, y in zip(left, right, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _with_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for text in binaries(batch.column("text")):
            bits = np.zeros(MAP_BITS, np.uint8)
            bits[hashing.shingles(text, SHINGLE_WORDS) % np.uint64(MAP_BITS)] = 1
            maps.append(np.packbits(bits).tobytes())
        yield batch.append_column("map", pa.array(maps, pa.binary()))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each posting (rows in order of token and blocks) that may be links."""
    key, held = None, []

    def flush():
        pairs = _candidates(key, held) if len(held) > 1 else []
        if pairs:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, _PAIR)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("token", "low", "high", "own", "node", "component", "n", "shared", "map")]
        for token, low, high, *member in zip(*columns, strict=True):
            if (token, low, high) != key:
                yield from flush()
                key, held = (token, low, high), []
            held.append(member)
    yield from flush()


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(key: tuple[int, int, int], members: list) -> list[tuple[int, int]]:
    """Pairs of different components and, for two blocks, of both of them.

    Members of the largest component are not compared with each other. A pair is
    left to the first posting, in the order of tokens, that both are in.
    """
    token, low, high = key
    component = np.array([m[2] for m in members])
    names, counts = np.unique(component, return_counts=True)
    if len(names) < 2:
        return []
    order = np.argsort(component == names[counts.argmax()], kind="stable")
    members = [members[i] for i in order]
    component = component[order]
    own = np.array([m[0] for m in members])
    node = np.array([m[1] for m in members])
    size = np.array([m[3] for m in members])
    bits = np.frombuffer(b"".join(m[5] for m in members), np.uint64).reshape(len(members), -1)
    set_bits = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    loss = size - set_bits  # shingles that share a bit with another of the same set
    tokens = [set(m[4]) for m in members]
    prefixes = [m[4][: len(m[4]) - MATCHES + 1] for m in members]
    out = []
    for i in range(len(members) - int(counts.max())):
        rest = slice(i + 1, None)
        near = (component[rest] != component[i]) & (node[rest] != node[i])
        near &= np.minimum(size[rest], size[i]) * 100 >= np.maximum(size[rest], size[i]) * MIN_PERCENT
        if low != high:
            near &= own[rest] != own[i]
        others = np.flatnonzero(near) + i + 1
        if not len(others):
            continue
        both = np.bitwise_count(bits[others] & bits[i]).sum(axis=1).astype(np.int64)
        common = both + np.minimum(loss[others], loss[i])
        allowed = common * (100 + MIN_PERCENT) >= MIN_PERCENT * (size[others] + size[i])
        for j in others[allowed]:
            shared = tokens[i] & tokens[j]
            if len(shared) < MATCHES:
                continue
            ours, theirs = set(prefixes[i]), set(prefixes[j])
            if min(ours & theirs) == token:
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return out


def _written(frame: DataFrame, purpose: str) -> DataFrame:
    folder = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def posted(classes: DataFrame) -> DataFrame:
    """(node, n, shared): the classes that can have links, and their tokens, rarest first.

    ``classes`` are the distinct sets (node, n, tokens). ``shared`` leaves out tokens
    that no other class has.
    """
    tokens = classes.select("node", "n", F.explode("tokens").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    return (
        tokens.join(frequent, "token")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        .filter(F.size("shared") >= MATCHES)
        .select("node", "n", F.col("shared.token").alias("shared"))
    )


def _countable(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and common tokens allow the similarity."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("ta"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("tb"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * MIN_PERCENT)
        .filter(F.size(F.array_intersect("ta", "tb")) >= MATCHES)
        .select("a", "b")
    )


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(_confirm, "a long, b long")


def _across(held: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in postings (token, node, component)."""
    several = (
        held.groupBy("token")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"))
        .filter("x < y")
        .select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        held.join(several, "token")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .join(nodes, "node")
        .join(texts.select("node", "map"), "node")
        .select("token", "low", "high", "own", "node", "component", "n", "shared", "map")
    )
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(parts, "token", "low", "high")
        .sortWithinPartitions("token", "low", "high")
        .mapInArrow(_merge, "a long, b long")
        .distinct()
    )


def links(given: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the classes with a link to another, from texts (node, text)."""
    postings = _written(
        nodes.select("node", F.explode(F.slice("shared", 1, F.size("shared") - (MATCHES - 1))).alias("token")),
        "postings",
    )
    texts = given.join(nodes.select("node"), "node", "left_semi")
    texts = _written(texts.mapInArrow(_with_map, "node long, text string, map binary"), "texts")
    hubs = postings.groupBy("token").agg(F.min("node").alias("a"))
    stars = postings.join(hubs, "token").filter("node > a").select("a", F.col("node").alias("b")).distinct()
    stars = _written(_countable(stars, nodes), "stars")
    first = _written(_confirmed(stars, texts), "links")
    held = postings.join(components(first), "node", "left").select(
        "token", "node", F.coalesce("component", "node").alias("component")
    )
    across = _written(_across(held, nodes, texts), "across").join(stars, ["a", "b"], "left_anti")
    more = _written(_confirmed(across, texts), "links")
    return components(first.unionByName(more))


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    A document of fewer words than a shingle has one shingle, one without words
    none and no links. Rows that share an id count as one document for links and
    keep a row each. A null id links by equal sets only. Repeated rows give
    repeated rows, an empty table none. Texts are read whole.
    """
    prepare(documents.sparkSession)
    given = documents.select("doc_id", "text")
    schema = "doc_id long, n_shingles long, digest binary, tokens array<long>"
    sketches = _written(given.mapInArrow(_sketch, schema), "sketches")
    named = (
        sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    )
    nodes = _written(posted(_written(named, "classes")), "nodes")
    linked = links(given.withColumnRenamed("doc_id", "node"), nodes)
    classes = (
        sketches.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"))
        .join(linked, "node", "left")
        .select("digest", F.coalesce("component", "node").alias("component"))
    )
    found = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        sketches.select("doc_id", "n_shingles", "digest")
        .join(classes, "digest", "left")
        .select("doc_id", "n_shingles", found.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def content(text: Column) -> Column:
    """Digest of a text; with the id it tells rows apart that differ in either."""
    return F.md5(F.coalesce(text, F.lit("")))


def _gone(documents: DataFrame) -> DataFrame:
    """(doc_id, content) of the rows whose component has another representative.

    A class is a distinct set with a number of its own, whatever ids its rows have,
    and is linked by the text of its first row. The first row of a component, in the
    order of ids with null ids last, represents it.
    """
    keyed = documents.select("doc_id", content(F.col("text")).alias("content"), "text")
    schema = "doc_id long, content string, n_shingles long, digest binary, tokens array<long>"
    sketches = _written(keyed.mapInArrow(_sketch, schema), "sketches").filter("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content")
    classes = _written(
        sketches.groupBy("digest")
        .agg(F.min(place).alias("row"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    nodes = _written(posted(classes), "nodes")
    wanted = classes.join(nodes.select("node"), "node", "left_semi").select(
        "node", F.col("row.doc_id").alias("id"), F.col("row.content").alias("of")
    )
    texts = (
        keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("of")))
        .select("node", "text")
        .dropDuplicates(["node"])
    )
    own = classes.join(links(texts, nodes), "node", "left").select(
        "digest", "row", F.coalesce("component", "node").alias("component")
    )
    firsts = own.groupBy("component").agg(F.min("row").alias("first"))
    of_class = own.join(firsts, "component").select("digest", "first")
    return (
        sketches.select("doc_id", "content", "digest")
        .join(of_class, "digest")
        .filter(
            ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            | (F.col("doc_id").isNull() & (F.col("content") != F.col("first.content")))
        )
        .select("doc_id", "content")
        .distinct()
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The document with the smallest id of every component; all columns stay.

    Rows are judged by their own text: one of an id's texts may go and another stay.
    Of rows of a component that share its smallest id, each stays. A null id is no
    id: such rows are linked as others are, go where a row with an id is in their
    component, and else one of them stays. Rows without words all stay.
    """
    prepare(documents.sparkSession)
    gone = _gone(documents.select("doc_id", "text")).select(
        F.col("doc_id").alias("gone_id"), F.col("content").alias("gone_content")
    )

    def left(rows: DataFrame) -> DataFrame:
        given = rows.select(F.struct("*").alias("doc"))
        same = F.col("doc.doc_id").eqNullSafe(F.col("gone_id")) & (
            content(F.col("doc.text")) == F.col("gone_content")
        )
        return given.join(gone, same, "left_anti")

    with_words = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    nameless = F.col("doc_id").isNull() & with_words
    once = (
        left(documents.filter(nameless))
        .withColumn("content", content(F.col("doc.text")))
        .dropDuplicates(["content"])
        .select("doc")
    )
    return left(documents.filter(~nameless)).unionByName(once).select("doc.*")
