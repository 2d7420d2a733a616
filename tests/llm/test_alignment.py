from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vaultlens.llm import alignment
from vaultlens.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = [
    "Plain words of a text, and more words of a text.",
    "Größe, naïve café — 東京 ☃ 😀 á",
    "special <|endoftext|> </s> <s> <unk> <0x41> strings",
    "tabs\tand\n\nlines   with  blanks ",
    " leading and 12,345.678 numbers",
    "holds a ▁ of the other side",
    "\x00 control \x1c\x85 ᠎  blanks",
    None,
    "",
    " ",
]


@pytest.fixture(scope="module")
def plain():
    """Groups and links of one text, byte by byte."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    entries = {n: entry for entry, n in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}

    def of(text):
        if not text:
            return None
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a = [bytes(byte[c] for c in entries[n]) for n in a]
        bytes_b = []
        for n in b:
            piece = second.id_to_piece(n)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if second.is_byte(n) else piece.replace("▁", " ").encode())
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        at_a = [i for i, x in enumerate(bytes_a) for _ in x]
        at_b = [i for i, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(at_a, at_b, strict=True)))
        ends = {sum(map(len, bytes_a[: i + 1])) for i in range(len(a))}
        groups, held_a, held_b, n, m = [], [], [], 0, 0
        stops = sorted(ends & {sum(map(len, bytes_b[: i + 1])) for i in range(len(b))})
        for stop in stops:
            held_a, held_b = [], []
            while n < len(a) and sum(map(len, bytes_a[: n + 1])) <= stop:
                held_a.append(str(a[n]))
                n += 1
            while m < len(b) and sum(map(len, bytes_b[: m + 1])) <= stop:
                held_b.append(str(b[m]))
                m += 1
            groups.append(",".join(held_a) + "|" + ",".join(held_b))
        return a, b, ";".join(groups), len(groups), Counter((a[i], b[j]) for i, j in links)

    return of


def expected(rows, of):
    found = [(doc_id, of(text)) for doc_id, text in rows]
    counts = sum((x[4] for _, x in found if x), Counter())
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, text, groups, links = x
        best = sum(n for pair, n in links.items() if counts[pair] == top[pair[1]])
        total = sum(n * counts[pair] for pair, n in links.items())
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append((doc_id, len(a), len(b), groups, sum(links.values()), best, total, digest))
    return sorted(out, key=repr)


def test_rows_equal_brute_force(spark, rows, plain, monkeypatch):
    table = [(n, text) for n, text in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[1]), (None, None)]
    documents = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in table], "doc_id long, text string, block long, pairs string, slot int")
    wanted = expected(table, plain)
    assert rows(alignment.align(documents.repartition(3), A, B)) == wanted
    # many small runs: several levels of merges, and runs of one bucket over several tasks
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    assert rows(alignment.align(documents.repartition(3), A, B, buckets=3, run_links=10)) == wanted


def test_given_documents_equal_brute_force(spark, rows, plain):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    table = [(r["doc_id"], r["text"][:3000]) for r in documents.collect()]
    short = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(alignment.align(short, A, B)) == expected(table, plain)


def test_long_texts_are_cut_where_both_sides_cut(monkeypatch):
    pair = alignment.tokenizers(A, B)
    text = " ".join(["Some words, naïve; and 12 more.  Two blanks\nthen a line"] * 200)
    whole = pair.encoded(text)
    assert len(whole) == 1
    monkeypatch.setattr(alignment, "CHUNK", 500)
    cut = pair.encoded(text)
    assert len(cut) > 10
    for side in (0, 1):
        assert np.concatenate([x[side] for x in cut]).tolist() == whole[0][side].tolist()


def test_ranks_encode_as_the_library_does():
    pair = alignment.tokenizers(A, B)
    text = "It's THE café's, naïve: don't we'll 12ab 3.4 $$ <|endoftext|>  \n\n x \t y ¡¿ Ünïcode Ωmega"
    assert pair.ranked.encode_ordinary(text) == pair.library.encode(text, add_special_tokens=False).ids


def test_no_documents(spark, no_documents):
    assert alignment.align(no_documents, A, B).collect() == []


def test_edge_documents(spark, rows, plain, edge_rows, edge_documents):
    small = [(i, t) for i, t, _ in edge_rows if not t or len(t) < 1000]
    kept = edge_documents.filter("text is null or length(text) < 1000")
    assert rows(alignment.align(kept, A, B)) == expected(small, plain)
    long = [row for row in alignment.align(edge_documents, A, B).collect() if row["doc_id"] in (10, 11)]
    assert all(row["n_links"] >= row["n_a"] > 60_000 for row in long)
