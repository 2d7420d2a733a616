from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from vaultlens.llm import personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    """(start, kind, end) by the patterns as they stand."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{z}" for a, k, z in spans)


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_equal_the_patterns(seed):
    pick = random.Random(seed)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", ".", "5.6", "+1 (017) 555-7713", "+", "4111 1111 1111 1111", "-", " ", "ü", "0", "9", "é@ß.de", "(", "a@b.c@d.e.f"]
    text = "".join(pick.choice(parts) for _ in range(400))
    assert personal_data.base_spans(text) == plain_spans(text)


def test_given_documents_equal_the_patterns(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    found = personal_data.find(documents).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    assert sum(r["n_base"] for r in found) > 50
    for r in found:
        base = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[1] == n for s in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, joined(base).split(","))) <= set(filter(None, r["spans"].split(",")))


def _documents(spark, texts):
    rows = [(n, t, 1, "k", "p") for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind int, instance string, found string")


CONTEXT = [f"please write to user{n}@mail.example.com today" for n in range(6)]
CALLS = [f"office phone: +1 (20{n}) 555-010{n} or" for n in range(6)]


def test_confident_contexts_discover_unseen_identifiers(spark):
    texts = [
        *CONTEXT,
        *CALLS,
        "please write to carol [at] example [dot] org today",
        "office phone: (207) 555-0188 or",
        # the same identifier elsewhere, in a context that proves nothing
        "a b carol [at] example [dot] org c",
        # a number of that shape in another context stays
        "serial of (208) 555-0199 parts",
    ]
    found = {r["doc_id"]: r["spans"] for r in personal_data.find(_documents(spark, texts)).collect()}
    text = texts[12]
    assert found[12] == f"email:{text.index('carol')}:{text.index(' today')}"
    assert found[13] == "phone:14:28"
    assert found[14] == "email:4:32"
    assert found[15] == ""


def test_contexts_shared_with_other_numbers_prove_nothing(spark):
    texts = CALLS + [f"office phone: 555-01{n:02d} or" for n in range(40)]
    found = personal_data.find(_documents(spark, texts)).collect()
    assert all(r["spans"] == "" for r in found if r["doc_id"] >= 6)


def test_copies_add_nothing(spark):
    few = [CALLS[0], CALLS[1]] * 30 + ["office phone: (207) 555-0188 or"]
    found = personal_data.find(_documents(spark, few)).collect()
    assert next(r for r in found if r["doc_id"] == 60)["spans"] == ""


def test_known_identifiers_are_marked_however_they_are_written(spark):
    found = personal_data.find(_documents(spark, ["call +1 (017) 555-7713 now", "id 1-017-555-7713."])).collect()
    assert {r["doc_id"]: r["spans"] for r in found} == {0: "phone:5:22", 1: "phone:3:17"}
    assert [r["n_phone"] for r in sorted(found, key=lambda r: r["doc_id"])] == [1, 0]


def test_rounds_let_patterns_help_each_other(spark):
    """Patterns of seeds, instances they prove, and patterns these lift, as a plain loop."""
    pick = random.Random(3)
    edges = {(3, f"p{pick.randrange(12)}", f"i{pick.randrange(40)}") for _ in range(220)}
    seeds = {f"i{n}" for n in range(22)}
    frame = spark.createDataFrame([(*e, e[2] in seeds) for e in edges], "kind int, pattern string, instance string, seed boolean")
    score = {}
    for _ in range(personal_data.ROUNDS):
        sure = {}
        for p in {e[1] for e in edges}:
            held = {e[2] for e in edges if e[1] == p}
            if len(held & seeds) < personal_data.MIN_SEEDS or held <= seeds:
                continue
            c = (len(held & seeds) + sum(score.get(i, 0.0) for i in held - seeds)) / (len(held) + personal_data.PRIOR)
            if c >= personal_data.MIN_CONFIDENCE:
                sure[p] = c
        score = {}
        for i in {e[2] for e in edges} - seeds:
            doubt = 1.0
            for _, p, j in edges:
                if j == i and p in sure:
                    doubt *= 1 - sure[p]
            if doubt < 1.0:
                score[i] = 1 - doubt
    found = {r["instance"]: r["score"] for r in personal_data.scored(frame).collect()}
    assert found.keys() == score.keys() and found
    assert all(abs(found[i] - score[i]) < 1e-9 for i in found)


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1(" * 100_000, "+1" + "(" * 200_000])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    personal_data.occurrences(text, personal_data.base_spans(text))
    assert time.process_time() - began < 5


def test_edge_documents(spark, edge_documents, edge_rows, no_documents):
    found = personal_data.find(edge_documents).collect()
    assert len(found) == len(edge_rows)
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in found)
    assert personal_data.find(no_documents).collect() == []
