from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from vaultlens.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(rows, items, window=10):
    windows: dict = {}
    for item, text in items:
        found = words(text)
        size = min(window, len(found))
        for i in range(len(found) - size + 1) if found else ():
            windows.setdefault(tuple(found[i : i + size]), set()).add(item)
    out = []
    for doc_id, text in rows:
        found, hit, names = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(found) - size + 1):
                if (items_here := windows.get(tuple(found[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    names |= items_here
        listed = ",".join(sorted(str(n) for n in names if n is not None)).encode()
        count = len(names - {None})
        out.append((doc_id, len(found), len(hit), count, hashlib.sha256(listed).hexdigest(), bool(hit)))
    return out


def case():
    pick = random.Random(3)
    word = lambda: f"t{pick.randrange(40)}"
    items = [(n, " ".join(word() for _ in range(pick.choice([0, 1, 3, 9, 10, 11, 40])))) for n in range(40)]
    items = [(n, text) for n, text in items if len(text.split()) != 1]
    items += [(items[5][0], items[5][1]), (None, " ".join(word() for _ in range(15))), (90, None), (91, "t1, T1! t1")]
    rows = []
    for n in range(60):
        text = [word() for _ in range(pick.randrange(0, 80))]
        for _ in range(pick.randrange(0, 3)):
            source = words(pick.choice(items)[1])
            a = pick.randrange(0, len(source) + 1)
            at = pick.randrange(0, len(text) + 1)
            text[at:at] = source[a : a + pick.randrange(5, 30)]
        rows.append((n, "; ".join(text).upper() if n % 2 else " ".join(text)))
    return rows + rows[:3], items


def test_hits_are_those_of_all_windows(spark):
    rows, items = case()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.report(docs, bench)
    assert Counter(map(tuple, found.collect())) == Counter(brute_force(rows, items))


def test_several_automata_give_the_same(spark):
    rows, items = case()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = lambda block: Counter(
        (r["doc"]["doc_id"], r["n_words"], str(r["spans"]), str(r["items"]))
        for r in decontamination.mark(docs, bench, block_words=block).collect()
    )
    assert told(100_000) == told(60)


def test_edge_cases(spark, edge_documents, edge_rows, no_documents):
    items = [(1, "quick brown fox jumps over the lazy dog near the old"), (2, None), (3, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, t) for i, t, _ in edge_rows]
    found = decontamination.report(edge_documents, bench)
    assert Counter(map(tuple, found.collect())) == Counter(brute_force(rows, items))
    assert decontamination.report(no_documents, bench).collect() == []
    nothing = decontamination.report(edge_documents, bench.limit(0))
    assert {row["contaminated"] for row in nothing.collect()} == {False}


def test_passages_are_cut_and_the_rest_stays(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    around = " ".join(f"clean{n}" for n in range(30))
    docs = spark.createDataFrame(
        [(1, around, 9), (2, f"{around}. {item.upper()}! Ende, {around}", 9), (3, item, 9), (4, None, None)],
        "doc_id long, text string, n_chars long",
    )
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {row["doc_id"]: row for row in decontamination.remove(docs, bench).collect()}
    assert set(found) == {1, 2, 4}
    assert (found[1]["text"], found[1]["n_chars"]) == (around, 9)
    assert found[2]["text"] == f"{around}. ! Ende, {around}"
    assert found[2]["n_chars"] == len(found[2]["text"])
    assert found[4]["text"] is None


def test_number_of_automata_changes_no_cut(spark):
    rows, items = case()
    # 30 % by each of two items is 60 %; cutting one item joins the halves of another
    pairs = [([f"p{n}x{k}" for k in range(12)], [f"q{n}x{k}" for k in range(12)]) for n in range(12)]
    items += [(1000 + 2 * n + i, " ".join(item)) for n, pair in enumerate(pairs) for i, item in enumerate(pair)]
    items += [(2000 + n, items[n][1]) for n in range(5)]
    around = lambda n, size: " ".join(f"r{n}y{k}" for k in range(size))
    half, nested = {}, {}
    for n, (p, q) in enumerate(pairs):
        half[3000 + n] = " ".join([*p, around(n, 16), *q])
        nested[4000 + n] = (around(n, 40), [*p[:6], *q, *p[6:]])
        nested[5000 + n] = (around(n, 40), [*q[:6], *p, *q[6:]])
    rows += [*half.items(), *((doc_id, f"{text} {' '.join(inner)}") for doc_id, (text, inner) in nested.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = lambda block: Counter(map(tuple, decontamination.remove(docs, bench, block_words=block).collect()))
    one, many = left(100_000), left(60)
    assert one == many
    found = {doc_id: text for doc_id, text in many}
    assert not set(half) & set(found)
    assert all(words(found[doc_id]) == words(text) for doc_id, (text, _) in nested.items())
    assert not any(r[-1] for r in brute_force(list(found.items()), items))
