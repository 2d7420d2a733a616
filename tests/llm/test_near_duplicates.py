from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from vaultlens.llm import near_duplicates
from vaultlens.llm.graph import components


def brute_force(rows):
    """(doc_id, n_shingles, component, kept) from all pairs of ids."""
    sets: dict = {}
    own = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        found = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        own.append((doc_id, found))
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(found)
    linked = {doc_id: doc_id for doc_id in sets}
    alike = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y)
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if any(alike(x, y) for x in sets[a] for y in sets[b]) and linked[b] < linked[a]:
                    linked[a] = linked[b]
                    changed = True
    out = []
    for doc_id, found in own:
        if doc_id is None:
            same = [linked[d] for d, all_sets in sets.items() if found and found in all_sets]
            component = min(same) if same else None
        else:
            component = linked[doc_id] if found else doc_id
        out.append((doc_id, len(found), component, doc_id == component))
    return out


def corpus():
    """Copies, chains of near copies, and texts that share a long passage."""
    pick = random.Random(5)
    word = lambda: f"v{pick.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for group in range(12):
        base = [word() for _ in range(120)]
        for copy in range(10):
            text = list(base)
            for _ in range(pick.randrange(0, 5)):
                text[pick.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
            if copy % 3 == 0:
                base = text  # drifts away from the first
    for _ in range(80):
        rows.append((len(rows), " ".join([*passage, *(word() for _ in range(pick.randrange(5, 60)))])))
    rows += [(len(rows) + n, rows[n][1]) for n in range(0, 60, 7)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 8])
def test_components_are_those_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = corpus()
    found = near_duplicates.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(map(tuple, found.collect())) == Counter(brute_force(rows))


def test_edge_cases(edge_documents, edge_rows):
    found = near_duplicates.find(edge_documents)
    assert Counter(map(tuple, found.collect())) == Counter(brute_force([(i, t) for i, t, _ in edge_rows]))


def test_no_rows(no_documents):
    assert near_duplicates.find(no_documents).collect() == []


def test_kept_documents_keep_their_columns(edge_documents):
    kept = near_duplicates.keep_one(edge_documents)
    assert kept.columns == edge_documents.columns
    ids = [row["doc_id"] for row in kept.collect()]
    assert 5 not in ids and 7 not in ids and 11 not in ids
    assert ids.count(6) == 2 and {1, 2, 3, 4, 10, 12} <= set(ids)


def kept_rows(rows):
    """Rows kept of (doc_id, text), from all pairs of rows."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    out = Counter()
    for g in set(group):
        members = [rows[n] for n in range(len(rows)) if group[n] == g]
        ids = [doc_id for doc_id, _ in members if doc_id is not None]
        words = any(sets[n] for n in range(len(rows)) if group[n] == g)
        if ids:
            out.update(m for m in members if m[0] == min(ids))
        else:
            out.update([min(members, key=lambda m: hashlib.md5((m[1] or "").encode()).hexdigest())] if words else members)
    return out


def test_rows_without_id_or_of_a_shared_id_are_judged_by_their_text(spark):
    pick = random.Random(9)
    fresh = lambda: " ".join(f"v{pick.randrange(4000)}" for _ in range(60))
    near = lambda text: text.replace(text.split()[0], "other", 1)
    a, b, c, d, e, f = (fresh() for _ in range(6))
    rows = [(1, a), (None, a), (None, fresh()), (None, fresh())]  # one null id is a copy
    rows += [(2, b), (None, near(b)), (None, near(near(b)))]  # null ids near a document
    rows += [(9, near(a)), (9, fresh()), (9, fresh())]  # one text of an id is a near copy
    rows += [(None, c), (None, near(c)), (None, c), (None, c.upper())]  # null ids alone
    rows += [(None, d), (None, d), (None, None), (None, ""), (None, " "), (None, None), (20, ""), (20, "")]
    rows += [(30, e), (30, e), (30, near(e)), (31, e), (40, f), (12, near(f)), (None, f)]
    # a null id joins two documents that are not near each other
    chain = [f"c{k}" for k in range(60)]
    rows += [(50, " ".join(chain)), (None, " ".join([*chain[5:], *(f"x{k}" for k in range(5))])),
             (51, " ".join([*chain[10:], *(f"x{k}" for k in range(10))]))]
    frame = spark.createDataFrame([(*r, "extra", "of") for r in rows], "doc_id long, text string, content string, gone_id string")
    kept = near_duplicates.keep_one(frame.repartition(3))
    assert kept.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == kept_rows(rows)
    assert sum(kept_rows(rows).values()) < len(rows)


def test_signature_hashes_follow_the_texts():
    one = near_duplicates.hashing.shingles(b"a b c d e f", 5)
    assert len(one) == 2
    assert set(one) == set(near_duplicates.hashing.shingles(b"A  b\tc d E\nf", 5))
    assert not set(one) & set(near_duplicates.hashing.shingles(b"ab c d e f g", 5))


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(n, n + 1) for n in range(0, 30)]
    star = [(100, n) for n in range(101, 140)]
    ring = [(200 + n, 200 + (n + 1) % 9) for n in range(9)]
    edges = spark.createDataFrame(path + star + ring + [(300, 300)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert found == {n: 0 for n in range(31)} | {n: 100 for n in range(100, 140)} | {n: 200 for n in range(200, 209)}
