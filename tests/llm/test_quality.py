from __future__ import annotations

import re
from collections import Counter

from vaultlens.llm import quality

FILL = " ".join(f"filler{n}" for n in range(18))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    found = WORDS.findall(text or "")
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if WORDS.search(line)]
    n = len(found)
    return (
        n,
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(inside),
        n < 10 or 100 * len(inside) > 20 * n,
    )


def measured(frame):
    return Counter(
        (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in frame.collect()
    )


def test_base_rules_of_edge_cases(edge_documents, edge_rows, no_documents):
    found = quality.judge(edge_documents)
    assert measured(found) == Counter((i, *base(t)) for i, t, _ in edge_rows)
    assert quality.judge(no_documents).collect() == []


def test_repeats_that_overlap_and_touch(spark):
    texts = ["a b c d e f", "a a a a a a a a a a a a", "a b c d e a b c d e a b c d e", "x " + "p q r s t u " * 3, "É 𝒳 # & " * 6]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'h' source")
    assert measured(quality.judge(frame)) == Counter((i, *base(t)) for i, t in enumerate(texts))


def test_lines_of_many_documents_deplete_all_but_the_first(spark):
    body = lambda n, words: " ".join(f"own{n}x{k}" for k in range(words))
    rows = [(n, f"{body(n, 12)}\nShared  LINE of the host {FILL}", "h") for n in range(60)]
    rows += [(100 + n, body(100 + n, 40), "h") for n in range(60)]
    rows += [(200, f"{body(200, 60)}\nshared line of the host {FILL}", "h")]
    rows += [(300, f"{body(300, 5)} and five more words here\nshared line of the host {FILL}", "other")]
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_left_percent=50).collect()}
    assert [d for d, r in found.items() if not r["kept"]] == [d for d in found if 0 < d < 60]
    assert found[0]["words_removed"] == 0 and found[200]["words_removed"] == 23 and found[300]["words_removed"] == 0


def test_copies_of_one_document_count_once(spark):
    text = "\n".join(" ".join(f"line{n}word{k}" for k in range(12)) for n in range(4))
    rows = [(n, text, None) for n in range(80)] + [(100 + n, f"other {n} " * 1 + " ".join(f"u{n}k{k}" for k in range(20)), None) for n in range(20)]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert found.filter("kept").count() == 100


def test_clean_cuts_lines_and_keeps_columns(spark, edge_documents):
    rows = [(n, f"mine{n} " + " ".join(f"w{n}x{k}" for k in range(20)) + "\nthe same line", "h", 7, "extra") for n in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, kept string")
    cleaned = quality.clean(frame)
    assert cleaned.columns == frame.columns
    found = {r["doc_id"]: r for r in cleaned.collect()}
    assert len(found) == 40 and found[0]["text"] == rows[0][1] and found[0]["n_chars"] == 7
    assert found[5]["text"] == rows[5][1].split("\n")[0] and found[5]["n_chars"] == len(found[5]["text"])
    assert quality.clean(edge_documents).columns == edge_documents.columns


def test_lines_of_a_large_host_are_judged_by_their_count(spark):
    long, short = " ".join(f"notice{k}" for k in range(50)), "all rights reserved"
    own = lambda n: " ".join(f"own{n}x{k}" for k in range(60))
    shared = lambda n: ([long] if n < 30 or 200 <= n < 212 else []) + ([short] if 100 <= n < 130 or 200 <= n < 212 else [])
    few = lambda n: [f"rare {long}"] if 300 <= n < 310 else ["a few words"] if 310 <= n < 330 else []
    rows = [(n, "\n".join([own(n), *shared(n), *few(n)]), "h") for n in range(10_000)]
    rows += [(20_000 + n, f"{own(20_000 + n)}\n{long}", "long only") for n in range(11)]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    lost = {r["doc_id"]: r["words_removed"] for r in found.filter("words_removed > 0").collect()}
    wanted = {n: 50 for n in range(1, 30)} | {n: 3 for n in range(101, 130)} | {n: 53 for n in range(200, 212)}
    assert lost == wanted | {20_000 + n: 50 for n in range(1, 11)}


def test_documents_without_id_lose_their_common_line_too(spark):
    """One text keeps the line, with all its copies, whether ids are null or not."""
    line = " ".join(f"notice{k}" for k in range(30))
    text = lambda n: " ".join(f"own{n}x{k}" for k in range(60)) + "\n" + line
    rows = [(None, text(n), "no ids") for n in range(60)] + [(None, text(0), "no ids")] * 2
    rows += [(None if n % 2 else 1000 + n, text(n), "some") for n in range(60)]
    rows += [(None, text(n), None) for n in range(60)]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    spared = Counter((r["source"], r["doc_id"], r["content"]) for r in found.filter("words_removed = 0").collect())
    assert [source for source, *_ in spared].count("no ids") == 1 and sum(n for (s, *_), n in spared.items() if s == "no ids") in (1, 3)
    assert [(s, i) for s, i, _ in spared if s == "some"] == [("some", 1000)]
    assert [n for (s, *_), n in spared.items() if s is None] == [1]
    assert found.filter("words_removed = 30").count() == found.count() - spared.total()
