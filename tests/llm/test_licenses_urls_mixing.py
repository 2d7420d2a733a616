from __future__ import annotations

import random
from collections import Counter, defaultdict

from tests.llm.test_decontamination import words
from vaultlens.llm import licenses, mixing, urls


def license_rows(rows):
    """All phrases at all places, all notices against all blocks."""
    out = []
    for doc_id, text in rows:
        found = words(text)
        places, labels = [], set()
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(found) - len(p) + 1) if found[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        best, more = 0.0, set(labels)
        for start in range(0, max(1, len(found) - 32), 32):
            block = set(found[start : start + 64])
            for label, notice in licenses.NOTICES:
                tokens = set(notice.split())
                common = len(tokens & block)
                if 100 * common >= 80 * len(tokens):
                    best = max(best, common / len(tokens))
                    more.add(label)
        out.append(
            (doc_id, len(found), len(places), min(places, default=None), max(places, default=None),
             ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if places else best)
        )
    return out


def test_license_scan_is_that_of_all_pairs(spark):
    pick = random.Random(2)
    pool = [w for _, n in licenses.NOTICES for w in n.split()] + [f"z{k}" for k in range(80)]
    rows = []
    for n in range(120):
        text = [pick.choice(pool) for _ in range(pick.randrange(0, 200))]
        if n % 3 == 0:
            notice = pick.choice(licenses.NOTICES)[1].split()
            del notice[pick.randrange(len(notice))]
            text[pick.randrange(len(text) + 1) :][:0] = notice
            text = text[: len(text) // 2] + notice + text[len(text) // 2 :]
        rows.append((n, ", ".join(text)))
    rows += [(500, "CC BY NC cc by nc; cc BY-NC"), (501, "Under the \u212aelvin MIT license, under the mit license"), (502, "under the m\u0130t license")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, found.collect())) == Counter(license_rows(rows))


def test_license_scan_of_edge_cases(edge_documents, edge_rows, no_documents):
    found = licenses.scan(edge_documents)
    assert Counter(map(tuple, found.collect())) == Counter(license_rows([(i, t) for i, t, _ in edge_rows]))
    assert licenses.scan(no_documents).collect() == []


URLS = [
    (1, None), (2, ""), (3, "no scheme/x"), (4, "HTTP://A.Example.COM/de/x?page=2"), (5, "http://example.com/de"),
    (6, "http://notexample.com/de/"), (7, "https://x.net"), (8, "https://x.net/?a"), (9, "http://example.net/en/login"),
    (10, "http://org/fr/cart"), (11, "http://x.org/en/login?u=1"), (12, "http://x.org/en/loginless"), (12, "http://x.org/en/loginless"),
    (13, "http://x.org/a?page=12#top"), (14, "http://x.org/a?apage=12"), (15, "http://u@x.net:80/a"), (16, "a://b://c/d?e"),
    (17, "https://win.CASINO-best.io/"), (18, "http://x.org/" + "a/" * 20000 + "cart"), (19, "http://é.org/fr/\nx"), (None, "http://x.org/tag/a/page/3"),
]


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "v", "h") for i, u in URLS], "page_id long, url string, verdict string, host string")
    found = {(r["page_id"], r["url"] if "url" in r else None): r for r in urls.judge(frame).collect()}
    verdicts = {k[0]: (r["host"], r["path"][:8], r["rule"], r["verdict"], r["patterns"]) for k, r in found.items()}
    assert verdicts == {
        1: ("", "", None, "allow", None), 2: ("", "", None, "allow", None), 3: ("", "", None, "allow", None),
        4: ("a.example.com", "/de/x", "example.com/de/", "block", "listing"), 5: ("example.com", "/de", None, "allow", None),
        6: ("notexample.com", "/de/", None, "allow", None), 7: ("x.net", "", None, "allow", None),
        8: ("x.net", "/", "net/", "block", None), 9: ("example.net", "/en/logi", "example.net/en/", "allow", "login"),
        10: ("org", "/fr/cart", "org/fr/", "allow", "cart"), 11: ("x.org", "/en/logi", None, "block", "login"),
        12: ("x.org", "/en/logi", None, "allow", None), 13: ("x.org", "/a", None, "block", "listing"),
        14: ("x.org", "/a", None, "allow", None), 15: ("u@x.net:80", "/a", None, "allow", None), 16: ("b:", "//c/d", None, "allow", None),
        17: ("win.casino-best.io", "/", None, "block", "casino"), 18: ("x.org", "/a/a/a/a", None, "block", "cart"),
        19: ("é.org", "/fr/\nx", "org/fr/", "allow", None), None: ("x.org", "/tag/a/p", None, "block", "tag"),
    }
    assert urls.judge(frame).filter("page_id = 12").count() == 2
    assert urls.judge(frame.limit(0)).collect() == []


def targets_by_filling(sizes):
    """Shares by weight, capped at twice the size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(capped.values()), [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in above}


def check_mix(rows, found):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    wanted = targets_by_filling(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6
        assert r["taken"] >= r["epochs"] * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 1


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 20)
    pick = random.Random(1)
    names = ["a", "b", "Z", None, "é", "zz", "empty"]
    rows = [(n, "w " * pick.randrange(1, 40), pick.choices(names[:6], [60, 5, 20, 3, 9, 3])[0]) for n in range(400)]
    rows += [(1000, "", "empty"), (1001, None, "empty"), (5, "w w w", "a"), (5, "w w w", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(frame.repartition(7)).collect()
    check_mix(rows, found)
    again = mixing.mix(frame.repartition(3)).collect()
    assert Counter((r["doc_id"], r["source"], r["taken"]) for r in found) == Counter((r["doc_id"], r["source"], r["taken"]) for r in again)


def test_mix_of_edge_cases(edge_documents, edge_rows, no_documents):
    check_mix(edge_rows, mixing.mix(edge_documents).collect())
    assert mixing.mix(no_documents).collect() == []


def test_better_documents_come_earlier(spark):
    rows = [(n, ("# " * 30 if n % 2 else "word " * 30), "s" if n < 3000 else "t") for n in range(3200)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 100), total_percent=30)
    by = found.filter("source = 's' AND part = size").groupBy(found["doc_id"] % 2).count().collect()
    counts = dict(map(tuple, by))
    assert counts[0] > 1.5 * counts[1]


def test_rows_without_id_spread_over_the_buckets(spark):
    """A third of the rows has no id: their keys differ, and no bucket holds them all."""
    rows = [(None if n % 3 == 0 else n, " ".join(f"w{n}x{k}" for k in range(5)), "s") for n in range(9_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = mixing.sizes_and_keys(frame).filter("doc_id IS NULL")
    assert keys.select("key").distinct().count() == 3_000
    sizes = keys.selectExpr("floor((1 - exp(-key)) * 4) bucket").groupBy("bucket").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 900
    found = mixing.mix(frame).collect()
    assert len(found) == 9_000 and all(r["taken"] <= 2 * r["size"] for r in found)
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 1
