from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import __spark_entry__ as contract
from tests.llm import test_decontamination as decontamination
from tests.llm import test_licenses_urls_mixing as mixing
from tests.llm import test_near_duplicates as near
from tests.llm import test_quality as quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "kept"]
#: Words of the line that many documents of one host share.
SHARED = "this is the line that every page of the host repeats at its end"
ITEM = " ".join(f"item{n}" for n in range(24))


def rows():
    pick = random.Random(8)
    fresh = lambda n: " ".join(f"w{pick.randrange(10_000)}" for _ in range(n))
    out = []
    for n in range(60):
        out.append((n, f"{fresh(40)}\n{SHARED}", "host"))
    for n in range(60, 110):
        out.append((n, fresh(60), pick.choice(["a", "b", None])))
    for n in range(110, 130):  # near and exact copies
        words = out[n - 60][1].split(" ")
        words[3] = "changed"
        out.append((n, " ".join(words) if n % 2 else out[n - 60][1], "a"))
    for n in range(130, 140):
        out.append((n, f"{fresh(40)} {ITEM.upper()} {fresh(40)}", "b"))
    out += [(140, ITEM, "b"), (141, "too short", "a"), (142, "again and again and " * 30, "a"), (143, None, "a"), (144, "", None)]
    out += [(None, fresh(30), "a"), (70, out[70][1], out[70][2])]
    return [(i, t, "en", s, None if t is None else len(t), True) for i, t, s in out]


def expected_quality(documents):
    """Base rules, and the shared line gone from all documents of its host but the first."""
    out = []
    for doc in documents:
        if quality.base(doc[1])[-1]:
            continue
        lines = doc[1].split("\n")
        if doc[3] == "host" and doc[0] != 0 and lines[-1] == SHARED:
            text = "\n".join(lines[:-1])
            doc = (doc[0], text, doc[2], doc[3], len(text), doc[5])
        out.append(doc)
    return out


def expected_near(documents):
    gone = {r[0] for r in near.brute_force([(d[0], d[1]) for d in documents]) if not r[3]}
    return [d for d in documents if d[0] not in gone]


def expected_decontamination(documents):
    found = decontamination.brute_force([(d[0], d[1]) for d in documents], [(1, ITEM)])
    out = []
    for doc, (_, n, hit, *_) in zip(documents, found, strict=True):
        if not hit:
            out.append(doc)
        elif 2 * hit <= n:
            text = doc[1].replace(ITEM.upper(), "")
            out.append((doc[0], text, doc[2], doc[3], len(text), doc[5]))
    return out


def test_each_stage_is_its_brute_force(spark, tmp_path):
    bench = spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = rows()
    docs = spark.createDataFrame(expected, SCHEMA).repartition(4)
    steps = [expected_quality, expected_near, expected_decontamination]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "benchmark_decontamination", "mixing_sources",
    ]
    for (name, stage), step in zip(corpus_pipeline.STAGES[:3], steps, strict=True):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        expected = step(expected)
        assert docs.columns == COLUMNS
        assert Counter(map(tuple, docs.collect())) == Counter(expected)
    assert len(expected) > 80
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()
    every = mixing.mixing.mix(docs).collect()
    mixing.check_mix([(d[0], d[1], d[3]) for d in expected], every)
    assert Counter((r["doc_id"], r["source"], r["taken"]) for r in mixed) == Counter(
        (r["doc_id"], r["source"], r["taken"]) for r in every if r["taken"]
    )


def test_run_applies_all_stages(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert contract.queries()["pipeline"](spark, str(tmp_path)).count() > 60


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert found.collect() == []
