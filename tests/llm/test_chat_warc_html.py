from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from html import unescape

import pyarrow.dataset as ds

from vaultlens.llm import chat, html, warc
from vaultlens.llm.queries import SPECIAL

NASTY = [
    "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\n<|text|>x", "<\\|turn|> <\\\\| [\\INST]", "[[INST]", "ends with <", "\\", "",
    "<|", "|>", "</s", "<s>", "[/INST", '{"a": [1, "x"]}', "[INST] \u00e9\U0001d4b3\x00\x1f\u2028", "\n\n", "<<|end|>\n",
]


def told(conv_id, turns):
    join = "".join(f"{role}\n{text}\n" for role, text in turns)
    loss = "".join(text for role, text in turns if role == "assistant")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return conv_id, len(turns), digest(join), len(loss), digest(loss)


def formatted(frame):
    return {tuple(r)[:5] for r in chat.digests(chat.formatted(chat.canonical(frame))).collect()}


def test_control_strings_come_back(spark):
    rows = [(n, t, "assistant" if t % 2 else "user", NASTY[(n + t) % len(NASTY)]) for n in range(len(NASTY)) for t in range(4)]
    rows += [(900, 0, "odd\nrole\\n\\b", "x"), (901, 0, None, None), (901, None, "assistant", "first"), (None, 1, "user", "u"), (902, 0, "user", "y"), (902, 0, "user", "y")]
    frame = spark.createDataFrame([(*r, "e", "l") for r in rows], "conv_id long, turn long, role string, text string, turns string, layout string")
    wanted = set()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        wanted.add(told(conv, [(r[2] or "", r[3] or "") for r in turns]))
    assert formatted(chat.rows_as_records(frame)) == wanted


def test_layouts_become_the_same_turns(spark):
    u, a, s = "Ask </s>?", "Answer [INST]", "Be brief"
    records = [
        SPECIAL,
        (1, 0, json.dumps({"prompt": u, "response": a})),
        (2, 0, json.dumps({"id": 7, "prompt": u, "completion": a, "meta": {"role": "x"}})),
        (3, 0, json.dumps({"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a, "weight": 1}]})),
        (4, 0, json.dumps({"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}]})),
        (5, 0, json.dumps({"instruction": u, "output": a})),
        (6, 0, json.dumps({"instruction": s, "input": u, "output": a})),
        (7, 0, json.dumps({"question": u, "answer": a})),
        (8, 0, json.dumps({"title": u})),
        (9, 0, "no json"),
        (10, 0, None),
    ]
    frame = spark.createDataFrame(records, "conv_id long, turn long, record string")
    two = [("user", u), ("assistant", a)]
    trick = "</s>[INST] ok [/INST]"
    assert formatted(frame) == {told(n, two) for n in (1, 2, 3, 4, 5, 7)} | {
        told(6, [("system", s), *two]), told(-7, [("user", trick), ("assistant", trick)]),
    }
    unknown = chat.canonical(frame).filter("layout IS NULL")
    assert {r["conv_id"] for r in unknown.collect()} == {8, 9, 10}
    assert chat.digests(chat.formatted(chat.canonical(frame.limit(0)))).collect() == []


def test_records_with_fields_of_other_layouts(spark):
    u, a, s = "Ask", "Answer", "Be brief"
    messages = [{"role": "user", "content": u}, {"role": "assistant", "content": a}]
    two = [("user", u), ("assistant", a)]
    good = {
        1: ({"instruction": s, "input": u, "output": a, "text": "all of it"}, [("system", s), *two]),
        2: ({"prompt": u, "messages": messages}, two),
        3: ({"question": u, "answer": a, "text": "x", "role": "y", "input": None}, two),
        4: ({"messages": [], "prompt": u, "response": a}, two),
        5: ({"conversations": [{"from": "human", "value": u, "role": "r"}, {"from": "gpt", "value": a}], "text": "t", "output": "o"}, two),
        6: ({"instruction": u, "output": a, "messages": "none", "completion": "c"}, two),
    }
    bad = {
        20: (json.dumps({"messages": []}), "no messages"), 21: (json.dumps({"conversations": [], "text": "t"}), "no messages"),
        22: (json.dumps({"prompt": u, "text": a}), "no declared layout"), 23: ("{}", "no declared layout"), 24: ("[1]", "no JSON object"),
        25: ("no json", "no JSON object"), 26: (None, "no JSON object"), 27: (json.dumps({"messages": ["x"]}), "no declared layout"),
    }
    rows = [(n, 0, json.dumps(record)) for n, (record, _) in good.items()] + [(n, 0, record) for n, (record, _) in bad.items()]
    rows += [(1, 1, bad[22][0])]  # beside a record that is written
    frame = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    assert formatted(frame) == {told(n, turns) for n, (_, turns) in good.items()}
    wanted = {(n, 0, record, reason) for n, (record, reason) in bad.items()} | {(1, 1, *bad[22])}
    assert set(map(tuple, chat.unmatched(chat.canonical(frame)).collect())) == wanted


def pages_case():
    same, small = "s" * 150, "t" * 99
    return [
        (5, "http://a/", same), (3, "http://b/ x\r\nInjected: 1", same), (9, None, same), (3, "http://b/2", same), (4, "u", small), (1, "u", small),
        (7, "u", None), (8, "u", ""), (2, "u", "é" * 50), (6, "u", "é" * 50), (None, "u", "n" * 200), (None, "u", "n" * 200),
        (10, "u", "WARC/1.1\r\n\r\n" * 30), (11, "u", "x" * 3_000_000), (12, "u", "only one " * 30),
    ]


def test_warc_round_trip(spark, tmp_path):
    rows = pages_case()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, kind int").repartition(4)
    manifest = warc.write(frame, str(tmp_path / "w"), shard_bytes=1000, roll_bytes=2000)
    found = warc.read(spark, str(tmp_path / "w"), payloads=True).collect()
    first = {}
    for page_id, _, text in rows:
        if len((text or "").encode()) >= 100:
            ids = [i for i, _, t in rows if t == text and i is not None]
            first[text] = min(ids, default=None)
    seen, wanted = set(), Counter()
    for page_id, _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        kind = "revisit" if text in first and (page_id != first[text] or text in seen) else "response"
        seen.add(text)
        wanted[(page_id, len(data), hashlib.sha256(data).hexdigest(), kind, first[text] if kind == "revisit" else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == wanted
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in found if r["record_type"] == "response")
    files = {r["file"]: r["sha256"] for r in manifest.collect()}
    assert len(files) > 3
    assert {n: hashlib.sha256((tmp_path / "w" / n).read_bytes()).hexdigest() for n in files} == files
    again = warc.write(frame.repartition(2), str(tmp_path / "again"), shard_bytes=1000, roll_bytes=2000)
    assert {r["file"]: r["sha256"] for r in again.collect()} == files
    assert not (tmp_path / "w" / "_temporary").exists()


def test_warc_of_no_pages(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(frame, str(tmp_path / "w")).count() == 0
    assert warc.read(spark, str(tmp_path / "w")).collect() == []


def by_markup(page):
    """Main text of the given pages, which mark their article."""
    inner = re.split("</article>|<footer>", page.split("<article>", 1)[1])[0]
    return " ".join(unescape(" ".join(re.split("<[^>]*>", inner))).split())


def test_html_of_the_given_pages(spark):
    folder = "/root/testdata/sf0.01/pages.parquet"
    rows = ds.dataset(folder).to_table().to_pylist()
    found = {r["page_id"]: r for r in html.extract(spark.read.parquet(folder)).collect()}
    assert len(found) == len(rows)
    for row in rows:
        assert found[row["page_id"]]["text"] == by_markup(row["html"])
        assert found[row["page_id"]]["n_chars"] == len(by_markup(row["html"]))


LONG = "A long paragraph of the story that says what happened on the day, with all that belongs to it."


def test_html_of_other_layouts_and_edge_cases(spark):
    cases = {
        1: (None, ""), 2: ("", ""), 3: ("   ", ""), 4: ("plain words", "plain words"), 5: (f"<p>{LONG}<p>Two &amp; &lt;x&gt;&nbsp;y", f"{LONG} Two & <x> y"),
        6: (f'<body><div class="cookie-banner">We use cookies</div><div class="post-content"><h2>T</h2><p>{LONG} <em>Two</em>three<br>four</p></div>'
            '<div id="comments"><p>Reader says that it is a very good story overall, really.</p></div></body>', f"T {LONG} Twothree four"),
        7: (f"<main><h1>Head</h1><p>{LONG}</p><aside>Side</aside><p>End.</p><form><p>Mail</p></form></main><footer>{LONG}</footer>", f"Head {LONG} End."),
        8: (f"<article><p>{LONG}</p><script>if (a < b) document.write('<p>no</p>')</script><!-- <p>no</p> --><p>Last", f"{LONG} Last"),
        9: ("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>", " ".join([LONG] * 3000)),
        10: ("<div>" * 3000 + f"<p>{LONG}</p>", LONG),
        11: ("<<<>><p", "<<<>>"),
    }
    rows = [(n, f"u{n}", page, "x") for n, (page, _) in cases.items()] + [(4, "u4", "plain words", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract(frame).collect()
    assert len(found) == len(rows)
    assert {r["page_id"]: r["text"] for r in found} == {n: text for n, (_, text) in cases.items()}
    assert html.extract(frame.limit(0)).collect() == []


def test_html_hides_by_attributes_only_and_keeps_math():
    model = html.Model(html.seed_counts())
    shown = ['title="The hidden valley"', "title='a hidden b'", 'data-title="A hidden gem"', 'class="prose hidden md:block"', 'aria-hidden="false"',
             """onclick="this.style='display:none'" """, 'data-style="display:none"', 'style="display:nonesuch"', 'alt="x"title="hidden y"', '"hidden words"',
             'title="a class=\'ad\' id=footer"', 'title=hidden', 'title = " hidden "']
    for attributes in shown:
        assert model.extract(f"<article {attributes}><p>{LONG}</p><p>Last</p></article>") == f"{LONG} Last", attributes
        assert model.extract(f"<article><p>{LONG} <a {attributes}>link</a> end.</p></article>") == f"{LONG} link end.", attributes
    for attributes in ["hidden", "HIDDEN", 'hidden=""', "hidden=until-found", "class=x hidden", "title='y'hidden/", 'style="color:red; DISPLAY : none !important"', "style=display:none", 'style="display&#58;none"']:
        page = f"<article><p>{LONG}</p><div {attributes}><p>Unseen {LONG}</p></div><p>Last</p></article>"
        assert model.extract(page) == f"{LONG} Last", attributes
    formula = "<math display='block'><mrow><mi>a</mi><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup></mrow></math>"
    assert model.extract(f"<article><p>{LONG} With {formula} it holds.</p></article>") == f"{LONG} With a+b2 it holds."


def test_marginals_are_those_of_all_assignments():
    model = html.Model(html.seed_counts())
    page = html.Page(f"<body><nav><a href='/'>x</a></nav><div class='post'><p>{LONG}</p><p>No.</p></div><footer>f</footer></body>")
    names, count = page.features(), len(page.parent)
    weight, totals = [0.0] * count, 0.0
    import itertools
    import math

    for labels in itertools.product((0, 1), repeat=count):
        p = model.start[labels[0]]
        for node in range(count):
            p *= math.exp(sum(model.scores[f][labels[node]] for f in names[node] if f in model.scores))
            if node:
                p *= model.step[page.edge(node), labels[page.parent[node]]][labels[node]]
        totals += p
        for node in range(count):
            weight[node] += p * labels[node]
    assert all(abs(a / totals - b) < 1e-9 for a, b in zip(weight, model.marginals(page), strict=True))
