"""The registered queries of these operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens import configure
from vaultlens.llm import alignment, chat, decontamination, html, language_model, licenses, mixing, near_duplicates
from vaultlens.llm import personal_data, quality, urls, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(table)``, where ``table`` reads a given table by name."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


#: Words and lines of every document, windows of five words, and line counts by host.
_QUALITY = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), l AS (
    SELECT r, doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d
), lines AS (
    SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS normal,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
    FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), grams AS (
    SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), rep AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS o(k) GROUP BY r
), hosts AS (
    SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source
), often AS (
    SELECT l.source, l.normal, min(l.doc_id) AS first_doc
    FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
    GROUP BY l.source, l.normal, h.n
    HAVING count(DISTINCT l.t) > 20 AND count(DISTINCT l.t) * 100 > h.n * 10
), lost AS (
    SELECT l.r, sum(l.words) AS n
    FROM lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.normal = o.normal
    WHERE l.doc_id IS DISTINCT FROM o.first_doc GROUP BY l.r
), m AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS words_removed
    FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
        AND NOT ((n_words - words_removed) * 100 < n_words * 30) AS kept
FROM m
"""


@query("op3_quality_rules", _QUALITY)
def _quality_rules(table):
    # the limits of the SQL: one count for all lines, and a share of the host
    limits = {"max_percent": quality.MAX_LINE_PERCENT, "long_docs": quality.MIN_LINE_DOCS}
    return quality.judge(table("documents"), **limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "words_removed", "kept",
    )


_LICENSES = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), phrases(label, p) AS (VALUES
    ('mit', 'under the mit license'), ('apache-2', 'apache license version 2'), ('cc-by-nc', 'cc by nc')
), places AS (
    SELECT r, label, i FROM (
        SELECT r, ws, label, string_split(p, ' ') AS ps, unnest(range(len(ws))) AS i FROM d, phrases
    ) WHERE ws[i + 1:i + len(ps)] = ps
), base AS (
    SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM places GROUP BY r
), notices(label, n) AS (VALUES
    @NOTICES@
), sets AS (
    SELECT row_number() OVER () AS k, label, list_distinct(string_split(n, ' ')) AS ts FROM notices
), blocks AS (
    SELECT r, list_distinct(ws[s + 1:s + 64]) AS bs
    FROM (SELECT r, ws, unnest(range(0, greatest(1, len(ws) - 32), 32)) AS s FROM d)
), hits AS (
    SELECT r, label, len(list_intersect(bs, ts)) / len(ts) AS c FROM blocks, sets
    WHERE 100 * len(list_intersect(bs, ts)) >= 80 * len(ts)
), found AS (
    SELECT r, max(c) AS c, list(DISTINCT label) AS labels FROM hits GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, a::BIGINT AS first_word,
    z::BIGINT AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',')
        AS labels,
    CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(found.c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)
""".replace("@NOTICES@", ", ".join(f"('{label}', '{text}')" for label, text in licenses.NOTICES))


@query("op2_license_scans", _LICENSES)
def _license_scans(table):
    return licenses.scan(table("documents"))


_URLS = r"""
WITH u AS (
    SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest
    FROM pages
), p AS (
    SELECT page_id, url, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(regexp_extract(rest, '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
    FROM u
), rules(verdict, own, start) AS (VALUES
    ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit AS (
    SELECT url, arg_max(own || start, length(own || start)) AS rule, arg_max(verdict, length(own || start)) AS verdict
    FROM (SELECT DISTINCT url, host, path FROM p), rules
    WHERE (host = own OR suffix(host, '.' || own)) AND starts_with(path, start)
    GROUP BY url
), patterns(name, pattern) AS (VALUES
    @PATTERNS@
), hits AS (
    SELECT url, array_to_string(list_sort(list(name)), ',') AS patterns
    FROM (SELECT DISTINCT url FROM p), patterns WHERE regexp_matches(url, '(?i)' || pattern) GROUP BY url
)
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN patterns IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, patterns
FROM p LEFT JOIN fit USING (url) LEFT JOIN hits USING (url)
""".replace("@PATTERNS@", ", ".join(f"('{name}', '{pattern}')" for name, pattern, _ in urls.PATTERN_RULES))


@query("op5_url_filters", _URLS)
def _url_filters(table):
    return urls.judge(table("pages"))


#: The level is found by trying, for each source, that it and those with a smaller
#: ratio of cap to weight are the capped ones.
_MIX = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
            / greatest(0.25::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE
                * len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>{}=_!]'))
                / greatest(length(coalesce(text, '')), 1)) AS key
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
    FROM d GROUP BY source
), q AS (
    SELECT *, 2 * source_size / w AS ratio FROM s
), levels AS (
    SELECT ratio, (1.5 * (SELECT sum(source_size) FROM s)
        - (SELECT coalesce(sum(2 * source_size), 0) FROM q i WHERE i.ratio < o.ratio))
        / (SELECT sum(w) FROM q i WHERE i.ratio >= o.ratio) AS level
    FROM (SELECT DISTINCT ratio FROM q) o
), lv AS (
    SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio
), t AS (
    SELECT source, source_size, least((2 * source_size)::DOUBLE, w * level) AS target FROM q, lv
), e AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), o AS (
    SELECT d.*, e.source_size, e.target, e.epochs, round(e.target)::BIGINT - e.epochs * e.source_size - coalesce(sum(size)
        OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, round(target, 3) AS target,
    (epochs * size + greatest(0, least(size, rest)))::BIGINT AS taken
FROM o
"""


@query("op6_mixing", _MIX)
def _mixing(table):
    return mixing.mix(table("documents")).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken"
    )


_CHAT = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
    SELECT *, '<|turn|>' || role || chr(10) || '<|text|>'
        || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|end|>' || chr(10) AS piece
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece)) AS turns_sha256,
    length(coalesce(string_agg(text, '' ORDER BY turn, piece) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
    length(string_agg(piece, ''))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: One conversation whose texts look like control strings, in another layout.
SPECIAL = (
    -7,
    0,
    '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"},'
    ' {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}',
)


@query("op10_chat_formatting", _CHAT)
def _chat_formatting(table):
    rows = table("conversations")
    special = rows.sparkSession.createDataFrame([SPECIAL], "conv_id long, turn long, record string")
    records = chat.rows_as_records(rows).unionByName(special)
    return chat.digests(chat.formatted(chat.canonical(records)))


_BENCHMARK = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), windows AS (
    SELECT item, k, ws[s:s + k - 1] AS w
    FROM (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s
        FROM b WHERE len(ws) > 0)
), sizes AS (
    SELECT DISTINCT k FROM windows
), places AS (
    SELECT r, k, i, ws[i:i + k - 1] AS w
    FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)
), hits AS (
    SELECT r, i, p.k, item FROM places p JOIN windows USING (k, w)
), n AS (
    SELECT r, count(DISTINCT i + o) AS n_hit FROM (SELECT r, i, unnest(range(k)) AS o FROM hits) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)
"""


@query("op7_benchmark_decontamination", _BENCHMARK)
def _benchmark_decontamination(table):
    return decontamination.report(table("documents"), table("benchmark"))


_WARC = r"""
WITH p AS (
    SELECT row_number() OVER () AS r, page_id, sha256(coalesce(html, '')) AS payload_digest,
        octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes
    FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
        row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN n = 1 OR payload_bytes < 100 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN n = 1 OR payload_bytes < 100 THEN NULL ELSE first_id END AS refers_to
FROM f
"""


@query("op9_warc", _WARC)
def _warc(table):
    return warc.round_trip(table("pages"))


#: All pairs that share a shingle, on their full sets, and all nodes each can reach.
_NEAR = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


@query("op4_minhash_near_dedup", _NEAR)
def _minhash_near_dedup(table):
    return near_duplicates.find(table("documents"))


@query("op8_html_extraction")
def _html_extraction(table):
    return html.extract(table("pages"))


@query("op1_lm_scoring")
def _lm_scoring(table):
    return language_model.score(table("documents"))


#: Vocabulary files of public tokenizers; they are read, never copied.
TOKENIZERS = "/opt/tokenizers"


@query("op12_cross_tokenizer_alignment")
def _cross_tokenizer_alignment(table):
    return alignment.align(
        table("documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    )


@query("op13_personal_data")
def _personal_data(table):
    return personal_data.find(table("documents"))


@query("op11_embedding_whitening")
def _embedding_whitening(table):
    return whitening.whiten(table("embeddings"))
