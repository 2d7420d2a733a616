"""URL filters: host and path rules, and pattern rules found by their rarest token.

A pattern rule names literal tokens that every URL it matches must hold. The
index files each rule under that token of its own which the fewest URLs have;
the tokens of a URL fetch the rules filed under them, and only these run their
regular expression.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultlens.llm.text import ascii_lower, whole

#: Fixed values: (verdict, host and path).
HOST_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]

#: (name, regular expression, literal tokens that it needs).
PATTERN_RULES = [
    ("listing", r"[?&]page=\d+(&|#|$)", ["page"]),
    ("login", r"/login([/?#]|$)", ["login"]),
    ("register", r"/register([/?#]|$)", ["register"]),
    ("cart", r"/cart([/?#]|$)", ["cart"]),
    ("search", r"/search\?(.*&)?q=", ["search", "q"]),
    ("session", r"[?&]phpsessid=[0-9a-f]+", ["phpsessid"]),
    ("calendar", r"/calendar/\d{4}/\d{2}", ["calendar"]),
    ("tag", r"/tag/[^/]+/page/\d+", ["tag", "page"]),
    ("casino", r"^https?://([^/]*[.-])?casino[.-]", ["casino"]),
    ("adult", r"^https?://([^/]*[.-])?xxx[.-]", ["xxx"]),
    ("program", r"\.exe([?#]|$)", ["exe"]),
    ("wp-admin", r"/wp-admin/", ["wp", "admin"]),
]


def tokens(url: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(url), "[^0-9a-z]+"), ""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return (
        ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def base_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, null if none does."""

    def fits(rule: str) -> Column:
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(start)

    longest = sorted(rules, key=lambda rule: -len(rule[1]))
    choose = lambda value: F.coalesce(*(F.when(fits(rule), F.lit(value(v, rule))) for v, rule in longest))
    return choose(lambda verdict, rule: rule), choose(lambda verdict, rule: verdict)


def rule_tokens(rules: list[tuple[str, str, list[str]]]) -> Column:
    return F.array(*(F.lit(t) for t in sorted({t for _, _, needs in rules for t in needs})))


def pattern_index(urls: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(token, name, pattern): each rule under its token with the fewest URLs."""
    spark = urls.sparkSession
    literal = rule_tokens(rules)
    wanted = spark.createDataFrame(
        [(name, pattern, token) for name, pattern, needs in rules for token in needs],
        "name string, pattern string, token string",
    )
    counts = (
        urls.select(F.explode(F.array_intersect(tokens(F.col("url")), literal)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("urls"))
    )
    rarest = Window.partitionBy("name").orderBy(F.coalesce("urls", F.lit(0)), "token")
    return (
        wanted.join(counts, "token", "left")
        .withColumn("rank", F.row_number().over(rarest))
        .filter("rank = 1")
        .select("token", "name", "pattern")
    )


def pattern_hits(urls: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(url, patterns): names of the pattern rules that match, for each such URL."""
    return (
        urls.filter(F.col("url").isNotNull())
        .select("url", F.explode(F.array_intersect(tokens(F.col("url")), rule_tokens(rules))).alias("token"))
        .join(pattern_index(urls, rules), "token")
        .filter(F.expr("url rlike concat('(?i)', pattern)"))
        .groupBy("url")
        .agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("patterns"))
    )


def judge(
    pages: DataFrame,
    host_rules: list[tuple[str, str]] = HOST_RULES,
    pattern_rules: list[tuple[str, str, list[str]]] = PATTERN_RULES,
) -> DataFrame:
    """Verdict on each page's URL: its host rule's, else block if a pattern matches.

    Host rules are a list on the driver, at most some thousand. A null URL has
    empty host and path, matches nothing and is allowed. Repeated URLs and rows
    get the same verdict each; an empty table gives no rows.
    """
    urls = pages.select("page_id", "url")
    host, path = host_and_path(whole("url"))
    rule, verdict = base_rule(F.col("host"), F.col("path"), host_rules)
    return (
        urls.alias("p")
        .join(pattern_hits(urls, pattern_rules).alias("h"), "url", "left")
        .select("page_id", host.alias("host"), path.alias("path"), "patterns")
        .select(
            "page_id",
            "host",
            "path",
            rule.alias("rule"),
            F.coalesce(
                verdict, F.when(F.col("patterns").isNotNull(), F.lit("block")), F.lit("allow")
            ).alias("verdict"),
            "patterns",
        )
    )
