"""HTML extraction with a tree-structured graphical model over the DOM.

Every block element is a binary variable, content or not. Parent and child are
tied by a transition table, and each node has a likelihood from its tag, the
kinds of its class and id names, its own text, its part of the text of the page
and its share of link text. A name tells a kind as a whole or if all its words
are of kinds or layout; a kind's word in another name is a feature of its own,
whose weight is learned. Sums of products are passed up from the leaves and down from the root, which gives
exact marginals; the text of nodes with a marginal of one half or more is the
main text. Tables are counted on labelled pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from copy import copy
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.seed_pages import seed_pages
from vaultlens.llm.tasks import binaries, in_batches, prepare

#: Pages of the table, by the hash of their id, that are labelled by their own
#: markup and add to the seed pages: at most so many, of at most so many characters.
LABELLED_PAGES = 300
LABELLED_CHARS = 100_000
#: Weight of each seed page against a page of the table.
SEED_WEIGHT = 3
#: Added to the count of every feature.
SMOOTHING = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is never text of the page.
UNSEEN = frozenset(
    "head title script style noscript template svg iframe object canvas audio video select option button textarea".split()
)
#: Read up to their end tag without looking for markup.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Parts of a line, not nodes unless their names tell of something.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var del math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced "
    "menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd "
    "maction semantics annotation annotation-xml".split()
)
#: Start tags that end an open paragraph.
_P_ENDS = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
#: Start tags that end an open element of a group, if it is nearer than the limits of the group.
_ENDS = {
    **dict.fromkeys(_P_ENDS, "p"),
    **{"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td"},
}
_SCOPE = frozenset("html body table td th article section div main aside nav footer header form".split())
_GROUPS = {
    "p": (frozenset({"p"}), _SCOPE),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
#: What a start tag changes: the groups that it is the nearest of, and those that it limits.
_CHANGES = {
    tag: ([g for g, (own, _) in _GROUPS.items() if tag in own], [g for g, (own, limit) in _GROUPS.items() if tag in limit - own])
    for tag in frozenset().union(*(own | limit for own, limit in _GROUPS.values()))
}

#: Kinds of class and id names, by the words in them.
KINDS = {
    "advert": "ad ads advert advertisement advertising adbox sponsor sponsored promo promoted banner",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager tabs toc",
    "header": "header masthead site-header pageheader",
    "footer": "footer copyright colophon legal imprint contentinfo",
    "sidebar": "sidebar aside side rail widget widgets secondary complementary",
    "comments": "comment comments commentlist disqus reply replies respond discussion",
    "notice": "cookie cookies consent gdpr notice alert popup modal dialog overlay paywall subscribe newsletter signup",
    "form": "form login search searchform signin register",
    "related": "related recommended recommendations more-stories share sharing social follow tags taglist author-bio",
    "content": "article content post entry main story body text maincontent articlebody hentry page-content",
}
_KIND_OF = {word: kind for kind, text in KINDS.items() for word in text.split()}
#: Words of names that say how an element lies and not what it is.
LAYOUT = frozenset(
    "site page main global top bottom left right inner outer wrap wrapper container box block area section list item items "
    "bar column col row grid panel group holder module region primary unit slot zone link links icon icons button buttons "
    "title heading js sub mobile desktop sticky fixed large small new my the default view field node el".split()
)
#: Short texts that name the owner of the page.
_LEGAL = re.compile(r"\u00a9|\bcopyright\b|\(c\) *[12]\d\d\d|\ball rights reserved\b", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=[\"']))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none(?![\w-])", re.I)
_WORD = re.compile(r"[a-z]+")


class Page:
    """Block nodes of a page in document order, and its runs of text."""

    def __init__(self, html: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#page"]
        self.kinds: list[frozenset] = [frozenset()]
        self.hints: list[frozenset] = [frozenset()]
        self.label: list[int | None] = [None]
        self.own = [0]
        self.linked = [0]
        self.runs: list[tuple[int, str]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        #: Open elements: (tag, node, unseen, depth of the nearest element of each group).
        stack: list[tuple[str, int, bool, dict[str, int]]] = [("#page", 0, False, {})]
        #: Depths of the open elements of a tag, so that none is looked for along the stack.
        depths: dict[str, list[int]] = {}
        pieces: list[str] = []
        links = 0
        at = 0

        def end_run() -> None:
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                if text:
                    node = stack[-1][1]
                    self.runs.append((node, text))
                    self.own[node] += len(text)
                pieces.clear()

        def pop(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                tag, node = stack[-1][:2]
                if node != stack[-2][1]:
                    end_run()
                if tag == "a":
                    links -= 1
                stack.pop()
                depths[tag].pop()

        def add(text: str) -> None:
            if text and not stack[-1][2]:
                pieces.append(text)
                if links > 0:
                    self.linked[stack[-1][1]] += len(text)

        length = len(html)
        while at < length:
            found = _TOKEN.search(html, at)
            if found is None:
                add(html[at:])
                break
            add(html[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                if depths.get(tag):
                    pop(depths[tag][-1])
                if tag == "br":
                    add(" ")
                continue
            if tag == "br":
                add(" ")
                continue
            ended = stack[-1][3].get(_ENDS.get(tag))
            if ended:
                pop(ended)
            if tag in VOID:
                if tag == "hr":
                    end_run()
                continue
            attributes = _attributes(found[3]) if found[3] else {}
            kinds, hints = _kinds(attributes) if attributes else (frozenset(), frozenset())
            node, unseen = stack[-1][1], stack[-1][2]
            if tag in UNSEEN or (attributes and _is_hidden(attributes)):
                unseen = True
                if tag not in ("head", "title", "script", "style"):
                    add(" ")
            elif not unseen and (tag not in INLINE or kinds - {"content"}):
                end_run()
                self.parent.append(node)
                self.tag.append(tag)
                self.kinds.append(kinds)
                self.hints.append(hints)
                self.label.append({"0": 0, "1": 1}.get(attributes.get("data-main")))
                self.own.append(0)
                self.linked.append(0)
                node = len(self.parent) - 1
            near = stack[-1][3]
            if tag in _CHANGES:
                own, limited = _CHANGES[tag]
                near = {**near, **dict.fromkeys(own, len(stack)), **dict.fromkeys(limited, 0)}
            depths.setdefault(tag, []).append(len(stack))
            stack.append((tag, node, unseen, near))
            if tag == "a":
                links += 1
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else length
        pop(1)
        end_run()

    def features(self) -> list[list[str]]:
        """Names of what is seen of each node."""
        below, links = list(self.own), list(self.linked)
        for node in range(len(self.parent) - 1, 0, -1):
            below[self.parent[node]] += below[node]
            links[self.parent[node]] += links[node]
        legal = {node for node, text in self.runs if len(text) < 200 and _LEGAL.search(text)}
        out = []
        for node, tag in enumerate(self.tag):
            share = links[node] / below[node] if below[node] else 0.0
            linked = 0 if share < 0.05 else 1 if share < 0.4 else 2
            size = self.own[node]
            own = 0 if not size else 1 if size < 25 else 2 if size < 60 else 3
            part = below[node] / (below[0] or 1)
            # what a name tells is not laid to the tag
            tag = "named" if self.kinds[node] - {"content"} else tag if tag in KNOWN_TAGS else "other"
            out.append(
                [
                    f"tag {tag}",
                    f"own {tag} {own}",
                    *(f"kind {kind}" for kind in self.kinds[node]),
                    *(f"hint {kind}" for kind in self.hints[node] - self.kinds[node]),
                    f"links {linked}",
                    f"part {linked} {0 if part < 0.02 else 1 if part < 0.2 else 2 if part < 0.6 else 3}",
                    *(["legal"] if node in legal else []),
                ]
            )
        return out

    def edges(self) -> list[str]:
        """How each node is tied to its parent.

        ``marked`` nodes say themselves what they are and ``hinted`` ones hint at it;
        others are ``inner`` below such a node, and ``plain`` where nothing above is named.
        """
        out, told = [], []
        for node, tag in enumerate(self.tag):
            above = node > 0 and told[self.parent[node]]
            marked = bool(self.kinds[node]) or tag in MARKED_TAGS
            hinted = bool(self.hints[node])
            out.append("marked" if marked else "hinted" if hinted else "inner" if above else "plain")
            told.append(above or hinted or (marked and tag not in ("html", "body")))
        return out

    def edge(self, node: int) -> str:
        return self.edges()[node]

    def labels(self, page: int = 0) -> list[int]:
        """A node's label is its own or its parent's; ``page`` is that of the root."""
        out = [page]
        for node in range(1, len(self.parent)):
            told = self.label[node]
            out.append(out[self.parent[node]] if told is None else told)
        return out

    def without(self, tags: frozenset) -> Page:
        """The page as if elements of these tags were ``div`` without a name."""
        out = copy(self)
        gone = [tag in tags for tag in self.tag]
        out.tag = ["div" if g else tag for g, tag in zip(gone, self.tag, strict=True)]
        out.kinds = [frozenset() if g else kinds for g, kinds in zip(gone, self.kinds, strict=True)]
        out.hints = [frozenset() if g else hints for g, hints in zip(gone, self.hints, strict=True)]
        return out

    def labels_by_markup(self) -> list[int] | None:
        """Labels of a page whose article is marked as such; None for another page."""
        out, found = [0], False
        for node in range(1, len(self.parent)):
            tag, kinds = self.tag[node], self.kinds[node]
            if tag == "article":
                found = True
                out.append(1)
            elif tag in ("nav", "header", "footer", "aside", "form") or kinds - {"content"}:
                out.append(0)
            else:
                out.append(out[self.parent[node]])
        return out if found else None

    def text(self, content: list[bool]) -> str:
        return " ".join(text for node, text in self.runs if content[node])


KNOWN_TAGS = frozenset(
    "#page html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th pre "
    "blockquote figure figcaption nav header footer aside form fieldset address details summary menu".split()
)

#: Labelled pages are counted as they are, without article elements, and without any
#: element that tells its part, so that the rest is learned too.
UNNAMED = [frozenset(), frozenset({"article"}), frozenset("article main nav header footer aside form section".split())]

EDGES = ("plain", "inner", "hinted", "marked")

#: Tags that tell content from the rest.
MARKED_TAGS = frozenset("html body article main nav header footer aside form".split())


def _attributes(text: str) -> dict[str, str]:
    """Values by name in lower case; of a name that is repeated the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), "".join(values))
    return found


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or (
        "style" in attributes and _NO_DISPLAY.search(unescape(attributes["style"])) is not None
    )


def _kinds(attributes: dict[str, str]) -> tuple[frozenset, frozenset]:
    """Kinds that the names of an element tell, and those that words in other names hint at."""
    told, hinted = set(), set()
    for name in ("class", "id", "role"):
        for value in attributes.get(name, "").lower().split():
            if value in _KIND_OF:
                told.add(_KIND_OF[value])
                continue
            words = [word for word in _WORD.findall(value) if len(word) > 1]
            found = {_KIND_OF[word] for word in words if word in _KIND_OF}
            (told if all(word in _KIND_OF or word in LAYOUT for word in words) else hinted).update(found)
    return frozenset(told - {"content"} or told), frozenset(hinted - {"content"})


def counts_of(page: Page, labels: list[int], weight: int = 1) -> Counter:
    """What training counts on one page: features by label, and labels by parent's."""
    found: Counter = Counter()
    edges = page.edges()
    for node, names in enumerate(page.features()):
        own = labels[node]
        found["nodes", "", own] += weight
        if not node:
            found["page", "", own] += weight
        for name in names:
            found["feature", name, own] += weight
        if node:
            found["child", f"{edges[node]} {labels[page.parent[node]]}", own] += weight
    return found


class Model:
    """Log-likelihoods of features, and the tables of the page and of parent and child."""

    def __init__(self, counts: Counter):
        nodes = [counts["nodes", "", y] for y in (0, 1)]
        names = {name for what, name, _ in counts if what == "feature"}
        self.scores = {}
        for name in names:
            kind, _, rest = name.partition(" ")
            # the own text is a bin of four, given the tag
            given = [counts["feature", f"tag {rest[:-2]}", y] for y in (0, 1)] if kind == "own" else nodes
            self.scores[name] = tuple(
                math.log((counts["feature", name, y] + SMOOTHING) / (given[y] + 4 * SMOOTHING)) for y in (0, 1)
            )
        self.start = [counts["page", "", y] + 1 for y in (0, 1)]
        self.step = {}
        for edge in EDGES:
            for x in (0, 1):
                row = [counts["child", f"{edge} {x}", y] + 1 for y in (0, 1)]
                self.step[edge, x] = [v / sum(row) for v in row]

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node: messages up, then down."""
        scores, parent = self.scores, page.parent
        tables = {edge: (*self.step[edge, 0], *self.step[edge, 1]) for edge in EDGES}
        steps = [tables[edge] for edge in page.edges()]
        up0, up1 = [], []  # own likelihood, times the messages of the children
        for names in page.features():
            a = b = 0.0
            for name in names:
                if name in scores:
                    x, y = scores[name]
                    a += x
                    b += y
            top = max(a, b)
            up0.append(math.exp(a - top))
            up1.append(math.exp(b - top))
        count = len(parent)
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * count
        for node in range(count - 1, 0, -1):
            s00, s01, s10, s11 = steps[node]
            a = s00 * up0[node] + s01 * up1[node]
            b = s10 * up0[node] + s11 * up1[node]
            total = a + b
            sent[node] = a, b = a / total, b / total
            above = parent[node]
            a, b = up0[above] * a, up1[above] * b
            top = max(a, b) or 1.0
            up0[above], up1[above] = max(a / top, 1e-300), max(b / top, 1e-300)
        a, b = self.start[0] * up0[0], self.start[1] * up1[0]
        belief = [(a / (a + b), b / (a + b))] * count
        out = [belief[0][1]] * count
        for node in range(1, count):
            a, b = belief[parent[node]]
            a, b = a / sent[node][0], b / sent[node][1]
            s00, s01, s10, s11 = steps[node]
            down0, down1 = a * s00 + b * s10, a * s01 + b * s11
            a, b = down0 * up0[node], down1 * up1[node]
            total = a + b
            belief[node] = a / total, b / total
            out[node] = b / total
        return out

    def extract(self, html: str) -> str:
        page = Page(html)
        return page.text([value >= 0.5 for value in self.marginals(page)])


def seed_counts() -> Counter:
    found: Counter = Counter()
    for html, label in seed_pages():
        page = Page(html)
        found += counts_of(page, page.labels(label), SEED_WEIGHT)
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for html in binaries(batch.column("html")):
            page = Page(html.decode(errors="replace"))
            labels = page.labels_by_markup()
            if labels is not None:
                for tags in UNNAMED:
                    found += counts_of(page.without(tags), labels)
    schema = pa.schema([("what", pa.string()), ("name", pa.string()), ("label", pa.int32()), ("n", pa.int64())])
    yield from in_batches(((*key, n) for key, n in found.items()), schema)


def train(pages: DataFrame, labelled_pages: int = LABELLED_PAGES) -> Model:
    """Count on the seed pages and on pages of the table that mark their article.

    Of these at most ``labelled_pages`` are used, of the smallest hashes of their
    id. Counts have one row for each tag, kind and bin, which bounds them.
    """
    chosen = (
        pages.filter(F.col("html").contains("<article") & (F.length("html") <= LABELLED_CHARS))
        .select("html", F.xxhash64("page_id", "html").alias("h"))
        .orderBy("h")
        .limit(labelled_pages)
        .select("html")
    )
    counted = chosen.mapInArrow(_count, "what string, name string, label int, n long")
    table = counted.groupBy("what", "name", "label").agg(F.sum("n").alias("n")).collect()
    return Model(balanced(seed_counts(), {(row["what"], row["name"], row["label"]): row["n"] for row in table}))


def balanced(seeds: Counter, table: dict[tuple, int]) -> Counter:
    """Both counts together; pages of the table weigh at most as much as the seed pages,
    so what their layout never shows is still told by these."""
    nodes = [sum(n for (what, _, _), n in counts.items() if what == "nodes") for counts in (seeds, table)]
    weight = min(1.0, nodes[0] / nodes[1]) if nodes[1] else 1.0
    return Counter({key: seeds[key] + weight * table.get(key, 0) for key in {*seeds, *table}})


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    Null and empty html give an empty text; pages are read whole, however long;
    repeated rows give repeated rows, and an empty table none (the seed pages
    train the model then).
    """
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(model or train(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.extract(html.decode(errors="replace")) for html in binaries(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    found = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
