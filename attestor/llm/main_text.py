"""Main text of web pages: boosted trees score the nodes of a page's tree, and a decoding along the tree chooses what stays.

Nodes are a page's block elements and the runs of text between their edges. A node's features are its subtree's density (text, links, sentences),
its depth, its place and what its siblings hold, its tag, and the groups that tokens of its attributes and its ancestors' belong to. The trees
are fitted by Spark's GBTClassifier on pages that are laid out anew (layouts.py) from the text of a bounded sample of the table's pages, where it is known which runs
are main text; a node is positive if main text lies below it. Decoding takes the likeliest labelling in which a positive node has positive
ancestors, so that what lies in a dropped part can't stay and a part that holds main text isn't dropped as a whole.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.layouts import MARK, page as laid_out
from attestor.llm.work import pieces, stored

#: Pages whose text the model is fitted on, and layouts that each is put into. A page gives at most so many characters.
SAMPLE_PAGES, LAYOUTS, SAMPLE_CHARS = 250, 4, 20_000
TREES, DEPTH = 20, 5
#: Parts that the sample is dealt to; it has the same size whatever the table's.
PARTS = 8
#: Characters of a page that make a batch of their own.
BATCH_CHARS = 4 << 20

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html "
    "label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style template noscript textarea title iframe svg math select object noembed noframes xmp canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that a start tag closes if they are the innermost.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"),
} | dict.fromkeys(HEADINGS, tuple(HEADINGS))

#: Groups of parts of a page: tags that name one, and tokens of attributes that do.
GROUPS = {
    "article": ("article main", r"article|content|post|posts|entry|story|body|main|text|prose|paragraph|richtext"),
    "nav": ("nav menu", r"nav\w*|\w*menu|crumbs?|breadcrumbs?|pagination|pager|toc|skip|tabs?|navigation|links"),
    "header": ("header hgroup", r"header|head|masthead|topbar|top|logo|branding|tagline"),
    "footer": ("footer", r"foot\w*|colophon|copyright|bottom|contentinfo|legal|imprint"),
    "aside": ("aside", r"side\w*|aside|widgets?|rail|related|recommend\w*|complementary|trending|popular|teasers?|more|further"),
    "notice": ("dialog", r"notic\w*|cookies?|consent|gdpr|privacy|alerts?|popup|modal|overlay|warning|announcement|toast|dialog|disclaimer|paywall"),
    "advert": ("", r"ads?|adv\w*|adsense|sponsor\w*|promo\w*|banner|commercial|partners?|affiliate|outbrain|taboola"),
    "form": ("form fieldset label button legend", r"forms?|search\w*|login|signin|signup|subscri\w*|newsletter|register|contact|poll|survey|input|field"),
    "comment": ("", r"comment\w*|discussion|disqus|repl\w*|respon\w*|reviews?|feedback|threads?|guestbook|opinions"),
    "social": ("", r"shar\w*|social|follow|tweet|facebook|twitter|tags?|meta|byline|author|dates?|print|tools|toolbar|credits?"),
    "hidden": ("", r"hidden|none|invisible|offscreen|sr|noprint"),
}
NAMES = tuple(GROUPS)
TAG_GROUP = {tag: 1 << k for k, (tags, _) in enumerate(GROUPS.values()) for tag in tags.split()}
TOKEN_GROUP = re.compile("|".join(f"(?P<{name}>{stems})" for name, (_, stems) in GROUPS.items()) + r"\Z")

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>?|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"'=]++|=\s*+"[^"]{0,4096}+"|=\s*+'[^']{0,4096}+'|[="'])*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden|aria-label)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Nodes:
    """The nodes of a batch of pages, as columns; a parent comes before its children."""

    def __init__(self):
        self.page, self.parent, self.tag, self.own, self.text, self.links = [], [], [], [], [], []

    def add(self, page: int, parent: int, tag: str, own: int, text: str | None = None, links: int = 0) -> int:
        for column, value in zip((self.page, self.parent, self.tag, self.own, self.text, self.links), (page, parent, tag, own, text, links), strict=True):
            column.append(value)
        return len(self.page) - 1


def groups_of(rest: str, seen: dict[str, int]) -> int:
    """The groups that an element's attributes name, as bits."""
    if rest not in seen:
        out = 0
        for name, *values in ATTRIBUTE.findall(rest):
            value, name = "".join(values), name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                out |= 1 << NAMES.index("hidden")
            elif not name.startswith("aria") and name != "style":
                for token in TOKEN.findall(value):
                    if m := TOKEN_GROUP.fullmatch(token.lower()):
                        out |= 1 << NAMES.index(m.lastgroup)
        if len(seen) > 10_000:
            seen.clear()
        seen[rest] = out
    return seen[rest]


def parsed(text: str, page: int, nodes: Nodes, seen: dict[str, int]) -> None:
    """Add the nodes of a page: block elements as they nest, and the runs of text between their edges."""
    stack, names, opened = [nodes.add(page, -1, "html", 0)], ["html"], {"html": 1}
    run: list[str] = []
    links = in_link = pos = 0
    unclosed: set[str] = set()

    def flush():
        nonlocal links
        if run and (words := "".join(run).split()):
            nodes.add(page, stack[-1], "", 0, " ".join(words), links)
        run.clear()
        links = 0

    def pop():
        stack.pop()
        opened[names.pop()] -= 1

    end, last = len(text), text.rfind(">") + 1  # no tag ends behind the last
    while pos < end:
        m = TAG.search(text, pos, last)
        chunk = text[pos : m.start() if m else end]
        if chunk:
            if not m and (cut := re.search(r"<[/a-zA-Z!?]", chunk)):  # a tag that the page's end cuts off
                chunk = chunk[: cut.start()]
            if "&" in chunk:
                chunk = entities.unescape(chunk)
            run.append(chunk)
            links += in_link and len(chunk)
        if not m:
            break
        pos, name = m.end(), m["name"]
        if name is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                in_link = 0
            elif name in BLOCKS and opened.get(name) and name not in ("html", "body"):
                flush()
                while names[-1] != name:
                    pop()
                pop()
            continue
        if name in SKIPPED:
            if name not in unclosed and not m["rest"].endswith("/"):
                closing = re.compile(f"</{name}(?=[\\s/>])", re.I).search(text, pos)
                if closing:
                    pos = closing.start()
                elif name in ("script", "style"):
                    break
                else:
                    unclosed.add(name)
        elif name == "a":
            in_link = 1
        elif name in ("br", "hr"):
            run.append(" ")
            if name == "hr":
                flush()
        elif name in BLOCKS and name not in ("html", "body"):
            flush()
            if names[-1] == "p" and name not in ("button", "label"):
                pop()
            for closed in CLOSES.get(name, ()):
                if names[-1] == closed:
                    pop()
            own = groups_of(m["rest"], seen) if m["rest"] else 0
            stack.append(nodes.add(page, stack[-1], name, own))
            names.append(name)
            opened[name] = opened.get(name, 0) + 1
    flush()


def features(nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each node, its parent (-1 for a page's root) and its depth."""
    n = len(nodes.page)
    page, parent, own = (np.array(x, np.int64) for x in (nodes.page, nodes.parent, nodes.own))
    is_run = np.array([t is not None for t in nodes.text])
    chars = np.array([len(t) if t else 0 for t in nodes.text], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in nodes.text], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";") if t else 0 for t in nodes.text], float)
    links = np.minimum(np.array(nodes.links, float), chars)
    tags = np.array([TAG_GROUP.get(t, 0) for t in nodes.tag], np.int64)
    up = np.maximum(parent, 0)

    depth, above = np.zeros(n, np.int64), np.zeros(n, np.int64)
    deep: list[np.ndarray] = []  # nodes by depth
    order = np.flatnonzero(parent < 0)
    children = np.argsort(up[parent >= 0], kind="stable")
    below = np.flatnonzero(parent >= 0)[children]
    first = np.searchsorted(up[below], np.arange(n + 1))
    while len(order):
        deep.append(order)
        counts = first[order + 1] - first[order]
        starts = np.repeat(first[order] - (np.cumsum(counts) - counts), counts)
        order = below[starts + np.arange(counts.sum())]
        depth[order] = len(deep)
        above[order] = above[up[order]] | own[up[order]] | tags[up[order]]

    def summed(x: np.ndarray) -> np.ndarray:
        out = x.astype(float).copy()
        for level in reversed(deep[1:]):
            np.add.at(out, up[level], out[level])
        return out

    kind = lambda names: np.array([t in names for t in nodes.tag])
    heading = kind(HEADINGS)
    all_chars, all_links, all_words, all_stops, runs, size = (summed(x) for x in (chars, links, words, stops, is_run, np.ones(n)))
    heads = summed(kind({"h1"}))
    before = np.cumsum(chars) - chars
    start = before[np.searchsorted(page, page)]  # characters of the pages before
    total = np.maximum(all_chars[np.searchsorted(page, page)], 1)
    siblings = np.bincount(up[below], minlength=n)[up]
    siblings[parent < 0] = 1
    place = np.zeros(n)
    place[below] = np.arange(len(below)) - first[up[below]]
    before_it, after_it = np.full(n, -1), np.full(n, -1)
    same = up[below][1:] == up[below][:-1]
    before_it[below[1:][same]], after_it[below[:-1][same]] = below[:-1][same], below[1:][same]
    logs = np.log1p(all_chars)
    next_to = lambda at: np.where(at >= 0, logs[at], -1)
    by_tag = np.unique(np.array(nodes.tag, dtype=object).astype(str), return_inverse=True)[1]
    _, alike, many = np.unique(up * (by_tag.max(initial=0) + 1) + by_tag, return_inverse=True, return_counts=True)
    others = np.where(siblings > 1, (summed_children(logs, up, parent, n)[up] - logs) / np.maximum(siblings - 1, 1), -1)
    ratio = lambda x, y: x / np.maximum(y, 1)
    near = np.where(is_run, up, np.arange(n))  # a run is of its element's kind
    numeric = [
        depth, is_run, logs, ratio(all_links, all_chars), np.log1p(runs), np.log1p(ratio(all_chars, runs)), ratio(all_stops, all_words), all_chars / total, (before - start) / total, (before - start + all_chars) / total,
        np.log(siblings), place / siblings, others, many[alike] / siblings, next_to(before_it), next_to(after_it), logs[up], ratio(all_links, all_chars)[up], ratio(all_chars, all_chars[up]), np.log1p(ratio(all_chars, size)),
        np.log1p(total), np.log1p(heads), heads[up] > 0, *(x[near] for x in (heading, kind({"h1"}), kind({"p"}), kind({"li", "dd", "dt"}), kind({"td", "th"}), kind({"div", "section"}), kind({"ul", "ol", "dl", "table"}))),
    ]
    bits = [(x >> k) & 1 for x in (tags[near], own[near], above) for k in range(len(NAMES))]
    return np.column_stack([*numeric, *bits]).astype(np.float64), parent, depth


def summed_children(x: np.ndarray, up: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    inner = parent >= 0
    return np.bincount(up[inner], weights=x[inner], minlength=n)


# --- the model ------------------------------------------------------------


class Trees(NamedTuple):
    """Boosted trees as arrays over all their nodes: a leaf leads to itself."""

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += weight * self.value[at]
        return 2 * out


def as_trees(model) -> Trees:
    """A fitted GBTClassificationModel's trees, of at most TREES * 2 ** (DEPTH + 1) nodes."""
    rows, roots = [], []

    def walk(node) -> int:
        at = len(rows)
        rows.append([0, 0.0, at, at, node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            rows[at][:2] = split.featureIndex(), split.threshold()
            rows[at][2] = walk(node.leftChild())
            rows[at][3] = walk(node.rightChild())
        return at

    roots = [walk(tree._call_java("rootNode")) for tree in model.trees]
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    return Trees(np.array(roots), np.array(model.treeWeights), columns[0].astype(int), columns[1].astype(float), columns[2].astype(int), columns[3].astype(int), columns[4].astype(float), DEPTH)


def training_nodes(pages: DataFrame, count: int = SAMPLE_PAGES) -> DataFrame:
    """features, label of the nodes of laid-out pages. The text is that of the `count` pages whose page_id hashes lowest; LAYOUTS pages are made of each, and as many where it has no text."""
    cut = pages.select(F.xxhash64("page_id").alias("h"), F.coalesce(F.substring("html", 1, SAMPLE_CHARS), F.lit("")).alias("html")).orderBy("h", "html").limit(count)
    spare = pages.sparkSession.range(count).select(F.xxhash64("id").alias("h"), F.lit("").alias("html"))

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            for h, html in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own = Nodes()
                parsed(html, 0, own, seen)
                texts = [t for t in own.text if t]
                nodes = Nodes()
                for k in range(LAYOUTS):
                    parsed(laid_out(h + k, texts), k, nodes, seen)
                main = np.array([bool(t and MARK in t) for t in nodes.text], float)
                nodes.text = [t.replace(MARK, "") if t else t for t in nodes.text]
                x, parent, depth = features(nodes)
                for level in range(int(depth.max(initial=0)), 0, -1):
                    at = np.flatnonzero(depth == level)
                    np.maximum.at(main, parent[at], main[at])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(main)], ["features", "label"])

    return cut.union(spare).repartition(PARTS).mapInArrow(run, "features array<double>, label double")


def fit(pages: DataFrame) -> Trees:
    """Trees fitted on the laid-out text of a bounded sample of pages (page_id, html); of any table, an empty one too."""
    rows = stored(training_nodes(pages), "main-text-nodes")
    classifier = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=7)
    held = rows.coalesce(PARTS).select(array_to_vector("features").alias("features"), "label").persist()
    try:
        return as_trees(classifier.fit(held))
    finally:
        held.unpersist()


# --- decoding -------------------------------------------------------------


def kept(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The likeliest labels of nodes with these log odds of which no positive one has a negative parent."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]
    for level in reversed(levels[1:]):
        np.add.at(yes, parent[level], np.maximum(yes[level], no[level]))
        np.add.at(no, parent[level], no[level])
    stays = yes > no
    for level in levels[1:]:
        stays[level] &= stays[parent[level]]
    return stays


def main_texts(pages: list[str], model: Trees, seen: dict[str, int]) -> list[str]:
    """The main text of each page: the runs that stay, joined by spaces."""
    nodes = Nodes()
    for k, html in enumerate(pages):
        parsed(html, k, nodes, seen)
    x, parent, depth = features(nodes)
    stays = kept(model.log_odds(x), parent, depth)
    out: list[list[str]] = [[] for _ in pages]
    for at in np.flatnonzero(stays).tolist():
        if nodes.text[at] is not None:
            out[nodes.page[at]].append(nodes.text[at])
    return [" ".join(runs) for runs in out]


def extracted(pages: DataFrame, model: Trees) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html): its main text and the code points of that.

    A null or empty html, or one without main text, gives an empty text. Tags that the page leaves open or cuts off end where a browser would
    end them; white space is what Unicode calls so. Rows that repeat are done each by itself. An empty table gives an empty result.
    """

    def run(batches):
        seen: dict[str, int] = {}
        for batch in pieces(batches, 64):
            pages = [x or "" for x in batch.column("html").to_pylist()]
            texts, start, size = [], 0, 0
            for k, page in enumerate(pages):
                size += len(page)
                if size >= BATCH_CHARS or k + 1 == len(pages):
                    texts += main_texts(pages[start : k + 1], model, seen)
                    start, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    made = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return made.withColumn("n_chars", F.length("text").cast("long"))
