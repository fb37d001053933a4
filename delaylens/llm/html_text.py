"""The main text of web pages: boosted trees over DOM nodes and a decoding that respects the tree.

A page becomes a tree of block elements with features of each (density of its subtree, tokens
of its tag and attributes, depth, siblings). Boosted trees, trained here on weakly labelled
pages, give each node a log-odds of being content. Decoding takes the best set of nodes in which
nothing is kept below a dropped ancestor.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.tables import share_by_hash, table

#: Bound of the training sample: pages, and the characters a page may have to be in it.
SAMPLE_PAGES, SAMPLE_CHARS = 160, 60_000
TREES, DEPTH, BINS, RATE = 40, 4, 24, 0.3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, with what ends them.
RAW = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in ("script", "style", "textarea", "title", "iframe")}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never part of an article.
NEVER = frozenset("script style noscript template iframe svg math head title textarea select option button object canvas audio video form".split())
FRAME = frozenset("nav header footer aside menu dialog".split())
BODY_WORDS = frozenset("article main content post entry story text body prose blog news page section".split())
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu "
    "header masthead footer foot sidebar side aside widget related recommended trending popular share sharing social follow "
    "comment comments reply replies respond discussion disqus cookie cookies consent notice alert gdpr popup modal overlay "
    "newsletter subscribe subscription signup login register search form breadcrumb breadcrumbs pagination pager tags meta "
    "copyright legal toolbar topbar skip hidden".split()
)
SCOPE = frozenset("article aside section main div table td th tr tbody ul ol body html blockquote nav header footer form".split())

PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


OPEN = frozenset(("#page", "html", "body"))


@dataclass
class Node:
    tag: str
    words: frozenset
    parent: int
    depth: int
    place: int = 0
    children: list = field(default_factory=list)
    runs: list = field(default_factory=list)  # places of its own text among the page's text runs
    never: bool = False


def _words(attributes: str) -> frozenset:
    out = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            out.add("hidden")
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                out.add("hidden")
        else:
            out.update(w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value)) if w)
    return frozenset(out)


def parse(page: str) -> tuple[list[Node], list[list]]:
    """Block nodes in page order, and text runs [node, pieces, linked characters].

    Tags may be unclosed or cut off: a block start closes an open paragraph, an end tag closes
    what is open inside it, and an end tag without a start is ignored. Inline elements don't
    break a run; a block start or end does.
    """
    nodes = [Node("#page", frozenset(), -1, 0)]
    runs: list[list] = []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block each stands in
    state = {"run": None, "links": 0}

    def add(text: str) -> None:
        at = stack[-1][1]
        if state["run"] is None:
            if not text.strip():
                return
            state["run"] = len(runs)
            nodes[at].runs.append(len(runs))
            runs.append([at, [], 0])
        runs[state["run"]][1].append(text)
        if state["links"]:
            runs[state["run"]][2] += len(text)

    def close(to: int) -> None:
        for tag, _ in stack[to:]:
            if tag not in INLINE:
                state["run"] = None
            if tag == "a":
                state["links"] -= 1
        del stack[to:]

    def close_open(tag: str) -> None:
        """Close an open element of this name that no other container separates from here."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                close(i)
                return
            if stack[i][0] in SCOPE:
                return

    def start(tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag not in VOID:
                stack.append((tag, stack[-1][1]))
                state["links"] += tag == "a"
            return
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            close_open(tag)
        close_open("p")
        state["run"] = None
        if tag in VOID:
            return
        parent = stack[-1][1]
        words = _words(attributes)
        node = Node(tag, words, parent, nodes[parent].depth + 1, len(nodes[parent].children))
        node.never = nodes[parent].never or tag in NEVER or "hidden" in words
        nodes[parent].children.append(len(nodes))
        stack.append((tag, len(nodes)))
        nodes.append(node)

    at = 0
    while at < len(page):
        m = PART.search(page, at)
        if m is None:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
        elif m[2] or m[4]:
            tag, attributes = (m[2] or m[4]).lower(), m[3] or m[5] or ""
            start(tag, attributes)
            if tag in RAW:
                end = RAW[tag].search(page, at)
                if tag == "title":
                    add(page[at : end.start() if end else len(page)])
                at = end.end() if end else len(page)
                close(len(stack) - 1)
    else:
        return nodes, runs
    add(page[at:])
    return nodes, runs


STOPS = re.compile("[.,;!?]")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset(("ul", "ol", "li", "dl"))
TABLES = frozenset(("table", "tr", "td", "th"))
FEATURES = (
    "text", "link_share", "text_share", "density", "depth", "siblings", "place", "children", "paragraphs", "stops",
    "mean_run", "own_text", "is_p", "is_heading", "is_list", "is_table", "is_frame", "body_words", "frame_words", "above_body",
    "above_frame", "above_link_share", "below_frame",
)


def features(nodes: list[Node], runs: list[list]) -> np.ndarray:
    """One row of FEATURES per node; subtree sums go from the leaves up, inherited ones down."""
    n = len(nodes)
    text, linked, stops, count, size, paragraphs, frames = ([0] * n for _ in range(7))
    for at, pieces, links in runs:
        if not nodes[at].never:
            whole = "".join(pieces)
            text[at] += len(whole)
            linked[at] += min(links, len(whole))
            stops[at] += len(STOPS.findall(whole))
            count[at] += 1
    own = list(text)
    framed = [x.tag in FRAME or not x.words.isdisjoint(FRAME_WORDS) for x in nodes]
    for i in range(n - 1, -1, -1):  # children come after their parents
        size[i] += 1
        paragraphs[i] += nodes[i].tag == "p"
        frames[i] += framed[i]
        p = nodes[i].parent
        if p >= 0:
            for column in (text, linked, stops, count, size, paragraphs, frames):
                column[p] += column[i]
    above = [(False, False)]
    out = []
    for i, x in enumerate(nodes):
        p = max(x.parent, 0)
        body = x.tag in ("article", "main") or not x.words.isdisjoint(BODY_WORDS)
        if i:
            above.append((above[p][0] or body, above[p][1] or framed[i]))
        siblings, t = len(nodes[p].children), max(text[i], 1)
        out.append((
            text[i], linked[i] / t, text[i] / max(text[0], 1), text[i] / size[i], x.depth, siblings, x.place / max(siblings, 1),
            len(x.children), paragraphs[i], stops[i] / t * 100, text[i] / max(count[i], 1), own[i], x.tag == "p", x.tag in HEADINGS,
            x.tag in LISTS, x.tag in TABLES, x.tag in FRAME, body, framed[i], above[i][0], above[i][1],
            linked[p] / max(text[p], 1), frames[i],
        ))
    return np.array(out, float)


@dataclass(frozen=True)
class Boosted:
    """Trees of fixed depth over quantile-binned features, stored level by level."""

    edges: list
    feature: np.ndarray  # tree x inner node
    cut: np.ndarray
    value: np.ndarray  # tree x leaf
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            total += value[at - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Gradient boosting of the logistic loss with second-order leaf values."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1)
    rate = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), base)
    chosen, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS + 1)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            best = np.full(2**level, 1e-6)
            for k in range(x.shape[1]):
                cell = (at - first) * (BINS + 1) + binned[:, k]
                g = np.bincount(cell, grad, 2**level * (BINS + 1)).reshape(2**level, -1).cumsum(1)
                h = np.bincount(cell, hess, 2**level * (BINS + 1)).reshape(2**level, -1).cumsum(1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                top = gain.argmax(1)
                value = gain[np.arange(len(top)), top]
                better = value > best
                best[better] = value[better]
                feature[first : first + len(top)][better] = k
                cut[first : first + len(top)][better] = top[better]
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
        margin += value[leaf]
        chosen.append(feature), cuts.append(cut), values.append(value)
    return Boosted(edges, np.stack(chosen), np.stack(cuts), np.stack(values), base)


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """1 inside an article and outside any frame, 0 inside a frame, -1 where tags don't say."""
    out = np.full(len(nodes), -1)
    for i, x in enumerate(nodes[1:], 1):
        above = out[x.parent]
        if x.never or x.tag in FRAME or x.words & FRAME_WORDS:
            out[i] = 0
        elif above >= 0:
            out[i] = above
        elif x.tag in ("article", "main") or x.words & {"article", "post", "entry", "story"}:
            out[i] = 1
    return out


def _disguised(nodes: list[Node], keep_words: bool) -> list[Node]:
    """The same tree with plain containers, so that the trees also learn from text and links."""
    out = []
    for x in nodes:
        tag, words = x.tag, x.words
        if tag in FRAME or tag in ("article", "main"):
            words = words | ({tag} if keep_words else frozenset())
            tag = "div"
        out.append(Node(tag, words if keep_words else frozenset(), x.parent, x.depth, x.place, x.children, x.runs, x.never))
    return out


def _framed(page: str, other: str, rng: np.random.Generator) -> str:
    """The page with text of another one set into it: as boxes named like boilerplate, in and
    around the article, and as short headings and lists after its paragraphs."""
    paragraphs = re.findall(r"<p\b[^>]*>[^<]{20,}", other)[:40] or ["<p>" + re.sub(r"<[^>]*>", " ", other)[:200]]
    words = sorted(FRAME_WORDS)
    ends = [m.end() for m in re.finditer(r"</p>|<article[^>]*>", page)]
    for at in sorted({ends[rng.integers(len(ends))] for _ in range(3) if ends}, reverse=True):
        some = [re.sub("<[^>]*>", "", q).split() for q in paragraphs]
        short = [" ".join(some[rng.integers(len(some))][: 1 + rng.integers(6)]) or "x" for _ in range(1 + rng.integers(4))]
        as_list = "<ul>" + "".join(f"<li>{w}</li>" for w in short) + "</ul>"
        page = page[:at] + (as_list if rng.random() < 0.5 else f"<h2>{short[0]}</h2>") + page[at:]
    spots = [m.start() for m in re.finditer(r"<article|</article>|<main|</main>|</p>", page)]
    for _ in range(3):
        word, at = words[rng.integers(len(words))], spots[rng.integers(len(spots))] if spots else len(page)
        inner = "".join(paragraphs[rng.integers(len(paragraphs))] + "</p>" for _ in range(1 + rng.integers(3)))
        name = "class" if rng.random() < 0.5 else "id"
        page = page[:at] + f'<div {name}="{word}">{inner}</div>' + page[at:]
        spots = [s for s in spots if s <= at]
    return page


def train(pages: DataFrame) -> Boosted:
    """Fit on a bounded sample of pages, chosen by the hash of their id: at most ``SAMPLE_PAGES``
    pages with a text, the first ``SAMPLE_CHARS`` characters of each, however long they are.

    Labels come from semantic tags and class names. Each page is also shown with its tags, and
    with tags and class names, taken away, and with boxes of other pages' text, so that the trees
    learn from text, links and names alike.
    """
    filled = pages.where(F.length("html") > 0).select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    rows = filled.where(share_by_hash("page_id", filled.count(), SAMPLE_PAGES))
    sample = rows.orderBy(F.xxhash64("page_id"), "html").limit(SAMPLE_PAGES).collect()
    return train_on([r.html for r in sample])


def train_on(sample: list[str]) -> Boosted:
    rng = np.random.default_rng(17)
    x, y = [np.zeros((2, len(FEATURES)))], [np.array([0, 1])]

    def show(nodes: list[Node], runs: list[list], labels: np.ndarray) -> None:
        known = labels >= 0
        x.append(features(nodes, runs)[known]), y.append(labels[known])

    for k, page in enumerate(sample):
        nodes, runs = parse(page)
        labels = weak_labels(nodes)
        for shown in (nodes, _disguised(nodes, True), _disguised(nodes, False)):
            show(shown, runs, labels)
        for _ in range(2):
            nodes, runs = parse(_framed(page, sample[(k + 1) % len(sample)], rng))
            labels = weak_labels(nodes)
            show(nodes, runs, labels), show(_disguised(nodes, True), runs, labels)
    return boost(np.concatenate(x), np.concatenate(y).astype(float))


def decode(nodes: list[Node], margin: list[float]) -> list[bool]:
    """Which nodes are kept: the best total score with nothing kept below a dropped node.

    A score is the node's margin and three quarters of its parent's score, so that a short heading or list
    item follows its surroundings. The page, html and body nodes hold everything and are always
    open, with score 0.
    """
    gain: list[float] = []
    for x, m in zip(nodes, margin):
        above = gain[x.parent] if gain else 0.0
        gain.append(0.0 if x.tag in OPEN else -1e9 if x.never else min(4.0, max(-4.0, m)) + max(-3.0, 0.75 * above))
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = [True]
    for i, x in enumerate(nodes[1:], 1):
        kept.append(kept[x.parent] and (gain[i] > 0 or x.tag in OPEN))
    return kept


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page; text directly in the body counts by the body's own margin."""
    trees = [parse(page or "") for page in pages]
    margins = model.margin(np.concatenate([features(*tree) for tree in trees])).tolist() if trees else []
    out, at = [], 0
    for nodes, runs in trees:
        margin = margins[at : at + len(nodes)]
        at += len(nodes)
        kept = decode(nodes, margin)
        found = (
            " ".join(entities.unescape("".join(pieces)).split())
            for i, pieces, _ in runs if kept[i] and (nodes[i].tag not in OPEN or margin[i] > 0)
        )
        out.append("\n".join(text for text in found if text))
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without an article, have an empty text. Pages may be broken
    off anywhere and of any length. Repeated rows each give a row; an empty table gives an empty
    result.
    """
    model = model or train(pages)

    def run(batches):
        for batch in batches:
            pages = batch.column(2).to_pylist()
            text = [t for i in range(0, len(pages), 64) for t in main_texts(pages[i : i + 64], model)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(pages["page_id"].cast("bigint"), pages["url"].cast("string"), pages["html"].cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


SQL = {}
QUERIES = {"op6_html_text": op6_html_text}
