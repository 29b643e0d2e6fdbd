"""Main text of web pages by minimum cuts.

A page is read as a list of text blocks with their place in the element tree. A linear classifier gives each block a cost of
being content and one of being boilerplate; these are its capacities to the two terminals. Neighbouring blocks and blocks with one
parent are joined by smoothness edges, the stronger the closer they are in the tree. A maximum flow gives the minimum cut, and
the blocks on the source's side are the content.

The classifier is a logistic regression fitted to pages that mark their article: blocks inside the mark against blocks outside it, once with the mark in
sight and once without, so that pages without marks are served too. Its prior holds what such pages can't teach, such as names of comment sections.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrain.llm import textkit as K

#: Element names by their part in a page. The content of RAW elements is no markup; those of TEXT may go without an end tag, where the start tag then counts for nothing.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
TEXT = frozenset("textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul noscript".split()
)
DROPPED = frozenset("nav footer aside form menu button dialog fieldset search head template object svg math canvas audio video select option datalist map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag closes, and those beyond which it does not.
CLOSES = {t: frozenset(["p"]) for t in BLOCKS - {"body", "head", "html", "button", "caption", "dd", "dt", "li", "legend", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"}}
CLOSES |= {"li": frozenset(["li", "p"]), "dd": frozenset(["dd", "dt", "p"]), "dt": frozenset(["dd", "dt", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "body": frozenset(["head"])}
SCOPES = frozenset("html body table ul ol dl div section article aside nav footer header main form blockquote td th li dd figure fieldset details noscript".split())
#: Words of class and id names that speak against or for content.
AGAINST = re.compile(
    r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|advertising|banner|billboard|breadcrumbs?|byline|captcha|comments?|commentlist|consent|cookies?|copyright|disqus|disclaimer|footer|gdpr|header|hidden|login|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|outbrain|overlay|pager|pagination|paywall|popup|promo|promoted|recommend|recommended|related|replies|reply|respond|rss|search|share|sharing|shoutbox|sidebar|"
    r"signup|skip|social|sponsor|sponsored|subscribe|subscription|taboola|tags|teaser|toolbar|topbar|tracking|widget)(?:$|[-_ \d])|(?:comment|sidebar|cookie|advert|sponsor|footer|navbar|newsletter)",
    re.I,
)
COMMENTS = re.compile(r"comment|disqus|(?:^|[-_ ])(?:repl(?:y|ies)|respond)(?:$|[-_ ])", re.I)
#: Names of page frames that only say what stands beside the content, and of an article's own head.
FRAMES = re.compile(r"\b(?:has|with|without|no)[-_](?:\w+[-_])?(?:sidebar|footer|header|ads?|comments?|nav|menu)\S*|\b(?:article|entry|post|content)[-_]+(?:header|head)\S*", re.I)
FOR = re.compile(r"(?:^|[-_ ])(?:article|articlebody|body|content|entry|main|post|story|text)(?:$|[-_ ])", re.I)

#: What the classifier sees of a block, and the weights that it starts from, in units of cost; positive speaks for content. UNIT of cost is one of log-odds.
FEATURES = ("bias", "in_article", "no_article", "named_for", "named_against", "dropped", "link_tenths", "long", "short", "heading", "punctuated")
PRIOR = (15.0, 120.0, -120.0, 50.0, -280.0, -400.0, -12.0, 40.0, -10.0, 30.0, 30.0)
UNIT = 40.0
#: Pages that the classifier is fitted to, at most: those with the least hashes; the weight of all their blocks together, in blocks, against a prior of variance 1 in log-odds; Newton steps.
FIT_PAGES, FIT_WEIGHT, FIT_STEPS = 2000, 64.0, 25
#: Characters from which a block is long, and up to which it is short.
LONG_CHARS, SHORT_CHARS = 80, 25
#: Capacity of the edge between neighbours with one parent; with other parents it is divided by their distance in the tree.
SMOOTH = 24

_NAME_START = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag: quotes count after an equals sign only, and no part of it is read twice.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>?)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    name: str
    depth: int
    parent: Element | None
    #: The nearest scope around it (itself if it is one), and of a scope: how many elements of each name are open in it outside inner scopes.
    scope: Element | None = None
    open: Counter | None = None
    #: The nearest block element around it, and evidence of the element and those around it.
    holder: Element | None = None
    heading: bool = False
    dropped: bool = False
    against: bool = False
    fit: bool = False
    article: bool = False
    link: bool = False
    comment: bool = False


@dataclass(slots=True)
class Block:
    place: Element
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    text: str = ""


def tags_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, tag, attributes) in page order: the text before a tag, and its name in lower case with a / before it for an end tag; the last has no tag. Comments, declarations and
    a tag that the page's end cuts off are left out. One pass: nothing is looked for twice."""
    place, start, end, unclosed = 0, 0, len(page), set()
    while (at := page.find("<", place)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            closing = "-->" if page.startswith("<!--", at) else ">"
            stop = page.find(closing, at + 2)
            yield page[start:at], "", ""
            place = start = end if stop < 0 else stop + len(closing)
            continue
        m = _NAME_START.match(page, at + 2 if after == "/" else at + 1)
        if m is None:
            if after == "/":  # no tag, but no text either
                stop = page.find(">", at)
                yield page[start:at], "", ""
                place = start = end if stop < 0 else stop + 1
            else:
                place = at + 1
            continue
        rest = _REST.match(page, m.end())
        if not rest[2]:
            yield page[start:at], "", ""
            return
        name, place = m[0].lower(), rest.end()
        yield page[start:at], "/" * (after == "/") + name, rest[1]
        start = place
        if name in RAW and after != "/" and not (name in TEXT and name in unclosed):
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, place)
            if close:
                place = start = close.start()
            elif name in TEXT:
                unclosed.add(name)
            else:
                return
    yield page[start:], "", ""


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, with their elements. Open elements and stray end tags are dealt with as browsers do, in the main."""
    root = Element("", 0, None, open=Counter())
    root.scope = root.holder = root
    at, out, block, opened = root, [], None, Counter()

    def text(raw: str) -> None:
        nonlocal block
        if block is None:
            if not raw or raw.isspace():
                return
            block = Block(at.holder)
            out.append(block)
        clean = html.unescape(raw) if "&" in raw else raw
        block.parts.append(clean)
        if at.link:
            block.link_parts.append(clean)

    def leave(element: Element) -> None:
        """Close element and all that is open in it."""
        nonlocal at
        stop = element.parent
        while at is not stop:
            opened[at.name] -= 1
            (at.parent if at.scope is at else at).scope.open[at.name] -= 1
            at = at.parent

    def within(names: frozenset[str] | set[str]) -> Element | None:
        """The outermost open element with one of the names inside the nearest scope."""
        scope, found = at.scope, None
        if any(scope.open[n] > 0 for n in names):
            up = at
            while up is not scope:
                found = up if up.name in names else found
                up = up.parent
        return found

    for raw, name, attributes in tags_of(page):
        text(raw)
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if name == "br":
                text(" ")
                continue
            if opened[name] > 0:
                if name in BLOCKS:
                    up = at
                    while up.name != name:
                        up = up.parent
                    leave(up)
                elif at.scope.open[name] > 0:
                    up = at
                    while up.name != name:
                        up = up.parent
                    leave(up)
            if name in BLOCKS:
                block = None
            continue
        if name in RAW:
            continue
        if name == "br" or name == "wbr":
            text(" " if name == "br" else "")
            continue
        if name in CLOSES:
            closes = CLOSES[name]
            while True:
                if (inner := within(closes)) is not None:
                    leave(inner)
                if at.scope.name not in closes:
                    break
                leave(at.scope)
        if name in BLOCKS:
            block = None
        if name in VOID:
            continue
        names = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)) if "=" in attributes else ""
        own = bool(names) and name not in ("html", "body")
        against, comment = own and bool(AGAINST.search(FRAMES.sub(" ", names))), at.comment or (own and bool(COMMENTS.search(names)))
        article = name in ("article", "main")
        new = Element(
            name, at.depth + 1, at, heading=at.heading or name in HEADINGS,
            dropped=at.dropped or name in DROPPED or (name == "header" and not at.article) or (bool(attributes) and bool(_HIDDEN.search(attributes))),
            # an article begins anew, unless it is a comment: frames around it may be named for what else they hold
            against=against or comment or name == "noscript" or (at.against and not article), fit=at.fit or (own and bool(FOR.search(names))), article=at.article or article, link=at.link or name == "a", comment=comment,
        )
        at.scope.open[name] += 1
        opened[name] += 1
        if name in SCOPES:
            new.scope, new.open = new, Counter()
        else:
            new.scope = at.scope
        new.holder = new if name in BLOCKS else at.holder
        at = new
        if attributes.endswith("/") and name in ("svg", "math"):
            leave(new)
    for b in out:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
    return [b for b in out if b.text]


def features_of(b: Block, any_article: bool) -> tuple[int, ...]:
    """FEATURES of a block of a page with or without an article mark."""
    n, linked = len(b.text), len("".join(b.link_parts).strip())
    inside = any_article and b.place.article
    return (
        1, int(inside), int(any_article and not inside), int(b.place.fit), int(b.place.against), int(b.place.dropped), 10 * min(linked, n) // n,
        int(n >= LONG_CHARS), int(n < SHORT_CHARS and not any_article), int(b.place.heading), int(b.text[-1] in ".!?…\"”»:"),
    )


def costs_of(blocks: list[Block], weights: tuple[float, ...]) -> list[int]:
    """The classifier's evidence for content (positive) or against it."""
    any_article = any(b.place.article for b in blocks)
    return [round(sum(w * x for w, x in zip(weights, features_of(b, any_article)) if x)) for b in blocks]


def examples(page: str | None) -> list[tuple[int, ...]]:
    """(label, FEATURES) of each block of a page that marks an article, with the mark in sight and without it; none of other pages."""
    blocks = blocks_of(page) if page else []
    if not any(b.place.article for b in blocks):
        return []
    return [(int(b.place.article and not b.place.against and not b.place.dropped), *features_of(b, seen)) for b in blocks for seen in (True, False)]


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> tuple[float, ...]:
    """Weights of the classifier from pages(page_id, url, html): the FIT_PAGES rows with the least hashes of page_id and url, as far as they mark their article; PRIOR if none does."""
    key = F.xxhash64("page_id", "url")
    least = pages.select(key.alias("h")).orderBy("h").limit(fit_pages).agg(F.max("h")).first()[0]
    if least is None:
        return PRIOR
    kind = T.ArrayType(T.ArrayType(T.IntegerType()))

    @F.arrow_udf(kind)
    def found(htmls: pa.Array) -> pa.Array:
        return pa.array([examples(p) for p in htmls.to_pylist()], pa.list_(pa.list_(pa.int32())))

    rows = pages.where(key <= least).select(F.explode(found(F.col("html"))).alias("x"))
    # features are few small integers, so blocks meet in a bounded number of distinct rows
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return PRIOR
    table = np.array([r["x"] for r in counts], float)
    return map_weights(table[:, 1:], table[:, 0], np.array([r["n"] for r in counts], float))


def map_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Weights of greatest posterior probability, by Newton steps: logistic loss of rows x with labels y that occur n times, scaled to FIT_WEIGHT rows in all, and a Gaussian prior around PRIOR."""
    start = np.array(PRIOR) / UNIT
    w, n = start.copy(), n * (FIT_WEIGHT / n.sum())
    for _ in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T * (n * p * (1 - p)) @ x + np.eye(len(w)), x.T @ (n * (y - p)) - (w - start))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w * UNIT)


def _distance(a: Element, b: Element, most: int) -> int:
    """Steps between two elements in the tree; most if they are further apart."""
    n = 0
    while a is not b and n < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity) between neighbours and between each block and the last before it with the same parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i and (c := SMOOTH // (1 + max(0, _distance(blocks[i - 1].place, b.place, SMOOTH + 2) - 2))):
            out.append((i - 1, i, c))
        parent = id(b.place.parent)
        if (j := last.get(parent)) is not None and j != i - 1:
            out.append((j, i, SMOOTH // 2))
        last[parent] = i
    return out


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut: a node with cost c > 0 has capacity c from the source, one with c < 0 has -c to the sink.

    Each source node pushes along shortest augmenting paths of its own till its supply is used up or no demand can be reached. What it then
    reaches never gets a way to the sink again, is on the source's side, and is left out of later searches. Of several minimum cuts
    this is the one with the smallest source side.
    """
    n = len(costs)
    demand = [max(-c, 0) for c in costs]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    inside = [False] * n
    for start in range(n):
        supply = costs[start]
        while supply > 0 and not inside[start]:
            before, queue, goal = {start: -1}, deque([start]), -1
            while queue:
                i = queue.popleft()
                if demand[i]:
                    goal = i
                    break
                for j, c in near[i].items():
                    if c and j not in before and not inside[j]:
                        before[j] = i
                        queue.append(j)
            if goal < 0:
                for i in before:
                    inside[i] = True
                break
            path, i = [], goal
            while before[i] >= 0:
                path.append((before[i], i))
                i = before[i]
            push = min([supply, demand[goal], *(near[a][b] for a, b in path)])
            supply -= push
            demand[goal] -= push
            for a, b in path:
                near[a][b] -= push
                near[b][a] += push
    return inside


def extract(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    """The content blocks of a page, one a line; an empty text if there is none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = min_cut(costs_of(blocks, weights), edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def main_text(page: Column, weights: tuple[float, ...] = PRIOR) -> Column:
    """The main text of each whole page. Null, empty and text-free pages give an empty text; a page is cut by itself, so repeated rows agree."""

    @F.arrow_udf(T.StringType())
    def extracted(pages: pa.Array) -> pa.Array:
        texts = pa.array([extract(p, weights) for p in pages.to_pylist()], pa.string())
        K.give_back()
        return texts

    return extracted(page)
