"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. What a block looks like and where it stands give the cost of
calling it content and the cost of calling it boilerplate: the capacities to the two terminals. Blocks next to
each other, and blocks of one parent, are tied by edges that cost something to cut. The minimum cut
of that network, found by maximum flow, is the cheapest labelling of the whole page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import slices, text_of, written

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page; all but the last few hold no markup either.
SKIPPED_TAGS = frozenset("script style textarea title noscript template iframe svg object canvas audio video select button math".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
#: An opening tag ends an open element of these, up to the container named.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
            "option": ({"option"}, {"select"})}
_ENDS_P = BLOCK_TAGS - {"body", "html", "head", "title", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_P_LIMIT = frozenset("table td th caption button object body html article section div main aside nav header footer form li".split())

#: For each tag's group: which open elements it ends, and beyond which it doesn't look.
_NEAR = {"p": ({"p"}, _P_LIMIT), **_IMPLIED}
_MATTER = frozenset().union(*(tags | limit for tags, limit in _NEAR.values()))

CONTENT_TAGS = frozenset({"article", "main"})
BOILERPLATE_TAGS = frozenset("nav aside footer header form menu dialog search fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ENDS = (r"(?:s|list|box|bar|form|area|wrapper|wrap|container|link|icon|button|section|block|menu|nav|right|left|top|bottom|panel|"
         r"inner|content|text|title|item|column)*(?![a-z])")
_NAMES = re.compile(
    r"(?<![a-z])(?:side-(?!by(?![a-z]))|(?:ad|ads|adv|adbox|adslot|adsbygoogle|advert(?:isement|ising|iser)?|gdpr|aside|masthead|respond|reply|"
    r"replies|login|signup|overlay|copyright|pagination|pager|toolbar|tags|byline|sponsor(?:ed)?|promo(?:tion|ted)?|banner|cookie|consent|"
    r"notice|alert|menu|nav(?:bar|igation)?|sidebar|footer|header|breadcrumb|comment(?:er|ing)?|discuss(?:ion)?|disqus|shar(?:e|ing)|social|"
    r"related|recommend(?:ed|ation)?|newsletter|subscri(?:be|ber|ption)|search|widget|popup|modal|teaser|outbrain|taboola)" + _ENDS + ")")
#: Names that say how a page is laid out, or what a post is about, and nothing about the element itself.
_LAYOUT = re.compile(r"(?<![a-z])(?:has|with|without|no)[-_]\S*|(?<!\S)comments?-(?:open|closed|off|enabled|disabled)(?!\S)")
_TOPICS = re.compile(r"(?<!\S)(?:tag|category|cat|topic|author|type|format|status|tax|term)-\S*")
_CONTENT_NAMES = re.compile(r"(?<![a-z])(?:article|post|entry|story|content|main)(?:[-_]?(?:body|content|text|main))?(?![a-z-])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HEADERS = re.compile(r"(?<![a-z])(?:header|masthead|byline)")
_COMMENTS = re.compile(r"(?<![a-z])(?:comment(?:er|ing)?|respond|reply|replies|discuss(?:ion)?|disqus)" + _ENDS)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: Constant, then weights of ``features``.
Model = tuple[float, ...]
#: What a sentence ends with, and groups of tags that look alike.
ENDINGS = tuple(".!?:;\"'”’»)…。！？")
TAG_GROUPS = (frozenset({"p", "blockquote", "pre"}), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("li dt dd".split()),
              frozenset("td th tr caption".split()))
#: Bounds of the fit, and of the log odds: a block with neighbours of the other kind on both sides, of one parent, can be outweighed.
FIT_PAGES, FIT_BLOCKS, MOST_ODDS = 2_000, 200, 2.5


@dataclass
class Element:
    """An open element: what it says about the blocks inside it."""

    tag: str
    parent: Element | None
    marked: bool = False  # as boilerplate
    lasting: bool = False  # marked in a way that no content inside can undo
    content: bool = False
    named: bool = False  # like content
    holds_content: bool = False
    remark: bool = False  # an article named like a comment
    excused: bool = False  # holds the main content, whatever its own name
    chars: int = 0
    near: dict[str, Element | None] = field(default_factory=dict)  # what an opening tag may end, for each group of _NEAR


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    owner: Element | None = None
    tag: str = ""


def _opened(tag: str, attributes: str, parent: Element | None) -> Element:
    made = Element(tag, parent)
    made.near = parent.near if parent is not None else {}
    if tag in _MATTER:
        made.near = {**made.near, **{group: None if tag in limit else made for group, (tags, limit) in _NEAR.items() if tag in limit or tag in tags}}
    made.content = tag in CONTENT_TAGS
    marked = tag in BOILERPLATE_TAGS
    in_content = parent is not None and (parent.content or (parent.parent is not None and parent.parent.content))
    if marked and tag == "header" and in_content:
        marked = False
    names: list[str] = []
    if attributes and tag not in ("html", "body", "a", "b", "i", "span", "em", "strong"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                names.append(_LAYOUT.sub(" ", _HUMP.sub("-", value).lower()))
                continue
            value = value.lower()
            if name == "role":
                marked |= value in BOILERPLATE_ROLES
                made.content |= value in ("main", "article")
            elif (name == "hidden" or name == "aria-hidden") and value in ("true", "hidden"):
                marked = True
            elif name == "style" and _HIDDEN.search(value):
                marked = made.lasting = True
    made.named = any(_CONTENT_NAMES.search(value) for value in names)
    for value in names:
        if made.content:
            made.remark |= bool(_COMMENTS.search(value))
            continue
        value = _TOPICS.sub(" ", value) if made.named else value
        if any(not (in_content and _HEADERS.match(value, m.start())) for m in _NAMES.finditer(value)):
            marked = True
            made.lasting |= bool(_COMMENTS.search(value))
    made.marked = marked
    made.lasting |= tag in ("nav", "aside", "footer")
    if made.content:
        up = parent
        while up is not None and not up.holds_content:
            up.holds_content = True
            up = up.parent
    return made


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order; references are decoded and white space is single."""
    found: list[Block] = []
    now = Block()
    top = Element("", None)
    links, skip, strict = 0, 0, True

    def close() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                now.owner.chars += len(now.text)
                found.append(now)
        now = Block()

    def add(raw: str) -> None:
        if skip or not raw:
            return
        text = html.unescape(raw)
        if now.owner is None and not text.isspace():
            now.owner = top
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def pop_to(element: Element) -> None:
        nonlocal top, links, skip
        while True:
            gone, top = top, top.parent
            top.chars += gone.chars
            depth[gone.tag] -= 1
            links -= gone.tag == "a"
            skip -= gone.tag in SKIPPED_TAGS
            if gone is element:
                return

    depth: dict[str, int] = {}
    at, n = 0, len(page)
    last_end = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = (_TAG if strict else _LOOSE).match(page, lt) if lt < last_end else None
        if m is None and lt < last_end and strict and _LOOSE.match(page, lt):
            strict, m = False, _LOOSE.match(page, lt)  # a quote never closes: from here on the next > ends a tag
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if tag in BLOCK_TAGS:
            close()
        elif tag == "br":
            add(" ")
        if m[1]:
            if tag in VOID_TAGS or not depth.get(tag):
                continue
            up = top
            while up.parent is not None and up.tag != tag:
                up = up.parent
            pop_to(up)
            continue
        if tag in VOID_TAGS:
            continue
        if tag in _ENDS_P and (up := top.near.get("p")):
            pop_to(up)
        if tag in _IMPLIED and (up := top.near.get(tag)):
            pop_to(up)
        if m[3].endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        top = _opened(tag, m[3], top)
        depth[tag] = depth.get(tag, 0) + 1
        links += tag == "a"
        skip += tag in SKIPPED_TAGS
        now.tag = tag if tag in BLOCK_TAGS else now.tag
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = n if end is None else end.start()
    close()
    while top.parent is not None:
        pop_to(top)
    return found


def _down(element: Element | None, known: dict[int, object], of: Callable[[Element, object], object], start: object) -> object:
    """``of`` an element and its parent's value, kept in ``known``: each element is worked on once."""
    path = []
    while element is not None and id(element) not in known:
        path.append(element)
        element = element.parent
    value = start if element is None else known[id(element)]
    for element in reversed(path):
        value = known[id(element)] = of(element, value)
    return value


def features(blocks: list[Block]) -> np.ndarray:
    """What a block's text, tag and neighbours look like, a row for each; nothing of names, roles or the parts of a page."""
    size = np.array([len(b.text) for b in blocks], float)
    linked = np.minimum(np.array([b.linked for b in blocks], float) / np.maximum(size, 1), 1)
    ends = np.array([b.text[-1:] in ENDINGS for b in blocks], float)
    tags = [np.array([b.tag in group for b in blocks], float) for group in TAG_GROUPS]
    # linked share and tags of the blocks before and after, none at the page's ends
    beside = [np.append(0, x)[:-1] + np.append(x, 0)[1:] for x in (linked, *tags)]
    place = np.arange(len(blocks)) / max(1, len(blocks) - 1)
    return np.column_stack([np.log1p(size), linked, ends, np.log1p(size) * ends, place, place ** 2, *tags, *beside])


def _spread(n: int, most: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))


def fit(pages: DataFrame, html_col: str = "html") -> Model | None:
    """The classifier of blocks, learned from pages that mark their article or main part themselves: blocks inside against the rest.

    Bounded sample: the ``FIT_PAGES`` distinct pages of least hash among those with such a tag, and of each at most ``FIT_BLOCKS`` blocks,
    evenly spread. None where the sample has only one kind of block.
    """
    kind = "x array<array<double>>, y array<double>"
    html_text = text_of(html_col)
    # pages by their hashes, that only those of the sample are moved
    marked = pages.where(html_text.rlike(r"(?i)<(article|main)[\s>]")).select(F.xxhash64(html_text).alias("draw"), html_text.alias("page"))
    least = marked.select("draw").distinct().orderBy("draw").limit(FIT_PAGES)
    chosen = marked.join(F.broadcast(written(least, "html-sample")), "draw")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "page"):
                for draw, page in zip(part.column("draw").to_pylist(), part.column("page").to_pylist(), strict=True):
                    blocks = blocks_of(page)
                    zones = _zones(blocks)
                    at = _spread(len(blocks), FIT_BLOCKS) if 2 in zones else []
                    rows = features(blocks)[at].tolist() if len(at) else []
                    yield pa.RecordBatch.from_pylist(
                        [{"draw": draw, "x": rows, "y": [float(zones[i] == 2) for i in at]}],
                        pa.schema([("draw", pa.int64()), ("x", pa.list_(pa.list_(pa.float64()))), ("y", pa.list_(pa.float64()))]))

    rows = chosen.mapInArrow(take, f"draw long, {kind}").groupBy("draw").agg(F.min(F.struct("x", "y")).alias("r")).orderBy("draw").collect()
    x = [v for row in rows for v in row["r"]["x"]]
    y = np.array([v for row in rows for v in row["r"]["y"]])
    return fit_blocks(np.array(x), y) if len(set(y.tolist())) == 2 else None


def fit_blocks(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> Model:
    """Logistic regression by Newton's method, the two kinds of block weighing alike."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) / len(y) + ridge * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    weights = w[1:] / scale
    return (float(w[0] - weights @ mean), *map(float, weights))


def costs(blocks: list[Block], model: Model | None = None) -> list[float]:
    """For each block the cost of calling it boilerplate less that of calling it content.

    A page that marks its article or main part is taken at its word, as are marks of boilerplate. Elsewhere the cost is the log odds of the fitted
    ``model``, bounded so that a block's neighbours can outweigh it; without a model, a rule of thumb.
    """
    if not blocks:
        return []
    zones = _zones(blocks)
    outside = -4.0 if 2 in zones else -0.5
    odds = None
    if model is not None and 2 not in zones:
        odds = np.clip(model[0] + features(blocks) @ np.array(model[1:]), -MOST_ODDS, MOST_ODDS).tolist()
    found = []
    for i, (b, zone) in enumerate(zip(blocks, zones, strict=True)):
        size = len(b.text)
        if odds is not None and zone >= 0:
            found.append(odds[i] + 2.0 * zone)
            continue
        cost = {2: 8.0, 1: 3.0 + outside, 0: outside, -1: -8.0}[zone]
        cost += min(1.5, size / 100)
        cost -= 3.0 * (b.linked > size / 2)
        cost += 0.5 * (b.tag in ("h1", "p", "blockquote", "pre"))
        if zone < 0:
            cost = min(cost, -5.0)
        found.append(cost)
    return found


def _zones(blocks: list[Block]) -> list[int]:
    """The zone of each block. Where marks would leave no article or main part, they don't count around the main content."""
    total = sum(len(b.text) for b in blocks)
    zones = _zones_once(blocks, total)
    if 2 not in zones and (found := _main_content(blocks, zones)):
        while (found := found.parent) is not None:
            found.excused = True
        zones = _zones_once(blocks, total)
    # articles named like comments are ones where there is any other article
    rest = 0 if 2 in zones else 2
    return [rest if z == 3 else z for z in zones]


def _zones_once(blocks: list[Block], total: int) -> list[int]:
    """2 inside an article or main part, 3 inside an article named like a comment, 1 inside what is named like content, -1 inside
    what is marked as boilerplate, else 0."""
    def zone(at: Element, outside: int) -> int:
        if outside < 0 or at.marked and not at.excused and not (at.holds_content and not at.lasting and at.chars * 2 > total):
            return -1
        return max(outside, 3 if at.remark else 2 if at.content else 1 if at.named else 0)

    known: dict[int, object] = {}
    return [_down(b.owner, known, zone, 0) for b in blocks]


def _main_content(blocks: list[Block], zones: list[int]) -> Element | None:
    """The main part or largest article, else the largest part named like content, of those inside marked elements.

    An article or named part must have at least half as much text as there is outside marks and links.
    """
    rest = sum(len(b.text) - b.linked for b, zone in zip(blocks, zones, strict=True) if zone >= 0)
    best, most = None, (False, False, 0)
    sheltered: dict[int, object] = {}  # in something that lasts
    seen: set[int] = set()
    for b, zone in zip(blocks, zones, strict=True):
        at = b.owner if zone < 0 else None
        while at is not None and id(at) not in seen:
            seen.add(id(at))
            if (at.content or at.named) and not at.marked and not at.remark:
                key = (at.tag == "main", at.content, at.chars)
                if key > most and (key[0] or at.chars * 2 >= rest) and not _down(at, sheltered, lambda e, above: above or e.lasting, False):
                    best, most = at, key
            at = at.parent
    return best


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, and the nearest earlier block of the same parent's parent."""
    found, last = [], {}
    for i, b in enumerate(blocks):
        parent = b.owner.parent if b.owner is not None else None
        if i:
            before = blocks[i - 1].owner
            near = before is not None and b.owner is not None and (before is b.owner or before.parent is parent)
            found.append((i - 1, i, 1.0 if near else 0.4))
        j = last.get(id(parent))
        if j is not None and j != i - 1:
            found.append((j, i, 0.6))
        last[id(parent)] = i
    return found


def minimum_cut(cost: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side. Positive costs are capacities from the source, negative ones to the sink.

    Maximum flow by phases of shortest augmenting paths.
    """
    n, least = len(cost), 1e-9
    excess = list(cost)
    to: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    cap: list[float] = []
    for u, v, w in ties:
        to[u].append(len(head))
        to[v].append(len(head) + 1)
        head += (v, u)
        cap += (w, w)
        # flow straight across this edge
        if excess[u] * excess[v] < 0:
            k, over, under = (len(head) - 2, u, v) if excess[u] > 0 else (len(head) - 1, v, u)
            flow = min(excess[over], -excess[under], w)
            excess[over] -= flow
            excess[under] += flow
            cap[k] -= flow
            cap[k ^ 1] += flow
    while True:
        level = [0 if e > least else -1 for e in excess]
        order = [u for u in range(n) if level[u] == 0]
        reached = False
        for u in order:
            for k in to[u]:
                v = head[k]
                if level[v] < 0 and cap[k] > least:
                    level[v] = level[u] + 1
                    order.append(v)
                    reached |= excess[v] < -least
        if not reached:
            return [x >= 0 for x in level]
        arc = [0] * n
        for source in range(n):
            while excess[source] > least and level[source] == 0:
                path, u = [], source
                while not (excess[u] < -least):
                    while arc[u] < len(to[u]):
                        k = to[u][arc[u]]
                        if cap[k] > least and level[head[k]] == level[u] + 1:
                            break
                        arc[u] += 1
                    if arc[u] < len(to[u]):
                        path.append(to[u][arc[u]])
                        u = head[path[-1]]
                    elif path:
                        u = head[path.pop() ^ 1]
                        arc[u] += 1
                    else:
                        break
                if not path:
                    break
                flow = min(excess[source], -excess[u], *(cap[k] for k in path))
                for k in path:
                    cap[k] -= flow
                    cap[k ^ 1] += flow
                excess[source] -= flow
                excess[u] += flow


def main_text(page: str, model: Model | None = None) -> str:
    blocks = blocks_of(page)
    kept = minimum_cut(costs(blocks, model), edges(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``pages`` without ``html_col`` and with ``text_col``, the main text: the content blocks joined by line ends.

    ``model`` is that of ``fit``, for pages that don't mark their article.

    A null or empty page has the empty text. A column that already has the name ``text_col`` gives way. Rows are neither
    dropped nor moved; repeated rows and ids stay rows; a page of any length is read whole.
    """
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*(F.col(f"`{c}`") for c in others), text_of(html_col).alias(text_col))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                texts = pa.array([main_text(page, model) for page in part.column(at).to_pylist()], pa.string())
                yield part.set_column(at, pa.field(text_col, pa.string()), texts)

    return rows.mapInArrow(take, rows.schema)
