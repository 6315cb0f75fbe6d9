"""Main text of web pages by a graphical model over the tree of their blocks.

Each block element is a node with two states, content and not. A node's potential comes from its tag, the words of
its class, id and role, and its own text; each pair of parent and child has a potential that depends on the child's
tag. Messages go up from the leaves and down from the root (sum-product), which gives each node's marginal
probability of being content. The weights are trained on labelled pages by maximum likelihood, whose gradient is
the difference between labelled and expected features under the same messages.

The labelled pages are made here, with a fixed seed: many layouts of articles among menus, notices, adverts, forms,
sidebars, comments and footers, whose elements are marked as content or not.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.token_files import slices

# Names of the elements of HTML, by how a parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
# What a page doesn't show as text: its head, templates, drawings, what media show where they can't play, and forms.
UNSEEN = frozenset("head template svg form select option datalist object audio video canvas".split()) | (RAW - {"xmp"})
BLOCK = frozenset(
    "html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption tbody td tfoot "
    "th thead tr ul head".split()
)
#: An open element of the second kind ends where one of the first kind begins, unless a barrier stands between.
ENDED_BY = {
    **dict.fromkeys(BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, ("p",)),
    "li": ("li", "p"),
    "dd": ("dd", "dt", "p"),
    "dt": ("dd", "dt", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "tr": ("tr", "td", "th", "p"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"),
    "thead": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"),
    "body": ("head",),
}
BARRIER = frozenset("html body article aside div section main nav header footer form table ul ol dl blockquote fieldset figure".split())
LISTS = {"li": frozenset({"ul", "ol", "menu"}), "dd": frozenset({"dl"}), "dt": frozenset({"dl"})}
CELLS = frozenset({"table"})

#: Attributes as a browser's tokenizer reads them: a name and, behind =, a quoted value or one up to white space or the
#: tag's end. A quote that nothing closes belongs to a value of the second kind, so it swallows no text.
_ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
_markup = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_named = re.compile(r"(?<![^\s/\"'])(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_space = re.compile(r"[\s\x00]+")
_letters = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    names: frozenset = frozenset()
    parent: int = -1
    label: str = ""
    text: list = field(default_factory=list)  # (place on the page, text, whether in a link)


def parse(page: str) -> list[Node]:
    """The page's block elements, parents before children, each with the text that no inner block holds."""
    nodes = [Node("#page")]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements with the block that holds their text
    hidden = links = place = at = 0

    def add(text: str) -> None:
        nonlocal place
        if text and not hidden:
            place += 1
            nodes[stack[-1][1]].text.append((place, text, links > 0))

    def close(depth: int) -> None:
        nonlocal hidden, links, place
        while len(stack) > depth:
            tag, _ = stack.pop()
            hidden -= tag in UNSEEN
            links -= tag == "a"
            place += tag in BLOCK

    size = len(page)
    while at < size:
        m = _markup.search(page, at)
        add(page[at : m.start() if m else size])
        if not m:
            break
        at = m.end()
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BARRIER:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                add(" ")
            continue
        if tag in ENDED_BY:
            stop = LISTS.get(tag, CELLS if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else BARRIER)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in stop:
                    break
                if stack[depth][0] in ENDED_BY[tag]:
                    close(depth)
                    if tag in ("p", "li", "dd", "dt", "td", "th") or tag not in LISTS:
                        continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if tag == "xmp":  # shown as it is written
                add(html.escape(page[at : end.start() if end else size]))
            at = end.end() if end else size
            continue
        holder = stack[-1][1]
        if tag in BLOCK:
            found = {k.lower(): a or b or c for k, a, b, c in _named.findall(m["rest"])}
            names = _letters.findall(" ".join(v for k, v in found.items() if k != "data-label").lower())
            nodes.append(Node(tag, frozenset(names), holder, found.get("data-label", "")))
            holder = len(nodes) - 1
            place += 1
        hidden += tag in UNSEEN
        links += tag == "a"
        stack.append((tag, holder))
    return nodes


def features(node: Node) -> list[str]:
    """Names of what a node shows by itself."""
    text = "".join(t for _, t, _ in node.text)
    words = len(text.split())
    linked = sum(len(t) for _, t, a in node.text if a)
    share = linked / len(text) if words else 0.0
    ends = sum(text.count(c) for c in ".!?,;。，")
    return [
        "bias",
        f"tag {node.tag}",
        f"words {words.bit_length()}",
        f"linked {min(4, int(share * 5))}" if words else "no text",
        f"stops {min(3, ends)}",
        *(f"name {n}" for n in node.names),
    ]


@dataclass
class Model:
    """Weights of features for the state content, and of (child's tag, parent's state, child's state)."""

    node: dict[str, float] = field(default_factory=dict)
    edge: dict[tuple[str, int, int], float] = field(default_factory=dict)

    def marginals(self, nodes: list[Node], own: list[list[str]]) -> tuple[list[float], list[list[float]]]:
        """P(content) of each node, and of each node but the root P(parent's state, its state) as four numbers."""
        n = len(nodes)
        weight, edge = self.node, self.edge
        score = [[0.0, sum(weight.get(f, 0.0) for f in fs)] for fs in own]
        pair = [[edge.get((x.tag, a, b), 0.0) for a in (0, 1) for b in (0, 1)] for x in nodes]
        up = [[0.0, 0.0] for _ in range(n)]  # what a node's subtree says to its parent
        below = [list(s) for s in score]  # own potential and what the children say
        for i in range(n - 1, 0, -1):
            p, (x, y) = pair[i], below[i]
            up[i] = [_add(p[0] + x, p[1] + y), _add(p[2] + x, p[3] + y)]
            parent = below[nodes[i].parent]
            parent[0] += up[i][0]
            parent[1] += up[i][1]
        belief = [list(below[0])] + [[0.0, 0.0] for _ in range(n - 1)]
        joint: list[list[float]] = [[]]
        for i in range(1, n):
            above, p = belief[nodes[i].parent], pair[i]
            a, b = above[0] - up[i][0], above[1] - up[i][1]
            j = [a + p[0] + below[i][0], a + p[1] + below[i][1], b + p[2] + below[i][0], b + p[3] + below[i][1]]
            z = max(j)
            e = [math.exp(x - z) for x in j]
            total = sum(e)
            joint.append([x / total for x in e])
            belief[i] = [_add(j[0], j[2]), _add(j[1], j[3])]
        return [1 / (1 + math.exp(min(700, max(-700, b[0] - b[1])))) for b in belief], joint

    def text(self, page: str) -> str:
        """The text of the content nodes in page order; one space within and between blocks."""
        nodes = parse(page)
        p, _ = self.marginals(nodes, [features(x) for x in nodes])
        pieces = sorted((place, i, t) for i, x in enumerate(nodes) if p[i] >= 0.5 for place, t, _ in x.text)
        out, last = [], None
        for place, i, t in pieces:
            # Neighbouring pieces of one block are one run of text; a block between them parts them.
            if last is not None and (i != last[0] or place != last[1] + 1):
                out.append(" ")
            out.append(html.unescape(t) if "&" in t else t)
            last = i, place
        return _space.sub(" ", "".join(out)).strip()


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(pages: list[str], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 0) -> Model:
    """Fit on labelled pages: elements with data-label "1" or "0" and all below them up to the next label."""
    model, order = Model(), random.Random(seed)
    seen: dict = {}
    prepared = []
    for page in pages:
        nodes = parse(page)
        labels = [0] * len(nodes)
        for i, x in enumerate(nodes[1:], 1):
            labels[i] = int(x.label) if x.label else labels[x.parent]
        prepared.append((nodes, [features(x) for x in nodes], labels))
    for _ in range(rounds):
        order.shuffle(prepared)
        for nodes, own, labels in prepared:
            p, joint = model.marginals(nodes, own)
            step: dict = {}
            for i, (fs, y) in enumerate(zip(own, labels, strict=True)):
                for f in fs:
                    step[f] = step.get(f, 0.0) + y - p[i]
                if i:
                    for k, e in enumerate(joint[i]):
                        key = (nodes[i].tag, k // 2, k % 2)
                        step[key] = step.get(key, 0.0) + (labels[nodes[i].parent] * 2 + y == k) - e
            for key, g in step.items():
                table = model.edge if isinstance(key, tuple) else model.node
                g -= decay * table.get(key, 0.0)
                seen[key] = seen.get(key, 0.0) + g * g
                table[key] = table.get(key, 0.0) + rate * g / math.sqrt(seen[key] + 1e-3)
    return model


# Words that pages use in classes and ids, by what they mark.
MARKS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip",
    "header": "header masthead site-header logo branding top banner-top",
    "footer": "footer site-footer foot colophon copyright legal bottom",
    "sidebar": "sidebar side rail widget widget-area secondary complementary related recommended trending popular recent archive tags more-stories",
    "notice": "cookie consent notice gdpr popup modal overlay alert banner message privacy newsletter subscribe paywall",
    "advert": "ad ads advert advertisement adbox ad-slot ad-unit ad-container banner-ad sponsor sponsored promo promotion adsense adslot",
    "comments": "comments comment comment-list responses reply replies disqus discussion respond user-comment",
    "share": "share social sharing follow toolbox",
    "content": "content article post entry entry-content post-body article-body main story text body page-content main-content",
    "neutral": "container wrapper wrap row col page inner outer grid layout site app root box block",
}


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Made pages whose elements are marked as content (1) or not (0)."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        syllables = ["".join(r.choice(s) for s in ("bdfglmnprst", "aeiou", " nrst"[: r.randint(1, 5)])).strip() for _ in range(60)]
        out = []
        for _ in range(max(1, int(math.exp(r.uniform(math.log(a), math.log(b)))))):
            out.append("".join(r.choices(syllables, k=r.randint(1, 3))) + (r.choice(".,,.;!?") if r.random() < 0.13 else ""))
        return " ".join(out).capitalize()

    def named(kind: str, chance: float = 1.0) -> str:
        if r.random() > chance:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{" ".join(r.sample(MARKS[kind].split(), r.choice((1, 1, 2))))}"'

    def element(tag: str, inner: str, kind: str = "", chance: float = 1.0, label: str = "") -> str:
        mark = f' data-label="{label}"' if label else ""
        end = "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"
        return f"<{tag}{named(kind, chance) if kind else ''}{mark}>{inner}{end}"

    def link(a: int = 1, b: int = 5) -> str:
        return f'<a href="/{r.randint(1, 999)}">{words(a, b)}</a>'

    def links() -> str:
        return element(r.choice(("ul", "ul", "ol", "div")), "".join(element("li", link()) for _ in range(r.randint(2, 9))))

    def paragraph() -> str:
        text = words(1, 120)
        if r.random() < 0.03:
            text += f" <math><mi>{words(1, 1)}</mi></math>"
        if r.random() < 0.25:
            text += f" {r.choice((link(), f'<b>{words(1, 9)}</b>', f'<em>{words(1, 4)}</em>', '<br>'))} {words(1, 20)}"
        return element("p", text if r.random() > 0.05 else f"<b>{text}")

    def boxed() -> str:
        """One box of a sidebar, alone or in an element of its own."""
        made = element(r.choice(("h2", "h3", "h4")), words(1, 4)) + r.choice((links, paragraph))()
        return element(r.choice(("section", "div")), made, "sidebar", 0.7) if r.random() < 0.5 else made

    def clutter(kind: str) -> str:
        tags = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section")}
        inner = {"menu": links, "header": lambda: words(1, 6) + r.choice(("", links())), "share": links, "sidebar": lambda: "".join(boxed() for _ in range(r.choice((1, 1, 2, 3))))}
        made = inner.get(kind, lambda: r.choice((lambda: words(2, 25), paragraph, lambda: words(2, 20) + link()))())()
        if kind == "comments":
            made = element("h3", words(1, 3)) + "".join(r.choice((paragraph, lambda: element("div", words(1, 4) + paragraph(), "comments", 0.5)))() for _ in range(r.randint(1, 6)))
        if kind == "footer":
            made = r.choice(("&copy; ", "")) + r.choice((words(2, 20), element("p", words(2, 20)), links()))
        if r.random() < 0.15:
            made += element("button", words(1, 3), kind, 0.3)
        tag = r.choice(tags.get(kind, ("div", "div", "section", "aside", "p") if kind != "comments" else ("div", "section", "ol")))
        sure = tag in ("nav", "header", "footer", "aside")
        return element(tag, made, kind, 0.5 if sure else 1.0, "0")

    def body() -> str:
        kinds = [lambda: paragraph()] * 12 + [
            lambda: element(r.choice(("h2", "h3")), words(1, 9)),
            lambda: element(r.choice(("ul", "ol")), "".join(element("li", words(1, 25)) for _ in range(r.randint(1, 6)))),
            lambda: element("blockquote", paragraph()),
            lambda: element("pre", words(2, 30)),
            lambda: element("figure", "<img src=x>" + element("figcaption", words(2, 15))),
            lambda: element("table", "".join(element("tr", "".join(element("td", words(1, 4)) for _ in range(3))) for _ in range(r.randint(1, 4)))),
            lambda: element("div", paragraph() + paragraph(), r.choice(("content", "neutral")), 0.6),
            lambda: element("section", element("h2", words(1, 6)) + paragraph(), "content", 0.3),
        ]
        inner = [element("h1", words(2, 14))] * (r.random() < 0.85) + [r.choice(kinds)() for _ in range(r.randint(1, 12))]
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            inner.insert(r.randint(1, len(inner)), element("button", words(1, 3), "share", 0.4, "0") if r.random() < 0.2 else clutter(r.choice(("advert", "share", "sidebar", "notice", "comments"))))
        return "".join(inner)

    pages = []
    for _ in range(n):
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        story = element(tag, body(), "content", 0.4 if tag in ("article", "main") else 1.0, "1")
        if tag == "article" and r.random() < 0.4:
            story = element(r.choice(("main", "div")), story, "neutral", 0.5, "0")
        above = [clutter(k) for k in ("menu", "header", "notice", "advert") if r.random() < 0.55]
        below = [clutter(k) for k in ("comments", "sidebar", "advert", "share", "footer", "notice") if r.random() < 0.45]
        r.shuffle(above)
        inner = "".join([*above, story, *below])
        for _ in range(r.choice((0, 0, 1, 2))):
            inner = element("div", inner, "neutral", 0.8, "0")
        pages.append(f"<html><head><title>{words(1, 6)}</title></head><body>{inner}</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the labelled pages, trained once in a process."""
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Add text (the main text, empty if none) to pages and drop html; a null html is empty. No shuffle.

    Every row keeps its place, repeated ones too; an empty table gives no rows. A column text that pages has already
    is replaced, all others are passed on, whatever their names. Pages of any length are read whole. Character
    references are decoded, runs of white space become one space, nothing else is dropped or cut.
    """
    kept = [n for n in pages.columns if n not in ("html", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, "html"):
                yield pa.record_batch([*piece.columns[1:], pa.array(map(model.text, texts), pa.string())], names=[*kept, "text"])

    rows = pages.select(F.coalesce("html", F.lit("")).alias("html"), *kept)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{fields}text string")
