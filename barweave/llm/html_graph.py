"""Main text of web pages by a graphical model on the page's tree.

Every block element and every run of text is a node with a hidden state: content or not. Its own features (tag, words
in class and id, text length, share of linked text) give a node potential, and each edge has a parent-child potential
that depends on the child's kind. Sum-product messages, leaves to root and back, give each node's marginal. Both sorts
of potentials are fitted to labelled pages by gradient ascent on the likelihood, whose gradient needs just those
marginals.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

_START = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z])", re.S)
_TAG = re.compile(r"[^\s/>]*")
# a quote delimits an attribute's value only right after the equals sign
_REST = re.compile(r"(?:[^>=]++|=\s*+(?>\"[^\"]*\"|'[^']*')?+)*+", re.S)
_PLAIN, _VALUE = re.compile(r"[^>=]*"), re.compile(r"=\s*+(?>\"[^\"]*\"|'[^']*')?+", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEAD_END = re.compile(r"</head\s*>|<body", re.I)
_LABEL = re.compile(r"data-main=\"([01])\"")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style title head template noscript iframe object svg canvas audio video textarea select option button datalist map".split())
RAW = frozenset("script style title textarea noscript iframe template svg".split())
BLOCK = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article section main nav aside header footer form fieldset legend label "
    "blockquote pre figure figcaption address details summary dialog hgroup menu search center hr".split()
)
KIND = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), "heading"), **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("li", "dt", "dd"), "item"),
    **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table"), **dict.fromkeys(("article", "main"), "article"), **dict.fromkeys(("form", "fieldset", "legend", "label", "dialog", "search"), "form"),
    **dict.fromkeys(("div", "section", "center", "details", "summary"), "box"), **dict.fromkeys(("p", "blockquote", "pre", "figcaption", "figure"), "p"), "nav": "nav", "aside": "aside", "header": "header", "footer": "footer", "address": "footer",
    "html": "root", "body": "root",
}
GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip toolbar topbar",
    "head": "header masthead banner logo branding topbar",
    "foot": "footer copyright legal colophon credits foot",
    "side": "sidebar side aside related recommended recommendations widget rail trending popular archive tags tag more",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay paywall banner disclaimer toast signup",
    "talk": "comment comments reply replies discussion disqus respond feedback reader commentlist",
    "share": "share sharing social follow facebook twitter rss print",
    "form": "form search login signin register contact input",
    "main": "article content post entry story main body text prose page blog news maincontent articlebody postbody",
    "meta": "byline author date time published meta dateline timestamp caption",
}
_GROUP: dict[str, frozenset[str]] = {}
for _name, _list in GROUPS.items():
    for _word in _list.split():
        _GROUP[_word] = _GROUP.get(_word, frozenset()) | {_name}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}


@dataclass
class Page:
    parent: list[int] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    features: list[tuple] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)  # a text run; None for an element
    block: list[int] = field(default_factory=list)  # number of the block that a text run is part of


@lru_cache(maxsize=256)
def _tags(tag: str, only_end: bool = False) -> re.Pattern:
    return re.compile(rf"</{tag}" if only_end else rf"<(/?){tag}\b[^>]*>", re.I)


def _markup(source: str) -> Iterator[re.Match | tuple[int, int, str, str, str]]:
    """Comments and declarations (matches), and tags (start, end, slash, name, attributes), in order; send a place to go on from there.

    Tags that never end are text. The work is linear: nothing is looked for after the last ``>``; and where a tag has no
    end, what its attributes went through is known to lead to none, so no later tag goes that way again.
    """
    last, end = source.rfind(">"), len(source)
    at, dead, careful, skip = 0, set(), False, 0
    while m := _START.search(source, at, last + 1):
        start = m.start()
        if m[2] is None:
            if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
                yield start, end, "", "", ""  # a comment without an end hides the rest
                return
            at = (yield m) or m.end()
            continue
        at = start + 1
        if start < skip:
            continue
        name_end = _TAG.match(source, m.end() - 1).end()
        stop = -1
        if not careful:
            stop = _REST.match(source, name_end).end()
            careful = stop >= end
        if careful:
            stop, path, p = -1, [], name_end
            while (q := _PLAIN.match(source, p).end()) < end:
                if source[q] == ">":
                    stop = q
                    break
                if q in dead:
                    break
                path.append(q)
                p = _VALUE.match(source, q).end()
            if stop < 0:
                dead.update(path)
                first = path[0] if path else q
                # tags that begin before a space before that place take the same way from there
                skip = max(skip, *(source.rfind(x, name_end, first) for x in " \t\n\r\f/"))
                continue
        at = (yield start, stop + 1, m[1], source[m.end() - 1 : name_end], source[name_end:stop]) or stop + 1
    if (tail := source.find("<!--", max(at, last + 1))) >= 0:
        yield tail, end, "", "", ""


def _length(n: int) -> int:
    return min(8, n.bit_length())


def parse(source: str) -> Page:
    """The page's tree; text with white space runs made one space, character references decoded."""
    page = Page()
    add_parent, add_kind, add_features, add_label, add_text, add_block = page.parent.append, page.kind.append, page.features.append, page.label.append, page.text.append, page.block.append
    stack: list[tuple[str, int, bool]] = []  # name, node, whether it is a block
    node, label, block, links = -1, 0, 0, 0
    labels: dict[int, int] = {}
    above: dict[int, frozenset] = {}  # what the ancestors' names hint at
    run: list[str] = []
    linked = 0

    def element(tag: str, attributes: str) -> int:
        groups: frozenset[str] = frozenset()
        if attributes:
            for m in _NAMES.finditer(attributes):
                for word in _WORDS.findall(m[2] or m[3] or m[4] or ""):
                    groups |= _GROUP.get(word.lower(), frozenset())
            if _HIDDEN.search(attributes):
                groups |= {"hidden"}
        kind = KIND.get(tag, "inline")
        add_parent(node)
        add_kind(kind)
        around = above.get(node, frozenset())
        add_features((kind, *sorted(f"{kind}:{g}" if kind == "root" else g for g in groups), *[f"under-{g}" for g in sorted(around)]))
        above[len(page.parent) - 1] = around | (groups - {"main", "meta"}) if groups and kind != "root" else around
        add_label(label)
        add_text(None)
        add_block(0)
        return len(page.parent) - 1

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = "".join(run)
            if words := text.split():
                clean = " ".join(words)
                share = 0 if not linked else 1 if linked * 2 < len(clean) else 2
                end = clean[-1] in ".!?。:;\"”…"
                add_parent(node)
                add_kind("text")
                add_features(("text", f"len{_length(len(words))}", f"link{share}", f"end{int(end)}", f"in-{page.kind[node] if node >= 0 else 'none'}"))
                add_label(label)
                add_text(text)
                add_block(block)
            elif page.text and page.text[-1] is not None and page.block[-1] == block:
                page.text[-1] += " "
            run = []
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            if links:
                linked += len(text)

    def close(depth: int) -> None:
        nonlocal node, label, block
        flush()
        if any(x[2] for x in stack[depth:]):
            block += 1
        del stack[depth:]
        node = next((x[1] for x in reversed(stack) if x[1] >= 0), -1)
        label = labels.get(node, 0)

    at, last, heads = 0, source.rfind(">") + 1, True
    tokens = _markup(source)
    m = next(tokens, None)

    def following():
        try:
            return tokens.send(at)
        except StopIteration:
            return None

    while m is not None:
        begin, stop, slash, tag, attributes = m if isinstance(m, tuple) else (*m.span(), "", "", "")
        take(source[at:begin])
        at, tag = stop, tag.lower()
        if not tag:
            m = following()
            continue
        if not slash:
            if tag in RAW:
                end = _tags(tag, only_end=True).search(source, at)
                if not end:
                    at = len(source)
                    break
                at = (source.find(">", end.start()) + 1) or len(source)
                if tag not in ("script", "style"):
                    take(" ")
                m = following()
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                    block += 1
                else:
                    take(" " if tag in ("br", "img", "input", "wbr") and tag != "wbr" else "")
                m = following()
                continue
            if tag in DROPPED and tag != "head":
                if attributes.endswith("/"):
                    m = following()
                    continue
                depth, end = 1, at
                for inner in _tags(tag).finditer(source, at, last):
                    depth += -1 if inner[1] else 1
                    if not depth:
                        end = inner.end()
                        break
                else:
                    end = len(source)
                take(" ")
                at = end
                m = following()
                continue
            if tag == "head":
                end = _HEAD_END.search(source, at) if heads else None
                heads = end is not None
                if end:
                    at = end.end() if end[0].startswith("</") else end.start()
                m = following()
                continue
            if tag in BLOCK:
                flush()
                block += 1
                for shut in (("p",) if tag not in ("label",) else ()) + CLOSES.get(tag, ()):
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == shut:
                            close(depth)
                            break
                        if stack[depth][0] in ("table", "ul", "ol", "dl", "td", "th", "div", "article", "section", "body", "li") and stack[depth][0] not in CLOSES.get(tag, ()):
                            break
                own = element(tag, attributes)
                if (mark := _LABEL.search(attributes)) is not None:
                    label = int(mark[1])
                    page.label[own] = label
                labels[own] = label
                node = own
                stack.append((tag, own, True))
            else:
                if tag == "a":
                    links += 1
                own = -1
                if attributes and tag != "a" and _NAMES.search(attributes):
                    flush()
                    own = element(tag, attributes)
                    labels[own] = label
                    node = own
                if attributes[-1:] != "/" or own >= 0:
                    stack.append((tag, own, False))
        else:
            if tag == "a":
                links = max(0, links - 1)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if stack[depth][1] >= 0 or depth < len(stack) - 1 and tag in BLOCK:
                        close(depth)
                    else:
                        del stack[depth]
                    break
                if stack[depth][2] and tag not in BLOCK:
                    break
        m = following()
    take(source[at:])
    flush()
    if not any(k == "article" or "main" in f for k, f in zip(page.kind, page.features, strict=True)):
        page.features = [f + (f"bare-{f[0]}",) if len(f) > 1 and f[0] == "text" or f[0] in ("p", "heading", "root") else f for f in page.features]
    return page


class Model:
    """Potentials; ``node``: log-odds of content by feature, ``edge``: by child's kind for parent 0/1 and child 0/1."""

    def __init__(self, node: dict[str, float] | None = None, edge: dict[str, list[float]] | None = None):
        self.node, self.edge = dict(node or {}), dict(edge or {})
        self.seen: dict[tuple, float] = {}
        self.odds: dict[str, tuple[float, float, float, float]] = {}

    def _unary(self, features: tuple) -> float:
        if (x := self.seen.get(features)) is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            x = self.seen[features] = math.exp(max(-30.0, min(30.0, sum(self.node.get(f, 0.0) for f in features))))
        return x

    def _pair(self, kind: str) -> tuple[float, float, float, float]:
        if (x := self.odds.get(kind)) is None:
            x = self.odds[kind] = tuple(math.exp(v) for v in self.edge.get(kind, (0.0, 0.0, 0.0, 0.0)))
        return x

    def marginals(self, page: Page) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Each node's probability of content, and each edge's four joint probabilities, by sum-product."""
        n, parent = len(page.parent), page.parent
        one = [self._unary(f) for f in page.features]  # unnormalised belief in 1 against a belief in 0 of 1, from below
        zero = [1.0] * n
        up0, up1 = [1.0] * n, [1.0] * n
        pairs = [self._pair(k) for k in page.kind]
        for v in range(n - 1, -1, -1):
            scale = one[v] + zero[v]
            a, b = zero[v] / scale, one[v] / scale
            zero[v], one[v] = a, b
            if (p := parent[v]) >= 0:
                e00, e01, e10, e11 = pairs[v]
                m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
                up0[v], up1[v] = m0, m1
                zero[p] *= m0
                one[p] *= m1
                if zero[p] + one[p] < 1e-100:
                    zero[p] *= 1e100
                    one[p] *= 1e100
        out, joint = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        for v in range(n):
            p = parent[v]
            e00, e01, e10, e11 = pairs[v]
            if p < 0:
                s0, s1 = e00 * zero[v], e11 * one[v]
                out[v] = s1 / (s0 + s1)
                joint[v] = (1 - out[v], 0.0, 0.0, out[v])
                continue
            above1 = out[p] / up1[v] if up1[v] else 0.0
            above0 = (1 - out[p]) / up0[v] if up0[v] else 0.0
            j00, j01, j10, j11 = above0 * e00 * zero[v], above0 * e01 * one[v], above1 * e10 * zero[v], above1 * e11 * one[v]
            total = j00 + j01 + j10 + j11
            joint[v] = (j00 / total, j01 / total, j10 / total, j11 / total)
            out[v] = joint[v][1] + joint[v][3]
        return out, joint

    def fit(self, pages: list[Page], rounds: int = 120, rate: float = 0.4, decay: float = 0.002) -> Model:
        """Gradient ascent (adaptive steps) on the likelihood of the pages' labels."""
        square: dict = defaultdict(lambda: 1e-3)
        for _ in range(rounds):
            slope: dict = defaultdict(float)
            for page in pages:
                out, joint = self.marginals(page)
                for v, p in enumerate(page.parent):
                    miss = page.label[v] - out[v]
                    for f in page.features[v]:
                        slope["n", f] += miss
                    true = (3 if page.label[v] else 0) if p < 0 else 2 * page.label[p] + page.label[v]
                    for i in range(4):
                        slope["e", page.kind[v], i] += (i == true) - joint[v][i]
            for key, g in slope.items():
                kind, name = key[0], key[1]
                row = self.edge.setdefault(name, [0.0] * 4) if kind == "e" else self.node
                at = key[2] if kind == "e" else name
                now = row[at] if kind == "e" else row.get(at, 0.0)
                g -= decay * now * len(pages)
                square[key] += g * g
                row[at] = now + rate * g / math.sqrt(square[key])
            self.seen.clear()
            self.odds.clear()
        return self

    def extract(self, source: str, least: float = 0.5) -> str:
        """The content's blocks, joined by line feeds; white space inside a block is one space."""
        page = parse(source)
        if not page.parent:
            return ""
        chance, _ = self.marginals(page)
        lines: list[str] = []
        last = -1
        for v, text in enumerate(page.text):
            if text is not None and chance[v] >= least:
                if page.block[v] == last:
                    lines[-1] += text
                else:
                    lines.append(text)
                    last = page.block[v]
        return "\n".join([x for x in (" ".join(y.split()) for y in lines) if x])


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame, model: Model) -> DataFrame:
    """The main text of every page, from the whole html: page_id, url, text, n_chars.

    Null or empty html gives the empty text. Rows are independent: repeated rows repeat the result, an empty table
    gives an empty one, and columns besides page_id, url and html are not read.
    """
    node, edge = model.node, model.edge

    def run(batches):
        own = Model(node, edge)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [own.extract(x) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, SCHEMA)
