"""Main text of web pages by boosted trees over the nodes of the document tree."""

from __future__ import annotations

import html as references
import random
import re
import zlib
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import column, sampled_texts, with_columns

#: Pages of the corpus and made pages that the model is fitted on at most, and bytes of the corpus's.
SAMPLE, MADE, SAMPLE_BYTES = 300, 400, 32 << 20
#: Buckets of attribute tokens by hash, each a feature.
TOKEN_BUCKETS = 32

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
HIDDEN = frozenset("script style noscript template iframe svg math head title object audio video canvas datalist map".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption button select option label textarea".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption button select option label textarea legend html body".split())
KINDS = {
    "article": ("article", "main"),
    "nav": ("nav", "menu", "dir"),
    "header": ("header", "hgroup"),
    "footer": ("footer",),
    "aside": ("aside", "dialog", "search"),
    "control": ("form", "fieldset", "button", "select", "option", "label", "textarea", "legend"),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "text": ("p", "blockquote", "pre", "figcaption", "dd", "dt", "address", "td", "th", "caption"),
    "list": ("ul", "ol", "dl"),
    "item": ("li",),
    "section": ("section",),
    "div": ("div", "center", "table", "tbody", "tr", "figure", "details"),
}
KIND = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags}
GOOD = frozenset("article articlebody main maincontent content entry post story body text prose page hentry blogpost".split())
BAD = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar side rail aside footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay dialog comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations more widget subscribe subscription newsletter signup login search form pagination pager tags toolbar copyright legal disclaimer hidden teaser".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Numbers of references that no character has, and zeros before others: more digits than Python turns into a number.
LARGE, ZEROS = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?"), re.compile(r"&#(?:([xX])0+(?=[0-9a-fA-F])|0+(?=[0-9]))")
#: Characters that tags with unbalanced quotes may be searched for, as a multiple of the page's.
SEARCHED = 20


@lru_cache(100_000)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % TOKEN_BUCKETS


@dataclass(slots=True)
class Node:
    """A block element, or (tag '') a run of text between the borders of blocks."""

    tag: str
    parent: int
    good: bool = False
    bad: bool = False
    hidden: bool = False
    tokens: tuple[int, ...] = ()
    text: str = ""
    links: int = 0
    link_chars: int = 0
    children: list[int] = field(default_factory=list)


def parse(page: str | None) -> list[Node]:
    """Block elements and text runs in page order, parents first. Unclosed elements end as HTML's rules for paragraphs, list
    items, table parts and the like say; unknown and inline elements are part of the run around them. The time is linear in
    the page's length: once tags whose quotes don't end have been searched for twenty times that, a tag ends at the next >."""
    page = page or ""
    nodes = [Node("html", -1)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones share their block's node
    places: dict[str, list[int]] = {}  # in the stack, of the open elements of a name
    last_end, last_data, spare = page.rfind(">"), page.rfind("]]>"), SEARCHED * len(page)
    endless: set[str] = set()  # elements of raw text that have no end from here on
    run: list[str] = []
    links = [0, 0]
    anchor = hidden = at = 0

    def flush() -> None:
        nonlocal links
        text = "".join(run)
        if "&#" in text:
            text = ZEROS.sub(r"&#\1", LARGE.sub("\ufffd", text))
        text = " ".join(references.unescape(text).split())
        run.clear()
        if text:
            up = stack[-1][1]
            nodes.append(Node("", up, text=text, links=links[0], link_chars=min(links[1], len(text))))
            nodes[up].children.append(len(nodes) - 1)
        links = [0, 0]

    def close(depth: int) -> None:
        nonlocal hidden, anchor
        while len(stack) > depth:
            tag, own = stack[-1]
            if tag in BLOCK:
                flush()
            stack.pop()
            places[tag].pop()
            hidden -= tag in HIDDEN or (tag in BLOCK and nodes[own].hidden)
            anchor -= tag == "a"

    def last(tags, barrier) -> int:
        """The place of the topmost open element of these names, unless one of the others is above it."""
        i = max([0, *(p[-1] for t in tags if (p := places.get(t)))])
        return i if i and all(p[-1] <= i for t in barrier if (p := places.get(t))) else 0

    while at < len(page):
        cut = page.find("<", at)
        cut = len(page) if cut < 0 else cut
        if cut > at and not hidden:
            run.append(page[at:cut])
            if anchor > 0:
                links[1] += cut - at
        if cut == len(page):
            break
        if cut < last_data and page.startswith("<![CDATA[", cut):
            at = page.find("]]>", cut) + 3
            continue
        found = None
        if cut < last_end or page.startswith("<!--", cut):
            found = TOKEN.match(page, cut) if spare > 0 or page.startswith(("<!", "<?"), cut) else None
            if not found:
                spare -= len(page) - cut
                found = LOOSE.match(page, cut)
        if not found:
            if not hidden:
                run.append("&lt;")
            at = cut + 1
            continue
        at = found.end()
        if not found.group(2):
            continue
        tag = found.group(2).lower()
        if found.group(1):
            if tag in ("p", "br") and not last((tag,), ("td", "th", "body", "html")):
                run.append(" ")
            elif i := last((tag,), ("td", "th") if tag not in ("table", "tr", "td", "th", "body", "html", "tbody") else ()):
                close(i)
            continue
        attributes = found.group(3)
        if tag in VOID:
            if tag in ("br", "hr", "img", "input", "wbr"):
                if tag == "hr":
                    flush()
                elif tag != "wbr" and not hidden:
                    run.append(" ")
            continue
        if tag in CLOSES_P and (i := last(("p",), ("td", "th", "button", "table"))):
            close(i)
        for own, barrier in ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("option",), ("select",)), (("td", "th"), ("tr", "table")), (("tr",), ("table",))):
            if (tag in own or (tag == "tr" and own[0] == "td")) and (i := last(own, barrier)):
                close(i)
        if tag == "body" and (i := last(("head",), ())):
            close(i)
        if tag in ("html",) or (tag == "body" and last(("body",), ())):
            continue
        block = tag in BLOCK
        if block:
            flush()
        up = stack[-1][1]
        if block:
            tokens, dark = set(), False
            for m in NAMED.finditer(attributes) if attributes.strip() else ():
                name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                if name in ("style", "hidden"):
                    dark |= name == "hidden" or "display:none" in value.replace(" ", "").lower()
                else:
                    tokens.update(SPLIT.split(CAMEL.sub(" ", value).lower()))
            node = Node(tag, up, bool(tokens & GOOD), bool(tokens & BAD), dark, tuple({bucket(t) for t in tokens if t}))
            nodes.append(node)
            nodes[up].children.append(len(nodes) - 1)
            up = len(nodes) - 1
            hidden += dark
        hidden += tag in HIDDEN
        if tag == "a":
            links[0] += 1
            anchor += 1
        if not attributes.endswith("/") or tag in BLOCK:
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, up))
        else:
            hidden -= tag in HIDDEN
            anchor -= tag == "a"
        if tag in RAW and tag in stack[-1][0]:
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            if not end:
                endless.add(tag)
            if end:
                if not hidden:
                    run.append(page[at : end.start()].replace("<", "&lt;"))
                at = end.start()
            elif tag in HIDDEN:
                at = len(page)
    close(1)
    flush()
    return nodes


ENDS = re.compile(r"[.!?;:…。！？][\"'”’»)]*(?:\s|$)")
WORD = re.compile(r"\S+")


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: kind, kinds of its ancestors, attribute tokens of both (two lists of known ones, and all by hash),
    subtree density, depth, place among siblings."""
    n, kinds = len(nodes), len(KINDS)
    chars, link_chars, links, tags, runs, ends, wordy = (np.zeros(n) for _ in range(7))
    for i, x in enumerate(nodes):
        if not x.tag:
            chars[i], link_chars[i], links[i], runs[i] = len(x.text), x.link_chars, x.links, 1
            ends[i] = len(ENDS.findall(x.text))
            wordy[i] = x.text.count(" ") + 1
        else:
            tags[i] = 1
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        for a in (chars, link_chars, links, tags, runs, ends, wordy):
            a[up] += a[i]
    before = np.zeros(n)
    seen = 0.0
    for i, x in enumerate(nodes):
        before[i] = seen
        if not x.tag:
            seen += chars[i]
    total = max(1.0, chars[0])
    place = np.zeros(n)
    for x in nodes:
        place[x.children] = np.arange(len(x.children))
    first = kinds * 2 + 20  # of the buckets of tokens
    out = np.zeros((n, first + TOKEN_BUCKETS), np.float32)
    for i, x in enumerate(nodes):
        up, row = x.parent, out[i]
        if i:
            row[first:] = out[up, first:]
            row[kinds : kinds * 2 + 3] = out[up, kinds : kinds * 2 + 3]
            row[kinds * 2 + 3] = out[up, kinds * 2 + 3] + 1
        if (k := KIND.get(x.tag)) is not None:
            row[k] = 1
            row[kinds + k] += 1
        row[kinds * 2] += x.good
        row[kinds * 2 + 1] += x.bad
        row[kinds * 2 + 2] += x.hidden
        if i:
            mates = nodes[up].children
            row[kinds * 2 + 4] = place[i] / len(mates)
            row[kinds * 2 + 5] = len(mates)
            row[kinds * 2 + 6] = np.log1p((chars[up] - chars[i]) / max(1, len(mates) - 1))
            row[kinds * 2 + 7] = chars[i] / max(1.0, chars[up])
            row[kinds * 2 + 8] = link_chars[up] / max(1.0, chars[up])
            row[kinds * 2 + 9] = out[up, kinds * 2 + 14] if i else 0
        row[kinds * 2 + 10] = np.log1p(chars[i])
        row[kinds * 2 + 11] = chars[i] / total
        row[kinds * 2 + 12] = link_chars[i] / max(1.0, chars[i])
        row[kinds * 2 + 13] = links[i]
        row[kinds * 2 + 14] = np.log1p(chars[i] / max(1.0, tags[i]))
        row[kinds * 2 + 15] = ends[i] / max(1.0, wordy[i])
        row[kinds * 2 + 16] = wordy[i] / max(1.0, runs[i])
        row[kinds * 2 + 17] = before[i] / total
        row[kinds * 2 + 18] = x.good
        row[kinds * 2 + 19] = x.bad
        for t in x.tokens:
            row[first + t] = 1
    return out


# ---------------------------------------------------------------- boosted trees


class Boosted:
    """Gradient-boosted trees for yes or no, on features cut into at most 32 bins, all trees of one depth."""

    def __init__(self, trees: int = 40, depth: int = 5, rate: float = 0.25, least: int = 8, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T] if len(y) else []
        bins = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], 1) if cuts else x
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.start = float(np.log(p / (1 - p)))
        score, width = np.full(len(y), self.start), 33
        for _ in range(self.n if len(y) else 0):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            leaf = np.zeros(len(y), np.int64)
            split = np.full((2**self.depth - 1, 2), -1.0)  # feature, cut; a node without one sends all to the left
            for level in range(self.depth):
                m, first = 2**level, 2**level - 1
                best = np.full(m, 1e-6)
                choice = np.full((m, 2), -1, np.int64)
                total_g, total_h = np.bincount(leaf, g, m), np.bincount(leaf, h, m)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    key = leaf * width + bins[:, f]
                    left_g, left_h, left_n = (np.bincount(key, w, m * width).reshape(m, width).cumsum(1) for w in (g, h, None))
                    right_g, right_h, right_n = total_g[:, None] - left_g, total_h[:, None] - left_h, left_n[:, -1:] - left_n
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - (total_g**2 / (total_h + self.ridge))[:, None]
                    gain[(left_n < self.least) | (right_n < self.least)] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(m), at] > best
                    best[better] = gain[np.arange(m), at][better]
                    choice[better] = np.stack((np.full(m, f), at), 1)[better]
                goes = np.zeros(len(y), np.int64)
                for i in range(m):
                    f, at = choice[i]
                    if f >= 0:
                        own = leaf == i
                        goes[own] = bins[own, f] > at
                        split[first + i] = f, cuts[f][at]
                leaf = leaf * 2 + goes
            size = 2**self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            score += value[leaf]
            self.trees.append((split[:, 0].astype(np.int64), split[:, 1].astype(np.float64), value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = at + 2**level - 1
                f = feature[node]
                at = at * 2 + ((f >= 0) & (x[row, f] > cut[node]))
            out += value[at]
        return out


def decode(nodes: list[Node], scores: np.ndarray) -> list[bool]:
    """The nodes that are kept: the choice of greatest total score in which no kept node has a dropped ancestor."""
    best = np.array(scores, float)
    best[0] = max(best[0], 0) if len(best) else 0
    for i in range(len(nodes) - 1, 0, -1):
        best[i] = max(best[i], 0.0)
        best[nodes[i].parent] += best[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and best[i] > 0
    return kept


# ---------------------------------------------------------------- training pages


def labels(nodes: list[Node]) -> np.ndarray:
    """What a page's own markup says of its nodes: text is main if it is in an article (or main part, or where tokens name
    one) and in no part for something else; an element is if any of its text is."""
    has = any(x.tag in ("article", "main") for x in nodes)
    inside, out, y = [False] * len(nodes), [False] * len(nodes), np.zeros(len(nodes))
    for i, x in enumerate(nodes):
        up = x.parent
        inside[i] = (up >= 0 and inside[up]) or x.tag in ("article", "main") or (not has and x.good)
        other = KIND.get(x.tag) in (KIND["nav"], KIND["aside"], KIND["form"], KIND["footer"], KIND["header"])
        out[i] = (up >= 0 and out[up]) or x.bad or x.hidden or other
        y[i] = not x.tag and inside[i] and not out[i]
    for i in range(len(nodes) - 1, 0, -1):
        y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
    return y


def blind(nodes: list[Node]) -> list[Node]:
    """The same tree without what labels() goes by: neither attribute tokens nor elements that name a part of a page."""
    parts = {KIND[t] for t in ("article", "nav", "header", "footer", "aside", "form", "section")}
    return [replace(x, tag="div" if x.tag != "html" and KIND.get(x.tag) in parts else x.tag, good=False, bad=False, tokens=()) for x in nodes]


def made_page(seed: int) -> tuple[str, set[str]]:
    """A page of a random layout, and the blocks of its main text."""
    r = random.Random(seed)
    main: set[str] = set()
    count = [0]

    def prose(least: int, most: int, stop: bool = True) -> str:
        count[0] += 1
        words = ["".join(r.choice("aeioulnrstdm") for _ in range(r.randint(1, 9))) for _ in range(r.randint(least, most))]
        text = " ".join(w + (r.choice([".", ",", ".", ","]) if r.random() < 0.12 else "") for w in words).capitalize()
        return f"{text} {count[0]}" + ("." if stop else "")

    def block(tag: str, text: str, keep: bool) -> str:
        if keep:
            main.add(text)
        return f"<{tag}>{text}</{tag}>"

    def listed(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(1, 3, False)}</a></li>' for i in range(n)) + "</ul>"

    def other(kind: str) -> str:
        text = "".join(r.choice([f"<p>{prose(2, 40)}</p>", f"<span>{prose(2, 12)}</span>", listed(r.randint(1, 4))]) for _ in range(r.randint(1, 3)))
        if r.random() < 0.3:
            text = prose(1, 30)
        tag = {"nav": "nav", "footer": "footer", "header": "header", "sidebar": "aside", "form": "form"}.get(kind, "div")
        if tag != "div" and r.random() < 0.5:
            return f"<{tag}>{listed(r.randint(2, 8)) if kind == 'nav' else text}</{tag}>"
        return f'<div class="{r.choice([kind, "x-" + kind, kind + " box"])}">{listed(r.randint(2, 8)) if kind == "nav" else text}</div>'

    kinds = "nav footer header sidebar form ad advert comments cookie notice share related newsletter banner menu breadcrumbs".split()
    body = [block("h1", prose(3, 12, False), True)] if r.random() < 0.9 else []
    for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
        kind = r.choice(["p"] * 6 + ["h2", "ul", "blockquote", "other", "section", "pre", "table"])
        if kind == "other":
            body.append(other(r.choice(kinds[3:])))
        elif kind == "ul":
            body.append("<ul>" + "".join(block("li", prose(2, 15), True) for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind == "section":
            body.append("<section>" + block("h3", prose(1, 6, False), True) + block("p", prose(3, 60), True) + "</section>")
        elif kind == "table":
            body.append("<table><tr>" + block("td", prose(1, 5, False), True) + block("td", prose(1, 5, False), True) + "</tr></table>")
        else:
            body.append(block(kind, prose(*((2, 8, False) if kind == "h2" else (1, 120))), True))
    body.append(block("p", prose(1, 90), True))
    own = r.choice(["article", "article", "article", "main", 'div class="article-body"', 'div id="content"', 'div class="post"'])
    text = f"<{own}>{''.join(body)}</{own.split()[0]}>"
    if r.random() < 0.3:
        text = f"<main>{text}</main>" if r.random() < 0.5 else f'<div class="wrap">{text}</div>'
    top = "".join(other(r.choice(["nav", "header", "ad", "banner", "breadcrumbs", "cookie"])) for _ in range(r.randint(0, 3)))
    end = "".join(other(r.choice(kinds)) for _ in range(r.randint(0, 4))) + f"<footer>{prose(1, 25)}</footer>" * (r.random() < 0.8)
    return f"<html><head><title>{prose(2, 5)}</title></head><body>{top}{text}{end}</body></html>", main


def fit(pages: list[str | None]) -> Boosted:
    """On made pages, whose main text is known, and on pages of the corpus, by what their markup says. Every other page of the
    corpus is shown without that markup, so that the trees learn from the text's density, place and neighbours what they
    can't read from names."""
    x, y = [], []
    for seed in range(MADE):
        page, main = made_page(seed)
        nodes = parse(page)
        own = np.array([n.text in main for n in nodes], float)
        for i in range(len(nodes) - 1, 0, -1):
            own[nodes[i].parent] = max(own[nodes[i].parent], own[i])
        x.append(features(nodes)), y.append(own)
    for i, page in enumerate(pages):
        nodes = parse(page)
        own = labels(nodes)
        if own.any():
            x.append(features(blind(nodes) if i % 2 else nodes)), y.append(own)
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Adds text and n_chars (code points) to every page.

    The model is fitted on the driver on made pages and on a sample of bounded size (300 pages, the first by a hash of the
    id, with 32 MB in all). Each whole page is then parsed where it lies; all its blocks and runs of text are scored, and the
    best choice is taken in which nothing is kept below something dropped. References are decoded, white space within a block
    becomes one space, and blocks are joined by line breaks in page order. Null html is empty; a page without main text has
    the text ''. Input columns of the results' names are replaced. Repeated rows get equal results, and an empty table gives
    an empty result.
    """
    own = pages.select(column(id_col).alias("id"), column(html_col).alias("text"))
    picked = own.select("id").filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    found = sampled_texts(own, picked, sample_bytes)
    model = fit([found[i] for i in sorted(found, key=lambda i: (zlib.crc32(str(i).encode()), str(i)))])

    def run(texts):
        for at in range(0, len(texts), 100):
            trees = [parse(t) for t in texts[at : at + 100]]
            sizes = np.cumsum([len(t) for t in trees])
            scores = np.split(model.score(np.concatenate([features(t) for t in trees])), sizes[:-1])
            for nodes, own in zip(trees, scores, strict=True):
                text = "\n".join(x.text for x, keep in zip(nodes, decode(nodes, own), strict=True) if keep and not x.tag)
                yield text, len(text)

    return with_columns(pages, [html_col], "text string, n_chars long", run)
