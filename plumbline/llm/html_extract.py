"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text between the borders of block elements, with the ancestors' tags and class words.
Each open element only keeps the features that it adds to those around it, and the places of open elements are held by tag,
so parsing and scoring take time in proportion to the page however deep it is nested. A block's features are its tags, its ancestors' tags and class words, and its text's form. The field has two labels (main text
or not), is trained by its exact likelihood on labelled pages, and each page is decoded by Viterbi.

The labelled pages are built by ``labelled_pages`` from a seed: layouts with menus, headers, sidebars, notices, adverts,
forms and reader comments around and inside articles, each leaf with its label. ``PAGES`` bounds their number.

Defined results: null and empty pages, and pages without main text, give the empty text; scripts, styles, comments and
unfinished tags are no text; a line break is white space; repeated rows each get a result; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import schema_of, table

PAGES, STEPS, RATE, L2 = 600, 400, 0.3, 0.005
#: Elements that end a run of text where they begin and end.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose inside is no markup, and those whose inside is no text.
RAW, HIDDEN = frozenset("script style textarea title xmp iframe noembed noframes".split()), frozenset("script style template noscript iframe svg math object noembed noframes select datalist".split())
#: An open element of the first name ends where one of the others begins.
ENDS = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: A new list or table may hold items of its own within an open item.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"td", "th", "button"}, "head": set()}
#: An end tag reaches beyond one of these only if it is one of the second kind.
CLOSED = frozenset("article body nav aside footer header main table".split())
STRONG = frozenset("html body article nav aside footer header main section div table form".split())
#: A start tag ends no element outside of these.
WALLS = frozenset("div article section aside nav form footer header main blockquote".split())
SECTIONS = frozenset("article aside body div footer form head header main nav section".split())
#: For each tag, the open elements that it may end, and those beyond which it doesn't look for them.
ENDED = {t: [o for o, by in ENDS.items() if t in by] for t in frozenset().union(*ENDS.values())}
LIMITS = {t: WALLS.union(*[SCOPES[o] for o in own if o != "head"]) for t, own in ENDED.items()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)(?:>|\Z)|([^<]+|<)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
#: Of labelled pages: an attribute that no page's own features come from.
_KEEP = re.compile(r"\sdata-keep=keep\b")


@lru_cache(maxsize=1 << 12)
def _innermost(tag: str, near: str) -> tuple[str, ...]:
    return f"last:{tag}", f"near:{near}", f"near:{near}>{tag}", "bias"


@lru_cache(maxsize=1 << 12)
def _own_features(tag: str, attributes: str) -> tuple[str, ...]:
    found = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes)) if "=" in attributes else ""
    return (f"in:{tag}", *(f"name:{w}" for w in set(_WORD.findall(found.lower())))) if found else (f"in:{tag}",)


class Path:
    """An open element: the one around it, the features that it adds to those around it, and the ones of the innermost element."""

    __slots__ = ("above", "added", "near", "own", "tag")

    def __init__(self, above: Path | None, tag: str, added: tuple[str, ...]):
        self.above, self.tag, self.added = above, tag, added
        self.near = tag if tag in SECTIONS else above.near if above else ""
        self.own = (_innermost if len(tag) < 64 else _innermost.__wrapped__)(tag, self.near)

    def features(self) -> list[str]:
        out, at = list(self.own), self
        while at:
            out += at.added
            at = at.above
        return out


#: Around all elements.
TOP = Path(None, "", ())


@dataclass
class Block:
    """A leaf: its text, the characters of it in links, its innermost element, and whether a labelled page marks it as main text."""

    text: str
    linked: int
    path: Path
    keep: bool = False


def parse(page: str, labelled: bool = False) -> list[Block]:
    """The leaf blocks of a page in order."""
    blocks: list[Block] = []
    open_: list[Path] = []
    places: dict[str, list[int]] = {}  # of open elements, by tag
    having: dict[str, int] = {}  # open elements by feature
    features: list[tuple[str, ...]] = []  # of each open element
    marks: list[bool] = []
    parts: list[str] = []
    linked = hidden = links = marked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            blocks.append(Block(text, linked, open_[-1] if open_ else TOP, marked > 0))
        parts.clear()
        linked = 0

    def pop(n: int) -> None:
        """Closes open elements down to n of them."""
        nonlocal hidden, links, marked
        if any(o.tag in BLOCKS for o in open_[n:]):
            close()
        for o in open_[n:]:
            hidden -= o.tag in HIDDEN
            links -= o.tag == "a"
            places[o.tag].pop()
            marked -= marks.pop()
            for f in features.pop():
                having[f] -= 1
        del open_[n:]

    def last(tags) -> int:
        """The place of the innermost open element of one of these tags, or -1."""
        return max((p[-1] for t in tags if (p := places.get(t))), default=-1)

    at, size = 0, len(page)
    while at < size and (m := _TOKEN.match(page, at)):
        at = m.end()
        ending, tag, rest, text = m.groups()
        if text is not None:
            if not hidden:
                parts.append(text)
                linked += len(text) * bool(links)
        elif tag is not None:
            tag = tag.lower()
            if not m.group().endswith(">"):
                break  # cut off within a tag
            if ending:
                n = places[tag][-1] if places.get(tag) else -1
                if n == len(open_) - 1 >= 0:
                    pop(n)
                elif n >= 0 and (tag in STRONG or n >= last(CLOSED)):  # an inner end tag doesn't close what is outside
                    pop(n)
                continue
            if tag in ENDED and (n := last(ENDED[tag])) >= 0 and n >= last(LIMITS[tag]):
                pop(n)
            if tag in BLOCKS:
                close()
            if tag == "br":
                parts.append(" ")
            if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
                continue
            own = (_own_features if len(rest) < 256 and len(tag) < 64 else _own_features.__wrapped__)(tag, rest)  # long ones aren't remembered
            open_.append(Path(open_[-1] if open_ else TOP, tag, tuple(f for f in own if not having.get(f))))
            for f in own:
                having[f] = having.get(f, 0) + 1
            features.append(own)
            places.setdefault(tag, []).append(len(open_) - 1)
            marks.append(labelled and bool(rest) and bool(_KEEP.search(rest)))
            marked += marks[-1]
            hidden += tag in HIDDEN
            links += tag == "a"
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                stop = end.start() if end else size
                if not hidden:
                    parts.append(page[at:stop])
                at = stop
    close()
    return blocks


def _text_features(b: Block) -> list[str]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    size = "1" if words <= 2 else "2" if words <= 8 else "3" if words <= 25 else "4"
    share = b.linked / max(1, n)
    return [f"words:{size}", f"links:{0 if not share else 1 if share < 0.5 else 2}", f"ends:{b.text[-1] if b.text[-1] in '.!?:' else 'other'}", f"sign:{b.text[0] in '©|•»'}"]


class Field:
    """The trained field: a weight by feature for the label of main text, and the transitions."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps = weights, [[float(x) for x in row] for row in steps]

    def scores(self, blocks: list[Block]) -> list[float]:
        get, out = self.weights.get, []
        inherited: dict[Path, float] = {}  # weights of what an element and those around it add
        for b in blocks:
            above, at = [], b.path
            while at and at not in inherited:
                above.append(at)
                at = at.above
            total = inherited[at] if at else 0.0
            for p in reversed(above):
                total += sum(get(f, 0.0) for f in p.added)
                inherited[p] = total
            out.append(total + sum(get(f, 0.0) for f in b.path.own) + sum(get(f, 0.0) for f in _text_features(b)))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The labels of the best sequence (Viterbi)."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.steps
        unary = self.scores(blocks)
        off, on = 0.0, unary[0]
        back = []
        for u in unary[1:]:
            to_off, to_on = off + s00 >= on + s10, off + s01 > on + s11
            back.append((not to_off, not to_on))
            off, on = max(off + s00, on + s10), max(off + s01, on + s11) + u
        label, out = on > off, []
        for at in range(len(blocks) - 1, -1, -1):
            out.append(label)
            if at:
                label = back[at - 1][label]
        return out[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS) -> Field:
    """Maximum likelihood with L2, by full gradients from forward and backward sums over all pages at once."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))  # so that the pages with a k-th block come first
    longest, n_pages = len(pages[0][0]), len(pages)
    some = [sum(len(p[0]) > k for p in pages) for k in range(longest)]
    mask, y = np.zeros((longest, n_pages), bool), np.zeros((longest, n_pages), int)
    index: dict[str, int] = {}
    where, which = [], []
    for i, (blocks, labels) in enumerate(pages):
        mask[: len(blocks), i] = True
        y[: len(labels), i] = labels
        for j, b in enumerate(blocks):
            for f in b.path.features() + _text_features(b):
                where.append(j * n_pages + i)
                which.append(index.setdefault(f, len(index)))
    where, which = np.array(where), np.array(which)
    w, t = np.zeros(len(index)), np.zeros((2, 2))
    gw, gt = np.full(len(index), 1e-8), np.full((2, 2), 1e-8)
    seen = np.zeros((2, 2))
    before, after = np.nonzero(mask[1:])  # each pair of neighbours, by the first one's place
    np.add.at(seen, (y[before, after], y[before + 1, after]), 1)
    lasts = mask.sum(axis=0) - 1, np.arange(n_pages)
    for _ in range(steps):
        u = np.bincount(where, w[which], longest * n_pages).reshape(longest, n_pages)
        forward, backward = np.zeros((2, longest, n_pages)), np.zeros((2, longest, n_pages))  # by label
        forward[1, 0] = u[0]
        for k in range(1, longest):
            off, on = forward[:, k - 1, : some[k]]
            forward[0, k, : some[k]] = np.logaddexp(off + t[0, 0], on + t[1, 0])
            forward[1, k, : some[k]] = np.logaddexp(off + t[0, 1], on + t[1, 1]) + u[k, : some[k]]
        total = np.logaddexp(forward[0][lasts], forward[1][lasts])
        for k in range(longest - 1, 0, -1):
            off, on = backward[0, k, : some[k]], backward[1, k, : some[k]] + u[k, : some[k]]
            for label in (0, 1):
                backward[label, k - 1, : some[k]] = np.logaddexp(t[label, 0] + off, t[label, 1] + on)
        share = np.where(mask, np.exp(np.where(mask, forward[1] + backward[1] - total, 0)), 0)
        made = np.empty((2, 2))
        for x in (0, 1):
            left = forward[x][before, after] - total[after]
            for z in (0, 1):
                made[x, z] = np.exp(left + t[x, z] + backward[z][before + 1, after] + (u[before + 1, after] if z else 0)).sum()
        dw = np.bincount(which, (y * mask - share).ravel()[where], len(index)) - L2 * w
        dt = seen - made - L2 * t
        gw += dw**2
        gt += dt**2
        w += RATE * dw / np.sqrt(gw)
        t += RATE * dt / np.sqrt(gt)
    return Field({f: float(w[i]) for f, i in index.items()}, t)


#: Class words of the labelled pages.
_OUT = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav links toc pagination pager",
    "header": "header masthead topbar banner site logo branding",
    "footer": "footer bottom copyright legal colophon credits",
    "aside": "sidebar aside widget related recommended trending popular more promo rail",
    "ad": "ad ads advert advertisement sponsor sponsored adsbygoogle promoted teaser",
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay message warning paywall",
    "form": "form newsletter subscribe signup login search contact",
    "comments": "comments comment discussion replies reply respond disqus reader feedback",
    "share": "share social sharing follow tags meta tools toolbar",
}
_IN = "content article post entry main body story text page wrapper container column blog single hentry container row inner"


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """Pages whose leaves of main text carry data-keep."""
    r = Random(seed)
    letters = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]

    def words(lo: int, hi: int) -> str:
        made = ["".join(r.choices(letters, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join([made[0].capitalize(), *made[1:]]) + r.choice([".", ".", ".", "", "!", "?", ":"])

    def leaf(tag: str, keep: bool, text: str) -> str:
        inner = text if r.random() < 0.8 else f"<{(t := r.choice(['b', 'em', 'strong', 'i', 'span']))}>{text}" + (f"</{t}>" if r.random() < 0.7 else "")
        return f"<{tag}{' data-keep=keep' if keep else ''}>{inner}" + ("<br>" if r.random() < 0.1 else "") + (f"</{tag}>" if tag not in ("p", "li") or r.random() < 0.7 else "")

    def listed(links: bool, lo: int, hi: int) -> str:
        items = [f'<li><a href="#">{words(1, 3)}</a></li>' if links else leaf("li", False, words(1, 12)) for _ in range(r.randint(lo, hi))]
        return "<ul>" + "".join(items) + "</ul>"

    def named(kind: str) -> str:
        return r.choice([f' class="{r.choice(_OUT[kind].split())}"', f' id="{r.choice(_OUT[kind].split())}"', f' class="{r.choice(_OUT[kind].split())}-{r.choice(["box", "area", "top", "list"])}"'])

    def noise(kind: str) -> str:
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "section", "aside"])
        tag = r.choice(tag)
        own = tag == kind or tag in ("nav", "aside", "header", "footer", "form")
        name = "" if own and r.random() < 0.5 else named(kind)
        body = {
            "nav": lambda: listed(True, 2, 8),
            "header": lambda: leaf(r.choice(["p", "div", "h2"]), False, words(1, 8)) + (listed(True, 1, 5) if r.random() < 0.4 else ""),
            "footer": lambda: ("&copy; " if r.random() < 0.5 else "") + words(2, 40) + (leaf("p", False, words(3, 30)) if r.random() < 0.4 else ""),
            "aside": lambda: leaf("h3", False, words(1, 4)) + (listed(r.random() < 0.7, 1, 6) if r.random() < 0.7 else leaf("p", False, words(4, 40))),
            "ad": lambda: words(2, 40) if r.random() < 0.6 else leaf("p", False, words(2, 40)),
            "notice": lambda: leaf("p", False, words(4, 40)) + ("<button>" + words(1, 2) + "</button>" if r.random() < 0.5 else ""),
            "form": lambda: "<label>" + words(1, 4) + "</label><input name=q>" + (leaf("p", False, words(3, 20)) if r.random() < 0.5 else "") + "<button>" + words(1, 2) + "</button>",
            "comments": lambda: leaf("h3", False, words(1, 3)) + "".join(f'<div class="{r.choice(["comment", "reply", "comment-body"])}">' + leaf("p", False, words(2, 60)) + "</div>" for _ in range(r.randint(1, 4))),
            "share": lambda: listed(True, 1, 5) if r.random() < 0.6 else words(1, 5),
        }[kind]()
        return f"<{tag}{name}>{body}</{tag}>"

    def paragraph() -> str:
        x = r.random()
        if x < 0.75:
            text = words(1, 3) if r.random() < 0.15 else words(2, 90)
            if r.random() < 0.15:
                text += f' <a href="#">{words(1, 4)}</a> ' + words(1, 10)
            return leaf("p", True, text)
        if x < 0.85:
            return leaf(r.choice(["h2", "h3", "h4"]), True, words(1, 8))
        if x < 0.9:
            return leaf("blockquote", True, words(4, 40))
        if x < 0.95:
            return r.choice(["<ul>", "<ol>"]) + "".join(leaf("li", True, words(1, 20)) for _ in range(r.randint(2, 5))) + "</ul>"
        return r.choice([leaf("pre", True, words(3, 20)), "<table><tr>" + leaf("td", True, words(1, 6)) + leaf("td", True, words(1, 6)) + "</tr></table>", "<figure><img src=x>" + leaf("figcaption", True, words(2, 15)) + "</figure>"])

    pages = []
    for _ in range(n):
        inner = [leaf("h1", True, words(1, 12))] * (r.random() < 0.9) + [paragraph() for _ in range(r.randint(1, 12))]
        for kind in r.choices(["ad", "share", "aside", "form", "notice"], k=r.choice([0, 0, 1, 2])):
            inner.insert(r.randint(1, len(inner)), noise(kind))
        if r.random() < 0.2:
            inner.append(noise("comments"))
        name = r.choice(["", "", f' class="{r.choice(_IN.split())}"', f' id="{r.choice(_IN.split())}"', f' class="{r.choice(_IN.split())}-{r.choice(_IN.split())}"'])
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        core = f"<{tag}{name}>" + "".join(inner) + (f"</{tag}>" if r.random() < 0.95 else "")
        if r.random() < 0.3:
            core = f'<{r.choice(["main", "div"])} class="{r.choice(_IN.split())}">' + core + "</div></main>"
        before = [noise(k) for k in ("header", "nav", "notice", "ad", "aside", "form", "share") if r.random() < (0.6 if k in ("nav", "header") else 0.3)]
        after = [noise(k) for k in ("comments", "aside", "ad", "share", "form", "notice", "footer") if r.random() < (0.85 if k == "footer" else 0.25)]
        r.shuffle(before)
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title></head><body>" + "".join(before) + core + "".join(after) + ("</body></html>" if r.random() < 0.8 else ""))
    return pages


@lru_cache(maxsize=1)
def trained(n: int = PAGES, seed: int = 11) -> Field:
    """Of the labelled pages; made once in a driver."""
    parsed = [parse(p, labelled=True) for p in labelled_pages(n, seed)]
    return train([(blocks, [b.keep for b in blocks]) for blocks in parsed])


def main_text(page: str, model: Field) -> str:
    blocks = parse(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """All columns of pages but html, and text; a column so named is replaced."""
    pages = pages.drop("text")
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def extracted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.schema.get_field_index("html")
            texts = [main_text(x, shared.value) if x else "" for x in batch.column(at).to_pylist()]
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(texts, pa.string())], names=[*[batch.schema.names[i] for i in keep], "text"])

    return pages.mapInArrow(extracted, schema_of(pages.drop("html"), "text string"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
