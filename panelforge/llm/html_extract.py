"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks: stretches of text that no block-level tag divides, each
with the tags, classes and ids of its ancestors. Every block has binary features of its ancestors and its
text; the field scores labels (main text or not) by them and by the label of the block before. It is
trained by gradient ascent of the conditional likelihood on labelled pages and decoded by Viterbi.
The labelled pages are laid out from a small grammar of page parts whose label is known.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "svg", "iframe", "object")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of HTML: tags without content, tags inside a line, and what a tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, stop, name (empty: no element), whether it ends an element, and attributes of each tag, comment and raw element.

    One pass: where quotes leave a tag open to the end of the page, that tag and all later ones end at
    the next ``>``, whatever the quotes. A ``<`` that nothing closes is text.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = len(page) if stop < 0 else stop + 3
            yield start, at, "", False, ""
            continue
        if start > last:
            return
        at = start + 1
        if page[at] in "!?":
            at = page.find(">", at) + 1
            yield start, at, "", False, ""
            continue
        end = page[at] == "/"
        name = _NAME.match(page, at + end)
        if not name:
            continue
        stop = name.end()
        while quotes:
            mark = _STOP.search(page, stop)
            if not mark or mark[0] != ">" and (close := page.find(mark[0], mark.end())) < 0:
                quotes = False
            elif mark[0] == ">":
                stop = mark.start()
                break
            else:
                stop = close + 1
        else:
            stop = page.find(">", name.end())
        tag, attrs, at = name[0].lower(), page[name.end() : stop], stop + 1
        if not end and tag in _RAW:
            closed = _RAW[tag].search(page, at)
            at = closed.end() if closed else len(page)
            tag = ""
        yield start, at, tag, end, attrs


def step_features(tag: str, names: str) -> frozenset[str]:
    """Features of one ancestor: its tag and the words of its classes and ids."""
    found = {f"in:{tag}"}
    for word in _SPLIT.split(_CAMEL.sub("-", names).lower()):
        if len(word) > 1:
            found.add(f"named:{word}")
            found.add(f"named:{word[:5]}*")
    return frozenset(found)


Path = tuple[str, frozenset, frozenset]


def blocks(page: str | None) -> list[tuple[str, Path, float]]:
    """The leaf blocks of a page: text, nearest tag, features of all ancestors and of the nearest named one, and the share of its text in links."""
    page = page or ""
    out: list[tuple[str, Path, float]] = []
    stack: list[Path] = []  # of block-level tags, with the features from the top down to each and of the last that is named
    known: dict[tuple[str, str], frozenset] = {}
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked = links = 0
    path = path_of_none = ("", frozenset(), frozenset())

    def close() -> None:
        nonlocal linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                out.append((words, path, min(1.0, linked / len(words))))
            text.clear()
        linked = 0

    at = 0
    for start, stop, tag, end, attrs in _tags(page):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if links:
                linked += len(piece)
        at = stop
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if end else 1
            elif tag == "br":
                text.append(" ")
            continue
        close()
        links = 0
        if end:
            while open_tags[tag]:
                shut = stack.pop()[0]
                open_tags[shut] -= 1
                if shut == tag:
                    break
        else:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
                open_tags[stack.pop()[0]] -= 1
            if tag not in VOID and not attrs.endswith("/"):
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)) if attrs else ""
                own = known.get((tag, names))
                if own is None:
                    own = known[tag, names] = step_features(tag, names)
                _, above, named = stack[-1] if stack else path_of_none
                stack.append((tag, above if own <= above else above | own, own if len(own) > 1 else named))
                open_tags[tag] += 1
        path = stack[-1] if stack else path_of_none
    text.append(page[at:])
    close()
    return out


def path_features(path: Path) -> list[str]:
    """Ancestor tags, the words of their classes and ids, those of the nearest that has any, and the nearest tag."""
    found = {f"own:{path[0]}", *path[1], *(f"near:{x}" for x in path[2])}
    if not {"in:article", "in:main"} & found:
        found.add("outside")
    return sorted(found)


def text_features(text: str, link_share: float) -> list[str]:
    n = len(text)
    found = ["bias", f"long:{min(6, n.bit_length() // 2)}", f"links:{int(link_share * 3)}"]
    if text[-1] in ".!?…\"”»":
        found.append("sentence")
    if text[0] in "©®":
        found.append("sign")
    words = text.count(" ") + 1
    found.append(f"words:{min(5, words.bit_length())}")
    if "|" in text or "»" in text or "·" in text:
        found.append("bars")
    return found


class Field:
    """Weights of a two-label chain: label 1 is main text."""

    def __init__(self, weights: dict[str, tuple[float, float]], start: np.ndarray, moves: np.ndarray):
        self.weights, self.start, self.moves = weights, start.tolist(), moves.tolist()
        self.by_path: dict[Path, tuple[float, float]] = {}

    def _sum(self, features: list[str]) -> tuple[float, float]:
        found = [w for f in features if (w := self.weights.get(f))]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def decode(self, page: list[tuple[str, Path, float]]) -> list[int]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.moves
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, (text, path, share) in enumerate(page):
            of = self.by_path.get(path)
            if of is None:
                if len(self.by_path) > 20_000:
                    self.by_path.clear()
                of = self.by_path[path] = self._sum(path_features(path))
            own = self._sum(text_features(text, share))
            x, y = of[0] + own[0], of[1] + own[1]
            if k == 0:
                a, b = self.start[0] + x, self.start[1] + y
                continue
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[str, list[int]]], steps: int = 120, decay: float = 3e-4) -> Field:
    """Fit a field on pages with a label for each block, by the gradient of the conditional likelihood."""
    rows = [[path_features(p) + text_features(t, s) for t, p, s in blocks(page)] for page, _ in pages]
    for (page, labels), r in zip(pages, rows):
        if len(labels) != len(r):
            raise ValueError("a label for each block is needed")
    index = {f: i for i, f in enumerate(sorted({f for r in rows for b in r for f in b}))}
    n, longest = len(rows), max(map(len, rows))
    place, feature = [], []
    for i, r in enumerate(rows):
        for j, b in enumerate(r):
            place += [i * longest + j] * len(b)
            feature += [index[f] for f in b]
    place, feature = np.array(place), np.array(feature)
    lengths = np.array([len(r) for r in rows])
    mask = np.arange(longest)[None, :] < lengths[:, None]
    gold = np.zeros((n, longest, 2))
    for i, (_, labels) in enumerate(pages):
        gold[i, np.arange(len(labels)), labels] = 1
    theta = np.zeros(len(index) * 2 + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    real = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        w, start, moves = theta[:-6].reshape(-1, 2), theta[-6:-4], theta[-4:].reshape(2, 2)
        emit = np.stack([np.bincount(place, weights=w[feature, k], minlength=n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2), 0)
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + behind - whole[:, None, None]) * mask[:, :, None]
        pair = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        pair = (np.exp(pair) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        miss = (gold - share).reshape(-1, 2)
        grad = np.concatenate(
            [
                np.stack([np.bincount(feature, weights=miss[place, k], minlength=len(index)) for k in (0, 1)], axis=1).ravel(),
                (gold[:, 0] - share[:, 0]).sum(axis=0),
                (real - pair).ravel(),
            ]
        ) / n - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    w = theta[:-6].reshape(-1, 2)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, theta[-6:-4], theta[-4:].reshape(2, 2))


# What parts of pages that are not main text are called; fixed values, in no order of weight.
NAMES = {
    "nav": "nav menu navbar navigation topnav main-nav breadcrumb breadcrumbs toolbar tabs pagination pager site-nav skip",
    "header": "header masthead site-header page-header top-bar branding logo banner",
    "footer": "footer site-footer page-footer copyright colophon legal bottom",
    "aside": "sidebar side-bar aside widget related recommended trending popular more-stories rail toc tags",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense ad-slot banner-ad commercial",
    "notice": "notice cookie cookie-notice cookie-banner gdpr consent alert popup modal newsletter paywall subscribe disclaimer warning",
    "form": "form search search-form login signup contact-form newsletter-form",
    "share": "share social sharing social-links follow",
    "comments": "comments comment comment-list reader-comments discussion responses replies disqus thread feedback",
}
MAIN_NAMES = "content article-body post-content entry-content story story-body main-content post entry article text body-text prose"


class Layouts:
    """Draws labelled pages: a page and the label of each of its blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts: list[str] = []
        self.labels: list[int] = []

    def words(self, least: int, most: int) -> str:
        syllables = "an the re on er in th ti en at nd es ou to ed ha le la de ie ch".split()
        return " ".join("".join(self.r.choices(syllables, k=self.r.randint(1, 4))) for _ in range(self.r.randint(least, most)))

    def sentence(self, least: int = 4, most: int = 40) -> str:
        return self.words(least, most).capitalize() + self.r.choice("....!?")

    def block(self, tag: str, text: str, label: int, shut: bool = True) -> None:
        self.parts.append(f"<{tag}>{text}" + (f"</{tag}>" if shut else ""))
        self.labels.append(label)

    def opened(self, kind: str) -> str:
        """Open a part of ``kind``; gives the tag to close it by."""
        native = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        name = self.r.choice(NAMES[kind].split())
        tag = native if native and self.r.random() < 0.5 else self.r.choice(["div", "div", "section", "aside" if kind in ("ad", "notice") else "div"])
        if kind == "form" and self.r.random() < 0.6:
            tag = "form"
        named = "" if tag == native and self.r.random() < 0.6 else f' {self.r.choice(["class", "id"])}="{name}"'
        self.parts.append(f"<{tag}{named}>")
        return tag

    def side(self, kind: str) -> None:
        r = self.r
        tag = self.opened(kind)
        if kind in ("nav", "share", "aside") and r.random() < 0.7 or kind in ("header", "footer") and r.random() < 0.3:
            if kind == "aside" and r.random() < 0.5:
                self.block("h3", self.words(1, 4), 0)
            self.parts.append("<ul>")
            for _ in range(r.randint(2, 7)):
                self.block("li", f'<a href="/{self.words(1, 1)}">{self.words(1, 5)}</a>', 0)
            self.parts.append("</ul>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.block(r.choice(["label", "p", "button", "legend"]), self.words(1, 6), 0)
            self.parts.append("<input type=text>")
        elif kind == "comments":
            if r.random() < 0.6:
                self.block(r.choice(["h2", "h3"]), self.words(1, 3), 0)
            for _ in range(r.randint(1, 5)):
                self.parts.append(r.choice(['<div class="comment">', "<li>", '<article class="comment">', "<div>"]))
                shut = {"<li>": "</li>", '<article class="comment">': "</article>"}.get(self.parts[-1], "</div>")
                for _ in range(r.randint(1, 2)):
                    self.block("p", " ".join(self.sentence() for _ in range(r.randint(1, 3))), 0)
                self.parts.append(shut)
        elif kind == "footer" and r.random() < 0.6:
            self.parts.append(f"&copy; {self.words(1, 2)}.example &middot; {self.sentence(2, 9)}")
            self.labels.append(0)
        elif r.random() < 0.5:
            self.parts.append(self.sentence(2, 25))
            self.labels.append(0)
        else:
            for _ in range(r.randint(1, 3)):
                self.block(r.choice(["p", "div", "h4"]), self.sentence(2, 20), 0)
        self.parts.append(f"</{tag}>")

    def main(self) -> None:
        r = self.r
        tag, name = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", "*"), ("section", "*"), ("article", "*"), ("div", "*")])
        self.parts.append(f"<{tag}{f' class={chr(34)}{r.choice(MAIN_NAMES.split())}{chr(34)}' if name else ''}>")
        title = self.words(1, 12).capitalize()
        self.block("h1", title, 1)
        for k in range(r.randint(1, 12)):
            kind = r.random()
            if k and kind < 0.08:
                self.block(r.choice(["h2", "h3"]), self.words(1, 8), 1)
            elif k and kind < 0.14:
                self.parts.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.block("li", self.sentence(1, 12), 1)
                self.parts.append("</ul>")
            elif k and kind < 0.18:
                self.block("blockquote", self.sentence(), 1)
            elif k and kind < 0.21:
                self.block("pre", self.words(3, 20), 1)
            elif k and kind < 0.33:
                self.side(r.choice(["ad", "notice", "share", "form", "aside", "nav"]))
            else:
                text = " ".join(self.sentence(1, 30) for _ in range(r.choice([1, 1, 2, 4, 8]))) if r.random() > 0.06 else self.sentence(1, 2)
                if r.random() < 0.15:
                    text = f"{text} <a href=/x>{self.words(1, 3)}</a> {self.words(1, 4)}."
                if r.random() < 0.15:
                    text = f"<b>{text}<br>"
                if r.random() < 0.05:
                    text += r.choice([" |", " &middot; ", " &raquo;", " &copy;"]) + r.choice(["", self.words(1, 3)])
                self.block("p", text, 1, shut=r.random() < 0.9)
        if r.random() < 0.2:
            self.side(r.choice(["comments", "share", "aside"]))
        self.parts.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.parts, self.labels = ["<!DOCTYPE html><html><head>"], []
        self.block("title", self.words(2, 10), 0)
        self.parts.append("<style>p{margin:0}</style><script>var a='<p>';</script></head><body>")
        wrapped = r.random() < 0.3
        if wrapped:
            self.parts.append(r.choice(['<div id="page">', '<div class="wrapper">', '<div class="container">']))
        for kind in r.sample(["nav", "header", "ad", "notice", "form", "aside", "nav", "header"], r.randint(0, 4)):
            self.side(kind)
        self.main()
        for kind in r.sample(["comments", "aside", "ad", "share", "form", "notice", "comments", "nav"], r.randint(0, 3)):
            self.side(kind)
        if r.random() < 0.85:
            self.side("footer")
        self.parts.append(("</div>" if wrapped else "") + r.choice(["</body></html>", ""]))
        return "".join(self.parts), list(self.labels)


def labelled_pages(n: int = 500, seed: int = 1) -> list[tuple[str, list[int]]]:
    """``n`` labelled pages, equal for an equal seed."""
    layouts = Layouts(seed)
    return [layouts.page() for _ in range(n)]


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, label in zip(found, field.decode(found)) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``pages`` with ``text`` (empty where none is found) and ``n_chars``; all its columns but one called text are kept.

    Null and empty pages have an empty text; a page without tags is one block; repeated rows give
    repeated results. Each page is decoded whole and alone, so nothing is shuffled.
    """
    pages = pages.drop("text", "n_chars")
    names = pages.columns
    model = field or train(labelled_pages())
    state = (model.weights, np.array(model.start), np.array(model.moves))
    at = names.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*state)
        for b in batches:
            texts = [main_text(p, own) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{plain}, text string, n_chars long")
