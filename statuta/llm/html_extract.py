"""Main text of web pages by boosted trees over the block elements of the page, decoded along the tree.

A page is read into its block elements. Each has features: its depth, text and tag density of its subtree,
share of link text, place among its siblings and what they hold, and tokens of its tag and attributes and of
those above it. Gradient-boosted trees give the odds that an element belongs to the main text. The choice is
made for all elements of a page together: the best one in which nothing below a dropped element is kept.

No page is labelled. The trees learn from pages whose markup says what is what (article and main against
navigation, footers, asides, forms, advertising and so on), once as they are and once without these tokens,
so that pages with bare markup are judged by their structure; each page also once with furniture put among its
paragraphs.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample, in pages.
SAMPLE = 500

# fixed values: elements by their part in the reading of a page
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption legend".split()
)
RAW = frozenset("script style title textarea noscript iframe".split())  # no markup inside, no self-closing form
HIDDEN = frozenset("template svg select button object canvas math audio video".split())
FOREIGN = frozenset("svg math".split())  # a slash ends them
ENDS_P = BLOCKS - frozenset("html body dd dt li td th tr tbody thead tfoot caption summary legend figcaption".split())
SAME = {  # an opening tag ends an open element of these kinds, up to the element that holds them
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME = frozenset(
    "nav navbar navigation menu menubar header footer foot sidebar side aside ad ads advert adverts advertisement adbox "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay form "
    "search login signup subscribe newsletter comment comments reply replies disqus discussion share sharing social related "
    "recommended breadcrumb breadcrumbs pagination pager toolbar widget copyright legal skip contentinfo complementary".split()
)
CONTENT = frozenset("article articlebody main content post entry story blogpost maincontent".split())

# A quote counts only where a value begins; nothing is tried twice, so reading is linear in the page.
TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)"""
    r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z))""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
TOKEN = re.compile(r"[a-z]+")


class Page:
    """Block elements in page order (parent, tag, tokens), and the text blocks that belong to them."""

    def __init__(self, source: str):
        self.parent, self.tag = [-1], ["html"]
        self.chrome, self.content = [0], [0]
        self.text: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._open, self._links, self._parts, self._linked = [0], 0, [], 0
        self._places: dict[str, list[int]] = {}  # of a tag: where it stands among the open elements
        self._hidden: list[str] = []  # an element whose text is left out, and what is open in it
        self._to_block = False  # it has no end tag, so the next block ends it
        self._ends: dict[str, int] = {}  # of a tag: where its next end tag begins, as far as looked for
        self._read(source)

    def _end_text(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.text.append((self._open[-1], text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _close(self, place: int) -> None:
        self._end_text()
        for element in self._open[place:]:
            self._places[self.tag[element]].pop()
        del self._open[place:]
        self._links = 0

    def _last(self, *tags: str) -> int:
        """Where the innermost open element of these kinds stands; 0 without."""
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=0)

    def _next_end(self, source: str, tag: str, at: int) -> int:
        """Where the next end tag of this kind begins, the page's length without; the page is passed once a tag."""
        found = self._ends.get(tag, -1)
        if found < at:
            ahead = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at)
            found = self._ends[tag] = ahead.start() if ahead else len(source)
        return found

    def _stays_hidden(self, closing: str, tag: str) -> bool:
        """Whether a tag inside a hidden element is done with; otherwise the element has ended before it.

        It ends with its end tag, with the element that holds it, with another one of its kind, and, if it
        has no end tag, with the next block.
        """
        if tag not in BLOCKS and tag not in HIDDEN:
            return True
        if self._to_block or (not closing and tag == self._hidden[0] and tag in ("button", "select")):
            self._hidden = []
            return False
        if not closing:
            self._hidden.append(tag)
        elif tag in self._hidden:
            while self._hidden.pop() != tag:
                pass
        elif self._last(tag):
            self._hidden = []
            return False
        return True

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = TAG.search(source, at)
            if not found:
                break
            if found.start() > at:
                self._add(source[at : found.start()])
            at = found.end()
            closing, tag, attributes = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW:
                if not closing:
                    gone = TAG.match(source, self._next_end(source, tag, at))
                    at = gone.end() if gone else end
            elif self._hidden and self._stays_hidden(closing, tag):
                continue
            elif tag in HIDDEN:
                if not closing and not (tag in FOREIGN and attributes.endswith("/")):
                    self._hidden = [tag]
                    self._to_block = self._next_end(source, tag, at) == end
            elif tag in BLOCKS:
                self._ended(tag) if closing else self._begun(tag, attributes)
            elif tag == "a":
                self._links = 0 if closing else 1
            elif tag in ("br", "hr", "img", "input", "wbr"):
                if tag == "hr":
                    self._end_text()
                elif tag == "br":
                    self._parts.append(" ")
        if at < end:
            self._add(source[at:])
        self._end_text()

    def _add(self, raw: str) -> None:
        if self._hidden:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._links:
            self._linked += len(text)

    def _begun(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        tags, stack = self.tag, self._open
        if tag in ENDS_P and (place := self._last("p")) > self._last("td", "th", "table"):
            self._close(place)
        if tag in SAME:
            ended, holders = SAME[tag]
            if (place := self._last(*ended)) > self._last(*holders):
                self._close(place)
        self._end_text()
        tokens = {tag}
        if attributes:
            for found in ATTRIBUTE.finditer(attributes):
                tokens.update(TOKEN.findall((found[1] or found[2] or found[3] or "").lower()))
        self.parent.append(stack[-1])
        tags.append(tag)
        self.chrome.append(len(tokens & CHROME))
        self.content.append(len(tokens & CONTENT))
        self._places.setdefault(tag, []).append(len(stack))
        stack.append(len(tags) - 1)

    def _ended(self, tag: str) -> None:
        if place := self._last(tag):
            self._close(place)
        else:
            self._end_text()

    def features(self) -> np.ndarray:
        """One row an element. Tokens stand in columns TOKENS."""
        n = len(self.tag)
        parent = self.parent
        own, linked, marks, words, begin = ([0.0] * n for _ in range(5))
        total = 0
        for element, text, links in self.text:
            if not own[element]:
                begin[element] = total
            own[element] += len(text)
            linked[element] += links
            marks[element] += sum(map(text.count, ".,;:!?"))
            words[element] += text.count(" ") + 1
            total += len(text)
        size, tags = list(own), [1.0] * n
        links, depth, children, place = list(linked), [0] * n, [0] * n, [0] * n
        chrome, content = [0] * n, [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
            place[i] = children[parent[i]]
            children[parent[i]] += 1
            chrome[i] = chrome[parent[i]] + self.chrome[parent[i]]
            content[i] = content[parent[i]] + self.content[parent[i]]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            size[p] += size[i]
            links[p] += links[i]
            tags[p] += tags[i]
            marks[p] += marks[i]
            words[p] += words[i]
            begin[p] = min(begin[p] or begin[i], begin[i] or begin[p])
        up = np.array(parent)
        size, tags, links, marks, words, children = map(np.array, (size, tags, links, marks, words, children))
        siblings = np.maximum(1, children[up])
        kind = [(t == "p", t in HEADINGS, t in ("li", "dt", "dd"), t in ("td", "th", "tr", "table"), t == "div") for t in self.tag]
        return np.column_stack(
            [
                depth,
                np.log1p(size),
                np.log1p(own),
                links / np.maximum(1, size),
                np.log1p(tags),
                np.log1p(size / tags),
                siblings,
                np.array(place) / siblings,
                np.log1p(np.maximum(0, size[up] - size) / siblings),
                marks / np.maximum(1, words),
                np.log1p(words),
                size / max(1, total),
                np.array(begin) / max(1, total),
                *np.array(kind, float).T,
                self.chrome,
                self.content,
                chrome,
                content,
            ]
        ).astype(np.float32)

    def told(self) -> np.ndarray:
        """What the markup says: 1 main text, 0 not, -1 nothing."""
        n = len(self.tag)
        label = [-1] * n
        for i in range(1, n):
            above = label[self.parent[i]]
            if above == 0 or self.chrome[i]:
                label[i] = 0
            elif above == 1 or self.content[i]:
                label[i] = 1
        return np.array(label)


TOKENS = slice(18, 22)
WIDTH = 22


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth, as arrays: features, thresholds and leaves; log-odds add up."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32) -> Trees:
    """Trees for the logistic loss, grown on histograms of at most `bins` cuts a feature."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)])
    odds = np.full(len(y), prior)
    inner = 2**depth - 1
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        slope, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            here = np.nonzero(at == node)[0]
            best = 1e-6
            if len(here) >= 4:
                g, h = slope[here], curve[here]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[here, f]
                    gl = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[node], threshold[node] = float(gain[i]), f, c[i]
            at[here] = 2 * node + 1 + (x[here, feature[node]] > threshold[node])
        leaf = np.bincount(at - inner, slope, inner + 1) / (np.bincount(at - inner, curve, inner + 1) + 1) * rate
        odds += leaf[at - inner]
        trees.append((feature, threshold, leaf))
    return Trees(prior, *(np.array(t) for t in zip(*trees)))


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The most likely choice of kept elements in which every kept element's ancestors are kept.

    Equal choices keep. The root itself is always kept and has no odds of its own.
    """
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep[0] = 0.0
    kept = np.zeros(len(parent), bool)
    best = keep.copy()
    lost = drop.copy()
    for i in range(len(parent) - 1, 0, -1):  # best[i]: of the subtree if i is kept; lost[i]: if it is dropped
        best[parent[i]] += max(best[i], lost[i])
        lost[parent[i]] += lost[i]
    kept[0] = True
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and best[i] >= lost[i]
    return kept


def extract(pages: list[str], trees: Trees | None) -> list[str]:
    """The main text of each page; without trees, and on pages of which they would keep nothing, all blocks outside elements with tokens of page furniture."""
    read = [Page(p) for p in pages]
    if not read:
        return []
    features = [p.features() for p in read]
    flat = np.concatenate(features)
    odds = trees.odds(flat) if trees else np.where(flat[:, TOKENS][:, [0, 2]].sum(axis=1) > 0, -1.0, 1.0)
    out, at = [], 0
    for page, x in zip(read, features):
        kept = decode(page.parent, odds[at : at + len(x)])
        at += len(x)
        if not any(kept[element] for element, _, _ in page.text):  # too little to judge: go by the tokens
            kept = x[:, TOKENS][:, [0, 2]].sum(axis=1) == 0
        out.append("\n".join(text for element, text, _ in page.text if kept[element]))
    return out


def furnished(source: str) -> str:
    """The page with furniture put between its paragraphs, as pages have it that this sample may lack.

    Which kind goes where follows from a hash of the page; the words are the page's own.
    """
    kinds, spot = sorted(CHROME), zlib.crc32(source.encode())
    places = [m.end() for m in re.finditer(r"</p\s*>|</h1\s*>", source)]
    texts = [t for _, t, _ in Page(source).text] or ["text"]
    for turn, place in enumerate(sorted({places[(spot >> 4 * i) % len(places)] for i in range(3)}, reverse=True) if places else []):
        kind = kinds[(spot >> turn) % len(kinds)]
        words = texts[(spot >> turn) % len(texts)].split()[: 3 + (spot >> 3 * turn) % 40]
        tag = kind if kind in BLOCKS else "div"
        inner = entities.escape(" ".join(words))
        source = f'{source[:place]}<{tag} class="{kind}"><p>{inner}</p></{tag}>{source[place:]}'
    return source


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, seed: int = 11) -> Trees | None:
    """Trees from about `sample` pages (chosen by a hash of id and page, alike ones once) whose markup tells enough; None without."""
    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html"))
    n = rows.select("id").count()
    if not n:
        return None
    share = min(1.0, sample / n)
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), "html", F.lit(seed)), F.lit(1 << 30))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(v) for t in batch.column(1).to_pylist() for v in (t, furnished(t))]
            x = [p.features()[p.told() >= 0] for p in found]
            y = [(t := p.told())[t >= 0] for p in found]
            x, y = ([np.concatenate(v[i : i + 2]) for i in range(0, len(v), 2)] for v in (x, y))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.astype(np.int8).tobytes() for v in y], pa.binary())],
                names=["id", "x", "y"],
            )

    drawn = rows.where(draw <= F.lit(int(share * (1 << 30)))).dropDuplicates(["id", "html"])
    told = drawn.mapInArrow(read, "id STRING, x BINARY, y BINARY").toArrow()
    told = told.sort_by([("id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(told["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    y = np.frombuffer(b"".join(told["y"].to_pylist()), np.int8).astype(float)
    if len(y) < 50 or y.min() == y.max():
        return None
    bare = x.copy()
    bare[:, TOKENS] = 0
    return boost(np.concatenate([x, bare]), np.concatenate([y, y]))


def main_text(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", trees: Trees | None = None, learn: bool = True
) -> DataFrame:
    """(id, url, text, n_chars) for every row.

    A null or empty page has an empty text. Broken markup is read as far as it goes: open elements end with
    the page, an unfinished tag is dropped, a quote counts only where a value of an attribute begins, and a
    button, a video or the like without an end tag ends at the next block. Repeated rows and null ids are kept; an empty table gives an
    empty result; columns other than the three named ones are not read. Pages of any length are read whole.
    """
    model = train(pages, id_col, html_col) if trees is None and learn else trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = extract([t or "" for t in batch.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("_html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text STRING, n_chars BIGINT")
