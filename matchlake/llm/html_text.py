"""Main text of web pages: boosted trees over DOM nodes, decoded as a tree.

A page becomes a tree of elements (missing end tags are implied, unknown ones ignored).  Every
element has features: its tag, the words of its class, id and role, those of the elements around it,
depth and place among its siblings, and the density of text, links and tags in its subtree.  Boosted
trees give each element the odds of holding main text.

The trees learn on at most ``TRAIN_PAGES`` pages, picked by a hash of the id, from elements whose
markup says what they are (an article, a menu ...); rows are also shown without these signs, so
that density and place must be learned as well.  Decoding takes the consistent choice of
highest probability: what lies in a dropped element is dropped.  A page of which nothing would be
kept gives all text that its markup does not call anything else.

Character references are decoded; white space in a block becomes one blank; blocks are joined by
one blank in page order.  A null or empty page has an empty text; without any page to learn from all
elements but technical ones are kept.  Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.boosting import BoostedTrees

TRAIN_PAGES = 300

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math object select textarea head "
                 "button canvas audio video".split())
#: Raw elements whose content is no markup.
_OPAQUE = frozenset("script style textarea iframe".split())
_INLINE = frozenset(
    "a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strike strong sub "
    "sup time tt u var wbr ins del label big acronym ruby rb rp rt".split())
#: Start tags that end an open element of these names.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Elements that such an implied end does not reach across.
_BARRIER = frozenset("table ul ol dl div section article main body html".split())

_MAIN_TAGS = frozenset("article main".split())
_PLATE_TAGS = frozenset("nav footer aside header form menu dialog".split())
_MAIN_WORDS = frozenset("article main content post entry story body text".split())
_PLATE_WORDS = frozenset(
    "nav navigation navbar menu footer header masthead sidebar aside ad ads advert advertisement "
    "sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay form "
    "search login signup subscribe newsletter comment comments reply replies disqus share social "
    "related recommended breadcrumb breadcrumbs pagination widget toolbar complementary "
    "contentinfo".split())
_KINDS = ("p", "div", "section", "li", "a", "heading", "table", "inline", "main", "plate")
_SIGNS = 8  # the leading features; one view of the training rows goes without
FEATURES = _SIGNS + len(_KINDS) - 2 + 14


@dataclass
class Page:
    """Elements in document order, and pieces of text with their element and block."""
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    main: list[int] = field(default_factory=list)
    plate: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page()
    tags, parents, ends, pieces = page.tag, page.parent, page.end, page.pieces

    def open_element(name: str, attributes: str) -> None:
        up = stack[-1] if stack else -1
        tags.append(name)
        parents.append(up)
        ends.append(0)
        page.depth.append(len(stack))
        page.place.append(page.children[up] if up >= 0 else 0)
        if up >= 0:
            page.children[up] += 1
        page.children.append(0)
        words = [w.lower() for found in _NAMES.findall(attributes)
                 for w in _WORD.findall("".join(found))] if "=" in attributes else ()
        page.main.append((name in _MAIN_TAGS) + sum(w in _MAIN_WORDS for w in words))
        page.plate.append((name in _PLATE_TAGS) + sum(w in _PLATE_WORDS for w in words))
        stack.append(len(tags) - 1)

    def close_to(level: int) -> None:
        for node in stack[level:]:
            ends[node] = len(tags)
        del stack[level:]

    stack: list[int] = []
    open_element("html", "")
    block = raw = 0  # raw: depth of elements whose text is never shown
    at = 0
    while found := _TOKEN.match(source, at):
        at = found.end()
        slash, name, attributes, slash2, name2, attributes2, text = found.groups()
        if text is not None:
            if not raw:
                pieces.append((stack[-1], block, text))
            continue
        name = name or name2
        if not name:
            continue
        name = name.lower()
        if name not in _INLINE:
            block += 1
        if slash or slash2:
            for level in range(len(stack) - 1, 0, -1):
                if tags[stack[level]] == name:
                    close_to(level)
                    break
        elif name in _VOID or name == "html":
            continue
        else:
            attributes = attributes or attributes2 or ""
            if name == "p" or name not in _INLINE and name not in _CLOSES:
                _end_open(stack, tags, {"p"}, close_to)
            if name in _CLOSES:
                _end_open(stack, tags, _CLOSES[name], close_to)
            if name in _OPAQUE:
                stop = re.compile(f"</{name}", re.I).search(source, at)
                at = stop.start() if stop else len(source)
            if not attributes.endswith("/") or name not in ("svg", "path"):
                open_element(name, attributes)
                if name in _OPAQUE and at >= len(source):
                    break
        raw = sum(tags[n] in _RAW for n in stack) if name in _RAW else raw
        if raw and not any(tags[n] in _RAW for n in stack):
            raw = 0
    close_to(0)
    return page


def _end_open(stack: list[int], tags: list[str], names: set[str], close_to) -> None:
    """Close the nearest open element of ``names``, unless a container stands between."""
    for level in range(len(stack) - 1, 0, -1):
        tag = tags[stack[level]]
        if tag in names:
            close_to(level)
            return
        if tag in _BARRIER:
            return


def _kind(tag: str) -> str | None:
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "heading"
    if tag in ("ul", "ol", "li", "dl", "dt", "dd"):
        return "li"
    if tag in ("table", "tr", "td", "th", "tbody", "thead"):
        return "table"
    if tag in ("p", "div", "section", "a"):
        return tag
    return "inline" if tag in _INLINE else None


def features(page: Page) -> np.ndarray:
    """One row per element; subtree sums come from running sums over document order."""
    n = len(page.tag)
    up = np.array(page.parent)
    ends = np.array(page.end)
    here = np.arange(n)
    depth = np.array(page.depth)
    main, plate = np.array(page.main, float), np.array(page.plate, float)
    chars, stops, words = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, _, text in page.pieces:
        chars[node] += len(text)
        words[node] += text.count(" ")
        stops[node] += text.count(".") + text.count(",")
    link = np.array([t == "a" for t in page.tag], float)

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return sums[ends] - sums[here]

    safe_up = np.maximum(up, 0)
    main_up, plate_up = main.copy(), plate.copy()
    link_up = link.copy()
    for node in range(1, n):  # a parent comes before its children
        main_up[node] += 0.7 * main_up[up[node]]
        plate_up[node] += 0.7 * plate_up[up[node]]
        link_up[node] = max(link_up[node], link_up[up[node]])
    text, tags, sentence, word = below(chars), below(np.ones(n)), below(stops), below(words)
    linked = below(chars * link_up)
    total = max(1.0, text[0])
    kinds = [_kind(t) for t in page.tag]
    brothers = np.array(page.children, float)[safe_up]
    place = np.array(page.place, float)
    out = np.zeros((n, FEATURES), np.float32)
    signs = (main, plate, main_up, plate_up, below(main) - main, below(plate) - plate,
             main_up - plate_up, np.maximum(main_up[safe_up], 0) - plate_up[safe_up])
    for k, column in enumerate(signs):
        out[:, k] = column
    at = _SIGNS
    for name in _KINDS[:-2]:
        out[:, at] = [k == name for k in kinds]
        at += 1
    rest = (depth, place, brothers, place / np.maximum(1, brothers - 1), np.array(page.children),
            np.log1p(text), text / total, text / tags, linked / np.maximum(1, text),
            sentence / np.maximum(1, text), np.log1p(word), np.log1p(tags), here / n,
            text / np.maximum(1, text[safe_up]))
    for k, column in enumerate(rest):
        out[:, at + k] = column
    return out


def signs(page: Page) -> np.ndarray:
    """What the markup says of every element: 1 main text below, 0 none, -1 nothing."""
    n = len(page.tag)
    said = np.full(n, -1)
    for node in range(n):
        inherited = said[page.parent[node]] if node else -1
        if page.tag[node] in _RAW or page.plate[node]:
            said[node] = 0
        elif page.main[node] and inherited != 0:
            said[node] = 1
        else:
            said[node] = inherited
    for node in range(n - 1, 0, -1):
        # what contains main text is kept for its sake
        if said[node] == 1 and said[page.parent[node]] == -1:
            said[page.parent[node]] = 1
    return said


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The consistent choice of highest probability, as a flag for every element.

    Inline elements without a sign of their own share the choice of what they stand in.
    """
    n = len(page.tag)
    shares = [node > 0 and page.tag[node] in _INLINE and not page.main[node]
              and not page.plate[node] for node in range(n)]
    odds = np.where(shares, 0.0, odds)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    sums = np.concatenate([[0.0], np.cumsum(no)])
    drop = (sums[np.array(page.end)] - sums[:n]).tolist()
    keep = yes.tolist()
    for node in range(n - 1, 0, -1):
        keep[page.parent[node]] += keep[node] if shares[node] else max(keep[node], drop[node])
    kept = np.zeros(n, bool)
    kept[0] = True
    for node in range(1, n):
        kept[node] = kept[page.parent[node]] and (shares[node] or keep[node] > drop[node])
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    out, last = [], -1
    flags = kept.tolist()
    for node, block, text in page.pieces:
        if flags[node]:
            if block != last:
                out.append(" ")
                last = block
            out.append(html.unescape(text) if "&" in text else text)
    return " ".join("".join(out).split())


def extract(sources: list[str], model: BoostedTrees | None) -> list[str]:
    """The main text of every page; the pages' elements are scored together."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    if model is None:
        return [text_of(p, np.ones(len(p.tag), bool)) for p in pages]
    odds = model.log_odds(np.concatenate([features(p) for p in pages]))
    ends = np.cumsum([len(p.tag) for p in pages])
    return [text_of(p, decode(p, odds[e - len(p.tag):e])) or text_of(p, signs(p) != 0)
            for p, e in zip(pages, ends)]


def fit(x: np.ndarray, y: np.ndarray) -> BoostedTrees:
    """Trees on three views of the rows: as they are, without signs, and with signs alone true.

    The second view teaches density and place, the third, in which all other features come from
    another row, that signs go before them.
    """
    masked, mixed = x.copy(), x.copy()
    masked[:, :_SIGNS] = 0
    mixed[:, _SIGNS:] = x[np.random.default_rng(7).permutation(len(x)), _SIGNS:]
    return BoostedTrees(rounds=30, depth=3).fit(
        np.concatenate([x, masked, mixed]), np.concatenate([y, y, y]).astype(float))


# --- Spark ----------------------------------------------------------------------

def train(pages: DataFrame, key: str = "page_id", source: str = "html",
          most: int = TRAIN_PAGES) -> BoostedTrees | None:
    """Boosted trees from at most about ``most`` pages; None if their markup says nothing."""
    rows = pages.where(F.col(source).isNotNull())
    share = min(1.0, most / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("pages")), F.lit(1 << 20)) / float(1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for s in batch.column("html").to_pylist():
                page = parse(s)
                said = signs(page)
                use = said >= 0
                x.append(features(page)[use])
                y.append(said[use])
            if x:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(np.concatenate(x)), pa.list_(pa.float32())),
                     pa.array(np.concatenate(y), pa.int64())], names=["x", "y"])

    # the elements of at most about ``most`` pages
    sample = rows.where(draw < share).select(F.col(source).alias("html")) \
        .mapInArrow(run, "x array<float>, y long").toArrow().sort_by("y")
    if not len(sample):
        return None
    x = np.array(sample.column("x").to_pylist(), np.float32)
    y = sample.column("y").to_numpy()
    if y.min() == y.max():
        return None
    order = np.lexsort((*x.T, y))  # the same model whatever the order of the tasks
    x, y = x[order], y[order]
    return fit(x, y)


def main_texts(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """Per page: key, url, text and n_chars."""
    model = train(pages, key, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = extract(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=[key, "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("k"), F.col("url").cast("string").alias("url"),
                        F.coalesce(source, F.lit("")).alias("html")) \
        .mapInArrow(run, f"{key} long, url string, text string, n_chars long")
