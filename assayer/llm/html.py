"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is a sequence of tags and runs of words. Words score positive and tags negative, and one scan finds the contiguous
region with the largest sum. The weights come from labelled pages, those that mark their article themselves: a
tag costs the more the rarer it stands inside of articles, a word brings the more the rarer words of its
surroundings stand outside. Of the region, what is no running text by its element (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) is left out, and the rest is cut into blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.rows import smallest

MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>script|style|noscript|textarea|title|template|iframe|svg|select|noframes|object)\b"
    r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)

#: Elements without an end tag of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br input".split()
)
#: Elements that hold no running text,
ASIDE = frozenset("nav aside footer form button dialog menu fieldset noscript figure canvas audio video head".split())
#: and words of a class, id or role that say the same of any element.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer comment comments commentlist disqus replies notice notices "
    "cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations popup modal overlay toolbar pagination pager search complementary contentinfo alert "
    "dialog".split()
)
#: Elements that end an open one of the same kind.
SIBLINGS = {name: frozenset({name}) for name in ("p", "li", "option", "tr", "td", "th")} | {
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
}
#: Block elements before which an open paragraph ends.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)
ARTICLE = frozenset(("article", "main"))
LEAST_TAG, MOST_WORD = -10.0, 5.0
DEFAULT = {"<p": -0.1, "</p": -0.1, "<br": -0.1, "<b": -0.1, "</b": -0.1, "<h1": -0.5, "</h1": -0.5, "p": 1.0, "h1": 1.0}
OTHER_TAG, OTHER_WORD = -2.0, 0.5
#: A tag of an element that is left out anyway costs at most this.
ASIDE_TAG = -1.0


def _is_aside(name: str, rest: str, in_article: bool) -> bool:
    if name in ASIDE or name == "header" and not in_article:
        return True
    if name in ("html", "body") or not rest or rest.isspace():
        return False
    for key, *values, hidden in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if hidden or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role"):
            words = set(re.split(r"[\s_-]+", value))
            if words & ASIDE_WORDS or "header" in words and name not in ARTICLE and not in_article:
                return True
    return False


def parse(page: str):
    """(kind, name, text, aside, in_article) of each part: tags as ``<p`` or ``</p``, words under the block they are in."""
    open_: list[tuple[str, bool, bool]] = []  # name, aside, article
    at = 0

    def state() -> tuple[bool, bool]:
        return (open_[-1][1], open_[-1][2]) if open_ else (False, False)

    def words(text: str):
        aside, article = state()
        block = next((name for name, _, _ in reversed(open_) if name not in INLINE), "body")
        return ("words", block, text, aside, article and not aside)

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in names:
                del open_[i:]
                return
            if open_[i][0] in stop:
                return

    for found in MARKUP.finditer(page):
        if found.start() > at:
            yield words(page[at : found.start()])
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["end"] or found["end2"]:
            aside, article = state()
            if any(name == other for other, _, _ in open_):
                close(frozenset({name}), frozenset())
            article = article and state()[1]
            yield ("tag", f"</{name}", "", aside, article and not aside)
            continue
        rest = found["rest"] or found["rest2"] or ""
        if name in SIBLINGS:
            close(SIBLINGS[name], frozenset("table ul ol dl div section article main body".split()))
        elif name in ENDS_PARAGRAPH:
            close(frozenset({"p"}), ENDS_PARAGRAPH - {"p"})
        aside, article = state()
        aside = aside or _is_aside(name, rest, article)
        yield ("tag", f"<{name}", "", aside, article and not aside)
        if name not in VOID and not rest.endswith("/"):
            open_.append((name, aside, article or name in ARTICLE))
    if at < len(page):
        yield words(page[at:])


def region(parts: list[tuple], weights: dict[str, float]) -> tuple[int, int]:
    """First and last part (exclusive) of the maximum-scoring subsequence; of equal sums the first, empty if none is over 0."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, (kind, name, text, aside, _) in enumerate(parts):
        if kind == "tag":
            weight = weights.get(name, OTHER_TAG)
            total += max(weight, ASIDE_TAG) if aside else weight
        else:
            total += len(text.split()) * (0.0 if aside else weights.get(name, OTHER_WORD))
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def text_of(parts: list[tuple]) -> str:
    """Blocks of the parts that are running text, one per line."""
    blocks, run = [], []
    for kind, name, text, aside, _ in parts:
        if kind == "words" and not aside:
            run.append(text)
        elif kind == "tag" and name in ("<br", "</br"):
            run.append(" ")
        elif kind == "tag" and name.lstrip("</") not in INLINE:
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    spaced = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in spaced if b)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    parts = list(parse(page or ""))
    begin, end = region(parts, weights)
    return text_of(parts[begin:end])


def learn(pages: DataFrame, max_pages: int = 2_000) -> dict[str, float]:
    """Weights from at most ``max_pages`` pages that mark an article, those of the smallest hash of their id.

    Without any such page the weights are ``DEFAULT``. The bound is a parameter and does not depend on the table.
    """
    labelled = pages.where(F.lower("html").rlike("<(article|main)[\\s>]"))
    chosen = smallest(labelled.select("page_id", F.xxhash64("page_id").alias("order")), "order", max_pages)
    sample = pages.join(F.broadcast(chosen.select("page_id").distinct()), "page_id").select("html")

    def count(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for kind, name, text, aside, article in parse(page or ""):
                    if not aside:
                        (inside if article else outside)[name] += 1 if kind == "tag" else len(text.split())
        names = sorted({*inside, *outside})
        yield pa.record_batch(
            {
                "name": pa.array(names, pa.string()),
                "inside": pa.array([inside[n] for n in names], pa.int64()),
                "outside": pa.array([outside[n] for n in names], pa.int64()),
            }
        )

    sums = (
        sample.mapInArrow(count, "name string, inside long, outside long")
        .groupBy("name")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .collect()  # names of tags on max_pages pages
    )
    weights = {}
    for name, inside, outside in sums:
        if name.startswith("<"):
            weights[name] = max(LEAST_TAG, -math.log((inside + outside + 1) / (inside + 0.5)))
        else:
            weights[name] = min(MOST_WORD, math.log((inside + outside + 1) / (outside + 1)))
    return weights or DEFAULT


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by a line
    feed, empty blocks vanish. A null or empty page, or one whose words nowhere outweigh its tags, has an empty
    text. Null ids and urls stay null, repeated rows are extracted each, other columns are dropped.
    """
    weights = learn(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [main_text(page, weights) for page in part.column("html").to_pylist()]
                yield pa.record_batch(
                    {
                        "page_id": part.column("page_id"),
                        "url": part.column("url"),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    }
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
