"""Main text of web pages: the best contiguous run of words, scored against tags.

A page is read once into blocks. Every word scores its trust, the probability that words in its
place are content; every tag between blocks costs by the same measure. The run of blocks with the
largest sum, found by one linear scan, is the content region. An article that it begins or ends
in is taken up to its own first or last block. Inside the region, pieces in places that are
never content (menus, adverts, forms, comments and so on) are left out.

Trust is learned: pages that mark their article (``<article>`` or ``<main>``) are the labelled
pages, and words inside and outside it are counted per place. Fixed prior counts stand in for
places that the labelled pages do not show: elements such as nav and aside are always left out,
class, id and role tokens made of words such as sidebar or advert only as long as the labelled
pages do not show content there; an id inside an article (often that of a heading) says nothing
unless it is learned. An article or main element
below such a token is read afresh.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled pages to learn from, taken by a digest of their keys; places kept and least words to believe a place.
SAMPLE_PAGES, MOST_PLACES, LEAST_WORDS = 2000, 5000, 50
TAG_COST = 3.0
#: Trust below which a token of OUT_WORDS is never content.
LEAST_TRUST = 0.2

# fixed: HTML elements by role, and words in class, id and role attributes
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
             "h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACES = {"br", "td", "th", "img", "wbr"}
TRACKED = {"article", "main", "nav", "aside", "footer", "header", "form", "head", "title", "menu", "dialog", "button", "select", "div", "section", "ul", "ol", "table", "span", "p"}
NEVER = {"nav", "aside", "footer", "form", "head", "title", "menu", "dialog", "button", "select"}
SEMANTIC = {"article", "main", *NEVER, "header"}
OUT_WORDS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus "
                "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
                "recommended related replies reply respond search share sharing sidebar sidenav signup social sponsor sponsored subscribe toolbar topbar "
                "widget widgets alert login form skip".split())
IN_WORDS = set("article body content entry main post story text".split())
TAG_TRUST = {"p": 0.9, "h1": 0.8, "h2": 0.8, "h3": 0.8, "blockquote": 0.8, "pre": 0.8, "figcaption": 0.6, "li": 0.3, "a": 0.2, "td": 0.4}

_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"<]*"|'[^'<]*'|"[^">]*"|'[^'>]*')*+>|[^<>]*+>)|<[!?][^>]*+>""")
_COMMENT_END = re.compile("--!?>")
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _places(name: str, attributes: str) -> tuple[list[str], set[str]]:
    """What tells the role of an element: its name, where that means something, and whole tokens of its attributes; also those that are ids only."""
    out, ids, others = [f"<{name}>"] if name in SEMANTIC else [], set(), set()
    if attributes and "=" in attributes:
        for m in _NAMES.finditer(attributes):
            tokens = [w.lower() for w in _CAMEL.sub("-", m[2] or m[3] or m[4] or "").split() if _WORD.search(w)]
            (ids if m[1].lower() == "id" else others).update(tokens)
            out += tokens
    return out, ids - others


def outside(place: str) -> bool:
    """Whether a token is made of nothing but words for what is not content."""
    words = _WORD.findall(place)
    return bool(words) and place[0] != "<" and all(w in OUT_WORDS and w not in IN_WORDS for w in words)


@lru_cache(65536)
def prior(place: str) -> tuple[float, float]:
    """Counts of words inside and outside content to start with."""
    words = _WORD.findall(place) if place[0] != "<" else []
    if place in ("<article>", "<main>") or any(w in IN_WORDS for w in words) and not any(w in OUT_WORDS for w in words):
        return 20.0, 1.0
    if place.strip("<>") in NEVER or outside(place):
        return 0.5, 20.0
    return 2.0, 2.0


class Block:
    __slots__ = ("pieces", "score", "words", "cost", "article")

    def __init__(self):
        self.pieces, self.score, self.words, self.cost, self.article = [], 0.0, 0, 0.0, 0


def read(html: str, trust: dict[str, float], counts: dict[str, list[float]] | None = None) -> list[Block]:
    """Blocks of a page in order. With ``counts``, words per place are added to it, [inside, outside] an article."""
    blocks, block, cost = [], Block(), 0.0
    stack: list[tuple[str, float | None, str, int, tuple[str, ...]]] = []  # name, trust (None: unknown), vetoed by ("", "word", "element"), article, places
    at, size, articles = 0, len(html), 0
    opened: Counter[str] = Counter()  # open elements by name, so that an end without a start needs no search
    unended: set[str] = set()  # raw elements that have no further end
    seen: list[tuple[tuple[str, ...], bool, int]] = []

    def text(raw: str) -> None:
        if not raw:
            return
        value = unescape(raw) if "&" in raw else raw
        own, vetoed, article = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (None, "", 0)
        words = len(value.split())
        if counts is not None and words:
            seen.append((tuple(p for s in stack for p in s[4]), article > 0 and vetoed != "element", words))
        if not vetoed:
            block.pieces.append(value)
            block.words += words
            block.score += words * (own if own is not None else TAG_TRUST.get(tag, 0.5))
            block.article = article

    def cut(depth: int) -> None:
        opened.subtract(s[0] for s in stack[depth:])
        del stack[depth:]

    def flush() -> None:
        nonlocal block, cost
        if block.words:
            block.cost, cost = cost, 0.0
            blocks.append(block)
        else:
            cost += block.cost
        block = Block()

    tag = ""
    while at < size:
        m = _TAG.search(html, at)
        text(html[at:m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            end = _COMMENT_END.search(html, at)
            at = end.end() if end else size
            continue
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            if not m[3].endswith("/>"):
                end = None if name in unended else re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                if end is None:
                    unended.add(name)
                at = end.end() if end else (size if name in ("script", "style") else at)
            continue
        if name in BLOCKS:
            flush()
        elif name in SPACES and not (closing and name in ("br", "wbr", "img")) and block.pieces and name != "wbr":
            block.pieces.append(" ")
        own = stack[-1][1] if stack else None
        if name in TRACKED:
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if opened[name] else None
                if depth is not None and not (name == "p" and any(s[0] != "span" for s in stack[depth + 1:])):
                    cut(depth)
            else:
                if name in BLOCKS and name not in ("span",):
                    while stack and stack[-1][0] == "p":  # a block ends a paragraph
                        cut(len(stack) - 1)
                if name == "body":
                    cut(0)
                parent = stack[-1] if stack else ("", None, "", 0, ())
                places, ids = _places(name, m[3])
                if name == "header" and parent[3]:
                    places = [p for p in places if p not in ("<header>", "header")]  # an article's own heading
                elif name == "header":
                    places.append("header")
                known = {p: trust[p] if p in trust else (lambda a, b: a / (a + b))(*prior(p)) for p in places
                         if p in trust or prior(p) != (2.0, 2.0) and not (parent[3] and p in ids)}
                afresh = name in ("article", "main") and not parent[3]
                vetoed = "" if afresh and parent[2] == "word" else parent[2]
                if name in NEVER:
                    vetoed = "element"
                elif not vetoed and name != "main" and not (name == "article" and parent[3]) and any(
                        outside(p) and known.get(p, 1.0) < LEAST_TRUST for p in places):
                    vetoed = "word"
                above = [] if parent[1] is None or afresh and parent[2] != "element" else [parent[1]]
                lowest = min([*known.values(), *above], default=None)
                article = parent[3]
                if name in ("article", "main") and not vetoed and (not article or name == "article" and stack and not opened["article"]):
                    articles += 1
                    article = articles
                stack.append((name, lowest, vetoed, article, tuple(places)))
                opened[name] += 1
        elif name == "body" and not closing:
            cut(0)
        here = stack[-1][1] if stack else None
        worth = min(x for x in (own, here, 1.0) if x is not None) if own is not None or here is not None else TAG_TRUST.get(name, 0.5)
        cost += TAG_COST * (1.0 - worth)
        tag = "" if closing else name
    flush()
    if counts is not None and any(inside for _, inside, _ in seen):
        for places, inside, words in seen:
            for place in set(places):
                counts[place][0 if inside else 1] += words
    return blocks


def region(blocks: list[Block]) -> tuple[int, int]:
    """First and last + 1 of the run of blocks with the largest sum; of equal sums the first and longest."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, b in enumerate(blocks):
        if total - b.cost <= 0:
            total, start = 0.0, i
        else:
            total -= b.cost
        total += b.score
        if total > best + 1e-12:
            best, where = total, (start, i + 1)
    return where


def whole_articles(blocks: list[Block], first: int, last: int) -> tuple[int, int]:
    """The run, extended at both ends to the outermost trusted block of the article that it begins or ends in."""
    if first == last:
        return first, last
    for i in range(first - 1, -1, -1):
        if not blocks[i].article or blocks[i].article != blocks[i + 1].article:
            break
        if 2 * blocks[i].score >= blocks[i].words:
            first = i
    for i in range(last, len(blocks)):
        if not blocks[i].article or blocks[i].article != blocks[i - 1].article:
            break
        if 2 * blocks[i].score >= blocks[i].words:
            last = i + 1
    return first, last


def extract(html: str | None, trust: dict[str, float]) -> str:
    if not html:
        return ""
    blocks = read(html, trust)
    first, last = region(blocks)
    chosen = blocks[slice(*whole_articles(blocks, first, last))]
    return "\n\n".join(t for t in (" ".join("".join(b.pieces).split()) for b in chosen) if t)


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Trust per place from a bounded sample of pages that mark their article."""
    digest = F.xxhash64(*[F.col(c) for c in pages.columns if c != html_col])
    keyed = pages.select(digest.alias("h"), html_col)
    limit = keyed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if limit is None:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for batch in batches:
            for html in batch.column(0).to_pylist():
                if html:
                    read(html, {}, found)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([v[i] for v in found.values()], pa.float64()) for i in (0, 1)]], ["place", "n_in", "n_out"])

    rows = keyed.where(F.col("h") <= limit).select(html_col).mapInArrow(count, "place string, n_in double, n_out double").groupBy("place").agg(
        F.sum("n_in").alias("a"), F.sum("n_out").alias("b")).where(F.col("a") + F.col("b") >= LEAST_WORDS).orderBy(
        F.desc(F.col("a") + F.col("b")), "place").limit(MOST_PLACES).collect()
    return {r.place: (r.a + prior(r.place)[0]) / (r.a + r.b + sum(prior(r.place))) for r in rows}


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars, one row per row of ``pages``.

    Blocks are joined by an empty line, white space inside a block is one space, character
    references are decoded. NULL, empty and wordless pages have the text ''. Rows are read one by
    one: repeated rows and NULL ids need no care, an empty table gives no rows, other columns
    are ignored; of equally good regions the first is taken.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    trust = learn(rows, "html", sample)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, trust) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
