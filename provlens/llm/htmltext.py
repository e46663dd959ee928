"""Main text of HTML pages: flat text blocks and a decision tree.

A page is cut into flat blocks: runs of text between block-level tags, with
white space (line breaks included) reduced to single blanks. Each block gets
the features of ``FEATURES``: words and link density (share of words inside
links) of the block and of the blocks before and after it, whether an enclosing
element says that it is main content or surroundings (by tag, ARIA role, or a
word of its class or id; inside main content some of these words do not count),
whether it is a heading, and how much text stands beside it in its container. What an element around
the whole page or around its main element says of surroundings is not taken
(``page_wide``), and an article or main element starts afresh inside a side
element that is only one by a hint. A decision tree decides
which blocks are main text; they are joined by line breaks in page order.

The tree is a Spark ML ``DecisionTreeClassifier`` trained on a small labelled
table: ``labelled_blocks()`` lays out a few page shapes by rule (semantic tags,
only class names, no hints at all) and labels their blocks. Another table with
the same columns can be passed in. Training sees only that table, never the
pages to extract from.

Extraction is one pass over the pages without a shuffle; a page is held whole,
its blocks are a list of strings. Tag soup is read leniently: unclosed
paragraphs and inline tags do not matter, a tag cut off at the end of a page is
markup, and scripts, styles, comments and the title are never text. Of the
elements without text (``SKIPPED``) only scripts, styles and text areas run to
the page's end if their end tag is missing; another one without end tag, or a
self-closed ``svg`` or ``math``, is its tag alone.

Defined cases: a null or empty html, or a page without main blocks, gives an
empty text; repeated rows are extracted each.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.llm.common import chunks, filled

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "in_main", "in_side", "heading", "kin")
TREE_DEPTH = 9
KIN_WORDS = 25  # more text beside a block tells no more

# Element names and hints.
RAW = "script|style|textarea"
SKIPPED = "noscript|template|svg|math|iframe|object|select|button|title"
LABELLED = frozenset("select button title".split())  # the text after an unclosed one is its label
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul".split())
CONTAINER = frozenset(
    "article aside body center details dialog div dl fieldset figure footer form header html main menu nav ol section "
    "table ul".split())
MAIN_TAGS = frozenset("article main".split())
SIDE_TAGS = frozenset("nav footer aside form dialog menu".split())
FIRM_TAGS = frozenset("nav footer aside dialog menu".split())  # never around the main element
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_HINTS = frozenset("article articlebody content entry main post story".split())
SIDE_HINTS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo "
    "consent cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter "
    "notice notification pager pagination popup promo promotion related reply replies search share sharing sidebar "
    "signup social sponsor sponsored subscribe toc toolbar widget".split())
# hints that inside main content count only if most words are linked: a section may be about related work
WEAK_HINTS = frozenset("complementary form related search".split())
# hints that count outside of main content only
TOP_HINTS = frozenset(["header"])
OUTSIDE_HINTS = frozenset("discussion feedback respond response responses reviews talkback thread".split())
# hints that an article inside is not the page's own
OTHERS_HINTS = frozenset(
    "ad ads advert advertisement advertising comment comments disqus promo promotion related reply replies sponsor "
    "sponsored".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)|<(?P<skip>{SKIPPED})(?![\w:-])[^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^'\">]+|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z!?][^>]*(?:>|\Z)", re.S | re.I)
PAIRED = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
                    rf"|<(?P<close>/?)(?P<skip>{SKIPPED})(?![\w:-])[^>]*>", re.S | re.I)
LABEL = re.compile(r"(?:[^<]+|</?(?:option|optgroup)\b[^>]*>)*", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Za-z]+")


class Element:
    """A container. ``main`` and ``side`` are what it says itself; ``resolve``
    adds what the containers around it say."""
    __slots__ = ("tag", "parent", "main", "side", "firm", "weak", "outside", "others", "words", "linked", "kin", "in_firm", "in_others")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        names = {n.lower() for m in ATTRIBUTE.finditer(attrs) for n in NAME.findall(m[2] or m[3] or m[4] or "")}
        self.tag, self.parent, self.words, self.linked, self.kin = tag, parent, 0, 0, 0
        self.side = tag in SIDE_TAGS or (tag != "main" and not names.isdisjoint(SIDE_HINTS))
        self.firm = tag in SIDE_TAGS or (tag != "main" and not names.isdisjoint(SIDE_HINTS - WEAK_HINTS - TOP_HINTS))
        self.weak = tag != "main" and not names.isdisjoint(WEAK_HINTS)
        self.outside = tag == "header" or (tag not in MAIN_TAGS and not names.isdisjoint(TOP_HINTS | OUTSIDE_HINTS))
        self.main = tag in MAIN_TAGS or not names.isdisjoint(MAIN_HINTS)
        self.others = tag in FIRM_TAGS or not names.isdisjoint(OTHERS_HINTS)
        self.in_firm = parent is not None and (parent.in_firm or parent.tag in FIRM_TAGS)
        self.in_others = parent is not None and (
            parent.in_others or (parent.others and parent.tag not in ("html", "body")))


def page_wide(elements: Sequence[Element], total: int) -> set[int]:
    """Identities of the elements whose side hints are not taken: html and
    body, those around the page's main element (its ``main``, else its first
    article outside of comments and the like, else the wordiest article or
    element with a main hint), and on a page without any such element those
    that hold over four fifths of its words."""
    wide = {id(e) for e in elements if e.tag in ("html", "body")}
    own = [e for e in elements if e.main and not e.side and not e.in_firm]
    chosen = (next((e for e in own if e.tag == "main"), None)
              or next((e for e in own if e.tag == "article" and not e.in_others), None)
              or max((e for e in own if id(e) not in wide), key=lambda e: e.words, default=None))
    if chosen:
        while chosen := chosen.parent:
            wide.add(id(chosen))
        return wide
    return wide | {id(e) for e in elements if e.tag not in FIRM_TAGS and 5 * e.words > 4 * total}


def resolved(elements: Sequence[Element], total: int) -> dict[int, tuple[bool, bool, bool]]:
    """(main, side, others) of every element of a page of ``total`` words, by
    identity."""
    wide = page_wide(elements, total)
    state = {id(None): (False, False, False)}
    for e in elements:  # parents come first
        main, side, others = state[id(e.parent)]
        taken = id(e) not in wide
        own_side = taken and (e.firm or (e.outside and not main) or (e.weak and (not main or 2 * e.linked > e.words)))
        if e.tag in MAIN_TAGS and not own_side:
            state[id(e)] = (True, others, others)
        else:
            state[id(e)] = (main or (e.main and not own_side), side or own_side, others or (taken and e.others))
    return state


def skips(page: str) -> dict[int, int]:
    """Start and end of the skipped elements that have an end tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in PAIRED.finditer(page):
        if m["skip"]:
            starts = opened.setdefault(m["skip"].lower(), [])
            if not m["close"]:
                if not self_closed(m):
                    starts.append(m.start())
            elif starts:
                ends[starts.pop()] = m.end()
    return ends


def self_closed(m: re.Match) -> bool:
    return m["skip"].lower() in ("svg", "math") and m[0].endswith("/>")


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, int]]:
    """(text, words, linked words, in_main, in_side, heading, kin) of every
    block; kin: the words without links that its container holds directly, less
    its own, KIN_WORDS at most."""
    out: list[tuple[str, int, int, Element | None, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[Element] = []
    elements: list[Element] = []
    link = heading = False

    def flush() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                out.append((" ".join(words), len(words), len("".join(linked).split()), stack[-1] if stack else None,
                            heading))
                if stack:
                    stack[-1].words += len(words)
                    stack[-1].linked += out[-1][2]
                    stack[-1].kin += len(words) - out[-1][2]
            parts.clear()
            linked.clear()

    def text(piece: str) -> None:
        if piece:
            if "&" in piece:
                piece = entities.unescape(piece)
            parts.append(piece)
            if link:
                linked.append(piece)

    at, ends = 0, skips(page)
    while m := TOKEN.search(page, at):
        text(page[at:m.start()])
        at = m.end()
        if m["raw"]:
            continue
        if m["skip"]:
            if m.start() in ends:
                at = ends[m.start()]
            elif m["skip"].lower() in LABELLED:
                at = LABEL.match(page, at).end()
            continue
        tag = (m["tag"] or "").lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = not m["close"]
            linked.append(" ")
        elif tag in BLOCK:
            flush()
            heading = tag in HEADINGS and not m["close"]
            link = link and tag not in CONTAINER  # an unclosed link ends with its surroundings
            if tag in CONTAINER:
                if m["close"]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i].tag == tag:
                            del stack[i:]
                            break
                elif not m["attrs"].endswith("/"):
                    stack.append(Element(tag, m["attrs"], stack[-1] if stack else None))
                    elements.append(stack[-1])
    text(page[at:])
    flush()
    for e in reversed(elements):
        if e.parent:
            e.parent.words += e.words
            e.parent.linked += e.linked
    state = resolved(elements, sum(b[1] for b in out))
    return [(*b[:3], *state[id(b[3])][:2], b[4], min(b[3].kin - b[1] + b[2], KIN_WORDS) if b[3] else 0) for b in out]


def features(found: Sequence[tuple]) -> list[tuple[float, ...]]:
    """The feature row of every block of a page."""
    base = [(float(w), n / w) for _, w, n, *_ in found]
    edge = (0.0, 0.0)
    return [(*base[i], *(base[i - 1] if i else edge), *(base[i + 1] if i + 1 < len(base) else edge),
             *map(float, b[3:])) for i, b in enumerate(found)]


def labelled_blocks() -> list[tuple[float, ...]]:
    """The default labelled table: FEATURES and the label (1: main text).

    Pages are laid out by rule; a block of main text starts with the word
    ``MAIN``. Sizes are counted up, so short and long blocks of both kinds
    occur.
    """
    def words(n: int, main: bool = False) -> str:
        return " ".join(["MAIN"] * main + ["word"] * (n - main))

    def links(n: int, size: int) -> str:
        return "".join(f'<li><a href="#">{words(size)}</a></li>' for _ in range(n))

    def paragraphs(sizes: Sequence[int]) -> str:
        return "".join(f"<p>{words(n, True)}</p>" for n in sizes)

    side = [lambda n: f"<nav><ul>{links(n % 6 + 2, n % 3 + 1)}</ul></nav>",
            lambda n: f'<div class="ad">{words(n)}</div>',
            lambda n: f"<header><p>{words(n)}</p></header>",
            lambda n: f'<div class="cookie-notice"><p>{words(n)}</p></div>',
            lambda n: f"<aside><h3>{words(n % 4 + 1)}</h3><p>{words(n)}</p></aside>",
            lambda n: f"<form><p>{words(n)}</p></form>",
            lambda n: f'<div id="comments"><p>{words(n)}</p><p>{words(n // 2 + 1)}</p></div>',
            lambda n: f"<footer><p>{words(n)}</p></footer>"]
    sizes = (1, 2, 4, 8, 15, 30, 60, 120, 250)
    pages = []
    for i, n in enumerate(sizes):
        body = f"<h1>{words(i + 1, True)}</h1>" + paragraphs([sizes[(i + k) % 9] for k in range(4)])
        around = [f(sizes[(i + k) % 9]) for k, f in enumerate(side)]
        before, after = "".join(around[:4]), "".join(around[4:])
        inner = f'<div class="share">{words(i % 3 + 1)}</div>'
        pages += [f"{before}<article>{body}{inner}</article>{after}",
                  f'{before}<div class="post-content">{body}</div>{after}',
                  f'{before}<main>{body}<ul>{"".join(f"<li>{words(n, True)}</li>" for _ in range(3))}</main>{after}']
        # no hints: long blocks among long ones are text, short ones and links are not
        pages.append(f"<div>{links(5, i % 3 + 1)}</div><div>{paragraphs([40 + n, 25 + i, 60 + n])}</div>"
                     f"<div>{words(i + 2)}</div><div>{links(4, 2)}</div>")
        # ... but a short one among long ones in one container is
        for count in (1, 2, 3, 5):
            long = [25 + (13 * i + 17 * k) % 70 for k in range(count)]
            mixed = [x for k, m in enumerate(long) for x in ([m, 1 + (i + k) % 6, 2] if k + 1 < count else [m])]
            for text in (long, mixed):
                for first in (links(4, i % 3 + 1), words(i % 6 + 1), ""):
                    pages.append(f"<div>{first}</div><div>{paragraphs(text)}</div><div>{words(i % 7 + 1)}</div>"
                                 f"<div>{links(5, 1)}</div><p>{words(i % 4 + 1)}</p>")
        # parts of an article named like surroundings, and comments after it
        pages.append(f'{before}<article><header class="entry-header"><h1>{words(i + 1, True)}</h1></header>'
                     f'{paragraphs([n, 3, 30 + i])}<section id="related-work"><h2>{words(2, True)}</h2>'
                     f'{paragraphs([20 + n, 2])}</section><div class="related-posts"><ul>{links(4, 3)}</ul></div></article>'
                     f'<section class="responses"><p>{words(n)}</p><p>{words(20 + i)}</p></section>{after}')
        # wrappers named after what else they hold
        for wrap in ('<body class="has-sidebar">', '<div id="page" class="with-sidebar">', '<form id="aspnetForm">'):
            pages += [f"{wrap}{before}<article>{body}{inner}</article>{after}",
                      f'{wrap}{before}<div class="post-content">{body}</div>{after}']
    rows = []
    for page in pages:
        found = blocks(page)
        rows += [(*f, float(b[0].startswith("MAIN"))) for f, b in zip(features(found), found)]
    return rows


def train(spark: SparkSession, labelled: DataFrame | None = None, depth: int = TREE_DEPTH):
    """The tree as nested (feature, threshold, low, high) with labels as leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    if labelled is None:
        columns = ", ".join(f"{c} double" for c in (*FEATURES, "label"))
        labelled = spark.createDataFrame(labelled_blocks(), columns)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=1, seed=1).fit(table)
    lines = iter([x.strip() for x in model.toDebugString.splitlines()[1:]])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        low = node()
        next(lines)  # Else
        return int(m[1]), float(m[2]), low, node()

    return node()


def classify(tree, row: Sequence[float]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree > 0.5


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, f in zip(found, features(found)) if classify(tree, f))


def extracted(pages: DataFrame, keys: Sequence[str] = ("page_id", "url"), html: str = "html",
              labelled: DataFrame | None = None) -> DataFrame:
    """Keys, ``text`` and ``n_chars``."""
    tree = train(pages.sparkSession, labelled)
    src = pages.select(*[F.col(f"`{k}`") for k in keys], filled(html).alias("__h"))
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "__h"):
            out = pdf.drop(columns="__h")
            out["text"] = [main_text(h, tree) for h in pdf["__h"]]
            yield out

    done = src.mapInPandas(each, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["text string"]))
    return done.withColumn("n_chars", F.length("text").cast("long"))
