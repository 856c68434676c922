"""Main text of web pages by minimum-cut labelling.

A page is read once into text blocks (what stands between block-level tags) with
the chain of elements around each.  A logistic scorer with fixed weights turns a
block's surroundings and text into log-odds of being content; these are the
capacities to the two terminals.  Smoothness edges join neighbouring blocks and
the next block of the same container, stronger the closer their elements are in
the DOM.  A maximum flow parts content from boilerplate.  Scopes nest, so blocks
and edges form a graph that always has a block with two neighbours at most; what
can flow through such a block has a closed form, by which it is replaced with
one edge between its neighbours.  Pages thus cost time in proportion to their
blocks; augmenting paths run on what can't be reduced, if anything.

Names of elements (class, id, role) are evidence, not a veto: an article inside
boilerplate is disputed, which its own text and its neighbours can outweigh, and
is the page's article if it outweighs all text outside boilerplate.  Names of
<html> and <body> and what a layout has or lacks (``has-sidebar``) count for
nothing; a form around plain blocks counts a little.

Headings, list items and table cells outside boilerplate speak neither for nor
against, whatever their length: they go with what they stand beside, which the
cut settles.  Words are counted by spaces, and by two characters in scripts that are
written without them.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by two line feeds in page order.

Defined results: null or empty html, and pages without content blocks, give an
empty text; broken nesting closes what it can; unclosed scripts and comments run
to the page's end; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|textarea|select|svg|iframe|object)\b(?:[^'\">]++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags that stand inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that closes an open element of the same group.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SCOPE = frozenset("div section article aside nav header footer main body ul ol table form dl".split())
AWAY_TAGS = frozenset("nav footer aside form button menu dialog input".split())
AWAY_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|alert\w*|dialog|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|foot\w*|header|masthead|topbar|side-?bar|aside|cookies?|consent|notice\w*|gdpr|popup|modal|overlay|comments?|comment-?list|replies|respond|reactions|disqus|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|search\w*|widget\w*|pagination|pager|toolbar|legal|copyright|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
HOME_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post|post-?(?:body|content|text)|entry\w*|story\w*|main\w*|content\w*|body-?text|text-?body)(?:$|[\s_-])", re.I)
#: Names that only the main text has; with <article> and <main> they hold against boilerplate around them.
STRONG_NAMES = re.compile(r"(?:^|\s)(?:main|main-?content|article|(?:article|post|entry|story)[_-]?(?:body|content|text)|body-?text)(?:$|\s)", re.I)
#: What readers say below an article; inside one it may be a section of it.
OUTSIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:discussions?|responses|talkback|feedback)(?:$|[\s_-])", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Parts of a name that say what a layout has or lacks, not what the element is.
_LAYOUT = re.compile(r"(?:(?<=[\s_-])|^)(?:has|no|with|without)[_-]\S+", re.I)
_NOTICE = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|cookie|privacy policy|terms of (?:use|service)|sign (?:in|up)|log ?in|subscribe", re.I)

#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_STOP = re.compile("[.!?] |[\u3002\uff01\uff1f\u0964\u06d4\u061f]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose blocks go with their neighbours.
FOLLOWS = HEADINGS | frozenset("li dt dd td th caption figcaption".split())

# Fixed weights of the block scorer, in thousandths of log-odds.
BIAS, AWAY, HOME, HEADING, PARAGRAPH, LINKED, NOTICE, PER_LOG2_WORDS, STOPS, LIST = -1500, -4500, 4500, 600, 700, -4000, -1500, 450, 500, -500
# Weaker evidence, within the range of a block's edges: an article inside boilerplate, and a form around a page.
DISPUTED, FORM = -2500, -2000
# Capacities of the smoothness edges.
ADJACENT, SAME_PARENT, SAME_SCOPE, NESTED = 250, 450, 350, 200


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    parent: int
    scope: int
    mark: int  # 1 inside an article or the like, -1 inside boilerplate, 2 in an article inside boilerplate, -2 in a form, 0 none of these
    around: int = 0  # the scope around the block's scope


def mark_of(tag: str, names: str, mark: int) -> int:
    """The mark of an element with these names inside one with ``mark``."""
    away = False
    if names and tag not in ("html", "body") and AWAY_NAMES.search(names):
        away = bool(AWAY_NAMES.search(_LAYOUT.sub(" ", names)))
    if not away and names and mark != 1 and tag not in ("html", "body") and OUTSIDE_NAMES.search(names):
        away = True
    strong = tag in ("article", "main") or bool(names and STRONG_NAMES.search(names))
    if strong and tag not in AWAY_TAGS:
        if mark in (0, -2, -1):
            against = away + (mark < 0)
            return 1 if against == 0 else 2 if against == 1 or tag == "main" else -1
        return -1 if away and tag != "main" else mark
    if away:
        # a name of its own for the main text, next to one of boilerplate: class="post tag-social"
        own = mark == 0 and any(HOME_NAMES.search(n) and not AWAY_NAMES.search(n) for n in names.split())
        return 2 if own and tag not in AWAY_TAGS else -1
    if tag == "form":
        return -2 if mark in (0, -2) else -1
    if tag in AWAY_TAGS or tag == "header" and mark not in (1, 2):
        return -1
    if names and HOME_NAMES.search(names):
        return 1 if mark == 0 else 0 if mark == -2 else mark
    return mark


class _Reader:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        #: open elements: tag, number, scope's number, mark
        self.stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
        #: how many elements of a tag are open, and of those without a scope how many in each open scope
        self.now: Counter[str] = Counter()
        self.within: list[Counter[str]] = [Counter()]
        #: the scope around each scope
        self.around: dict[int, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = False
        self.count = 0

    def say(self, text: str) -> None:
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text)

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            self.parts.clear()
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                tag, number, scope, mark = self.stack[-1]
                self.blocks.append(Block(text, min(self.linked, len(text)), tag, number, scope, mark))
        self.linked = 0

    def open(self, tag: str, attributes: str) -> None:
        stack = self.stack
        for c in CLOSES.get(tag) or (("p",) if tag in _ENDS_P else ()):
            if self.within[-1][c]:
                self.close(c)
        if tag in VOID:
            return
        mark = stack[-1][3]
        names = _HUMP.sub("-", " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))) if attributes else ""
        mark = mark_of(tag, names, mark)
        self.count += 1
        self.now[tag] += 1
        if tag in _SCOPE:
            self.around[self.count] = stack[-1][2]
            self.within.append(Counter())
        else:
            self.within[-1][tag] += 1
        stack.append((tag, self.count, self.count if tag in _SCOPE else stack[-1][2], mark))

    def close(self, tag: str) -> None:
        """Close elements up to the last open ``tag``; each is passed once, an end tag of nothing costs nothing."""
        shut = "" if self.now[tag] else tag
        while shut != tag:
            shut = self.stack.pop()[0]
            self.now[shut] -= 1
            if shut in _SCOPE:
                self.within.pop()
            else:
                self.within[-1][shut] -= 1


def read(page: str) -> list[Block]:
    r = _Reader()
    at = 0
    for m in _TAG.finditer(page):
        a = m.start()
        if a > at:
            r.say(page[at:a])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                r.flush() if m[1].lower() in ("title", "textarea", "select", "iframe", "object") else None
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                r.in_link = not m[2]
            elif tag == "br":
                r.parts.append(" ")
            continue
        r.flush()
        r.in_link = False
        if m[2]:
            r.close(tag)
        else:
            r.open(tag, m[4] or "")
    if at < len(page):
        r.say(page[at:])
    r.flush()
    settle(r.blocks)
    for b in r.blocks:
        b.around = r.around.get(b.scope, 0)
    return r.blocks


def settle(blocks: list[Block]) -> None:
    """Disputed text that outweighs all other text outside boilerplate is the page's article; a form that does is a plain wrapper."""
    sizes = {0: 0, 1: 0, -1: 0, 2: 0, -2: 0}
    for b in blocks:
        sizes[b.mark] += len(b.text) - b.linked
    for mark, instead in ((2, 1), (-2, 0)):
        if 2 * sizes[mark] > sum(sizes.values()) - sizes[-1]:
            for b in blocks:
                b.mark = instead if b.mark == mark else b.mark


_MARKS = {0: 0, 1: HOME, -1: AWAY, 2: DISPUTED, -2: FORM}


def words_of(text: str) -> int:
    n = text.count(" ") + 1
    return n if text.isascii() else n + len(_UNSPACED.findall(text)) // 2


def log_odds(b: Block) -> int:
    """The scorer: positive where the block looks like content."""
    words = words_of(b.text)
    z = BIAS + PER_LOG2_WORDS * min(7, words.bit_length())
    if b.tag in HEADINGS:
        z += HEADING
    elif b.tag in ("p", "blockquote", "pre", "figcaption"):
        z += PARAGRAPH
    elif b.tag == "li":
        z += LIST
    if words >= 8 and _STOP.search(b.text):
        z += STOPS
    if b.mark == 0 and b.tag in FOLLOWS:
        z = max(z, 0)
    z += _MARKS[b.mark] + LINKED * b.linked // max(1, len(b.text))
    if words < 30 and _NOTICE.search(b.text):
        z += NOTICE
    return z


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            nested = before.scope == b.around or before.around == b.scope
            out[i - 1, i] = ADJACENT + (SAME_PARENT if before.parent == b.parent else NESTED if nested and before.scope != b.scope else 0)
        j = last.get(b.scope)
        if j is not None:
            out[j, i] = out.get((j, i), 0) + SAME_SCOPE
        last[b.scope] = i
    return [(i, j, w) for (i, j), w in out.items()]


def minimum_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of a minimum cut: ``terminal[i]`` > 0 pulls to True, < 0 to False; ties go to False."""
    n = len(terminal)
    pull = list(terminal)
    #: what it costs that i is True and j False
    cap: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        cap[i][j] = cap[i].get(j, 0) + w
        cap[j][i] = cap[j].get(i, 0) + w
    gone: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    out = [False] * n
    todo = deque(i for i in range(n) if len(cap[i]) < 3)
    while todo:
        v = todo.popleft()
        if out[v] or len(cap[v]) > 2:
            continue
        out[v] = True
        around = [(u, cap[v][u], cap[u].pop(v)) for u in cap[v]]
        gone.append((v, pull[v], around))
        no, yes = max(pull[v], 0), max(-pull[v], 0)
        if len(around) == 1:
            ((u, v_u, u_v),) = around
            pull[u] -= min(no + u_v, yes) - min(no, yes + v_u)
        elif around:
            (u, v_u, u_v), (w, v_w, w_v) = around
            neither, only_w, only_u, both = min(no, yes + v_u + v_w), min(no + w_v, yes + v_u), min(no + u_v, yes + v_w), min(no + u_v + w_v, yes)
            pull[w] -= only_w - neither
            pull[u] -= both - only_w
            cap[u][w] = cap[u].get(w, 0) + only_u + only_w - neither - both
            cap[w].setdefault(u, 0)
        todo.extend(u for u, _, _ in around if len(cap[u]) < 3)
    rest = [i for i in range(n) if not out[i]]
    label = [False] * n
    if rest:
        for i in _flow({i: pull[i] for i in rest}, {i: cap[i] for i in rest}):
            label[i] = True
    for v, p, around in reversed(gone):
        no = max(p, 0) + sum(u_v for u, _, u_v in around if label[u])
        yes = max(-p, 0) + sum(v_u for u, v_u, _ in around if not label[u])
        label[v] = yes < no
    return label


def _flow(pull: dict[int, int], near: dict[int, dict[int, int]]) -> set[int]:
    """The nodes on the source's side after a maximum flow (shortest augmenting paths)."""
    source, sink = -1, -2
    cap: dict[int, dict[int, int]] = {i: dict(x) for i, x in near.items()}
    cap[source] = {i: p for i, p in pull.items() if p > 0}
    cap[sink] = {}
    for i, p in pull.items():
        if p < 0:
            cap[i][sink] = -p
        if p > 0:
            cap[i].setdefault(source, 0)
    while True:
        come = {source: source}
        line = deque([source])
        while line and sink not in come:
            u = line.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in come:
                    come[v] = u
                    line.append(v)
        if sink not in come:
            return set(come) - {source}
        path, v = [], sink
        while v != source:
            path.append((come[v], v))
            v = come[v]
        most = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= most
            cap[v][u] = cap[v].get(u, 0) + most


def extract(page: str) -> str:
    blocks = read(page)
    if not blocks:
        return ""
    keep = minimum_cut([log_odds(b) for b in blocks], edges_of(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    def make():
        def run(values):
            got = [extract(v) for v in values]
            return {"text": got, "n_chars": [len(t) for t in got]}

        return run

    return map_texts(pages, id_col, html_col, make, "text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: its id, url, main text and the text's length.  The url travels with the id, so no join is needed."""
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    return main_text(pages, "page", "html").select("page.page_id", "page.url", "text", "n_chars")
