"""Main text of web pages by a tree-structured graphical model.

Each element of a page is a variable, content or not. Its evidence is naive
Bayes over the words of its class, id and role, whether most of a block is
links and, for an element that holds blocks of text, how many sentences these
have together and how many of its blocks are mostly links; a potential that
depends on its name joins it to its parent. (A single block's length is no
evidence: many short paragraphs would outvote the element that holds them.)
Sum-product messages, upward from the leaves and downward from the root, give
the exact marginal of every element; text of elements whose marginal is one
half or more is kept.

The parameters are counts over labelled pages, taken anew from

* ``TEMPLATES`` below, short pages whose elements with ``data-main`` (and what
  they hold, up to ``data-not``) are labelled content;
* at most about ``MAX_PAGES`` pages of the table that mark their article with
  ``<article>`` or ``<main>`` (of at most ``MAX_PAGE_BYTES``), drawn by a hash of the id; elements inside are
  content unless an element of ``ASIDE`` holds them.

Each page is learned twice, the second time without its names: no class, id or
role, ``<article>`` and ``<main>`` as ``<div>``. So the shape of a page and its
text decide where names say nothing.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one line feed in page order. A ``<br>``
is white space. Unclosed and crossed tags are read as browsers do in the common
cases: a paragraph ends where a block begins, list items and cells end at the
next, an end tag closes what is open inside its element, others are ignored. A
quote that no attribute closes is part of a tag that ends at its first ``>``; a
tag that never ends is no text.

Edge cases: null or empty html has an empty text; a page without tags is one
element; null and repeated ids are pages like others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import copy
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import identified

#: Labelled pages of the table used for training, at most (in expectation).
MAX_PAGES = 400
#: Larger pages are not drawn, so that the sample is bounded in bytes too.
MAX_PAGE_BYTES = 1 << 18
#: Share of all counts that the templates carry.
TEMPLATE_SHARE = 0.5

# Element names by their part in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math select".split())
INLINE = set("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike "
             "strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
               "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"},
         "option": {"select"}}
ASIDE = set("nav aside footer header form head script style noscript button".split())

# A quoted value is closed by a quote before white space, / or >; else the tag ends at the first >.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)"""
    r"""((?:[^>"'=]|=(?!\s*["'])|=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>]))*(?=>)|[^>]*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|data-main|data-not)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019)\]]*(?:\s|$)")
#: Words that count as a sentence where none is marked; numbers of sentences that tell.
SENTENCE_WORDS, TELLING = 25, (1, 3, 8)
#: Elements that hold a block of text; any other one that is not inline holds such blocks.
LEAF = set("p li dt dd td th h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption summary address label legend".split())


class Page:
    """Elements of a page in document order (parents first) and its text runs."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.words, self.marks = ["#page"], [-1], [()], [()]
        #: (element, text, whether a block edge lies before it)
        self.runs: list[tuple[int, str, bool]] = []
        self._open, self._edge = [0], True
        at = 0
        while True:
            found = TOKEN.search(source, at)
            if found is None:
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = found.group(2)
            if name is None:
                continue
            name = name.lower()
            if found.group(1):
                self._end(name)
                continue
            self._start(name, found.group(3))
            if name in RAW and not found.group(3).endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
                self._open.pop()
        if at < len(source):
            self._text(source[at:])

    def _text(self, text: str) -> None:
        if not text.isspace():
            self.runs.append((self._open[-1], text, self._edge))
            self._edge = False
        elif self.runs and not self._edge:
            self.runs.append((self._open[-1], " ", False))

    def _pop_to(self, depth: int) -> None:
        if any(self.tag[i] not in INLINE for i in self._open[depth:]):
            self._edge = True
        del self._open[depth:]

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            for k in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[k]]
                if tag == "p":
                    self._pop_to(k)
                    break
                if tag not in INLINE:
                    break
        if name in SAME:
            for k in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[k]]
                if tag in SAME[name]:
                    self._pop_to(k)
                if tag in SCOPE[name]:
                    break
        if name == "br":
            if self.runs and not self._edge:
                self.runs.append((self._open[-1], " ", False))
            return
        if name not in INLINE:
            self._edge = True
        words, marks = [], []
        if attributes:
            for key, value in ATTRIBUTE.findall(attributes):
                if key.lower().startswith("data-"):
                    marks.append(key.lower())
                else:
                    words += WORD.findall(value.lower())
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.words.append(tuple(words))
        self.marks.append(tuple(marks))
        if name not in VOID and not attributes.endswith("/"):
            self._open.append(len(self.tag) - 1)

    def _end(self, name: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[k]] == name:
                self._pop_to(k)
                return

    def _block_of(self, i: int) -> int:
        """The element whose block the text of element i is part of."""
        while self.tag[i] in INLINE:
            i = self.parent[i]
        return i

    def without_names(self) -> Page:
        """The same page with nothing that names its parts."""
        bare = copy.copy(self)
        bare.words = [()] * len(self.tag)
        bare.tag = ["div" if t in ("article", "main") else t for t in self.tag]
        return bare

    def features(self) -> list[list[tuple[str, object]]]:
        n = len(self.tag)
        length, linked, own, own_linked = [0] * n, [0] * n, [0] * n, [0] * n
        sentences, words = [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for element, text, _ in self.runs:
            length[element] += len(text)
            block = self._block_of(element)
            own[block] += len(text)
            if in_link[element]:
                own_linked[block] += len(text)
            else:
                sentences[block] += len(SENTENCE.findall(text))
                words[block] += text.count(" ") + 1
        for i in range(n):
            if self.tag[i] == "a":
                linked[i] = length[i]
        for i in range(n - 1, 0, -1):
            length[self.parent[i]] += length[i]
            linked[self.parent[i]] += length[i] if self.tag[i] == "a" else linked[i]
        # What the blocks of an element say together.
        said, blocks, link_blocks = [0] * n, [0] * n, [0] * n
        for i in range(n):
            if own[i]:
                holder = i
                while self.tag[holder] in LEAF or self.tag[holder] in INLINE or self.tag[holder] in ("ul", "ol", "dl", "table", "tbody", "tr"):
                    holder = self.parent[holder]
                said[holder] += max(sentences[i], words[i] // SENTENCE_WORDS)
                blocks[holder] += 1
                link_blocks[holder] += 2 * own_linked[i] > own[i]
        out = []
        for i in range(n):
            found: list[tuple[str, object]] = [("word", w) for w in set(self.words[i])]
            if 2 * linked[i] > length[i] and self.tag[i] not in INLINE:
                found.append(("links", 1))
            if blocks[i]:
                found += [("said", k) for k in TELLING if said[i] >= k] or [("said", 0)]
                if 2 * link_blocks[i] > blocks[i]:
                    found.append(("menu", 1))
            out.append(found)
        if not {"html", "body"} & set(self.tag):
            out[0].append(("fragment", 1))
        return out

    def text(self, content: list[bool]) -> str:
        blocks: list[list[str]] = []
        edge = True
        for element, text, before in self.runs:
            edge = edge or before
            if content[element]:
                if edge:
                    blocks.append([])
                blocks[-1].append(html.unescape(text))
                edge = False
            else:
                edge = edge or not text.isspace()
        joined = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(b for b in joined if b)


class TreeModel:
    """Counts of labelled elements, and marginals of unlabelled pages. The
    potential between parent and child is P(child | parent, child's name)."""

    def __init__(self) -> None:
        self.pairs: dict[str, list[list[float]]] = {}
        self.seen = [Counter(), Counter()]
        self.total, self.roots = [0.0, 0.0], [1.0, 1.0]

    def learn(self, page: Page, labels: list[bool], weight: float) -> None:
        for i, features in enumerate(page.features()):
            y = int(labels[i])
            if i:
                for name in ("", page.tag[i]):
                    self.pairs.setdefault(name, [[0.0, 0.0], [0.0, 0.0]])[int(labels[page.parent[i]])][y] += weight
            else:
                self.roots[y] += weight
            self.total[y] += weight
            for f in features:
                self.seen[y][f] += weight

    def finish(self, unit: float) -> TreeModel:
        """Smooth the counts by a share of ``unit``, the weight of one template element."""
        known = set(self.seen[0]) | set(self.seen[1])
        rate = lambda y, f: (self.seen[y][f] + 0.1 * unit) / (self.total[y] + unit)
        self.odds = {f: math.log(rate(1, f) / rate(0, f)) for f in known}
        keep = 0.3 * unit
        share = lambda row, prior: [(row[y] + keep * prior[y]) / (sum(row) + keep * sum(prior)) for y in (0, 1)]
        whole = [share(row, [0.5, 0.5]) for row in self.pairs[""]]
        self.move = {name: [share(row, whole[p]) for p, row in enumerate(rows)] for name, rows in self.pairs.items()}
        return self

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element by one upward and one downward pass."""
        n, get = len(page.tag), self.odds.get
        moves = [self.move.get(t) or self.move[""] for t in page.tag]
        belief0, belief1 = [1.0] * n, [1.0] * n
        for i, features in enumerate(page.features()):
            score = sum([get(f, 0.0) for f in features])
            belief1[i] = math.exp(max(-30.0, min(30.0, score)))
        belief1[0] *= self.roots[1] / self.roots[0]
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            b0, b1 = belief0[i], belief1[i]
            (t00, t01), (t10, t11) = moves[i]
            m0, m1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
            s = m0 + m1
            up0[i], up1[i] = m0, m1 = m0 / s, m1 / s
            p = page.parent[i]
            b0, b1 = belief0[p] * m0, belief1[p] * m1
            s = b0 + b1
            belief0[p], belief1[p] = b0 / s, b1 / s
        out = [belief1[0] / (belief0[0] + belief1[0])] * n
        for i in range(1, n):
            p = out[page.parent[i]]
            (t00, t01), (t10, t11) = moves[i]
            # The parent's belief without this child's own message.
            q0, q1 = (1 - p) / up0[i], p / up1[i]
            b0, b1 = belief0[i] * (q0 * t00 + q1 * t10), belief1[i] * (q0 * t01 + q1 * t11)
            out[i] = b1 / (b0 + b1)
        return out


def template_labels(page: Page) -> list[bool]:
    labels = [page.tag[1:2] != ["html"] and page.tag[1:2] != ["body"] and not any("data-main" in m for m in page.marks)]
    labels += [False] * (len(page.tag) - 1)
    for i in range(1, len(page.tag)):
        labels[i] = ("data-main" in page.marks[i] or labels[page.parent[i]]) and "data-not" not in page.marks[i]
    return labels


def article_labels(page: Page) -> list[bool]:
    labels, aside = [False] * len(page.tag), [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        p = page.parent[i]
        aside[i] = aside[p] or (page.tag[i] in ASIDE)
        labels[i] = not aside[i] and (page.tag[i] in ("article", "main") or labels[p])
    return labels


def train(pages: list[str]) -> TreeModel:
    model = TreeModel()
    marked = [Page(p) for p in pages]
    elements = sum(len(p.tag) for p in marked)
    own = [Page(t) for t in TEMPLATES]
    weight = max(1.0, elements * TEMPLATE_SHARE / (1 - TEMPLATE_SHARE) / sum(len(p.tag) for p in own))
    for page in own:
        labels = template_labels(page)
        model.learn(page, labels, weight)
        model.learn(page.without_names(), labels, weight)
    for page in marked:
        labels = article_labels(page)
        model.learn(page, labels, 1.0)
        model.learn(page.without_names(), labels, 1.0)
    return model.finish(weight)


def main_text(source: str | None, model: TreeModel) -> str:
    page = Page(source or "")
    return page.text([m >= 0.5 for m in model.marginals(page)]) if page.runs else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars``."""
    rows = identified(pages, id_col, url_col, html_col).toDF("id", "url", "html")
    marked = rows.where(F.col("html").rlike(r"(?i)<(article|main)\b") & (F.octet_length("html") <= MAX_PAGE_BYTES))
    n = marked.select("id").count()
    drawn = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 30)) < int(min(1.0, max_pages / max(1, n)) * (1 << 30))
    sample = sorted(r.html for r in marked.where(drawn).select("html").toLocalIterator())
    model = train(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, model) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


_P = "Lorem words of a paragraph that runs on for a while, so that its length is that of prose in an article. "
_MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>World news</a></li><li><a href=/c>About</a></li></ul>"
#: Labelled training pages of common layouts.
TEMPLATES = [
    f"""<html><head><title>A title</title><style>p{{}}</style><script>var x</script></head><body><header class="site-header"><h1>Site</h1>
    <nav class="menu" role="navigation">{_MENU}</nav></header><main data-main id="main"><article class="post"><h1>Heading</h1>
    <p>{_P * 3}</p><p>{_P}<a href=/x>a link</a> and more.</p><h2>Part</h2><ul><li>An item of the text</li><li>Another item</li></ul>
    <blockquote><p>{_P}</p></blockquote><p>End.</p><section data-not class="comments" id="comments"><h3>Comments</h3><div class="comment">
    <p>{_P}</p></div><div class="comment reply"><p>I agree.</p></div><form><label>Name</label><input><button>Send</button></form></section></article></main>
    <aside class="sidebar widget"><h3>Related</h3>{_MENU}<p>Read also this text.</p></aside><footer class="site-footer"><p>(c) Site</p>{_MENU}</footer></body></html>""",
    f"""<body><div id="header" class="header top banner"><a href=/>Logo</a></div><div id="nav" class="nav navbar">{_MENU}</div>
    <div class="cookie notice consent"><p>We use cookies on this site. <button>Accept</button></p></div><div id="wrapper" class="container">
    <div id="content" class="content article-body entry" data-main><h1 class="title headline">Heading</h1><p>{_P * 2}</p><p>Short.</p><p><b>{_P}</b></p>
    <div class="ad advert sponsored" data-not><p>Buy this now, a very good offer.</p></div><p>{_P * 4}</p><table><tr><td>cell</td><td>1</td></tr></table></div>
    <div id="sidebar" class="sidebar right"><div class="widget"><h4>Popular</h4>{_MENU}</div><div class="ads">Advert</div></div></div>
    <div id="comments" class="comments reader-comments"><p class="comment-author">A reader</p><p>{_P}</p><p>Nice text!</p></div>
    <div id="footer" class="footer"><p>Copyright, all rights reserved</p>{_MENU}</div></body>""",
    f"""<body><nav class="breadcrumb">{_MENU}</nav><div class="alert notice"><p>This site will be down on Sunday for maintenance work.</p></div>
    <article data-main><header data-not class="meta"><p>By an author</p></header><h1>Heading</h1><p>{_P}</p><p>{_P * 2}</p><p>{_P}</p>
    <aside data-not class="related"><h4>More</h4>{_MENU}</aside><p>{_P}</p><footer data-not><p>Filed under: news</p></footer></article>
    <form class="newsletter subscribe"><p>Get our letter every week.</p><input><button>Subscribe</button></form><footer><p>Imprint</p></footer></body>""",
    f"""<body><div class="page"><div class="post-content story text" data-main><h2>Heading</h2><p>{_P * 3}</p><p>{_P}</p><pre>code of the text</pre><p>One more.</p></div>
    <section class="discussion responses comment-list"><ol><li class="comment"><p>{_P}</p></li><li class="comment"><p>First!</p></li></ol></section>
    <div class="promo advertisement"><p>Sponsored: a product you will like, see the shop.</p></div></div></body>""",
    f"""<h1>Heading</h1><p>{_P * 2}</p><p>Short.</p><ul><li>An item</li></ul><p>{_P}</p>""",
    f"""<p>{_P * 2}</p><div class="ads" data-not><p>Buy this now.</p></div><p>{_P}</p><div class="comments" data-not><p>{_P}</p></div>""",
    _P * 4,
    _P,
    "A short text.",
    f"""<div class="nav" data-not>{_MENU}</div><h1>Heading</h1><p>{_P}</p><p>Short text.</p><div class="footer" data-not><p>Imprint</p></div>""",
    f"""<body data-main><h1>Heading</h1><p>{_P * 2}</p><p>{_P}</p><p>Short text.</p></body>""",
    f"""<body><main data-main role="main"><section><h2>Heading</h2><p>{_P * 2}</p><div><p>{_P}</p></div><figure><figcaption>A picture of it</figcaption></figure>
    <p>{_P}</p></section></main><div class="popup modal newsletter"><p>Sign up today.</p><form><input></form></div><div class="share social">{_MENU}</div></body>""",
]

#: Names authors give to the parts of a page.
MAIN_NAMES = "main content article post entry story text body article-body post-content entry-content page-content article-text".split()
OTHER_NAMES = ("sidebar ad ads advert advertisement banner promo sponsored cookie notice alert consent popup modal newsletter subscribe "
               "comments comment-list replies discussion footer header nav menu breadcrumb share social related login search widget "
               "pagination tags meta copyright reader-comments topbar toolbar").split()


def _layouts() -> list[str]:
    """Pages with each name once or more, as class or id, in and beside the main part."""
    out = []
    other = [f'<div class="{n}" data-not><p>{_P if k % 2 else "Some words."}</p>{_MENU if k % 3 else ""}</div>' for k, n in enumerate(OTHER_NAMES)]
    tags = [f"<{t} data-not>{_MENU if k % 2 else f'<p>{_P}</p>Words.'}</{t}>" for k, t in enumerate(sorted(ASIDE - {"head", "script", "style", "noscript"}))]
    for k, name in enumerate(MAIN_NAMES):
        mine = other[k % 4 :: 4] + tags
        key, box = ("id", "class")[k % 2], ("div", "section", "article", "main")[k % 4]
        before, inside, after = ("".join(mine[j::3]) for j in range(3))
        text = f"<h1>Heading</h1><p>{_P * 2}</p><p>Short.</p>{inside}<h2>Part</h2><p><b>{_P}</b><a href=x>link</a></p><ul><li>Item</li></ul><div>{_P}</div>"
        page = f"{before}<{box} {key}='{name}' data-main>{text}</{box}>{after}"
        out.append(f"<body><div class='wrap'>{page}</div></body>" if k % 2 else f"<html><body>{page}</body></html>")
    out.append(f"<body data-main><h1>Heading</h1><p>{_P}</p>{''.join(tags)}<p>Short.</p>{''.join(other)}</body>")
    return out


TEMPLATES += _layouts()
