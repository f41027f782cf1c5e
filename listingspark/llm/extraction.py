"""Main text of web pages by the agreement of their host.

A page's containers are scored by the text of the blocks inside them, without link text and boilerplate.
Each page votes for the generalised paths of its best containers (tags and classes from the root, digits
folded), Spark sums the votes per host and path, and every page is extracted again from the elements at the
winning path of its host.  A page that has no such element, or hardly any text there, keeps its own best container.

Boilerplate is by tag (menus, asides, footers, forms, scripts, styles and the like), by words in class, id or
role (comments, adverts, notices, sharing and the like), and by being hidden; of a header inside the article
only its headings stay.  Names that tell a feature or a state (has-sidebar, comments-open) don't count.  An element that holds most
of the page's text outside links stays though it is a form or named after what may frame a page (sidebar, overlay, share and the
like), and so does an article or main element.  Broken markup is closed the way browsers do it: an opening block ends a paragraph, a
closing tag ends what is open inside it, an open comment or script runs to the end.

Null or empty html gives the empty text, and so does a page without text.  A null address is the host of the
empty name.  Repeated rows are extracted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, stored

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title|select|object|canvas|math|xmp)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)  # a quote left open ends with its tag
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""(?<![-\w])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![-\w])hidden(?![-\w])|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - set("body caption html tbody td tfoot th thead tr".split())
_CONTAINER = set("article main section div td body html blockquote center".split())
_DROP = set("head nav aside footer form menu dialog button label fieldset search datalist audio video map frameset noframes".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
_BAD = set("nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside rail widget widgets comment comments reply replies "
           "disqus respond ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies "
           "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
           "recommendations pager pagination toolbar login paywall search complementary contentinfo".split())
# What a word of _BAD says of a part of the page, not of its frame: such an element goes however much text it holds.
_ALWAYS = set("comment comments reply replies disqus respond related recommended recommendations sponsor sponsored sponsors ad ads advert adverts "
              "advertisement advertising adsense promo promos promotion cookie cookies consent gdpr nav navbar navigation menu menus breadcrumb "
              "breadcrumbs masthead footer pager pagination contentinfo".split())
# Words that make the rest of a name a state or a feature of the element: has-sidebar, with-ads, comments-open, share-ready.
_FEATURE = set("has have with no not without is hide show enable disable".split())
_STATE = set("open opened closed close ready enabled disabled active inactive on off loaded allowed visible".split())
_HEAD_WORDS = {"header", "banner", "top", "topbar"}
_GOOD = set("article content entry post story body main text title".split())
# An element of these names ends an open element of these, up to a list or table around it.
_PEERS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_BONUS = {"article": 1.5, "main": 1.3, "html": 0.7, "body": 0.8}


def words_of(token: str) -> list[str]:
    """Lower-case words of one name, without those of a feature or a state."""
    words = [w.lower() for w in _WORD.findall(token)]
    for i, w in enumerate(words):
        if w in _FEATURE:
            return words[:i]
    return [] if len(words) > 1 and words[-1] in _STATE else words


class Page:
    """A page as nodes and a flat list of events: a text, an opening (node number) or a closing (-1 - node number)."""

    def __init__(self, html: str):
        self.tag, self.classes, self.parent, self.dropped = ["html"], [""], [-1], [False]
        self.begin, self.end = [0], [0]
        self.events: list[str | int] = [0]
        self._stack = [0]
        self._doubtful: set[int] = set()
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self.events.append(html[at:m.start()])
            at = m.end()
            name = m[3] or m[6]
            if name is None:
                continue
            name = name.lower()
            if m[2] or m[5]:
                self._close(name)
            elif name == "br":
                self.events.append(" ")
            elif name in _VOID:
                if name == "hr":
                    self._end_p()
                    self._open(name, "")
                    self._pop(len(self._stack) - 1)
            else:
                self._start(name, m[4] if m[3] else m[7])
        if at < len(html):
            rest = html[at:]
            cut = re.search(r"</?[a-zA-Z][^>]*\Z", rest)  # a tag that is never finished
            self.events.append(rest[:cut.start()] if cut else rest)
        self._pop(0)
        self._settle()

    def _settle(self) -> None:
        """An element that its name or its being a form would drop stays when it holds most of the page's text outside links."""
        if not self._doubtful:
            return
        sizes, link, i = [0] * (len(self.events) + 1), 0, 0
        while i < len(self.events):
            event = self.events[i]
            skip = i
            if isinstance(event, str):
                sizes[i + 1] = 0 if link else len(event.strip())
            elif event >= 0 and self.dropped[event] and event not in self._doubtful:
                skip = self.end[event]
            elif self.tag[event if event >= 0 else -1 - event] == "a":
                link += 1 if event >= 0 else -1
            i = skip + 1
        before = list(accumulate(sizes))
        for node in self._doubtful:
            self.dropped[node] = 2 * (before[self.end[node]] - before[self.begin[node]]) <= before[-1]

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and name in [self.tag[i] for i in self._stack]:
            return
        if name in _ENDS_P:
            self._end_p()
        if name in _PEERS:
            peers, around = _PEERS[name]
            for depth in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[depth]]
                if tag in peers:
                    self._pop(depth)
                    if tag == name or name == "dd" or name == "dt":
                        break
                elif tag in around or tag in ("div", "body"):
                    break
        self._open(name, attributes)
        if attributes.endswith("/") and name not in _BLOCK and name not in ("a", "b", "i", "em", "strong", "span"):
            self._pop(len(self._stack) - 1)

    def _end_p(self) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag == "p":
                self._pop(depth)
                return
            if tag in _BLOCK:
                return

    def _open(self, name: str, attributes: str) -> None:
        node = len(self.tag)
        parent = self._stack[-1]
        classes, dropped = "", name in _DROP
        doubtful = name == "form"
        if attributes and not attributes.isspace():
            m = _CLASS.search(attributes)
            classes = (m[1] or m[2] or m[3] or "") if m else ""
            if not dropped and name not in ("html", "body"):
                words = {w for m in _NAMES.finditer(attributes) for token in (m[2] or m[3] or m[4] or "").split() for w in words_of(token)}
                bad = words & _BAD
                if name in ("article", "main"):
                    bad &= _ALWAYS
                by_name = bool(bad) or bool(words & _HEAD_WORDS) and not words & _GOOD and name not in _HEADINGS and name != "header"
                if by_name:
                    dropped, doubtful = True, not bad & _ALWAYS
            if (not dropped or doubtful) and name not in ("html", "body") and _HIDDEN.search(
                    re.sub(r"""(class|id|role|href|src|title|alt|data-[-\w]+)\s*=\s*("[^"]*"|'[^']*')""", "", attributes, flags=re.I)):
                dropped, doubtful = True, False
        if dropped and doubtful:
            self._doubtful.add(node)
        inside = self.tag[parent] == "header" and name not in _HEADINGS and name not in ("div", "section")
        if name == "header" and not any(self.tag[i] in ("article", "main") for i in self._stack) or inside and name in _BLOCK:
            dropped = True
            self._doubtful.discard(node)
        self.tag.append(name)
        self.classes.append(classes)
        self.parent.append(parent)
        self.dropped.append(dropped)
        self.begin.append(len(self.events))
        self.end.append(0)
        self.events.append(node)
        self._stack.append(node)

    def _close(self, name: str) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag == name:
                self._pop(depth)
                return
            if tag in ("td", "th", "table") and name not in ("table", "tbody", "thead", "tfoot", "tr", "body", "html"):
                return

    def _pop(self, depth: int) -> None:
        while len(self._stack) > depth:
            node = self._stack.pop()
            self.end[node] = len(self.events)
            self.events.append(-1 - node)

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            names = sorted({_DIGITS.sub("#", c.lower()) for c in self.classes[node].split()})
            steps.append(".".join([self.tag[node], *names]))
            node = self.parent[node]
        return "/".join(["html", *reversed(steps)])

    def blocks(self, root: int) -> Iterator[tuple[int, str, int]]:
        """(node, text, characters in links) of each block below ``root`` that is no boilerplate, in page order."""
        events, tag, dropped = self.events, self.tag, self.dropped
        parts: list[str] = []
        links = in_link = 0
        where, i, stop = root, self.begin[root], self.end[root]
        home = [root]
        while i <= stop:
            event = events[i]
            if isinstance(event, str):
                parts.append(event)
                if in_link:
                    links += len(event.strip())
            else:
                node = event if event >= 0 else -1 - event
                name = tag[node]
                if name in _BLOCK or dropped[node]:
                    if parts:
                        text = " ".join(unescape("".join(parts)).split())
                        if text:
                            yield where, text, links
                        parts, links = [], 0
                    if event >= 0:
                        if dropped[node] and node != root:
                            i = self.end[node]
                        else:
                            home.append(node)
                    else:
                        home.pop()
                    where = home[-1]
                elif name == "a":
                    in_link += 1 if event >= 0 else -1
            i += 1
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                yield where, text, links

    def scores(self) -> dict[int, float]:
        """Containers by the text inside them: the nearest counts a block in full, each further one half of that."""
        out: dict[int, float] = {}
        for node, text, links in self.blocks(0):
            worth = max(0, len(text) - 2 * links)
            if tag_is_list(self.tag[node]):
                worth *= 0.7
            while node >= 0 and worth > 0.5:
                if self.tag[node] in _CONTAINER:
                    out[node] = out.get(node, 0.0) + worth * _BONUS.get(self.tag[node], 1.0)
                    worth /= 2
                node = self.parent[node]
        return out


def tag_is_list(tag: str) -> bool:
    return tag in ("li", "dt", "dd")


def votes_of(html: str | None, most: int = 3) -> list[tuple[str, float]]:
    """Paths of the best containers of a page, each with its share of the best score."""
    page = Page(html or "")
    ranked = sorted(page.scores().items(), key=lambda x: (-x[1], x[0]))
    out: dict[str, float] = {}
    for node, score in ranked[:most]:
        path = page.path(node)
        out[path] = max(out.get(path, 0.0), round(score / ranked[0][1], 3))
    return list(out.items())


def main_text(html: str | None, path: str | None = None) -> str:
    """Blocks of the elements at ``path``, or of the page's own best container, joined by an empty line."""
    page = Page(html or "")
    scores = page.scores()
    best = min(scores, key=lambda n: (-scores[n], n), default=None)
    if best is None:
        return "\n\n".join(t for _, t, _ in page.blocks(0))
    own = [t for _, t, _ in page.blocks(best)]
    if path and page.path(best) != path:
        roots: list[int] = []
        for node in range(len(page.tag)):
            if page.tag[node] in _CONTAINER and page.path(node) == path and not page.dropped[node] and not any(page.end[r] > page.begin[node] for r in roots[-1:]):
                roots.append(node)
        there = [t for r in roots for _, t, _ in page.blocks(r)]
        if sum(map(len, there)) * 4 >= sum(map(len, own)):
            return "\n\n".join(there)
    elif path:
        same = [n for n in range(len(page.tag)) if page.tag[n] in _CONTAINER and not page.dropped[n] and page.path(n) == path]
        if len(same) > 1:  # several articles of one form on a page
            roots = []
            for n in same:
                if not roots or page.end[roots[-1]] < page.begin[n]:
                    roots.append(n)
            return "\n\n".join(t for r in roots for _, t, _ in page.blocks(r))
    return "\n\n".join(own)


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; the empty name for anything else."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, votes``: the path with most votes of each host; among equals the shorter, then the first."""
    ship(pages.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, weight = [], [], []
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p, w in votes_of(html):
                    host.append(h)
                    path.append(p)
                    weight.append(int(1000 * w))
            yield pa.RecordBatch.from_pydict({"host": pa.array(host, pa.string()), "path": pa.array(path, pa.string()), "weight": pa.array(weight, pa.int64())})

    votes = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].cast("string").alias("html")).mapInArrow(vote, "host string, path string, weight long")
    sums = votes.groupBy("host", "path").agg(F.sum("weight").alias("votes"))
    return sums.groupBy("host").agg(F.min(F.struct(-F.col("votes"), F.length("path"), "path")).alias("best")).select(
        "host", "best.path", (-F.col("best.col1")).alias("votes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 64) -> DataFrame:
    """``page_id, url, text`` of every page.

    The winning paths are written first, so their size is known when they meet the pages: where it is below the
    broadcast threshold no page is shuffled.  Beyond it, the pages of a host are dealt over ``salts`` tasks.
    """
    paths = stored(host_paths(pages, url_col, html_col).select("host", "path"), "host-paths")
    paths = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                        pages[html_col].cast("string").alias("html"), host_of(pages[url_col]).alias("host"),
                        F.pmod(F.xxhash64(pages[id_col], pages[url_col]), F.lit(salts)).cast("int").alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.join(paths, ["host", "salt"], "left").select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string")
