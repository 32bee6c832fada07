"""Main text of web pages by removing what recurs on their host.

Pages are parsed into elements and every element subtree with text is named twice
by hashes: by its content (tags, attributes, text), and, if it is no prose, by its
frame (tags, classes and roles, whatever the text).  Spark counts, by host, the
distinct surroundings in which each name occurs; names that recur in many are the
host's template.  A second pass over the pages deletes template subtrees.

* Content names say that the same box stands on many pages: notices, teasers,
  forms, wherever they are, inside articles too.
* Frame names say that a box of the same make does, its text changing from page
  to page: menus, adverts, footers.  They are given outside of articles and main
  elements only; where a page has neither, only to boxes that are mostly links.

What one page of a host can't show by recurrence (reader comments, or a host of
two pages) is left to the elements' tags and classes: of what the counts leave,
the outermost articles, or main elements, or all of a page that has neither, are
taken without elements that say that they are no content.

Copies of an article on one host recur too.  A subtree's surroundings are
therefore told apart by the longest text of the page outside of it, that of
elements that say that they are no content left aside: paragraphs of a copied or
nearly copied page have the same one on each copy and count once.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from lineament.llm.words import unused
from lineament.plans.storage import sized, written

LEAST_PAGES, SHARE = 3, 0.5
HTML_STEP = 4 << 20
# fixed values: HTML's element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot body html legend summary figcaption".split())
#: Elements that a start tag of the key closes when they are open, up to the nearest of the barrier.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset("ul ol dl table div article section main body html menu aside nav header footer form blockquote select".split())
#: Elements whose text is no text of the page.
UNSEEN = frozenset("head script style noscript template iframe object embed svg canvas audio video title textarea select option datalist".split())
#: Elements that hold prose: their boxes are template by content alone.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure dl article main".split())
#: What isn't content by its own word: tags, roles, and classes or ids, which may be joined with one another and with the neutral ones.
NOISE_TAGS = UNSEEN | frozenset("nav aside footer header form button input menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond reply replies disqus form search pagination pager toolbar hidden".split()
)
NEUTRAL_WORDS = frozenset("site page global top bottom left right main box block area section container wrapper wrap list bar link links item items button buttons icon icons inner outer content text title".split())
#: A start tag as most are written; nothing in it is tried twice.
_start = re.compile(r"""<([a-zA-Z][^\s/><]*+)((?:\s++[^\s=>"'/<]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?+)*+\s*+/?+)>""")
_name = re.compile(r"[^\s/>]*+")
_attribute = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_raw_end = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}


def noisy(word: str) -> bool:
    """Whether a class or id is one of NOISE_WORDS, or made of them and neutral ones alone."""
    if word in NOISE_WORDS:
        return True
    parts = re.split("[-_]+", word)
    return len(parts) > 1 and any(p in NOISE_WORDS for p in parts) and all(p in NOISE_WORDS or p in NEUTRAL_WORDS for p in parts)


class Element:
    __slots__ = ("tag", "attributes", "children", "parent", "depth")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.depth = parent.depth + 1 if parent else 0

    def named(self) -> dict[str, str]:
        """Attributes by name, the first of each, values in lower case."""
        out: dict[str, str] = {}
        for m in _attribute.finditer(self.attributes):
            out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        return out

    def noise(self) -> bool:
        if self.tag in NOISE_TAGS:
            return True
        if not self.attributes:
            return False
        own = self.named()
        if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role") in NOISE_ROLES or "display:none" in own.get("style", "").replace(" ", ""):
            return True
        return self.tag not in ("html", "body", "article", "main") and any(noisy(w) for w in (own.get("class", "") + " " + own.get("id", "")).split())

    def frame(self) -> str:
        """What the element is without its content: tag, classes, id and role."""
        if not self.attributes:
            return self.tag
        own = self.named()
        return " ".join([self.tag, *sorted(own.get("class", "").split()), "#" + own.get("id", ""), own.get("role", "")])


def tag_end(html: str, at: int) -> int:
    """The place behind the `>` that ends the tag whose attributes begin at `at`, -1 if none does; quotes count after `=` only."""
    n = len(html)
    while at < n:
        c = html[at]
        if c == ">":
            return at + 1
        at += 1
        if c == "=":
            while at < n and html[at].isspace():
                at += 1
            if at < n and html[at] in "\"'":
                at = html.find(html[at], at + 1) + 1
                if not at:
                    return -1
    return -1


def parse(html: str) -> Element:
    """A tree of elements and raw text; end tags that HTML implies are put in, stray ones left out.

    Every character is looked at a bounded number of times.  A tag, comment or
    declaration that the page's end cuts off is no text.
    """
    root = node = Element("", "", None)
    at, n = 0, len(html)
    #: The open elements of each tag, and the open barriers.
    opened: dict[str, list[Element]] = {}
    barriers: list[Element] = [root]

    def close(tags: tuple[str, ...], to_barrier: bool = True) -> None:
        """Closes the nearest open element of some tags and all in it, unless a barrier within it is open and counts."""
        nonlocal node
        e = None
        for t in tags:
            if (found := opened.get(t)) and (e is None or found[-1].depth > e.depth):
                e = found[-1]
        if e is None or to_barrier and barriers[-1].depth > e.depth:
            return
        while node is not e.parent:
            opened[node.tag].pop()
            if barriers[-1] is node:
                barriers.pop()
            node = node.parent

    while at < n:
        start = html.find("<", at)
        if start < 0:
            node.children.append(html[at:])
            break
        c = html[start + 1 : start + 2]
        end_tag = c == "/" and html[start + 2 : start + 3].isascii() and html[start + 2 : start + 3].isalpha()
        if c and c not in "/!?" and not (c.isascii() and c.isalpha()):
            node.children.append(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            node.children.append(html[at:start])
        if not c:
            break
        if c in "!?/" and not end_tag:
            end = html.find("-->", start + 4) + 3 if html.startswith("<!--", start) else html.find(">", start) + 1
            at = end if end > 2 else n
            continue
        if end_tag:
            tag = _name.match(html, start + 2)[0].lower()
            at = html.find(">", start) + 1 or n
            close((tag,), tag not in BLOCK)
            continue
        if m := _start.match(html, start):
            tag, attributes, at = m[1].lower(), m[2], m.end()
        else:
            tag = _name.match(html, start + 1)[0]
            begin = start + 1 + len(tag)
            at = tag_end(html, begin)
            if at < 0:
                break
            tag, attributes = tag.lower(), html[begin : at - 1]
        if tag in CLOSES_P:
            close(("p",))
        elif tag in SIBLINGS:
            close(SIBLINGS[tag])
        new = Element(tag, attributes, node)
        node.children.append(new)
        if tag in RAW:
            end = _raw_end[tag].search(html, at)
            new.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            node = new
            opened.setdefault(tag, []).append(new)
            if tag in BARRIER:
                barriers.append(new)
    return root


def _hash(text: str) -> int:
    """64 bits, signed."""
    n = xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return n - (1 << 64) if n >> 63 else n


def _longest(texts: list[str]) -> list[str]:
    """The longest of the first 0, 1, 2, ... texts; of equals the greatest."""
    out, top = [""], ""
    for t in texts:
        if len(t) > len(top) or len(t) == len(top) and t > top:
            top = t
        out.append(top)
    return out


def named_subtrees(root: Element) -> tuple[list[tuple[Element, tuple[int, ...], str]], str]:
    """Elements with text, their subtrees' names as signed 64-bit numbers, and the longest text outside of each; and the longest of all.

    The page as a whole, articles, and main elements that stand for the page have no name.
    """
    tops = outermost(root, "article") or outermost(root, "main")
    order: list[tuple[Element, int, bool]] = []  # with the number of texts before the element, and whether it is in an article or prose
    texts: list[str] = []
    ends: dict[int, int] = {}
    unnamed = {id(e) for e in tops}
    stack: list = [(root, False, False)]
    while stack:
        e, inside, quiet = stack.pop()
        if isinstance(e, str):
            if t := " ".join(e.split()):
                texts.append("" if quiet else t)
        elif inside is None:
            ends[id(e)] = len(texts)
        elif e.tag not in UNSEEN:
            order.append((e, len(texts), inside))
            stack.append((e, None, None))
            inside = inside or e.tag in PROSE
            quiet = quiet or e.noise()
            stack.extend((c, inside, quiet) for c in reversed(e.children))
    before, after = _longest(texts), _longest(texts[::-1])[::-1]  # of the texts before each place, and from it on

    out = []
    content: dict[int, int] = {}
    frames: dict[int, str | None] = {}  # of elements that aren't within prose; None: prose, or holding some
    size: dict[int, tuple[int, int]] = {}  # characters of text, and of those in links
    for e, start, inside in reversed(order):  # children before parents
        parts = [e.tag, e.attributes]
        for c in e.children:
            if isinstance(c, str):
                if t := c.strip():
                    parts.append(t)
            elif id(c) in content:
                parts.append(f"\0{content[id(c)]:x}")
        content[id(e)] = name = _hash("\1".join(parts))
        names = (name,)
        frame = None
        if not inside:
            seen = [c for c in e.children if isinstance(c, str) or id(c) in content]
            own = [frames[id(c)] for c in seen if not isinstance(c, str)] if e.tag not in PROSE else ()
            if e.tag not in PROSE and None not in own:
                frame = f"{e.frame()}({','.join(sorted(set(own)))})"
                if len(frame) > 512:
                    frame = f"{_hash(frame):x}"
                chars = sum(len(c.strip()) if isinstance(c, str) else size[id(c)][0] for c in seen)
                size[id(e)] = chars, chars if e.tag == "a" else sum(size[id(c)][1] for c in seen if not isinstance(c, str))
            frames[id(e)] = frame
        if (end := ends[id(e)]) > start and id(e) not in unnamed and e.tag not in ("", "html", "body"):
            if frame is not None and e.tag in BLOCK and (tops or 2 * size[id(e)][1] > size[id(e)][0]):
                names = (name, _hash("\2" + frame))
            x, y = before[start], after[end]
            out.append((e, names, x if (len(x), x) > (len(y), y) else y))
    return out, before[-1]


def outermost(root: Element, tag: str) -> list[Element]:
    """Elements of a tag that aren't in another or in what isn't content, in page order."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.tag == tag:
            out.append(e)
        else:
            stack += [c for c in reversed(e.children) if not isinstance(c, str) and c.tag not in NOISE_TAGS]  # one in a menu or footer is no article
    return out


def blocks(root: Element, template: set[int], by_tags: bool = True) -> list[str]:
    """The blocks of what isn't template or, with by_tags, noise; white space made one space."""
    gone = {id(e) for e, names, _ in named_subtrees(root)[0] if not template.isdisjoint(names)} if template else ()
    tops = (outermost(root, "article") or outermost(root, "main")) if by_tags else []
    out: list[str] = []
    line: list[str] = []

    def close():
        text = " ".join(unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    # a stack, as pages may be nested deeply: elements to enter, text to add, None to end a block
    stack: list = [*reversed(tops or [root])]
    while stack:
        c = stack.pop()
        if c is None:
            close()
        elif isinstance(c, str):
            line.append(c)
        elif id(c) in gone or (c.noise() if by_tags else c.tag in UNSEEN):
            continue
        elif c.tag == "br":
            line.append(" ")
        else:
            if c.tag in BLOCK or c.tag == "":
                close()
                stack.append(None)
            stack.extend(reversed(c.children))
    close()
    return out


def _host(url: str | None) -> str | None:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else None


def _pieces(batches, column: str):
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > HTML_STEP:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _named(html: str, url: str):
    """(host, name, rest) for each name of a page, and without a name for the page as a whole."""

    def run(batches):
        for b in _pieces(batches, html):
            hosts, names, rests = [], [], []
            for h, u in zip(b.column(html).to_pylist(), b.column(url).to_pylist()):
                found, longest = named_subtrees(parse(h or ""))
                hashed = {t: _hash(t) for t in {longest, *(t for _, _, t in found)}}
                rows = {(None, hashed[longest]), *((name, hashed[t]) for _, own, t in found for name in own)}
                hosts += [_host(u)] * len(rows)
                names += [name for name, _ in rows]
                rests += [rest for _, rest in rows]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(rests, pa.int64())], names=["host", "name", "rest"])

    return run


def _extracted(html: str, names: list[str], template: str, by_tags: bool):
    def run(batches):
        for b in _pieces(batches, html):
            texts = ["\n".join(blocks(parse(h or ""), set(t or ()), by_tags)) for h, t in zip(b.column(html).to_pylist(), b.column(template).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "__text", "__n_chars"])

    return run


def host_of(url):
    """The host of a URL column as _host() finds it."""
    pattern = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    return F.when(url.rlike(pattern), F.lower(F.regexp_extract(url, pattern, 1)))


def templates(pages: DataFrame, html: str = "html", url: str = "url", least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, names): subtrees that recur in least_pages distinct surroundings on a host at least, and in more than that share of its distinct pages.

    Pages are distinct by their longest text, as surroundings are.  A host has
    at most (subtrees of a mean page) / share of names.
    """
    rows = pages.select(html, url).mapInArrow(_named(html, url), "host string, name long, rest long").distinct()
    counts = written(rows.groupBy("host", "name").agg(F.count("*").alias("n")).filter((F.col("n") >= least_pages) | F.col("name").isNull()), "counts")
    totals = counts.filter("name is null").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    named = counts.filter("name is not null")
    many = named.join(totals, named["host"].eqNullSafe(totals["of"])).filter(F.col("n") > share * F.col("pages"))
    return many.groupBy("host").agg(F.collect_list("name").alias("names"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url", least_pages: int = LEAST_PAGES, share: float = SHARE, by_tags: bool = True) -> DataFrame:
    """pages without the html, with __text and __n_chars (code points).

    Blocks are joined by one line feed in page order, white space inside a block
    is one space, character references are decoded.  A null or empty html, or
    one without content, gives an empty text.  Pages without a host are a host of
    their own; rows that repeat are pages each; a host of fewer than least_pages
    distinct pages has no template.  Deep nesting, unclosed and stray tags and
    cut-off pages are read as HTML reads them, as far as blocks go.  Without
    by_tags host counts alone decide.  A column of pages that is named like one
    of the two results is replaced by it.  An empty table gives no rows.
    """
    names = [n for n in pages.columns if n != html and n.lower() not in ("__text", "__n_chars")]
    pages = pages.select(*names, html)
    found = written(templates(pages, html, url, least_pages, share), "templates")
    size = found.select(F.coalesce(F.sum(F.size("names")), F.lit(0)).alias("n"), F.count("*").alias("hosts")).first()
    key, template = unused(pages, "host"), unused(pages, "template")
    side = sized(found.select(F.col("host").alias(key), F.col("names").alias(template)), 8, size["n"] + 8 * size["hosts"])
    rows = pages.join(side, host_of(F.col(url)).eqNullSafe(F.col(key)), "left")
    shape = T.StructType([*(pages.schema[n] for n in names), T.StructField("__text", T.StringType()), T.StructField("__n_chars", T.LongType())])
    return rows.select(*names, html, template).mapInArrow(_extracted(html, names, template, by_tags), shape)
