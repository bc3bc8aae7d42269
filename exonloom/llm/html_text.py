"""Main text of web pages, with site templates removed by counting element subtrees per host.

Pages are parsed twice, leniently and in linear time.  The first pass hashes every block element's subtree (tags and
text, each child by its own hash) and counts it per host, on the raw page, before any rule.  A subtree that stands on
many pages of its host that differ in the rest is template.  The second pass deletes template subtrees; what counting
cannot see, as on hosts with few pages, rules take out: elements that are no article by their tag (nav, header, footer,
aside, form, script, style and the like), by their role, or by a telling class or id.

An article's content is guarded.  Paragraphs and headings are not counted by themselves: a passage that many articles
share is text.  In an article, and on pages without one, only small parts are counted, they must stand on a share of
the host's pages as well, and in an article pages count as different by their longest other block, so that near copies
don't make their body or a table in it a template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.llm.common import cut, discard

#: Elements whose content is never shown or never text.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "title", "head"}
#: Elements around an article.
AROUND = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search"}
#: Elements that begin and end a block of text.
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Block elements that are no template by themselves: an author's paragraph, or the page or article as a whole.
NEVER = HEADINGS | {"p", "blockquote", "pre", "html", "body", "main", "article"}
#: Parts of lists and tables count with these as a whole where they may be an author's.
PARTS = {"li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "summary", "legend", "figcaption"}
#: Of a page's text, a counted part of an article has at most one in so many; of a page without article, one in HALF.
SMALL, HALF = 4, 2
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What closes an open element without its end tag: tag -> open tags that it ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = ("ul", "ol", "dl", "table", "div", "article", "section", "body", "main")
#: Words of a class or id that tell what an element is.
TELLING = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|masthead|comments?|commentlist|respond|replies|reactions?|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|widget|pagination|pager|toolbar|skip|disclaimer|copyright)(?:$|[\s_-])",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: A tag, up to a '>' that stands in no quoted attribute value; the loop is atomic, so a failure costs one pass.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>=]+|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_NAME = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
#: Character references with more digits than any character has, which int() would refuse.
_ZEROS, _DIGITS = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title")}
#: What an element or block is in; a block has its innermost element's.
OUT, HARD, ARTICLE, IN_HEADER, IN_HEADING, ITEM, MUTE = 1, 2, 4, 8, 16, 32, 64
#: Template subtrees whose hashes are broadcast at most, 8 bytes each; beyond, they are joined to the pages.
MOST_TEMPLATES = 1 << 21


def _left_out(tag: str, rest: str, in_article: bool) -> bool:
    if not rest.strip(" /\n\t\r"):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("article", "main", "body", "html"):
            if in_article:  # an article's header has its title
                value = " ".join(w for w in value.split() if "header" not in w)
            if TELLING.search(value):
                return True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:
        text = _DIGITS.sub("&#9999999", _ZEROS.sub("&#", text))
    return html.unescape(text)


class Page:
    """A page's blocks of text in order, and its block elements with the blocks that each spans."""

    def __init__(self, page: str | None):
        self.blocks: list[str] = []
        self.home: list[int] = []  # a block's innermost block element
        self.flag: list[int] = []  # what a block is in
        self.linked: list[bool] = []  # whether all of its text is in links
        self.tags, self.up, self.flags, self.first, self.last, self.digest = [""], [-1], [0], [0], [0], [0]
        self._parse(page or "")

    def _parse(self, text: str) -> None:
        """One pass; every step costs the length of what it reads, as open elements are found by per-tag stacks."""
        stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, flags, block element
        open_of: dict[str, list[int]] = {}  # depths at which a tag is open
        open_blocks = [0]
        hashers = [xxhash.xxh3_64()]
        links = 0
        parts: list[str] = []
        in_links = plain = 0

        def flush() -> None:
            nonlocal in_links
            if parts:
                size = sum(map(len, parts))
                line = _SPACE.sub(" ", "".join(parts)).strip()
                if line:
                    _, flags, e = stack[-1]
                    hashers[-1].update(b"\x02" + line.encode("utf-8", "surrogatepass"))
                    self.blocks.append(line)
                    self.home.append(e)
                    self.flag.append(flags)
                    self.linked.append(in_links >= size)
                parts.clear()
                in_links = 0

        def close() -> None:
            nonlocal links
            tag, _, e = stack.pop()
            open_of[tag].pop()
            if tag == "a":
                links -= 1
            if tag in BLOCK:
                open_blocks.pop()
                h = hashers.pop()
                self.digest[e], self.last[e] = h.intdigest(), len(self.blocks)
                hashers[-1].update(b"\x03" + h.digest())

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                close()

        deepest = lambda tags: max((open_of[t][-1] for t in tags if open_of.get(t)), default=0)
        at, n = 0, len(text)
        while at < n:
            lt = text.find("<", at)
            stop = lt if lt >= 0 else n
            flags = stack[-1][1]
            if stop > at and not flags & MUTE:
                own = _decoded(text[at:stop])
                parts.append(own)
                if links:
                    in_links += len(own)
            if lt < 0:
                break
            after = text[lt + 1 : lt + 2]
            if after in "!?" and after or after == "/" and not text[lt + 2 : lt + 3].isalpha():
                comment = text.startswith("<!--", lt)
                end = text.find("-->" if comment else ">", lt + 2 if comment else lt)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            name = _NAME.match(text, lt)
            if not name:
                if not flags & MUTE:
                    parts.append("<")
                at = lt + 1
                continue
            m = None if plain else _TAG.match(text, lt)
            if m:
                ending, tag, rest, at = m[1] == "/", m[2].lower(), m[3], m.end()
            else:  # a quote stays open to the page's end: from here on, quotes don't count
                plain = 1
                end = text.find(">", lt)
                if end < 0:
                    break
                ending = text[lt + 1] == "/"
                tag, rest, at = text[lt + 1 + ending : name.end()].lower(), text[name.end() : end], end + 1
            if tag in BLOCK:
                flush()
            elif tag == "br":
                parts.append(" ")
            if ending:
                here = open_of.get(tag)
                # an inline end tag doesn't reach out of its block
                if here and (tag in BLOCK or here[-1] > open_blocks[-1]):
                    close_to(here[-1])
                continue
            if tag in VOID or rest.endswith("/"):
                continue
            if tag in BLOCK:
                # a block tag ends an open paragraph and the inline elements in it
                inner = stack[open_blocks[-1]][0]
                if inner == "p" or inner in HEADINGS and tag in HEADINGS:
                    close_to(open_blocks[-1])
            if tag in CLOSES:
                old = deepest(CLOSES[tag])
                if old > deepest(_SCOPE):
                    close_to(old)
            self._open(tag, rest, stack, open_of, open_blocks, hashers)
            links += tag == "a"
            if tag in _ENDS:
                end = _ENDS[tag].search(text, at)
                at = end.end() if end else n
                close()
        flush()
        close_to(1)
        self.last[0] = len(self.blocks)

    def _open(self, tag: str, rest: str, stack: list, open_of: dict, open_blocks: list, hashers: list) -> None:
        _, up, e = stack[-1]
        flags = up
        if tag in SILENT:
            flags |= MUTE | HARD
        elif tag in AROUND and not (tag == "header" and up & ARTICLE):
            flags |= HARD
        if flags & HARD or _left_out(tag, rest, bool(up & ARTICLE)):
            flags |= OUT
        if tag in ("article", "main"):
            comment = tag == "article" and re.search(r"comment|reply", rest, re.I)
            out = flags & HARD or comment or up & OUT and up & ARTICLE
            flags = flags | OUT if out else flags & ~OUT
            flags |= ARTICLE
        if tag == "header":
            flags |= IN_HEADER
        elif tag in HEADINGS:
            flags |= IN_HEADING
        elif tag in ("li", "td"):
            flags |= ITEM
        if tag not in BLOCK and flags & OUT and not up & OUT:
            flags |= MUTE  # an inline element that is left out is no block of its own
        open_of.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
            e = len(self.tags)
            self.tags.append(tag)
            self.up.append(stack[-1][2])
            self.flags.append(flags)
            self.first.append(len(self.blocks))
            self.last.append(len(self.blocks))
            self.digest.append(0)
            hashers.append(xxhash.xxh3_64(tag))
        else:
            hashers[-1].update(b"\x01" + tag.encode())
        stack.append((tag, flags, e))

    def subtrees(self, host: str) -> tuple[list[tuple[int, int, bool]], list[int]]:
        """((key, rest, sure) of every counted subtree, key of every deletable one by element, 0 if it is none).

        ``rest`` tells the page apart from others that hold the subtree; ``sure`` if it stands outside the page's
        article, where nothing is the author's."""
        n = len(self.blocks)
        hashes = [xxhash.xxh3_64_intdigest(b.encode("utf-8", "surrogatepass")) for b in self.blocks]
        sums, sizes = [0], [0]
        for h, b in zip(hashes, self.blocks):
            sums.append(sums[-1] + h)
            sizes.append(sizes[-1] + len(b))
        ranked = [(len(b), h) for b, h in zip(self.blocks, hashes)]
        before, behind = [(0, 0)], [(0, 0)]
        for r in ranked:
            before.append(max(before[-1], r))
        for r in reversed(ranked):
            behind.append(max(behind[-1], r))
        told = [k for k in range(n) if self.flag[k] & ARTICLE and not self.flag[k] & OUT]
        has_article, low, high = bool(told), min(told, default=0), max(told, default=-1)
        salt = xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))
        counted, keys = [], [0] * len(self.tags)
        for e in range(1, len(self.tags)):
            lo, hi = self.first[e], self.last[e]
            if lo == hi or self.tags[e] in NEVER:
                continue
            size = sizes[hi] - sizes[lo]
            inside = self.flags[e] & ARTICLE and not self.flags[e] & OUT
            sure = has_article and not inside and (hi <= low or lo > high)
            key = (self.digest[e] ^ salt) * 0x9E3779B97F4A7C15 % (1 << 63) or 1
            if not sure:
                if self.tags[e] in PARTS or size * (SMALL if inside else 1) > sizes[n]:
                    continue
                keys[e] = key
                if not inside and size * HALF > sizes[n]:
                    continue
            keys[e] = key
            rest = max(before[lo], behind[n - hi])[1] if inside else sums[n] - (sums[hi] - sums[lo])
            counted.append((key, rest % (1 << 63), sure))
        return counted, keys

    def text(self, keys: list[int], template: set[int] | None = None) -> tuple[str, int, int]:
        """(main text, code points that stood in template, code points that rules took out)."""
        gone = [False] * len(self.tags)
        for e in range(1, len(gone)):
            gone[e] = gone[self.up[e]] or bool(template) and keys[e] in template
        left = [k for k in range(len(self.blocks)) if not gone[self.home[k]]]
        kept = [k for k in left if not self.flag[k] & OUT]
        if any(self.flag[k] & ARTICLE for k in kept):
            kept = [k for k in kept if self.flag[k] & ARTICLE]
            # an article's own header: its headings are the article's, the rest is not
            kept = [k for k in kept if not self.flag[k] & IN_HEADER or self.flag[k] & IN_HEADING]
        else:  # outside an article, a list item or cell that is one link is a menu's
            kept = [k for k in kept if not (self.linked[k] and self.flag[k] & ITEM)]
        size = lambda ks: sum(len(self.blocks[k]) for k in ks)
        return "\n".join(self.blocks[k] for k in kept), size(range(len(self.blocks))) - size(left), size(left) - size(kept)


def host_of(url: str | None) -> str:
    """The url's host, lower-cased, without user and port; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _hosts(urls: pa.Array) -> list[str]:
    return [host_of(u) for u in urls.to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, url, html) to a row per counted subtree, one with a null key per page, whose rest is the page's, and one
    with a null rest for each subtree that isn't counted on this page but goes from it if it is template."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            some = batch.slice(at, 200)
            rows: list[tuple[int, int, int | None, int, bool]] = []
            for mark, host, page in zip(some.column(0).to_pylist(), _hosts(some.column(1)), some.column(2)):
                p = Page(page.as_py())
                salt = xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")) >> 1
                rows.append((mark, salt, None, xxhash.xxh3_64_intdigest("\n".join(p.blocks).encode("utf-8", "surrogatepass")) >> 1, False))
                counted, keys = p.subtrees(host)
                rows += [(mark, salt, *s) for s in counted]
                rows += [(mark, salt, k, None, False) for k in {*keys} - {0, *(s[0] for s in counted)}]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["print", "host", "subtree", "rest", "sure"])


def _cleaned(templates):
    """(page, url, html[, gone]) to the output; ``templates`` is a broadcast sorted array, or None if rows have their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates.value if templates else None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                out = []
                for k, (host, page) in enumerate(zip(_hosts(some.column(1)), some.column(2))):
                    p = Page(page.as_py())
                    keys = p.subtrees(host)[1]
                    if known is None:
                        gone = set(some.column(3)[k].as_py() or ())
                    else:
                        own = np.array(keys, np.int64)
                        place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                        gone = set(own[known[place] == own].tolist()) if len(known) else set()
                    out.append(p.text(keys, gone - {0}))
                text, template, ruled = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(template, pa.int64()), pa.array(ruled, pa.int64())],
                    names=["page", "url", "text", "n_chars", "template_chars", "rule_chars"],
                )

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", recurring: int = 5, share: float = 0.05, most_templates: int = MOST_TEMPLATES) -> DataFrame:
    """(id, url, text, n_chars, template_chars, rule_chars) for every row of ``pages``.

    A block element's subtree that stands on ``recurring`` or more pages of its host that differ in the rest is
    template and deleted; where it may be an author's, it must also stand on ``share`` or more of the host's different
    pages.  ``template_chars`` is how much text that removed, ``rule_chars`` how much the rules did after it.
    Character references are decoded, white space inside a block becomes one space, blocks are trimmed, and joined
    by a newline; nothing else is dropped.

    Defined results: a null or empty page, or one with nothing but template, has the empty text.  A null url, or one
    without a host, belongs to the host "".  Repeated rows agree in the rest, so they count once.  A host with a
    third of all pages is counted by partial sums.  Templates' hashes are broadcast if there are ``most_templates`` at
    most, and else joined to the pages that hold them; nothing is gathered per host.  A page of any size and nesting
    takes time in proportion to its length.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    mark = F.xxhash64("url", "html").alias("print")
    seen = cut(base.select(mark, "url", "html").mapInArrow(_counted, "print bigint, host bigint, subtree bigint, rest bigint, sure boolean"))
    held = seen.filter("subtree is not null")
    each = held.filter("rest is not null").groupBy("host", "subtree", "rest").agg(F.max("sure").alias("sure"))
    each = each.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.count_if("sure").alias("n_sure")).filter(F.col("n") >= recurring)
    pages_of = seen.filter("subtree is null").groupBy("host").agg(F.count_distinct("rest").alias("pages"))
    often = (F.col("n_sure") >= recurring) | (F.col("n") >= F.col("pages") * share)
    template = cut(each.join(pages_of, "host").filter(often).select("subtree").distinct())
    schema = f"page {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint, template_chars bigint, rule_chars bigint"
    if template.count() <= most_templates:
        known = np.sort(template.toArrow().column(0).to_numpy())
        out = base.mapInArrow(_cleaned(pages.sparkSession.sparkContext.broadcast(known)), schema)
        discard(seen)
    else:
        gone = held.join(template, "subtree").groupBy("print").agg(F.collect_set("subtree").alias("gone"))
        out = base.withColumn("print", mark).join(gone, "print", "left").select("page", "url", "html", "gone").mapInArrow(_cleaned(None), schema)
    return out.withColumnsRenamed({"page": id_col, "url": url_col})
