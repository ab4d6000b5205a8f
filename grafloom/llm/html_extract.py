"""Main text of web pages, with site templates found by counting subtrees.

A page is parsed into blocks.  Elements that are never article text (menus, headers,
footers, sidebars, forms, scripts, adverts and notices by their roles and by whole names of
their classes, reader comments) yield none, but no name drops an article or what holds the
page's article or main.  Of the block elements that could still reach the main text, each
subtree is hashed with its tag and text; Spark counts, per host, over how many pages of
different main text each hash recurs, and subtrees that recur are deleted.  Paragraphs,
headings, lists and the like inside an article can also be quoted or copied: they must
recur over a share of the host's pages, and single ones over more pages than whole lists,
tables and figures.  A page most of whose text they make up is a copy and stays whole.

What stands around the main text often varies in its words, but not in its form.  So each
frame, a container or list outside article and main that is dropped by the rules or whose
text is links for the most part, is also hashed by its place and form alone (tags and class
names, rows of like children as one) and counted likewise; frames that recur over a share
of the host's pages are deleted, unless one holds most of its page's text.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("head nav footer header aside form script style noscript template svg math iframe object button select option textarea title canvas video audio dialog menu input fieldset".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head caption".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure figcaption".split())
#: Of CONTENT, those that hold a whole list, table or figure.
GROUPS = frozenset("ul ol dl table figure".split())
#: Kinds of subtrees: outside CONTENT or outside the roots; whole groups; other content; frames, by form.
FREE, GROUP, SINGLE, FRAME = range(4)
ROOTS = frozenset("html body article main".split())
CELLS = frozenset(("td", "th"))
#: Class and id names of what is never article text; words that are also topics or layouts only as the sole name.
NAMES = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo cookie popup modal overlay newsletter subscribe sidebar widget widgets navbar nav navigation breadcrumb breadcrumbs footer masthead comment comments respond disqus recommended pagination pager toolbar main-menu main-nav main-navigation nav-menu post-navigation posts-navigation page-navigation entry-comments ad-container ad-wrapper disqus-thread".split())
SOLE = frozenset("advertising alert consent cookies gdpr header login menu notice notices promotion related search share sharing social subscription".split())
#: Known combinations: a subject and a part of a page (cookie-notice), or a place and a part (site-header).
_SUBJECT = "ads?|adv|adverts?|advertisement|advertising|banner|sponsor|sponsored|promo|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|sidebar|widgets?|nav|breadcrumbs?|footer|comments?|disqus|share|sharing|social|related|recommended|login|search"
_COMBINED = re.compile(rf"(?:{_SUBJECT})(?:-(?:{_SUBJECT}|media))?-(?:box|bar|banner|block|list|links?|buttons?|icons|form|section|area|unit|slot|notice|popup|modal|overlay|message|posts|articles|stories|menu|nav|navigation|signup|sidebar|widgets?|share|sharing|consent|respond)|(?:site|global|top|bottom|left|right|primary|secondary)-(?:header|footer|nav|navbar|navigation|menu|sidebar|banner|ads?|toolbar)")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'<>]+)")
_ENDS_P = BLOCKS - CELLS
#: A new element of the first kind ends an open one of the second, up to the container.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Element:
    __slots__ = ("chars", "dropped", "form", "in_root", "links", "parts", "roots", "start", "tag", "undo")

    def __init__(self, tag, dropped, in_root, start, roots, names):
        self.tag, self.dropped, self.in_root, self.start, self.roots, self.parts = tag, dropped, in_root, start, roots, []
        self.form = [f"{tag}.{names}"]  # tag and class names, then the children's forms
        self.chars = self.links = 0  # of its text, and of that in links
        self.undo = None  # state at the start, if the name says that this is no article text


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): next((x for x in m.groups()[1:4] if x is not None), "") for m in _ATTR.finditer(text)}


def _dropped(tag: str, attrs: str, in_root: bool) -> bool:
    if tag in DROPPED:
        return not (tag == "header" and in_root)
    if "=" not in attrs and "hidden" not in attrs:
        return False
    a = _attributes(attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return tag not in ROOTS
    return a.get("role", "").lower() in ROLES


def _named(tag: str, attrs: str, in_root: bool) -> bool:
    """Whether a class or the id is a whole name of what is never article text."""
    if "=" not in attrs or tag in ROOTS:
        return False
    a = _attributes(attrs)
    for value in (a.get("class", ""), a.get("id", "")):
        names = [re.sub(r"[-_]+", "-", x) for x in value.lower().split()]
        for x in names:
            if x in ("header", "masthead") and in_root:
                continue
            if x in NAMES or x in SOLE and len(names) == 1 or _COMBINED.fullmatch(x):
                return True
    return False


class Page:
    """Blocks of a page's text, ranges of its roots, and its deletable subtrees."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.articles: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        self._doubtful: list[tuple[int, int]] = []  # articles inside an element dropped by its name
        self.subtrees: list[tuple[int, int, int, int]] = []  # hash, kind, first block, end
        self._stack: list[_Element] = []
        self._text: list[str] = []
        self._parse(source)
        if not self.articles and not self.mains:
            self.articles = self._doubtful
        if self.articles or self.mains:  # subtrees outside cannot reach the main text
            roots = self.articles or self.mains
            inside = [s for s in self.subtrees if s[1] != FRAME and any(a <= s[2] and s[3] <= b for a, b in roots)]
            self.subtrees = inside + [(d, kind, 0, 0) for d, kind, _, _ in self.subtrees if kind == FRAME]

    def _flush(self) -> None:
        if self._text:
            block = " ".join("".join(self._text).split())
            self._text.clear()
            if block:
                self.blocks.append(block)

    def _roots(self) -> int:
        return len(self.articles) + len(self.mains) + len(self._doubtful)

    def _named_end(self, e: _Element) -> bool:
        """Take back all that is inside e, unless it holds a root; the articles it holds count if the page has no other root."""
        blocks, text, subtrees, articles, mains = e.undo
        if len(self.mains) == mains:
            self._doubtful += self.articles[articles:]
            del self.articles[articles:]
            if self._roots() == e.roots:
                del self.blocks[blocks:], self.subtrees[subtrees:]
                self._text = text
                return True
        return False

    def _close(self) -> None:
        e = self._stack.pop()
        above = self._stack[-1] if self._stack else None
        form = f"{_signed(xxhash.xxh64_intdigest(' '.join(e.form))):x}"
        if above is not None and above.form[-1] != form:
            above.form.append(form)
        if e.undo and self._named_end(e):
            self._frame(e, above, form)
            return
        block = e.tag in BLOCKS
        if block and not e.dropped:
            self._flush() if e.tag not in CELLS else self._text.append(" ")
        if above is not None:
            above.chars += e.chars
            above.links += e.chars if e.tag == "a" else e.links
        if e.dropped or 2 * e.links >= e.chars > 0:
            self._frame(e, above, form)
        if e.dropped:
            return
        digest = xxhash.xxh64_intdigest(f"{e.tag}\0{'\0'.join(e.parts)}")
        if above is not None:
            above.parts.append(f"{digest:x}")
        if not block:
            return
        end = len(self.blocks)
        if e.tag == "article" and not (above and above.in_root == "article"):
            self.articles.append((e.start, end))
        elif e.tag == "main":
            self.mains.append((e.start, end))
        elif end > e.start and e.tag not in ROOTS and e.tag not in CELLS and self._roots() == e.roots:
            kind = FREE if not e.in_root or e.tag not in CONTENT else GROUP if e.tag in GROUPS else SINGLE
            self.subtrees.append((_signed(digest), kind, e.start, end))

    def _frame(self, e: _Element, above: _Element | None, form: str) -> None:
        """Note a container or list outside the roots, without one, by its place and form; of dropped ones the outermost."""
        if e.tag in BLOCKS and (e.tag not in CONTENT or e.tag in GROUPS) and e.tag not in ROOTS and e.tag != "head" and not e.in_root and self._roots() == e.roots and not (above and above.dropped):
            place = "/".join(x.tag for x in self._stack)
            self.subtrees.append((_signed(xxhash.xxh64_intdigest(f"{place} {form}")), FRAME, e.start, max(e.start, len(self.blocks))))

    def _open(self, tag: str, attrs: str) -> None:
        stack = self._stack
        if tag in _ENDS_P:
            self._end_until({"p"}, {"td", "th", "button", "table", "div", "section", "article", "main", "body", "blockquote", "li"} - {tag} if tag != "p" else {"td", "th", "table", "button"}, stop_at_block=tag != "p")
        if tag in _SIBLINGS:
            self._end_until(*_SIBLINGS[tag])
        above = stack[-1] if stack else None
        in_root = (above.in_root if above else "") or ""
        dropped = bool(above and above.dropped) or _dropped(tag, attrs, bool(in_root))
        if tag in ("article", "main") and not dropped:
            in_root = "article" if tag == "article" or in_root == "article" else "main"
        if tag in BLOCKS and not (above and above.dropped):
            self._flush() if tag not in CELLS else self._text.append(" ")
        if tag in VOID:
            if tag == "br" and not dropped:
                self._text.append(" ")
            return
        names = " ".join(_attributes(attrs).get("class", "").lower().split()) if "class" in attrs else ""
        e = _Element(tag, dropped, in_root, len(self.blocks), self._roots(), names)
        if not dropped and _named(tag, attrs, bool(in_root)):
            e.undo = len(self.blocks), self._text.copy(), len(self.subtrees), len(self.articles), len(self.mains)
        stack.append(e)

    def _end_until(self, tags, barriers, stop_at_block: bool = False) -> None:
        """Close the nearest open element of tags, and all inside it, if no barrier is nearer."""
        for k in range(len(self._stack) - 1, -1, -1):
            tag = self._stack[k].tag
            if tag in tags:
                while len(self._stack) > k:
                    self._close()
                return
            if tag in barriers or stop_at_block and tag in BLOCKS:
                return

    def _data(self, text: str) -> None:
        top = self._stack[-1] if self._stack else None
        if top is not None and top.dropped:
            return
        if "&" in text:
            text = entities.unescape(text)
        self._text.append(text)
        if top is not None:
            part = " ".join(text.split())
            top.parts.append(part)
            top.chars += len(part)

    def _parse(self, source: str) -> None:
        at, find = 0, _TOKEN.search
        while m := find(source, at):
            if m.start() > at:
                self._data(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._data(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if not m[1]:
                self._open(tag, m[3])
                if tag in RAW and not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    stop = end.start() if end else len(source)
                    if stop > at:
                        self._data(source[at:stop])
                    at = stop
            elif tag in VOID or tag == "br":
                self._text.append(" ")
            elif any(e.tag == tag for e in self._stack):
                # a stray inline end tag does not close blocks
                inline = tag not in BLOCKS
                for k in range(len(self._stack) - 1, -1, -1):
                    if self._stack[k].tag == tag:
                        while len(self._stack) > k:
                            self._close()
                        break
                    if inline and self._stack[k].tag in BLOCKS:
                        break
        if at < len(source):
            self._data(source[at:])
        while self._stack:
            self._close()
        self._flush()

    def _kept(self) -> list[int]:
        roots = self.articles or self.mains or [(0, len(self.blocks))]
        return sorted({i for a, b in roots for i in range(a, b)})

    def main_text(self) -> str:
        """The text with all its subtrees."""
        return "\n\n".join(self.blocks[i] for i in self._kept())

    def rooted(self) -> tuple[list[str], list[tuple[int, int, int, int]]]:
        """Blocks of the roots, and the subtrees by their places among these."""
        kept = self._kept()
        place = {i: k for k, i in enumerate(kept)}
        return [self.blocks[i] for i in kept], [(d, kind, place[a], place[b - 1] + 1) if a < b else (d, kind, 0, 0) for d, kind, a, b in self.subtrees]


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def host(url: str | None) -> str:
    """Lower-case host of a URL without scheme, user, port; empty if there is none."""
    if not url:
        return ""
    rest = url.split("//", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].split(":", 1)[0].lower()


RESULT = "page_id long, url string, text string, n_chars long"
PARSED = "page_id long, url string, page_key long, host string, main long, blocks array<string>, subtrees array<struct<subtree:long,kind:int,a:int,b:int>>"
_SUBTREE = pa.struct([("subtree", pa.int64()), ("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
_RESULT_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64()]
_PARSED_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(_SUBTREE)]


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def parse_pages(rows: DataFrame) -> DataFrame:
    """Every page parsed once, as PARSED: blocks and subtrees of its roots; main is null if there is no text."""

    def run(batches):
        for batch in batches:
            out = []
            for page_id, url, source, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(source or "")
                covered = {i for _, kind, a, b in page.subtrees if kind == FREE for i in range(a, b)}
                rest = "\n".join(x for i, x in enumerate(page.blocks) if i not in covered) or page.main_text()
                blocks, subtrees = page.rooted()
                main = xxhash.xxh64_intdigest(rest) >> 1 if blocks else None
                out.append((page_id, url, key, host(url), main, blocks, [{"subtree": d, "kind": kind, "a": a, "b": b} for d, kind, a, b in subtrees]))
            yield _batch(out, PARSED, _PARSED_KINDS)

    return rows.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html")).mapInArrow(run, PARSED)


def cleaned_blocks(blocks: list[str], subtrees: list[dict], templates: list[dict] | None) -> list[str]:
    """The blocks without those of templates; a frame that makes up most of the page stays, and content that makes up most of the rest."""
    if not templates:
        return blocks
    found = {(t["subtree"], t["kind"]) for t in templates}
    doomed = [x for x in subtrees if (x["subtree"], x["kind"]) in found]
    half = sum(map(len, blocks)) / 2
    free = {i for x in doomed if x["kind"] == FREE or x["kind"] == FRAME and sum(map(len, blocks[x["a"] : x["b"]])) <= half for i in range(x["a"], x["b"])}
    content = {i for x in doomed if x["kind"] in (GROUP, SINGLE) for i in range(x["a"], x["b"])} - free
    chars = sum(len(x) for i, x in enumerate(blocks) if i not in free)
    if 2 * sum(len(blocks[i]) for i in content) <= chars:
        free |= content
    return [x for i, x in enumerate(blocks) if i not in free]


def extract_main_text(pages: DataFrame, min_pages: int = 5, single_pages: int = 20, share: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    A subtree is a template if it recurs on ``min_pages`` pages or more of its host whose
    main texts differ; copies of one page count once.  Inside an article or main, a whole
    list, table or figure must also be on ``share`` of the host's pages, and a paragraph,
    heading, list item or the like on ``single_pages`` pages besides; a page whose text is
    mostly such templates keeps them.  Frames, told by their form, must also be on ``share``
    of the host's pages.  A null or empty html gives an empty
    text.  A null url is a host of its own.  Unclosed and stray tags are repaired as far
    as block structure needs; text outside any element counts as body text.  Repeated rows
    all come back; extra columns are not read; an empty table gives an empty result.

    Pages are parsed once and held in the shared folder; templates, and the pages whose text
    holds some, are held likewise, so that both are sent to the pages while they are few.
    """
    parsed = materialize(parse_pages(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))))
    templates = page_templates(parsed, min_pages, single_pages, share)
    # of pages, only those where a template holds text have to meet it
    with_text = F.filter("subtrees", lambda s: s["a"] < s["b"])
    listed = parsed.where("main is not null").select("page_key", "host", F.explode(with_text).alias("s")).select("page_key", "host", "s.subtree", "s.kind")
    doomed = materialize(listed.join(templates, ["host", "subtree", "kind"]).groupBy("page_key").agg(F.collect_set(F.struct("subtree", "kind")).alias("templates")))

    def cleaned(batches):
        for batch in batches:
            out = []
            for page_id, url, *page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = "\n\n".join(cleaned_blocks(*page))
                out.append((page_id, url, text, len(text)))
            yield _batch(out, RESULT, _RESULT_KINDS)

    held = parsed.join(doomed, "page_key", "left").select("page_id", "url", "blocks", "subtrees", "templates")
    return held.mapInArrow(cleaned, RESULT)


def page_templates(parsed: DataFrame, min_pages: int, single_pages: int, share: float) -> DataFrame:
    """(host, subtree, kind, n) of the subtrees that recur on a host's pages of different main text, held in the shared folder."""
    listed = parsed.where("main is not null").select("host", "main", F.explode("subtrees").alias("s")).select("host", "main", "s.subtree", "s.kind")
    keys = ["host", "subtree", "kind"]
    counted = listed.select(*keys, "main").distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    often = counted.where(F.col("n") >= F.when(F.col("kind") == SINGLE, max(single_pages, min_pages)).otherwise(min_pages))
    hosts = parsed.where("main is not null").select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("mains"))
    return materialize(often.join(hosts, "host").where((F.col("kind") == FREE) | (F.col("n") >= share * F.col("mains"))).select(*keys, "n"))
