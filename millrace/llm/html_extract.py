"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks at block-level tags. Blocks inside menus, headers, footers, sidebars, notices, adverts,
forms and reader comments (by tag, role, or a word of class or id), and scripts, styles and markup, are not
text. If the page has an article or main element with text, blocks outside it are not either.

Pass 1 labels a block by itself: much of it in links is bad; long with a good share of stop words is
good, as is a long one of sentences whatever its language (stop words of a few languages cannot tell others, but prose has sentence
ends and lists of words have none); long with few of either is bad; other short blocks stay open. Inside an article a
long block that is not mostly links is never bad: without stop words or sentences it stays open.
Pass 2 gives each open block the label of its nearest decided neighbour, before or after it; a heading that of the next one, and
if both are as near and differ, or there is none, a heading or a block of an article is good, any other bad.

If no block of a page is decided, all of them are text.

A page's header goes, and so does an article's own, but for its headings (h1 to h6), which are the article's title.

White space in a block becomes one space, blocks are joined by two line feeds. Null and empty html give the empty text.
Every row gives one row, an empty table none; nothing is capped, texts of any length are read whole, repeated rows are rows, and
other columns of the table are not read, whatever their names. Broken markup is read as far as it goes: a tag that never
ends is text, a quote that never ends is no quote, an element that never ends lasts to the end of its parent (one of a list of choices to
the next block). A page is read once from its start to its end: time grows with its length, whatever is broken in it.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

LONG, LINKS, STOPS, SOME_STOPS = 70, 0.5, 0.15, 0.08
#: A block is of sentences if it has one at least for so many characters.
SENTENCE = 300
BLOCK = set("address article aside blockquote body dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
HOLDER = set("address article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol search section table ul".split())
RAW = set("script style noscript template textarea title svg iframe object select datalist button canvas math".split())
AWAY = set("nav header footer aside form menu dialog search fieldset select datalist option optgroup".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
WORDS_AWAY = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget widgets header masthead footer foot copyright share sharing social related recommended "
    "comment comments disqus respond reply replies toolbar pagination pager".split()
)
#: Frequent function words of six languages (fixed values).
STOP_WORDS = frozenset(
    "the of and to in is it that was for on with as by at from this be are or an a not which have has had he she they we you "
    "le la les de des du et un une est en que qui dans pour pas sur par au aux avec ce se il elle ne sont plus "
    "der die das und ist von zu den mit dem ein eine auf für nicht im des als auch es an er sie sich wird bei "
    "el los las y del que es con por para como más pero su al lo si no son una "
    "il di che non per con sono della nel "
    "o os e do da em um uma não com para mais".split()
)
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: What follows a tag's name up to its end; quotes count after an equals sign.
REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: One attribute after the other, so that nothing inside a name or value counts as one.
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
SENTENCE_END = re.compile(r"[.!?…]+[\"'”’»)]*(?=\s|$)|[。！？｡।॥።؟۔]")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A class that begins with one of these tells what the element goes with or without.
RELATED = set("no not without with has have is hide show".split())
#: Elements without content, and those that end where the next of their kind (or for p, any block) begins.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDED = {"p": BLOCK, "select": BLOCK, "datalist": BLOCK, "option": BLOCK | {"option", "optgroup"}, "optgroup": BLOCK | {"optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}


def away_word(token: str) -> bool:
    """Whether a class or id names what is not main text: one of WORDS_AWAY, or a compound that begins or ends with one."""
    parts = [x.lower() for x in PART.findall(token)]
    if not parts or parts[0] in RELATED:
        return False
    return parts[0] in WORDS_AWAY or parts[-1] in WORDS_AWAY


def is_away(tag: str, attributes: str) -> bool:
    """Whether an element holds anything but main text."""
    if tag in AWAY:
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    seen: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        seen.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    if "hidden" in seen or seen.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", seen.get("style", ""), re.I):
        return True
    if not ROLES.isdisjoint(seen.get("role", "").lower().split()):
        return True
    tokens = seen.get("class", "").split() + seen.get("id", "").split()
    if tag in ("article", "main"):
        # holders of main text: only a class that is such a word by itself
        return any(t.lower() in WORDS_AWAY for t in tokens)
    return any(map(away_word, tokens))


class Elements:
    """The open elements: holders, and those of others that hold no main text."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        #: How many are open of each name: of holders at all, of others since the last holder.
        self.holders: dict[str, int] = {}
        self.others: list[dict[str, int]] = [{}]
        self.away = self.title = self.article = 0

    def push(self, tag: str, gone: bool) -> None:
        title = gone and self.article > 0 and not self.away and tag not in AWAY - {"header"}
        # an article's own header: its headings stay
        title = title and tag in ("header", "div", "section", "hgroup")
        self.stack.append((tag, gone and not title, title))
        self.away += gone and not title
        self.title += title
        self.article += tag in ("article", "main")
        if tag in HOLDER:
            self.holders[tag] = self.holders.get(tag, 0) + 1
            self.others.append({})
        else:
            self.others[-1][tag] = self.others[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag, gone, title = self.stack.pop()
        self.away -= gone
        self.title -= title
        self.article -= tag in ("article", "main")
        if tag in HOLDER:
            self.holders[tag] -= 1
            self.others.pop()
        else:
            self.others[-1][tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        """An end tag: what is open since its element began ends too; no holder ends by another element's tag."""
        if (self.holders if tag in HOLDER else self.others[-1]).get(tag):
            while self.pop() != tag:
                pass


def tags(page: str):
    """start, end, whether it is an end tag, name (empty for comments and declarations) and attributes of each tag, up to where the caller says."""
    at, quoted = 0, True
    last = page.rfind(">")
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = len(page) if end < 0 else end + 3
            at = (yield i, end, False, "", "") or end
            continue
        if i > last:
            return
        name = NAME.match(page, i + 1)
        if name is None and page[i + 1 : i + 2] not in ("!", "?"):
            at = i + 1
            continue
        start = name.end() if name else i + 1
        rest = REST.match(page, start) if name and quoted else None
        if name and rest is None:
            # a quote is open to the end of the page: none counts from here on
            quoted = False
        end = rest.end() if rest else page.index(">", start) + 1
        at = (yield i, end, bool(name and name[1]), name[2].lower() if name else "", page[start : end - 1]) or end


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, is a heading, is in an article) of each block that may be text."""
    out: list[tuple[str, int, bool, bool]] = []
    open_ = Elements()
    links = breaks = linked = 0
    heading = False
    parts: list[str] = []

    def close() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, heading, open_.article > 0))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if open_.away or not raw or open_.title and not heading:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if not text.isspace():
            breaks = 0
            if links:
                linked += len(" ".join(text.split()))

    #: Raw elements whose end tags are all behind.
    ended: set[str] = set()
    scan = tags(page)
    at, found = 0, next(scan, None)
    while found:
        start, end, ends, tag, attributes = found
        add(page[at:start])
        at = end
        if tag in RAW:
            if not ends and not attributes.endswith("/"):
                stop = None if tag in ended else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                close_at = page.find(">", stop.end()) if stop else -1
                if close_at >= 0:
                    at = close_at + 1
                else:
                    ended.add(tag)
                    if tag in ("script", "style", "textarea", "title"):
                        at = len(page)
                    else:
                        open_.push(tag, True)
            elif ends:
                open_.end(tag)
        elif tag:
            if tag == "a":
                links = 0 if ends else 1
            elif tag == "br":
                breaks += 1
                add(" ")
                if breaks > 1:
                    close()
            if tag in BLOCK:
                close()
                links = breaks = 0
                heading = not ends and tag in HEADINGS
            if not ends:
                # elements whose end tag may be left out
                while open_.stack and tag in ENDED.get(open_.stack[-1][0], ()):
                    open_.pop()
            if ends:
                open_.end(tag)
            elif tag in HOLDER:
                open_.push(tag, is_away(tag, attributes))
            elif tag not in VOID and not attributes.endswith("/"):
                # of the others only those that go, and what bears the same name inside of them
                gone = is_away(tag, attributes)
                if gone or open_.others[-1].get(tag):
                    open_.push(tag, gone)
        try:
            found = scan.send(at)
        except StopIteration:
            found = None
    add(page[at:])
    close()
    return out


def labels(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Whether each block is main text."""
    if any(x[3] for x in found) and not all(x[3] for x in found):
        # what is outside the article goes, and labels nothing in it
        inside = iter(labels([x for x in found if x[3]]))
        return [x[3] and next(inside) for x in found]
    first: list[bool | None] = []
    for text, linked, _, inside in found:
        words = text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        if linked > LINKS * len(text):
            first.append(False)
        elif len(text) >= LONG:
            prose = stops >= STOPS or len(SENTENCE_END.findall(text)) * SENTENCE >= len(text)
            first.append(True if prose else None if inside or stops >= SOME_STOPS else False)
        else:
            first.append(None)
    if all(x is None for x in first):
        # a short page: nothing tells its blocks apart
        return [True] * len(first)
    n = len(first)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if first[i] is not None else last
        before[i] = last
    last = None
    for i in reversed(range(n)):
        last = i if first[i] is not None else last
        after[i] = last
    out = []
    for i, (label, block) in enumerate(zip(first, found)):
        if label is None:
            near = [(abs(i - j), first[j]) for j in (before[i], after[i]) if j is not None]
            least = min((d for d, _ in near), default=0)
            kinds = {x for d, x in near if d == least}
            if block[2] and after[i] is not None:
                kinds = {first[after[i]]}
            label = kinds.pop() if len(kinds) == 1 else block[2] or block[3]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    return "\n\n".join(b[0] for b, good in zip(found, labels(found)) if good)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return common.map_batches(picked, work, "page_id long, url string, text string, n_chars long", by="html")
