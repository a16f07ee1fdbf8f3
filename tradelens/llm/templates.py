"""Main text of web pages by template deduction from equivalence classes.

1. Each page becomes tokens: its block elements by their path in the tree (with their classes, digits
   left out), and its text lines by the path they stand at.
2. Over the pages of a host, the tokens with the same occurrence vector (how often in which page) form
   an equivalence class. The vectors are never gathered: a class is the xor of a hash of (page,
   count) over its pages, pre-aggregated on both sides of a shuffle, so a host with a third of all
   pages costs no task more than another; tokens with the same xor are then put together as one class.
   Pages with the same tokens are one page.
3. A class is judged as one: it is valid if its tokens occur a fixed number of times per page, in two
   pages at least. Of a class that does not nest as a whole, the tokens that do form the valid part.
   Valid classes are nested by the paths of their tokens: an element is part of the template if its
   parent is, a line if ``share`` of the pages that have its place have it. What lies below one
   template element and above the next is a slot.
4. Slots are judged by what all pages of the host have there: one whose text is links, most of which
   other pages have too, is a menu; a list of links of the page's own is not. Hosts with one page take
   the slots of the template over all hosts.
5. From each page the template's lines and menu slots are left out, then menus, headers, footers,
   sidebars, notices, adverts, forms and comments that the page itself marks (by element, role or
   whole class name), and where a page marks its article, what stands outside it. A class name of
   which only a part says so counts only where the template has the element on the host's pages,
   outside a marked article, and if the element does not hold most of the page.

A line of a marked article is never taken for template, however many pages have it. Tokens count by the
pages that have them, not by their share of a host, so a layout of few pages is found on a large host
as on a small one; a host's template grows with its layouts. Nulls: a
null html is an empty page; pages with a null or hostless url share one host, the empty one. Repeated
rows each get their text. Very long pages are read whole. Ties do not occur: no order decides. An
empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import stored

# The HTML standard's elements by kind, and names by which pages mark what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select option button canvas object audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ASIDE = frozenset("nav footer aside menu dialog search head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside rail widget widgets "
    "header masthead footer foot colophon copyright comment comments commentlist reviews disqus replies reply respond cookie cookies consent gdpr notice notices alert popup popover modal overlay toast paywall "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar skip hidden".split()
)
# What a class name may add to one of these without changing what it says.
NEUTRAL = frozenset(
    "site global main primary secondary top bottom left right container wrapper wrap box block section area list item items inner outer slot unit bar links link button buttons icon icons group panel "
    "row col column form posts articles media this mobile desktop sticky fixed user reader js google".split()
)
HEADS = frozenset("header masthead".split())
WHOLE_NAMES = frozenset("body html main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
CLOSES_PARAGRAPH = BLOCK - {"body", "html", "head"}
#: Elements that end an open one of their kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body td th".split())


#: What an element says of itself. PART: a class name of which only a part is known.
NOTHING, PART, NAME, WRAPPER, HEAD, SURE = range(6)


class Element:
    """An open tag with its place in the tree; ``path`` changes at block elements only."""

    __slots__ = ("tag", "up", "path", "says", "article", "has_article", "has_heading", "chars", "dropped", "_token")

    def __init__(self, tag: str, up: Element | None, path: str, says: int, article: bool):
        self.tag, self.up, self.path, self.says, self.article = tag, up, path, says, article
        self.has_article = self.has_heading = False
        self.chars, self.dropped, self._token = 0, None, None

    def above(self) -> Iterator[Element]:
        """The element and all that it stands in."""
        e = self
        while e:
            yield e
            e = e.up

    def token(self) -> int:
        if self._token is None:
            self._token = self.up.token() if self.up and self.up.path == self.path else token(self.path)
        return self._token


def attributes(source: str) -> dict[str, str]:
    out = {}
    for name, value in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), references.unescape(value.strip("\"'")))
    return out


def says(tag: str, attr: dict[str, str]) -> int:
    """Does the element mark itself as something beside the article, and how surely?"""
    if tag in ASIDE or attr.get("role", "").lower() in ROLES or "hidden" in attr or attr.get("aria-hidden") == "true":
        return SURE
    if "display:none" in attr.get("style", "").replace(" ", "").lower():
        return SURE
    if tag == "header":
        return HEAD
    if tag == "form":
        return WRAPPER
    found = NOTHING
    if tag not in WHOLE_NAMES:
        for key in ("class", "id"):
            for name in attr.get(key, "").split():
                parts = {x.lower() for x in NAME_PARTS.split(name) if x}
                if parts & NAMES:
                    whole = all(x in NAMES or x in NEUTRAL or not x.isalpha() for x in parts)
                    found = max(found, PART if not whole else HEAD if parts & HEADS else NAME)
    return found


def is_article(tag: str, attr: dict[str, str]) -> bool:
    return tag in ("article", "main") or attr.get("role", "").lower() in ("main", "article") or "articleBody" in attr.get("itemprop", "")


def parse(page: str) -> tuple[list[tuple[str, Element, int]], list[Element]]:
    """The text lines of a page with the block elements that hold them and how much of them is links; all block elements."""
    root = Element("", None, "", NOTHING, False)
    stack, blocks, elements = [root], [], []
    text: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if text:
            line = SPACE.sub(" ", references.unescape("".join(text))).strip()
            text.clear()
            if line:
                holder = next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag)
                blocks.append((line, holder, min(linked, len(line))))
                for e in holder.above():
                    e.chars += len(line)
        linked = 0

    def add(piece: str):
        nonlocal linked
        inline = []
        for e in reversed(stack):
            if e.tag in BLOCK or not e.tag:
                break
            inline.append(e)
        if not any(e.says >= NAME for e in inline):  # an advert inside a line
            text.append(piece)
            if any(e.tag == "a" for e in inline):
                linked += len(piece.strip())

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            add(page[at : lt if lt >= 0 else end])
            if lt < 0:
                break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        tag = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if not tag:
            add("<")
            at = lt + 1
            continue
        at = tag.end()
        closing, name = tag[1], tag[2].lower()
        if name in RAW:
            if not closing and not tag[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            text.append(" ")
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and name not in SCOPES:
                    break
            continue
        if name in CLOSES_PARAGRAPH and any(e.tag == "p" for e in stack):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        if name in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[name]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES - SIBLINGS[name] - {"div", "section"}:
                    break
        attr = attributes(tag[3]) if tag[3].strip(" /") else {}
        up = stack[-1]
        path = up.path
        if name in BLOCK:
            path += "/" + ".".join([name, *DIGITS.sub("", attr.get("class", "")).split()])
        one = Element(name, up, path, says(name, attr) if attr or name in ASIDE or name in ("header", "form") else NOTHING, is_article(name, attr))
        if name in BLOCK:
            elements.append(one)
        if one.article or name in HEADINGS:
            for e in one.above():
                e.has_article |= one.article
                e.has_heading |= name in HEADINGS
        if name not in VOID:
            stack.append(one)
    flush()
    return blocks, elements


def token(path: str, text: str = "") -> int:
    """A number for an element (no text) or a text line at its place."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{path}\n{text}") - (1 << 63)


#: The token of the page itself.
PAGE, TAG_KIND, LINE_KIND = 0, 1, 2


def page_tokens(page: str | None) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    """A number for what the page holds, and its tokens: (token, parent, count, characters, of these in links, of these in what the page marks as a menu, kind)."""
    blocks, elements = parse(page or "")
    rows: dict[int, list[int]] = {}
    for e in elements:
        if e.up:
            rows.setdefault(e.token(), [e.up.token(), 0, 0, 0, 0, TAG_KIND])[1] += 1
    for line, e, links in blocks:
        row = rows.setdefault(token(e.path, line), [e.token(), 0, 0, 0, 0, LINE_KIND])
        row[1] += 1
        sure = any(x.says == SURE for x in e.above())
        row[2] += len(line)
        row[3] += 0 if sure else links
        own = rows.get(e.token())
        if own:
            own[2] += len(line)
            own[3] += links
            own[4] += links if sure else 0
    found = sorted((t, *r) for t, r in rows.items())
    return token(repr(found)), [*found, (PAGE, PAGE, 1, 0, 0, 0, PAGE)]


class Template:
    """What one host's pages share."""

    def __init__(self, n_pages: int = 0, slots=(), menus=(), lines=()):
        self.n_pages, self.slots, self.menus, self.lines = n_pages, frozenset(slots), frozenset(menus), frozenset(lines)

    def slot(self, e: Element) -> int | None:
        """The template element below which ``e`` stands."""
        return next((x.token() for x in e.above() if x.token() in self.slots), None)


def nest(n_pages: int, tags: list[tuple[int, int, int, int, int, bool]], lines: list[int], menu_share: float) -> Template:
    """The template made of valid classes. ``tags``: (token, parent, characters, of these in links, of these on other pages too, is it in a valid class)."""
    valid = {t: up for t, up, *_, ok in tags if ok}
    root = token("")
    inside: dict[int, bool] = {root: True}

    def holds(t: int) -> bool:
        way = []
        while t not in inside and t in valid and t not in way:
            way.append(t)
            t = valid[t]
        answer = inside.get(t, False)
        inside.update(dict.fromkeys(way, answer))
        return answer

    slots = {t for t in valid if holds(t)}
    parents = {t: up for t, up, *_ in tags}
    held: dict[int, list[int]] = {}
    for t, _, chars, links, again, _ in tags:
        seen = set()
        while t not in slots and t in parents and t not in seen:
            seen.add(t)
            t = parents[t]
        if t in slots:
            own = held.setdefault(t, [0, 0, 0])
            own[0] += chars
            own[1] += links
            own[2] += again
    return Template(n_pages, slots, [t for t, (chars, links, again) in held.items() if chars and links >= menu_share * chars and again >= menu_share * links], lines)


def _judge(blocks, template: Template, few: bool) -> list[bool]:
    """Which lines belong to the main text, by what the page and the template's elements say."""
    total = sum(len(line) for line, e, _ in blocks if not any(x.says == SURE for x in e.above())) or 1

    def aside(e: Element, names: bool, up_to_article: bool) -> bool:
        in_article = False
        for x in e.above():
            marked = in_article or any(y.article for y in x.above())
            kept_head = x.says == HEAD and x.has_heading and marked
            if x.says == SURE or (names and x.says in (NAME, HEAD, WRAPPER) and not kept_head):
                return True
            if x.says == PART and not marked and not few and x.token() in template.slots and 2 * x.chars <= total and not x.has_article and not x.has_heading:
                return True
            if up_to_article and x.article and not any(y.article for y in (x.up.above() if x.up else ())):
                names = False  # what the article stands in may be named as it likes
        return False

    def verdicts(names: bool, up_to_article: bool) -> list[bool]:
        known: dict[int, bool] = {}
        return [known[id(e)] if id(e) in known else known.setdefault(id(e), not aside(e, names, up_to_article)) for _, e, _ in blocks]

    article = [any(x.article for x in e.above()) for _, e, _ in blocks]
    if any(article):
        for up_to in (False, True):
            stay = [a and v for a, v in zip(article, verdicts(True, up_to))]
            if any(stay):
                return stay
    stay = verdicts(True, False)
    if any(stay) or not blocks:
        return stay
    # all of the page is in what a name or a form makes an aside: the name is that of a wrapper
    return [v and 2 * max(x.chars for x in e.above() if x.says in (NAME, HEAD, WRAPPER)) > total if any(x.says in (NAME, HEAD, WRAPPER) for x in e.above()) else v for v, (_, e, _) in zip(verdicts(False, False), blocks)]


def extract(page: str | None, template: Template) -> tuple[str, int, int]:
    """The main text, the number of slots with text, and of lines left out by the template."""
    blocks, _ = parse(page or "")
    few = template.n_pages < 2
    stay = _judge(blocks, template, few)
    out, slots, dropped = [], set(), 0
    for (line, e, _), ok in zip(blocks, stay):
        in_article, slot = any(x.article for x in e.above()), template.slot(e)
        known = not in_article and token(e.path, line) in template.lines
        if known or (slot in template.menus and not in_article):
            dropped += 1
        elif ok:
            slots.add(slot)
            out.append(line)
    return "\n\n".join(out), len(slots), dropped


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


#: What a class holds of each of its tokens.
MEMBER = ["token", "parent", "kind", "chars", "links", "sure"]


def classes_of(tokens: DataFrame) -> DataFrame:
    """The equivalence classes: host, vector, support (pages), least and most per page, and members, the tokens of a host that have one occurrence vector.

    Lines of one page alone are in no class: they are no template, and nothing else is judged by them.
    """
    own = tokens.where((F.col("kind") != LINE_KIND) | (F.col("support") >= 2))
    return own.groupBy("host", "vector").agg(F.max("support").alias("support"), F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list(F.struct(*MEMBER)).alias("members"))


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """host, token, parent, kind, support (pages), vector, least and most per page, chars, links and sure links of every token.

    The vector names the class of the token; ``classes_of`` puts the tokens of a class together.
    """

    def work(parts: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["host", "page", "token", "parent", "n", "chars", "links", "sure", "kind"]
        for part in parts:
            rows: list[tuple] = []
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                page_hash, found = page_tokens(page)
                rows += [(host, page_hash, *x) for x in found]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

    schema = "host string, page long, token long, parent long, n long, chars long, links long, sure long, kind long"
    seen = pages.select(_host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string")).mapInArrow(work, schema)
    once = seen.groupBy("host", "token", "page").agg(*[F.max(c).alias(c) for c in ("parent", "n", "chars", "links", "sure", "kind")])
    sums = [F.max("parent").alias("parent"), F.max("kind").alias("kind"), F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("sure").alias("sure")]
    return once.groupBy("host", "token").agg(*sums)


def members(classes: DataFrame) -> DataFrame:
    """The tokens of the classes, each with the support, the counts and the verdict of its class.

    A class is ``valid`` if its tokens occur a fixed number of times per page, in two pages at least.
    """
    valid = (F.col("support") >= 2) & (F.col("least") == F.col("most"))
    return classes.select("host", "vector", "support", "least", "most", valid.alias("valid"), F.explode("members").alias("m")).select("host", "vector", "support", "least", "most", "valid", "m.*")


def _valid(kept: DataFrame, share: float) -> DataFrame:
    """Add ``ok``: does the token stay in its class, and is that valid? A line is measured against the place it stands at."""
    place = kept.where(F.col("kind") == TAG_KIND).select("host", F.col("token").alias("parent"), F.col("support").alias("_place"))
    joined = kept.join(place, ["host", "parent"], "left").withColumn("_of", F.when(F.col("kind") == LINE_KIND, F.coalesce("_place", "pages")).otherwise(F.col("pages")))
    line = (F.col("support") >= F.least(F.lit(3), F.col("pages"))) & (F.col("support") >= share * F.col("_of"))
    return joined.withColumn("ok", F.col("valid") & ((F.col("kind") == TAG_KIND) | line))


def templates(classes: DataFrame, share: float = 0.9, menu_share: float = 0.6, least_share: float = 0.01) -> DataFrame:
    """host, n_pages, slots, menus and lines of every host with two different pages, and of all hosts together (host null).

    ``classes`` (or the tokens to gather) must be stored. What one host's row holds grows with the elements that two pages or more
    share, so with the host's layouts and not with its pages. The template over all hosts, one row,
    has what ``share`` of them have; of what hangs from it, elements of ``least_share`` of the hosts tell menus.
    """
    tokens = members(classes if "members" in classes.columns else classes_of(classes))
    hosts = tokens.where(F.col("kind") == PAGE).select("host", F.col("support").alias("pages")).where("pages >= 2")
    common = tokens.where(F.col("kind") != PAGE).join(hosts, "host").where("support >= 2")
    own = _valid(common, share)
    again = common.where((F.col("kind") == LINE_KIND) & (F.col("links") > 0)).groupBy("host", F.col("parent").alias("token")).agg(F.sum("links").alias("again"))
    own = own.join(again, ["host", "token"], "left").withColumn("again", F.coalesce("again", F.lit(0)) + F.col("sure"))
    count = tokens.where(F.col("kind") == PAGE).agg(F.count("*").alias("pages"))
    over = tokens.where(F.col("kind") == TAG_KIND).groupBy("token").agg(F.max("parent").alias("parent"), F.count("*").alias("support"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("sure").alias("again"))
    n_hosts = count.first()["pages"]
    over = over.where(F.col("support") >= F.lit(least_share * n_hosts)).withColumn("ok", (F.col("support") >= 2) & (F.col("support") >= share * n_hosts) & (F.col("least") == F.col("most")))
    rows = own.select("host", "pages", "token", "parent", "chars", "links", "again", "ok", "kind").unionByName(over.select(F.lit(None).cast("string").alias("host"), F.lit(n_hosts).cast("long").alias("pages"), "token", "parent", "chars", "links", "again", "ok", F.lit(TAG_KIND).cast("long").alias("kind")))
    tag = F.when(F.col("kind") == TAG_KIND, F.struct("token", "parent", "chars", "links", "again", "ok"))
    gathered = rows.where((F.col("kind") == TAG_KIND) | F.col("ok")).groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(tag).alias("tags"), F.collect_list(F.when(F.col("kind") == LINE_KIND, F.col("token"))).alias("lines"))

    def work(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            host, pages, tags, lines = (part.column(c).to_pylist() for c in ("host", "pages", "tags", "lines"))
            made = [nest(n, [(t["token"], t["parent"], t["chars"], t["links"], t["again"], t["ok"]) for t in own], ls, menu_share) for n, own, ls in zip(pages, tags, lines)]
            longs = [pa.array([sorted(x) for x in column], pa.list_(pa.int64())) for column in ([m.slots for m in made], [m.menus for m in made], [m.lines for m in made])]
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(pages, pa.int64()), *longs], ["host", "n_pages", "slots", "menus", "lines"])

    return gathered.mapInArrow(work, "host string, n_pages long, slots array<long>, menus array<long>, lines array<long>")


def main_text(pages: DataFrame, **parameters) -> DataFrame:
    """page_id, url, text, n_chars, n_slots and n_template_blocks of every page."""
    known = stored(templates(stored(classes_of(equivalence_classes(pages)), "classes"), **parameters), "templates")
    every = known.where("host is null").first()  # one row, as long as a page has kinds of elements
    shared = (1, every["slots"], every["menus"], []) if every else (0, [], [], [])
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), _host(F.col("url").cast("string")).alias("host")).join(known.where("host is not null"), "host", "left")

    def work(parts: Iterator) -> Iterator:
        import pyarrow as pa

        over_all, of_host = Template(*shared), {}
        for part in parts:
            found = []
            for host, page, n, *lists in zip(part.column("host").to_pylist(), part.column("html"), part.column("n_pages").to_pylist(), part.column("slots"), part.column("menus"), part.column("lines")):
                if n is None:
                    own = over_all
                else:
                    if host not in of_host:
                        if len(of_host) >= 256:
                            of_host.clear()
                        of_host[host] = Template(n, *[x.as_py() for x in lists])
                    own = of_host[host]
                found.append(extract(page.as_py(), own))
            own = [pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *own], ["page_id", "url", "text", "n_chars", "n_slots", "n_template_blocks"])

    return given.mapInArrow(work, "page_id long, url string, text string, n_chars long, n_slots long, n_template_blocks long")
