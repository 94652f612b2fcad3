"""Main text of web pages by differencing each page with its nearest pages by URL.

A page becomes text lines (one a block) with the part of the page each stands in. Pages are put
in order of host and URL path. Adjacent pages of a host with all the same lines are copies, which tell
nothing about each other, and make one entry. Each entry is aligned with the entry of its host on either side by
the longest common subsequence of lines, and the shared lines are deleted. Entries are cut into
runs of NEIGHBOURS, and a run gets the last entry before and the first after it too.

What the alignment may delete are lines whose part of the page is unknown. Lines of menus, headers,
footers, sidebars, notices, adverts, forms and comments, which pages mark by elements, roles, class names (also of
paragraphs, list items and stretches of a line) or as hidden, go in any case; lines in an `article` or `main` element stay, as articles
of one host may share passages (licences, repeated paragraphs, whole articles). A form round an article, or round all of a
page, isn't one to be dropped.

Null or empty html has empty text. Pages without a URL are one host. Equal rows give equal rows. Very long pages are read whole, one at a
time; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import html
import math
import os
import re
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import cut, map_text, running_total, table

NEIGHBOURS = 16
CHROME, UNKNOWN, MAIN, FORM = 0, 1, 2, 3

# Element names of HTML by how they bear on text.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_DROPPED = {"nav", "footer", "aside", "form", "dialog", "template", "noscript", "svg", "button", "select", "object", "menu", "math", "canvas", "video", "audio", "datalist"}
_MAIN = {"article", "main"}
_CONTAINERS = _DROPPED | _MAIN | {"header", "div", "section", "ul", "ol", "dl", "table", "td", "figure", "fieldset", "details", "body", "head"}
_BLOCKS = _CONTAINERS | {"p", "li", "dt", "dd", "tr", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "pre", "blockquote", "address", "figcaption", "caption", "summary", "html", "tbody", "thead", "tfoot", "legend", "center", "option"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: Elements whose end may be left out, with those that end them as they begin.
_ENDED = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "th": {"th", "td", "tr"}, "option": {"option"}}
#: Other elements that a class name may mark; any element may be hidden.
_MARKABLE = {"p", "li", "dt", "dd", "tr", "th", "span", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "address", "figcaption", "caption", "small", "ins", "label"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Words of class names and ids that mark what isn't the article.
_MARKS = {
    *"ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr".split(),
    *"newsletter subscribe signup sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar".split(),
    *"comment comments commentlist disqus reply replies respond sharing social popup modal overlay widget widgets".split(),
    *"login pagination pager disclaimer".split(),
}
#: Words that mark it too, where a name has no words beside them but marks and those of layout (related-posts, not related-work).
_WEAK_MARKS = set("related recommended share search skip hidden notice notices alert banner".split())
_LAYOUT = set("box bar list lists item items link links post posts article articles story stories section block area wrap wrapper container inner outer site page top bottom left right content text message msg form button buttons unit slot zone panel group row col main to the js u".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: What stands between the values of attributes, a value without quotes, and white space.
_BARE, _VALUE, _SPACE = re.compile(r"[^>=]*+"), re.compile(r"[^\s>]*+"), re.compile(r"\s*+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _marks(names: str) -> bool:
    """Whether one of the names in a class or id attribute marks what isn't the article."""
    for name in names.split():
        words = {w for w in _SPLIT.split(_CAMEL.sub(r"\1-\2", name).lower()) if w and not w.isdigit()}
        if words & _MARKS or words & _WEAK_MARKS and words <= _WEAK_MARKS | _LAYOUT:
            return True
    return False


def _marked(name: str, attributes: str, inside_main: bool) -> bool:
    if name in _DROPPED or name == "header" and not inside_main:
        return True
    by_name = name in _CONTAINERS and name not in ("body", "html", "article", "main") or name in _MARKABLE
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key == "role" and value.lower() in _ROLES or key in ("class", "id") and by_name and _marks(value):
            return True
    return False


class Tags:
    """The tags of a page, one after the other, in time that grows with its length: what isn't found once isn't looked for again.

    Quotes count where a value begins only; within a value without quotes they are part of it, and one that isn't closed on the page ends at the next >.
    A comment that isn't closed goes to the end. A < that begins no tag, or has no > after it, is text."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), {'"', "'"}

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Begin, end, "/" of an end tag, lower-case name (empty: a comment or declaration) and attributes of the first tag from `at` on."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                return i, end + 3 if end >= 0 else len(page), "", "", ""
            if i > self.last:  # only a comment could begin here
                at = page.find("<!--", i)
                if at < 0:
                    return None
                continue
            if page[i + 1] in "!?":
                return i, page.index(">", i) + 1, "", "", ""
            m = _NAME.match(page, i + 1)
            if not m:
                at = i + 1
                continue
            end = self._end(m.end())
            if end >= 0:
                return i, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at = i + 1
        return None

    def _end(self, at: int) -> int:
        """Where the > of the tag stands whose name ends at `at`."""
        page, begin = self.page, at
        while self.quotes:
            at = _BARE.match(page, at).end()
            if at == len(page):  # all > that follow are in quotes: from here on quotes don't count
                self.quotes = set()
                break
            if page[at] == ">":
                return at
            at = _SPACE.match(page, at + 1).end()
            quote = page[at : at + 1]
            if quote not in ('"', "'"):
                at = _VALUE.match(page, at).end()
                continue
            end = page.find(quote, at + 1) if quote in self.quotes else -1
            if end < 0:
                self.quotes.discard(quote)
                return page.find(">", at)
            at = end + 1
        return page.find(">", begin)


def lines(page: str) -> list[tuple[str, int]]:
    """(text, part) of each block of a page, in page order; texts have references decoded and white space made one space."""
    out: list[tuple[str, int]] = []
    # Open containers and marked elements: name, whether it is dropped, whether it is main; how many have each name; and open forms that are dropped.
    stack: list[list] = []
    named: dict[str, int] = {}
    open_forms: list[list] = []
    # How many open elements are dropped, are main, and are dropped stretches of a line.
    dropped = main = mute = 0
    held: list[str] = []
    at, size, tags = 0, len(page), Tags(page)

    def close() -> None:
        if held:
            t = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if t:
                out.append((t, CHROME if dropped else FORM if open_forms else MAIN if main else UNKNOWN))

    def pop() -> str:
        nonlocal dropped, main, mute
        name, gone, is_main = stack.pop()
        named[name] -= 1
        if gone:
            if name == "form":
                open_forms.pop()
            mute -= name not in _BLOCKS
            dropped -= name != "form" and name in _BLOCKS
        main -= is_main
        return name

    while at < size:
        tag = tags.next(at)
        if not tag:
            if not mute:
                held.append(page[at:])
            break
        begin, end, slash, name, attributes = tag
        if begin > at and not mute:
            held.append(page[at:begin])
        at = end
        if not name:
            continue
        if name in _BLOCKS:
            close()
        if slash:
            if named.get(name):
                while pop() != name:
                    pass
            continue
        while stack and name in _ENDED.get(stack[-1][0], ()):
            pop()
        if name in _RAW:
            ended = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = ended.end() if ended else size
        elif name not in _VOID and not attributes.endswith("/"):
            gone = bool(attributes or name in _CONTAINERS) and _marked(name, attributes, bool(main))
            if not gone and name not in _CONTAINERS:
                continue
            # A second main or article inside another is part of it.
            is_main = name in _MAIN or "role" in attributes and bool(re.search(r"\brole\s*=\s*[\"']?main\b", attributes))
            if is_main:  # forms round the article
                for form in open_forms:
                    form[1] = False
                open_forms.clear()
            stack.append([name, gone, is_main])
            named[name] = named.get(name, 0) + 1
            if gone:
                if name == "form":
                    open_forms.append(stack[-1])
                mute += name not in _BLOCKS
                dropped += name != "form" and name in _BLOCKS
            main += is_main
    close()
    parts = {part for _, part in out}
    if MAIN in parts:  # a page that marks its main part has nothing else of it
        return [(t, part if part == MAIN else CHROME) for t, part in out]
    if FORM in parts:
        form = CHROME if UNKNOWN in parts else UNKNOWN
        return [(t, form if part == FORM else part) for t, part in out]
    return out


def aligned(a: list, b: list) -> list[int]:
    """Positions of a in a longest common subsequence of a and b.

    A row of the table of lengths is one integer of a bit for each line of b (a zero where the length grows), so that a row is made by a few operations. Every
    so many rows one is kept, and those between are made again on the way back: the table's rows are never held together."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[begin : len(a) - end], b[begin : len(b) - end]
    keep = set(x) & set(y)
    xs, y = [i for i, v in enumerate(x) if v in keep], [v for v in y if v in keep]
    places: dict = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1

    def after(row: int, i: int) -> int:
        hit = row & places[x[xs[i]]]
        return (row + hit | row - hit) & full

    step, kept, row = max(1, math.isqrt(len(xs))), [], full
    for i in range(len(xs)):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    found, j = [], len(y)
    for part in range(len(kept) - 1, -1, -1):
        rows = [kept[part]]  # rows[r]: before line part * step + r
        for i in range(part * step, min(len(xs), (part + 1) * step)):
            rows.append(after(rows[-1], i))
        r = len(rows) - 1
        while r and j:
            if rows[r] >> (j - 1) & 1:
                j -= 1
            elif rows[r - 1] >> (j - 1) & 1:
                found.append(begin + xs[part * step + r - 1])
                r, j = r - 1, j - 1
            else:
                r -= 1
    return [*range(begin), *reversed(found), *range(len(a) - end, len(a))]


def _place(url: object) -> list:
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|[?#].*$", ""), F.lit(""))
    return [host, path]


def _mark(pages: DataFrame) -> Column:
    """128 bits of a digest of a row's page_id, url and html: equal rows have equal results."""
    parts = [F.col(c).cast("string") for c in ("page_id", "url", "html")]
    sized = [F.concat_ws("", F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.substring(F.unhex(F.sha2(F.concat(*sized).cast("binary"), 256)), 1, 16)


def outlines(pages: DataFrame) -> DataFrame:
    """mark (of the row), host, path, same (a digest of host and lines) and digests of the lines of unknown part, for pages that have such lines.

    Digests are of 128 bits and keyed by bytes drawn for this run, so that no lines can be made to collide."""
    key = os.urandom(16)

    def digest(of: bytes) -> bytes:
        return blake2b(of, digest_size=16, key=key).digest()

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        listed, same, keep = [], [], []
        for host, t in zip(slab.column(1).to_pylist(), slab.column(3).to_pylist()):
            own = [digest(x.encode("utf-8", "surrogatepass")) for x, part in lines(t or "") if part == UNKNOWN]
            keep.append(bool(own))
            listed.append(own or None)
            same.append(digest(b"".join([*own, (host or "").encode()])))
        batch = pa.RecordBatch.from_arrays([*slab.columns[:3], pa.array(same, pa.binary()), pa.array(listed, pa.list_(pa.binary()))], names=["mark", "host", "path", "same", "lines"])
        return batch.filter(pa.array(keep))

    host, path = _place(F.col("url"))
    rows = pages.select(_mark(pages).alias("mark"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("text"))
    return map_text(rows, run, "mark binary, host string, path string, same binary, lines array<binary>")


def entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mark, entry) of each page with lines of unknown part, and (entry, host, lines): an entry stands for adjacent pages
    of a host with the same lines, and entries are numbered in order of host and path."""
    ranked = cut(running_total(outlines(pages).dropDuplicates(["mark"]).withColumn("__one", F.lit(1).cast("long")), [F.col("host"), F.col("path"), F.col("mark")], "__one", "rank"))
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("same").alias("__before"))
    is_first = F.coalesce(F.col("same") != F.col("__before"), F.lit(True))
    marked = ranked.join(before, "rank", "left").withColumn("first", is_first.cast("long"))
    rows = marked.select("rank", "mark", "host", F.when(F.col("first") == 1, F.col("lines")).alias("lines"), "first")
    numbered = cut(running_total(rows, [F.col("rank")], "first").withColumn("entry", F.col("before") + F.col("first") - 1))
    return numbered.select("mark", "entry"), numbered.where("first = 1").select("entry", "host", "lines")


def shared_lines(pages: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """mark and the numbers, among its lines of unknown part, of those that each page shares with its nearest pages.

    A run holds a fixed number of entries, whatever the sizes of hosts are, besides the last one before and the first one after it."""
    marks, every = entries(pages)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("entry")
        rows = [(h, list(x)) for h, x in zip(group["host"], group["lines"])]
        own = group["own"].tolist()
        out = []
        for i, (host, mine) in enumerate(rows):
            if own[i]:
                gone: set[int] = set()
                for j in (i - 1, i + 1):
                    if 0 <= j < len(rows) and rows[j][0] == host:
                        gone.update(aligned(mine, rows[j][1]))
                out.append(sorted(gone))
        return pd.DataFrame({"entry": group.loc[group["own"], "entry"].to_numpy(), "gone": pd.Series(out, dtype=object)})

    at = F.floor(F.col("entry") / neighbours)
    # An entry at the end of a run is the neighbour of the next run's first one, and the other way round.
    beside = F.array_distinct(F.array(*[F.floor((F.col("entry") + way) / neighbours) for way in (0, -1, 1)]))
    runs = every.withColumn("run", F.explode(beside)).withColumn("own", F.col("run") == at)
    gone = runs.groupBy("run").applyInPandas(run, "entry long, gone array<int>").where("size(gone) > 0")
    return marks.join(gone, "entry").groupBy("mark").agg(F.first("gone").alias("gone"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    gone = shared_lines(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _mark(pages).alias("__mark"))
    joined = rows.join(gone.withColumnRenamed("mark", "__of"), F.col("__mark") == F.col("__of"), "left").select("page_id", "url", F.col("html").alias("text"), "gone")

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for page, out in zip(slab.column(2).to_pylist(), slab.column(3).to_pylist()):
            kept, unknown, out = [], 0, set(out or ())
            for t, part in lines(page or ""):
                if part == MAIN or part == UNKNOWN and unknown not in out:
                    kept.append(t)
                unknown += part == UNKNOWN
            texts.append(" ".join(kept))
        return pa.RecordBatch.from_arrays([slab.column(0), slab.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_text(joined, run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


#: The same for pages whose main part is one `article` element, with the references that occur in them.
OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*)</article>', 1) AS t FROM pages
), b AS (SELECT page_id, url, regexp_replace(t, '<[^>]+>', ' ', 'g') AS t FROM a
), c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM b
), d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
