"""HTML main-text extraction with per-host wrappers.

A wrapper is a union-free regular expression over the elements and texts of a
host's pages, inferred by aligning their streams one after another
(``html_wrapper.py``): every page takes part. Pages of a host are aligned in
buckets dealt by a hash of their content, and partial wrappers are merged by
sixteen, level by level, so no task takes a host as a whole and the result
doesn't depend on partitions or on tasks that ran twice.

Extraction follows the wrapper. From the root it goes down to the element
that holds most of the host's slots, weighing article and main elements
higher; that element is the article. Its lines are the text, without what is
never article text by HTML's own meaning (menus, forms, footers, scripts, ...).
A part with a name goes by that name alone only outside articles, or where it
names comments, adverts or consent, or is clearly a bar, box or list of such
things (``named_chrome``). Texts that stay the same on at least SAME_ON
different pages are template and go where the article has no article or main
element around it; inside one only parts with a name go, if nearly all articles
of the host (SAME_ON_IN_ARTICLE at least) repeat them word for word.

A page is parsed once; its tokens are written, and wrappers are joined to
them: by a broadcast up to MOST_BYTES of them, otherwise by a join that
adaptive execution splits where a host is large. Nodes of a single page leave
a wrapper once it covers 32 pages, since the page knows them itself.

Defined results: null or empty html gives empty text; a null or odd url has
host ``""``; unclosed and stray tags are tolerated; every row gives one row;
without an article of its own a page gives the text of its body.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .html_tree import BLOCK, RAW, SPACE, Element, parse
from .html_wrapper import TEXT, Node, expression, merge, of_page, ordered, placed, pruned, read, same_on, stream, written

__all__ = ["expression", "extract", "infer", "main_text"]

MOST_BYTES = 32_000_000
#: Least share of an element's weighed letters that its part must hold to be the article; weight of an article or main element; least letters of a repeated article against the longest.
SHARE, WEIGHT, TEASER = 0.6, 6.0, 0.25
SAME_ON, SAME_ON_IN_ARTICLE = 4, 8
SEMANTIC = ("article", "main")
CONTAINER = set("#root html body div section article main center td tr tbody table".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Elements and roles that are never article text, by HTML's and ARIA's own meaning.
CHROME = set("nav footer form select input textarea menu dialog".split()) | RAW
#: Controls: words of theirs count within a sentence, not alone.
CONTROLS = set("button label legend".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
#: Words of names that say what is no article text, words that say nothing beside them, and more such words beside what names comments or adverts.
COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
ADVERTS = set("ad ads advert adverts advertisement advertisements advertising adsense promo promoted promotion sponsor sponsored sponsors".split())
CHROME_WORDS = COMMENTS | ADVERTS | set(
    "banner banners breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices"
    " pagination popup related share sharing sidebar sidebars social subscribe subscription toolbar widget widgets".split()
)
PLAIN_WORDS = set(
    "alert area articles bar block bottom box btn button buttons center col column container fixed form global group icons info inner item items law left link links list main"
    " outer page panel policy posts primary privacy right secondary section sign signup site slot sticky stories thread top unit up wrap wrapper".split()
)
WIDER_WORDS = set("article author body content count date entry google in inline meta mid native post reader readers text title user users visitor".split())
NAMED = set("div section ul ol dl table p span center details aside".split())
#: Inside an article a name counts only with one of these beside its chrome word, with two chrome words, or if it names comments, adverts or consent.
PARTS = set("articles bar box btn button buttons fixed form icons items links list posts signup site slot sticky stories unit".split())
CONSENT = set("cookie cookies consent gdpr".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


def named_chrome(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """A container with a class or id made up of chrome words and plain words only, such as ``ad``, ``cookie-notice`` or ``relatedPosts``, but not ``related-work``; inside an article not ``share``, ``newsletter`` or ``social-policy`` either, which can be its own sections."""
    if tag not in NAMED:
        return False
    for name in [*attrs.get("class", "").split(), *attrs.get("id", "").split()]:
        words = {w.lower() for w in WORDS.findall(name)}
        chrome = words & CHROME_WORDS
        plain = PLAIN_WORDS | WIDER_WORDS if words & (COMMENTS | ADVERTS) else PLAIN_WORDS
        if not chrome or not words <= CHROME_WORDS | plain:
            continue
        if not in_article or words & (COMMENTS | ADVERTS | CONSENT):
            return True
        if not words <= {"header"} | PLAIN_WORDS and not words & {"policy", "privacy"} and (len(chrome) > 1 or words & PARTS):
            return True
    return False


def only_links(e: Element) -> bool:
    """Whether at least four fifths of an element's letters are links."""
    links = letters = 0
    todo = [(c, e.tag == "a") for c in e.children]
    while todo:
        c, inside = todo.pop()
        if isinstance(c, str):
            n = len("".join(c.split()))
            letters += n
            links += n if inside else 0
        else:
            todo += [(x, inside or c.tag == "a") for x in c.children]
    return links >= 0.8 * letters


def is_chrome(e: Element) -> bool:
    a = e.attrs
    if e.tag in CHROME or (e.tag == "header" and not e.in_article) or (e.tag == "aside" and (not e.in_article or only_links(e))):
        return True
    return bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or named_chrome(e.tag, a, e.in_article))


def mark_of(e: Element) -> str:
    """What tells an element from its like: its tag, with its id or classes, numbers left out."""
    name = e.attrs.get("id") or e.attrs.get("class") or ""
    return DIGITS.sub("0", f"{e.tag}.{' '.join(name.split())}") if name.strip() else e.tag


class Page:
    """Tokens of a page in its order: (place of the parent, mark, number of the outermost article around it or 0, text of a line or null)."""

    def __init__(self, page: str | None):
        self.tokens: list[tuple[int, str, int, str | None]] = [(-1, "#root", 0, None)]
        if page:
            self._read(parse(page))

    def _read(self, root: Element) -> None:
        texts: list[tuple[str, bool]] = []  # with whether a control shows it
        here = (0, 0)
        articles = 0

        def close() -> None:
            line = SPACE.sub(" ", "".join(t for t, _ in texts)).strip()
            alone = all(control or not t.strip() for t, control in texts)
            texts.clear()
            if line and not alone:
                self.tokens.append((here[0], TEXT, here[1], line))

        todo: list = [(c, here, False) for c in reversed(root.children)]
        while todo:
            c, around, control = todo.pop()
            if c is None:  # the end of a block; text goes on in the one around it
                close()
                here = around
            elif isinstance(c, str):
                texts.append((html.unescape(c), control))
            elif is_chrome(c):
                if c.tag in BLOCK:
                    close()
            elif c.tag in BLOCK and c.tag not in CONTROLS:
                close()
                todo.append((None, around, control))
                articles += c.tag == "article" and not around[1]
                here = (len(self.tokens), around[1] or (articles if c.tag == "article" else 0))
                self.tokens.append((around[0], mark_of(c), here[1], None))
                todo.extend((x, here, control) for x in reversed(c.children))
            else:
                if c.tag == "br":
                    texts.append((" ", control))
                todo.extend((x, around, control or c.tag in CONTROLS) for x in reversed(c.children))
        close()

    def wrapper(self) -> tuple[Node, list[Node]]:
        return of_page(stream([(parent, mark, text) for parent, mark, _, text in self.tokens]))


def infer(pages: list[str]) -> Node:
    """The wrapper of a few pages of one host."""
    out: Node | None = None
    for p in pages:
        own = Page(p).wrapper()[0]
        out = own if out is None else merge(out, own)
    return out or Node("#root")


def main_text(page: str | None, wrapper: Node | None = None) -> str:
    return article_text(Page(page).tokens, wrapper)


def article_text(tokens: list[tuple[int, str, int, str | None]], wrapper: Node | None) -> str:
    """The article's lines by the wrapper of the page's host; what the wrapper doesn't have counts as on this page alone."""
    if not any(text for *_, text in tokens):
        return ""
    own, nodes = of_page(stream([(parent, mark, text) for parent, mark, _, text in tokens]))
    host = placed(own, wrapper)
    every = ordered(own)
    stats = {n: host.get(n, n) for n in every}
    tag = {n: n.mark.split(".")[0] for n in every}
    parent = {k: n for n in every for k in n.kids}

    weighed: dict[Node, float] = {}  # letters a page in slots below, those of articles counted WEIGHT times
    fixed: dict[Node, bool] = {}  # whether an element has text and all of it stays the same over many pages
    for n in reversed(every):
        s = stats[n]
        if n.mark == TEXT:
            weighed[n], fixed[n] = 0.0 if same_on(s, SAME_ON) else s.letters / s.pages, same_on(s, SAME_ON_IN_ARTICLE)
        else:
            weighed[n] = sum(weighed[k] for k in n.kids) * (WEIGHT if tag[n] in SEMANTIC else 1.0)
            fixed[n] = any(fixed[k] for k in n.kids) and all(fixed[k] or not weighed[k] for k in n.kids)

    at = own
    while True:
        inside = []
        for k in at.kids:  # members of a group stand where the group stands
            inside += k.kids if k.mark.startswith("(") else [k]
        inside = [n for n in inside if tag[n] in CONTAINER and (stats[n].times <= 1.5 * stats[n].pages or tag[n] == "article")]
        best = max(inside, key=lambda n: weighed[n], default=own)
        if best is own or not weighed[best] or weighed[best] < SHARE * weighed[at] / (WEIGHT if tag[at] in SEMANTIC else 1.0):
            break
        at = best

    around = at
    while tag[around] not in SEMANTIC and around in parent:
        around = parent[around]
    semantic = tag[around] in SEMANTIC
    within, gone, heading = {at}, set(), set()
    for n in ordered(at):
        for k in n.kids:
            within.add(k)
            if n in heading or tag[n] in HEADING:
                heading.add(k)
            s = stats[k]
            if semantic:  # only a part with a name that nearly all articles of the host repeat word for word
                template = tag[k] in NAMED - {"p", "span"} and "." in k.mark and fixed[k] and s.pages >= 0.9 * stats[at].pages
            else:
                template = k.mark == TEXT and k not in heading and same_on(s, SAME_ON)
            if n in gone or template:
                gone.add(k)
    lines = [(k, text) for (_, _, k, text), n in zip(tokens, nodes, strict=True) if text and n in within and n not in gone]
    if tag[at] == "article" and at.times > 1:
        letters: dict[int, int] = {}
        for k, line in lines:
            letters[k] = letters.get(k, 0) + len(line)
        lines = [(k, line) for k, line in lines if letters[k] >= TEASER * max(letters.values())]
    if not lines and at is own:  # nothing but template
        lines = [(k, text) for _, _, k, text in tokens if text]
    return "\n".join(line for _, line in lines)


PARSED = "page_id bigint, url string, host string, tokens array<struct<parent:int,mark:string,article:int,text:string>>"
TOKENS = pa.list_(pa.struct([("parent", pa.int32()), ("mark", pa.string()), ("article", pa.int32()), ("text", pa.string())]))
#: Pages handled at a time; pages whose streams a task aligns one after another; partial wrappers that are merged into one (a power of two).
PAGES, ALIGNED, MERGED = 64, 32, 16
#: Hosts of several pages whose sizes are broadcast; with more, the join is shuffled.
FEW_HOSTS = 200_000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), PAGES):
            part = batch.slice(at, PAGES)
            rows = [Page(h).tokens for h in part.column(3).to_pylist()]
            sizes = [0]
            for r in rows:
                sizes.append(sizes[-1] + len(r))
            fields = list(TOKENS.value_type)
            columns = zip(*(x for r in rows for x in r), strict=True)
            tokens = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), tokens], names=["page_id", "url", "host", "tokens"])


def _lists(column: pa.Array) -> Iterator[list[tuple]]:
    """The rows of a list-of-structs column as lists of tuples, field by field rather than struct by struct."""
    offsets = column.offsets.to_pylist()
    first = offsets[0]
    values = column.values.slice(first, offsets[-1] - first)  # of a slice, its own values only
    fields = [f.to_pylist() for f in values.flatten()]
    for begin, end in zip(offsets, offsets[1:], strict=False):
        yield list(zip(*(f[begin - first : end - first] for f in fields), strict=True))


def _aligned(of_pages: bool) -> Callable:
    """One wrapper for each run of rows of one (host, bucket), from pages (streams without texts) or partial wrappers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": [key[0]], "bucket": pa.array([key[1]], pa.int64()), "wrapper": [written(pruned(held))]})

        for batch in batches:
            values = _lists(batch.column(2)) if of_pages else iter(batch.column(2).to_pylist())
            for host, bucket, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                own = of_page(value)[0] if of_pages else read(value)
                if key == (host, bucket):
                    merge(held, own)
                else:
                    if key is not None:
                        yield out()
                    key, held = (host, bucket), own
        if key is not None:
            yield out()

    return run


@lru_cache(maxsize=64)
def _told(wrapper: str | None) -> Node | None:
    return read(wrapper) if wrapper else None


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), PAGES):
            part = batch.slice(at, PAGES)
            texts = [article_text(tokens, _told(wrapper)) for tokens, wrapper in zip(_lists(part.column(2)), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """PARSED, a row for each row of ``pages``, written."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    return settle(own.mapInArrow(_parse, PARSED))


def fit_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) over all pages of ``pages`` (see ``parsed``), for hosts of several pages.

    Pages are dealt to buckets by a hash of their content, about ALIGNED pages a bucket, and aligned in
    order of that hash; then MERGED neighbouring buckets are merged at a time, until each host has one. So the
    result depends neither on the partitions nor on a task that ran twice.
    """
    sizes = settle(pages.groupBy("host").agg(F.count("*").alias("n")).where("n > 1"))
    # buckets by host: a power of two
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / ALIGNED))).cast("int")
    # texts stay behind: alignment asks for their lengths and hashes alone
    stream_ = F.transform("tokens", lambda t: F.struct(t["parent"].alias("parent"), t["mark"].alias("mark"), F.coalesce(F.char_length(t["text"]), F.lit(0)).alias("letters"), F.shiftrightunsigned(F.xxhash64(t["text"]), 1).alias("h")))
    lean = pages.select("host", F.xxhash64("tokens", "page_id").alias("place"), stream_.alias("tokens"))
    hosts = sizes.select("host", bits.alias("bits"))
    if sizes.count() <= FEW_HOSTS:
        hosts = F.broadcast(hosts)
    dealt = lean.join(hosts, "host").select("host", F.expr("if(bits = 0, 0L, shiftrightunsigned(place, 64 - bits))").alias("bucket"), "tokens", "place")
    rows = dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "place").select("host", "bucket", "tokens")
    out = settle(rows.mapInArrow(_aligned(True), "host string, bucket bigint, wrapper string"))
    while (out.agg(F.max("bucket")).first()[0] or 0) > 0:
        near = out.select("host", F.expr(f"bucket div {MERGED}").alias("next"), "wrapper", "bucket").repartition("host", "next").sortWithinPartitions("host", "next", "bucket")
        out = settle(near.select("host", "next", "wrapper").mapInArrow(_aligned(False), "host string, bucket bigint, wrapper string"))
    return out.select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (the article's lines, joined by newlines), n_chars."""
    read_ = parsed(pages)
    wrappers = settle(fit_wrappers(read_))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64)).first()[0] or 0
    told = read_.join(F.broadcast(wrappers) if size <= MOST_BYTES else wrappers, "host", "left").select("page_id", "url", "tokens", "wrapper")
    return told.mapInArrow(_extract, "page_id bigint, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
