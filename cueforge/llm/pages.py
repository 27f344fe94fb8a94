"""Main text of web pages, with site templates removed.

Every page becomes a tree in one pass; every container in its article (the largest article, else main, else the body)
that could be page furniture is hashed with all below it. The article is cut into blocks, and each block knows the hashes
of the containers around it. Spark counts the different pages of a host that have each hash, and blocks under a subtree
that recurs across many pages of their host go. What is furniture by its tag or role, or by one of the contract's own
words as a whole class or id of a plain container, goes without counting. An article inside an article is a reader's comment.

Paragraphs, headings, lists and their items, sections and figures of an article are never taken for templates, however
often they recur, nor is a container that holds half of its page's article or more. Pages of a host with the same
article are one page for the counts, so copies of a page make no template. Pages without a host (null or odd urls)
share no templates.

Null pages are empty and give an empty text. Broken markup never fails and costs time in proportion to its length: stray
brackets are text and open elements end with their parent. Repeated rows, and pages that share an id, each give their
row. An empty table gives no rows. Extra columns pass through; `text` and `n_chars` replace columns of the same name.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import stored

#: A subtree is a template if this many pages of a host have it, and this share of them. On hosts of over 100
#: pages the share is of 100 pages times the root of their hundreds, so it rises more slowly than the host.
TEMPLATE_PAGES = 5
TEMPLATE_PERCENT = 20

# HTML's element kinds, and names that page furniture goes by.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg object textarea title".split())
#: Of these an end tag that is missing is the end of the page.
TO_THE_END = {"script", "style", "textarea", "title"}
FURNITURE = set("nav footer aside form button select dialog menu head audio video canvas".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr table tbody thead".split())
KEPT = PROSE | set("ul ol dl section figure figcaption details summary caption tfoot".split())
CLOSES_P = BLOCKS - {"caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "summary", "figcaption"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = set("ad ads advert adverts advertisement comment comments footer header menu nav notice sidebar".split())
NAMED = set("article div ol section span ul".split())

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("article", "children", "digest", "gone", "parts", "size", "tag")

    def __init__(self, tag, gone=False, article=False):
        self.tag, self.gone, self.article = tag, gone, article
        self.children, self.parts, self.size, self.digest = [], [], 0, 0


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_article) or (tag == "article" and in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name in ("class", "id"):
            if tag in NAMED and not NAMES.isdisjoint(value.split()):
                return True
        elif name == "role":
            if value in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


class Tags:
    """(start, end, closing, name, attributes) of the page's tags and comments, in one pass; the caller may move `at` on."""

    def __init__(self, page: str):
        self.page, self.at, self.quotes, self.last = page, 0, True, page.rfind(">")

    def _end(self, at: int) -> int:
        """After the tag's bracket, outside quoted values; a quote that never closes is a character like others."""
        while self.quotes and (stop := _STOP.search(self.page, at)):
            if stop[0] == ">":
                return stop.end()
            at = max(self.page.find(stop[0], stop.end()) + 1, stop.end())
        # a bracket is left only inside quotes: from here on quotes mean nothing
        self.quotes = False
        return self.page.find(">", at) + 1

    def __iter__(self):
        page = self.page
        while self.at <= self.last and (found := _OPEN.search(page, self.at)):
            start = found.start()
            if found[2]:
                end = self._end(found.end())
                if not end:
                    end = page.find(">", found.end()) + 1
                if not end:
                    return
                self.at = end
                yield start, end, found[1], found[2].lower(), page[found.end() : end - 1]
            elif found[0] == "<!--":
                self.at = end = page.find("-->", found.end()) + 3
                if end == 2:
                    self.at = end = len(page)
                yield start, end, "", "", ""
            else:
                self.at = end = page.find(">", found.end()) + 1
                if not end:
                    return
                yield start, end, "", "", ""


def parse(page: str) -> Node:
    """The page's tree; every node has the digest of its subtree and the length of its text."""
    root = Node("")
    stack = [root]
    opened = Counter()

    def text(piece):
        if piece:
            top = stack[-1]
            top.children.append(piece)
            piece = " ".join(piece.split())
            top.parts.append(piece)
            top.size += len(piece)

    def close():
        node = stack.pop()
        opened[node.tag] -= 1
        node.digest = xxhash.xxh64_intdigest(node.tag + "\x01" + "\x02".join(node.parts)) - (1 << 63)
        above = stack[-1]
        above.parts.append(str(node.digest))
        above.size += node.size

    def close_open(names, stop):
        if not any(opened[n] for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                while len(stack) > depth:
                    close()
                return
            if stack[depth].tag in stop:
                return

    done = 0
    unclosed = set()
    tags = Tags(page)
    for start, end, closing, tag, attributes in tags:
        text(page[done:start])
        done = end
        if not tag:
            continue
        if closing:
            if opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in CLOSES_P:
            close_open({"p"}, BLOCKS - {"p"})
        if tag in CLOSED_BY:
            close_open(CLOSED_BY[tag], LISTS[tag])
        top = stack[-1]
        if tag in RAW:
            finish = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
            if finish or tag in TO_THE_END:
                tags.at = done = finish.end() if finish else len(page)
            else:
                unclosed.add(tag)
            continue
        node = Node(tag, _is_furniture(tag, attributes, top.article), top.article or tag == "article")
        top.children.append(node)
        if tag in VOID:
            top.parts.append(tag)
        elif not (attributes.endswith("/") and tag not in BLOCKS):
            stack.append(node)
            opened[tag] += 1
    text(page[done:])
    while len(stack) > 1:
        close()
    return root


def _main(root: Node) -> Node:
    """The largest outermost article that isn't furniture, else such a main, else the root."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.gone:
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return max(found, key=lambda n: n.size)
    return root


def article_blocks(page: str | None) -> tuple[int, list[tuple[str, list[int]]]]:
    """Digest of the page's article, and its blocks without furniture: text, and the digests of the containers around it that could be templates."""
    root = parse(page or "")
    main = _main(root)
    whole = main is root
    own = xxhash.xxh64_intdigest("\x02".join(main.parts)) - (1 << 63)
    blocks, now, under = [], [], []

    def end():
        line = " ".join(entities.unescape("".join(now)).split())
        if line:
            blocks.append((line, list(under)))
        now.clear()

    def could_be_template(node):
        return node is not main and node.size and node.tag not in ("html", "body", "article", "main") and (whole or node.tag not in KEPT) and 2 * node.size < main.size

    todo = [(True, main)]
    while todo:
        opens, node = todo.pop()
        if isinstance(node, str):
            now.append(node)
        elif not opens:
            end()
            if could_be_template(node):
                under.pop()
        elif node.tag == "br":
            now.append(" ")
        elif node.gone and node is not main:
            if node.tag in BLOCKS:
                end()
        else:
            if node.tag in BLOCKS or node is main:
                end()
                todo.append((False, node))
                if could_be_template(node):
                    under.append(node.digest)
            todo += [(True, c) for c in reversed(node.children)]
    return own, blocks


def main_text(page: str | None, templates: set[int] = frozenset()) -> str:
    """The blocks of the article that stand under no template."""
    return "\n".join(text for text, under in article_blocks(page)[1] if templates.isdisjoint(under))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def read_pages(pages: DataFrame, url: str, html: str, kept: list[str]) -> DataFrame:
    """The rows with `_host`, `_own` (digest of the article) and `_blocks`."""
    schema = pages.select(*kept).schema.simpleString()[7:-1]
    block = pa.struct([("text", pa.string()), ("under", pa.list_(pa.int64()))])

    def read(batches):
        for batch in W.slices(batches, html):
            found = [article_blocks(p) for p in batch.column(html).to_pylist()]
            blocks = [[{"text": t, "under": u} for t, u in b] for _, b in found]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in [*kept, "_host"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([own for own, _ in found], pa.int64()), pa.array(blocks, pa.list_(block))], names=[*kept, "_host", "_own", "_blocks"])

    needed = list(dict.fromkeys([*kept, html]))
    return pages.withColumn("_host", host_of(F.col(url))).select(*needed, "_host").mapInArrow(read, f"{schema}, _host string, _own bigint, _blocks array<struct<text:string,under:array<bigint>>>")


def templates(read: DataFrame, pages_least: int = TEMPLATE_PAGES, percent: int = TEMPLATE_PERCENT) -> DataFrame:
    """(_host, _digest): the subtrees that recur on many different pages of a host."""
    several = read.where("_host <> ''")
    of_host = several.groupBy("_host").agg(F.count_distinct("_own").alias("pages")).where(F.col("pages") >= pages_least)
    counts = several.select("_host", "_own", F.explode("_digests").alias("_digest")).groupBy("_host", "_digest").agg(F.count_distinct("_own").alias("k"))
    many = counts.where(F.col("k") >= pages_least).join(of_host, "_host")
    return many.where(100 * F.col("k") >= percent * F.least("pages", 10 * F.sqrt("pages"))).select("_host", "_digest")


def extracted(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", keep_html: bool = True) -> DataFrame:
    """The rows with `text` and `n_chars`; without the page itself where `keep_html` is off, which saves its way through the shuffle."""
    out = [c for c in pages.columns if c not in ("text", "n_chars") and (keep_html or c != html)]
    pages = pages.withColumn("_t", F.xxhash64(id_col, html, url))
    read = stored(read_pages(pages, url, html, [*out, "_t"]), "pages")
    # blocks under no container that could be a template need no counts
    read = read.withColumn("_digests", F.array_distinct(F.flatten("_blocks.under")))
    some, none = read.where(F.size("_digests") > 0), read.where(F.size("_digests") == 0).withColumn("_templates", F.array().cast("array<bigint>"))
    digests = some.select("_t", "_host", F.explode("_digests").alias("_digest"))
    gone = digests.join(templates(read), ["_host", "_digest"]).groupBy("_t").agg(F.collect_set("_digest").alias("_templates"))
    some = some.join(gone, "_t", "left").withColumn("_templates", F.coalesce("_templates", F.array().cast("array<bigint>")))
    left = F.filter("_blocks", lambda b: ~F.arrays_overlap(b["under"], "_templates"))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n")
    return none.unionByName(some).select(*out, text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages, keep_html=False).select("page_id", "url", "text", "n_chars")
