"""Main text of web pages by site template removal.

Every element's subtree is hashed (tags and text). Spark counts on how many pages of a
host, and of a section of it (the first part of the path), each hash occurs; subtrees that recur across many pages are
template and are deleted. Beyond that, elements whose tag, role or class says menu,
header, footer, sidebar, notice, advert, form or comments go, and an article or main
element, where there is one that stays, is all that is read. A form, or an element that goes
for its class only, stays if it holds most of the page (of its articles, where it has any), as a wrapper does; the
form's fields go all the same. Headings and paragraphs inside an article go
only if their class says advert or comments, or if it says any of the other things and they recur as well.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm.common import arrow_in_small_batches, cut, if_small, table

# Names of elements, roles and class words.
DROPPED = set("head title nav footer aside script style noscript template iframe svg canvas annotation annotation-xml button select textarea input dialog menu object embed audio video map".split())
RAW = set("script style noscript template iframe svg textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd semantics".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASS_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe signup social share sharing related recommended recommendations comment comments "
    "disqus respond reply replies widget toolbar pagination pager skip".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
# Of these, what takes a heading or paragraph out of an article, and what doesn't take other elements out of it.
ALWAYS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments disqus".split())
IN_ARTICLE = CLASS_WORDS - {"header", "masthead"}
# First parts of a class that deny what it says; last parts that say only what surrounds something.
DENIED = set("no not non with without has hide".split())
AROUND = set("area banner bar block blocks bottom box btn button buttons card cards container content feed form group head heading icons inner item items label left line link links list main note outer overlay panel post posts region right row section slot space strip text title top unit wrap wrapper zone".split())
# Where a button amid text is part of a sentence.
SENTENCES = set("p h1 h2 h3 h4 h5 h6 blockquote li dd td".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
STOP = re.compile(r">|=\s*+([\"'])")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
SPACE = re.compile(r"\s+")

#: A subtree is template if it is on PAGES pages of its host or section and on SHARE of them; outside articles MANY pages do.
PAGES, SHARE, MANY = 5, 0.2, 50
#: What a form, or an element that would go for its class, holds of the page's text if it is a wrapper.
WRAPS = 0.75


class Node:
    __slots__ = ("hash", "inside", "parts", "soft", "suspect", "tag", "unwanted")

    def __init__(self, tag: str, inside: bool, unwanted: bool = False, soft: bool = False, suspect: bool = False):
        self.tag, self.inside, self.unwanted, self.soft, self.suspect, self.parts, self.hash = tag, inside, unwanted, soft, suspect, [], 0

    @property
    def kept_prose(self) -> bool:
        return self.inside and self.tag in PROSE and not self.suspect


def _says(value: str, words: set[str], strict: bool) -> bool:
    """Whether a name in ``value`` has one of ``words`` as a part; if ``strict``, only where its last part is one or stands for what surrounds."""
    for name in value.split():
        parts = [x for x in re.split(r"[_-]+", name) if x]
        if parts and parts[0] not in DENIED and not words.isdisjoint(parts) and (not strict or parts[-1] in words or parts[-1] in AROUND or parts[-1].isdigit()):
            return True
    return False


def _judge(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """(unwanted, soft: stays as a wrapper, suspect: unwanted if it recurs) by tag and attributes."""
    if tag in DROPPED or tag == "header" and not inside:
        return True, False, False
    soft, suspect = tag == "form", False
    if not attributes or not attributes.strip(" /"):
        return soft, soft, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True, False, False
        if name == "role" and value.strip() in ROLES:
            if value.strip() not in ("form", "search"):
                return True, False, False
            soft = True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if tag in PROSE and inside:
                if ALWAYS & set(value.split()):
                    return True, False, False
                suspect |= _says(value, IN_ARTICLE, False)
            elif _says(value, IN_ARTICLE if inside else CLASS_WORDS, inside):
                if _says(value, ALWAYS, True):
                    return True, False, False
                soft = True
    return soft, soft, suspect


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """Where the ``>`` is that ends a tag whose name ends at ``at``: outside quoted values, or the first one if a value has no end.

    ``dead`` are quotes of the page from which no such ``>`` was found, so that none is followed twice.
    """
    followed, here = [], at
    while m := STOP.search(source, here):
        if m[1] is None:
            return m.start()
        quote = m.end() - 1
        if quote in dead:
            break
        followed.append(quote)
        here = source.find(m[1], quote + 1) + 1
        if not here:
            break
    dead.update(followed)
    return source.find(">", at)


def _scan(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, attributes or text) of a page in one pass; kind is ``<`` for a tag, ``/`` for its end, empty for text."""
    at, dead = 0, set()
    while at < len(source):
        begin = source.find("<", at)
        if begin != at:
            yield "", "", source[at : begin if begin > 0 else len(source)]
            if begin < 0:
                return
        end = source.startswith("/", begin + 1)
        if source.startswith("<!--", begin):
            close = source.find("-->", begin + 4)
            at = close + 3 if close >= 0 else len(source)
        elif m := NAME.match(source, begin + 1 + end):
            close = m.end() if source.startswith(">", m.end()) else _tag_end(source, m.end(), dead)
            if close < 0:
                yield "", "", "<"
                at = begin + 1
                continue
            tag, attributes, at = m[0].lower(), source[m.end() : close], close + 1
            if end or tag not in RAW:
                yield "/" if end else "<", tag, attributes
            elif not (tag == "svg" and attributes.endswith("/")):
                m = RAW_ENDS[tag].search(source, at)
                at = source.find(">", m.end()) + 1 if m else 0
                at = at or len(source)
        elif source[begin + 1 : begin + 2] in ("!", "?", "/"):
            close = source.find(">", begin)
            at = close + 1 if close >= 0 else len(source)
        else:
            yield "", "", "<"
            at = begin + 1


def parse(source: str) -> Node:
    """Tree of a page; what follows an element that is never closed belongs to it, and a tag that never ends is left out."""
    root, unsettled = Node("", False), False
    stack = [root]
    end = source.rfind(">") + 1
    begun = re.search(r"<[a-zA-Z/!?]", source[end:])
    source = source[: end + begun.start()] if begun else source

    for kind, tag, rest in _scan(source):
        if not kind:
            stack[-1].parts.append(html.unescape(rest) if "&" in rest else rest)
            continue
        if kind == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "td", "th", "table") and tag in INLINE | {"p", "li"}:
                    break
            continue
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE and stack[i].tag != "p":
                    break
        inside = stack[-1].inside or tag in ("article", "main")
        node = Node(tag, inside, *_judge(tag, rest, inside))
        unsettled = unsettled or node.soft or tag == "button"
        stack[-1].parts.append(node)
        if tag not in VOID:
            stack.append(node)
    if unsettled:
        _settle(root)
    return root


def _settle(root: Node) -> None:
    """Keeps soft elements that hold most of the page, and buttons that are part of a sentence."""
    soft, size, gone, articles = [], [0, 0], 0, 0  # characters of all text, and of that inside articles
    begun: list[list[int]] = []
    for node, left in _walk(root):
        hard = node.unwanted and not node.soft
        if left:
            gone -= hard
            if node.soft:
                soft.append((node, [x - y for x, y in zip(size, begun.pop(), strict=True)]))
            continue
        gone += hard
        if node.tag in SENTENCES and any(isinstance(x, str) and not x.isspace() for x in node.parts):
            for x in node.parts:
                if isinstance(x, Node) and x.tag == "button":
                    x.unwanted = False
        if node.soft:
            begun.append(list(size))
        if not gone:
            articles += node.tag in ("article", "main")
            n = sum(len(x) - x.count(" ") for x in node.parts if isinstance(x, str) and not x.isspace())
            size[0] += n
            size[1] += n * node.inside
    by = 1 if articles and size[1] else 0
    for node, held in soft:
        if held[by] and held[by] >= WRAPS * size[by] and not (by and node.inside):
            node.unwanted = False


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """(node, left) before and after its parts."""
    stack = [(root, False)]
    while stack:
        node, left = stack.pop()
        yield node, left
        if not left:
            stack.append((node, True))
            stack += [(x, False) for x in reversed(node.parts) if isinstance(x, Node)]


def _kept(root: Node) -> Iterator[Node]:
    """The nodes that neither are unwanted nor stand in such a one."""
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.unwanted:
            yield node
            stack += [x for x in node.parts if isinstance(x, Node)]


def set_hashes(root: Node) -> None:
    for node, left in _walk(root):
        if left:
            text = "\x00".join(f"\x01{x.hash}" if isinstance(x, Node) else SPACE.sub(" ", x).strip() for x in node.parts)
            node.hash = xxhash.xxh3_64_intdigest(f"{node.tag}\x00{text}") - (1 << 63)


def _has_text(node: Node) -> bool:
    return any(isinstance(x, str) and not x.isspace() for n, left in _walk(node) if not left for x in n.parts)


def candidates(root: Node) -> dict[int, bool]:
    """Hashes of the subtrees that may be template, and whether they stand inside an article: not the page's frame, nor plain prose inside an article."""
    found, skip = {}, None
    for node, left in _walk(root):
        if skip is not None:
            skip = None if node is skip and left else skip
        elif not left and node.unwanted:
            skip = node
        elif left and node.tag not in ("", "html", "body", "article", "main") and node.tag not in INLINE and not node.kept_prose and _has_text(node):
            found[node.hash] = found.get(node.hash, False) or node.inside
    return found


def text_of(root: Node, template: set[int] = frozenset()) -> str:
    """The blocks that remain, in page order, joined by blank lines."""
    articles = any(n.tag in ("article", "main") for n in _kept(root))
    blocks, line = [], []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(line)).strip():
            blocks.append(text)
        line.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif isinstance(x, tuple):
            if not articles or x[1]:
                line.append(x[0])
        elif x.tag in ("br", "wbr", "img", "hr"):
            line.append("" if x.tag == "wbr" else "\n") if x.tag != "hr" else flush()
        elif not x.unwanted and (x.hash not in template or x.tag in ("", "html", "body", "article", "main") or x.kept_prose):
            if x.tag not in INLINE:
                flush()
                stack.append(None)
            stack += [p if isinstance(p, Node) else (p, x.inside) for p in reversed(x.parts)]
    flush()
    return "\n\n".join(blocks)


def _site(url: str | None) -> tuple[str, str]:
    """Host and section (the first part of the path, if another follows)."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)/*([^/?#]*)(/)?", url or "", re.I)
    return (m[1].rpartition("@")[2].lower(), m[2] if m[3] else "") if m else ("", "")


FOUND = "key long, host string, section string, subtrees array<struct<hash:long,inside:boolean>>"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("inside", pa.bool_())]))
    for batch in batches:
        hosts, sections, subtrees = [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            root = parse(page.as_py() or "")
            set_hashes(root)
            host, section = _site(url)
            hosts.append(host)
            sections.append(section)
            subtrees.append([{"hash": h, "inside": inside} for h, inside in sorted(candidates(root).items())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array(sections, pa.string()), pa.array(subtrees, kind)], names=["key", "host", "section", "subtrees"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, template in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            root = parse(page.as_py() or "")
            if template:
                set_hashes(root)
            texts.append(text_of(root, set(template or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _template(found: DataFrame) -> DataFrame:
    """(host, hash, section) of the template's subtrees; section is null for those of the whole host."""
    each = found.select("key", "host", "section", F.explode("subtrees").alias("s")).select("host", "section", "s.hash", "s.inside")
    by_section = each.groupBy("host", "section", "hash").agg(F.count("*").alias("n"), F.max("inside").alias("inside"))
    by_host = by_section.groupBy("host", "hash").agg(F.sum("n").alias("n"), F.max("inside").alias("inside"))
    sections = found.groupBy("host", "section").agg(F.count("*").alias("pages"))
    hosts = sections.groupBy("host").agg(F.sum("pages").alias("pages"))
    often = (F.col("n") >= PAGES) & ((F.col("n") >= SHARE * F.col("pages")) | ~F.col("inside") & (F.col("n") >= MANY))
    whole = by_host.where(F.col("n") >= PAGES).join(hosts, "host").where(often).select("host", "hash", F.lit(None).cast("string").alias("section"))
    return whole.union(by_section.where(F.col("n") >= PAGES).join(sections, ["host", "section"]).where(often).select("host", "hash", "section"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages`` (page_id, url, html).

    Null html is empty, and an empty page has empty text. Pages without a host in their url
    count as one host. A row that is repeated in all three columns counts once. Other columns are ignored.
    """
    spark = pages.sparkSession
    arrow_in_small_batches(spark)
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    found = cut(pages.select("key", "url", "html").mapInArrow(_subtrees, FOUND).dropDuplicates(["key"]))
    template = cut(_template(found))
    met = found.select("key", "host", "section", F.explode("subtrees").alias("s")).select("key", "host", "section", "s.hash")
    same = met.join(if_small(template.withColumnRenamed("section", "of"), 500_000), ["host", "hash"]).where("of is null or of = section")
    lists = cut(same.groupBy("key").agg(F.sort_array(F.collect_set("hash")).alias("template")))  # at most a page's own subtrees
    rows = pages.join(if_small(lists, 20_000), "key", "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
