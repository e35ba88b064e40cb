"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree whose nodes are the paths of tags
and classes. For each node the tree keeps how often which run of child tags
(presentation) and which own text (content) occurs; from that follow, as
entropies over the pages that have the node, the importance of its
presentation (0: all pages alike) and of its content (0: the same texts on
all pages). A node's own importance is the larger of the two for inner nodes
and that of the content for leaves; its importance is the largest of its own
and of all nodes below it, which no weighted sum over the branch exceeds. So
a branch is low only if it is so throughout: a list, table or wrapper whose
pages all look alike counts by what stands in it. Hosts with fewer than
least_pages pages at a node say nothing about it; its text stays.

From each page go: branches whose tag, role or class names them as
navigation, header, footer, sidebar, notice, advert, form, script, style or
comments; where the page marks its article or main part, all that is outside;
and branches of low importance. Inside an article or main part, where texts
repeat between copies of one text, a class must be such a name as a whole
(comments, not share-price); of branches whose class only holds one, the tree decides.
Other branches inside stay. A page that would lose all its text to the tree keeps it.
What remains is joined by block.

Null html has no text. Repeated rows are told apart; a null or odd url
belongs to host ''. Unclosed tags end where HTML ends them. An empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import written

# HTML's void, raw and block elements, and the names of branches without main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea select button svg iframe object title"
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog".split())
NOISE_WORDS = r"(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|widget|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|related|comments?|replies|disqus|pagination|pager|toolbar)"
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
MAIN = frozenset("article main".split())
#: An element on the left ends where one on the right begins beside it.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = frozenset("article aside blockquote body div fieldset figure footer form header html main nav section table td th ul ol dl".split())

#: A class or id that is, and one that holds, such a word.
NAMED = re.compile(rf"(?:^|\s){NOISE_WORDS}(?:$|\s)", re.I)
HOLDS = re.compile(rf"(?:^|[\s_-]){NOISE_WORDS}(?:$|[\s_-])", re.I)

REST = r"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*"
TOKEN = re.compile(rf"<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>{REST})>|<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW.split()}
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Node:
    __slots__ = ("tag", "path", "noise", "main", "doubt", "children")

    def __init__(self, tag: str, path: str, noise: bool, main: bool, doubt: bool):
        self.tag, self.path, self.noise, self.main, self.doubt = tag, path, noise, main, doubt
        self.children: list[str] = []


def walk(page: str) -> Iterator[tuple[str, object]]:
    """("open", node), ("close", node) and ("text", (node, string)) in page order."""
    root = Node("", "", False, False, False)
    stack, at = [root], 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            yield "text", (stack[-1], page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW_END and not m["end"]:
            at = RAW_END[tag].search(page, at).end()
            continue
        if m["end"]:
            if any(n.tag == tag for n in stack[1:]):
                while True:
                    node = stack.pop()
                    yield "close", node
                    if node.tag == tag:
                        break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ENDS and tag in ENDS[stack[k].tag]:
                while len(stack) > k:
                    yield "close", stack.pop()
                break
            if stack[k].tag in SCOPES:
                break
        about = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(m["rest"])} if m["rest"] else {}
        names = " ".join(about.get(k, "") for k in ("class", "id"))
        up = stack[-1]
        named = names.strip() and tag not in ("html", "body", *MAIN)
        noise = up.noise or tag in NOISE_TAGS or about.get("role", "").lower() in NOISE_ROLES or bool(named and (NAMED if up.main else HOLDS).search(names))
        doubt = up.doubt or bool(named and up.main and HOLDS.search(names))
        style = f"{tag}.{about['class'].split()[0]}" if about.get("class", "").split() else tag
        node = Node(tag, f"{up.path}>{style}", noise, up.main or tag in MAIN or about.get("role", "").lower() == "main", doubt)
        up.children.append(style)
        yield "open", node
        if tag in VOID or m["rest"].endswith("/") and tag not in BLOCK:
            yield "close", node
        else:
            stack.append(node)
    if at < len(page) and page[at] != "<":
        yield "text", (stack[-1], page[at:])
    while len(stack) > 1:
        yield "close", stack.pop()


def host(url: str | None) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def style_nodes(page: str) -> Iterator[tuple[str, str, int]]:
    """path, p or c, and the hash of a presentation or a content, once for each path of the page."""
    looks: dict[str, list[str]] = {}
    texts: dict[str, list[str]] = {}
    for kind, x in walk(page):
        if kind == "text":
            node, s = x
            if s and not s.isspace():
                texts.setdefault(node.path, []).append(" ".join(s.split()))
        elif kind == "close":
            runs = [c for i, c in enumerate(x.children) if not i or x.children[i - 1] != c]
            looks.setdefault(x.path, []).append(",".join(runs))
    for path, found in looks.items():
        yield path, "p", zlib.crc32("|".join(sorted(set(found))).encode())
        yield path, "c", zlib.crc32("|".join(texts.get(path, [])).encode())


def style_tree(pages: DataFrame, least_pages: int = 10, low: float = 0.3) -> DataFrame:
    """_host and low: the paths of low importance of each host that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in seen.items()] or []
            seen.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "path", "kind", "value", "n"])

        for batch in batches:
            for url, page in zip(batch.column(0), batch.column(1), strict=True):
                own = host(url.as_py())
                for path, kind, value in style_nodes(page.as_py() or ""):
                    seen[own, path, kind, value] += 1
                if len(seen) > 200_000:
                    yield out()
        yield out()

    counts = pages.select("url", "html").mapInArrow(count, "host string, path string, kind string, value bigint, n bigint").groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    per = counts.groupBy("host", "path").agg(
        *[f(F.when(F.col("kind") == k, v)).alias(a) for k, s in (("p", "look"), ("c", "text")) for f, v, a in ((F.sum, n, f"{s}_n"), (F.sum, n * F.log(n), f"{s}_log"))],
    )
    m = F.greatest(F.col("look_n"), F.lit(2.0))
    spread = lambda s: (F.log(m) - F.col(f"{s}_log") / m) / F.log(m)  # noqa: E731  entropy of the distribution, in shares of its most
    importance = F.when(F.col("path").rlike(r">(p|h[1-6]|li|a|span|b|i|em|strong|td|th)(\.[^>]*)?$"), spread("text")).otherwise(F.greatest(spread("look"), spread("text")))
    known = per.where(F.col("look_n") >= least_pages).select("host", "path", importance.alias("own"))
    # each node and those above it, whose paths its own begins with
    names = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(2), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), ">"))
    branch = known.select("host", F.col("path").alias("_at"), "own", F.explode(above).alias("path")).groupBy("host", "path").agg(F.max("own").alias("most"), F.bool_or(F.col("path") == F.col("_at")).alias("met"))
    return branch.where(F.col("met") & (F.col("most") < low)).groupBy(F.col("host").alias("_host")).agg(F.collect_set("path").alias("low"))


def main_text(page: str, low: frozenset[str] = frozenset()) -> str:
    """The text of the page without noise and, unless nothing is left then, without its branches of low importance."""
    return _text(page, low) or (_text(page, frozenset()) if low else "")


def _text(page: str, low: frozenset[str]) -> str:
    blocks: list[tuple[bool, str]] = []  # in the main part, text
    parts: list[str] = []
    main = marked = False

    def flush() -> None:
        s = " ".join("".join(parts).split())
        if s:
            blocks.append((main, s))
        parts.clear()

    for kind, x in walk(page):
        if kind == "text":
            node, s = x
            if not node.noise and (node.path not in low or node.main and not node.doubt or node.tag in ("html", "body")):
                if not parts:
                    main = node.main
                parts.append(entities.unescape(s) if "&" in s else s)
            continue
        if x.tag in BLOCK:
            flush()
        elif x.tag == "br" and kind == "open":
            parts.append(" ")
        if kind == "open":
            marked = marked or x.main and not x.noise
    flush()
    return "\n".join(s for inside, s in blocks if inside or not marked)


def extract(pages: DataFrame, least_pages: int = 10, low: float = 0.3, most_paths: int = 200_000) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages.

    The hosts' low paths are broadcast only when there are most_paths of them
    at most, of 200 characters on average.
    """
    tree = written(style_tree(pages, least_pages, low), "styles")
    total = tree.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)), F.coalesce(F.sum(F.length(F.array_join("low", ""))), F.lit(0))).first()
    if total[0] <= most_paths and total[1] <= 200 * most_paths:
        tree = F.broadcast(tree)
    own = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = pages.select("page_id", "url", "html", own.alias("_h")).join(tree, F.col("_h") == F.col("_host"), "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", frozenset(paths.as_py() or ())) for p, paths in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint")
