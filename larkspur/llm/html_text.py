"""Main text of web pages by site template removal.

1. Each page is parsed into an element tree.  Every block element with text, menus,
   adverts and footers included, gets a hash of its subtree.  Spark counts, per host,
   the different page contents in which a subtree occurs; copies of one page count once.
2. Subtrees that recur in at least ``min_share`` of the host's different contents, and in
   ``min_pages`` of them, are the site's template: many pages of a host means the same
   share of it at every size.  A host has at most as many of them as a page has subtrees,
   divided by that share.  Paragraphs, headings and the like inside an article are prose,
   which pages quote from each other: they aren't candidates.
3. Each page is parsed again next to its host's template hashes, and what is in a
   template subtree is deleted.  Nothing but hashes is shuffled for the counts; the pages
   themselves are moved only where the templates of all hosts are too many to be sent to
   every task (``MOST_SENT``).
4. What recurs too little to be counted, as on a host with few pages, is left to lists:
   elements that are never main text by their kind (scripts, menus, forms, ...) or by what
   their class, id or role says (adverts, cookie notices, comments, ...) are left out.
   Words say nothing of prose elements, of ``main`` and what it or a plain article is in,
   and of what holds most of the text of its article, or outside articles of the page;
   readers' remarks may be longer than their article.  If there is a ``main`` with prose,
   only its text is kept; of it the ``article`` elements, but for those of less than a
   quarter of the largest one's text, and none of them if there is more prose beside
   them than in the largest: then they are teasers.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined in page order by one space.  Tags that are cut off or unclosed end
where the HTML rules end them; an unclosed comment or script ends with the page.

Null and empty pages give an empty text.  Repeated rows are extracted each; a null
or odd url counts as the host ""; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import arrow_rows, forget, written
from larkspur.llm.textblock import slices

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never main text.
GONE = frozenset("script style noscript template head title nav aside footer form button select option textarea input iframe object embed svg canvas dialog menu map audio video noembed noframes".split())
#: Holds no text of the page, so nothing to count.
UNSEEN = frozenset("script style template head title noscript iframe noembed noframes textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead figcaption br hr".split()) | INLINE
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: What an opening tag closes, and the elements beyond which it closes nothing.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
HOLDS_P = frozenset("article aside body button div section main td th table blockquote li dd figure footer header nav form".split())
#: Words of a class, id or role that mark what isn't main text.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation topnav breadcrumb breadcrumbs pagination pager footer masthead toolbar comment comments disqus respond reply replies share sharing social related recommended widget "
    "search login complementary contentinfo skip copyright".split()
)
#: Of these the words of readers' remarks, which may be longer than what they are about.
REMARK = frozenset("comment comments disqus respond reply replies".split())
#: Times the rest of its article's text that an element of remarks may hold and still be taken for remarks.
REMARKS = 8
#: An article is a teaser beside one of more than so many times its text.
TEASER = 4
ROOTS = frozenset(["article", "main"])
#: The templates of all hosts are sent to every task if they are at most so many hashes, else joined.
MOST_SENT = 2_000_000
COUNTED = "host string, content bigint, subtrees array<bigint>"
EXTRACTED = "page_id bigint, url string, text string, n_chars bigint, n_template_blocks int"


class _Node:
    __slots__ = ("tag", "parent", "sum", "gone", "silent", "root", "hash", "candidate", "filled", "hinted", "remark", "holds")

    def __init__(self, tag: str, parent: _Node | None, label: str, gone: bool, hinted: bool = False):
        self.tag, self.parent = tag, parent
        self.gone = gone or bool(parent and parent.gone)
        # no block of its own to be counted: what isn't text of the page, and inline elements that are left out
        self.silent = bool(parent and parent.silent) or tag in UNSEEN or gone and tag in INLINE
        self.root = tag if tag in ROOTS else parent.root if parent else None
        if parent and parent.root == "article":
            self.root = "article"
        self.candidate = tag not in ("html", "body", "article", "main") and tag not in INLINE and tag not in UNSEEN and not (tag in PROSE and self.root)
        self.filled = False
        self.hinted = hinted and tag not in PROSE and tag != "main"
        self.remark = self.hinted and not REMARK.isdisjoint(label.lower().replace("-", " ").replace("_", " ").split())
        self.holds = False  # main, or an article that no word counts against
        self.sum = hashlib.blake2b(f"<{tag} {label}>".encode("utf-8", "replace"), digest_size=8)
        self.hash = 0


def _marked(tag: str, attributes: str, inside_root: bool) -> tuple[str, bool, bool]:
    """The class and id of a tag, whether its kind or hiding says that it isn't main text, and whether a word of its class, id or role does."""
    gone = tag in GONE or tag == "header" and not inside_root
    if not attributes.strip(" /\t\r\n"):
        return "", gone, False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    label = f"{found.get('class', '')} {found.get('id', '')}"
    hinted = False
    if tag not in ("html", "body", "main"):
        words = re.split(r"[^a-z0-9]+", f"{label} {found.get('role', '')}".lower())
        hinted = not HINTS.isdisjoint(words)
        gone = gone or "hidden" in found or found.get("aria-hidden") == "true"
    return label, gone, hinted


class _Block:
    """A block's text with its outermost article, and the elements that words count against, each with the article that it is in."""

    __slots__ = ("text", "node", "article", "main", "prose", "hinted")

    def __init__(self, text: str, node: _Node):
        self.text, self.node = text, node
        self.article: _Node | None = None
        self.main = self.prose = False
        chain: list[_Node] = []
        at: _Node | None = node
        while at:
            self.prose = self.prose or at.tag in PARAGRAPHS
            self.main = self.main or at.tag == "main"
            if at.hinted and not at.holds:
                chain.append(at)
            if at.tag == "article":
                self.article = at
            at = at.parent
        self.hinted = [(n, self.article if n.root == "article" and n is not self.article else None) for n in chain]


def _unhinted(blocks: list[_Block]) -> list[_Block]:
    """The blocks that aren't in an element whose words count against it: one that doesn't hold most of its article's text, with a paragraph or heading, or of the page's."""
    size: Counter[int] = Counter()
    prose: set[int] = set()
    for b in blocks:
        size[0] += len(b.text)
        if b.prose:
            prose |= {id(n) for n, _ in b.hinted}
        if b.article:
            size[id(b.article)] += len(b.text)
        for n, _ in b.hinted:
            if n is not b.article:
                size[id(n)] += len(b.text)

    def against(node: _Node, article: _Node | None) -> bool:
        own, whole = size[id(node)], size[id(article) if article else 0]
        return 2 * own <= whole or article is not None and id(node) not in prose or node.remark and own <= REMARKS * (whole - own)

    return [b for b in blocks if not any(against(*x) for x in b.hinted)]


def parsed_page(page: str) -> tuple[list[tuple[str, _Node]], list[int]]:
    """The blocks of text of a page, in order, each with its element, and the hashes of all candidate elements with text."""
    stack: list[_Node] = [_Node("html", None, "", False)]
    open_tags: Counter[str] = Counter()
    kept: list[tuple[str, _Node]] = []
    text: list[str] = []
    subtrees: dict[int, None] = {}

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                kept.append((block, next(n for n in reversed(stack) if n.tag not in INLINE)))

    def close() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        node.hash = int.from_bytes(node.sum.digest(), "little", signed=True)
        stack[-1].sum.update(node.hash.to_bytes(8, "little", signed=True))
        if node.filled and node.tag not in UNSEEN:
            stack[-1].filled = True
            if node.candidate:
                subtrees[node.hash] = None

    def say(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece)
            words = " ".join(piece.split())
            stack[-1].sum.update(words.encode("utf-8", "replace"))
            stack[-1].filled = stack[-1].filled or bool(words)
            if not stack[-1].silent:
                text.append(piece)

    def end(tags, beyond=frozenset()) -> None:
        """Close up to the innermost of the tags, if one is open before an element of ``beyond``."""
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                if any(n.tag not in INLINE for n in stack[i:]):
                    flush()
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in beyond:
                return

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        ending, tag = m[1], (m[2] or m[4] or "").lower()
        if ending:
            ending = ending.lower()
            if ending == "br":
                flush()
            elif ending not in ("html", "body"):
                end((ending,), frozenset(["article", "section", "td", "th", "table"]) if ending in INLINE or ending == "p" else frozenset())
        elif tag:
            if tag in ENDS_P:
                end(("p",), HOLDS_P)
            if tag in CLOSES:
                end(*CLOSES[tag])
            if tag not in INLINE:
                flush()
            if tag in ("html", "body") or tag in VOID:
                continue
            label, gone, hinted = _marked(tag, m[3] or m[5] or "", stack[-1].root is not None)
            if tag == "body":
                continue
            stack.append(_Node(tag, stack[-1], label, gone, hinted))
            if tag in ROOTS and not hinted:
                for n in stack[:-1]:
                    n.holds = True
            open_tags[tag] += 1
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                stack[-1].sum.update(page[at : stop.start() if stop else size].encode("utf-8", "replace"))
                at = stop.start() if stop else size
            elif (m[3] or "").endswith("/") and tag not in INLINE and tag in ("svg", "path"):
                close()
    flush()
    while len(stack) > 1:
        close()
    return kept, list(subtrees)


def in_templates(node: _Node | None, templates: frozenset[int] | set[int]) -> bool:
    while node:
        if node.candidate and node.hash in templates:
            return True
        node = node.parent
    return False


def main_blocks(kept: list[tuple[str, _Node]]) -> list[str]:
    """Of the blocks that no template has, the texts that kinds, words and ``main`` or ``article`` leave."""
    blocks = [_Block(t, n) for t, n in kept if not n.gone]
    if any(b.main and (b.prose or b.article) for b in blocks) or not any(b.article for b in blocks) and any(b.main for b in blocks):
        blocks = [b for b in blocks if b.main]
    blocks = _unhinted(blocks)
    size: Counter[int] = Counter()
    for b in blocks:
        size[id(b.article) if b.article else 0] += len(b.text) if b.article or b.prose else 0
    largest = max((n for a, n in size.items() if a), default=0)
    if size[0] > largest > 0:  # the text is beside them: they are teasers
        blocks = [b for b in blocks if not b.article]
    elif largest:
        blocks = [b for b in blocks if b.article and TEASER * size[id(b.article)] >= largest]
    return [b.text for b in blocks]


def blocks_of(page: str) -> list[str]:
    """The blocks of text that a page keeps by itself, in order."""
    return main_blocks(parsed_page(page)[0])


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, a hash of the main text, and the candidate subtrees of each page."""
    for batch in slices(batches, "html"):
        pages = [parsed_page(h or "") for h in batch.column("html").to_pylist()]
        content = [int.from_bytes(hashlib.blake2b("\n".join(main_blocks(kept)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for kept, _ in pages]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(content, pa.int64()), pa.array([s for _, s in pages], pa.list_(pa.int64()))], ["host", "content", "subtrees"])


def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main text of each page, and how many blocks the host's templates took from it."""
    for batch in slices(batches, "html"):
        known: dict[str, frozenset[int]] = {}
        texts, gone = [], []
        templates = batch.column("templates")
        for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
            if host not in known:
                known[host] = frozenset(templates[i].as_py() or ())
            blocks, _ = parsed_page(page or "")
            left = [(t, n) for t, n in blocks if not in_templates(n, known[host])] if known[host] else blocks
            gone.append(len(blocks) - len(left))
            texts.append(" ".join(main_blocks(left)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(gone, pa.int32())],
            ["page_id", "url", "text", "n_chars", "n_template_blocks"],
        )


def site_templates(pages: DataFrame, min_share: float, min_pages: int) -> DataFrame:
    """host and ``templates``, the hashes of the subtrees that recur on it; ``pages`` has host and html."""
    contents = written(pages.select("host", "html").mapInArrow(counted, COUNTED).groupBy("host", "content").agg(F.min("subtrees").alias("subtrees")), "page-subtrees")
    # the hosts that can have templates only
    hosts = contents.groupBy("host").agg(F.count("*").alias("contents")).where(F.col("contents") >= min_pages)
    found = contents.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    many = found.join(hosts, "host").where(F.col("pages") >= F.col("contents") * min_share)
    out = written(many.groupBy("host").agg(F.collect_list("subtree").alias("templates")), "templates")
    forget(contents)
    return out


def main_text(pages: DataFrame, min_share: float = 0.01, min_pages: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_template_blocks (blocks that the host's templates took) of every page."""
    arrow_rows(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), F.col(f"`{html_col}`").alias("html"))
    templates = site_templates(rows, min_share, min_pages)
    size = templates.agg(F.sum(F.size("templates") + 1)).first()[0] or 0
    # each page's host has one row; beyond the bound a hot host's pages are split by the skew join
    joined = rows.join(F.broadcast(templates) if size <= MOST_SENT else templates, "host", "left")
    out = joined.select("page_id", "url", "host", "html", "templates").mapInArrow(extracted, EXTRACTED)
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
