"""Main text of web pages by wrapper induction.

Pages of a host are aligned with reference pages of the host by simple tree matching: equal
tags in order, the largest number of matched nodes. A matched node whose own text is the
same on both pages votes for template, one that differs votes for content. Blocks that most
references confirm as constant are the host's template and go; varying slots are content.
What HTML itself names as not part of the article (navigation, headers and footers of the
page, asides, forms, scripts, dialogs) and slots that classes, ids or roles name as adverts,
menus, notices or reader comments go as well, for they vary from page to page too. If a page
marks its article or main part, only that part is aligned.

Scale: a host keeps at most REFERENCES pages as its wrapper (the smallest hashes of url and
page, so the choice does not depend on row order); every page is aligned with these only,
and a host with a third of all pages is a plain join of its pages with one wrapper row.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast

REFERENCES = 4             # pages in a host's wrapper
HOSTS = 20_000             # wrapper rows a broadcast may hold (about 2 kB each)

# Elements of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes plaintext".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu script style noscript template iframe svg math head "
                    "textarea object canvas audio video input label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "p": {"p"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BODIES = frozenset("html body main article".split())
_READERS = r"comments?|disqus|respond|replies|reply"
_AROUND = r"(?:(?:site|top|bottom|main|global)[-_]+)?(?:{})(?:[-_]+(?:slot|box|list|bar|body|wrap|wrapper|container|area|section|block|links?|unit|form|items?))?"
# whole class tokens and ids, with a word of place or kind around them at most: "site-footer", not "has-sidebar"
NAMED = re.compile(_AROUND.format(r"ads?|adverts?|advertisement|adbox|banner|sponsor(?:ed)?|promo|nav|navbar|navigation|menu|breadcrumbs?|"
                   r"sidebar|side|footer|foot|header|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|"
                   r"login|share|sharing|social|related|recommended|widget|toolbar|pager|pagination|skip|alert|" + _READERS), re.I)
READERS = re.compile(_AROUND.format(_READERS), re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

# a quote opens a value only behind an equals sign, and a value that never ends is no value: a stray quote ends at its tag
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)


class Node:
    """An element: tag, whether it is dropped, the pattern its class or id is dropped for, and children (nodes or text)."""

    __slots__ = ("tag", "out", "named", "kids")

    def __init__(self, tag: str, out: bool, named: re.Pattern | None = None):
        self.tag, self.out, self.named, self.kids = tag, out or named is not None, named, []


def _named(tag: str, attrs: str) -> re.Pattern | None:
    """READERS or NAMED if a class token or the id says so; the page's body and its parts are never NAMED."""
    found = None
    for name, *values in ATTR.findall(attrs):
        if name.lower() in ("class", "id"):
            for token in next((v for v in values if v), "").split():
                if READERS.fullmatch(token) and tag not in ("html", "body", "main"):
                    return READERS
                if tag not in BODIES and NAMED.fullmatch(token):
                    found = NAMED
    return found


def _role_out(attrs: str) -> bool:
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
    return False


def _keep_most(root: Node) -> None:
    """Elements whose class or id names a slot but that hold most of the page's text stay.

    Unless the page has an article or main part elsewhere; reader comments only stay when
    the page has no other text.
    """
    size, parts, order, todo = {}, {}, [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(k for k in x.kids if isinstance(k, Node) and not (k.out and k.named is None))
    for x in reversed(order):
        inner = [k for k in x.kids if isinstance(k, Node)]
        size[id(x)] = sum(len("".join(k.split())) for k in x.kids if isinstance(k, str)) + sum(size.get(id(k), 0) for k in inner)
        parts[id(x)] = (x.tag in ("article", "main")) + sum(parts.get(id(k), 0) for k in inner)
    total, marked = size[id(root)], parts[id(root)]
    for x in order:
        if x.named is None or 2 * size[id(x)] <= total or parts[id(x)] < marked:
            continue
        if x.named is NAMED or size[id(x)] == total:
            x.out, x.named = False, None


def parse(text: str) -> Node:
    """A tolerant tree: raw text elements end at their own end tag, unclosed elements end
    where the standard says or with their parent, stray end tags are ignored."""
    root = Node("#root", False)
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P or tag in SAME_CLOSES:
            ends = SAME_CLOSES.get(tag, {"p"})
            for k in range(len(stack) - 1, 0, -1):
                open_ = stack[k].tag
                if open_ in ends or (open_ == "p" and tag in CLOSES_P):
                    del stack[k:]
                    break
                if open_ not in INLINE:
                    break
        out = tag in DROPPED or _role_out(m.group(3))
        node = Node(tag, out, None if out else _named(tag, m.group(3)))
        stack[-1].kids.append(node)
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(text, at)
            node.kids.append(text[at:end.start()] if end else text[at:])
            at = end.end() if end else n
            continue
        stack.append(node)
    _keep_most(root)
    return root


def _find(node: Node, tags: tuple[str, ...]) -> list[Node]:
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.tag in tags and not x.out:
            found.append(x)
            continue
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not (k.out and (k.tag in RAW or k.named)))
    return found


def _headings(header: Node) -> Node:
    """The headings of an article's header, without those of its own dropped parts."""
    kept, todo = Node("header", False), list(reversed(header.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.out:
            continue
        if x.tag in HEADINGS:
            kept.kids.append(x)
        else:
            todo.extend(reversed(x.kids))
    return kept


def main_parts(root: Node) -> list[Node]:
    """The article, else the main part, else the body, else everything."""
    for tags in (("article",), ("main",), ("body",)):
        found = _find(root, tags)
        if found:
            return found
    return [root]


def blocks(root: Node) -> list[tuple[str, str]]:
    """(path, text) of the blocks of the main part in page order; named slots are left out.

    A block is a longest run of text and inline elements between block borders. Character
    references are decoded, white space runs become one space, ends are trimmed.
    """
    out, buffer = [], []

    def flush(path):
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            steps = []
            while path is not None:
                path, tag = path
                steps.append(tag)
            out.append(("/".join(reversed(steps)), text))

    inside_main = {id(p) for p in main_parts(root)}
    for part in main_parts(root):
        # a path is a pair (path above, tag) and becomes text only for a block, so depth costs no more than its length
        todo = [(part, (None, part.tag), 0)]
        flush(None)
        while todo:
            node, path, k = todo.pop()
            if k == 0 and node.tag not in INLINE:
                flush(path)
            advanced = False
            while k < len(node.kids):
                kid = node.kids[k]
                k += 1
                if isinstance(kid, str):
                    buffer.append(kid)
                elif kid.tag == "br":
                    buffer.append(" ")
                elif kid.out and kid.tag == "header" and part.tag in ("article", "main"):
                    todo.append((node, path, k))
                    todo.append((_headings(kid), (path, "header"), 0))
                    advanced = True
                    break
                elif kid.out and id(kid) not in inside_main:
                    if kid.tag not in INLINE:
                        flush(path)
                else:
                    todo.append((node, path, k))
                    todo.append((kid, path if kid.tag in INLINE else (path, kid.tag), 0))
                    advanced = True
                    break
            if not advanced and node.tag not in INLINE:
                flush(path)
        flush(None)
    return out


def tree(paths: list[str]):
    """Block paths as a tree of [tag, block index or None, children] for the matching."""
    root = ["", None, []]
    stack = [root]
    for k, path in enumerate(paths):
        steps = path.split("/")
        while len(stack) > len(steps) or any(stack[j + 1][0] != steps[j] for j in range(len(stack) - 1)):
            stack.pop()
        for step in steps[len(stack) - 1:-1]:
            node = [step, None, []]
            stack[-1][2].append(node)
            stack.append(node)
        stack[-1][2].append([steps[-1], k, []])
    return root


def match(a, b, pairs: list, same=None) -> int:
    """Simple tree matching: size of the largest order-preserving match of two trees with
    equal root tags; the matched leaf pairs are appended to `pairs`. Of equally large
    matches one that pairs trailing leaves of equal text (`same`) is taken.

    Subtrees are matched on a stack of our own, so pages may nest to any depth.
    """
    open_, value = [_match(a, b, pairs, same)], None
    while open_:
        try:
            open_.append(_match(*open_[-1].send(value), same))
            value = None
        except StopIteration as done:
            open_.pop()
            value = done.value
    return value


def _match(a, b, pairs: list, same):
    """One level of `match`: asks for the match of two children and is sent its size."""
    if a[0] != b[0]:
        return 0
    x, y = a[2], b[2]
    if a[1] is not None and b[1] is not None:
        pairs.append((a[1], b[1]))
    if not x or not y:
        return 1
    # leaves with equal tags at either end belong to some largest match: only the middle needs the table
    head, tail, most = 0, 0, min(len(x), len(y))
    while (same and tail < most and x[-1 - tail][0] == y[-1 - tail][0] and not x[-1 - tail][2] and not y[-1 - tail][2]
           and same(x[-1 - tail][1], y[-1 - tail][1])):
        pairs.append((x[-1 - tail][1], y[-1 - tail][1]))
        tail += 1
    while head < most - tail and x[head][0] == y[head][0] and not x[head][2] and not y[head][2]:
        pairs.append((x[head][1], y[head][1]))
        head += 1
    while tail < most - head and x[-1 - tail][0] == y[-1 - tail][0] and not x[-1 - tail][2] and not y[-1 - tail][2]:
        pairs.append((x[-1 - tail][1], y[-1 - tail][1]))
        tail += 1
    ends = 1 + head + tail
    x, y = x[head:len(x) - tail], y[head:len(y) - tail]
    w, got = {}, {}
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            if x[i - 1][0] == y[j - 1][0]:
                own: list = []
                w[i, j], got[i, j] = (yield x[i - 1], y[j - 1], own), own
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w[i, j])
            else:
                m[i][j] = max(m[i - 1][j], m[i][j - 1])
    i, j, chosen = len(x), len(y), []
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
        elif m[i][j] == m[i][j - 1]:
            j -= 1
        else:
            chosen.append((i, j))
            i, j = i - 1, j - 1
    for c in reversed(chosen):
        pairs.extend(got[c])
    return m[len(x)][len(y)] + ends


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def signature(html: str | None) -> tuple[list[str], list[int], list[str]]:
    """Paths, text hashes and texts of a page's blocks."""
    found = blocks(parse(html or ""))
    return [p for p, _ in found], [text_hash(t) for _, t in found], [t for _, t in found]


def template_blocks(paths: list[str], hashes: list[int], references: list[tuple]) -> set[int]:
    """Indices of the page's blocks that are constant in the wrapper.

    `references` are (tree, hashes). A reference that agrees on more than half of the
    matched blocks is a copy of the page and says nothing about the template. A block is
    template when at least two other references match it and all of them have its text.
    """
    own = tree(paths)
    seen, same, told = [0] * len(paths), [0] * len(paths), 0
    for other, theirs in references:
        pairs: list = []
        match(own, other, pairs, lambda i, j: hashes[i] == theirs[j])
        equal = sum(hashes[i] == theirs[j] for i, j in pairs)
        if 2 * equal > len(pairs):
            continue
        told += 1
        for i, j in pairs:
            seen[i] += 1
            same[i] += hashes[i] == theirs[j]
    return {i for i in range(len(paths)) if told >= 2 and seen[i] >= 2 and same[i] == seen[i]}


def _host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """__r (host) and refs, the block paths and text hashes of at most REFERENCES pages a host.

    Candidates are ranked inside 64 salts of a host first, so a hot host is not one task.
    """
    keyed = pages.select(_host().alias("__host"), "html", F.xxhash64("url", "page_id").alias("__o")).where("__host <> '' and html is not null")
    narrow = keyed.select("__host", F.pmod("__o", F.lit(64)).alias("__salt"), "__o", F.xxhash64("html").alias("__x")).distinct()
    few = Window.partitionBy("__host", "__salt").orderBy("__o", "__x")
    top = Window.partitionBy("__host").orderBy("__o", "__x")
    chosen = narrow.withColumn("k", F.row_number().over(few)).where(F.col("k") <= REFERENCES).withColumn(
        "k", F.row_number().over(top)).where(F.col("k") <= REFERENCES).select(
        F.col("__host").alias("__h"), F.col("__o").alias("__p"), F.col("__x").alias("__y"))
    texts = keyed.join(checked_broadcast(chosen, 4 * HOSTS), (F.col("__host") == F.col("__h")) & (F.col("__o") == F.col("__p"))
                       & (F.xxhash64("html") == F.col("__y")), "left_semi").select("__host", "html")

    def run(batches):
        for b in batches:
            found = [signature(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("__host"), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                ["__host", "paths", "hashes"])
    signed = texts.mapInArrow(run, "__host string, paths array<string>, hashes array<long>")
    return signed.groupBy(F.col("__host").alias("__r")).agg(F.array_sort(F.collect_set(F.struct("paths", "hashes"))).alias("refs"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    Null or empty html and pages without main text give an empty text. Pages without a host
    have no wrapper and are cut by their own markup only. Repeated rows give repeated
    results; other columns are not read.
    """
    refs = checked_broadcast(wrappers(pages), HOSTS)
    keyed = pages.select("page_id", "url", "html", _host().alias("__host")).join(refs, F.col("__host") == F.col("__r"), "left")

    def run(batches):
        known: dict = {}
        for b in batches:
            text, size = [], []
            refs = b.column("refs")
            for k, (page, host) in enumerate(zip(b.column("html").to_pylist(), b.column("__host").to_pylist())):
                paths, hashes, texts = signature(page)
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[host] = [(tree(r["paths"]), r["hashes"]) for r in (refs[k].as_py() or [])]
                gone = template_blocks(paths, hashes, known[host]) if paths else set()
                out = "\n".join(t for i, t in enumerate(texts) if i not in gone)
                text.append(out)
                size.append(len(out))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(text, pa.string()), pa.array(size, pa.int64())],
                ["page_id", "url", "text", "n_chars"])
    return keyed.select("page_id", "url", "html", "__host", "refs").mapInArrow(run, "page_id long, url string, text string, n_chars long")
