"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of branches: an element path with its tags and classes. For each branch two
entropies are measured over the host's pages. Presentation: how varied the inner tag sequences are (a menu that always
looks alike has none). Content: how many of the pages hold the same text there (a notice that all pages hold has none).
A branch's importance weighs both, times a prior for what its element says it is and whether the page has an article;
a page's text is its branches of importance ``KEEP`` or more, and nothing else decides. An article keeps at least ``KEEP``:
a text that a host repeats on many pages is still an article. Containers with a class inside an article are branches of
their own. Their repetition is measured against what stands around them: a text in most of a host's different articles
is a notice, while a text that is repeated with its article, whole or edited, is part of a copy.

Trees are merged by counting: pages send one small row per branch, counts are summed before the shuffle and joined back,
so the pages of a large host are never in one place."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize

KEEP = 0.5
#: Share of presentation in the importance of a branch one level above its texts.
PRESENTATION = 0.1
#: Plain text on a page with an article is "beside"; a container with a class in an article is a "part".
PRIORS = {"article": 1.0, "part": 1.0, "plain": 1.0, "beside": 0.4, "chrome": 0.4}
#: With fewer pages of a host that have the branch, entropies say nothing.
LEAST_PAGES = 4

#: Elements without content, whose text is no text, that part blocks, and page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|object|canvas|title"
BLOCKS = set("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section
select summary table tbody td tfoot th thead tr ul""".split())
FURNITURE = set("nav footer aside form menu dialog button select fieldset head".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form".split())
FURNITURE_NAMES = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar menu
menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments discussion disqus reply replies
respond share sharing social related recommended recommendations widget widgets toolbar search login masthead""".split())
#: Elements that are a part of an article if they have a class.
CONTAINERS = set("div section p ul ol dl table".split())
#: Words of the runs that tell whether two articles are copies.
SHINGLE = 5
#: Page furniture only where it is not part of an article.
PAGE_ONLY = set("header banner masthead".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
SCOPES = set("article aside body div dl fieldset footer form header html li main nav ol section table td th ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
NAME = re.compile(r"[A-Za-z]+")


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Node:
    __slots__ = ("tag", "path", "kind", "branch", "opens")

    def __init__(self, tag, path, kind, branch, opens=False):
        self.tag, self.path, self.kind, self.branch, self.opens = tag, path, kind, branch, opens


class Branch:
    """One branch of a page: its path, kind, the tags inside and the texts of its blocks."""

    __slots__ = ("path", "kind", "tags", "blocks")

    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.tags, self.blocks = path, kind, [], []

    def keys(self) -> tuple[int, int, int]:
        runs = [t for i, t in enumerate(self.tags) if i == 0 or t != self.tags[i - 1]]
        kind = "plain" if self.kind == "beside" else self.kind
        return _key(self.path, kind), _key(*runs), _key(*[t for _, t in self.blocks])

    def least_shingle(self) -> int | None:
        """The smallest hash of a run of words; None without words."""
        words = " ".join(t for _, t in self.blocks).split()
        return min((_key(*words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))), default=None)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _open(tag: str, raw: str, parent: _Node) -> _Node:
    bare = not raw or not raw.strip(" /\n\t")
    if bare and (tag not in BLOCKS or parent.kind != "plain") and tag not in FURNITURE:
        # Most elements: nothing but a tag inside a known branch, or an inline element, which has no path of its own.
        return _Node(tag, parent.path, parent.kind, parent.branch)
    attributes = {} if bare else _attributes(raw)
    label = tag
    if "class" in attributes:
        label += "." + ".".join(sorted(attributes["class"].split()))
    names = {n.lower() for n in NAME.findall(attributes.get("class", "") + " " + attributes.get("id", ""))}
    kind, inside = parent.kind, parent.kind in ("article", "part")
    furniture = (tag in FURNITURE or attributes.get("role", "").lower() in FURNITURE_ROLES or names & FURNITURE_NAMES
                 or "hidden" in attributes or attributes.get("aria-hidden") == "true"
                 or re.search(r"display\s*:\s*none", attributes.get("style", "")))
    if inside and names & FURNITURE_NAMES and names & FURNITURE_NAMES <= PAGE_ONLY:
        furniture = False
    if tag == "header" and not inside:
        furniture = True
    if tag in ("html", "body"):
        furniture = False
    if kind != "chrome":
        if furniture:
            kind = "chrome"
        elif not inside and (tag in ("article", "main") or attributes.get("role", "").lower() in ("article", "main")):
            kind = "article"
        elif inside and tag in CONTAINERS and attributes.get("class", "").strip():
            return _Node(tag, f"{parent.path}>{label}", "part", None, opens=True)
    if tag not in BLOCKS and kind == parent.kind:
        return _Node(tag, parent.path, kind, parent.branch)
    return _Node(tag, f"{parent.path}>{label}", kind, None)


def branches(page: str) -> list[Branch]:
    """Branches of a page in page order of their first block. Furniture and articles are a branch each as a whole; other
    texts belong to the branch of their element."""
    found: dict[str, Branch] = {}
    order: list[Branch] = []
    stack = [_Node("", "", "plain", None)]
    words: list[str] = []
    serial = [0, 0]

    def flush() -> None:
        nonlocal words
        if words:
            text = "".join(words)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            words = []
            if text:
                branch(stack[-1]).blocks.append((serial[1], text))
                serial[1] += 1

    def branch(node: _Node) -> Branch:
        name = node.branch or node.path
        if name not in found:
            found[name] = Branch(re.sub(r"#\d+$", "", name), node.kind)
            order.append(found[name])
        return found[name]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            words.append(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if stack[i].kind != stack[i - 1].kind:
                        flush()
                    del stack[i:]
                    break
                # An inline end tag does not close the block it stands in.
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        # A block closes an open paragraph; an item closes the one before it in the same list.
        for i in range(len(stack) - 1, 0, -1):
            if (stack[i].tag == "p" and tag in BLOCKS and tag != "br") or stack[i].tag in CLOSES.get(tag, ()):
                del stack[i:]
                break
            if stack[i].tag in SCOPES:
                break
        if tag in VOID:
            continue
        node = _open(tag, m[4], stack[-1])
        if node.kind != "plain":
            if stack[-1].kind == node.kind and not node.opens:
                node.branch = stack[-1].branch
            else:
                flush()
                serial[0] += 1
                node.branch = f"{node.path}#{serial[0]}"
            if node.branch in found:
                found[node.branch].tags.append(tag)
        stack.append(node)
    if at < len(page):
        words.append(page[at:])
    flush()
    if any(b.kind in ("article", "part") for b in order):
        for b in order:
            b.kind = "beside" if b.kind == "plain" else b.kind
    return order


def main_text(page: str, kept: set[tuple[int, int]] | None) -> str:
    """Blocks of the kept branches; without a verdict of the tree, of those that their prior alone would keep."""
    blocks = [t for b in branches(page)
              if (PRIORS[b.kind] >= KEEP if kept is None else (lambda k: (k[0], k[2]) in kept)(b.keys())) for t in b.blocks]
    return "\n".join(t for _, t in sorted(blocks))


def _around(page: list[Branch]) -> dict[int, int]:
    """For each part of a page's article, by its place, the smallest shingle of what stands around it. A part that is half
    of its article or more is the article, and is left out."""
    if not any(b.kind == "part" for b in page):
        return {}
    inside = {i: b for i, b in enumerate(page) if b.kind in ("article", "part")}
    size = {i: sum(len(t) for _, t in b.blocks) for i, b in inside.items()}
    least = {i: b.least_shingle() for i, b in inside.items()}
    return {i: min((x for j, x in least.items() if j != i and x is not None), default=0)
            for i, b in inside.items() if b.kind == "part" and 2 * size[i] < sum(size.values())}


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, host, html in zip(*(batch.column(c).to_pylist() for c in ("_page", "_host", "_html")), strict=True):
            seen, found = set(), branches(html or "")
            around = _around(found)
            for i, b in enumerate(found):
                path, style, content = b.keys()
                if (path, content) not in seen:
                    seen.add((path, content))
                    kind = "article" if b.kind == "part" and i not in around else b.kind
                    rows.append((page, host, path, style, content, kind, around.get(i)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         names=["_page", "_host", "path", "style", "content", "kind", "around"])


def _entropy(rows: DataFrame, keys: list[str], of: str, name: str) -> DataFrame:
    """keys, n (rows) and the entropy of ``of`` among the rows of a key."""
    by_value = rows.groupBy(*keys, of).agg(F.count(F.lit(1)).alias("c"))
    return (by_value.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
            .select(*keys, "n", (F.log("n") - F.col("s") / F.col("n")).alias(name)))


def importance(nodes: DataFrame) -> DataFrame:
    """The branches with their importance on their host."""
    branch, text = ["_host", "path"], ["_host", "path", "content"]
    columns = ["_page", "_host", "path", "content", "kind"]
    whole, parts = nodes.filter(F.col("kind") != "part"), nodes.filter(F.col("kind") == "part")
    spread = F.when(F.col("n") > 1, F.col("spread") / F.log("n")).otherwise(1.0)

    by_path = _entropy(whole, branch, "style", "spread")
    by_content = whole.groupBy(*text).agg(F.count(F.lit(1)).alias("same"))
    known = F.col("n") >= LEAST_PAGES
    presentation = F.when(known, spread).otherwise(1.0)
    content = F.when(known, 1 - F.log("same") / F.log("n")).otherwise(1.0)
    prior = F.create_map(*[F.lit(x) for pair in PRIORS.items() for x in pair])[F.col("kind")]
    value = prior * (PRESENTATION * presentation + (1 - PRESENTATION) * content)
    value = F.when(F.col("kind") == "article", F.greatest(value, F.lit(KEEP))).otherwise(value)
    judged = (whole.join(by_content, text).join(by_path, branch).select(*columns, value.alias("importance")))

    # exp(entropy) is a number of different articles in which copies hardly count.
    articles = _entropy(parts, branch, "around", "all").drop("n")
    holding = _entropy(parts, text, "around", "these").drop("n")
    by_path = _entropy(parts, branch, "style", "spread")
    known = F.exp("all") >= LEAST_PAGES - 1e-9
    share = F.exp(F.col("these") - F.col("all"))
    value = F.when(known, PRESENTATION * spread + (1 - PRESENTATION) * (1 - F.least(share, F.lit(1.0)))).otherwise(1.0)
    return judged.unionByName(parts.join(holding, text).join(articles, branch).join(by_path, branch)
                              .select(*columns, (prior * value).alias("importance")))


def extract(pages: DataFrame, url: str = "url", html: str = "html", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per row of ``pages``: columns of ``carry``, the url, ``text`` and ``n_chars``.

    Character references are decoded, white space inside a block is one blank, blocks are joined by line feeds. A null
    or empty page has an empty text. Pages without a host (null or odd urls) are one host. Equal rows are one page of the
    tree and each get their text. Broken markup is read as browsers do for the common cases: unclosed elements end with
    their parent, unknown end tags are passed over."""
    columns = list(dict.fromkeys([*carry, url]))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    source = pages.select(F.struct(*columns).alias("_row"), host.alias("_host"), F.col(html).cast("string").alias("_html"))
    source = source.withColumn("_page", F.xxhash64("_row", "_html"))
    # Several counts read the branches; pages are parsed once for all of them.
    nodes = materialize(source.select("_page", "_host", "_html").mapInArrow(
        _tree, "_page bigint, _host string, path bigint, style bigint, content bigint, kind string, around bigint"))
    kept = (importance(nodes).filter(F.col("importance") >= KEEP).groupBy("_page")
            .agg(F.collect_set(F.struct("path", "content")).alias("_kept")))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", {(k["path"], k["content"]) for k in keep or ()})
                     for h, keep in zip(batch.column("_html").to_pylist(), batch.column("_kept").to_pylist(), strict=True)]
            row = batch.column("_row")
            yield pa.RecordBatch.from_arrays(
                [row.field(i) for i in range(len(columns))] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*columns, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema["_row"].dataType.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return source.join(kept, "_page", "left").select("_row", "_html", "_kept").mapInArrow(render, f"{schema}, text string, n_chars bigint")
