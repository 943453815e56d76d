"""Main text of web pages by a site style tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import discard, materialize, small
from tidemark.llm._text import lean

#: Pages of a site that must have a node before it is judged, and the importance below which its branch goes.
PAGES, IMPORTANCE = 4, 0.625
#: Shares in a node's importance of what pages declare it to be and of its presentation; the rest is its content's.
DECLARED, PRESENTATION = 0.5, 0.05
#: In a declared article a repeated text goes if at least this share of the pages of its node have it, and if of these
#: pages at least the second share have different sketches: near copies of one page repeat its text as well.
SHARE, DIFFERENT = 0.05, 0.5
#: Parts that the pages of one site are dealt to where they meet the site's noise.
_SALTS = 64
#: Pages of a batch whose blocks are held at once.
_PAGES_AT_ONCE = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?|([^<]+)|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements of HTML by how they are parsed and what they are for.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_NOISE = frozenset("nav footer aside form script style noscript template iframe svg button select dialog head menu textarea title object canvas audio video datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body html td th tr tbody tfoot thead legend".split())
_SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPES = frozenset("ul ol dl table html body article section main aside nav div form td th".split())
_CONTENT = {"main": 1, "article": 2}
_NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar comment comments disqus replies respond cookie cookies consent notice notices alert alerts gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended widget pagination pager copyright toolbar masthead".split()
)
#: Words that a name may have beside one of the above and still mean the same ("comment-list", "site-nav-2"); any other
#: word ("has-sidebar", "ad-free") makes it a name that tells nothing.
_PLAIN_NAMES = frozenset(
    "site page global main primary secondary top bottom left right inner outer box block bar wrap wrapper container area section list item items group panel content module unit slot zone region holder text link links post posts article articles story stories button buttons icon icons title body label fixed sticky mobile desktop small large form head header".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def _named_noise(value: str, inside: bool) -> bool:
    """Whether one of the names in a class or an id says that the element is no part of the article."""
    for name in value.split():
        parts = {x.lower() for x in _NAME_PARTS.findall(name) if not x.isdigit()}
        if parts <= _NOISE_NAMES | _PLAIN_NAMES and (not _NOISE_NAMES.isdisjoint(parts) or (not inside and "header" in parts)):
            return True
    return False


def _declared(tag: str, attributes: str, inside: bool) -> tuple[bool, int, str]:
    """(whether the element is declared noise; 2 if it is declared an article, 1 the main part; what tells it from its
    siblings). ``inside``: it stands in an article, whose header belongs to it."""
    noise, content, names = tag in _NOISE or (tag == "header" and not inside), _CONTENT.get(tag, 0), ""
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names += f" {value}"
                noise |= tag not in ("html", "body", "main") and _named_noise(value, inside)
            elif name == "role":
                noise |= value.lower() in _NOISE_ROLES
                content = max(content, _CONTENT.get(value.lower(), 0))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                noise |= tag not in ("html", "body")
    return noise, content, tag + names


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def read(page: str) -> tuple[list[tuple[int, str, bool]], list[tuple[int, int, int]], bool]:
    """What :func:`_read` gives; but an element that holds more than half of the page's text is no noise, whatever it is
    called, if all that isn't declared noise is less than a tenth of the text and no part of an article or main part:
    forms, hidden application roots and the like that pages are wrapped in."""
    found, wrappers = _read(page, frozenset())
    while wrappers:  # one declared within another
        spared = wrappers
        found, wrappers = _read(page, spared)
        wrappers = (wrappers | spared) if wrappers - spared else frozenset()
    return found


def _read(page: str, spared: frozenset[int]) -> tuple[tuple[list[tuple[int, str, bool]], list[tuple[int, int, int]], bool], frozenset[int]]:
    """Blocks of text (style-tree node, text, whether the page declares it a part of its main text), facts for the
    site's tree, and whether the page declares an article or a main part.

    Elements declare noise (menus, footers, forms, adverts, comments and the like) by their tag, role, class or id. A
    branch that holds an article or main part with more than half of the page's text is none, whatever it is called.
    If the articles, or else the main parts, hold at least half of the text that is not declared noise, what stands
    outside of them is declared to be something else too.

    A node is the same for pages of the site that are laid out alike so far: a hash of its parent, its kind (element,
    classes) and its place among the parent's children of this kind, where the last of several counts as such. Facts
    are (node, presentation, content) of every block, declared noise among them.
    """
    tags, parents, noise, loud, content, within, styles, place = ["#"], [-1], [False], [False], [0], [0], [[]], [("", 0)]
    like: dict[tuple[int, str], int] = {}  # children of a node by kind
    stack: list[int] = [0]
    runs: list[tuple[int, list[str]]] = []  # (node, texts) of each block
    open_runs: list[int | None] = [None, None]  # of the block at hand: of its text, and of declared noise in it
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m[7]
        if text is not None or m[0] == "<":
            text = text if text is not None else "<"
            text = html.unescape(text) if "&" in text else text
            # A run stays in the element it began in: inline elements belong to the block around them, noise in it doesn't.
            top = stack[-1]
            run = open_runs[loud[top]]
            if run is None:
                open_runs[loud[top]] = len(runs)
                runs.append((top, [text]))
            else:
                runs[run][1].append(text)
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue  # a comment or a declaration
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in _BLOCK:
                open_runs = [None, None]
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == tag:
                    del stack[k:]
                    break
                if tags[stack[k]] in _SCOPES and tag not in _SCOPES:
                    break
            continue
        if tag == "br":
            for run in open_runs:
                if run is not None:
                    runs[run][1].append(" ")
            continue
        if tag in _BLOCK:
            open_runs = [None, None]
        if tag in _VOID:
            continue
        for closed in (_SIBLINGS.get(tag, ()), ("p",) if tag in _CLOSES_P else ()):
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in closed:
                    del stack[k:]
                    break
                if tags[stack[k]] in _SCOPES:
                    break
        top = stack[-1]
        told, kind, sign = _declared(tag, m[3] if m[2] else m[6], within[top] == 2)
        node = len(tags)
        told = told and node not in spared
        tags.append(tag), parents.append(top), noise.append(told), loud.append(told or loud[top]), content.append(kind), within.append(max(0 if told else kind, within[top]))
        place.append((sign, like.get((top, sign), 0))), styles[top].append(sign), styles.append([])
        like[top, sign] = place[-1][1] + 1
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if (m[3] or "").rstrip().endswith("/") and tag not in _BLOCK:
            continue
        stack.append(node)

    texts = [(node, " ".join("".join(parts).split())) for node, parts in runs]
    texts = [(node, t) for node, t in texts if t]
    size = [0] * len(tags)
    for node, t in texts:
        size[node] += len(t)
    for node in range(len(tags) - 1, 0, -1):
        size[parents[node]] += size[node]
    noisy, holds = [False] * len(tags), [False] * len(tags)
    for node in range(1, len(tags)):
        if content[node] and not noise[node] and 2 * size[node] > size[0]:
            while node > 0 and not holds[node]:
                holds[node], node = True, parents[node]
    for node in range(1, len(tags)):
        noisy[node] = noisy[parents[node]] or (noise[node] and not holds[node])
        within[node] = within[parents[node]] if noisy[node] else max(content[node], within[parents[node]])
    plain = [0, 0, 0]  # text that is not declared noise: all, in main parts and articles, in articles
    for node, t in texts:
        if not noisy[node]:
            for k in range(within[node] + 1):
                plain[k] += len(t)
    part = next((k for k in (2, 1) if plain[k] and 2 * plain[k] >= plain[0]), 0)
    wrappers = frozenset()
    if not plain[1] and 10 * plain[0] < size[0]:
        wrappers = frozenset(k for k in range(1, len(tags)) if noise[k] and 2 * size[k] > size[0])
    keys: dict[int, int] = {0: 1}

    def key(node: int) -> int:
        path = []
        while node not in keys:
            path.append(node)
            node = parents[node]
        for x in reversed(path):
            sign, nth = place[x]
            keys[x] = _hash(keys[parents[x]], sign, "last" if nth and nth == like[parents[x], sign] - 1 else nth)
        return keys[path[0]] if path else keys[node]

    blocks, facts, seen = [], [], {}
    for node, t in texts:
        k = seen[node] = seen.get(node, 0) + 1
        own = _hash(key(node), k)
        blocks.append((own, t, not noisy[node] and within[node] >= part))
        facts.append((own, _hash("|".join(styles[node])), _hash(t)))
    return (blocks, facts, part > 0), wrappers | spared if wrappers else wrappers


def _sketch(blocks: list[tuple[int, str, bool]]) -> int:
    """The least hash of three words in a row: mostly the same for near copies of a page, and only for these."""
    words = " ".join(t for _, t, _ in blocks).split()
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) - (1 << 63)


def _host(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _entropy(kind: str) -> list:
    """Sums from which the entropy of a node's variants follows: n log n over variants."""
    return [F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias(kind)]


def site_noise(pages: DataFrame) -> DataFrame:
    """``host, noise``: marks of what is of low importance in each site's style tree (``page_id, url, html`` pages).

    All pages of a host are merged: for each node, how many pages have it, and how its presentations (the children's
    elements) and its contents spread over them. Both count by their entropy, to the base of the pages: 1 if all
    differ and 0 if all are the same. What a page declares a block to be is one more feature of its presentation. Marks
    are hashes of a node and what its block is declared to be (0 something else, 1 main text, 2 main text of a page
    that declares no article); of blocks in declared articles (1) only contents are marked that the site repeats.
    """
    schema = pa.schema([("host", pa.string()), ("node", pa.int64()), ("style", pa.int64()), ("content", pa.int64()), ("sketch", pa.int64()), ("role", pa.int32())])

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, _PAGES_AT_ONCE):
                part = batch.slice(some, _PAGES_AT_ONCE)
                out = []
                for url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    blocks, found, declared = read(page or "")
                    host, sketch = _host(url), _sketch(blocks)
                    out += [(host, *f, sketch, _role(may, declared)) for f, (_, _, may) in zip(found, blocks, strict=True)]
                columns = list(zip(*out, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = materialize(pages.select("url", "html").mapInArrow(lean(facts), "host string, node long, style long, content long, sketch long, role int"), "facts")
    each = {}
    for kind in ("style", "content"):
        spread = found.groupBy("host", "node", kind).agg(F.count(F.lit(1)).alias("n")).groupBy("host", "node").agg(*_entropy("e"))
        each[kind] = spread.where(F.col("m") >= PAGES).select("host", "node", "m", (1 - F.col("e") / (F.col("m") * F.log("m"))).alias(kind))
    spread = PRESENTATION * F.col("style") + (1 - DECLARED - PRESENTATION) * F.col("content")
    judged = each["style"].join(each["content"].drop("m"), ["host", "node"]).withColumn("role", F.explode(F.array(F.lit(0), F.lit(1))))
    low = judged.where(DECLARED * F.col("role") + spread < IMPORTANCE)
    low = materialize(low.select("host", "node", "m", "role"), "low")  # as many as the sites' templates have nodes
    kinds = found.where("role > 0").join(small(low.where("role = 1").drop("role")), ["host", "node"]).groupBy("host", "node", "m", "content", "sketch").agg(F.count(F.lit(1)).alias("n"))
    texts = kinds.groupBy("host", "node", "m", "content").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))
    texts = texts.where((F.col("n") >= SHARE * F.col("m")) & (F.col("different") >= F.greatest(F.lit(PAGES), DIFFERENT * F.col("n"))))
    nodes = low.select("host", F.xxhash64("node", F.when(F.col("role") == 1, 2).otherwise(0)).alias("mark"))
    marks = nodes.unionByName(texts.select("host", F.xxhash64("node", F.lit(1), "content").alias("mark")))
    noise = materialize(marks.groupBy("host").agg(F.collect_list("mark").alias("noise")), "noise")  # at most 2 + 1 / SHARE a node
    discard(found, low)
    return noise


def _role(may: bool, declared: bool) -> int:
    return (1 if declared else 2) if may else 0


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, its blocks joined by line breaks.

    The site's style tree decides (see :func:`site_noise`): blocks of low importance go. Of the main text of a page
    that declares an article only repeated contents go. Nodes that fewer than PAGES pages of a site have are not judged: there the
    page's own declarations decide. Character references are decoded, white space inside a block becomes one space. A
    null or empty page has an empty text; pages without an address form one site. Null ids and repeated rows are kept
    as they are (repeated pages count as pages of their site); other columns are not read, so that their names don't
    matter; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    noise = site_noise(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    kinds = rows.schema
    block = pa.struct([("node", pa.int64()), ("content", pa.int64()), ("role", pa.int32()), ("text", pa.string())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, _PAGES_AT_ONCE):
                part, found = batch.slice(some, _PAGES_AT_ONCE), []
                for page in part.column(2).to_pylist():
                    all_blocks, facts, declared = read(page or "")
                    found.append([{"node": k, "content": f[2], "role": _role(may, declared), "text": t} for (k, t, may), f in zip(all_blocks, facts, strict=True)])
                hosts = [_host(u) for u in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(found, pa.list_(block))], names=["page_id", "url", "host", "blocks"])

    parsed = rows.mapInArrow(lean(blocks), f"page_id {kinds['page_id'].dataType.simpleString()}, url string, host string, blocks array<struct<node:long,content:long,role:int,text:string>>")
    parsed = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int")).join(noise, ["host", "salt"], "left")
    mark = lambda b: F.when(b["role"] == 1, F.xxhash64(b["node"], F.lit(1), b["content"])).otherwise(F.xxhash64(b["node"], b["role"]))
    low = lambda b: F.coalesce(F.array_contains("noise", mark(b)), F.lit(False))
    # A block that its page declares something else has no importance where the site has too few such pages to tell.
    kept = F.filter("blocks", lambda b: ~low(b) & (b["role"] > 0))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return parsed.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
