"""Operator 9: main text of web pages by union-free regular expressions.

The token stream of a page is nested into elements (with the end tags that HTML
leaves out). A run of sibling elements that repeats, of one to four labels,
folds into a repeated group. Two such expressions are aligned label by label:
what both hold is merged, what only one holds becomes optional, texts that
differ become text slots. Aligning all pages of a host, one after another, gives
the host's wrapper: an expression of sequences, optional and repeated groups and
slots, without unions. A label is the tag with its class, id and role words.

The wrapper then tells where the article is. Its slots are weighed: characters
outside links that differ between pages; where pages of differing text are too
few to tell (fewer than three, copies counted once, or the heaviest block is the
same on all), all characters count. From the root, the way goes down as long as
one child holds more than half of what is left; an ``article`` or ``main`` element,
or one of that role, is evidence of its own and counts ``TAGGED`` times. Where the
way ends is the article: what is the same on all pages weighs nothing on the way, but in
the article nothing is left out for being the same. Menus, headers, footers, sidebars, notices, adverts, forms
and comments are left out by tag and by whole class, id or role words; an
``article`` or ``main`` never is, nor a header in the article. A page of which these words would
leave nothing is read without them, by tags alone. Every page is read with its host's wrapper; text
is dropped for no other reason.

Sequences are aligned along a longest common subsequence, found with bit vectors
in memory that is bounded whatever the number of siblings. Elements deeper than
``DEEPEST`` levels hang from their ancestor at that level in an expression, so its
walks are bounded; pages are read with an explicit stack at any depth.

Alignment is associative enough to reduce as a tree: tasks align the pages of
each host they hold, partial wrappers meet by (host, salt), those of the salts
by host. A host with a third of all pages so brings one small row per task. The
wrappers are written to the shared folder, so the planner knows their size when
it chooses between a broadcast and a shuffle join with the pages.

Defined results: null or empty html gives an empty text; pages whose url is null
or has no ``://`` share the host ""; unclosed, broken or cut markup is read as
far as it goes; a page without the wrapper's article, or without text in it,
falls back to its own expression, then to all of the page outside the tags that never hold an article; repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import store

SALTS, MOST_HOSTS, PERIODS = 32, 2_000, 4
#: Levels of an expression, and how many times a tagged article's weight counts.
DEEPEST, TAGGED = 48, 16
#: Bits of an alignment's table that are held at once.
TABLE_BITS = 1 << 28
#: So many pages of different text show which texts are a host's own.
DIFFERING = 3
#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg dialog menu object canvas".split())
ARTICLE = frozenset(("article", "main"))
#: Label words of what is not the article; words of layout may stand beside them ("site-footer").
_HEAD = r"(?:header|masthead)"
_AWAY = (
    r"(?:ads?|adsby\w+|adsense|ad(?:box|slot|unit|block)s?|advert\w*|sponsor\w*|promo\w*|banner|nav[^\W_]*|menu[^\W_]*|breadcrumbs?|sidebar|side|footer|"
    r"disqus|respond|notices?|cookies?|consent|gdpr|alert|newsletter|subscribe|shar(?:e|ing)|social|related|recommend\w*|popup|modal|"
    r"widget|skip|login|search|contentinfo|complementary|navigation)"
)
_LAYOUT = r"(?:site|page|main|global|primary|secondary|top|bottom|left|right|bar|box|list|links?|area|wrap(?:per)?|container|inner|outer|block|section|form|slot|unit)"
#: Words of reader comments, and of who writes them, where and what of them.
_COMMENTS = r"(?:comments?|commentlist|repl(?:y|ies)|discussion|disqus)"
_OF_COMMENTS = rf"(?:{_LAYOUT}|users?|readers?|visitors?|guests?|post|fb|facebook|thread|feed|count|item|body|content|text|author|meta|title|children|new|add|all)"
_WORDS = rf"(?:(?:{_LAYOUT}[_-]+)*{_AWAY}(?:[_-]+(?:{_AWAY}|{_LAYOUT}))*|(?:{_OF_COMMENTS}[_-]+)*{_COMMENTS}(?:[_-]+(?:{_COMMENTS}|{_OF_COMMENTS}))*)"
_HEADS = rf"(?:{_LAYOUT}[_-]+)*{_HEAD}(?:[_-]+(?:{_AWAY}|{_HEAD}|{_LAYOUT}))*"
INSIDE = re.compile(rf"(?:^|[.#@]){_WORDS}[_-]*(?=$|[.#@])")
AWAY = re.compile(rf"(?:^|[.#@])(?:{_WORDS}|{_HEADS})[_-]*(?=$|[.#@])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


def label_of(tag: str, attributes: str) -> str:
    """Tag with its class (.), id (#) and role (@) words; digits are left out of them."""
    out = tag
    if "=" in attributes:
        for name, *values in NAMED.findall(attributes):
            mark = {"class": ".", "id": "#", "role": "@"}[name.lower()]
            for word in sorted(set(re.sub(r"\d+", "", "".join(values)).lower().split())):
                out += mark + word
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('open', tag, label), ('close', tag, '') and ('text', '', text) in order; comments and raw texts are skipped."""
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if tag := (m[2] or "").lower():
            if m[1]:
                yield "close", tag, ""
            else:
                yield "open", tag, label_of(tag, m[3] or "")
                if tag in RAW and not (m[3] or "").endswith("/"):
                    end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                    at = end.start() if end else len(page)
    if at < len(page):
        yield "text", "", page[at:]


def walk(page: str) -> Iterator[tuple[str, list, str]]:
    """Token events with the stack of open (tag, label) elements; end tags that HTML leaves out are supplied."""
    stack: list[tuple[str, str]] = []
    held: Counter[str] = Counter()

    def pop() -> str:
        tag = stack.pop()[0]
        held[tag] -= 1
        return tag

    for kind, tag, value in tokens(page):
        if kind == "text":
            yield "text", stack, value
        elif kind == "open":
            if tag in ENDS_P and held["p"]:
                while (top := pop()) != "p":
                    yield "pop", stack, top
                yield "pop", stack, top
            if tag in SAME_ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in STOPS[tag]:
                        break
                    if stack[i][0] in SAME_ENDS[tag]:
                        while len(stack) > i:
                            top = pop()
                            yield "pop", stack, top
                        break
            stack.append((tag, value))
            held[tag] += 1
            yield "push", stack, tag
            if tag in VOID:
                top = pop()
                yield "pop", stack, top
        elif held[tag]:
            while True:
                top = pop()
                yield "pop", stack, top
                if top == tag:
                    break
    while stack:
        top = pop()
        yield "pop", stack, top


# An expression node: [label, optional, repeated, children, text, mass, linked, same].
# text is the node's own text if it was the same wherever seen, else None (a slot);
# mass and linked are characters of own text, and of such inside links; same is a
# digest of the texts that one page has for the node, None if pages differ in it.
LABEL, OPTIONAL, REPEATED, CHILDREN, TEXT, MASS, LINKED, SAME = range(8)
GROUP = "()"


def _node(label: str) -> list:
    return [label, False, False, [], "", 0, 0, ""]


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _key(node: list) -> str:
    """What nodes are aligned by: the label; for a group, its members' labels."""
    return node[LABEL] if node[LABEL] != GROUP else GROUP + "".join(f"<{_key(c)}>" for c in node[CHILDREN])


def merge(a: list, b: list, within: bool = False) -> list:
    """Align two nodes of one key: of two pages, or ``within`` one page."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    if not within or a[SAME] is None or b[SAME] is None:
        same = a[SAME] if a[SAME] == b[SAME] else None
    else:
        same = _digest(f"{a[SAME]} {b[SAME]}") if a[SAME] or b[SAME] else ""
    children = align(a[CHILDREN], b[CHILDREN], within)
    return [a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], children, text, a[MASS] + b[MASS], a[LINKED] + b[LINKED], same]


def _maybe(node: list) -> list:
    return [node[LABEL], True, *node[REPEATED:]]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each item of ``b``, a bit vector of the longest common subsequence with ``a``: bit i is 0 where a[i] lengthens it."""
    where: dict[int, int] = {}
    for i, k in enumerate(a):
        where[k] = where.get(k, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for k in b:
        u = v & where.get(k, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a[:i] and b, for each i."""
    v = (1 << len(a)) - 1
    for v in _rows(a, b):  # noqa: B007  the last one counts
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list[str], b: list[str], table_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence; sequences too long for one table are halved."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(k, len(number)) for k in keys] for keys in (a, b))
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and x[m - 1] == y[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) > table_bits and n - j > 1:
            half = (j + n) // 2
            before, after = _lengths(x[i:m], y[j:half]), _lengths(x[i:m][::-1], y[half:n][::-1])[::-1]
            cut = i + int((before + after).argmax())
            todo += [(i, cut, j, half), (cut, m, half, n)]
            continue
        table = list(_rows(x[i:m], y[j:n]))
        p, q = m - i, n - j
        while p and q:
            if table[q - 1] >> (p - 1) & 1:
                p -= 1
            else:
                q -= 1
                if not q or table[q - 1] >> (p - 1) & 1:
                    p -= 1
                    out.append((i + p, j + q))
    return sorted(out)


def align(a: list, b: list, within: bool = False) -> list:
    """Align two sequences along a longest common subsequence of keys; the rest becomes optional."""
    ka, kb = [_key(n) for n in a], [_key(n) for n in b]
    if ka == kb:
        return [merge(x, y, within) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*common(ka, kb), (len(a), len(b))]:
        out += [_maybe(n) for n in a[i:p]] + [_maybe(n) for n in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], within))
        i, j = p + 1, q + 1
    return fold(out)


def fold(nodes: list) -> list:
    """Fold runs that repeat, of one label first and then of up to PERIODS labels, into repeated groups."""
    for period in range(1, PERIODS + 1):
        if len(nodes) < 2 * period:
            break
        keys, out, i = [_key(n) for n in nodes], [], 0
        while i < len(nodes):
            n = 1
            while keys[i : i + period] == keys[i + n * period : i + (n + 1) * period] and len(keys[i : i + period]) == period:
                n += 1
            if n == 1:
                out.append(nodes[i])
                i += 1
                continue
            units = [nodes[i + j * period : i + (j + 1) * period] for j in range(n)]
            first = units[0]
            for unit in units[1:]:
                first = [merge(x, y, True) for x, y in zip(first, unit, strict=True)]
            if period == 1:
                first[0][REPEATED], first[0][OPTIONAL] = True, all(u[0][OPTIONAL] for u in units)
                out += first
            else:
                out.append([GROUP, False, True, first, "", 0, 0, ""])
            i += n * period
        nodes = out
    return nodes


def _close(node: list) -> None:
    """Fold a whole node's children; a long text stands as its beginning and the digest of all of it."""
    node[CHILDREN] = fold(node[CHILDREN])
    text = " ".join(node[TEXT])
    node[SAME] = _digest(text) if text else ""
    node[TEXT] = text if len(text) <= 200 else f"{text[:200]}\0{node[SAME]}"


def expression(page: str) -> list:
    """The expression of one page."""
    root, path = _node("#"), []
    root[TEXT] = []
    path.append(root)
    links = 0
    for kind, stack, value in walk(page):
        if kind == "push":
            node = _node(stack[-1][1])
            node[TEXT] = []
            path[min(len(path) - 1, DEEPEST)][CHILDREN].append(node)
            path.append(node)
            links += value == "a"
        elif kind == "pop":
            node = path.pop()
            _close(node)
            links -= value == "a"
        elif text := SPACE.sub(" ", value).strip():
            node = path[-1]
            node[TEXT].append(text)
            node[MASS] += len(text)
            node[LINKED] += len(text) if links else 0
    _close(root)
    return root


def _is_away(label: str, in_article: bool) -> bool:
    tag = re.split(r"[.#@]", label, maxsplit=1)[0]
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if _is_article(label):
        return False
    return tag not in ("html", "body") and tag != label and bool((INSIDE if in_article else AWAY).search(label[len(tag) :]))


def _is_article(label: str) -> bool:
    return re.split(r"[.#@]", label, maxsplit=1)[0] in ARTICLE or bool(re.search(r"@main(?=$|[.#@])", label))


def _members(node: list) -> Iterator[list]:
    for child in node[CHILDREN]:
        if child[LABEL] == GROUP:
            yield from _members(child)
        else:
            yield child


def page_key(node: list) -> str:
    """Digest of a page's text outside menus and the like: the same for copies."""
    out: list[str] = []

    def gather(at: list) -> None:
        out.append(at[SAME] or "")
        for child in _members(at):
            if not _is_away(child[LABEL], False):
                gather(child)

    gather(node)
    return _digest(" ".join(x for x in out if x))


def _step(path: int, label: str) -> int:
    """Number of the path that leads one label further."""
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), path)


def plan(wrapper: list, differing: int) -> dict:
    """What a page is read by: the label path of the article.

    ``differing`` is the number of pages of different text that the wrapper was met on.
    """

    def shown(node: list) -> list:
        return [c for c in _members(node) if not _is_away(c[LABEL], False)]

    def heaviest(node: list) -> list:
        return max([node, *(heaviest(c) for c in shown(node))], key=lambda n: n[MASS] - n[LINKED])

    top = heaviest(wrapper)
    articles_differ = differing >= DIFFERING and (top[SAME] is None or top[OPTIONAL])
    weights: dict[int, int] = {}

    def weigh(node: list) -> int:
        """Characters of the slots below, kept for each node."""
        own = max(0, node[MASS] - node[LINKED])
        if node[TEXT] and articles_differ and not node[OPTIONAL]:
            own = 0
        own += sum(weigh(c) for c in shown(node))
        weights[id(node)] = own * TAGGED if _is_article(node[LABEL]) else own
        return weights[id(node)]

    node, path = wrapper, 0
    weigh(wrapper)
    while not _is_article(node[LABEL]):
        best = max(shown(node), key=lambda c: weights[id(c)], default=None)
        if best is None or not weights[id(best)] or weights[id(best)] * 2 <= weights[id(node)]:
            break
        tag = re.split(r"[.#@]", best[LABEL], maxsplit=1)[0]
        if not _is_article(best[LABEL]) and (best[REPEATED] or tag in ("p", "h1", "h2", "h3", "ul", "ol", "table", "blockquote", "pre") or tag in INLINE):
            break
        node, path = best, _step(path, best[LABEL])
    return {"root": path}


def read(page: str, how: dict, words: bool = True) -> str | None:
    """Text of the article's slots by ``how``; None if the page has none of the article's elements.

    Without ``words`` only tags tell what is not the article.
    """
    root = how["root"]
    blocks, parts, paths = [], [], [0]
    inside, away, met = int(root == 0), 0, root == 0
    marks: list[tuple[bool, bool]] = []
    for kind, stack, value in walk(page):
        if kind == "text":
            if inside and not away:
                parts.append(value)
            continue
        if value == "br":
            parts.append(" ")
        elif value not in INLINE and parts:
            blocks.append("".join(parts))
            parts = []
        if kind == "push":
            label = stack[-1][1]
            paths.append(_step(paths[min(len(paths) - 1, DEEPEST)], label))
            start, gone = paths[-1] == root, _is_away(label if words else value, inside > 0)
            marks.append((start, gone))
            inside, away, met = inside + start, away + gone, met or start
        else:
            paths.pop()
            start, gone = marks.pop()
            inside, away = inside - start, away - gone
    blocks.append("".join(parts))
    if not met:
        return None
    lines = (SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(page: str | None, how: dict | None) -> str:
    """Main text of a page by its host's plan, or by its own expression if that does not fit."""
    if not page:
        return ""
    return (read(page, how) if how else None) or read(page, plan(expression(page), 1)) or read(page, {"root": 0}, words=False) or ""


def host_of(url: Column) -> Column:
    """Host of a url: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"\A([^/?#]*)", 1), F.lit(""))


SCHEMA = "host string, wrapper string, pages long, keys array<string>"


def _few(keys: set[str]) -> list[str]:
    """The smallest DIFFERING keys: enough to tell whether there are so many."""
    return sorted(keys)[:DIFFERING]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the pages of each host that this task holds."""
    held: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, json.dumps(w), n, k) for h, (w, n, k) in held.items()]
        held.clear()
        types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["host", "wrapper", "pages", "keys"])

    for batch in batches:
        for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if page:
                own = expression(page)
                key = page_key(own)
                if host in held:
                    wrapper, n, keys = held[host]
                    held[host] = [merge(wrapper, own), n + 1, _few({*keys, key})]
                else:
                    held[host] = [own, 1, [key]]
            if len(held) >= MOST_HOSTS:
                yield out()
    if held:
        yield out()


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["wrapper"])
    wrapper = None
    for text in rows["wrapper"]:
        own = json.loads(text)
        wrapper = own if wrapper is None else merge(wrapper, own)
    keys = _few({k for own in rows["keys"] for k in own})
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "pages": [int(rows["pages"].sum())], "keys": [keys]})


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, pages, keys): one wrapper per host, as JSON; keys are at most DIFFERING page keys."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    partial = rows.mapInArrow(_partial, SCHEMA)
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    met = salted.groupBy("host", "salt").applyInPandas(_joined, SCHEMA)
    return met.groupBy("host").applyInPandas(_joined, SCHEMA)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    wrappers = store.written(infer(pages, url, html), "wrappers")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper", F.size("keys").alias("differing"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple[str, int], dict] = {}
        for batch in batches:
            out = []
            for page, wrapper, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if wrapper is not None and (wrapper, n) not in plans:
                    if len(plans) >= MOST_HOSTS:
                        plans.clear()
                    plans[wrapper, n] = plan(json.loads(wrapper), n)
                out.append(extract(page, plans.get((wrapper, n))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
