"""Main text of web pages by wrapper induction.

One page of each host is its pivot. Every page's DOM tree is aligned with its host's pivot by simple tree matching (equal
tags, children in order, most matched nodes). A matched node takes the pivot node's path of tags and names and is told by
that node; any other by its own path and its place among such nodes. Spark then counts which texts recur at a path on
another page. Nodes whose text recurs on most pages of the host are template, whether it is one text or some that
rotate; nodes whose text varies are slots, and slots are content. The name of the host within a text is a variable.

Texts do not recur between copies: pages are told apart by the least hash of their GRAM-word shingles, which near copies
mostly share. Hosts of few pages borrow from all others: a path counts as PRIOR more pages, of which its texts recur
as often as they do at that path anywhere. A page that is alone on its host is so cut by what all hosts show.

Names only break ties among what induction leaves over: slots that are no article, as reader comments, per-page
adverts and related links, and nodes of which nothing is known. Of these, elements that HTML or their names declare as
boilerplate go, and where an article or main element exists, so do those outside of it. extract(names=False) leaves
this out; extract(induce=False) leaves out the method itself and returns the whole text of a page.

Defined cases: null html gives an empty text; pages whose url is null or has no host are each a host of their own;
repeated rows are separate rows; an empty table gives an empty table; other columns are ignored; nesting of any depth is
aligned without recursion.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import saved, small_batches

#: Pages that what is known of a path weighs, and the share of pages with a recurring text from which a node is template.
PRIOR = 8
SHARE = 0.5
GRAM = 4
BROADCAST_BYTES = 32 << 20
#: What a recurring text takes in a broadcast table: two hashes and its place there.
RECURRING_BYTES = 64
#: Copies of each host's template in the join that replaces a broadcast, so that a large host is dealt to as many tasks.
SALTS = 16
#: Pivots are chosen among pages up to this long, if the host has any.
PIVOT_CHARS = 1 << 16
#: Child lists whose sizes' product is above this are aligned by halves, in linear memory, with the same score.
CELLS = 1 << 16

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SILENT = frozenset("head script style title noscript template iframe object svg math canvas audio video button select input textarea datalist".split())
#: Elements that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus related recommended pagination pager search toolbar".split())


def hash_of(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Dom(HTMLParser):
    """Nodes in document order as parallel lists, and text blocks with the node that they stand in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.names, self.role = ["#"], [-1], [frozenset()], [""]
        self.stack = [0]
        self.silent = 0  # open elements whose text is none
        self.blocks: list[tuple[int, str]] = []
        self.run: list[str] = []
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self) -> None:
        if self.run:
            if text := " ".join("".join(self.run).split()):
                at = next(n for n in reversed(self.stack) if n == 0 or self.tag[n] in BLOCK)
                self.blocks.append((at, text))
            self.run = []

    def _pop_to(self, depth: int) -> None:
        tags = [self.tag[n] for n in self.stack[depth:]]
        if not BLOCK.isdisjoint(tags):
            self._flush()
        self.silent -= sum(t in SILENT for t in tags)
        del self.stack[depth:]

    def _close_head(self) -> None:
        for d, n in enumerate(self.stack):
            if self.tag[n] == "head":
                self._pop_to(d)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or (self.tag[self.stack[-1]] == "head" and tag not in IN_HEAD):
            self._close_head()
        if tag in CLOSES_P:
            for d in range(len(self.stack) - 1, 0, -1):
                t = self.tag[self.stack[d]]
                if t == "p":
                    self._pop_to(d)
                    break
                if t in BLOCK:
                    break
        if tag in ITEMS:
            for d in range(len(self.stack) - 1, 0, -1):
                t = self.tag[self.stack[d]]
                if t in SCOPES[tag]:
                    break
                if t in ITEMS[tag]:
                    self._pop_to(d)
                    if tag != "tr" or t == "tr":
                        break
        if tag in BLOCK:
            self._flush()
        if tag == "br":
            self.run.append("\n")
        if tag in ("br", "wbr"):
            return
        node = len(self.tag)
        known = dict(attrs) if attrs else {}
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        words = f"{known.get('class') or ''} {known.get('id') or ''}".strip()
        self.names.append(frozenset(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower())) if words else frozenset())
        self.role.append((known.get("role") or "").lower())
        if tag not in VOID:
            self.stack.append(node)
            self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for d in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[d]]
            if t == tag:
                self._pop_to(d)
                return
            if t in BLOCK and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if self.tag[self.stack[-1]] == "head" and data.strip():
            self._close_head()
        if not self.silent:
            self.run.append(data)

    def texts(self, host: str | None) -> dict[int, int]:
        """A hash of each node's own blocks, by node in page order."""
        out: dict[int, list[str]] = {}
        for n, t in self.blocks:
            out.setdefault(n, []).append(t.replace(host, "") if host else t)
        return {n: hash_of("\n".join(t)) for n, t in out.items()}

    def paths(self) -> list[int]:
        """For each node a hash of the tags and names from the root to it; digits in names do not count."""
        out = [0] * len(self.tag)
        for n in range(1, len(self.tag)):
            names = sorted({re.sub(r"\d+", "", w) for w in self.names[n]})
            out[n] = hash_of(f"{out[self.parent[n]]}/{self.tag[n]}.{'.'.join(names)}")
        return out


class Shape:
    """Children lists and, for each node, a hash of its subtree's tags and its size: equal hashes match as wholes."""

    def __init__(self, tag: list[str], parent: list[int]):
        self.tag = tag
        self.kids: list[list[int]] = [[] for _ in tag]
        for n in range(1, len(tag)):
            self.kids[parent[n]].append(n)
        self.size, self.key = [1] * len(tag), [0] * len(tag)
        for n in range(len(tag) - 1, -1, -1):
            self.key[n] = hash((tag[n], *[self.key[k] for k in self.kids[n]]))
            self.size[n] += sum(self.size[k] for k in self.kids[n])


def match_score(a: Shape, b: Shape, x: int, y: int, memo: dict) -> int:
    """Most nodes that an order-keeping, root-to-root matching of two subtrees has. Scores are kept by shape in memo;
    what a pair needs is worked off from a list, so depth costs no stack."""
    todo = [(x, y)]
    while todo:
        p, q = todo[-1]
        pair = a.key[p], b.key[q]
        if pair in memo:
            todo.pop()
        elif a.tag[p] != b.tag[q]:
            memo[pair] = 0
        elif pair[0] == pair[1]:
            memo[pair] = a.size[p]
        else:
            ours = list({a.key[k]: k for k in a.kids[p]}.values())
            theirs = list({b.key[k]: k for k in b.kids[q]}.values())
            needs = [(i, j) for i in ours for j in theirs if (a.key[i], b.key[j]) not in memo]
            if needs:
                todo += needs
            else:
                memo[pair] = 1 + int(_best_scores(a, b, a.kids[p], b.kids[q], memo)[-1])
                todo.pop()
    return memo[a.key[x], b.key[y]]


def _best_scores(a: Shape, b: Shape, xs: list[int], ys: list[int], memo: dict) -> np.ndarray:
    """The best score of xs with each beginning of ys, of known scores. Subtrees of one shape score alike."""
    if len(xs) == 1 and len(ys) == 1:
        return np.array([0, memo[a.key[xs[0]], b.key[ys[0]]]])
    shapes: dict[int, int] = {}
    of = np.fromiter((shapes.setdefault(b.key[y], len(shapes)) for y in ys), np.int64, len(ys))
    scores: dict[int, np.ndarray] = {}
    best = np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        if (score := scores.get(a.key[x])) is None:
            scores[a.key[x]] = score = np.array([memo[a.key[x], k] for k in shapes], np.int64)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + score[of]))
    return best


def _align(a: Shape, b: Shape, xs: list[int], ys: list[int], memo: dict) -> list[tuple[int, int]]:
    """Pairs of a best order-keeping matching of two child lists. Equal subtrees at both ends match in some best one; long
    rests are halved where the best scores of the first half of xs and of the second add up to most."""
    out, todo = [], [(xs, ys)]
    while todo:
        xs, ys = todo.pop()
        least, head, tail = min(len(xs), len(ys)), 0, 0
        while head < least and a.key[xs[head]] == b.key[ys[head]]:
            head += 1
        while tail < least - head and a.key[xs[-1 - tail]] == b.key[ys[-1 - tail]]:
            tail += 1
        out += zip(xs[:head], ys[:head], strict=True)
        out += zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if not xs or not ys:
            continue
        for x in {a.key[x]: x for x in xs}.values():
            for y in {b.key[y]: y for y in ys}.values():
                match_score(a, b, x, y, memo)
        if len(xs) > 1 and len(xs) * len(ys) > CELLS:
            half = len(xs) // 2
            cut = int(np.argmax(_best_scores(a, b, xs[:half], ys, memo) + _best_scores(a, b, xs[: half - 1 : -1], ys[::-1], memo)[::-1]))
            todo += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
            continue
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            up, row = rows[-1], [0]
            for j, y in enumerate(ys):
                s = memo[a.key[x], b.key[y]]
                row.append(max(up[j + 1], row[j], up[j] + s if s else 0))
            rows.append(row)
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
    return out


def matched(a: Shape, b: Shape) -> dict[int, int]:
    """Nodes of a to nodes of b."""
    memo: dict = {}
    out, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo += zip(a.kids[x], b.kids[y], strict=True) if a.key[x] == b.key[y] else _align(a, b, a.kids[x], b.kids[y], memo)
    return out


def declared(dom: Dom) -> list[bool]:
    """Nodes that lie in declared boilerplate, or outside of the page's article and main elements if it has such."""
    n = len(dom.tag)
    main, holds, out = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        main[k] = main[dom.parent[k]] or dom.tag[k] in ("article", "main") or dom.role[k] == "main"
    for k in range(n - 1, 0, -1):
        if dom.tag[k] in ("article", "main", "h1") or holds[k]:
            holds[dom.parent[k]] = True
    for k in range(1, n):
        t, spoken = dom.tag[k], dom.names[k] & {"comment", "comments"}
        named = (bool(dom.names[k] & NAMES) or dom.role[k] in ROLES) and t not in ("html", "body", "main") and (bool(spoken) or not holds[k])
        out[k] = out[dom.parent[k]] or t in BOILERPLATE or (t == "header" and not main[k]) or named
    if any(main[k] and not out[k] for k, _ in dom.blocks):
        out = [o or not m for o, m in zip(out, main, strict=True)]
    return out


def pivot_of(html: str) -> bytes:
    dom = Dom(html)
    return pickle.dumps((dom.tag, dom.parent, dom.paths()))


def said(texts: list[str]) -> int:
    """The least hash of the shingles of a page's words."""
    words = " ".join(texts).encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    m = max(1, len(h) - GRAM + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(GRAM, len(h))):
        out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return int(out.min().view(np.int64))


def page_nodes(html: str | None, host: str | None = None, pivot: tuple[Shape, list[int]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, bool, str]]]:
    """Nodes with text of a page as (key, path, hash of the text), and its blocks as (key, declared, text). pivot: its
    shape and its nodes' paths."""
    dom = Dom(html or "")
    own = dom.texts(host)
    to = matched(Shape(dom.tag, dom.parent), pivot[0]) if pivot and own else {}
    paths, out = dom.paths() if own else [], declared(dom) if own else []
    place: dict[int, int] = {}
    key, path = {}, {}
    for n in own:
        if n in to:
            key[n], path[n] = to[n], pivot[1][to[n]]
        else:
            path[n] = paths[n]
            key[n] = hash_of(f"{path[n]} {place.setdefault(path[n], 0)}")
            place[path[n]] += 1
    return [(key[n], path[n], h) for n, h in own.items()], [(key[n], out[n], t) for n, t in dom.blocks]


KNOWN = "page_id bigint, url string, host string, said bigint, nodes array<struct<key:bigint, path:bigint, text:bigint>>, packed binary"


def _aligner(shared):
    """shared: broadcast of host to pivot bytes, or None where rows bring a column pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict = {}

        def pivot(host, data):
            if data is None:
                return None
            if host not in ready:
                if len(ready) >= 4096:
                    ready.clear()
                tag, parent, paths = pickle.loads(data)
                ready[host] = Shape(tag, parent), paths
            return ready[host]

        for b in batches:
            datas = [shared.value.get(h) for h in b["host"]] if shared else b["pivot"]
            found = [page_nodes(h, host, pivot(host, d)) for h, host, d in zip(b["html"], b["host"], datas, strict=True)]
            b["said"] = [said([t for _, _, t in blocks]) for _, blocks in found]
            b["nodes"] = [[{"key": k, "path": p, "text": h} for k, p, h in nodes] for nodes, _ in found]
            b["packed"] = [zlib.compress(pickle.dumps(blocks), 1) for _, blocks in found]
            yield b[["page_id", "url", "host", "said", "nodes", "packed"]].astype({"page_id": "Int64"})

    return run


def aligned(pages: DataFrame) -> DataFrame:
    """page_id, url, host, a hash of the page's text, its nodes aligned with its host's pivot, and its blocks packed."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1)
    alone = F.concat(F.lit("//"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("/"), F.xxhash64("html").cast("string"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.when(host != "", F.lower(host)).otherwise(alone).alias("host"))
    first = F.struct(F.length("html") > PIVOT_CHARS, F.coalesce("page_id", F.lit(2**63 - 1)), F.xxhash64("html"))
    chosen = rows.filter("html is not null and not startswith(host, '//')").groupBy("host").agg(F.min_by("html", first).alias("html"))

    @F.pandas_udf("binary")
    def shaped(htmls: pd.Series) -> pd.Series:
        return htmls.map(pivot_of)

    pivots = saved(chosen.select("host", shaped("html").alias("pivot")))
    size = pivots.agg(F.sum(F.length("pivot") + F.length("host") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: bytes(r.pivot) for r in pivots.toLocalIterator()})
        return rows.mapInPandas(_aligner(shared), KNOWN)
    return rows.join(pivots, "host", "left").mapInPandas(_aligner(None), KNOWN)


def templates(known: DataFrame, prior: int = PRIOR, share: float = SHARE) -> DataFrame:
    """host (its hash) and template, the keys of its template nodes."""
    seen = known.select(F.xxhash64("host").alias("host"), "said", F.explode("nodes").alias("n")).select("host", "said", "n.*")
    again = seen.groupBy("path", "text").agg(F.min("said").alias("low"), F.max("said").alias("high")).filter("low <> high")
    again = saved(again.select("path", "text", F.lit(1).alias("recurs")))
    if again.count() * RECURRING_BYTES <= BROADCAST_BYTES:
        again = F.broadcast(again)
    told = seen.select("path", "text", "host", "key").join(again, ["path", "text"], "left")
    nodes = told.groupBy("host", "key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("pages"), F.count("recurs").alias("recurring"))
    paths = nodes.groupBy("path").agg((F.sum("recurring") / F.sum("pages")).alias("rate"))
    share_of = (F.col("recurring") + prior * F.col("rate")) / (F.col("pages") + prior)
    return nodes.join(paths, "path").filter(share_of >= share).groupBy("host").agg(F.collect_set("key").alias("template"))


def _writer(names: bool):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for packed, template in zip(b["packed"], b["template"], strict=True):
                out = frozenset(template.tolist()) if template is not None else ()
                texts.append("\n".join(t for k, d, t in pickle.loads(zlib.decompress(packed)) if k not in out and not (names and d)))
            b["text"], b["n_chars"] = texts, [len(t) for t in texts]
            yield b[["page_id", "url", "text", "n_chars"]].astype({"page_id": "Int64"})

    return write


def extract(pages: DataFrame, induce: bool = True, names: bool = True, prior: int = PRIOR, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = saved(aligned(pages)).withColumn("__host", F.xxhash64("host"))
    if not induce:
        told = known.withColumn("template", F.lit(None).cast("array<bigint>"))
        names = False
    else:
        template = saved(templates(known, prior, share).withColumnRenamed("host", "__host"))
        size = template.agg(F.sum(F.size("template") * 8 + 72)).first()[0] or 0
        if size <= BROADCAST_BYTES:
            told = known.join(F.broadcast(template), "__host", "left")
        else:
            dealt = known.withColumn("salt", F.pmod("said", F.lit(SALTS)).cast("int"))
            told = dealt.join(template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__host", "salt"], "left")
    return told.select("page_id", "url", "packed", "template").mapInPandas(_writer(names), "page_id bigint, url string, text string, n_chars bigint")
