"""Main text of web pages with a host suffix array.

A page becomes blocks of text, each marked by the elements around it: *main* (inside
``article``, or ``main`` where there is no article), *side* (menus, headers, footers, adverts,
forms, comments and the like) or *open* (neither).  Main blocks are kept whole: articles are
copied and quote each other, so repetition says nothing about them.  All other text goes into
one token stream per page; a suffix array over the concatenated streams of a host's pages finds
the substrings of ``min_tokens`` tokens or more that ``PAGES`` pages share which are not copies of each other (equal in main and open
text).  On a page without a main element these are boilerplate where they reach an edge of a block or are long, and what
is left of the open blocks is the text.  An article inside a marked wrapper is main if the page has no other.

A host's pages are dealt into shards of about ``shard_bytes`` and each shard has a suffix array of
its own.  For hosts of several shards, the pages whose text depends on it are held against the
sorted suffix heads of the whole host, so the dealing changes nothing in the result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

MIN_TOKENS = 8
PAGES = 3                       # pages, copies counted once, that hold what is boilerplate
LONG = 3                        # times ``min_tokens``: a covered run in the middle of a block goes from this length on
SHARD_BYTES = 16 << 20
SPLIT_HOSTS = 1 << 16           # hosts of several shards (a name and a number each) that are broadcast
SIDE, OPEN, MAIN = 0, 1, 2

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile("[a-z]+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOWHERE = (False, 0, False, False, 0)
BLOCKS = {"html", "head", "body", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table",
          "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "section", "article", "main", "aside", "header", "footer", "nav",
          "blockquote", "pre", "hr", "figure", "figcaption", "address", "details", "summary", "form", "fieldset", "legend",
          "dialog", "center", "noscript", "template", "select", "option", "menu", "hgroup", "search"}
SIDE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "dialog", "button", "select", "menu",
             "search", "svg", "object", "audio", "video", "canvas", "map", "label", "input"} | RAW
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu",
              "menubar", "toolbar", "status"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus"}
SIDE_WORDS = COMMENT_WORDS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe",
    "signup", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "widgets", "related",
    "recommended", "share", "sharing", "social", "footer", "header", "masthead", "toolbar", "pagination", "pager", "login", "hidden"}
HARD_TAGS = SIDE_TAGS - {"form"}   # an article inside these stays side
SCOPES = {"article", "section", "div", "td", "th", "main", "aside", "nav", "header", "footer", "form", "blockquote", "body", "li"}


def _is_side(name: str, attrs: str) -> bool:
    """Whether an element holds side text by its name, role, class or id."""
    if name in SIDE_TAGS:
        return True
    if name in ("html", "body") or not attrs or attrs.isspace():
        return False
    words, role = set(), ""
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            words.update(WORD.findall(value))
        elif key == "role":
            role = value
        elif key == "hidden":
            return True
    if name in ("article", "main") or role == "main":
        return bool(words & COMMENT_WORDS)
    return role in SIDE_ROLES or bool(words & SIDE_WORDS)


def _is_hard(name: str, attrs: str) -> bool:
    """Whether an element that holds side text makes articles inside it side text too: a side tag, comments, hidden."""
    if name in HARD_TAGS:
        return True
    found = [(k.lower(), v) for k, v in ATTRIBUTE.findall(attrs)]
    return any(k == "hidden" or k in ("class", "id") and set(WORD.findall(v.lower())) & COMMENT_WORDS for k, v in found)


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, mark) of every block of a page that holds text, in page order."""
    page = page or ""
    # name, side, 0 none, 1 inside main, 2 inside article; then hard side, and the latter two if marked wrappers don't count
    stack: list[tuple[str, bool, int, bool, bool, int]] = []
    out: list[tuple[str, bool, int, bool, int]] = []
    text: list[str] = []

    def flush():
        words = "".join(text).split()
        text.clear()
        if words:
            side, inside, _, own, within = stack[-1][1:] if stack else NOWHERE
            out.append((" ".join(words), side, inside, own, within))

    def close(upto: int):
        flush()
        del stack[upto:]

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        piece = page[at:m.start() if m else len(page)]
        if piece:
            text.append(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in BLOCKS or stack[k][1:] != (stack[k - 1][1:] if k else NOWHERE):
                        close(k)
                    else:
                        del stack[k:k + 1]
                    break
            else:
                if name == "p":
                    flush()
            continue
        attrs = m[3] or m[6] or ""
        if name == "br":
            text.append(" ")
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end and (m2 := TAG.match(page, at)):
                at = m2.end()
            continue
        if name in BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):      # a block ends an open paragraph, an item an open item
                if stack[k][0] == "p" or stack[k][0] == name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        side, inside, hard, own, within = stack[-1][1:] if stack else NOWHERE
        mine = _is_side(name, attrs)
        if mine and not (side and own):
            flush()
        side, hard, own = side or mine, hard or mine and _is_hard(name, attrs), own or mine
        kind = 2 if name == "article" else 1 if name == "main" or re.search(r"\brole\s*=\s*[\"']?main\b", attrs, re.I) else 0
        if not side and (kind == 2 or not inside):
            inside = kind or inside
        if kind and not hard and not mine and (kind == 2 or not within) and not (own and within):
            if own:
                flush()
            own, within = False, kind
        stack.append((name, side, inside, hard, own, within))
    flush()
    top = max((inside for _, side, inside, _, _ in out if not side), default=0)
    if not top:                                   # no main but inside marked wrappers
        out = [(t, side and (own or not within), 0 if own else within, own, within) for t, side, _, own, within in out]
        top = max((inside for _, side, inside, _, _ in out if not side), default=0)
    return [(t, SIDE if side else MAIN if inside and inside == top else OPEN) for t, side, inside, _, _ in out]


def _tokens(blocks) -> list[int]:
    """Token hashes of the text outside main blocks."""
    return [xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) >> 1 for t, _ in blocks for w in t.split(" ")]


def suffix_heads(stream: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` tokens, by prefix doubling."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size < depth:
        step = min(size, depth - size)
        then = np.full(len(rank), -1, np.int64)
        then[:max(len(rank) - step, 0)] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + then + 1, return_inverse=True)[1].astype(np.int64)
        size += step
    return rank


def covered(streams: list[np.ndarray], min_tokens: int, copies=None, pages: int = 2) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a substring of at least ``min_tokens`` that ``pages`` pages have.

    ``copies``: a number per page; pages of one number count once."""
    sizes = np.array([len(s) for s in streams], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    flat = np.empty(int(sizes.sum()) + len(streams), np.int64)
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    for k, s in enumerate(streams):
        flat[first[k]:first[k] + len(s)] = s
        flat[first[k] + len(s)] = -1 - k                  # an end of its own: no substring runs over it
    rank = suffix_heads(flat, min_tokens)
    array = np.argsort(rank, kind="stable")               # the suffix array, to that depth
    head = np.concatenate([[True], rank[array][1:] != rank[array][:-1]]) if len(array) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    owner = page if copies is None else np.asarray(copies, np.int64)[page]
    order = np.lexsort((owner[array], group))
    one = np.ones(len(array), bool)                       # the first of each page, or class of copies, in its group
    one[1:] = (group[order][1:] != group[order][:-1]) | (owner[array][order][1:] != owner[array][order][:-1])
    held = np.bincount(group[order][one], minlength=int(head.sum()))
    hit = array[held[group] >= pages]
    edge = np.zeros(len(flat) + min_tokens + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + min_tokens, -1)
    mark = np.cumsum(edge)[:len(flat)] > 0
    return [mark[a:a + n] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]


def split_main(blocks) -> tuple[str | None, list[tuple[str, int]]]:
    """The main blocks joined (None without any), and the others."""
    main = [t for t, kind in blocks if kind == MAIN]
    return "\n".join(main) if main else None, [b for b in blocks if b[1] != MAIN]


def _boilerplate(mark: np.ndarray, long: int) -> np.ndarray:
    """``mark`` of a block without runs below ``long`` tokens that reach neither of its edges: phrases inside a text."""
    mark = np.array(mark, bool)
    step = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    for a, b in zip(step[::2].tolist(), step[1::2].tolist(), strict=True):
        if a and b < len(mark) and b - a < long:
            mark[a:b] = False
    return mark


def text_of(main: str | None, others, mark, long: int = LONG * MIN_TOKENS) -> str:
    """The main text whole; without any, the open blocks without boilerplate. ``mark``: covered tokens of ``others``."""
    if main is not None:
        return main
    out, at = [], 0
    for t, kind in others:
        words = t.split(" ")
        gone = _boilerplate(mark[at:at + len(words)], long) if kind == OPEN else ()
        left = [w for w, g in zip(words, gone, strict=True) if not g] if kind == OPEN else []
        if left:
            out.append(" ".join(left))
        at += len(words)
    return "\n".join(out)


BLOCK = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("mark", T.IntegerType())]))
PAGE = T.StructType([T.StructField("depends", T.BooleanType()), T.StructField("main", T.StringType()), T.StructField("blocks", BLOCK)])


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _page(col: pa.Array) -> pa.Array:
    rows = []
    for page in col.to_pylist():
        main, others = split_main(blocks_of(page))
        rows.append({"depends": main is None and any(m == OPEN for _, m in others), "main": main,
                     "blocks": [{"text": t, "mark": m} for t, m in others]})
    block = pa.list_(pa.struct([("text", pa.string()), ("mark", pa.int32())]))
    return pa.array(rows, pa.struct([("depends", pa.bool_()), ("main", pa.string()), ("blocks", block)]))


def _parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``main`` (its main text), ``blocks`` (the others) and ``depends`` (its text depends on what its host
    repeats) in place of ``html``."""
    return append_any(pages, "page", PAGE, "html", _page).drop("html").select("*", "page.*").drop("page")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_tokens: int = MIN_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``pages``: id, url, text (blocks joined by a newline, empty if none) and n_chars (code points).

    A null page is empty, a null or odd URL has the empty host.  Pages are told apart by id and a digest of their
    HTML: repeated rows count as one page for repetition and are each returned.  Extra columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        F.xxhash64(F.col(id_col), F.coalesce(F.col(html_col), F.lit(""))).alias("key"), host_of(F.col(url_col)).alias("host"))
    # a row for each host that needs several shards: few, as each has more than shard_bytes of pages; broadcast if so,
    # so that pages are shuffled for the suffix arrays only
    size = F.sum(F.octet_length(F.coalesce("html", F.lit(""))))
    split = checkpoint(rows.groupBy("host").agg(F.ceil(size / shard_bytes).cast("long").alias("shards")).where("shards > 1"))
    split = F.broadcast(split) if split.limit(SPLIT_HOSTS + 1).count() <= SPLIT_HOSTS else split
    parsed = _parsed(rows).join(split, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = parsed.withColumn("shard", F.pmod("key", "shards")).repartition("host", "shard").sortWithinPartitions("host", "shard")
    kind = T.StructType([parsed.schema["id"], parsed.schema["url"], T.StructField("open", T.BooleanType()), T.StructField("text", T.StringType())])
    texts = dealt.mapInArrow(_by_shard(min_tokens), kind).where("not open").select("id", "url", "text")
    whole = rows.join(split, "host", "left_semi")
    waiting = checkpoint(_parsed(whole).where("depends").select("key", "host").distinct())
    if not waiting.isEmpty():
        texts = texts.union(_whole_host(whole, waiting, min_tokens))
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                        F.char_length("text").cast("long").alias("n_chars"))


def _by_shard(min_tokens: int):
    """Task: texts of the pages of each shard; ``open`` where the text waits for the whole host."""

    def finish(rows):
        blocks = [[(b["text"], b["mark"]) for b in r["blocks"]] for r in rows]
        of_key, main = {}, {r["key"]: r["main"] for r in rows}
        for r, b in zip(rows, blocks, strict=True):
            of_key.setdefault(r["key"], b)
        same = {}
        copies = [same.setdefault((main.get(k), tuple(t for t, m in b if m == OPEN)), len(same)) for k, b in of_key.items()]
        streams = [np.array(_tokens(b), np.int64) for b in of_key.values()]
        marks = dict(zip(of_key, covered(streams, min_tokens, copies, PAGES), strict=True))
        out = []
        for r, b in zip(rows, blocks, strict=True):
            wait = r["depends"] and r["shards"] > 1
            out.append({"id": r["id"], "url": r["url"], "open": wait,
                        "text": None if wait else text_of(r["main"], b, marks[r["key"]], LONG * min_tokens)})
        return out

    def run(batches):
        group, name = [], None
        for batch in batches:
            ids = batch.schema.field("id").type
            schema = pa.schema([("id", ids), ("url", pa.string()), ("open", pa.bool_()), ("text", pa.string())])
            for r in batch.to_pylist():
                if (r["host"], r["shard"]) != name:
                    if group:
                        yield from pa.Table.from_pylist(finish(group), schema).to_batches()
                    group, name = [], (r["host"], r["shard"])
                group.append(r)
        if group:
            yield from pa.Table.from_pylist(finish(group), schema).to_batches()

    return run


def _whole_host(rows: DataFrame, waiting: DataFrame, min_tokens: int) -> DataFrame:
    """Texts of the ``waiting`` pages: their suffix heads are held against those of all pages of their host."""
    pages = _parsed(rows)

    def heads(col):
        out = []
        for row in col.to_pylist():
            t = np.array(_tokens([(b["text"], b["mark"]) for b in row]), np.int64)
            n = max(len(t) - min_tokens + 1, 0)
            out.append([xxhash.xxh3_64_intdigest(t[k:k + min_tokens].tobytes()) - (1 << 63) for k in range(n)])
        return pa.array(out, pa.list_(pa.int64()))

    opened = F.transform(F.filter("blocks", lambda b: b["mark"] == OPEN), lambda b: b["text"])
    copies = F.xxhash64("main", opened).alias("copies")
    suffix = append_any(pages.select("key", "host", copies, "blocks"), "heads", T.ArrayType(T.LongType()), "blocks", heads) \
        .select("host", "key", "copies", F.posexplode("heads").alias("pos", "head"))
    shared = suffix.select("host", "head", "copies").distinct().groupBy("host", "head").agg(F.count("*").alias("n")) \
        .where(F.col("n") >= PAGES).select("host", "head")
    hit = suffix.join(waiting.select("key").distinct(), "key", "left_semi").join(shared, ["host", "head"]) \
        .groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("hits"))
    own = pages.where("depends").join(hit, "key", "left").select("id", "url", F.struct("blocks", "hits").alias("both"))

    def texts(col):
        out = []
        for row in col.to_pylist():
            blocks = [(b["text"], b["mark"]) for b in row["blocks"]]
            mark = np.zeros(sum(len(t.split(" ")) for t, _ in blocks), bool)
            for k in row["hits"] or ():
                mark[k:k + min_tokens] = True
            out.append(text_of(None, blocks, mark, LONG * min_tokens))
        return pa.array(out, pa.string())

    return append_any(own, "text", T.StringType(), "both", texts).select("id", "url", "text")


def append_any(df: DataFrame, name: str, dtype: T.DataType, column: str, make) -> DataFrame:
    """``df`` with one more column made from any column, 256 rows at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, dtype)])
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, make(part.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)
