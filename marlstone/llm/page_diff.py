"""Main text of web pages: differencing against the pages of the nearest URLs, of what the page's structure leaves in."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, dense_rank, global_order, join_weighted, slices, written

#: What a line is: marked as boilerplate; part of an article or main element; neither. HEAD: an article's own header, of which headings count.
DROP, ARTICLE, OPEN, HEAD = 0, 1, 2, 3
#: Pages of one block of the sorted URLs; different pages on either side of a page with which it is compared.
BLOCK, SIDES = 64, 2
#: A place of a host is template if so much of its lines is shared with the neighbours, on at least so many different pages.
TEMPLATE, PAGES = 0.9, 4
#: Bits of the table that an alignment keeps; longer pages are split in two first.
TABLE_BITS = 1 << 28
#: Broadcast the lines to delete only under so many bytes; beyond, join by shuffling.
BROADCAST_BYTES = 16 << 20

# Elements by their part in a page.
_RAW = "script|style|noscript|template|svg|iframe|object|canvas|math|textarea|select|audio|video"
_BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "title", "header", "fieldset", "map"}
_BLOCKS = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "tr", "table", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "article", "section", "main",
    "figure", "figcaption", "hr", "address", "body", "html", "details", "summary", "center", "legend", "option", "search", "hgroup",
} | _BOILER
_CONTAINERS = _BLOCKS - {"p", "hr", "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "h1", "h2", "h3", "h4", "h5", "h6", "option"} | {"span"}
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "subscription", "signup", "share",
    "sharing", "social", "comment", "comments", "respond", "disqus", "replies", "related", "recommended", "widget", "popup", "modal", "overlay", "login", "search", "form", "pagination",
    "pager", "toolbar", "copyright", "disclaimer", "hidden",
}
_HEADS = {"header", "masthead"}
#: Names that take even an article element out.
_NOT_ARTICLES = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "promo", "sponsored", "related", "recommended", "teaser"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S | re.I)
_NAME = re.compile(r"(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE = re.compile(r"role\s*=\s*[\"']?([a-z]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _boiler(tag: str, attrs: str) -> str:
    """Why an element isn't main text: "head" for a header, "other", or nothing."""
    if tag in ("body", "html"):
        return ""
    if tag == "header":
        return "head"
    if tag in _BOILER:
        return "other"
    if not attrs.strip():
        return ""
    if _HIDDEN.search(attrs) or ((role := _ROLE.search(attrs)) and role[1].lower() in _ROLES):
        return "other"
    named = {w.lower() for a in _NAME.findall(attrs) for w in re.findall(r"[A-Za-z][a-z]*|[A-Z]+", " ".join(a))}
    named &= _NOT_ARTICLES if tag in ("article", "main") else _NAMES
    return "head" if named and named <= _HEADS else "other" if named else ""


def _step(tag: str, attrs: str) -> str:
    """An element's part of a tag path: its name, classes and id, numbers in these made equal."""
    if not attrs:
        return "/" + tag
    return "/" + ".".join([tag, *(re.sub(r"[0-9]+", "0", " ".join(a).strip()) for a in _NAME.findall(attrs))])


def lines(page: str | None) -> list[tuple[str, int, str]]:
    """The page's blocks in order, white space collapsed and references decoded, each with DROP, ARTICLE or OPEN, and its tag path."""
    page = page or ""
    out: list[tuple[str, int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int, str]] = []  # containers, what lines in them are, and their tag paths
    heading, dropped, leaf, at = False, False, "", 0

    def flush() -> None:
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if line:
                kind = DROP if dropped else stack[-1][1] if stack else OPEN
                out.append((line, kind if kind != HEAD else ARTICLE if heading else DROP, (stack[-1][2] if stack else "") + leaf))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in ("br", "td", "th"):
            text.append(" ")
            continue
        if tag not in _CONTAINERS and tag not in _BLOCKS:
            continue
        if tag != "span":
            flush()
        if tag in ("h1", "h2"):
            heading = not m[2]
        if tag not in _CONTAINERS:  # its end may be left out, so it marks no more than its own line
            dropped = not m[2] and bool(_boiler(tag, m[4]))
            leaf = "" if m[2] else _step(tag, m[4])
            continue
        dropped = dropped and tag == "span"
        leaf = leaf if tag == "span" else ""
        if not m[2]:
            if m[4].endswith("/"):
                continue
            if tag == "body":
                stack.clear()  # whatever was left open before
            kind = stack[-1][1] if stack else OPEN
            boiler = _boiler(tag, m[4])
            if kind != DROP and boiler:
                if tag == "span":
                    flush()
                kind = HEAD if boiler == "head" and kind in (ARTICLE, HEAD) else DROP
            elif kind == OPEN and (tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articleBody", m[4], re.I)):
                kind = ARTICLE
            elif kind == ARTICLE and tag == "article" and any(t == "article" for t, _, _ in stack):
                kind = DROP  # an article in an article is a comment or a teaser
            stack.append((tag, kind, (stack[-1][2] if stack else "") + _step(tag, m[4])))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag == "span" and stack[k][1] == DROP and (k == 0 or stack[k - 1][1] != DROP):
                        flush()
                    del stack[k:]
                    break
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """After each item of ``a`` the columns, as bits, at which the longest common subsequence with ``b`` doesn't grow."""
    full = (1 << len(b)) - 1
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    row = full
    yield row
    for x in a:
        met = row & where.get(x, 0)
        row = (row + met | row - met) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    for row in _rows(a, b):  # noqa: B007 - the last one counts
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common(a: list[int], b: list[int]) -> list[int]:
    """The places in ``a`` of a longest common subsequence of both. Long lists are halved where halves fit best, so that space stays linear."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    inner, other = set(b[start : len(b) - end]), set(a[start : len(a) - end])
    mine = [i for i in range(start, len(a) - end) if a[i] in inner]
    x, y = [a[i] for i in mine], [v for v in b[start : len(b) - end] if v in other]
    found: list[int] = []
    if not x:
        pass
    elif len(x) > 1 and len(x) * len(y) > TABLE_BITS:
        half = len(x) // 2
        cut_ = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        found = common(x[:half], y[:cut_]) + [half + k for k in common(x[half:], y[cut_:])]
    else:
        table = [row.to_bytes(len(y) // 8 + 1, "little") for row in _rows(x, y)]
        i, j = len(x), len(y)
        while i and j:
            at, bit = (j - 1) >> 3, 1 << (j - 1 & 7)
            if table[i][at] & bit:
                j -= 1
            elif table[i - 1][at] & bit:
                i, j = i - 1, j - 1
                found.append(i)
            else:
                i -= 1
        found.reverse()
    return [*range(start), *(mine[k] for k in found), *range(len(a) - end, len(a))]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page's article lines, or its open lines where it marks none; the hashes, kinds and places of all its lines."""
    import xxhash

    def named(texts: list[str]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.uint64).view(np.int64)

    for batch in (piece for whole in batches for piece in slices(whole, "html")):
        marked, main, hashes, kinds, places, names = [], [], [], [], [], []
        for page in batch["html"]:
            found = lines(page)
            marked.append(any(k == ARTICLE for _, k, _ in found))
            main.append([t for t, k, _ in found if k == (ARTICLE if marked[-1] else OPEN)])
            hashes.append(named([t for t, _, _ in found]))
            kinds.append(bytes(k for _, k, _ in found))
            paths = {p: k for k, p in enumerate(dict.fromkeys(p for _, _, p in found))}
            places.append(named(list(paths))[[paths[p] for _, _, p in found]] if found else hashes[-1])
            names.append(xxhash.xxh3_64_intdigest(hashes[-1].tobytes() + kinds[-1] + places[-1].tobytes()))
        yield batch.drop(columns="html").assign(_marked=marked, _main=main, _lines=hashes, _kinds=kinds, _places=places, _sig=np.array(names, dtype=np.uint64).view(np.int64))


def deleted(mine: list[int], open_at: list[int], others: list[list[int]]) -> list[int]:
    """Which of a page's open lines are boilerplate: those that it shares, aligned, with its neighbours.

    A neighbour with all of the page's open lines is a copy of it and tells nothing. A line goes if two of the others
    share it, or the only one.
    """
    votes, voters = np.zeros(len(mine), dtype=np.int64), 0
    for other in others:
        same = np.zeros(len(mine), dtype=np.int64)
        same[common(mine, other)] = 1
        if not same[open_at].all():
            votes += same
            voters += 1
    return [k for k, at in enumerate(open_at) if voters and votes[at] >= min(2, voters)]


def shared_places(mine: list[int], others: list[list[int]]) -> tuple[list[int], int]:
    """Which of an article's lines its neighbours' articles share, aligned, as in ``deleted``, and how many neighbours tell.

    A neighbour that shares over half of the article is another version of it and tells nothing.
    """
    votes, voters = np.zeros(len(mine), dtype=np.int64), 0
    for other in others:
        same = common(mine, other)
        if len(same) * 2 <= len(mine):
            votes[same] += 1
            voters += 1
    return np.flatnonzero(votes >= min(2, voters)).tolist() if voters else [], voters


_SHARED = "_host string, _sig long, _many long, _gone array<int>, _at array<long>, _place long, _seen long, _met long, _pages long"


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """For the pages of one block, in URL order with the next pages on both sides: which of their open lines to delete.

    For articles: which of their lines are shared, and at which places; and of each place how many lines there are, how
    many are shared, and on how many pages.
    """
    rows = rows.sort_values("_rank")
    hosts, ranks, own, sigs, many = (rows[c].tolist() for c in ("_host", "_rank", "_own", "_sig", "_many"))
    kinds, hashes, places = rows["_kinds"].tolist(), rows["_lines"].tolist(), rows["_places"].tolist()
    at = [np.flatnonzero(np.frombuffer(k, dtype=np.uint8) == ARTICLE) for k in kinds]
    # A line of an article meets one of the same text at the same place.
    articles = [(np.asarray(h, dtype=np.int64)[k] ^ np.asarray(p, dtype=np.int64)[k] * 3).tolist() for h, p, k in zip(hashes, places, at, strict=True)]
    out, counts = [], {}
    for i in np.flatnonzero(np.array(own) == 1).tolist():
        near = [j for j in range(max(0, i - SIDES), min(len(ranks), i + SIDES + 1)) if j != i and hosts[j] == hosts[i] and abs(ranks[j] - ranks[i]) <= SIDES]
        if articles[i]:
            met, voters = shared_places(articles[i], [articles[j] for j in near if articles[j]])
            mine = np.asarray(places[i], dtype=np.int64)[at[i]].tolist()
            if met:
                out.append((hosts[i], sigs[i], many[i], met, [mine[k] for k in met], None, None, None, None))
            for place in set(mine) if voters else ():
                seen = counts.setdefault((hosts[i], place), [0, 0, 0])
                seen[0] += mine.count(place)
                seen[1] += sum(mine[k] == place for k in met)
                seen[2] += 1
            continue
        open_at = [k for k, kind in enumerate(kinds[i]) if kind == OPEN]
        if open_at:
            gone = deleted(list(hashes[i]), open_at, [list(hashes[j]) for j in near])
            if gone:
                out.append((hosts[i], sigs[i], many[i], gone, None, None, None, None, None))
    out += [(host, None, None, None, None, place, *seen) for (host, place), seen in counts.items()]
    made = pd.DataFrame(out, columns=[c.split()[0] for c in _SHARED.split(", ")], dtype=object)
    return made.astype({c: "Int64" for c in ("_sig", "_many", "_place", "_seen", "_met", "_pages")})


def shared_lines(parsed: DataFrame) -> DataFrame:
    """(_host, _sig, _many, _gone): for each different page of a host which of its main lines to delete; pages that lose none are left out.

    Different pages are range-sorted by host and path (equal ones are one, by their first path), so the nearest pages by
    URL path are neighbours there; they are found in blocks that overlap, however many pages a host has. Only hashes of
    lines and places are moved; of hosts whose pages all mark articles, only those of the articles.
    An open line goes if its neighbours share it. A line of an article goes if they share it and, over all pages of the
    host, nearly all lines of its place are shared: that place is the template's, not the article's.
    """
    hosts = cut(parsed.where(~F.col("_marked") & (F.size("_main") > 0)).select("_host").distinct())
    if hosts.count() * 128 < BROADCAST_BYTES:
        parsed = parsed.join(F.broadcast(hosts.withColumn("_full", F.lit(True))), "_host", "left").where(F.col("_full") | F.col("_marked"))
        of_article = "filter({}, (x, i) -> _full or substring(_kinds, i + 1, 1) = X'01')"
        parsed = parsed.withColumns({c: F.expr(of_article.format(c)) for c in ("_lines", "_places")})
        parsed = parsed.withColumn("_kinds", F.expr("if(_full, _kinds, unhex(repeat('01', size(_lines))))"))
    keys = parsed.groupBy("_host", "_sig").agg(F.min("_path").alias("_path"), F.count("*").alias("_many"), *(F.any_value(c).alias(c) for c in ("_lines", "_kinds", "_places")))
    ranked = dense_rank(global_order(cut(keys), ["_host", "_path", "_sig"]).withColumn("_all", F.lit(0)), ["_all"], "_rank")
    block = F.expr(f"_rank div {BLOCK}")
    at = F.pmod(F.col("_rank"), F.lit(BLOCK))
    near = F.array_compact(F.array(block, F.when(at < SIDES, block - 1), F.when(at >= BLOCK - SIDES, block + 1)))
    dealt = ranked.withColumn("_block", F.explode(near)).withColumn("_own", (F.col("_block") == block).cast("int"))
    made = cut(dealt.drop("_all").groupBy("_block").applyInPandas(_shared, _SHARED))
    gone, met = (made.where(F.col("_gone").isNotNull() & c).select("_host", "_sig", "_many", "_gone", "_at") for c in (F.col("_at").isNull(), F.col("_at").isNotNull()))
    places = made.where("_place is not null").groupBy("_host", "_place").agg(*(F.sum(c).alias(c) for c in ("_seen", "_met", "_pages")))
    template = cut(places.where((F.col("_pages") >= PAGES) & (F.col("_met") >= TEMPLATE * F.col("_seen"))).groupBy("_host").agg(F.collect_list("_place").alias("_template")))
    gone = gone.drop("_at")
    if not template.take(1):
        return gone
    weights = met.groupBy("_host").agg(F.count("*").alias("_rows"))
    lost = join_weighted(met, cut(template.join(weights, "_host")), ["_host"], "_rows")
    lost = lost.withColumn("_gone", F.expr("filter(_gone, (x, i) -> array_contains(_template, _at[i]))")).where(F.size("_gone") > 0)
    return gone.unionByName(lost.select("_host", "_sig", "_many", "_gone"))


def extract(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``: text is the main text's blocks joined by blank lines.

    What no boilerplate element holds is differenced against the pages of the nearest URLs on its host. A page that marks
    an article keeps its lines, less those at places that all of the host's articles share. Any other page keeps what it
    doesn't share with those pages. Null html: empty text. Null url: a host of its own. Repeated rows
    each give their row; pages of equal lines are differenced once. A page alone on its host, or with copies only, loses
    no line to differencing; one whose lines are all shared has an empty text. An empty table gives no rows; other columns don't matter.
    """
    bound_batches(pages.sparkSession)
    url = F.coalesce("url", F.lit(""))
    # A long beside a null would reach pandas as a floating-point number, so identifiers go there as text.
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.lower(F.regexp_extract(url, r"^(?:[a-z+]+:)?//([^/?#]*)", 1)).alias("_host"), F.regexp_extract(url, r"^(?:[a-z+]+:)?(?://[^/?#]*)?([^?#]*)", 1).alias("_path"), "html")
    parsed = written(rows.mapInPandas(_parse, "page_id string, url string, _host string, _path string, _marked boolean, _main array<string>, _lines array<long>, _kinds binary, _places array<long>, _sig long"), "zstd")
    main, kept = parsed.select("page_id", "url", "_main", "_host", "_sig"), F.col("_main")
    if differencing:
        gone = cut(shared_lines(parsed))
        size = gone.agg(F.sum(F.size("_gone") * 4 + F.length("_host") + 64)).first()[0] or 0
        if size < BROADCAST_BYTES:
            main = main.join(F.broadcast(gone), ["_host", "_sig"], "left")
        else:
            lost = join_weighted(main, gone, ["_host", "_sig"], "_many")
            main = lost.unionByName(main.join(gone.select("_host", "_sig"), ["_host", "_sig"], "left_anti").withColumns({"_gone": F.lit(None).cast("array<int>"), "_many": F.lit(1).cast("long")}))
        kept = F.filter("_main", lambda t, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False)))
    text = main.select("page_id", "url", F.array_join(kept, "\n\n").alias("text"))
    return text.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
