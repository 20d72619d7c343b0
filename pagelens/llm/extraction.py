"""Main text of pages: blocks of the element tree, and suffix arrays of hosts' pages for what repeats on them."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.htmltree import BLOCKS, HEADINGS, IN_TABLE, TABLE_PARTS, Element, parse
from ._common import union_all, written
from ._words import mix, texts, word_hashes, _AT

#: Words of a repeated substring at least, and share of a block's words that such substrings must cover.
LEAST, COVERED = 6, 0.5
#: Words of the pages whose suffixes are sorted together.
ARRAY = 1 << 20
#: Runs of articles in a batch.
ROWS = 1 << 15
#: A page of which everything repeats keeps its blocks of so many words outside links.
PROSE = 20

#: Elements whose text is never shown as such, or only works a form.
SILENT = frozenset("head script style noscript template svg math canvas iframe object embed video audio select button textarea input datalist noframes noembed xmp".split())
#: Elements around the main text.
AROUND = frozenset("nav footer aside menu dialog form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words and beginnings of words in class and id that name what is not main text, the last only outside it.
NAMES = frozenset("ad ads adv adslot adbox adunit banner consent gdpr notice notices popup modal overlay respond reply replies nav menu pager widget widgets related share sharing social footer login signup search skip toolbar".split())
BEGINNINGS = ("adsby", "adsense", "advert", "sponsor", "promo", "cookie", "newsletter", "breadcrumb", "navbar", "navigation", "sidebar", "paginat", "comment", "disqus", "subscri", "recommend", "teaser")
OUTSIDE = frozenset("header masthead topbar".split())
#: class and id of an element that holds the main text where no article element does.
MAIN = re.compile(r"\b(?:(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)|articlebody|maincontent)\b")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_BREAKS = BLOCKS | IN_TABLE | TABLE_PARTS | frozenset("body html legend optgroup option".split())

#: What the tree says of a block: around the main text, within it, or nothing that settles it.
AWAY, WITHIN, OPEN = 0, 1, 2
BLOCK = "array<struct<text:string,role:int,free:int>>"
PARSED = f"page_id {{}}, url {{}}, host string, key binary, open boolean, blocks {BLOCK}"


def _marked(e: Element, attrs: dict, within: bool) -> bool:
    """Whether an element's role, class or id says that it is not main text."""
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "").lower()):
        return True
    names = {p.lower() for p in _PARTS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    return bool(names & NAMES) or any(n.startswith(BEGINNINGS) for n in names) or (not within and bool(names & OUTSIDE))


def _regions(top: Element):
    """Elements in page order, then for each the kind of region that it is ('article', 'main') or holds."""
    order, stack, kind, holds = [], [top], {}, set()
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [k for k in reversed(e.kids) if isinstance(k, Element)]
        a = e.attributes() if e.attrs else {}
        if e.tag == "article" and not _marked(e, a, True):
            kind[id(e)] = "article"
        elif e.tag == "main" or a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody" or MAIN.search(f"{a.get('class', '')} {a.get('id', '')}".lower()):
            kind[id(e)] = "main"
    for e in reversed(order):
        if id(e) in kind or id(e) in holds:
            if e.up is not None:
                holds.add(id(e.up))
    return kind, holds


def blocks(html: str) -> list[tuple[str, int, int]]:
    """Text, role and words outside links of every block of a page that is shown, in page order."""
    top = parse(html)
    kind, holds = _regions(top)
    out, parts, free = [], [], []
    now = [None]

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, now[0], len(" ".join("".join(free).split()).split())))
        parts.clear()
        free.clear()

    # an entry opens an element, shows a text or ends a block; state: marked, region, link (-1: in a heading of an article)
    stack = [(top, False, "", 0)]
    while stack:
        item, marked, region, link = stack.pop()
        if item is None:
            flush()
            continue
        if isinstance(item, str):
            state = (marked, region)
            if state != now[0]:
                flush()
                now[0] = state
            parts.append(item)
            free.append(" " if link > 0 else item)
            continue
        if item.tag in SILENT:
            continue
        if item.tag == "br":
            stack.append((" ", marked, region, link))
            continue
        mine = kind.get(id(item), "")
        if not marked and not mine and id(item) not in holds:
            away = item.tag in AROUND or (item.tag == "header" and not region)
            marked = away or bool(item.attrs and _marked(item, item.attributes(), bool(region)))
            if marked and item.tag not in _BREAKS:  # within a block, which goes on
                continue
        region = "article" if "article" in (region, mine) else region or mine
        if region == "article" and item.tag in HEADINGS:
            link = -1
        link = link or int(item.tag == "a")
        breaks = item.tag in _BREAKS
        if breaks:
            flush()
            stack.append((None, marked, region, link))
        stack += [(k, marked, region, link) for k in reversed(item.kids)]
    flush()
    shown = {region for _, (marked, region), _ in out if not marked}
    inner = shown & {"article", "main"}

    def role(state, free):
        marked, region = state
        if marked or (inner and not region):
            return AWAY
        if region == "article":
            return WITHIN if free else OPEN  # links alone are text of it unless they repeat
        return OPEN if free or region else AWAY  # a block of links alone, outside any region, is a menu

    return [(text, role(state, free), free) for text, state, free in out]


def _parsed(batches):
    for batch in batches:
        ids, urls, hosts, pages = (batch.column(k) for k in range(4))
        keys, opens, shown, roles, frees, ends = [], [], [], [], [], [0]
        for host, html in zip(hosts.to_pylist(), pages.to_pylist()):
            found = blocks(html) if html else []
            keys.append(hashlib.blake2b(f"{host}\0{html}".encode("utf-8", "surrogatepass"), digest_size=16).digest())
            opens.append(any(r == OPEN for _, r, _ in found))
            for text, role, free in found:
                shown.append(text)
                roles.append(role)
                frees.append(free)
            ends.append(len(shown))
        inner = pa.StructArray.from_arrays([pa.array(shown, pa.string()), pa.array(roles, pa.int32()), pa.array(frees, pa.int32())], ["text", "role", "free"])
        arrays = [pa.array([h or "" for h in hosts.to_pylist()], pa.string()), pa.array(keys, pa.binary()), pa.array(opens, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)]
        yield pa.RecordBatch.from_arrays([ids, urls, *arrays], names=["page_id", "url", "host", "key", "open", "blocks"])


def suffix_runs(words: np.ndarray, page: np.ndarray, least: int):
    """The suffixes of concatenated pages in order of their first `least` words: places in that order, and the
    number of the run of equal ones that each belongs to. Suffixes that their page ends earlier are left out.

    Ranks of ever longer beginnings come by doubling, the last step overlaps.
    """
    n = len(words)
    rank, depth = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while depth < least:
        step = min(depth, least - depth)
        pair = np.full(n, -1, np.int64)
        pair[: n - step] = rank[step:]
        both = rank * (n + 1) + pair + 1
        rank, depth = np.unique(both, return_inverse=True)[1].astype(np.int64), depth + step
    whole = np.zeros(n, bool)
    if n >= least:
        whole[: n - least + 1] = page[: n - least + 1] == page[least - 1 :]
    at = np.flatnonzero(whole)
    at = at[np.argsort(rank[at], kind="stable")]
    return at, np.cumsum(np.append(False, rank[at][1:] != rank[at][:-1])) if len(at) else at


def _arrays(least: int, told):
    """Suffix arrays of a task's pages, about ARRAY words at a time; told makes rows of the runs of one array."""

    def solved(held):
        first = {}
        for key, w, is_open in held:
            first.setdefault(key, (w, is_open))  # a page and its copies on the host count once
        if not first:
            return
        words = np.concatenate([w for w, _ in first.values()])
        size = np.array([len(w) for w, _ in first.values()])
        which = np.repeat(np.arange(len(size)), size)
        begins = np.cumsum(size) - size
        at, run = suffix_runs(words, which, least)
        if not len(at):
            return
        heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        total = np.full(len(heads), least, np.uint64)
        for k in range(least):
            total += words[at[heads] + k] * _AT[k]
        yield from told(list(first), [o for _, o in first.values()], begins, size, which[at], at, run, heads, mix(total).view(np.int64))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            hosts, keys, opens = (batch.column(k).to_pylist() for k in range(3))
            for host, key, is_open, data in zip(hosts, keys, opens, texts(batch.column(3))):
                w = word_hashes(data)
                if not len(w):
                    continue
                salt = np.frombuffer(hashlib.blake2b(host.encode(), digest_size=8).digest(), np.uint64)
                held.append((key, mix(w ^ salt), is_open))
                n += len(w)
                if n >= ARRAY:
                    yield from solved(held)
                    held, n = [], 0
        yield from solved(held)

    return run


def _outside(least: int):
    """Of words outside articles: covered words of pages with open blocks (gram null), and a row for each distinct
    run of least words, with its page if only one page has it."""

    def told(keys, opens, begins, size, pages, at, run, heads, grams):
        low, high = np.minimum.reduceat(pages, heads), np.maximum.reduceat(pages, heads)
        many = low != high
        cover = np.zeros(int(size.sum()) + least, bool)
        for k in range(least):
            cover[at[many[run]] + k] = True
        rows = {"key": [], "places": [], "gram": []}
        for k, is_open in enumerate(opens):
            if is_open:
                hit = np.flatnonzero(cover[begins[k] : begins[k] + size[k]])
                if len(hit):
                    rows["key"].append(keys[k])
                    rows["places"].append(hit.tolist())
                    rows["gram"].append(None)
        ends = np.append(heads[1:], len(at))
        for gram, k, head, end, shared in zip(grams.tolist(), low.tolist(), heads.tolist(), ends.tolist(), many.tolist()):
            rows["key"].append(None if shared else keys[k])
            rows["places"].append(None if shared or not opens[k] else (at[head:end] - begins[k]).tolist())
            rows["gram"].append(gram)
        yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(rows, (pa.binary(), pa.list_(pa.int32()), pa.int64()))], names=list(rows))

    return _arrays(least, told)


def _inside(least: int):
    """Of words of articles: a row for each distinct run of least words, with a page and another one that hold it."""

    def told(keys, opens, begins, size, pages, at, run, heads, grams):
        low, high = np.minimum.reduceat(pages, heads), np.maximum.reduceat(pages, heads)
        names = pa.array(keys, pa.binary())
        for k in range(0, len(heads), ROWS):
            one, two = low[k : k + ROWS], high[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + ROWS]), names.take(pa.array(one)), names.take(pa.array(two, mask=one == two))], names=["gram", "key", "other"])

    return _arrays(least, told)


def _side(parsed: DataFrame, within: bool) -> DataFrame:
    """Pages with their words within articles, or outside."""
    mine = F.filter("blocks", lambda b: (b.role == WITHIN) == F.lit(within))
    return parsed.select("host", "key", "open", F.array_join(F.transform(mine, lambda b: b.text), " ").alias("words")).where("words <> ''")


def repeated(parsed: DataFrame, least: int = LEAST) -> DataFrame:
    """key, places and quoted of pages with open blocks: the words (numbers among a page's words outside its
    article) that substrings of least words or more cover which stand on other pages of the host too, for places
    outside their articles, for quoted in them.

    Tasks sort the suffixes of their own pages, articles for themselves. What is on one page in one array can be on
    another page in another: each array hands on one row a distinct run of words, so a run meets at most one row an
    array, however many pages hold it; the result is that of one array over all pages of the host. Of the runs of
    articles only those that open blocks hold too are handed on.
    """
    rows = written(_side(parsed, False).mapInArrow(_outside(least), "key binary, places array<int>, gram long"), "suffixes")
    runs = rows.where("gram is not null")
    shared = runs.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max(F.col("key").isNull()).alias("many"))
    shared = shared.where("low is not null and (many or low <> high)").select("gram")
    own = runs.where("places is not null")
    asked = written(own.select("gram").distinct(), "asked")
    held = _side(parsed, True).mapInArrow(_inside(least), "gram long, key binary, other binary").join(asked, "gram", "left_semi")
    held = held.groupBy("gram").agg(F.min(F.least("key", "other")).alias("low"), F.max(F.greatest("key", "other")).alias("high"))
    quoted = own.join(held, "gram").where("low <> key or high <> key")

    def covered(found, quotes):
        starts = found.select("key", F.explode("places").alias("p"))
        return starts.select("key", F.explode(F.sequence("p", F.col("p") + least - 1)).alias("place"), F.lit(quotes).alias("quotes"))

    settled = rows.where("gram is null").select("key", F.explode("places").alias("place"), F.lit(False).alias("quotes"))
    places = union_all([covered(own.join(shared, "gram", "left_semi"), False), settled, covered(quoted, True)]).distinct()
    of = lambda quotes: F.array_sort(F.collect_list(F.when(F.col("quotes") == quotes, F.col("place"))))
    return places.groupBy("key").agg(of(False).alias("places"), of(True).alias("quoted"))  # one page's words


def _assembled(batches):
    """Pages' blocks that stay: of open ones those go that repeats cover; if nothing would stay, only those that
    repeats outside articles cover."""
    for batch in batches:
        out = []
        found, ends = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
        found = list(zip(*(found.field(k).to_pylist() for k in range(3))))
        for low, high, places, quoted in zip(ends - ends[0], ends[1:] - ends[0], batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            outside = np.array(places or [], np.int64)
            anywhere, at, rows = np.union1d(outside, np.array(quoted or [], np.int64)), 0, []
            for text, role, free in found[low:high]:
                n = text.count(" ") + 1 if role != WITHIN else 0
                hits = [int(np.searchsorted(x, at + n) - np.searchsorted(x, at)) if n and len(x) else 0 for x in (anywhere, outside)]
                at += n
                if role != AWAY:
                    rows.append((text, *(role == WITHIN or h < COVERED * n for h in hits), free))
            kept = [t for t, stays, _, _ in rows if stays] or [t for t, _, stays, _ in rows if stays] or [t for t, _, _, free in rows if free >= PROSE]
            out.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, text and n_chars of every page: the article without what stands around it.

    The element tree gives a page's blocks. Those of an article element are main text, but for marked parts
    (menus, footers, asides, adverts, notices, forms, comments) and blocks of links alone that are no headings;
    if there is one, what lies outside it and outside a main element goes. All other blocks are open. Suffix
    arrays over the pages of each host, articles included, find substrings of `least` words or more that stand on
    distinct pages (copies of a page count as one); an open block goes if they cover half of its words, and
    unique ones stay. A page of which all open blocks repeat keeps those that only articles of other pages hold
    (it is another form of them), else those of PROSE words outside links. Open blocks outside any article that
    are links alone are menus. An article's text stays whatever repeats, as articles quote and copy each other.

    In a block, references are decoded and white space becomes one space; a line break is white space.
    Blocks are joined by a line feed. Null and empty html give an empty text; a null url is a host of its own
    name ''; null page_id stays. Repeated rows each give a row. An empty table gives an empty result. Other
    columns are not read. Pages of one host may be spread over all tasks; none is gathered.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    parsed = written(pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(_parsed, PARSED.format(*kinds)), "parsed-pages")
    found = written(repeated(parsed, least), "covered")
    whole = parsed.join(found, "key", "left").select("page_id", "url", "blocks", "places", "quoted")
    return whole.mapInArrow(_assembled, f"page_id {kinds[0]}, url {kinds[1]}, text string").withColumn("n_chars", F.length("text").cast("long"))
