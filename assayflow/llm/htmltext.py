"""Main text of web pages: a suffix array over the pages of a host, beside the markup.

Every page is cut into blocks (``parse``). Markup says where the article may be: elements that never hold an article's text go
(``DROPPED``, ``DROPPED_NAMES``, ``DROPPED_ROLES``), and of a page with an ``article`` or ``main`` element all outside goes. Such
menus, adverts and footers are mostly unique to a page, so repetition could not tell them. What is left is the array's to judge.

The pages of a host are dealt into shards of at most about ``SHARD_PAGES`` pages and ``SHARD_BYTES`` bytes (one host may hold most of a table), and
one task takes a shard. It lays the token streams of all pages end to end and sorts the suffixes by their first ``RUN``
tokens (prefix doubling). Suffixes that agree so far stand side by side; a run shared by enough distinct pages of the host is
boilerplate, and covers its tokens. A block that is mostly covered goes; unique runs stay.

On a page without an article ``MIN_PAGES`` distinct pages of the host make boilerplate. Exact copies of a page count as one page, so they do not make each other
boilerplate.

Within an article passages may well be repeated, as pages quote and copy each other, and are wanted; there a run must be on
``SITE_PAGES`` distinct pages and on ``SITE_SHARE`` of all, and the article stays whole if most of it is covered, as the article itself is
repeated then.

A host of several shards has the texts that it would have in one: pages are counted over the whole host first (``_common``), and a shard's array
is told of the runs that are common there. Runs on a share of all pages are few; they are found among those whose slot of ``SLOTS`` is hit by
as many pages, which loses none, and only these are counted exactly. Runs of pages without an article are counted one by one.

Whole pages are processed, in time in proportion to their length. Nulls and empty pages give the empty text; a null url is a host of its own. Repeated rows
give a row each, null ids are kept, an empty table gives an empty one, and columns besides id, url and source may have any names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialised

SHARD_PAGES, SHARD_BYTES = 1024, 1 << 25
RUN = 8
#: Distinct pages of a host that share a run before it counts as boilerplate on pages without an article, and within articles (and this part of the host).
MIN_PAGES = 3
SITE_PAGES, SITE_SHARE = 10, 0.5
COVERED = 0.8
#: Slots that runs of a host are first counted in, how many are added up together, and hosts that a task counts at once.
SLOTS, CHUNK, HELD_HOSTS = 1 << 13, 256, 256
#: Elements without article text, and names in class or id that mark such parts.
DROPPED = frozenset("head title nav header footer aside form button select textarea script style noscript template iframe svg object menu dialog".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED_NAMES = re.compile(r"ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notice|nav(?:bar|igation)?|menu|sidebar|footer|header|masthead|breadcrumbs?|comments?|disqus|replies|share|sharing|social|related|newsletter|subscribe|popup|modal|widget")
#: What a name of several parts may end in after a dropped name, and parts that make a name tell of the layout instead (has-sidebar, no-ads).
PIECES = re.compile(r"area|bar|block|box|buttons?|container|content|form|icons?|inner|items?|links?|list|posts?|section|slot|text|unit|wrap(?:per)?|\d*")
LAYOUT = frozenset("has have no not non with without is hide hides show shows layout".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
_TAG = re.compile(r"""<(?:!--|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|[!?][^>]*>)""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none\b")


@dataclass
class Page:
    """A page's blocks: their texts, where each stands (``dropped``, ``inside`` the article), and its path as a token."""

    texts: list[str] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    has_article: bool = False


def _named(token: str) -> bool:
    """Whether a class or id says that an element holds no article's text."""
    parts = re.split("[-_]+", token.lower())
    if LAYOUT.intersection(parts):
        return False
    return bool(DROPPED_NAMES.fullmatch(parts[-1]) or (PIECES.fullmatch(parts[-1]) and any(map(DROPPED_NAMES.fullmatch, parts))))


def _drops(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element goes by its tag, role or being hidden, and whether by its names."""
    if tag in DROPPED:
        return True, False
    named = False
    if "=" in attributes or "hidden" in attributes.lower():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
            if name == "hidden" or (name == "role" and value.strip().lower() in DROPPED_ROLES) or (name == "style" and _UNSEEN.search(value)):
                return True, False
            named |= name in ("class", "id") and tag not in ("html", "body") and any(map(_named, value.split()))
    return False, named


def parse(source: str | None) -> Page:
    """Cuts a page into blocks; character references are decoded and white space is made one space."""
    source, page = source or "", Page()
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, whether it drops, whether by name, whether it is an article
    named: list[int] = []  # the open elements that drop by name
    within: list[tuple[int, ...]] = []  # those about each block
    homes: list[tuple[int, ...]] = []  # those about each article
    open_: Counter[str] = Counter()
    drops = articles = count = 0
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            page.texts.append(text)
            page.dropped.append(drops > 0)
            page.inside.append(articles > 0)
            page.paths.append("/".join(t for t, *_ in stack[-3:] if t not in INLINE))
            within.append(tuple(named))

    def leave(upto: int) -> None:
        nonlocal drops, articles
        while len(stack) > upto:
            tag, drop, by_name, article = stack.pop()
            if by_name:
                named.pop()
            open_[tag] -= 1
            drops -= drop
            articles -= article

    at, end, lower = 0, len(source), None
    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            parts.append(source[at:])
            break
        parts.append(source[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            close = source.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            if open_[tag]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in VOID or (m[3].endswith("/") and tag in INLINE):
            continue
        if tag in RAW:
            lower = source.lower() if lower is None else lower
            close = lower.find(f"</{tag}", at)
            at = end if close < 0 else (lower.find(">", close) + 1 or end)
            continue
        if tag not in INLINE and open_["p"] and stack and "p" in (stack[-1][0], *(t for t, *_ in stack[-4:] if t not in INLINE)):
            leave(max(i for i in range(len(stack)) if stack[i][0] == "p"))
        (drop, by_name), article = _drops(tag, m[3]), tag in ("article", "main")
        stack.append((tag, drop, by_name, article))
        open_[tag] += 1
        drops += drop
        articles += article
        count += 1
        if by_name:
            named.append(count)
        if article and drops == 0:
            homes.append(tuple(named))
    flush()
    _settle(page, within, homes)
    return page


def _settle(page: Page, within: list[tuple[int, ...]], homes: list[tuple[int, ...]]) -> None:
    """Drops blocks in elements that drop by name, but if these hold all articles, the articles' outermost ones stay unless more text lies outside all such elements."""
    spared: set[int] = set()
    if homes and all(homes):
        least = min(map(len, homes))
        spared = {e for h in homes if len(h) == least for e in h}
        length = lambda keeps: sum(len(t) for t, d, w, i in zip(page.texts, page.dropped, within, page.inside, strict=True) if not d and keeps(w, i))
        if length(lambda w, i: not w) > length(lambda w, i: i and spared.issuperset(w)):
            spared = set()
    page.dropped = [d or not spared.issuperset(w) for d, w in zip(page.dropped, within, strict=True)]
    page.inside = [i and not d for i, d in zip(page.inside, page.dropped, strict=True)]
    page.has_article = any(spared.issuperset(h) for h in homes)


def candidates(page: Page) -> list[int]:
    """The blocks that markup leaves: those in the article, or without one all but dropped blocks."""
    return [k for k, (inside, dropped) in enumerate(zip(page.inside, page.dropped, strict=True)) if (inside if page.has_article else not dropped)]


def hashed(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


def stream(kinds: list[int], texts: list[str], known: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A page's tokens as hashes, each block led by its kind, and where blocks begin and the last ends."""
    known = {} if known is None else known
    tokens, starts = [], [0]
    for kind, text in zip(kinds, texts, strict=True):
        tokens.append(kind & 0xFFFFFFFFFFFFFFFF)
        for word in text.split(" "):
            found = known.get(word)
            if found is None:
                found = known[word] = hashed(word)
            tokens.append(found)
        starts.append(len(tokens))
    return np.array(tokens, np.uint64), np.array(starts)


def shared_runs(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """Per stream and place, how many distinct streams have the ``run`` tokens that begin there; 0 where fewer follow."""
    if not streams:
        return []
    numbers = np.unique(np.concatenate(streams), return_inverse=True)[1]
    cuts = np.cumsum([0, *map(len, streams)])
    ends = -1 - np.arange(len(streams))  # an own end token for each page: no run crosses it
    text = np.concatenate([x for k, e in enumerate(ends) for x in (numbers[cuts[k] : cuts[k + 1]], [e])]).astype(np.int64)
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        ahead = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        depth += step
    order = np.lexsort((owner, rank))  # the suffixes in order of their first tokens, pages together
    r, o = rank[order], owner[order]
    fresh = np.append(True, (r[1:] != r[:-1]) | (o[1:] != o[:-1]))
    distinct = np.bincount(r, fresh).astype(np.int64)[rank]
    places = np.cumsum([0, *(len(s) + 1 for s in streams)])
    out = []
    for a, n in zip(places[:-1], map(len, streams), strict=True):
        found = distinct[a : a + n].copy()
        found[max(0, n - run + 1) :] = 0
        out.append(found)
    return out


def run_keys(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """A 64-bit key for the ``run`` tokens from each place on; the same in every shard."""
    padded = np.concatenate([tokens, np.zeros(run, np.uint64)])
    out = np.zeros(len(tokens), np.uint64)
    for k in range(run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(tokens)]
    return out.view(np.int64)


def covered(counts: np.ndarray, least: int, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run that ``least`` distinct pages share."""
    mark = np.zeros(len(counts) + run + 1, np.int64)
    starts = np.flatnonzero(counts >= least)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + run, -1)
    return np.cumsum(mark)[: len(counts)] > 0


@dataclass
class Rest:
    """What markup left of a page: digest of the whole page, whether it has an article, and blocks."""

    digest: int
    article: bool
    kinds: list[int]
    texts: list[str]


def rest(source: str | None) -> Rest:
    page = parse(source)
    kept = candidates(page)
    kind = lambda path: hashed("\n" + path) - (1 << 63)
    digest = xxhash.xxh64_intdigest((source or "").encode("utf-8", "surrogatepass")) - (1 << 63)
    return Rest(digest, page.has_article, [kind(page.paths[k]) for k in kept], [page.texts[k] for k in kept])


def _distinct(rests: list[Rest]) -> tuple[dict[int, int], list[np.ndarray], list[np.ndarray]]:
    """Pages without their exact copies: their numbers by digest, their streams and where blocks begin."""
    first: dict[int, int] = {}
    streams, starts, known = [], [], {}
    for page in rests:
        if page.digest not in first:
            first[page.digest] = len(first)
            tokens, at = stream(page.kinds, page.texts, known)
            streams.append(tokens)
            starts.append(at)
    return first, streams, starts


def chosen(rests: list[Rest], common: np.ndarray | None = None, site: np.ndarray | None = None) -> list[str]:
    """The main texts of pages of one host, or of a shard of it. Of a shard, ``common`` and ``site`` are the sorted keys of runs that enough pages of the
    host share: for pages without an article (those of two shards or more), and within articles (all)."""
    first, streams, starts = _distinct(rests)
    counts = shared_runs(streams)
    share = max(SITE_PAGES, int(np.ceil(SITE_SHARE * len(streams))))
    out = []
    for page in rests:
        k = first[page.digest]
        shared, least = counts[k], share if page.article else MIN_PAGES
        told = site if page.article else common
        if told is not None:
            known = _among(run_keys(streams[k]), told) & (shared > 0)
            shared = np.where(known, least, 0 if page.article else shared)
        marks = np.append(0, np.cumsum(covered(shared, least)))
        size = np.diff(starts[k])
        goes = (marks[starts[k][1:]] - marks[starts[k][:-1]]) >= COVERED * size
        if page.article and 2 * size[goes].sum() >= size.sum():
            goes[:] = False
        out.append("\n".join(t for t, g in zip(page.texts, goes.tolist(), strict=True) if not g))
    return out


def _among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``held``."""
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def _page_runs(page: Rest, known: dict[str, int]) -> np.ndarray:
    """The distinct keys of a page's whole runs."""
    if len(known) > 100_000:
        known.clear()
    tokens, _ = stream(page.kinds, page.texts, known)
    return np.unique(run_keys(tokens)[: max(0, len(tokens) - RUN + 1)])


def extract(sources: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    return chosen([rest(s) for s in sources])


def _rests(table: pa.Table) -> list[Rest]:
    return [Rest(*x) for x in zip(*(table.column(c).to_pylist() for c in ("digest", "article", "kinds", "texts")), strict=True)]


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html", shard_pages: int = SHARD_PAGES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per page its id, url, ``text`` and ``n_chars``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), host.alias("host"), F.col(source).alias("html"))
    shards = F.ceil(F.greatest(F.count("*") / shard_pages, F.coalesce(F.sum(F.length("html")), F.lit(0)) / shard_bytes))
    large = materialised(rows.groupBy("host").agg(shards.alias("shards")).where("shards > 1"), "hosts")
    types = {c: rows.schema[c].dataType.simpleString() for c in ("id", "url")}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = [rest(x.as_py()) for x in rb.column(3)]
            columns = [pa.array([r.digest for r in found], pa.int64()), pa.array([r.article for r in found], pa.bool_()), pa.array([r.kinds for r in found], pa.list_(pa.int64())), pa.array([r.texts for r in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(2), *columns, rb.column(4)], ["id", "url", "host", "digest", "article", "kinds", "texts", "shards"])

    schema = f"id {types['id']}, url {types['url']}, host string, digest long, article boolean, kinds array<long>, texts array<string>, shards long"
    hosts = broadcast_if_small(large)
    parsed = lambda joined: joined.select("id", "url", "host", "html", F.coalesce("shards", F.lit(1)).cast("long").alias("shards")).mapInArrow(cut, schema)
    inside = rows.join(hosts, "host").select("id", "url", "host", "html", "shards")
    place = F.pmod(F.xxhash64("id", "url", "digest"), F.col("shards"))
    common = materialised(_common(inside, place), "runs")
    # Round two: every page, dealt by what is in the row, so that copies do not meet in one shard.
    dealt = parsed(rows.join(hosts, "host", "left")).withColumn("shard", place)

    def judge(own: pa.Table, others: pa.Table) -> pa.Table:
        several = own.num_rows and own.column("shards")[0].as_py() > 1
        run, site = (np.asarray(others.column(n).to_numpy(), t) for n, t in (("run", np.int64), ("site", bool)))
        texts = chosen(_rests(own), *((np.sort(run[~site]), np.sort(run[site])) if several else ()))
        return pa.table([own.column("id"), own.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return dealt.groupBy("host", "shard").cogroup(common.groupBy("host", "shard")).applyInArrow(judge, f"`{id_col}` {types['id']}, url {types['url']}, text string, n_chars long")


def _common(pages: DataFrame, place: Column) -> DataFrame:
    """Rows ``host, shard, run, site`` for pages (``id, url, host, html, shards``) of hosts of several shards: the runs that enough distinct pages of the whole host share, for
    the shards that need them; ``site`` ones are on enough for articles, the others on enough for pages without an article, and in a shard that has them on such a page."""
    types = {c: pages.schema[c].dataType.simpleString() for c in ("id", "url")}

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every page, with its runs if it has no article, and rows without a digest for how many pages hit a slot."""
        known: dict[str, int] = {}
        hits: dict[str, np.ndarray] = {}

        def counted() -> pa.RecordBatch:
            held = [(host, c, part) for host, h in hits.items() for c, part in enumerate(h.reshape(-1, CHUNK)) if part.any()]
            none = [None] * len(held)
            columns = [pa.nulls(len(held), kinds[0]), pa.nulls(len(held), kinds[1]), pa.array([h for h, _, _ in held], pa.string()), pa.array(none, pa.int64()), pa.array(none, pa.bool_()), pa.array([[c] for _, c, _ in held], pa.list_(pa.int64())), pa.array([x for *_, x in held], pa.list_(pa.int32())), pa.array(none, pa.int64())]
            hits.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        names, kinds = ["id", "url", "host", "digest", "article", "runs", "hits", "shards"], ()
        for rb in batches:
            kinds, found = (rb.column(0).type, rb.column(1).type), [rest(x.as_py()) for x in rb.column(3)]
            runs = [_page_runs(r, known) for r in found]
            for host, keys in zip(rb.column(2).to_pylist(), runs, strict=True):
                if len(hits) >= HELD_HOSTS and host not in hits:
                    yield counted()
                hits.setdefault(host, np.zeros(SLOTS, np.int32))[np.unique(keys & (SLOTS - 1))] += 1
            columns = [pa.array([r.digest for r in found], pa.int64()), pa.array([r.article for r in found], pa.bool_()), pa.array([k if not r.article else [] for r, k in zip(found, runs, strict=True)], pa.list_(pa.int64())), pa.nulls(len(found), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(2), *columns, rb.column(4)], names)
        if hits:
            yield counted()

    first = materialised(pages.mapInArrow(seen, f"id {types['id']}, url {types['url']}, host string, digest long, article boolean, runs array<long>, hits array<int>, shards long"), "seen")
    whole = first.where("digest IS NOT NULL")
    share = F.greatest(F.lit(SITE_PAGES), F.ceil(F.lit(SITE_SHARE) * F.count_distinct("digest"))).cast("long")
    sizes = whole.groupBy("host").agg(share.alias("least"), F.max("shards").alias("shards"), F.count_if(~F.col("article")).alias("open"))

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.array(x, np.int64) for x in table.column("hits").to_pylist()], axis=0)
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * CHUNK, pa.string()), "slot": pa.array(chunk * CHUNK + np.arange(CHUNK)), "n": pa.array(total)})

    slots = first.where("digest IS NULL").select("host", F.col("runs")[0].alias("chunk"), "hits").groupBy("host", "chunk").applyInArrow(added, "host string, slot long, n long")
    full = slots.join(sizes, "host").where("n >= least").groupBy("host").agg(F.collect_list("slot").alias("slots"))
    # Hosts where something has to be counted: of most nothing is on a share of all pages.
    asked = materialised(sizes.join(full, "host", "left").where("slots IS NOT NULL OR open > 0").select("host", "least", "shards", F.col("open") > 0, F.coalesce("slots", F.array().cast("array<long>")).alias("slots")).toDF("host", "least", "shards", "open", "slots"), "asked")

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of each page that are to be counted; ``likely`` those in full slots."""
        known: dict[str, int] = {}
        for rb in batches:
            for host, source, open_, slots in zip(*(rb.column(i).to_pylist() for i in range(4)), strict=True):
                page = rest(source)
                keys, full = _page_runs(page, known), np.zeros(SLOTS, bool)
                full[np.array(slots, np.int64)] = True
                likely = full[keys & (SLOTS - 1)]
                kept = likely | open_
                keys, likely = keys[kept], likely[kept]
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array(np.full(len(keys), page.digest, np.int64)), pa.array(keys), pa.array(likely)], ["host", "digest", "run", "likely"])

    found = pages.select("host", "html").join(broadcast_if_small(asked.select("host", "open", "slots")), "host").select("host", "html", "open", "slots").mapInArrow(runs_of, "host string, digest long, run long, likely boolean")
    mine = whole.where("NOT article").withColumn("shard", place).select("host", "shard", F.explode("runs").alias("run")).distinct()
    wanted = mine.select("host", "run").distinct().withColumn("open_run", F.lit(True))
    held = found.join(wanted, ["host", "run"], "left").where("likely OR open_run").groupBy("host", "run").agg(F.count_distinct("digest").alias("n"))
    held = materialised(held.where(F.col("n") >= MIN_PAGES), "held")
    site = held.join(asked, "host").where("n >= least").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "run", F.lit(True).alias("site"))
    return mine.join(held, ["host", "run"]).select("host", "shard", "run", F.lit(False).alias("site")).unionByName(site)
