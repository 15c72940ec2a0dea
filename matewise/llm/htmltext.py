"""Main text of HTML pages, with a suffix array per host against boilerplate.

A page becomes blocks of text, each with a zone: ``main`` (inside an article or main
element), ``chrome`` (menus, headers, footers, sidebars, notices, adverts, forms,
comments), ``plain`` (anything else in the body) or ``loose`` (as plain, but in no paragraph,
heading or other element for text).  The pages of a host are
concatenated as token streams; a suffix array over them, sorted to the depth of the
shortest long substring, finds every substring of ``least`` tokens that occurs, and on how
many distinct pages, and so which tokens of each block are covered by repeats.

Chrome is never text.  Where a page marks its main part, its blocks are the text, elsewhere
the plain blocks are, in both cases but for boilerplate; if that leaves nothing, all of them
stay.  Boilerplate are the runs of tokens in substrings that recur on most of the host's distinct
pages (:class:`Rule`); they are cut out, and a block's other runs stay.  Articles may share passages, so
what recurs on fewer pages, a tenth at least, is boilerplate only with its place as further evidence:
loose blocks that are mostly covered by it and lie at a page's rim, with nothing but chrome and
such blocks before them, or behind.

Hosts are cut into chunks of about ``chunk_pages`` pages, or ``chunk_bytes`` of them, by hash of
their content, so a host with a third of all pages is many tasks.  Results don't depend on the
cut: a substring on a share of a host's pages is on half that share of the pages of some chunk,
and what its chunks tell of it leaves it possible (:func:`likely`).  These few candidates are
counted on every page of the host, by 64-bit hashes of the substrings; a chunk builds its suffix
array once.  Pages with equal HTML are one page in all counts.

Edge cases: null and empty pages give an empty text; a null or odd URL has the empty
host; repeated rows are copies of each other and returned each; unclosed elements end
with their parent; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import discard, stash
from .runs import by_run

ZONES = {"main": "m", "chrome": "c", "plain": "p", "loose": "l"}

#: A comment, a tag (attributes with quoted values, or failing that anything up to >), or a declaration.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attributes>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|(?P<rest>[^>]*)>)"
    r"|<[!?][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_WORDS = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math".split())
MAIN = frozenset("article main".split())
CHROME = frozenset(
    "head nav footer aside form button select menu dialog script style noscript template iframe object canvas audio video svg".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold text of their own; of others, text is loose.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th caption figcaption summary address body html".split())
#: An open element of the value's kinds ends where one of the key's kind starts.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}
}
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations sidebar widget menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments disqus replies login signin signup "
    "search toolbar skip paywall".split()
)
KEEPS = frozenset("html body article main".split())


@dataclass
class Block:
    text: str
    zone: str


def _is_chrome(name: str, attributes: str, in_main: bool) -> bool:
    if name in CHROME or (name == "header" and not in_main):
        return True
    if name in KEEPS or not attributes.strip():
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value.strip() in CHROME_ROLES:
            return True
        if key in ("class", "id") and not CHROME_NAMES.isdisjoint(_WORDS.split(value)):
            return True
    return False


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # element, zone within it
    zone, at, end = "plain", 0, page.rfind(">") + 1  # no tag ends behind that

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                loose = zone == "plain" and bool(stack) and stack[-1][0] not in TEXTUAL
                out.append(Block(text, "loose" if loose else zone))

    while at < end:
        tag = _TAG.search(page, at, end)
        stop = tag.start() if tag else end
        if stop > at:
            parts.append(page[at:stop])
        if not tag:
            break
        at = tag.end()
        closing, name = tag["close"], (tag["name"] or "").lower()
        attributes = tag["attributes"] if tag["attributes"] is not None else tag["rest"] or ""
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    zone = stack[-1][1] if stack else "plain"
                    break
            continue
        if name == "body":  # ends an unclosed head
            stack = [x for x in stack if x[0] == "html"]
            zone = stack[-1][1] if stack else "plain"
        elif name in ENDS and stack and stack[-1][0] in ENDS[name]:
            stack.pop()
            zone = stack[-1][1] if stack else "plain"
        elif name in BLOCK and stack and stack[-1][0] == "p":
            stack.pop()
            zone = stack[-1][1] if stack else "plain"
        if name in RAW:
            closed = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = closed.end() if closed else end
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name not in BLOCK and name not in CHROME:
            if zone == "chrome" or not attributes or not _is_chrome(name, attributes, zone == "main"):
                continue  # inline elements without a zone of their own need no place
            flush()
        inner = zone
        if zone != "chrome":
            if _is_chrome(name, attributes, zone == "main"):
                inner = "chrome"
            elif name in MAIN:
                inner = "main"
        if inner != zone:
            flush()
        stack.append((name, inner))
        zone = inner
    parts.append(page[max(at, end) :].partition("<!--")[0])
    flush()
    return out


@dataclass(frozen=True)
class Rule:
    """What makes boilerplate: substrings that recur on enough of the host's distinct pages.

    Anywhere these are a ``main_share`` of them, and ``least_main_pages`` at least; for loose blocks at the
    rim, covered to ``covered`` or more, a ``plain_share`` and ``least_pages``.  Of a block covered that much
    only runs of ``least_run`` other tokens stay; from others, only runs of as many covered ones are cut.
    """

    covered: float = 0.8
    plain_share: float = 0.1
    least_pages: int = 3
    main_share: float = 0.5
    least_main_pages: int = 5
    least_run: int = 8

    def __post_init__(self) -> None:
        if not 0 < self.plain_share <= self.main_share <= 1 or not 0 < self.least_pages <= self.least_main_pages:
            raise ValueError("the main part needs as many pages as plain blocks at least")

    def plain_pages(self, pages: int) -> float:
        return max(self.least_pages, self.plain_share * pages)

    def main_pages(self, pages: int) -> float:
        return max(self.least_main_pages, self.main_share * pages)


@dataclass
class Repeats:
    """The substrings of ``least`` tokens of some streams: distinct ones are classes, in order of their first suffix's rank."""

    sizes: np.ndarray
    least: int
    suffixes: np.ndarray  # start of each, by class
    first: np.ndarray  # index of each class's first suffix
    counts: np.ndarray  # streams that hold each class

    def covered(self, counts: np.ndarray, pages: float) -> list[np.ndarray]:
        """For each stream, which tokens lie in a substring that ``pages`` streams hold."""
        total = int(self.sizes.sum())
        edges = np.zeros(total + 1, np.int64)
        runs = np.diff(np.append(self.first, len(self.suffixes)))
        starts = self.suffixes[np.repeat(counts >= pages, runs)]
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + self.least, -1)
        return np.split(np.cumsum(edges[:-1]) > 0, np.cumsum(self.sizes)[:-1])


def repeats(streams: list[np.ndarray], least: int, counted: np.ndarray | None = None) -> Repeats:
    """Classes of equal substrings of ``least`` token ids; only streams that are ``counted`` count.

    ``least`` is a power of two: suffixes are sorted by prefix doubling to that depth.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    total, none = int(sizes.sum()), np.empty(0, np.int64)
    if not total:
        return Repeats(sizes, least, none, none, none)
    page = np.repeat(np.arange(len(streams)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # tokens to the end of the stream
    rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < least:
        ahead = np.full(total, -1, np.int64)
        ahead[: total - depth] = rank[depth:]
        ahead[left <= depth] = -1
        rank = np.unique(rank * (total + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[left[suffixes] >= least]
    if not len(suffixes):
        return Repeats(sizes, least, none, none, none)
    order, home = rank[suffixes], page[suffixes]
    change = np.concatenate(([True], order[1:] != order[:-1]))
    # within a class suffixes are in stream order, so each stream shows once
    seen = change | np.concatenate(([True], home[1:] != home[:-1]))
    if counted is not None:
        seen &= counted[home]
    first = np.flatnonzero(change)
    return Repeats(sizes, least, suffixes, first, np.add.reduceat(seen.astype(np.int64), first))


def repeated_tokens(streams: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each stream of token ids, which tokens lie in a substring of ``least`` or more that another stream holds too."""
    found = repeats(streams, least)
    return found.covered(found.counts, 2)


class Chunk:
    """Pages of one host: their distinct contents, as token streams."""

    def __init__(self, parsed: list[list[Block]], contents: list | None = None, counted: list[bool] | None = None, least: int = 8) -> None:
        """``contents`` tells which pages are equal, ``counted`` which of them count here."""
        at: dict = {}
        contents = contents or [tuple((b.zone, b.text) for b in page) for page in parsed]
        self.which = [at.setdefault(key, len(at)) for key in contents]
        self.pages: list[list[Block]] = [[] for _ in at]
        self.counted, self.least = np.zeros(len(at), bool), least
        for k, page, c in zip(self.which, parsed, counted or [True] * len(parsed)):
            self.pages[k] = page
            self.counted[k] |= c
        self.n_pages = int(self.counted.sum())

    @cached_property
    def words(self) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
        """Distinct words, each page's stream of their numbers, and the ends of its blocks in it."""
        ids: dict[str, int] = {}
        streams, ends = [], []
        for page in self.pages:
            each = [b.text.split(" ") for b in page]
            streams.append(np.array([ids.setdefault(w, len(ids)) for ws in each for w in ws], dtype=np.int64))
            ends.append(np.cumsum([0, *map(len, each)]))
        return list(ids), streams, ends

    @cached_property
    def repeats(self) -> Repeats:
        return repeats(self.words[1], self.least, self.counted)

    @cached_property
    def hashes(self) -> np.ndarray:
        """A hash of the ``least`` tokens from each place on, the same in every chunk; meaningless where fewer follow."""
        words, streams, _ = self.words
        word = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
        tokens = word[np.concatenate(streams)] if words else np.empty(0, np.uint64)
        tokens = np.concatenate((tokens, np.zeros(self.least, np.uint64)))
        out = np.zeros(len(tokens) - self.least, np.uint64)
        for k, f in enumerate(np.random.default_rng(8).integers(0, 1 << 63, self.least, np.uint64)):
            out += tokens[k : k + len(out)] * (f << np.uint64(1) | np.uint64(1))
        out ^= out >> np.uint64(31)
        return (out * np.uint64(0x94D049BB133111EB)).view(np.int64)

    def on_share(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(hash, pages) of the substrings on at least this share of the chunk's pages, from its suffix array."""
        found = self.repeats
        some = np.flatnonzero((found.counts > 0) & (found.counts >= share * self.n_pages))
        return self.hashes[found.suffixes[found.first[some]]], found.counts[some]

    def _places(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where substrings with a hash of ``some`` (sorted) start: place, page, index in ``some``."""
        sizes = np.array([len(s) for s in self.words[1]], np.int64)
        page = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(page))
        at = np.minimum(np.searchsorted(some, self.hashes), len(some) - 1)
        places = np.flatnonzero((some[at] == self.hashes) & (left >= self.least))
        return places, page[places], at[places]

    def count(self, some: np.ndarray) -> np.ndarray:
        """On how many counted pages substrings with these hashes (sorted) are."""
        _, page, at = self._places(some)
        pairs = np.unique(np.stack([at, page])[:, self.counted[page]], axis=1)
        return np.bincount(pairs[0], minlength=len(some))

    def _covered(self, counts: np.ndarray, pages: float, some: np.ndarray | None) -> list[np.ndarray]:
        if some is None:
            return self.repeats.covered(counts, pages)
        some = some[counts >= pages]
        if not len(some):
            return [np.zeros(len(s), bool) for s in self.words[1]]
        sizes = np.array([len(s) for s in self.words[1]], np.int64)
        edges = np.zeros(int(sizes.sum()) + 1, np.int64)
        places, _, _ = self._places(some)
        np.add.at(edges, places, 1)
        np.add.at(edges, places + self.least, -1)
        return np.split(np.cumsum(edges[:-1]) > 0, np.cumsum(sizes)[:-1])

    def texts(self, pages: int, rule: Rule, some: np.ndarray | None = None, counts: np.ndarray | None = None) -> list[tuple[str, int, int]]:
        """(text, tokens, repeated tokens) of each page of a host of ``pages`` distinct ones.

        ``some`` (sorted hashes) and ``counts`` tell what the host's pages share; without them the chunk is the whole host.
        """
        counts = self.repeats.counts if some is None else counts
        out = []
        plain, main = (self._covered(counts, n, some) for n in (rule.plain_pages(pages), rule.main_pages(pages)))
        for page, end, often, most in zip(self.pages, self.words[2], plain, main):
            zones = ("main",) if any(b.zone == "main" for b in page) else ("plain", "loose")
            spans = list(zip(end, end[1:]))
            outer = [b.zone == "chrome" or (b.zone == "loose" and often[a:z].mean() >= rule.covered) for b, (a, z) in zip(page, spans)]
            rim = at_rim(outer) if "loose" in zones else [False] * len(page)
            text = [(b.text, "" if r else unique_runs(b.text, most[a:z], rule)) for b, r, (a, z) in zip(page, rim, spans) if b.zone in zones]
            kept = [own for _, own in text if own] or [t for t, _ in text]
            out.append(("\n".join(kept), int(end[-1]), int(often.sum())))
        return [out[k] for k in self.which]


def at_rim(outer: list[bool]) -> list[bool]:
    """Which blocks have only ``outer`` ones, themselves included, before them or behind."""
    first = next((i for i, x in enumerate(outer) if not x), len(outer))
    last = next((i for i in range(len(outer) - 1, -1, -1) if not outer[i]), -1)
    return [i < first or i > last for i in range(len(outer))]


def unique_runs(text: str, covered: np.ndarray, rule: Rule) -> str:
    """A block without its covered runs.

    If they are most of it, short runs between them go too; if not, short covered runs stay (a repeated
    substring that begins in the block before may end in this one).
    """
    if not covered.any():
        return text
    mostly = covered.mean() >= rule.covered
    words, out = text.split(" "), []
    cuts = np.flatnonzero(np.diff(covered)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
        if (not covered[a] and z - a >= rule.least_run) if mostly else (not covered[a] or z - a < rule.least_run):
            out += words[a:z]
    return " ".join(out)


def main_texts(pages: list[str | None], least: int = 8, rule: Rule = Rule()) -> list[tuple[str, int, int]]:
    """(text, tokens, tokens in what enough pages for plain boilerplate share) of the pages of one host."""
    chunk = Chunk([blocks(p) for p in pages], pages, least=least)
    return chunk.texts(chunk.n_pages, rule)


def likely(told: DataFrame, rule: Rule) -> DataFrame:
    """(host, chunks, pages, print) of the substrings that can be on enough pages of their host.

    ``told`` has what chunks tell: (host, chunks, pages, print, n, of), n of a chunk's ``of`` pages, where
    that is half the wanted share at least.  Chunks that tell nothing have less than that half.
    """
    half = rule.plain_share / 2
    summed = told.groupBy("host", "chunks", "pages", "print").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    most = F.col("n") + F.lit(half) * (F.col("pages") - F.col("of"))
    enough = F.greatest(F.lit(float(rule.least_pages)), F.lit(rule.plain_share) * F.col("pages"))
    return summed.where(most >= enough - 1e-6).select("host", "chunks", "pages", "print")


def chunk_key(host: Column, chunk: Column) -> Column:
    return F.xxhash64(host, chunk.cast("long"))


def to_chunks(hosts: DataFrame) -> DataFrame:
    """Rows (host, chunks, ...) to every chunk of their host, as ``group``."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    return hosts.select("*", each).withColumn("group", chunk_key(F.col("host"), F.col("chunk"))).drop("chunk")


def parse(rows: DataFrame) -> DataFrame:
    """``rows`` with blob and size, the blocks of each page in compressed form, in place of html."""
    names = [c for c in rows.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            packed, sizes = [], []
            for p in batch.column("html"):
                plain = "\n".join(ZONES[b.zone] + b.text for b in blocks(p.as_py())).encode("utf-8", "surrogatepass")
                packed.append(codec.compress(plain, asbytes=True))
                sizes.append(len(plain))
            columns = [*(batch.column(c) for c in names), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "blob", "size"])

    schema = StructType([*(rows.schema[c] for c in names), StructField("blob", BinaryType()), StructField("size", LongType())])
    return rows.mapInArrow(run, schema)


def read_chunk(some: pa.Table) -> Chunk:
    codec, names = pa.Codec("zstd"), {v: k for k, v in ZONES.items()}
    parsed = []
    for blob, size in zip(some.column("blob").to_pylist(), some.column("size").to_pylist()):
        text = codec.decompress(blob, size, asbytes=True).decode("utf-8", "surrogatepass") if size else ""
        parsed.append([Block(x[1:], names[x[0]]) for x in text.split("\n") if x])
    return Chunk(parsed, some.column("content").to_pylist(), some.column("counted").to_pylist())


def _host_rows(some: pa.Table, prints: np.ndarray, **more: object) -> pa.Table:
    first = {c: pa.array([some.column(c)[0].as_py()] * len(prints), some.schema.field(c).type) for c in ("host", "chunks", "pages")}
    return pa.table(first | {"print": pa.array(prints)} | {k: pa.array(v, pa.int64()) for k, v in more.items()})


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    chunk_pages: int = 256,
    chunk_bytes: int = 1 << 26,
    broadcast_hosts: int = 100_000,
    rule: Rule = Rule(),
) -> DataFrame:
    """One row per page: id, url, text, n_chars, n_tokens, n_repeated (tokens in what a share of the host's pages hold)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    rows = rows.withColumns({"content": F.xxhash64("html"), "row": F.xxhash64("id", "url")})
    contents = rows.groupBy("host", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row").alias("first"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes")
    )
    contents = stash(contents, "contents")
    parts = lambda n, size: F.ceil(F.greatest(F.col(n) / chunk_pages, F.col(size) / chunk_bytes))
    hosts = contents.groupBy("host").agg(F.sum("copies").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("pages"))
    large = stash(hosts.withColumn("chunks", parts("rows", "bytes")).where("chunks > 1").select("host", "pages", "chunks"), "hosts")
    # a content with many copies is spread, and counts in one place only
    spread = F.ceil(4 * F.greatest(F.col("copies") / chunk_pages, F.col("bytes") / chunk_bytes))
    copied = contents.withColumn("spread", F.least(spread, "copies")).where("spread > 1").select("host", "content", "first", "spread")
    copied = stash(copied, "copied")
    discard(contents)
    small = lambda x: F.broadcast(x) if x.count() <= broadcast_hosts else x
    one = F.lit(1).cast("long")
    salt = F.pmod("row", F.coalesce("spread", one))
    placed = (
        rows.join(small(large), "host", "left")
        .join(small(copied), ["host", "content"], "left")
        .withColumn("chunk", F.pmod(F.xxhash64("content", salt), F.coalesce("chunks", one)))
        .select(
            chunk_key(F.col("host"), F.col("chunk")).alias("group"),
            "host",
            F.coalesce("chunks", one).alias("chunks"),
            F.coalesce("pages", one).alias("pages"),
            F.coalesce(salt == F.pmod("first", F.col("spread")), F.lit(True)).alias("counted"),
            "content",
            "id",
            "url",
            "html",
        )
    )
    work = parse(placed).repartition("group")
    names = ["id", "url", "text", "n_chars", "n_tokens", "n_repeated"]
    kinds = [pages.schema[id_col].dataType, StringType(), StringType(), *[LongType()] * 3]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_run(batches, ["group"]):
            if some.column("chunks")[0].as_py() > 1:
                chunk = read_chunk(some)
                prints, n = chunk.on_share(rule.plain_share / 2)
                yield from _host_rows(some, prints, n=n, of=np.full(len(n), chunk.n_pages)).to_batches()

    def count(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(some) or not len(asked):
            return pa.table({"host": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in ("chunks", "pages", "print", "n")}})
        prints = np.unique(asked.column("print").to_numpy())
        return _host_rows(some, prints, n=read_chunk(some).count(prints))

    def finish(some: pa.Table, boiler: pa.Table) -> pa.Table:
        if not len(some):
            return to_arrow_schema(schema).empty_table()
        chunk, order = read_chunk(some), np.argsort(boiler.column("print").to_numpy())
        if some.column("chunks")[0].as_py() == 1:
            found = chunk.texts(chunk.n_pages, rule)
        else:
            found = chunk.texts(some.column("pages")[0].as_py(), rule, *(boiler.column(c).to_numpy()[order] for c in ("print", "n")))
        texts = [x[0] for x in found]
        numbers = [[len(t) for t in texts], [x[1] for x in found], [x[2] for x in found]]
        columns = [some.column("id"), some.column("url"), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)]
        return pa.table(dict(zip(names, columns)))

    schema = StructType([StructField(*x) for x in zip(names, kinds)])
    told = work.sortWithinPartitions("group").mapInArrow(tell, "host string, chunks long, pages long, print long, n long, of long")
    asked = to_chunks(likely(told, rule)).select("group", "print")
    counted = work.groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(count, "host string, chunks long, pages long, print long, n long")
    totals = counted.groupBy("host", "chunks", "pages", "print").agg(F.sum("n").alias("n"))
    enough = F.greatest(F.lit(float(rule.least_pages)), F.lit(rule.plain_share) * F.col("pages"))
    boiler = to_chunks(totals.where(F.col("n") >= enough)).select("group", "print", "n")
    return work.groupBy("group").cogroup(boiler.groupBy("group")).applyInArrow(finish, schema)
