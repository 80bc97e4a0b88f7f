"""Main text of web pages: marked articles by their markup, the rest by suffix arrays over each host's pages.

A page is cut into blocks. Blocks of menus, headers, footers, sidebars, notices, adverts, forms and comments are furniture; blocks of a
marked article are content; the other blocks are open, and furniture beside a large article. The words of all blocks of a host's pages are
concatenated and their suffixes sorted; runs that stand on a share of the host's distinct pages are boilerplate, and content and open
blocks keep what no such run covers. In content the share is higher. A host of many pages is dealt over tasks: each proposes the runs of
that share among its own pages, among which are all that have it over the host, and those are counted over all pages.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm.jaccard import word_hashes
from finfacts.llm.shared import bitmap, marked, written
from finfacts.llm.url_rules import host_of

#: Words of the shortest run that counts as repeated; a power of two.
RUN = 8
#: Distinct pages on which a run must stand at least; on a host of FLOOR distinct pages or more, on that many.
PAGES, FLOOR = 2, 4
#: Percent of a host's distinct pages on which a run must stand to be boilerplate in an open block, and in a marked article.
OPEN_PERCENT, CONTENT_PERCENT = 10, 50
#: Where repeats cover so many percent of a page on a host of less than FLOOR distinct pages, the pages are versions of one.
COPY_PERCENT = 75
#: Marked articles of so many times the words of a page's open blocks make these furniture.
ARTICLE_LEAD = 2
#: Characters of the pages of one task. A host with more is dealt over several, of SHARD_PAGES distinct pages each at least; its runs
#: are counted over all of them.
SHARD_CHARS, SHARD_PAGES = 4_000_000, 64

CONTENT, OPEN, FURNITURE = 0, 1, 2

# Element names and words of class and id attributes.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr
ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("head title nav footer header aside form button select option dialog menu fieldset".split())
NEVER = frozenset("html body main".split())
HINTS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted
promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
COMMENTS = frozenset("comment comments reply replies".split())
# Words that only say where or how such a block stands. A class or id all of HINTS and these names furniture; with any other word in it,
# as in search-results-article or comment-free, it says nothing.
PLACES = frozenset("""area bar block bottom box button col column container content fixed form group header holder inner item items left
links list main outer page panel post primary right row secondary section site slot sticky text the title top unit wrap wrapper""".split())
# Left out up to their end tag; where it is missing, or the tag closes itself, only the tag is.
EMBEDDED = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in "noscript template svg iframe object math audio video canvas".split()}

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)>", re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names(attributes: str, hints: frozenset[str]) -> bool:
    """Whether some class, id or role names one of hints and, beside that, nothing but places."""
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORDS.findall(token)}
            if words & hints and words <= hints | PLACES:
                return True
    return False


def _kind(name: str, attributes: str) -> int | None:
    if name in SKIPPED:
        return FURNITURE
    if name in NEVER:
        return CONTENT if name == "main" else None
    if attributes:
        if _names(attributes, COMMENTS if name == "article" else HINTS):
            return FURNITURE
    return CONTENT if name == "article" else None


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the blocks of a page in order. White space within a block is one space; empty blocks are left out."""
    found: list[tuple[str, int]] = []
    if not page:
        return found
    opened: list[tuple[str, int | None]] = []
    furniture = content = at = 0
    parts: list[str] = []
    endless: set[str] = set()

    def close_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((text, FURNITURE if furniture else CONTENT if content else OPEN))
            parts.clear()

    while m := _PIECE.search(page, at):
        if m.start() > at:
            parts.append(html.unescape(page[at:m.start()]))
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, ending = name.lower(), bool(m[2] or m[5])
        if name in EMBEDDED and not ending and not (m[4] or m[7] or "").endswith("/") and name not in endless:
            end = EMBEDDED[name].search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            close_block()
        if name in VOID:
            continue
        if ending:
            for place in range(len(opened) - 1, -1, -1):
                if opened[place][0] == name:
                    for _, kind in opened[place:]:
                        furniture -= kind == FURNITURE
                        content -= kind == CONTENT
                    del opened[place:]
                    break
            continue
        if name == "body":
            opened.clear()
            furniture = content = 0
        kind = _kind(name, m[4] or m[7] or "")
        if name == "header" and content:
            kind = None  # the heading of the article itself
        if kind is not None or name in BLOCKS:
            opened.append((name, kind))
            furniture += kind == FURNITURE
            content += kind == CONTENT
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    close_block()
    words = [sum(t.count(" ") + 1 for t, k in found if k == kind) for kind in (CONTENT, OPEN)]
    if words[0] >= ARTICLE_LEAD * words[1]:
        return [(t, FURNITURE if k == OPEN else k) for t, k in found] if words[0] else found
    # Marked articles that are small beside the open blocks, such as teasers, say nothing about these.
    return [(t, OPEN if k == CONTENT else k) for t, k in found]


def ranks(words: np.ndarray, pages: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every suffix by its first run words, from 1, and whether it has as many on its page.

    words are the numbers of the words of the concatenated pages, pages the page of each. Ranks are doubled until they compare run words;
    the suffixes in that order are the suffix array to that depth.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    # A suffix that runs into another page is cut there: beyond its page every place ranks 0.
    last = np.searchsorted(pages, pages, "right")
    width = 1
    while width < run:
        ahead = np.zeros(n, np.int64)
        inside = np.arange(n) + width < last
        ahead[inside] = rank[np.flatnonzero(inside) + width]
        rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return rank, np.arange(n) + run <= last


def pages_by_rank(rank: np.ndarray, whole: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """For each rank the number of distinct pages on which its run stands whole."""
    counts = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
    places = np.flatnonzero(whole)
    suffixes = places[np.argsort(rank[places], kind="stable")]  # stable: places of one rank are in order of page
    fresh = (np.diff(rank[suffixes], prepend=-1) != 0) | (np.diff(pages[suffixes], prepend=-1) != 0)
    np.add.at(counts, rank[suffixes[fresh]], 1)
    return counts


def covered(hits: np.ndarray, run: int = RUN) -> np.ndarray:
    """Whether each place lies in a run that begins at a hit."""
    cover = np.zeros(len(hits) + run, np.int64)
    cover[:len(hits)] += hits
    cover[run:] -= hits
    return np.cumsum(cover[:len(hits)]) > 0


def repeated(words: np.ndarray, pages: np.ndarray, run: int = RUN, least: int = PAGES) -> np.ndarray:
    """Whether each word lies in a run of at least run words that stands on at least least distinct pages."""
    rank, whole = ranks(words, pages, run)
    return covered(whole & (pages_by_rank(rank, whole, pages)[rank] >= least), run)


def long_stretches(hit: np.ndarray, run: int = RUN) -> np.ndarray:
    """hit without its stretches of fewer than run places: a run that only reaches into a block from the next one takes nothing there."""
    edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    result = np.zeros(len(hit), bool)
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        result[first:last] = last - first >= run
    return result


def least_pages(distinct: int, kind: int) -> int:
    """On how many of a host's distinct pages a run must stand to be boilerplate in blocks of a kind."""
    if kind == CONTENT:
        return max(FLOOR, -(-distinct * CONTENT_PERCENT // 100))
    return max(PAGES, min(distinct, FLOOR), -(-distinct * OPEN_PERCENT // 100))


def _numbered(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    number: dict[str, int] = {}
    words = np.array([number.setdefault(w, len(number)) for s in streams for w in s], np.int64)
    return words, np.repeat(np.arange(len(streams)), [len(s) for s in streams])


def _streams(pages: list[list[tuple[str, int]]]) -> list[list[str]]:
    return [[w for text, _ in page for w in text.split(" ")] for page in pages]


def candidates(pages: list[list[tuple[str, int]]]) -> dict[str, int]:
    """The runs that stand on the least share of these distinct pages, with the number of pages each.

    A run on that share of all pages of a host stands on as large a share of at least one of the parts they are dealt into.
    """
    streams = _streams(pages)
    words, owners = _numbered(streams)
    rank, whole = ranks(words, owners)
    counts = pages_by_rank(rank, whole, owners)
    often = np.flatnonzero(whole & (counts[rank] * 100 >= OPEN_PERCENT * len(pages)))
    firsts = often[np.unique(rank[often], return_index=True)[1]]
    flat = [w for s in streams for w in s]
    return {" ".join(flat[i:i + RUN]): int(counts[rank[i]]) for i in firsts.tolist()}


def run_counts(pages: list[list[tuple[str, int]]], runs: list[str]) -> list[int]:
    """For each of runs on how many of pages it stands."""
    streams = _streams(pages)
    words, owners = _numbered(streams + [r.split(" ") for r in runs])
    rank, whole = ranks(words, owners)
    n = len(words) - RUN * len(runs)
    counts = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
    found = pages_by_rank(rank[:n], whole[:n], owners[:n])
    counts[:len(found)] = found
    return counts[rank[n::RUN]].tolist()


def kept_texts(pages: list[list[tuple[str, int]]], runs: dict[str, int], distinct: int) -> list[list[str]]:
    """For some pages of a host, (text, kind) of the blocks each: the content and open blocks without the host's boilerplate.

    runs has the host's frequent runs with the number of its distinct pages they stand on. A block all covered goes; of another, the
    stretches of RUN covered words or more.
    """
    streams = _streams(pages)
    words, owners = _numbered(streams + [r.split(" ") for r in runs])
    rank, whole = ranks(words, owners)
    n = len(words) - RUN * len(runs)
    often = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
    often[rank[n::RUN]] = list(runs.values())
    stands = np.where(whole[:n], often[rank[:n]], 0)
    hits = {kind: covered(stands >= least_pages(distinct, kind)) for kind in (CONTENT, OPEN)}
    at, result = 0, []
    for page in pages:
        kept, size, gone, first = [], 0, 0, at
        for text, kind in page:
            own = text.split(" ")
            if kind != FURNITURE:
                hit = hits[kind][at:at + len(own)]
                rest = [] if hit.all() else [w for w, c in zip(own, long_stretches(hit), strict=True) if not c]
                if rest:
                    kept.append(" ".join(rest))
                size, gone = size + len(own), gone + len(own) - len(rest)
            at += len(own)
        # On a host of so few pages what is nearly a whole page is a copy of it, as for mobiles or print.
        if distinct < FLOOR and 100 * gone >= COPY_PERCENT * size:
            kept = marked_text(page)
        result.append(kept)
    return result


def marked_text(page: list[tuple[str, int]]) -> list[str]:
    return [text for text, kind in page if kind != FURNITURE]


#: Bits of the filter of boilerplate runs for each run, bits that a run sets, and most bits: 64 MB in every task.
BITS_PER_RUN, HITS, MOST_BITS = 32, 8, 1 << 29


def run_cells(text: str, host: str, bits: int) -> np.ndarray:
    """The bits of the filter that the runs of a text set, a row for each place; A-Z count as a-z here."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))[0]
    n = max(0, len(words) - RUN + 1)
    start = int.from_bytes(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    mixed = np.full(n, start, np.uint64)
    for j in range(RUN):
        mixed = (mixed ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    step = (mixed * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return ((mixed[:, None] + np.arange(HITS, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def touched(page: list[tuple[str, int]], host: str, filters: dict[int, np.ndarray], bits: int) -> bool:
    """Whether a run that may be boilerplate for blocks of a kind reaches into such a block of the page."""
    kinds = np.repeat([k for _, k in page], [t.count(" ") + 1 for t, _ in page])
    cells = run_cells(" ".join(t for t, _ in page), host, bits)

    def reached(bitmap_: np.ndarray) -> np.ndarray:
        hits = np.zeros(len(kinds), bool)
        hits[:len(cells)] = marked(bitmap_, cells).all(1)
        return covered(hits)

    return any((reached(f) & (kinds == k)).any() for k, f in filters.items())


def hit_pages(batch: pa.RecordBatch, filters: dict[int, np.ndarray], bits: int) -> np.ndarray:
    """Whether each page of a batch is touched; pages without a block of a kind that has a filter are not looked into."""
    at = {n: i for i, n in enumerate(batch.schema.names)}
    lists = batch.column(at["blocks"])
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    of_kind = np.isin(lists.flatten().field("kind").to_numpy(zero_copy_only=False), list(filters))
    some = np.diff(np.concatenate([[0], np.cumsum(of_kind)])[np.concatenate([[0], np.cumsum(sizes)])]) > 0
    hosts, keys = batch.column(at["host"]).to_pylist(), batch.column(at["key"])
    hit = some & keys.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(hit).tolist():
        hit[i] = bool(hosts[i]) and touched([(b["text"], b["kind"]) for b in lists[i].as_py()], hosts[i], filters, bits)
    return hit


BLOCK_LIST = "array<struct<text:string,kind:int>>"
PARSED = f"page_id long, url string, blocks {BLOCK_LIST}, key string, chars long"


def _pairs(column: pa.ChunkedArray) -> list[list[tuple[str, int]]]:
    return [[(b["text"], b["kind"]) for b in page] for page in column.to_pylist()]


def main_texts(pages: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (columns page_id, url and html are read).

    A null or empty html, and a page all of furniture, gives the empty text. Pages of a host with equal texts outside furniture count as
    one page, and each keeps its text. Pages without a host share nothing with each other. An empty table gives no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32())]))
        for batch in batches:
            found = [blocks(h) for h in batch.column(2).to_pylist()]
            # A page all of furniture is told from others by that.
            texts = ["\n".join(marked_text(page) or [t for t, _ in page]) for page in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([[{"text": t, "kind": k} for t, k in page] for page in found], kind),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() if t else None for t in texts], pa.string()),
                pa.array([sum(len(t) for t, _ in page) for page in found], pa.int64()),
            ], names=["page_id", "url", "blocks", "key", "chars"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(parse, PARSED)
    parsed = written(read.withColumn("row", F.monotonically_increasing_id()).withColumn("host", host_of(F.col("url"))), "parsed-pages")
    sizes = written(parsed.where("key is not null and host <> ''").groupBy("host").agg(
        F.sum("chars").alias("chars"), F.countDistinct("key").alias("distinct_pages")).where("distinct_pages > 1"), "host-sizes")
    # A host is dealt finer where the session asks for more shuffle tasks; what counts as boilerplate does not depend on it.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    most = max(1, min(shard_chars, total // tasks))
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("chars") / most), F.floor(F.col("distinct_pages") / SHARD_PAGES))).cast("int")
    hosts = sizes.select("host", "distinct_pages", shards.alias("shards"))

    def dealt(rows: DataFrame, over: DataFrame) -> DataFrame:
        # Dealt in one exchange by both columns: one by host alone would put a host into one task.
        spread = rows.join(over, "host").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
        return spread.repartition(tasks, "host", "shard")

    def shards_of(runs: DataFrame) -> DataFrame:
        every = runs.join(hosts, "host").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        return every.select("host", "shard", "run", "n").repartition(tasks, "host", "shard")

    def firsts(group: pa.Table) -> list[list[tuple[str, int]]]:
        """One page of each key."""
        _, places = np.unique(np.array(group.column("key").to_pylist(), object), return_index=True)
        return _pairs(group.column("blocks").take(pa.array(places)))

    def propose(group: pa.Table) -> pa.Table:
        distinct, parts = group.column("distinct_pages")[0].as_py(), group.column("shards")[0].as_py()
        # Of a host in one piece the counts are final.
        least = least_pages(distinct, OPEN) if parts == 1 else 1
        found = {r: n for r, n in candidates(firsts(group)).items() if n >= least}
        return pa.table({"host": pa.array([group.column("host")[0].as_py()] * len(found), pa.string()), "run": pa.array(list(found), pa.string()),
                         "n": pa.array(list(found.values()), pa.int64()), "final": pa.array([parts == 1] * len(found), pa.bool_())})

    def count(key: tuple, group: pa.Table, runs: pa.Table) -> pa.Table:
        asked = runs.column("run").to_pylist()
        found = run_counts(firsts(group), asked) if asked and group.num_rows else [0] * len(asked)
        return pa.table({"host": pa.array([key[0].as_py()] * len(asked), pa.string()), "run": pa.array(asked, pa.string()), "n": pa.array(found, pa.int64())})

    def sweep(key: tuple, group: pa.Table, runs: pa.Table) -> pa.Table:
        known = dict(zip(runs.column("run").to_pylist(), runs.column("n").to_pylist(), strict=True))
        texts = kept_texts(_pairs(group.column("blocks")), known, group.column("distinct_pages")[0].as_py()) if group.num_rows else []
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "kept": pa.array(texts, pa.list_(pa.string()))})

    def filter_of(runs_of: dict[int, DataFrame]) -> tuple[int, dict[int, np.ndarray]]:
        """A filter of the runs for blocks of each kind that has any."""
        size = min(MOST_BITS, max(1 << 16, BITS_PER_RUN * max(r.count() for r in runs_of.values())))

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [run_cells(r, h, size).ravel() for h, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["cell"])

        made: dict[int, tuple[DataFrame, np.ndarray]] = {}
        for kind, runs in runs_of.items():
            same = next((f for r, f in made.values() if r is runs), None)
            made[kind] = (runs, bitmap(runs.select("host", "run").mapInArrow(cells, "cell long"), size) if same is None else same)
        return size, {kind: f for kind, (_, f) in made.items() if f.any()}

    ready = parsed.where("key is not null").select("host", "key", "blocks")
    proposed = written(dealt(ready, hosts).groupBy("host", "shard").applyInArrow(propose, "host string, run string, n long, final boolean"), "run-candidates")
    # Counted over all pages of their host; those that hold none of them do not move for it.
    to_count = written(proposed.where("not final").select("host", "run", "n").dropDuplicates(["host", "run"]), "runs-to-count")
    count_bits, asked_for = filter_of({kind: to_count for kind in (CONTENT, OPEN, FURNITURE)})
    asked_of = pages.sparkSession.sparkContext.broadcast(asked_for)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hit_pages(batch, asked_of.value, count_bits)))

    several = dealt(ready.mapInArrow(holding, ready.schema), hosts.where("shards > 1")).groupBy("host", "shard").cogroup(shards_of(to_count).groupBy("host", "shard"))
    counted = several.applyInArrow(count, "host string, run string, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))
    least = F.greatest(F.lit(PAGES), F.least(F.col("distinct_pages"), F.lit(FLOOR)), F.ceil(F.col("distinct_pages") * OPEN_PERCENT / 100))
    counted = counted.join(hosts, "host").where(F.col("n") >= least).select("host", "run", "n")
    frequent = written(proposed.where("final").select("host", "run", "n").unionAll(counted), "frequent-runs")

    # A page keeps what its markup says, and does not move, unless a run that is boilerplate on its host may reach into a block that stays.
    sized = frequent.join(hosts.select("host", "distinct_pages"), "host")
    content_least = F.greatest(F.lit(FLOOR), F.ceil(F.col("distinct_pages") * CONTENT_PERCENT / 100))
    bits, filters = filter_of({OPEN: sized, CONTENT: sized.where(F.col("n") >= content_least)})
    held = pages.sparkSession.sparkContext.broadcast(filters)

    def parted(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(hit_pages(batch, held.value, bits) == wanted))

        return parsed.mapInArrow(run, parsed.schema)

    clear, maybe = parted(False), parted(True)
    listed = hosts.select(F.col("host").alias("_host"))
    known = maybe.join(listed, F.col("host") == F.col("_host"), "left_semi")
    unknown = maybe.join(listed, F.col("host") == F.col("_host"), "left_anti")
    swept = dealt(known.drop("chars", "row"), hosts).groupBy("host", "shard").cogroup(shards_of(frequent).groupBy("host", "shard")).applyInArrow(
        sweep, "page_id long, url string, kept array<string>")
    plain = clear.unionAll(unknown).select(
        "page_id", "url", F.transform(F.filter("blocks", lambda b: b["kind"] != FURNITURE), lambda b: b["text"]).alias("kept"))
    text = F.coalesce(F.array_join("kept", "\n"), F.lit(""))
    return plain.unionByName(swept).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
