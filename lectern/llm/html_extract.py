"""Main text of web pages: page structure, and the word runs that a host's pages repeat, in their main part and outside."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, Words, discard, mix, numbered, slices, small_side, staged

#: Words of a repeated run at least, and distinct pages of a host that must have it.
RUN, MIN_PAGES = 5, 3
#: Words of a repeated run in a main part at least: sentences that articles have in common are shorter. A main part of
#: which more than MOST_PERCENT would go is a copy of an article rather than boilerplate, and stays whole.
MAIN_RUN, MOST_PERCENT = 25, 50
#: Suffixes of an array that one task compares with their neighbours.
BLOCK = 4_096
#: Bits of the table of repeated anchors, a power of two; a false hit there costs time and changes nothing.
ANCHOR_BITS = 1 << 27
#: Pages with repeated runs up to which these are broadcast; beyond that the join shuffles.
PAGES = 50_000

# Elements by role, and names in class, id or role that mark boilerplate.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title"}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu"}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "widget",
}
#: In a main part, names on these mark nothing: they hold its own text.
OWN = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figure", "figcaption", "main"}
#: A value in quotes may hold < and >; a quote elsewhere is a character like others, and < without its > is text.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>])((?:=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["'])|[^<>=])*)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Parts that may stand beside a mark in a name, as in social-links or cookie-banner-inner; other words, as in ad-hoc or related-work, make another name.
BESIDE = set("area articles bar block body bottom box btn button buttons col container content default desktop float fixed global group icons inner item items left link links list main mobile new outer overlay panel pop popular posts primary right row secondary section site slot small space sticky stories text thread title toggle top unit user wrap zone".split())
#: Parts of a name that speaks of a page's layout and not of the element, as with-sidebar does.
LAYOUT = {"with", "without", "no", "not", "has", "layout", "wrapper", "page"}
#: Elements of running text, whose names mark nothing in a main part.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "math", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
_SPLIT = re.compile(r"[^a-z]+")


def _marked(attributes: str, own: bool) -> bool:
    """Whether a name marks boilerplate. own: of a main part, where an id is an anchor that a title gave."""
    if "=" not in attributes:
        return False
    names = (name for m in _NAMES.findall(attributes) if not (own and m[0].lower() == "id") for name in "".join(m[1:]).lower().split())
    return any(not MARKS.isdisjoint(parts) and LAYOUT.isdisjoint(parts) and MARKS.union(BESIDE, {""}).issuperset(parts) for parts in map(_SPLIT.split, names))


def blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """Text blocks of a page in their order: in the article or main part, in what structure marks as boilerplate, and elsewhere."""
    import html

    main, dropped, loose = [], [], []
    stack: list[list] = []  # open elements that matter: name, dropped, main
    text: list[str] = []
    is_dropped = is_main = False
    open_names: dict[str, int] = {}  # how many of each name the stack holds
    n_dropped = n_main = 0
    no_end: set[str] = set()  # raw elements without an end tag in what is left of the page

    def popped(i: int) -> None:
        nonlocal n_dropped, n_main, is_dropped, is_main
        for x in stack[i:]:
            open_names[x[0]] -= 1
            n_dropped, n_main = n_dropped - bool(x[1]), n_main - bool(x[2])
        del stack[i:]
        is_dropped, is_main = n_dropped > 0, n_main > 0

    def close_block() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                (dropped if is_dropped else main if is_main else loose).append(words)

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            text.append(page[at:])
            break
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in BLOCKS or name in DROPPED:
                close_block()
            if open_names.get(name):
                close_block()
                i = len(stack) - 1
                while stack[i][0] != name:  # each step takes an element off
                    i -= 1
                popped(i)
            continue
        if name in RAW:
            over = None if name in no_end or found[3].rstrip().endswith("/") and name in ("svg", "iframe", "object") else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if over is None and not found[3].rstrip().endswith("/"):
                no_end.add(name)
            at = over.end() if over else end if name in ("script", "style") else at  # others without an end tag are skipped alone
            continue
        block = name in BLOCKS or name in DROPPED
        if block:
            close_block()
            if stack and stack[-1][0] in ("p", "li", "dt", "dd") and (stack[-1][0] == name or stack[-1][0] == "p"):
                popped(len(stack) - 1)
        if name in VOID or found[3].rstrip().endswith("/") or name in ("html", "body"):
            continue
        own = is_main or name in ("article", "main")
        bad = name in DROPPED or not (own and (name in OWN or name in INLINE) or name in ("article", "body", "html")) and _marked(found[3], own)
        begins_main = name in ("article", "main") and not bad
        if begins_main and not is_main:  # what holds the main part is no boilerplate, whatever its class says
            for x in stack:
                x[1] = x[1] and (x[0] in DROPPED or x[0] == "article")
            n_dropped = sum(bool(x[1]) for x in stack)
            is_dropped = n_dropped > 0
        if bad and not block:
            close_block()
        # Other elements are followed too where they may nest within one that matters by name.
        if bad or begins_main or open_names.get(name) or (stack and name not in ("p", "li", "dt", "dd", "b", "i", "a", "em", "strong")):
            stack.append([name, bad, begins_main])
            open_names[name] = open_names.get(name, 0) + 1
            n_dropped, n_main = n_dropped + bool(bad), n_main + bool(begins_main)
            is_dropped, is_main = n_dropped > 0, n_main > 0
    close_block()
    return main, dropped, loose


def _parse(run: int):
    """Task function: main text, or the loose blocks of a page without one, and the suffixes of the page's stream outside its main part, cut at `run` words."""

    def task(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows = {"text": [], "loose": [], "suffixes": []}
            for page in batch.column("html").to_pylist():
                main, dropped, loose = blocks(page or "")
                stream = [w for b in (dropped + loose if main else loose + dropped) for w in b.split()]
                keys = {int.from_bytes(hashlib.blake2b("\0".join(stream[i : i + run]).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for i in range(len(stream) - run + 1)}
                rows["text"].append("\n".join(main) if main else None)
                rows["loose"].append(None if main else loose)
                rows["suffixes"].append(sorted(keys))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(rows["text"], pa.string()), pa.array(rows["loose"], strings), pa.array(rows["suffixes"], pa.list_(pa.int64()))],
                names=["page_id", "url", "host", "text", "loose", "suffixes"],
            )

    return task


def _windows(words: Words, host: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, with its text's host in it, and whether the text has that many."""
    m = max(len(words.hashes) - n + 1, 0)
    h = host[words.doc[:m]]
    with np.errstate(over="ignore"):
        for i in range(n):
            h = mix(h * _BASE + words.hashes[i : i + m])
    return h, words.doc[:m] == words.doc[n - 1 : n - 1 + m]


def _anchored(words: Words, host: np.ndarray, run: int, long: int):
    """First word, main text and anchor of each run of `long` words of the main texts.

    The anchor is the least hash of the runs of `run` words in it, so equal long runs have equal anchors.
    """
    host = host.view(np.uint64)
    whole, ok = _windows(words, host, long)
    short, _ = _windows(words, host, run)
    anchor = np.minimum.reduce([short[k : k + len(whole)] for k in range(long - run + 1)]) if len(whole) else whole
    return np.flatnonzero(ok), words.doc[: len(whole)][ok], anchor[ok].view(np.int64)


def _keys(rows: np.ndarray, keys: np.ndarray, n: int):
    """The distinct keys of each of n rows as an Arrow list."""
    import pyarrow as pa

    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    rows, keys = rows[first], keys[first]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(keys, pa.int64()))


def _anchors(run: int, long: int):
    """Task function: the distinct anchors of each page."""

    def task(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            _, row, anchor = _anchored(Words(batch.column("text")), np.asarray(batch.column("hosted").to_pylist(), np.int64), run, long)
            yield pa.RecordBatch.from_arrays([_keys(row, anchor, len(batch))], names=["anchors"])

    return task


def _suffixes(table, run: int, long: int):
    """Task function: the suffixes of main texts at which a long run with a repeated anchor begins, as its words' hashes."""

    def task(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            words, hosted = Words(batch.column("text")), np.asarray(batch.column("hosted").to_pylist(), np.int64)
            at, _, anchor = _anchored(words, hosted, run, long)
            bit = anchor & (ANCHOR_BITS - 1)
            at = at[(table.value[bit >> 6] >> (bit & 63)) & 1 == 1]
            heads = (words.hashes[at[:, None] + np.arange(long)] & np.uint64(0x7FFF)).astype(np.int16)  # 15 bits a word, hundreds a run
            doc = words.doc[at]
            head = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * long, pa.int32()), pa.array(heads.ravel(), pa.int16()))
            version = np.asarray(batch.column("version").to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hosted[doc]), pa.array(version[doc]), pa.array((at - words.first[doc]).astype(np.int32)), head], names=["hosted", "version", "at", "head"])

    return task


def _cut(long: int):
    """Task function: main texts without the words that repeated long runs cover."""

    def task(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            main = batch.column("text").to_pylist()
            words = Words(pa.array(main, pa.string()))
            covered = np.zeros(len(words.hashes) + 1, np.int64)
            at = np.concatenate([words.first[i] + np.asarray(x, np.int64) for i, x in enumerate(batch.column("repeated").to_pylist())]) if main else np.zeros(0, np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + long, -1)
            keep, k, out = np.cumsum(covered)[:-1] == 0, 0, []
            gone = np.add.reduceat(np.append(~keep, False).astype(np.int64), words.first[:-1]) if len(main) else []
            for i, text in enumerate(main):
                if 100 * gone[i] > MOST_PERCENT * (words.first[i + 1] - words.first[i]):
                    k += int(words.first[i + 1] - words.first[i])
                    out.append(text)
                    continue
                lines = []
                for line in text.split("\n"):
                    own = line.split(" ")
                    left = [w for w, stays in zip(own, keep[k : k + len(own)], strict=True) if stays]
                    k += len(own)
                    if left:
                        lines.append(" ".join(left))
                out.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return task


def _repeated_in_main(mains: DataFrame, run: int, long: int, min_pages: int) -> DataFrame:
    """version and the first words of the runs of each main text (version, hosted, text) that `min_pages` texts of its host have.

    The suffixes of a host's texts are sorted by ranges, neighbours are compared, and the distinct texts of each interval
    of long common prefixes are counted. Only suffixes with a repeated anchor are sorted: no other can have an equal one.
    """
    spark = mains.sparkSession
    counted = mains.mapInArrow(_anchors(run, long), "anchors array<long>").select(F.explode("anchors").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    bit = F.col("key").bitwiseAND(ANCHOR_BITS - 1)
    bits = counted.filter(F.col("n") >= min_pages).groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits"))
    found = bits.toArrow()  # at most ANCHOR_BITS / 64 rows
    table = np.zeros(ANCHOR_BITS // 64, np.int64)
    table[np.asarray(found.column("at"), np.int64)] = np.asarray(found.column("bits"), np.int64)
    held = spark.sparkContext.broadcast(table)
    suffixes = staged(mains.mapInArrow(_suffixes(held, run, long), "hosted long, version long, at int, head array<smallint>"), "suffixes")
    array = numbered(suffixes, ["hosted"], ["head", "version", "at"], "suffix-array")
    discard(suffixes)  # the array is a table of its own
    rows = _intervals(array, long, min_pages)
    discard(array)
    return staged(rows.groupBy("version").agg(F.collect_list("at").alias("repeated")), "repeated-runs")


def _neighbours(long: int):
    """Task function: suffixes as they come, with the words that each has in common with the one before it in the array, where that came just before.

    A head stays only beside a neighbour that did not; elsewhere it is null, so that it is not shuffled.
    """

    def task(batches):
        import pyarrow as pa

        def row(batch, common, alone):
            keep = (common < 0) | alone
            head = batch.column("head").take(pa.array(np.arange(len(batch)), mask=~keep))
            return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int32(), mask=common < 0), head], names=["hosted", "pos", "version", "at", "common", "head"])

        last, known = None, -1
        for batch in batches:
            if not len(batch):
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            hosted, pos = (batch.column(c).to_numpy() for c in ("hosted", "pos"))
            heads = batch.column("head").flatten().to_numpy().reshape(len(batch), long)
            follows = (hosted[1:] == hosted[:-1]) & (pos[1:] == pos[:-1] + 1)
            differ = heads[1:] != heads[:-1]
            common = np.append(known, np.where(follows, np.where(differ.any(1), differ.argmax(1), long), -1))
            yield row(batch.slice(0, len(batch) - 1), common[:-1], ~follows)
            last, known = batch.slice(len(batch) - 1), common[-1]
        if last is not None:
            yield row(last, np.array([known]), np.array([True]))

    return task


def _intervals(array: DataFrame, long: int, least: int = 1) -> DataFrame:
    """Rows of a suffix array (hosted, pos: place in it, head, version, at) in intervals of `least` texts or more, with the place at which their interval begins and its texts.

    An interval holds the suffixes whose common prefix with the one before is `long` words at least. Neighbours are
    compared as they are read, or else within blocks of the array, into which the last suffix of the block before is
    copied; an interval that runs over several blocks has the start that the blocks before have left open. Its suffixes lie in the order of their
    versions, so its distinct texts are as many as its changes of version. An interval within a block is counted there,
    and its rows are done. For one at the edge of a block the counts of its blocks are summed, and only its rows are
    joined with them, by a row for each block.
    """
    block = F.floor(F.col("pos") / BLOCK)
    schema = f"hosted long, pos long, version long, at int, common int, head {array.schema['head'].dataType.simpleString()}"
    rows = array.select("hosted", "pos", "version", "at", "head").mapInArrow(_neighbours(long), schema)
    rows = rows.withColumn("block", F.explode(F.when(F.col("pos") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy("hosted", "block").orderBy("pos")
    common = F.array_position(F.zip_with("head", "before", lambda x, y: x == y), False) - 1  # -1: they agree in all
    common = F.when(F.col("common").isNotNull(), F.col("common")).when(F.col("before").isNull(), 0).when(common < 0, long).otherwise(common)
    rows = rows.withColumn("before", F.lag("head").over(w)).withColumn("earlier", F.lag("version").over(w)).withColumn("common", common)
    rows = rows.filter(F.floor(F.col("pos") / BLOCK) == F.col("block")).withColumn("start", F.when(F.col("common") < long, F.col("pos")))
    new = F.col("start").isNotNull() | (F.col("version") != F.col("earlier"))
    rows = rows.select("hosted", "block", "version", "at", F.max("start").over(w).alias("start"), new.cast("int").alias("new"))
    texts = F.sum("new").over(Window.partitionBy("hosted", "block", "start"))
    whole = Window.partitionBy("hosted", "block")
    # Only a full block can have one after it, into which its last interval runs on.
    edge = F.col("start").isNull() | ((F.col("start") == F.max("start").over(whole)) & (F.count("*").over(whole) == BLOCK))
    rows = rows.withColumn("texts", texts).withColumn("edge", edge).filter(F.col("edge") | (F.col("texts") >= least))
    rows = staged(rows.drop("new"), "suffix-neighbours")
    inner = rows.filter("not edge").select("hosted", "version", "at", F.col("start").alias("interval"), "texts")
    outer = rows.filter("edge").drop("edge")

    last = outer.groupBy("hosted", "block").agg(F.max("start").alias("last"), F.max_by("texts", F.coalesce("start", F.lit(-1))).alias("ending"), F.max(F.when(F.col("start").isNull(), F.col("texts"))).alias("beginning"))
    open_ = F.max("last").over(Window.partitionBy("hosted").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    last = staged(last.withColumn("carried", open_), "open-intervals")
    pieces = last.select("hosted", F.coalesce("last", "carried").alias("interval"), F.col("ending").alias("n"))
    pieces = pieces.unionByName(last.filter("last is not null and beginning is not null").select("hosted", F.col("carried").alias("interval"), F.col("beginning").alias("n")))
    sums = pieces.groupBy("hosted", "interval").agg(F.sum("n").alias("n"))
    summed = lambda start, name: sums.select("hosted", F.col("interval").alias(start), F.col("n").alias(name))
    edges = last.select("hosted", "block", "last", "carried").join(summed("last", "last_texts"), ["hosted", "last"], "left").join(summed("carried", "carried_texts"), ["hosted", "carried"], "left")
    total = F.when(F.col("start").isNull(), F.col("carried_texts")).otherwise(F.col("last_texts"))
    outer = outer.join(small_side(staged(edges, "interval-texts")), ["hosted", "block"]).select("hosted", "version", "at", F.coalesce("start", "carried").alias("interval"), total.alias("texts"))
    return inner.unionByName(outer.filter(F.col("texts") >= least))


def _unique_runs(run: int):
    """Task function: loose blocks without the words that repeated runs cover."""

    def task(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for loose, repeated in zip(batch.column("loose").to_pylist(), batch.column("repeated").to_pylist(), strict=True):
                stream = [(k, w) for k, b in enumerate(loose) for w in b.split()]
                known, covered = set(repeated or ()), [False] * len(stream)
                for i in range(len(stream) - run + 1):
                    key = hashlib.blake2b("\0".join(w for _, w in stream[i : i + run]).encode("utf-8", "replace"), digest_size=8).digest()
                    if int.from_bytes(key, "big", signed=True) in known:
                        covered[i : i + run] = [True] * run
                left: dict[int, list[str]] = {}
                for (k, w), c in zip(stream, covered, strict=True):
                    if not c:
                        left.setdefault(k, []).append(w)
                out.append("\n".join(" ".join(words) for words in left.values()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return task


def extract(pages: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """Main text of each row of pages (page_id, url, html): page_id, url, text, n_chars.

    The text is that of the blocks inside article or main elements, or of all blocks of a page without such; what
    structure or names mark as boilerplate is left out. Then the words go that a repeated run covers: in a main part
    one of MAIN_RUN words or more that stands in the main parts of `min_pages` pages of the host; on a page
    without main part one of `run` words or more outside the main parts. Words of main parts are compared without ASCII
    case. A main part of which more than MOST_PERCENT of the words would go stays whole.

    Main parts go through a suffix array of their host: suffixes are sorted by ranges of their first MAIN_RUN words,
    so that a host of any size is dealt over tasks, and intervals of neighbours with so long a common prefix are the
    repeated runs (a longer repeat is the union of such runs at its places). Only suffixes whose anchor, the least of
    the windows of `run` words in their run, is repeated in the host are sorted; no other can have a neighbour that
    agrees so far. Short runs outside main parts are counted by hash.

    Short runs are counted by host and key with partial counts, so that a host with a third of all pages is no single task.

    A null html gives an empty text; a null url is a host of its own; repeated rows are all returned. Rows with
    equal page_id count as one page of a host; for runs in main parts, rows with equal main text do, so that copies of an article
    do not remove each other. An empty table gives an empty one.
    """
    id_kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    parsed = staged(source.mapInArrow(_parse(run), f"page_id {id_kind}, url string, host string, text string, loose array<string>, suffixes array<long>").withColumn("row", F.monotonically_increasing_id()), "parsed-pages")

    hosted = parsed.filter("text is not null").select("row", "page_id", "url", "text", F.xxhash64("host").alias("hosted"), F.xxhash64("host", "text").alias("version"))
    copies = staged(hosted.groupBy("version").agg(F.min("row").alias("row"), F.count("*").alias("n")).filter("n > 1").select("version", F.col("row").alias("first")), "page-copies")
    mains = hosted.join(small_side(copies, PAGES), "version", "left").filter("first is null or first = row").select("version", "hosted", "text")
    found = small_side(_repeated_in_main(mains, run, MAIN_RUN, min_pages), PAGES)
    with_main = hosted.join(found, "version", "left")
    done = with_main.filter("repeated is null").select("page_id", "url", "text")
    cut = with_main.filter("repeated is not null").select("page_id", "url", "text", "hosted", "repeated").mapInArrow(_cut(MAIN_RUN), f"page_id {id_kind}, url string, text string")

    open_pages = parsed.filter("text is null")
    array = parsed.select("host", "page_id", F.explode("suffixes").alias("key")).distinct().groupBy("host", "key").agg(F.count("*").alias("pages"))
    repeated = array.filter(F.col("pages") >= min_pages).select("host", "key")
    own = open_pages.select("row", "host", F.explode("suffixes").alias("key")).join(repeated, ["host", "key"]).groupBy("row").agg(F.collect_list("key").alias("repeated"))
    rest = open_pages.select("row", "page_id", "url", "loose").join(own, "row", "left").select("page_id", "url", "loose", "repeated")
    rest = rest.mapInArrow(_unique_runs(run), f"page_id {id_kind}, url string, text string")
    return done.unionByName(cut).unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
