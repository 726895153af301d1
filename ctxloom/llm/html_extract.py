"""Main text of web pages, by differencing each page against its nearest by URL.

A page is cut into blocks of text with the zone that its markup puts them in: boilerplate elements,
the body, or an article. Pages are sorted by host and path; each is paired with the neighbour whose
path shares the longer beginning, and the two pages' lines are aligned by their longest common
subsequence. Shared lines are deleted, on pages with an article as on those without. The check after
it is exact and corrects the differencing where markup is certain: lines inside an article stay
though a copy shares them, and lines of boilerplate elements go though no neighbour has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import slices

BOILERPLATE, BODY, MAIN = 0, 1, 2

#: Elements of HTML by what they do to text.
HIDDEN = set("script style noscript template svg math iframe object embed canvas audio video head title select datalist".split())
CHROME = set("nav header footer aside form menu dialog button textarea fieldset search".split())
BREAKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option optgroup p pre section summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CHROME_NAMES = set("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promotion recommended related replies reply respond share sharing sidebar skyscraper social sponsor sponsored subscribe toolbar widget".split())
CHROME_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())


def _is_chrome(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    if tag in CHROME:
        return True
    if tag in ("html", "body", "article", "main"):
        names = ("class", "id") if tag == "article" else ()
    else:
        names = ("class", "id")
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return tag not in ("html", "body")
        if value and name == "role" and value.lower() in CHROME_ROLES:
            return True
        if value and name in names and any(_named(word) for word in value.lower().split()):
            return True
    return False


def _named(word: str) -> bool:
    return any(part in CHROME_NAMES for part in (word, *word.replace("_", "-").split("-")))


class Blocks(HTMLParser):
    """Collects (zone, text) of the blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str]] = []
        self.piece: list[str] = []
        self.open: list[tuple[str, str]] = []  # (tag, kind); kind: hidden, chrome, main or nothing

    def zone(self) -> int:
        kinds = {kind for _, kind in self.open}
        return BOILERPLATE if "chrome" in kinds else MAIN if "main" in kinds else BODY

    def cut(self) -> None:
        text = " ".join("".join(self.piece).split())
        if text:
            self.found.append((self.zone(), text))
        self.piece.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("td", "th"):
            self.piece.append(" ")
        if tag in VOID:
            if tag in BREAKS:
                self.cut()
            return
        kind = "hidden" if tag in HIDDEN else "chrome" if _is_chrome(tag, attrs) else "main" if tag in ("article", "main") or ("role", "main") in attrs else ""
        if tag in BREAKS or kind:
            self.cut()
        if tag in ("p", "li", "option", "dt", "dd") and self.open and self.open[-1][0] == tag:
            self.open.pop()
        if kind == "main":  # a boilerplate element that was never closed does not hold the article
            self.open = [x for x in self.open if x[1] != "chrome" or x[0] not in ("div", "p", "span")]
        if kind or self.open and (tag in {x[0] for x in self.open if x[1]} or tag in ("p", "li")):
            self.open.append((tag, kind))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BREAKS:
            self.cut()

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS or tag in HIDDEN:
            self.cut()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if self.open[i][1]:
                    self.cut()
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if not any(kind == "hidden" for _, kind in self.open):
            self.piece.append(data)


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every block, in page order."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    return parser.found


def common_lines(own: list[int], other: list[int]) -> list[bool]:
    """Which of `own` lie on a longest common subsequence with `other` (bit-parallel, then traced back)."""
    out, first = [False] * len(own), 0
    while first < min(len(own), len(other)) and own[first] == other[first]:
        out[first] = True
        first += 1
    end, end2 = len(own), len(other)
    while end > first and end2 > first and own[end - 1] == other[end2 - 1]:
        end, end2 = end - 1, end2 - 1
        out[end] = True
    places: dict[int, int] = {}
    for i, line in enumerate(own[first:end]):
        places[line] = places.get(line, 0) | 1 << i
    full = (1 << (end - first)) - 1
    state, states = full, []
    for line in other[first:end2]:
        hit = state & places.get(line, 0)
        state = ((state + hit) | (state - hit)) & full
        states.append(state)
    row, column = len(states), end - first
    while row and column:
        if states[row - 1] >> (column - 1) & 1:
            column -= 1
        else:
            row -= 1
            if not (row and not states[row - 1] >> (column - 1) & 1):
                column -= 1
                out[first + column] = True
    return out


def _host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _key(url: str | None, found: list[tuple[int, str]]) -> tuple[str, str, bytes, list[int]]:
    """Host, path, a key of both and all lines, and the lines' hashes."""
    host, path = _host_and_path(url)
    digests = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for _, x in found]
    whole = hashlib.blake2b("\0".join((host, path)).encode("utf-8", "surrogatepass") + b"".join(digests), digest_size=16)
    return host, path, whole.digest(), [int.from_bytes(x, "big", signed=True) for x in digests]


def _outline(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the key and the hashes of its lines alone."""
    for frame in slices(frames, 2):
        rows = [_key(url, blocks(html.as_py())) for url, html in zip(frame.column(1).to_pylist(), frame.column(2), strict=True)]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "path", "key", "hashes"])


def _candidates(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the lines that no boilerplate element holds, with their places among all lines and whether an article holds them."""
    for frame in slices(frames, 2):
        rows = []
        for url, html in zip(frame.column(1).to_pylist(), frame.column(2), strict=True):
            found = blocks(html.as_py())
            kept = [(text, at, zone == MAIN) for at, (zone, text) in enumerate(found) if zone != BOILERPLATE]
            rows.append((_key(url, found)[2], *(list(c) for c in zip(*kept, strict=True)), len(found)) if kept else (_key(url, found)[2], [], [], [], len(found)))
        kinds = (pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64())
        yield pa.RecordBatch.from_arrays([*frame.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["page_id", "url", "key", "lines", "places", "main", "n_lines"])


def neighbours(urls: DataFrame) -> DataFrame:
    """key, other: for distinct (host, path, key), the neighbour in sorted order with the longer common path.

    The order is dealt out by ranges, so that a large host is many partitions; only the first and
    last row of each partition meet in one task.
    """
    row = F.struct("host", "path", "key")
    dealt = urls.repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id())
    placed = materialise(dealt, "urls").withColumn("row", row)
    ends = placed.groupBy("part").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    over = Window.orderBy("part")
    ends = ends.select("part", F.lag("high").over(over).alias("below"), F.lead("low").over(over).alias("above"))
    inside = Window.partitionBy("part").orderBy("row")
    both = placed.withColumn("before", F.lag("row").over(inside)).withColumn("after", F.lead("row").over(inside)).join(ends, "part")
    both = both.select("row", F.coalesce("before", "below").alias("before"), F.coalesce("after", "above").alias("after"))

    def near(side: str):
        same = F.expr(f"array_position(transform(sequence(1, greatest(1, least(length(row.path), length({side}.path)))), i -> substring(row.path, i, 1) = substring({side}.path, i, 1)), false)")
        length = F.when(same == 0, F.least(F.length("row.path"), F.length(f"{side}.path"))).otherwise(same - 1)
        return F.when(F.col(f"{side}.host") == F.col("row.host"), length).otherwise(-1)

    near_before, near_after = F.coalesce(near("before"), F.lit(-1)), F.coalesce(near("after"), F.lit(-1))
    other = F.when(F.greatest(near_before, near_after) < 0, None).when(near_before >= near_after, F.col("before.key")).otherwise(F.col("after.key"))
    return both.select(F.col("row.key").alias("key"), other.alias("other")).where("other is not null")


def _align(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        shared = [common_lines(a, b) for a, b in zip(frame.column(1).to_pylist(), frame.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(shared, pa.list_(pa.bool_()))], names=["key", "shared"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines and n_shared (lines shared with the paired page) of every page.

    Null and empty html give an empty text. A page without another of its host shares nothing.
    Pages of equal URL and lines count as one in pairing, so copies don't delete each other. Null
    URLs are a host of their own; of two neighbours with as long a common path the one before is the
    pair. Pages are parsed twice: pairing and aligning need only hashes of lines, and texts are
    shuffled once, without the lines of boilerplate elements.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    outlines = materialise(rows.mapInArrow(_outline, "host string, path string, key binary, hashes array<long>"), "outlines")
    distinct = outlines.select("key", "hashes").dropDuplicates(["key"])
    pairs = neighbours(outlines.select("host", "path", "key").distinct())
    aligned = pairs.join(distinct, "key").join(distinct.select(F.col("key").alias("other"), F.col("hashes").alias("theirs")), "other").select("key", "hashes", "theirs").mapInArrow(_align, "key binary, shared array<boolean>")
    found = rows.mapInArrow(_candidates, "page_id long, url string, key binary, lines array<string>, places array<int>, main array<boolean>, n_lines long").join(aligned, "key", "left")
    text = F.array_join(F.expr("filter(lines, (x, i) -> main[i] or not coalesce(shared[places[i]], false))"), "\n")
    shared = F.coalesce(F.expr("size(filter(shared, x -> x))"), F.lit(0)).cast("long")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "n_lines", F.when(F.col("shared").isNull(), 0).otherwise(shared).alias("n_shared"))
