"""From pages to sources, claims and contradictions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

MIN_TEXT, CLAIMS_PER_SOURCE, CONFIDENCE = 200, 12, 0.55

#: Elements whose text is left out, and those that begin a line.
SKIPPED = {"script", "style", "noscript", "svg"}
LINES = {"p", "br", "li", "h1", "h2", "h3", "h4", "blockquote"}


OPENS, CLOSES, TEXT = 1, -1, 0


class _Events(HTMLParser):
    """A page as a flat list of (what happens, to which element or text)."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.found: list[tuple[int, str]] = []
        self.handle_starttag = lambda tag, _: self.found.append((OPENS, tag))
        self.handle_endtag = lambda tag: self.found.append((CLOSES, tag))
        self.handle_data = lambda data: self.found.append((TEXT, data))
        self.feed(html)
        self.close()


def _title_and_text(html: str | None) -> tuple[str, str]:
    """White space collapsed; how deep each event lies in elements that are left out is a running sum that never falls below 0."""
    events = _Events(html or "").found
    depths = accumulate((kind * (name in SKIPPED) if kind else 0 for kind, name in events), lambda depth, step: max(0, depth + step), initial=0)
    titles = accumulate(events, lambda inside, e: e[0] == OPENS if e[0] and e[1] == "title" else inside, initial=False)
    seen = [(kind, value, title) for (kind, value), depth, title in zip(events, islice(depths, 1, None), islice(titles, 1, None), strict=True) if kind == OPENS and value in LINES or kind == TEXT and not depth]
    text = "".join("\n" if kind else value for kind, value, _ in seen)
    return " ".join("".join(value for kind, value, title in seen if title and not kind).split()), " ".join(text.split())


def html_to_text(pages: DataFrame, least: int = MIN_TEXT) -> DataFrame:
    """page_id, url, title, text, rejected: white space collapsed; a text under `least` characters is rejected. The title stays part of the text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            titles, texts = zip(*(_title_and_text(html.as_py()) for html in frame.column(2)), strict=True) if len(frame) else ((), ())
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "title", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, title string, text string")
    return out.withColumn("rejected", F.length("text") < least)


def claims(sources: DataFrame, most: int = CLAIMS_PER_SOURCE) -> DataFrame:
    """source_id, pos, text, evidence_type, confidence: the first sentences that read as claims, of sources (source_id, text, source_class)."""
    split = sources.select("source_id", "source_class", F.posexplode(text.sentences(F.col("text"))).alias("pos", "text")).where(text.is_claim(F.col("text")))
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))
    return split.withColumn("_n", n).where(F.col("_n") <= most).select("source_id", "pos", "text", text.evidence_type(F.col("source_class")).alias("evidence_type"), F.lit(CONFIDENCE).alias("confidence"))


def unprocessed(sources: DataFrame, claims_: DataFrame) -> DataFrame:
    """Sources without claims that were read or whose extraction failed."""
    return sources.where(F.col("status").isin("read", "extraction_failed")).join(claims_, "source_id", "left_anti")


def new_urls(found: DataFrame, known: DataFrame) -> DataFrame:
    """The first row of each (project, url) that is not known."""
    n = F.row_number().over(Window.partitionBy("project", "url").orderBy("seq"))
    return found.withColumn("_n", n).where("_n = 1").drop("_n").join(known, ["project", "url"], "left_anti")


def relevant(title: Column, snippet: Column, url: Column, anchors: Column, keywords: Column) -> Column:
    """An anchor in the title, or one anywhere and a keyword in the title."""
    low = F.lower(title)
    everywhere = F.lower(F.concat_ws(" ", title, snippet, url))
    in_title = F.exists(anchors, lambda a: F.contains(low, a))
    return in_title | (F.exists(anchors, lambda a: F.contains(everywhere, a)) & F.exists(keywords, lambda k: F.contains(low, k)))


def status(sources: DataFrame, claims_: DataFrame, by: str = "project") -> DataFrame:
    """Counts of sources and claims, and their classes and types as maps."""

    def histogram(df: DataFrame, key: str, total: str, name: str) -> DataFrame:
        counts = df.groupBy(by, key).agg(F.count("*").alias("n"))
        return counts.groupBy(by).agg(F.sum("n").alias(total), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    return histogram(sources, "source_class", "sources", "source_classes").join(histogram(claims_, "evidence_type", "claims", "evidence_types"), by, "left")


def report_lines(claims_: DataFrame, sources: DataFrame) -> DataFrame:
    """section, seq, line of a report: findings that cite their source, then the sources."""
    found = claims_.select(F.lit(1).alias("section"), F.col("claim_id").alias("seq"), F.format_string("- **%s** (%.0f%%): %s [S%d]", "evidence_type", F.col("confidence") * 100, "text", "source_id").alias("line"))
    listed = sources.select(F.lit(2).alias("section"), F.col("source_id").alias("seq"), F.format_string("- **[S%d]** [%s](%s) — %s", "source_id", "title", "url", "source_class").alias("line"))
    return found.unionByName(listed)
