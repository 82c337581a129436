"""Web pages: URL rules, fetching and main text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.scratch import written


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def raw_url(url: Column) -> Column:
    """Trimmed; a page that shows a file of a code host becomes the raw file's address."""
    url = F.trim(url)
    parts = F.regexp_extract(_path(url), "^/([^/]+)/([^/]+)/blob/(.+)$", 0)
    raw = F.concat(F.lit("https://raw.githubusercontent.com"), F.regexp_replace(parts, "^/([^/]+)/([^/]+)/blob/(.+)$", "/$1/$2/$3"))
    return F.when((_host(url) == "github.com") & (parts != ""), raw).otherwise(url)


def canonical_name(url: Column) -> Column:
    """Last part of the path, else the host; with ``.html`` if it has no dot."""
    last = F.regexp_extract(F.regexp_replace(_path(url), "/+$", ""), "([^/]*)$", 1)
    name = F.when(last != "", last).when(_host(url) != "", _host(url)).otherwise(url)
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(name, F.lit(".html")))


def extension(url: Column) -> Column:
    """``.md``, ``.markdown``, ``.rst`` or ``.txt`` of the path, ``.md`` for raw files of a code host, else ``.html``."""
    suffix = F.lower(F.regexp_extract(_path(url), "[^/](\\.[^./]+)$", 1))
    return F.when(suffix.isin(".md", ".markdown", ".rst", ".txt"), suffix).when(_host(url) == "raw.githubusercontent.com", ".md").otherwise(".html")


def fetched(urls: DataFrame, fetch: Callable[[str], bytes | None], tries: int = 2, wait: float = 1.0, threads: int = 8, partitions: int | None = None) -> DataFrame:
    """``url, content, error`` of the addresses in ``url``: blank ones are skipped, and what is one address after :func:`raw_url` is fetched once.

    ``fetch`` runs in the workers, ``threads`` calls at a time in each task, so tasks overlap their waiting; addresses are dealt by
    hash, so a host with most of them is spread as well. A call that raises is tried again after ``wait`` seconds, twice as long
    each time; ``error`` says what the last try raised, or ``empty``. The result is written, so that everything read from it is of one fetch.
    """
    if tries < 1 or threads < 1:
        raise ValueError("tries and threads must be at least 1")

    def one(url: str) -> tuple[str, bytes | None, str | None]:
        for nth in range(tries):
            try:
                content = fetch(url)
                return (url, bytes(content), None) if content else (url, None, "empty")
            except Exception as e:  # noqa: BLE001  one failing page must not stop the others
                error = f"{type(e).__name__}: {e}"
                if nth + 1 < tries:
                    time.sleep(wait * 2**nth)
        return url, None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for i in range(0, len(batch), threads):  # no more pages in memory than are fetched at once
                    yield pd.DataFrame(list(pool.map(one, batch["url"].iloc[i : i + threads])), columns=["url", "content", "error"])

    asked = urls.select(raw_url(T.strip(F.col("url"))).alias("url")).where("url <> ''").distinct()
    dealt = asked.repartition(partitions, "url") if partitions else asked
    return written(dealt.mapInPandas(run, "url string, content binary, error string"))


def artifacts(pages: DataFrame) -> DataFrame:
    """``pages`` (url, content, error) that were fetched and are not empty, as artifacts: ``source_id, file_name, mime_type, content_text,
    cursor_after`` in place of ``content`` and ``error``. Pages give their main text, other files all of it."""
    held = pages.where(F.col("error").isNull() & (F.length("content") > 0)).withColumn("url", raw_url(F.col("url")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    page = extension(F.col("url")) == ".html"
    return held.withColumns(
        {
            "source_id": F.col("url"),
            "file_name": canonical_name(F.col("url")),
            "mime_type": F.when(page, "text/html").when(extension(F.col("url")) == ".txt", "text/plain").otherwise("text/markdown"),
            "content_text": F.when(page, main_text(text)).otherwise(text),
            "cursor_after": F.lit(None).cast("string"),
        }
    ).drop("content", "error")


def failures(pages: DataFrame) -> DataFrame:
    """``source_id, cursor_after, reason`` of the pages that :func:`artifacts` leaves out."""
    lost = F.col("error").isNotNull() | (F.coalesce(F.length("content"), F.lit(0)) == 0)
    return pages.where(lost).select(F.col("url").alias("source_id"), F.lit(None).cast("string").alias("cursor_after"), F.coalesce("error", F.lit("empty")).alias("reason"))


def main_text(html: Column) -> Column:
    """Readable text: boilerplate elements and comments go, block elements part paragraphs, tags go, entities turn into characters."""
    for element in ("script", "style", "nav", "header", "footer", "noscript"):
        html = F.regexp_replace(html, f"(?is)<{element}\\b.*?</{element}>", " ")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, "(?i)</?(p|div|section|article|h[1-6]|li|ul|ol|table|tr|br|main|body|title|head|blockquote|pre)\\b[^>]*>", "\n")
    html = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(html, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r]+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n\n")
