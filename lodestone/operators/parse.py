"""File types, routes and parsers: content to blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Extension to (MIME type, type).
EXTENSIONS = {
    ".pdf": ("application/pdf", "pdf"),
    ".html": ("text/html", "html"),
    ".htm": ("text/html", "html"),
    ".txt": ("text/plain", "txt"),
    ".md": ("text/markdown", "markdown"),
    ".markdown": ("text/markdown", "markdown"),
    ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    ".pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "unsupported"),
    ".xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"),
    ".png": ("image/png", "unsupported"),
    ".jpg": ("image/jpeg", "unsupported"),
    ".jpeg": ("image/jpeg", "unsupported"),
    ".gif": ("image/gif", "unsupported"),
}
#: Type to parsers in the order they are tried.
ROUTES = {
    "pdf": ["pymupdf", "pdf_ocr"],
    "html": ["trafilatura"],
    "txt": ["md_parser"],
    "markdown": ["md_parser"],
    "docx": ["docx_parser"],
    "xlsx": ["xlsx_parser"],
}
#: Leading bytes in hex and their type.
MAGIC = [("25504446", "application/pdf", "pdf"), ("89504E470D0A1A0A", "image/png", "unsupported"), ("FFD8FF", "image/jpeg", "unsupported"), ("474946383761", "image/gif", "unsupported"), ("474946383961", "image/gif", "unsupported")]


def _found(mime, kind, confidence: float, strategy: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(mime).alias("mime_type"), lit(kind).alias("detected_type"), F.lit(confidence).alias("confidence"), F.lit(strategy).alias("strategy"))


def sniff(content: Column, name: Column) -> Column:
    """``struct<mime_type, detected_type, confidence, strategy>``: magic bytes first (a zip by its extension), then the extension."""
    extension = F.lower(F.regexp_extract(name, "(\\.[^./]+)$", 1))
    head = F.ltrim(F.lower(F.make_valid_utf8(F.substring(content, 1, 512).cast("string"))), F.lit(" \t\r\n\x0b\x0c"))
    found = None
    for hex_, mime, kind in MAGIC:
        hit = F.startswith(content, F.unhex(F.lit(hex_)))
        found = F.when(hit, _found(mime, kind, 1.0, "magic")) if found is None else found.when(hit, _found(mime, kind, 1.0, "magic"))
    zip_ = F.startswith(content, F.unhex(F.lit("504B0304")))
    for ext in (".docx", ".xlsx", ".pptx"):
        found = found.when(zip_ & (extension == ext), _found(*EXTENSIONS[ext], 0.95, "composite"))
    found = found.when(zip_, _found("application/zip", "unsupported", 0.8, "composite"))
    found = found.when(head.startswith("<!doctype html") | head.startswith("<html"), _found("text/html", "html", 0.95, "magic"))
    pairs = [x for ext, (mime, kind) in EXTENSIONS.items() for x in (F.lit(ext), _found(mime, kind, 0.7, "extension"))]
    named = F.try_element_at(F.create_map(*pairs), extension)  # one constant, however often the struct's fields are taken
    return found.otherwise(F.coalesce(named, _found("application/octet-stream", "unknown", 0.0, "none")))


def route(sniffed: DataFrame) -> DataFrame:
    """``sniffed`` with parser ``candidates`` and ``unsupported``."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in ROUTES.items() for x in pair])
    routed = sniffed.withColumn("candidates", F.coalesce(F.try_element_at(table, F.col("detected_type")), F.array().cast("array<string>")))
    return routed.withColumn("unsupported", F.size("candidates") == 0)


#: Line ends, each one of them.
LINE_END = "\\r\\n|[\\n\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"


def _between(marks: Column, first: Column, end: Column, make) -> Column:
    """``make(k, from, to)`` for the stretches from ``first`` to ``end`` that the places in ``marks`` part, the marks left out."""
    edge = lambda k: F.when(k == 0, first).otherwise(F.get(marks, k - 1) + 1)
    stop = lambda k: F.when(k == F.size(marks), end).otherwise(F.get(marks, k))
    return F.transform(F.sequence(F.lit(0), F.size(marks)), lambda k: make(k, edge(k), stop(k)))


def _places(first: Column, end: Column, keep) -> Column:
    """Places from ``first`` to before ``end`` for which ``keep`` holds."""
    return F.when(end > first, F.filter(F.sequence(first, end - 1), keep)).otherwise(F.array().cast("array<int>"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, block_type, text, section_path``: headings, fenced code and paragraphs of each ``text``.

    Every document is taken apart inside its row, by array functions: fences part its lines into text and code in turn, headings
    and blank lines part the text, and headings part the blocks, each stretch with the path that its heading leaves. All line ends
    count; blocks are stripped, empty ones left out; a fence that is never closed goes to the end.
    """
    block = "array<struct<kind:string,text:string,level:int>>"
    lines = docs.select("doc_id", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), LINE_END, "\n"), "\n").alias("lines"))
    marked = lines.withColumns(
        {
            "n": F.size("lines"),
            "fences": _places(F.lit(0), F.size("lines"), lambda i: F.get("lines", i).startswith("```")),
            "marks": F.transform("lines", lambda x: F.when(x.rlike(f"^{T.SPACE}*#"), "heading").when(x.rlike(f"^{T.SPACE}*$"), "blank")),
        }
    )
    body = lambda a, b: T.strip(F.array_join(F.slice("lines", a + 1, b - a), "\n"))
    made = lambda kind, text, level: F.struct(F.lit(kind).alias("kind"), text.alias("text"), level.cast("int").alias("level"))
    none = F.lit(0)

    def heading(i: Column) -> Column:
        line = T.strip(F.get("lines", i))
        return made("heading", T.strip(F.regexp_replace(line, "^#+", "")), F.char_length(F.regexp_extract(line, "^#+", 0)))

    def stretch(seps: Column, a: Column, b: Column) -> Column:
        def part(k: Column, x: Column, y: Column) -> Column:
            text = F.array(made("paragraph", body(x, y), none))
            return F.when((k > 0) & (F.get("marks", x - 1) == "heading"), F.concat(F.array(heading(x - 1)), text)).otherwise(text)

        return F.flatten(_between(seps, a, b, part))

    def segment(k: Column, a: Column, b: Column) -> Column:
        seps = _places(a, b, lambda i: F.get("marks", i).isNotNull())
        plain = F.transform(F.array(seps), lambda s: stretch(s, a, b))[0]
        return F.when(k % 2 == 1, F.array(made("code", body(a, b), none))).otherwise(plain)

    parts = F.flatten(_between(F.col("fences"), F.lit(0), F.col("n"), segment)).cast(block)
    blocks = marked.select("doc_id", F.filter(parts, lambda x: x["text"] != "").alias("blocks"))
    headed = blocks.withColumn("heads", _places(F.lit(0), F.size("blocks"), lambda i: F.get("blocks", i)["kind"] == "heading"))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<array<string>>").alias("out"))

    def enter(s: Column, i: Column) -> Column:
        kept = F.slice(s["path"], 1, F.least(F.get("blocks", i)["level"] - 1, F.size(s["path"])))
        path = F.concat(kept, F.array(F.get("blocks", i)["text"]))
        return F.struct(path.alias("path"), F.concat(s["out"], F.array(path)).alias("out"))

    pathed = headed.withColumn("paths", F.aggregate("heads", start, enter, lambda s: s["out"]))
    root = F.array().cast("array<string>")

    def section(k: Column, a: Column, b: Column) -> Column:
        first = F.when(k > 0, a - 1).otherwise(a)  # the heading itself
        path = F.when(k > 0, F.get("paths", k - 1)).otherwise(root)
        above = F.when(k > 0, F.slice(path, 1, F.size(path) - 1)).otherwise(root)
        return F.transform(
            F.slice("blocks", first + 1, b - first),
            lambda x, j: F.struct((first + j).alias("pos"), x["kind"].alias("block_type"), x["text"].alias("text"), F.when(x["kind"] == "heading", above).otherwise(path).alias("section_path")),
        )

    out = F.flatten(_between(F.col("heads"), F.lit(0), F.size("blocks"), section))
    return pathed.select("doc_id", F.explode(out).alias("b")).select("doc_id", "b.*")


def pdf_headings(spans: DataFrame, factor: float = 1.2, min_chars: int = 3) -> DataFrame:
    """Line blocks from a table of text spans ``doc_id, page, line, size, text``.

    A line's size is that of most of its characters; it is a heading if that is
    at least ``factor`` times the document's median size (weighted by
    characters) or if it is in capitals throughout.
    """
    held = spans.withColumn("n", F.char_length("text"))
    sizes = held.groupBy("doc_id", "page", "line", "size").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.struct("span", "text")))["text"], "").alias("t"))
    median = held.where("n > 0").groupBy("doc_id").agg(F.percentile("size", 0.5, F.col("n")).alias("median"))
    lines = sizes.groupBy("doc_id", "page", "line").agg(F.max_by("size", F.struct("n", "size")).alias("size"))
    texts = held.groupBy("doc_id", "page", "line").agg(F.array_join(F.array_sort(F.collect_list(F.struct("span", "text")))["text"], "").alias("text"))
    joined = lines.join(texts, ["doc_id", "page", "line"]).join(median, "doc_id").where(F.char_length(F.trim("text")) >= min_chars)
    heading = (F.col("size") >= factor * F.col("median")) | F.col("text").rlike("^[A-Z][A-Z\\s&/\\-]{3,59}$")
    return joined.select("doc_id", "page", "line", "text", F.when(heading, "heading").otherwise("paragraph").alias("block_type"))


def layout_blocks(spans: DataFrame, factor: float = 1.2, min_chars: int = 3) -> DataFrame:
    """``doc_id, page, block, first_line, n_lines, block_type, text`` from a table of text spans ``doc_id, page, block, line, span, size, text``.

    A line's size is that of most of its visible characters, the first one of equals. A line is a heading by size (``factor`` times
    the document's median, weighted by visible characters) or if it is in capitals throughout. Within a layout block the lines
    between headings make up a paragraph; blank lines count for nothing. Numbers of islands come from a running count of headings.
    """
    held = spans.withColumn("n", F.char_length(T.strip(F.col("text"))))
    visible = held.where("n > 0 AND size > 0")
    median = visible.groupBy("doc_id").agg(F.percentile("size", 0.5, F.col("n")).alias("median"))
    key = ["doc_id", "page", "block", "line"]
    by_size = visible.groupBy(*key, "size").agg(F.sum("n").alias("n"), F.min("span").alias("at"))
    sizes = by_size.groupBy(*key).agg(F.max_by("size", F.struct("n", -F.col("at"))).alias("size"))
    texts = held.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("span", "text")))["text"], "").alias("text"))
    lines = texts.where(T.strip(F.col("text")) != "").join(sizes, key, "left").join(median, "doc_id", "left")
    heading = F.coalesce(F.col("size") >= factor * F.coalesce("median", F.lit(12.0)), F.lit(False)) | T.strip(F.col("text")).rlike("^[A-Z][A-Z\\s&/\\-]{3,59}$")
    inside = W.partitionBy("doc_id", "page", "block").orderBy("line")
    marked = lines.withColumn("heading", heading).withColumn("island", F.sum(F.col("heading").cast("int")).over(inside))
    body = T.strip(F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], "\n"))
    made = marked.groupBy("doc_id", "page", "block", "island", "heading").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"), body.alias("text"))
    kind = F.when(F.col("heading"), "heading").otherwise("paragraph")
    return made.where(F.char_length("text") >= min_chars).select("doc_id", "page", "block", "first_line", "n_lines", kind.alias("block_type"), "text")


def _office_blocks(content: bytes, kind: str) -> Iterator[tuple[str, str]]:
    """Blocks of a DOCX or XLSX file, read with the standard library."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if kind == "docx":
            body = ET.fromstring(z.read("word/document.xml"))
            in_tables = {p for t in body.iter() if local(t) == "tbl" for p in t.iter() if local(p) == "p"}
            words = lambda e: "".join(x.text or "" for x in e.iter() if local(x) == "t").strip()
            for p in (p for p in body.iter() if local(p) == "p" and p not in in_tables):
                style = next((v for s in p.iter() if local(s) == "pStyle" for v in s.attrib.values()), "")
                if len(words(p)) >= 3:
                    yield "heading" if "heading" in style.lower() else "paragraph", words(p)
            for row in (r for r in body.iter() if local(r) == "tr"):
                line = " | ".join(words(c) for c in row if local(c) == "tc")
                if len(line) >= 3:
                    yield "table", line
        else:
            shared = ET.fromstring(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in z.namelist() else []
            strings = ["".join(x.text or "" for x in si.iter() if local(x) == "t") for si in shared]
            links = ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if "xl/_rels/workbook.xml.rels" in z.namelist() else []
            targets = {r.attrib["Id"]: r.attrib["Target"].removeprefix("/xl/") for r in links}
            sheets = [s.attrib for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(s) == "sheet"]
            for n, sheet in enumerate(sheets, 1):
                named = next((v for k, v in sheet.items() if k.endswith("}id")), None)  # the relationship says which file it is
                yield "heading", f"Sheet: {sheet['name']}"
                for row in (r for r in ET.fromstring(z.read(f"xl/{targets.get(named, f'worksheets/sheet{n}.xml')}")).iter() if local(r) == "row"):
                    cells = []
                    for c in (c for c in row if local(c) == "c"):
                        value = "".join(x.text or "" for x in c.iter() if local(x) in ("v", "t"))
                        cells.append(strings[int(value)] if c.attrib.get("t") == "s" and value else value)
                    if any(x.strip() for x in cells):
                        yield "table", " | ".join(cells)


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes], Iterator[tuple[str, str]]]] | None = None, min_ocr_chars: int = 100) -> DataFrame:
    """``path, pos, block_type, text, parser, fallback`` of routed files (path, content, detected_type, candidates).

    Candidates are tried in order: one that is missing or raises is passed over,
    and a result under ``min_ocr_chars`` goes on to OCR if that is a candidate
    with a parser. With none left a file gives one ``[unsupported_format: T]`` block.
    Markdown is taken apart in the JVM, by :func:`markdown_blocks`.
    """
    own = {
        "docx_parser": lambda raw: _office_blocks(raw, "docx"),
        "xlsx_parser": lambda raw: _office_blocks(raw, "xlsx"),
    } | (parsers or {})

    def blocks_of(content: bytes, kind: str, candidates: list[str]) -> tuple[list[tuple[str, str]], str, bool]:
        tried = 0
        for name in candidates:
            if name not in own:
                continue
            try:
                found = list(own[name](content))
            except Exception:  # noqa: BLE001  a broken file goes to the next parser
                tried += 1
                continue
            short = len(" ".join(t for _, t in found)) < min_ocr_chars
            if short and name != "pdf_ocr" and "pdf_ocr" in candidates and "pdf_ocr" in own:
                tried += 1
                continue
            return found, name, tried > 0
        return [("unknown", f"[unsupported_format: {kind}]")], "none", True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, kind, candidates in batch.itertuples(index=False):
                found, parser, fallback = blocks_of(bytes(content), kind, list(candidates))
                rows += [(path, n, k, t, parser, fallback) for n, (k, t) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "pos", "block_type", "text", "parser", "fallback"])

    held = files.select("path", "content", "detected_type", "candidates")
    is_markdown = F.coalesce(F.get("candidates", F.lit(0)) == "md_parser", F.lit(False)) & F.lit("md_parser" not in own)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    native = markdown_blocks(held.where(is_markdown).select(F.col("path").alias("doc_id"), text.alias("text")))
    native = native.select(F.col("doc_id").alias("path"), "pos", "block_type", "text", F.lit("md_parser").alias("parser"), F.lit(False).alias("fallback"))
    others = held.where(~is_markdown).mapInPandas(run, "path string, pos int, block_type string, text string, parser string, fallback boolean")
    return native.unionByName(others)
