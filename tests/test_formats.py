"""File formats, suites, streams and document parts that the registered queries do not reach."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from lodestone.operators import parse
from lodestone.sources import connectors, files
from lodestone.streaming import incremental

W = 'xmlns:w="http://w"'


def docx():
    p = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('left')}</w:tc><w:tc>{p('right')}</w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{p('Title', 'Heading1')}{p('A paragraph.')}{p('x')}{table}</w:body></w:document>"})


def xlsx():
    sheet = lambda *cells: "<worksheet><sheetData><row>" + "".join(cells) + "</row></sheetData></worksheet>"
    return zipped(
        {
            "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="First" r:id="rId9"/><sheet name="Second" r:id="rId2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId2" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
            "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>",
            "xl/worksheets/sheet1.xml": sheet("<c><v>1</v></c>"),
            "xl/worksheets/sheet2.xml": sheet('<c t="s"><v>0</v></c>', "<c><v>42</v></c>"),
        }
    )


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files_markdown_and_ocr(spark):
    rows = [
        ("a.docx", docx(), "docx", ["docx_parser"]),
        ("b.xlsx", xlsx(), "xlsx", ["xlsx_parser"]),
        ("c.md", "# H\r\ntext \xff".encode("latin-1"), "markdown", ["md_parser"]),
        ("d.pdf", b"%PDF scanned", "pdf", ["pdf_text", "pdf_ocr"]),
        ("e.pdf", b"%PDF with text", "pdf", ["pdf_text", "pdf_ocr"]),
        ("f.docx", b"broken", "docx", ["docx_parser"]),
        ("g.bin", b"", "bin", []),
        ("h.md", b"", "markdown", ["md_parser"]),
    ]
    df = spark.createDataFrame(rows, "path string, content binary, detected_type string, candidates array<string>")
    own = {"pdf_text": lambda raw: [("paragraph", "t" * 200 if b"with text" in raw else "short")], "pdf_ocr": lambda raw: [("paragraph", "read by eye")]}
    found = {}
    for r in parse.parse_files(df, own).orderBy("path", "pos").collect():
        found.setdefault(r["path"], []).append((r["block_type"], r["text"], r["parser"], r["fallback"]))
    assert found["a.docx"] == [("heading", "Title", "docx_parser", False), ("paragraph", "A paragraph.", "docx_parser", False), ("table", "left | right", "docx_parser", False)]
    assert [x[:2] for x in found["b.xlsx"]] == [("heading", "Sheet: First"), ("table", "shared | 42"), ("heading", "Sheet: Second"), ("table", "1")]
    assert found["c.md"] == [("heading", "H", "md_parser", False), ("paragraph", "text \ufffd", "md_parser", False)]
    assert found["d.pdf"] == [("paragraph", "read by eye", "pdf_ocr", True)] and found["e.pdf"][0][2:] == ("pdf_text", False)
    assert found["f.docx"] == [("unknown", "[unsupported_format: docx]", "none", True)] and found["g.bin"][0][1] == "[unsupported_format: bin]"
    assert "h.md" not in found


def test_layout_blocks(spark):
    rows = [
        ("d", 1, 0, 0, 0, 10.0, "first "), ("d", 1, 0, 0, 1, 20.0, "x"), ("d", 1, 0, 1, 0, 10.0, " second line"), ("d", 1, 0, 2, 0, 14.0, " Large "), ("d", 1, 0, 3, 0, 10.0, "  "), ("d", 1, 0, 4, 0, 10.0, "third"),
        ("d", 1, 1, 0, 0, 10.0, "CAPITAL TITLE"), ("d", 1, 1, 1, 0, 10.0, "ab"), ("d", 2, 0, 0, 0, 10.0, "other page"), ("e", 1, 0, 0, 0, None, "no size"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, page int, block int, line int, span int, size double, text string")
    got = [tuple(r) for r in parse.layout_blocks(df).orderBy("doc_id", "page", "block", "first_line").collect()]
    assert got == [
        ("d", 1, 0, 0, 2, "paragraph", "first x\n second line"), ("d", 1, 0, 2, 1, "heading", "Large"), ("d", 1, 0, 4, 1, "paragraph", "third"),
        ("d", 1, 1, 0, 1, "heading", "CAPITAL TITLE"), ("d", 2, 0, 0, 1, "paragraph", "other page"), ("e", 1, 0, 0, 1, "paragraph", "no size"),
    ]


def test_document_parts(spark):
    parts = [("TITLE", ["The ", "title\n"], None), ("HEADING_2", ["Two"], None), ("NORMAL_TEXT", ["plain"], None), (None, [" "], None), (None, None, [["a", "b"], ["c", "d"]])]
    df = spark.createDataFrame([(parts,)], "p array<struct<style:string,runs:array<string>,rows:array<array<string>>>>")
    assert df.select(connectors.document_text(F.col("p")).alias("t")).first()["t"] == "# The title\n## Two\nplain\n| a | b |\n| c | d |"


def test_suites_and_beir(spark, tmp_path):
    case = {"query_id": "q1", "query": "what?", "expected_behavior": "answer", "expected_sources": ["a.txt"]}
    (tmp_path / "suite.json").write_text(json.dumps([case, case | {"query_id": "q2"}], indent=1))
    (tmp_path / "suite.jsonl").write_text(json.dumps(case) + "\n" + json.dumps(case | {"query_id": "q2"}))
    for name in ("suite.json", "suite.jsonl"):
        assert [r["query_id"] for r in files.suite(spark, f"file://{tmp_path}/{name}").orderBy("query_id").collect()] == ["q1", "q2"]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(x) for x in [{"_id": "d1", "title": "T", "text": "two words"}, {"_id": "d2", "title": "", "text": "one"}]))
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q", "text": "asked"}))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\td1\t2\nq\td2\t0\n")
    held = files.beir(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in held["chunks"].orderBy("chunk_id").collect()] == [("d1", "T two words", 3), ("d2", "one", 1)]
    assert [tuple(r) for r in held["queries"].collect()] == [("q", "asked")] and [tuple(r) for r in held["qrels"].collect()] == [("q", "d1")]


def test_streams_of_events(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:10", "x"), ("a", "2024-01-01 00:00:20", "x"), ("b", "2024-01-01 00:04:00", "y"), ("c", "2024-01-01 00:06:00", "x")]
    schema = "id string, at timestamp, kind string"
    spark.createDataFrame(rows, "id string, at string, kind string").selectExpr("id", "cast(at AS timestamp) AS at", "kind").write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")

    def run(name, df, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(60)
        return spark.table(name)

    assert sorted(r["id"] for r in run("once", incremental.late_once(source(), "id", "at"), "append").collect()) == ["a", "b", "c"]
    counted = run("active", incremental.activity(source(), "at", "kind"), "complete").collect()
    assert sorted((r["window"]["start"].minute, r["kind"], r["n_events"]) for r in counted) == [(0, "x", 2), (0, "y", 1), (5, "x", 1)]
