"""Fill-in-the-middle against a plain version, and its way back."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_in_middle as fim
from lodestone.llm import queries

SF = "/root/testdata/sf0.001"
LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, rate=100, spm_rate=50, unit=LINE, seed=7):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = unit.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(2)
    odd = ["", None, "\n", "\n\n\n", "a", "a\n", "a\r\nb\rc d\x85e", "<P>", "x <M> y\n", "<", "<<\n<P\n>", "日本\n語😀\n\\$1 $2 \\\\\n", "line\n" * 5000, "x" * 200_000, "$3\\1\n" * 20]
    return odd + ["".join(rng.choice(["α", "b", "\n", "<", ">", "S", "$", "\\"]) for _ in range(rng.randrange(200))) for _ in range(60)]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 10), (0, 50)])
def test_forms_and_restoring(spark, rate, spm_rate):
    rows = [(i, t, 5, "clash") for i, t in enumerate(texts())] + [(None, "a\nb\nc\n", 5, "clash"), (3, "\n\n\n", 5, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string").repartition(3)
    made = fim.transform(docs, rate=rate, spm_rate=spm_rate).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    found = made.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], rate, spm_rate), r["doc_id"]
        assert r["back"] == (r["text"] or "")
    assert rate < 100 or {"plain", "psm", "spm"} == {r["form"] for r in found}


def test_very_many_units(spark):
    """A possessive count walks without recursion: 300,000 lines on a common stack."""
    docs = spark.createDataFrame([(i, "ab\n" * 300_000 + "end") for i in range(4)], "doc_id long, text string")
    for r in fim.transform(docs).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"]) and r["back"] == r["text"]


def test_other_units_and_markers(spark):
    docs = spark.createDataFrame([(i, "one two  three four") for i in range(20)], "doc_id long, text string")
    made = fim.transform(docs, unit="\\s*\\S+", markers=("$a", "\\b", "^c")).withColumn("back", fim.restore(F.col("output"), F.col("form"), ("$a", "\\b", "^c")))
    for r in made.collect():
        n, form, prefix, middle, output = plain(r["doc_id"], r["text"], unit=re.compile(r"\s*\S+"))
        assert r["n"] == 4 and (r["prefix_chars"], r["middle_chars"]) == (prefix, middle) and r["back"] == r["text"]
        assert r["output"] == output.replace("<P>", "$a").replace("<S>", "\\b").replace("<M>", "^c")
    with pytest.raises(ValueError):
        fim.transform(docs, markers=("aa", "b", "c"))


def test_native_plan_and_empty_table(spark):
    out = queries.op11_fill_in_middle(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(queries.ORACLE_SQL["op11_fill_in_middle"])
    out = queries.op11_fill_in_middle(spark, SF)
    assert theirs.columns == out.columns
    assert sorted(map(tuple, out.collect())) == sorted(theirs.fetchall())
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in out.collect():
        n, form, prefix, middle, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
