"""Fill-in-the-middle: texts cut into prefix, middle and suffix at drawn units, by one counted match a row.

``regexp_count`` gives the number n of units (lines, by default). Two draws from
0 to n say where the middle begins and ends, and a pattern made for the row,
``((?:unit){a}+)((?:unit){b-a}+)(.*)``, captures the three parts in a single match;
its replacement puts them in order behind their markers. The counted groups are
possessive, so the match walks over the text once and never back. DataFrame
functions only.

The draws h1 to h4 are the first four groups of eight hex digits of the SHA-256
of ``seed:id``, so a row's form depends on its id alone.

Defined results: a null or empty text gives the form ``plain`` and an empty
output; so does, with the text as output, a text that holds one of the markers.
A null id draws as an empty one. Repeated rows get equal outputs. Columns of the
input with the name of a result are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "[^\\n]*\\n|[^\\n]+"
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
RESULTS = ["n", "form", "output", "prefix_chars", "middle_chars"]


def draws(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers drawn for an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def _written(marker: str) -> str:
    """The marker as the replacement of a pattern spells it."""
    return re.sub(r"([\\$])", r"\\\1", marker)


def transform(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    unit: str = LINE,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``docs`` with ``n, form, output, prefix_chars, middle_chars``.

    ``rate`` per cent of the texts are transformed, ``spm_rate`` per cent of these
    with the suffix first. ``unit`` is a pattern whose matches, from left to right,
    make up the whole text. Lengths are code points, null where the form is plain.
    """
    p, s, m = markers
    h1, h2, h3, h4 = draws(F.col("__id"), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    if any(x[:1] in x[1:] or x == "" for x in markers):
        raise ValueError("a marker's first character must occur in it once")
    source = docs.withColumns({"__text": whole, "__id": F.col(doc_id)}).drop(*RESULTS)
    plain = (F.col("__text") == "") | (h3 % 100 >= rate)
    for marker in markers:
        plain = plain | F.contains("__text", F.lit(marker))
    counted = source.withColumns({"n": F.regexp_count("__text", F.lit(unit)).cast("long"), "form": F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")})
    i, j = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    placed = counted.withColumns({"__from": F.least(i, j), "__to": F.greatest(i, j)})
    group = lambda count: F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit("(?s)\\A"), group(F.col("__from")), group(F.col("__to") - F.col("__from")), F.lit("(.*)\\z"))
    parts = {"psm": f"{_written(p)}$1{_written(s)}$3{_written(m)}$2", "spm": f"{_written(s)}$3{_written(p)}$1{_written(m)}$2"}
    order = F.when(F.col("form") == "psm", parts["psm"]).otherwise(parts["spm"])
    cut = placed.withColumn("output", F.when(F.col("form") == "plain", F.col("__text")).otherwise(F.regexp_replace("__text", pattern, order)))
    # No part holds a marker, and none can arise where parts meet, as a marker's first character is nowhere else in it.
    at = lambda marker: F.locate(marker, F.col("output"))
    prefix_end = F.when(F.col("form") == "psm", at(s)).otherwise(at(m))
    length = {
        "prefix_chars": F.when(F.col("form") != "plain", prefix_end - at(p) - len(p)).cast("long"),
        "middle_chars": F.when(F.col("form") != "plain", F.char_length("output") + 1 - at(m) - len(m)).cast("long"),
    }
    return cut.withColumns(length).drop("__text", "__id", "__from", "__to")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from which ``transform`` made ``output``."""
    p, s, m = (re.escape(x) for x in markers)
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{p}(.*?){s}(.*?){m}(.*)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{s}(.*?){p}(.*?){m}(.*)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests_sql(seed: int, rate: int, spm_rate: int) -> str:
    """DuckDB SQL for the lengths and digests of ``documents``."""
    number = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    part = lambda a, b: f"coalesce(array_to_string(units[{a}:{b}], ''), '')"
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), u AS (
      SELECT doc_id, t, h, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units FROM d
    ), k AS (
      SELECT *, len(units) AS n, least({number(0)} % (len(units) + 1), {number(1)} % (len(units) + 1)) AS a,
        greatest({number(0)} % (len(units) + 1), {number(1)} % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {number(2)} % 100 >= {rate} THEN 'plain'
          WHEN {number(3)} % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form
      FROM u
    ), p AS (
      SELECT *, {part("1", "a")} AS prefix, {part("a + 1", "b")} AS middle, {part("b + 1", "n")} AS suffix FROM k
    )
    SELECT doc_id, n::BIGINT AS n, form,
      CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM p
    """
