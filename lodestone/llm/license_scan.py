"""License scan: normalised text against templates by Dice over word bigrams, in DataFrame functions only.

A document's units are its lines, its paragraphs (parts between blank lines), its
whole text, and its passages. A unit is normalised (lower case, everything but
letters and digits to single blanks), and its distinct word bigrams are compared with
those of each template: Dice = 2 |A and B| / (|A| + |B|). Two sets of sizes a
and b can only reach a Dice of t if b lies between a t/(2-t) and a (2-t)/t;
templates outside of these bounds are never compared. Before that, one scan looks for
the templates' telling bigrams (not of two common words) in whole texts: a text with
fewer distinct ones of a template than the size bound asks for has no unit near it.

A passage is a stretch of the whole text that a template's telling bigrams mark: they
lie at most ``gap`` words apart from one to the next. So a header is found wherever it
begins and ends, over wrapped lines, comment signs and blank lines and right before
code. Stretches with too few of the template's bigrams are dropped before they are
measured.

Only places of telling bigrams are shuffled, by text and template. The texts found that
way are read again, by a key (hash of id and text); all else stays inside a row.

Defined results: null, empty and one-word units have no bigrams and match
nothing. The best template of a unit wins; ties go to the first name in order. Of
passages that overlap, the one that shares the most bigrams with its template stays, then
the one of the highest Dice, then the first name, then the first place. ``position`` counts units from 0, for passages words. Repeated rows are
scanned one by one. Other columns of the input stay out.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Public license notices and headers to compare with, by identifier and form.
NOTICES: dict[str, str] = {
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause/notice": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT/notice": "Released under the MIT License.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
}
#: The whole texts lie beside this module, one file each, as published.
TEMPLATES = NOTICES | {f"{path.stem}/text": path.read_text(encoding="utf-8") for path in sorted(Path(__file__).with_name("licenses").glob("*.txt"))}


#: Words too common to tell a license.
COMMON = set("a an and any are as at be by for from in is it not of on or that the this to under which with you".split())


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct word bigrams of each template, normalised as the units are."""
    out = {}
    for name, text in sorted(templates.items()):
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        out[name] = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
    return out


def telling(bigrams: list[str]) -> list[str]:
    """The bigrams that are not of two common words or letters; all of them if there is none."""
    plain = lambda w: w in COMMON or (len(w) < 2 and not w.isdigit())
    return [b for b in bigrams if not all(map(plain, b.split()))] or bigrams


def least_shared(bigrams: list[str], threshold: float) -> int:
    """How many distinct telling bigrams a text within ``threshold`` shares at least."""
    return max(1, math.ceil(len(bigrams) * threshold / (2 - threshold) - 1e-9) - (len(bigrams) - len(telling(bigrams))))


def _pairs(ws: Column) -> Column:
    return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1)))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column behind a generator, so that later filters do not compute it anew."""
    return df.withColumn(name, F.explode(F.array(value)))


def _hits(texts: DataFrame, sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """``key, k, at, bigram``: places of the telling bigrams of template ``k``, where a text has enough of them."""
    spark = texts.sparkSession
    pairs = "\n".join(f"{b}|{k}" for k, bigrams in enumerate(sets.values()) for b in telling(bigrams))
    pair = F.split("pair", "\\|")
    marks = spark.range(1).select(F.explode(F.split(F.lit(pairs), "\n")).alias("pair")).select(pair[0].alias("bigram"), pair[1].cast("int").alias("k"))
    needs = {k: least_shared(bigrams, threshold) for k, bigrams in enumerate(sets.values())}
    wanted = ", ".join(f"'{b}'" for b in sorted({b for bigrams in sets.values() for b in telling(bigrams)}))
    made = "transform(slice(words, 1, greatest(size(words) - 1, 0)), (w, i) -> struct(i AS at, concat_ws(' ', w, get(words, i + 1)) AS bigram))"
    found = _once(texts.select("key", F.split(_plain(F.col("text")), " ").alias("words")), "places", F.expr(f"filter({made}, x -> x.bigram IN ({wanted}))"))
    placed = found.where(F.size("places") >= min(needs.values())).select("key", F.explode("places").alias("p")).select("key", "p.at", "p.bigram")
    placed = placed.join(F.broadcast(marks), "bigram").distinct()  # as many rows as the templates have bigrams
    enough = placed.groupBy("key", "k").agg(F.collect_list(F.struct("at", "bigram")).alias("places"))  # a text's own places
    need = F.element_at(F.array(*[F.lit(n) for _, n in sorted(needs.items())]), F.col("k") + 1)
    return enough.where(F.size(F.array_distinct("places.bigram")) >= need).withColumn("need", need)


def _spans(hits: DataFrame, gap: int) -> DataFrame:
    """``key, k, first, last``: stretches of places at most ``gap`` words apart with enough distinct bigrams."""
    single = hits.select("key", "k", "need", F.explode("places").alias("p")).select("key", "k", "need", "p.at", "p.bigram")
    within = W.partitionBy("key", "k").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(within) > gap, F.lit(False)).cast("int")
    numbered = single.withColumn("apart", apart).withColumn("nth", F.sum("apart").over(within))
    return (
        numbered.groupBy("key", "k", "need", "nth")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count_distinct("bigram").alias("found"))
        .where("found >= need")
        .groupBy("key")
        .agg(F.collect_list(F.struct("first", "last", "k")).alias("spans"))  # some spans of one text
    )


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", gap: int = 6) -> DataFrame:
    """``doc_id, unit, position, license, dice, n_bigrams`` of every unit that reaches ``threshold``."""
    sets = template_bigrams(templates)
    names = list(sets)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    hits = cut(_hits(texts, sets, threshold))
    near = cut(hits.select("key").distinct().join(_spans(hits, gap), "key", "left"))
    held = texts.join(near, "key")
    literal = lambda k: F.split(F.lit("\n".join(sets[names[k]])), "\n")
    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  ``value`` is computed once
    name_of = lambda k: F.element_at(F.array(*[F.lit(n) for n in names]), k + 1)

    def dice(own: Column, k: int) -> Column:
        n, size = len(sets[names[k]]), F.size(own)
        shared = F.size(F.array_intersect(own, literal(k)))
        inside = (size >= n * low - 1e-9) & (size <= n * high + 1e-9)
        return F.struct(F.when(inside, F.lit(2.0) * shared / (size + F.lit(n))).otherwise(F.lit(0.0)).alias("dice"), F.lit(-k).alias("place"), size.alias("n_bigrams"), shared.alias("shared"))

    def units(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("position"), x.alias("part")))

    whole = F.coalesce("text", F.lit(""))
    every = F.concat(units("line", F.split(whole, "\n")), units("paragraph", F.split(whole, "\n[ \t]*\n")), units("text", F.array(whole)))
    words = lambda c: F.split(_plain(c), " ")
    of_units = held.select("doc_id", F.explode(every).alias("u"))
    best = let(let(words(F.col("u.part")), lambda ws: F.array_distinct(_pairs(ws))), lambda own: F.array_max(F.array(*[dice(own, k) for k in range(len(names))])))
    inside = _once(of_units, "best", best).where(F.col("best.dice") >= threshold)
    inside = inside.select("doc_id", "u.unit", "u.position", name_of(-F.col("best.place")).alias("license"), "best.dice", "best.n_bigrams")

    def chosen(own: Column, x: Column) -> Column:
        """The span measured with its own template."""
        value = dice(own, 0)
        for k in range(1, len(names)):
            value = F.when(x["k"] == k, dice(own, k)).otherwise(value)
        return F.struct(x["first"].alias("first"), x["last"].alias("last"), name_of(x["k"]).alias("license"), value.alias("d"))

    def measured(ws: Column) -> Column:
        return F.transform("spans", lambda x: let(F.array_distinct(_pairs(F.slice(ws, x["first"] + 1, x["last"] - x["first"] + 2))), lambda own: chosen(own, x)))

    def beaten(x: Column, spans: Column) -> Column:
        order = lambda z: F.struct(-z["d"]["shared"], -z["d"]["dice"], z["license"], z["first"])
        return F.exists(spans, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]) & (order(y) < order(x)))

    kept = lambda spans: F.filter(spans, lambda x: ~beaten(x, spans))
    passing = let(F.filter(let(words(F.col("text")), measured), lambda x: x["d"]["dice"] >= threshold), kept)
    passages = held.where("spans IS NOT NULL").select("doc_id", F.explode(passing).alias("s"))
    return inside.unionByName(passages.select("doc_id", F.lit("passage").alias("unit"), F.col("s.first").alias("position"), "s.license", "s.d.dice", "s.d.n_bigrams"))


def scan_sql(threshold: float = 0.8, templates: dict[str, str] = TEMPLATES, gap: int = 6) -> str:
    """The same scan of table ``documents`` as DuckDB SQL."""
    sets = template_bigrams(templates)
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{name}', {listed(b)}, {listed(telling(b))}, {least_shared(b, threshold)})" for name, b in sets.items())
    words = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
WITH templates(license, bigrams, telling, need) AS (VALUES {rows}),
parts AS (
  SELECT doc_id, 'line' AS unit, string_split(coalesce(text, ''), chr(10)) AS p FROM documents
  UNION ALL SELECT doc_id, 'paragraph', regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n') FROM documents
  UNION ALL SELECT doc_id, 'text', [coalesce(text, '')] FROM documents),
units AS (SELECT doc_id, unit, unnest(range(len(p))) AS position, unnest(p) AS part FROM parts),
words AS (SELECT doc_id, unit, position, {words.format('part')} AS w FROM units),
pairs AS (
  SELECT doc_id, unit, position, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM words WHERE len(w) > 1),
scored AS (
  SELECT doc_id, unit, position, license, len(b) AS n_bigrams,
         2.0::double * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice
  FROM pairs JOIN templates
    ON len(b) >= len(bigrams) * {threshold / (2 - threshold)} - 1e-9 AND len(b) <= len(bigrams) * {(2 - threshold) / threshold} + 1e-9),
whole AS (SELECT row_number() OVER () AS row, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT row, unnest(range(1, len(w))) AS spot, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM whole),
marks AS (SELECT license, unnest(telling) AS b FROM templates),
hits AS (
  SELECT row, license, spot, b, CASE WHEN spot - lag(spot) OVER (PARTITION BY row, license ORDER BY spot) > {gap} THEN 1 ELSE 0 END AS apart
  FROM places JOIN marks USING (b)),
stretches AS (SELECT *, sum(apart) OVER (PARTITION BY row, license ORDER BY spot) AS nth FROM hits),
spans AS (
  SELECT row, license, min(spot) AS lo, max(spot) AS hi FROM stretches JOIN templates USING (license)
  GROUP BY row, license, nth, need HAVING count(DISTINCT b) >= need),
measured AS (
  SELECT row, doc_id, license, lo, hi, bigrams, list_distinct(list_transform(range(lo, hi + 1), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM spans JOIN whole USING (row) JOIN templates USING (license)),
near AS (
  SELECT row, doc_id, license, lo, hi, len(b) AS n_bigrams, len(list_intersect(b, bigrams)) AS shared,
         2.0::double * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice FROM measured),
passages AS (
  SELECT * FROM near x WHERE dice >= {threshold} AND NOT EXISTS (
    SELECT 1 FROM near y WHERE y.row = x.row AND y.lo <= x.hi AND x.lo <= y.hi AND y.dice >= {threshold}
      AND (-y.shared, -y.dice, y.license, y.lo) < (-x.shared, -x.dice, x.license, x.lo)))
(SELECT doc_id, unit, position::integer AS position, license, dice, n_bigrams::integer AS n_bigrams
 FROM scored WHERE dice >= {threshold}
 QUALIFY row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY dice DESC, license) = 1)
UNION ALL
SELECT doc_id, 'passage', (lo - 1)::integer, license, dice, n_bigrams::integer FROM passages
"""
