"""DuckDB SQL for the registered queries, over views named like the tables."""

from __future__ import annotations

from lodestone.functions.text import CJK, SPACE
from lodestone.operators.chunks import ANCHOR_RULES, PRONOUNS
from lodestone.operators.clean import NAV_PHRASES, NAV_SEPARATORS, PLAIN_FORMS
from lodestone.operators.context import ABSTAIN, CONTEXT_HEADER, INDEX_HEADER, NO_CONTEXT, QUESTION_HEADER
from lodestone.operators.parse import EXTENSIONS, ROUTES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def canonical(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]){SPACE}+', '\\1' || chr(31), 'g')"
    marked = f"regexp_replace({marked}, '([\\x{{3002}}\\x{{FF01}}\\x{{FF1F}}])', '\\1' || chr(31), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(31)), lambda q: {strip('q')}), lambda q: q <> '')"


LINES = "lines AS (SELECT doc_id, unnest(range(len(p)))::int AS pos, unnest(p) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))"


def split(limit: int) -> str:
    return f"""{LINES},
held AS (SELECT doc_id, pos, {strip('text')} AS text FROM lines),
sents AS (SELECT doc_id, pos, unnest(range(len(s))) AS nth, unnest(s) AS s FROM (
  SELECT doc_id, pos, {sentences('text')} AS s FROM held WHERE {tokens('text')} > {limit})),
walk AS (
  SELECT doc_id, pos, nth, s, 0 AS part, {tokens('s')} AS used FROM sents WHERE nth = 0
  UNION ALL
  SELECT x.doc_id, x.pos, x.nth, x.s, CASE WHEN w.used + {tokens('x.s')} > {limit} THEN w.part + 1 ELSE w.part END,
         CASE WHEN w.used + {tokens('x.s')} > {limit} THEN {tokens('x.s')} ELSE w.used + {tokens('x.s')} END
  FROM walk w JOIN sents x ON x.doc_id = w.doc_id AND x.pos = w.pos AND x.nth = w.nth + 1),
parts AS (
  SELECT doc_id, pos, 0 AS part, text FROM held WHERE text <> '' AND {tokens('text')} <= {limit}
  UNION ALL SELECT doc_id, pos, part, string_agg(s, ' ' ORDER BY nth) FROM walk GROUP BY ALL),
blocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1)::int AS sequence, pos, text,
  sha256({canonical('text')}) AS block_hash, {tokens('text')}::int AS n_tokens FROM parts)"""


def _case(arms: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {rest} END"


RULES = [(f"regexp_matches(text, {lit(p)})", lit(kind), str(level), lit(name)) for name, kind, p, level in ANCHOR_RULES]
ANNOTATED = f"""{split(512)},
marked AS (SELECT doc_id, sequence, CASE WHEN sequence % 7 = 0 THEN '# ' WHEN sequence % 7 = 3 THEN '2.1 ' WHEN sequence % 11 = 5 THEN '- ' ELSE '' END || text AS text FROM blocks),
annotated AS (SELECT doc_id, sequence, text, sha256({canonical('text')}) AS block_hash, {tokens('text')}::int AS n_tokens,
  {_case([(c, k) for c, k, _, _ in RULES], "'none'")} AS anchor_type,
  {_case([(c, n) for c, _, n, _ in RULES], '0')} AS anchor_level,
  {_case([(c, r) for c, _, _, r in RULES], 'NULL')} AS rule_name FROM marked)"""
ASSIGNED = f"""{ANNOTATED},
pack AS (
  SELECT doc_id, sequence, 0 AS chunk_no, n_tokens AS used, anchor_type = 'none' AS content FROM annotated WHERE sequence = 0
  UNION ALL
  SELECT a.doc_id, a.sequence, p.chunk_no + f::int, CASE WHEN f THEN 0 ELSE p.used END + a.n_tokens,
         (NOT f AND p.content) OR a.anchor_type = 'none'
  FROM pack p JOIN annotated a ON a.doc_id = p.doc_id AND a.sequence = p.sequence + 1,
       LATERAL (SELECT (a.anchor_type <> 'none' AND p.content) OR p.used + a.n_tokens > 256 AS f))"""
CHUNKS = f"""{ASSIGNED},
placed AS (SELECT a.*, p.chunk_no,
  last_value(CASE WHEN anchor_type <> 'none' THEN text END IGNORE NULLS) OVER (PARTITION BY a.doc_id, p.chunk_no ORDER BY a.sequence) AS heading
  FROM annotated a JOIN pack p USING (doc_id, sequence)),
built AS (SELECT doc_id, chunk_no, sha256(string_agg(block_hash, '|' ORDER BY sequence)) AS chunk_id,
  string_agg(CASE WHEN anchor_type = 'none' AND heading IS NOT NULL THEN heading || ': ' || text ELSE text END, chr(10) || chr(10) ORDER BY sequence) AS stable_text,
  string_agg(CASE WHEN anchor_type <> 'none' THEN '[' || upper(anchor_type) || '] ' || text ELSE text END, chr(10) || chr(10) ORDER BY sequence) AS display_text,
  min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM placed GROUP BY doc_id, chunk_no),
chunks AS (SELECT *, {tokens('stable_text')}::int AS token_count FROM built)"""


def pronouns(x: str) -> str:
    cleaned = f"regexp_replace(lower({x}), '[\\p{{L}}\\p{{N}}_]*[^\\x{{00}}-\\x{{7F}}a-z][\\p{{L}}\\p{{N}}_]*', ' ', 'g')"
    return f"list_filter(regexp_extract_all({cleaned}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"


_PRONOUNS = "[" + ", ".join(map(lit, PRONOUNS)) + "]"
RISK = f"CASE WHEN len(w) < 5 THEN 0.0::double ELSE len(list_filter(w, lambda y: list_contains({_PRONOUNS}, y)))::double / len(w) END"

VERSIONS = f"""{split(512)},
old AS (SELECT doc_id, sequence AS pos, text, block_hash FROM blocks),
kept AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 7 = 0 THEN text || ' x' ELSE text END AS text FROM old WHERE (doc_id + pos) % 10 <> 0),
new AS (SELECT doc_id, pos, text, sha256({canonical('text')}) AS block_hash FROM kept)"""
DIFF = f"""{VERSIONS},
diff AS (
  SELECT n.doc_id, n.block_hash, CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.doc_id = n.doc_id AND o.block_hash = n.block_hash) THEN 'unchanged' ELSE 'added' END AS status FROM new n
  UNION ALL SELECT o.doc_id, o.block_hash, 'removed' FROM old o ANTI JOIN new n ON o.doc_id = n.doc_id AND o.block_hash = n.block_hash)"""
RESYNC = f"""{VERSIONS},
known AS (SELECT n.doc_id, n.pos, n.block_hash AS chunk_signature,
  EXISTS (SELECT 1 FROM old o WHERE o.doc_id = n.doc_id AND o.block_hash = n.block_hash) AS known FROM new n),
again AS (SELECT *, max(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS again FROM known)"""

METRICS = f"""{LINES},
held AS (SELECT doc_id, {strip('text')} AS text FROM lines),
measured AS (SELECT doc_id, count(*) AS n_blocks, sum(length(text)) + count(*) - 1 AS char_count,
  round(sum(len(regexp_extract_all(translate(text, chr(10) || chr(13) || chr(9) || ' ', ''), '[\\p{{C}}\\p{{Z}}]')))::double / (sum(length(text)) + count(*) - 1), 6) AS non_printable_ratio,
  round(CASE WHEN count(*) > 1 THEN (count(*) - count(DISTINCT text))::double / count(*) ELSE 0 END, 6) AS repetition_score
  FROM held WHERE text <> '' GROUP BY doc_id),
gated AS (SELECT *, list_filter([CASE WHEN char_count < 50 THEN 'too_short' END, CASE WHEN non_printable_ratio > 0.05 THEN 'non_printable' END,
  CASE WHEN repetition_score > 0.4 THEN 'repetitive' END], lambda r: r IS NOT NULL) AS reasons FROM measured)"""


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def bm25_index(where: str = "true") -> str:
    return f"""
corpus AS (SELECT doc_id AS chunk_id, text AS stable_text, source AS source_path, lang, {tokens('text')}::int AS token_count FROM documents),
words AS MATERIALIZED (SELECT chunk_id, {terms('stable_text')} AS t FROM corpus WHERE {where}),
lengths AS (SELECT chunk_id, len(t) AS n_terms FROM words),
postings AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM words) GROUP BY ALL),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT count(*) FROM lengths) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY term),
statistics AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def bm25(k: int, scope: str = "true", asked: str = ASKED) -> str:
    return f"""{bm25_index()}, {asked},
wanted AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({terms('query')}) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / (SELECT avg(n_terms) FROM lengths)))), 6) AS bm25_score
  FROM postings JOIN statistics USING (term) JOIN wanted USING (term) JOIN lengths USING (chunk_id) JOIN corpus USING (chunk_id) WHERE {scope} GROUP BY ALL),
keyword AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id))::int AS rank FROM scored QUALIFY rank <= {k})"""


def knn(condition: str, k: int, same: str = "true") -> str:
    return f"""near AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id,
  round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::double - z[2]::double) ** 2)), 6) AS l2sq
  FROM embeddings q JOIN embeddings v ON {same} WHERE {condition}),
vector AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY l2sq, chunk_id))::int AS rank FROM near QUALIFY rank <= {k})"""


LISTS = f"""{bm25(20)}, {knn('q.vec_id IN (SELECT query_id FROM asked)', 20)}"""
FUSED = f"""{LISTS},
lists AS (SELECT query_id, chunk_id, 'bm25' AS list, rank, bm25_score, NULL::double AS vector_score FROM keyword
  UNION ALL SELECT query_id, chunk_id, 'vector', rank, NULL, -l2sq FROM vector),
counts AS (SELECT query_id, count(DISTINCT list) AS n FROM lists GROUP BY ALL),
summed AS (SELECT query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) AS rrf_score, count(DISTINCT list) AS held_by, max(bm25_score) AS bm25_score,
  max(vector_score) AS vector_score, min(list) AS first_list FROM lists GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, rrf_score, (row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id))::int AS rank, bm25_score, vector_score,
  CASE WHEN n > 1 AND held_by = n THEN 'hybrid' ELSE first_list END AS retrieval_source FROM summed JOIN counts USING (query_id) QUALIFY rank <= 10),
hybrid AS (SELECT f.*, c.stable_text, c.stable_text AS display_text, c.source_path, c.token_count, a.query FROM fused f JOIN corpus c USING (chunk_id) JOIN asked a USING (query_id))"""
LABEL = "CASE WHEN bm25_score IS NOT NULL AND vector_score IS NOT NULL THEN 'both' WHEN bm25_score IS NOT NULL THEN 'bm25_only' ELSE 'vector_only' END"
OVERLAP = f"""{FUSED},
bags AS (SELECT *, list_distinct({terms('query')}) AS qa, list_distinct({terms('stable_text')}) AS ta FROM hybrid),
jaccard AS (SELECT *, round(len(list_intersect(qa, ta))::double / (len(qa) + len(ta) - len(list_intersect(qa, ta))), 6) AS rerank_score FROM bags),
reranked AS (SELECT query_id, chunk_id, rank AS old_rank, rerank_score,
  (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank))::int AS new_rank FROM jaccard QUALIFY new_rank <= 5)"""
PACKED = f"""{FUSED},
once AS (SELECT *, source_path AS source_label, row_number() OVER (PARTITION BY query_id, {strip('stable_text')} ORDER BY rank) AS nth FROM hybrid),
running AS (SELECT *, token_count AS tokens, (row_number() OVER w)::int AS ref_number, (sum(token_count) OVER w)::bigint AS used_tokens FROM once WHERE nth = 1 WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
packed AS (SELECT * FROM running WHERE ref_number <= 6 AND used_tokens <= 2048),
contexts AS (SELECT query_id, string_agg('[' || ref_number || '] ' || display_text, chr(10) || chr(10) ORDER BY ref_number) AS context_text, sum(tokens)::bigint AS total_tokens, count(*) AS n_passages,
  string_agg('[' || ref_number || '] ' || source_label, chr(10) ORDER BY ref_number) AS entries FROM packed GROUP BY query_id),
answered AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'Sorry, I don''t have enough information in the provided context to answer this question.'
  WHEN query_id % 5 = 0 THEN regexp_replace(answer, '\\[[2-9]\\]', '', 'g') ELSE answer END AS answer
  FROM (SELECT query_id, string_agg(coalesce({sentences('display_text')}[1], '') || ' [' || ref_number || ']', ' ' ORDER BY ref_number) AS answer FROM packed GROUP BY query_id))"""
EVAL = f"""{bm25(20)},
qrels AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
found AS (SELECT k.query_id, count(*) FILTER (q.chunk_id IS NOT NULL AND rank <= 10) AS hits, min(rank) FILTER (q.chunk_id IS NOT NULL) AS first,
  sum(1 / log2(rank + 1)) FILTER (q.chunk_id IS NOT NULL AND rank <= 10) AS dcg
  FROM keyword k LEFT JOIN qrels q ON q.query_id = k.query_id AND q.chunk_id = k.chunk_id GROUP BY k.query_id),
counted AS (SELECT query_id, count(*) AS n_relevant FROM qrels GROUP BY query_id),
judged AS (SELECT query_id, coalesce(n_relevant, 0) AS n_relevant, coalesce(hits, 0) AS hits,
  round(CASE WHEN n_relevant > 0 THEN coalesce(hits, 0)::double / n_relevant ELSE 0 END, 6) AS recall,
  round(CASE WHEN n_relevant > 0 THEN coalesce(1.0::double / first, 0) ELSE 0 END, 6) AS mrr,
  round(CASE WHEN n_relevant > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg
  FROM found FULL JOIN counted USING (query_id)),
averaged AS (SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM judged)"""


def _share(a: str, b: str) -> str:
    return f"round(CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::double / len({a}) ELSE 0 END, 6)"


def _plain(x: str) -> str:
    for fancy, plain in PLAIN_FORMS.items():
        x = f"replace({x}, {lit(fancy)}, {lit(plain)})"
    return x


def _nav(x: str) -> str:
    tests = [f"contains(lower({x}), {lit(p)})" for p in NAV_PHRASES]
    for s in NAV_SEPARATORS:
        parts = f"list_filter(list_transform(string_split({x}, {lit(s)}), lambda q: {strip('q')}), lambda q: q <> '')"
        tests.append(f"(contains({x}, {lit(s)}) AND len({parts}) BETWEEN 2 AND 10 AND len(list_filter({parts}, lambda q: length(q) > 30)) = 0)")
    return "(" + " OR ".join(tests) + ")"


def main_text(x: str) -> str:
    for element in ("script", "style", "nav", "header", "footer", "noscript"):
        x = f"regexp_replace({x}, '(?is)<{element}\\b.*?</{element}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(p|div|section|article|h[1-6]|li|ul|ol|table|tr|br|main|body|title|head|blockquote|pre)\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    lines = f"list_transform(string_split({x}, chr(10)), lambda q: trim(regexp_replace(q, '[ \\t\\r]+', ' ', 'g')))"
    return f"array_to_string(list_filter({lines}, lambda q: q <> ''), chr(10) || chr(10))"


HOST = "lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"
PATH = "regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
NAMES = f"""named AS (SELECT page_id, html, url AS u, regexp_extract(regexp_replace({PATH.replace('(u,', '(url,')}, '/+$', ''), '([^/]*)$', 1) AS last, {HOST.replace('(u,', '(url,')} AS host,
  {PATH.replace('(u,', '(url,')} AS path FROM pages),
files AS (SELECT *, CASE WHEN contains(b, '.') THEN b ELSE b || '.html' END AS name FROM (SELECT *, CASE WHEN last <> '' THEN last WHEN host <> '' THEN host ELSE u END AS b FROM named))"""
_EXT = [(f"ext = {lit(e)}", f"{{'mime_type': {lit(m)}, 'detected_type': {lit(t)}, 'confidence': 0.7::double, 'strategy': 'extension'}}") for e, (m, t) in EXTENSIONS.items()]
SNIFF = f"""{NAMES},
heads AS (SELECT page_id, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS ext, ltrim(lower(substr(html, 1, 512)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS head FROM files),
sniffed AS (SELECT page_id, {_case([("starts_with(head, '<!doctype html') OR starts_with(head, '<html')", "{'mime_type': 'text/html', 'detected_type': 'html', 'confidence': 0.95::double, 'strategy': 'magic'}"), *_EXT],
  "{'mime_type': 'application/octet-stream', 'detected_type': 'unknown', 'confidence': 0.0::double, 'strategy': 'none'}")} AS s FROM heads)"""
MARKDOWN = f"""{LINES},
marks AS (SELECT doc_id, pos, CASE WHEN pos % 9 = 0 THEN '# ' || text WHEN pos % 9 = 4 THEN '## ' || text WHEN pos % 9 = 6 THEN '```' WHEN pos % 9 = 8 THEN '' ELSE text END AS line FROM lines),
state AS (SELECT *, starts_with(line, '```') AS fence, coalesce(sum(starts_with(line, '```')::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM marks),
kinds AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN fenced THEN 'code' WHEN starts_with({strip('line')}, '#') THEN 'heading' WHEN {strip('line')} = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM state),
titled AS (SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract({strip('line')}, '^#+')) END AS level, CASE WHEN kind = 'heading' THEN {strip("regexp_replace(" + strip('line') + ", '^#+', '')")} END AS title FROM kinds),
runs AS (SELECT *, sum((kind IN ('fence', 'heading', 'blank'))::int) OVER (PARTITION BY doc_id ORDER BY pos) AS run,
  last_value(CASE WHEN level = 1 AND title <> '' THEN {{'pos': pos, 'title': title}} END IGNORE NULLS) OVER w AS h1,
  last_value(CASE WHEN level = 2 AND title <> '' THEN {{'pos': pos, 'title': title}} END IGNORE NULLS) OVER w AS h2 FROM titled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
found AS (
  SELECT doc_id, pos AS spot, 'heading' AS block_type, title AS text, CASE WHEN level = 1 THEN [] ELSE [h1.title] END AS path FROM runs WHERE kind = 'heading' AND title <> ''
  UNION ALL
  SELECT doc_id, min(pos), kind, {strip("string_agg(line, chr(10) ORDER BY pos)")},
    CASE WHEN first(h1) IS NULL THEN [] WHEN first(h2).pos > first(h1).pos THEN [first(h1).title, first(h2).title] ELSE [first(h1).title] END
  FROM runs WHERE kind IN ('code', 'paragraph') GROUP BY doc_id, run, kind)"""
RAW_URL = f"CASE WHEN {HOST} = 'github.com' AND regexp_matches({PATH}, '^/([^/]+)/([^/]+)/blob/(.+)$') THEN 'https://raw.githubusercontent.com' || regexp_replace({PATH}, '^/([^/]+)/([^/]+)/blob/(.+)$', '/\\1/\\2/\\3') ELSE trim(u) END"
THREADS = "threads AS (SELECT conv_id, count(*) AS n_messages, max(turn) AS cursor, string_agg('[' || turn || '] <' || coalesce(role, 'unknown') || '>: ' || coalesce(text, ''), chr(10) ORDER BY turn, '[' || turn || '] <' || coalesce(role, 'unknown') || '>: ' || coalesce(text, '')) AS text FROM conversations GROUP BY conv_id)"

ORACLE_SQL: dict[str, str] = {
    "blocks_split": f"WITH RECURSIVE {split(64)} SELECT doc_id, sequence, block_hash, n_tokens FROM blocks",
    "doc_fingerprint": "SELECT doc_id, sha256(text) AS fingerprint, sha256(source || ':' || sha256(text)) AS doc_key FROM documents",
    "parse_metrics": f"WITH {METRICS} SELECT doc_id, n_blocks, char_count::bigint AS char_count, non_printable_ratio, repetition_score FROM measured",
    "quality_gates": f"WITH {METRICS} SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM gated",
    "sentence_split": f"WITH {LINES}, s AS (SELECT doc_id, pos, {sentences('text')} AS s FROM lines) SELECT doc_id, pos, nth::int AS nth, sha256(q) AS sentence_hash FROM (SELECT doc_id, pos, unnest(range(len(s))) AS nth, unnest(s) AS q FROM s)",
    "clean_unicode": f"SELECT doc_id, sha256({_plain('nfc_normalize(text || ' + lit(' … “é” ﬁn — é') + ')')}) AS text_hash FROM documents",
    "clean_empty": f"WITH {LINES} SELECT doc_id, pos FROM lines WHERE length({strip('text')}) >= 3",
    "clean_pipeline": f"""WITH {LINES}, s AS (SELECT doc_id, pos, {_plain('nfc_normalize(text)')} AS text FROM lines), t AS (SELECT *, {strip('text')} AS t FROM s)
SELECT doc_id, pos, sha256(text) AS text_hash FROM t WHERE t <> '' AND NOT {_nav('t')} QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) = 1""",
    "clean_ocr_merge": f"""WITH {LINES}, s AS (SELECT doc_id, pos, {strip('text')} AS line FROM lines),
flags AS (SELECT *, line = '' OR regexp_matches(line, '[.!?"''' || chr(39) || ']$') OR length(line) >= 80 AS flush FROM s),
groups AS (SELECT *, coalesce(sum(flush::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM flags),
merged AS (SELECT doc_id, g, string_agg(line, ' ' ORDER BY pos) FILTER (line <> '') AS m FROM groups GROUP BY ALL),
joined AS (SELECT doc_id, coalesce(string_agg(m, chr(10) ORDER BY g), '') AS text FROM merged GROUP BY doc_id)
SELECT doc_id, sha256(CASE WHEN contains(d.text, chr(10)) THEN j.text ELSE d.text END) AS text_hash FROM documents d JOIN joined j USING (doc_id)""",
    "clean_navigation": f"WITH {LINES}, s AS (SELECT doc_id, pos, {strip('text')} AS t FROM lines) SELECT doc_id, pos FROM s WHERE NOT {_nav('t')}",
    "clean_page_navigation": f"""WITH body AS (SELECT page_id AS doc_id, string_split({main_text('html')}, chr(10)) AS p FROM pages),
l AS (SELECT doc_id, unnest(range(len(p)))::int AS pos, unnest(p) AS text FROM body), s AS (SELECT *, {strip('text')} AS t FROM l)
SELECT doc_id, pos, sha256(text) AS text_hash FROM s WHERE NOT {_nav('t')}""",
    "clean_repeated_headers": f"""WITH {LINES}, s AS (SELECT doc_id, pos, pos // 10 AS page, {strip('text')} AS t FROM lines),
pages_of AS (SELECT doc_id, count(DISTINCT page) AS n FROM s GROUP BY ALL),
often AS (SELECT doc_id, t FROM s JOIN pages_of USING (doc_id) WHERE n >= 2 GROUP BY doc_id, t, n HAVING count(DISTINCT page) > 0.5 * n)
SELECT doc_id, pos FROM s ANTI JOIN often USING (doc_id, t)""",
    "clean_dedupe_lines": f"WITH {LINES} SELECT doc_id, pos FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, {strip('text')} ORDER BY pos) = 1",
    "sniff_types": f"WITH {SNIFF} SELECT page_id, s.detected_type, s.mime_type, s.confidence, s.strategy FROM sniffed",
    "route_types": f"WITH {SNIFF}, r AS (SELECT page_id, {_case([(f's.detected_type = {lit(k)}', lit(','.join(v))) for k, v in ROUTES.items()], lit(''))} AS candidates FROM sniffed) SELECT page_id, candidates, candidates = '' AS unsupported FROM r",
    "markdown_blocks": f"""WITH {MARKDOWN} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1)::int AS pos, block_type, sha256(text) AS text_hash,
array_to_string(list_transform(path, lambda p: sha256({canonical('p')})), ',') AS section FROM found WHERE {strip('text')} <> ''""",
    "html_main_text": f"SELECT page_id, length({main_text('html')})::int AS n_chars, sha256({main_text('html')}) AS text_hash FROM pages",
    "web_artifacts": f"""WITH {NAMES}, x AS (SELECT *, {RAW_URL} AS source_id, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext FROM files)
SELECT page_id, source_id, name AS file_name, CASE WHEN ext = '.txt' THEN 'text/plain' WHEN ext IN ('.md', '.markdown', '.rst') OR {HOST} = 'raw.githubusercontent.com' THEN 'text/markdown' ELSE 'text/html' END AS mime_type,
  sha256(CASE WHEN ext IN ('.md', '.markdown', '.rst', '.txt') OR {HOST} = 'raw.githubusercontent.com' THEN html ELSE {main_text('html')} END) AS text_hash FROM x WHERE html <> ''""",
    "url_canonical": f"""WITH {NAMES} SELECT page_id, {RAW_URL} AS raw_url, name, CASE WHEN lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ('.md', '.markdown', '.rst', '.txt') THEN lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))
WHEN host = 'raw.githubusercontent.com' THEN '.md' ELSE '.html' END AS extension FROM files""",
    "thread_flatten": f"WITH {THREADS} SELECT conv_id, n_messages, cursor, sha256(text) AS text_hash FROM threads",
    "anchor_annotate": f"WITH RECURSIVE {ANNOTATED} SELECT doc_id, sequence, anchor_type, anchor_level, rule_name FROM annotated",
    "chunk_pack": f"WITH RECURSIVE {ASSIGNED} SELECT doc_id, sequence, chunk_no FROM pack",
    "chunk_build": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no, chunk_id, sha256(stable_text) AS stable_hash, sha256(display_text) AS display_hash, token_count, first_sequence, last_sequence FROM chunks",
    "chunk_stats": f"WITH RECURSIVE {CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(avg(token_count), 6) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM chunks",
    "chunk_token_histogram": f"WITH RECURSIVE {CHUNKS} SELECT CASE WHEN token_count <= 128 THEN '<=128' WHEN token_count <= 256 THEN '<=256' WHEN token_count <= 384 THEN '<=384' WHEN token_count <= 512 THEN '<=512' ELSE '>512' END AS bucket, count(*) AS n_chunks FROM chunks GROUP BY 1",
    "pronoun_risk": f"""WITH bags AS (SELECT doc_id, {pronouns('text')} AS w FROM documents), scored AS (SELECT doc_id, w, {RISK} AS r FROM bags)
SELECT doc_id, round(r, 6) AS score, CASE WHEN len(w) < 5 THEN 0 ELSE len(list_filter(w, lambda y: list_contains({_PRONOUNS}, y))) END::int AS pronouns, len(w)::int AS words,
CASE WHEN r < 0.2 THEN 'low' WHEN r < 0.5 THEN 'medium' ELSE 'high' END AS level FROM scored""",
    "enrich_chunks": f"""WITH RECURSIVE {CHUNKS}, s AS (SELECT doc_id, chunk_no, stable_text AS t, {sentences('stable_text')} AS s, {pronouns('stable_text')} AS w FROM chunks),
r AS (SELECT *, {RISK} AS risk, substr({strip("regexp_extract(t, '(?m)^#{1,6}" + chr(92) + "s+(.+)', 1)")}, 1, 120) AS heading FROM s)
SELECT doc_id, chunk_no, sha256(CASE WHEN heading <> '' THEN heading ELSE coalesce(list_filter(s, lambda q: length(q) <= 80)[1], replace(substr({strip('t')}, 1, 60), chr(10), ' ')) END) AS title_hash,
sha256(substr(array_to_string(s[1:2], ' '), 1, 256)) AS summary_hash,
array_to_string(list_filter([CASE WHEN regexp_matches(t, '```|`[^`]+`') THEN 'has_code' END, CASE WHEN regexp_matches(t, '(?m)^\\|.+\\|') THEN 'has_table' END,
CASE WHEN regexp_matches(t, '(?m)^(\\s*[-*+]|\\s*\\d+\\.)\\s+') THEN 'has_list' END, CASE WHEN risk >= 0.5 THEN 'high_pronoun_risk' END], lambda q: q IS NOT NULL), ',') AS tags FROM r""",
    "block_diff": f"WITH RECURSIVE {DIFF} SELECT doc_id, block_hash, status, count(*) AS n FROM diff GROUP BY ALL",
    "diff_guardrail": f"""WITH RECURSIVE {DIFF}, c AS (SELECT doc_id, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed FROM diff GROUP BY doc_id),
r AS (SELECT *, (added + removed)::double / (unchanged + added + removed) AS r FROM c)
SELECT doc_id, unchanged, added, removed, round(r, 6) AS change_ratio, CASE WHEN r >= 0.9 THEN 'error' WHEN r >= 0.5 THEN 'warning' ELSE 'none' END AS level FROM r""",
    "resync_window": f"WITH RECURSIVE {RESYNC} SELECT doc_id, chunk_signature, pos, CASE WHEN again THEN 'reembed' ELSE 'reuse' END AS action FROM again",
    "resync_hybrid": f"""WITH RECURSIVE {RESYNC}, all_ AS (SELECT doc_id, again OR avg(again::int) OVER (PARTITION BY doc_id) >= 0.8 AS again FROM again)
SELECT doc_id, count(*) FILTER (NOT again) AS reused, count(*) FILTER (again) AS reembed, round(count(*) FILTER (NOT again)::double / count(*), 6) AS savings_ratio FROM all_ GROUP BY doc_id""",
    "stale_chunks": f"WITH RECURSIVE {VERSIONS} SELECT o.doc_id, o.pos, o.block_hash AS chunk_signature FROM old o ANTI JOIN new n ON o.doc_id = n.doc_id AND o.block_hash = n.block_hash",
    "early_skip": "WITH known AS (SELECT CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text FROM documents) SELECT doc_id, sha256(text) AS doc_key FROM documents ANTI JOIN known USING (text)",
    "latest_version": "SELECT source AS source_path, doc_id, n_chars AS ingest_seq FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) = 1",
    "upsert_documents": "WITH r AS (SELECT doc_id * 2 AS doc_id, lang, -1::bigint AS n_chars FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, lang, n_chars FROM documents ANTI JOIN r USING (doc_id) UNION ALL SELECT * FROM r",
    "delete_documents": f"WITH {LINES} SELECT doc_id, count(*) AS n_blocks FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id",
    "bm25_statistics": f"WITH {bm25_index()} SELECT term, df, round(idf, 6) AS idf FROM statistics",
    "bm25_topk": f"WITH {bm25(10)} SELECT query_id, chunk_id, bm25_score, rank FROM keyword",
    "bm25_pruned": f"WITH {bm25(10)} SELECT query_id, chunk_id, bm25_score, rank FROM keyword",
    "bm25_filled": f"""WITH {bm25(10, asked="asked AS (SELECT min(doc_id) AS query_id, source AS query FROM documents WHERE source IS NOT NULL GROUP BY source)")}
SELECT a.query_id, c.chunk_id, coalesce(s.bm25_score, 0) AS bm25_score, (row_number() OVER (PARTITION BY a.query_id ORDER BY s.bm25_score IS NULL, s.bm25_score DESC, c.chunk_id))::int AS rank
FROM asked a CROSS JOIN corpus c LEFT JOIN scored s ON s.query_id = a.query_id AND s.chunk_id = c.chunk_id QUALIFY rank <= 10""",
    "bm25_topk_collection": f"""WITH {bm25(10, "lang = 'en'")} SELECT query_id, chunk_id, bm25_score, rank FROM keyword""",
    "keyword_remove": f"WITH {bm25_index('chunk_id % 4 <> 0')} SELECT term, df, round(idf, 6) AS idf FROM statistics",
    "knn_topk": f"WITH {knn('q.vec_id % 100 = 0', 10)} SELECT query_id, chunk_id, l2sq, rank FROM vector",
    "knn_pivots": f"WITH {knn('q.vec_id % 100 = 0', 10)} SELECT query_id, chunk_id, l2sq, rank FROM vector",
    "knn_topk_filtered": f"WITH {knn('q.vec_id % 100 = 0', 10, 'q.label = v.label')} SELECT query_id, chunk_id, l2sq, rank FROM vector",
    "vector_dimensions": "SELECT len(embedding)::int AS dimension, count(*) AS n_vectors FROM embeddings GROUP BY 1",
    "attribute_candidates": f"""WITH {LISTS}, m AS (SELECT query_id, chunk_id, bm25_score, -l2sq AS vector_score FROM keyword FULL JOIN vector USING (query_id, chunk_id))
SELECT *, CASE WHEN bm25_score IS NOT NULL AND vector_score IS NOT NULL THEN 'hybrid' WHEN bm25_score IS NOT NULL THEN 'bm25' ELSE 'vector' END AS retrieval_source, {LABEL} AS source_label FROM m""",
    "rrf_fusion": f"WITH {FUSED} SELECT query_id, chunk_id, rrf_score, rank, bm25_score, vector_score, retrieval_source FROM fused",
    "hybrid_search": f"WITH {FUSED} SELECT query_id, chunk_id, rank, rrf_score, rrf_score AS final_score, retrieval_source, source_path FROM hybrid",
    "language_filter": f"""WITH {FUSED}, m AS (SELECT *, query_id % 3 = 0 AND NOT (chunk_id % 5 = 0 OR regexp_matches(stable_text, '{CJK}')) AND coalesce(bm25_score, 0) <= 0 AS wrong FROM hybrid),
c AS (SELECT *, count(*) FILTER (NOT wrong) OVER (PARTITION BY query_id) AS n, min(rank) OVER (PARTITION BY query_id) AS first FROM m)
SELECT query_id, chunk_id, rank FROM c WHERE NOT wrong OR (n = 0 AND rank = first)""",
    "rerank_overlap": f"WITH {OVERLAP} SELECT query_id, chunk_id, new_rank AS rank, rerank_score FROM reranked",
    "rank_change": f"WITH {OVERLAP} SELECT query_id, chunk_id, old_rank, new_rank, CASE WHEN old_rank > new_rank THEN '▲' || (old_rank - new_rank) WHEN old_rank < new_rank THEN '▼' || (new_rank - old_rank) ELSE '↔' END AS change FROM reranked",
    "packer_citations": f"""WITH {PACKED} SELECT query_id, ref_number, chunk_id, CASE WHEN chunk_id % 3 <> 0 THEN source_label ELSE chunk_id::varchar END AS source_label,
sha256(CASE WHEN length(display_text) > 120 THEN regexp_replace(substr(display_text, 1, 120), '{SPACE}+$', '') || '…' ELSE display_text END) AS excerpt_hash FROM packed""",
    "eval_answerable": f"WITH {EVAL} SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM judged WHERE query_id % 4 <> 0",
    "citations": f"WITH {FUSED} SELECT query_id, rank AS ref_number, chunk_id, source_path AS source_label, sha256(substr(display_text, 1, 200)) AS excerpt_hash FROM hybrid",
    "context_pack": f"WITH {PACKED} SELECT query_id, ref_number, chunk_id, tokens, used_tokens FROM packed",
    "context_drop_reasons": f"""WITH {PACKED} SELECT o.query_id, o.chunk_id, o.rank, CASE WHEN o.nth > 1 THEN 'duplicate' WHEN r.ref_number > 6 THEN 'below_top_k' ELSE 'budget' END AS reason
FROM once o LEFT JOIN running r ON r.query_id = o.query_id AND r.chunk_id = o.chunk_id ANTI JOIN packed p ON p.query_id = o.query_id AND p.chunk_id = o.chunk_id""",
    "context_text": f"WITH {PACKED} SELECT query_id, sha256(context_text) AS context_hash, total_tokens, n_passages FROM contexts",
    "prompt_build": f"""WITH {PACKED} SELECT a.query_id, sha256(concat_ws(chr(10) || chr(10), {lit(INDEX_HEADER + chr(10))} || entries, {lit(CONTEXT_HEADER)} || coalesce(context_text, {lit(NO_CONTEXT)}), {lit(QUESTION_HEADER)} || {strip('query')})) AS user_hash
FROM asked a LEFT JOIN contexts USING (query_id)""",
    "abstain_detection": f"WITH {PACKED} SELECT query_id, {' OR '.join(f'contains(lower(answer), {lit(p)})' for p in ABSTAIN)} AS abstained FROM answered",
    "cited_filter": f"""WITH {PACKED}, n AS (SELECT query_id, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::int) AS named FROM answered)
SELECT query_id, ref_number, chunk_id FROM packed JOIN n USING (query_id) WHERE len(named) = 0 OR list_contains(named, ref_number)""",
    "answer_spans": f"""WITH {PACKED}, p AS (SELECT query_id, list_filter(string_split(regexp_replace(answer, '(\\[\\d+\\])', chr(31) || '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS p FROM answered),
u AS (SELECT query_id, unnest(range(len(p)))::int AS span_no, unnest(p) AS t FROM p),
e AS (SELECT *, (sum(length(t)) OVER (PARTITION BY query_id ORDER BY span_no))::int AS end_at FROM u)
SELECT query_id, span_no, CASE WHEN regexp_full_match(t, '\\[\\d+\\]') THEN 'citation_marker' ELSE 'answer' END AS span_type, end_at - length(t)::int AS start_at, end_at, sha256(t) AS text_hash FROM e""",
    "eval_per_query": f"WITH {EVAL} SELECT query_id, n_relevant, hits, recall, mrr, ndcg FROM judged",
    "eval_macro": f"WITH {EVAL} SELECT * FROM averaged",
    "benchmark_report": f"""WITH {EVAL.replace('rank <= 20)', 'rank <= 100)')}, own AS (SELECT * FROM judged WHERE n_relevant > 0),
candidates AS (SELECT count(*) AS n FROM keyword SEMI JOIN own USING (query_id))
SELECT count(*) AS n_queries, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(ndcg), 0), 6) AS ndcg,
  any_value(n) AS total, any_value(n) AS n_bm25_only FROM own, candidates""",
    "case_outcomes": f"WITH {EVAL} SELECT CASE WHEN n_relevant = 0 THEN 'SKIP' WHEN hits > 0 THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS n FROM judged GROUP BY 1",
    "source_attribution": f"""WITH {FUSED}, l AS (SELECT {LABEL} AS source_label FROM hybrid) SELECT count(*) AS total, """
    + ", ".join(f"count(*) FILTER (source_label = '{x}') AS n_{x}, round(count(*) FILTER (source_label = '{x}')::double / greatest(count(*), 1), 6) AS share_{x}" for x in ("bm25_only", "vector_only", "both"))
    + " FROM l",
    "token_saved": f"""WITH {PACKED}, c AS (SELECT query_id, sum(token_count) AS c FROM hybrid GROUP BY ALL), u AS (SELECT query_id, sum(tokens) AS u FROM packed GROUP BY ALL)
SELECT count(*) AS n_queries, round(avg(c - u), 6) AS token_saved_est FROM c JOIN u USING (query_id)""",
    "baseline_compare": f"""WITH {EVAL}, b(baseline, baseline_ndcg) AS (VALUES ('scifact', 0.665::double), ('fiqa', 0.236::double), ('nfcorpus', 0.325::double))
SELECT baseline, baseline_ndcg, ndcg, round(ndcg - baseline_ndcg, 6) AS difference FROM averaged, b""",
    "latency_mean_p95": """WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, n, round(m, 4) AS mean, l[n * 95 // 100 + 1] AS p95 FROM s""",
    "runs_latest": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "runs_by_type": "SELECT event_type, count(*) AS n_runs, max(event_id) AS last_id, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "list_collections": "SELECT coalesce(nullif(lang, ''), 'default') AS collection, count(*) AS n_documents FROM documents GROUP BY 1",
    "ingest_summary": f"WITH {METRICS} SELECT CASE WHEN len(reasons) = 0 THEN 'ok' WHEN list_contains(reasons, 'too_short') THEN 'skipped' ELSE 'error' END AS status, count(*) AS n_docs, sum(n_blocks)::bigint AS n_blocks, sum(char_count)::bigint AS chars FROM gated GROUP BY 1",
    "sync_counters": f"""WITH {THREADS} SELECT count(*) AS fetched, count(*) FILTER (conv_id % 3 <> 0 AND trim(text) <> '') AS ingested, count(*) FILTER (conv_id % 3 = 0) AS skipped,
count(*) FILTER (conv_id % 3 <> 0 AND trim(text) = '') AS failed FROM threads""",
    "connector_cursor": "SELECT role, count(*) AS n_new, max(turn) AS cursor FROM conversations WHERE turn > 1 GROUP BY role",
    "extractive_answers": f"WITH {PACKED} SELECT query_id, sha256(answer) AS answer_hash FROM answered",
    "answer_quality": f"""WITH {PACKED}, r AS (SELECT query_id, answer, context_text, b.text AS expected, query FROM answered JOIN contexts USING (query_id) JOIN benchmark b ON b.item_id = query_id JOIN asked USING (query_id)),
t AS (SELECT query_id, list_distinct({terms('answer')}) AS a, list_distinct({terms('context_text')}) AS c, list_distinct({terms('expected')}) AS e, list_distinct({terms('query')}) AS q FROM r)
SELECT query_id, {_share('a', 'c')} AS faithfulness, {_share('q', 'a')} AS answer_relevancy, {_share('e', 'c')} AS context_recall FROM t""",
    "layout_headings": f"""WITH {LINES}, s AS (SELECT doc_id, pos // 10 AS page, pos AS line, CASE WHEN pos % 6 = 0 THEN 14.0 ELSE 10.0 END::double AS size, text FROM lines),
e AS (SELECT doc_id, sum(length(text)) AS total, sum(length(text)) FILTER (size = 10) AS small FROM s GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN 2 * small > total THEN 10.0 WHEN 2 * small = total THEN 12.0 ELSE 14.0 END AS median FROM (SELECT doc_id, total, coalesce(small, 0) AS small FROM e))
SELECT doc_id, page::int AS page, line, CASE WHEN size >= 1.2 * median OR regexp_matches(text, '^[A-Z][A-Z\\s&/\\-]{{3,59}}$') THEN 'heading' ELSE 'paragraph' END AS block_type
FROM s JOIN m USING (doc_id) WHERE length(trim(text)) >= 3""",
    "layout_paragraphs": f"""WITH {LINES}, s AS (SELECT doc_id, pos // 10 AS page, pos % 10 // 4 AS block, pos AS line, CASE WHEN pos % 6 = 0 THEN 14.0 ELSE 10.0 END::double AS size, text, {strip('text')} AS bare FROM lines),
m AS (SELECT doc_id, CASE WHEN 2 * coalesce(sum(length(bare)) FILTER (size = 10), 0) > sum(length(bare)) THEN 10.0 WHEN 2 * coalesce(sum(length(bare)) FILTER (size = 10), 0) = sum(length(bare)) THEN 12.0 ELSE 14.0 END AS median FROM s GROUP BY doc_id),
k AS (SELECT *, size >= 1.2 * median OR regexp_matches(bare, '^[A-Z][A-Z\\s&/\\-]{{3,59}}$') AS heading FROM s JOIN m USING (doc_id) WHERE bare <> ''),
g AS (SELECT *, sum(heading::int) OVER (PARTITION BY doc_id, page, block ORDER BY line) AS island FROM k),
t AS (SELECT doc_id, page, block, heading, min(line) AS first_line, count(*) AS n_lines, {strip("string_agg(text, chr(10) ORDER BY line)")} AS body FROM g GROUP BY doc_id, page, block, island, heading)
SELECT doc_id, page::int AS page, block::int AS block, first_line, n_lines, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS block_type, sha256(body) AS text_hash FROM t WHERE length(body) >= 3""",
    "trace_stages": """SELECT user_id AS run_id, CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'click' THEN 'rerank' WHEN 'purchase' THEN 'generate' ELSE 'parse' END AS stage,
count(*) AS n_events, round(sum(value), 4) AS latency_ms FROM events GROUP BY 1, 2""",
    "trace_latest": "SELECT user_id AS run_id, event_id FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
