"""Document preparation and text rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import chunking, docprep, mining
from corpusmill.plans.registry import query, table

UNITS = r"[\x{3400}-\x{9fff}]|[A-Za-z0-9]+(?:[-''/][A-Za-z0-9]+)*|[^\sA-Za-z0-9\x{3400}-\x{9fff}]"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{UNITS}'))::INT AS n_tokens FROM documents")
def dc20_count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("n_tokens"))


@query(r"""SELECT doc_id, CASE WHEN v = 0 THEN 0.0 ELSE round(least(1.0, g::DOUBLE / v), 6) END AS garbled FROM (
  SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS v, len(regexp_extract_all(text, '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]')) AS g FROM documents)""")
def dc15_garbled_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(tx.garbled_ratio(F.col("text")), 6).alias("garbled"))


@query(r"""SELECT doc_id, length(text) BETWEEN 15 AND 2000 AND NOT regexp_full_match(text, '[\d[:punct:]\s]*')
  AND NOT (len(list_distinct(string_split(text, ''))) <= 2 AND length(text) < 30) AS useful FROM documents""")
def dc2_filter_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.chunk_is_useful(F.col("text")).alias("useful"))


LINES = r"""SELECT doc_id, line_no, x FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, source FROM documents)) WHERE trim(x) <> ''"""


@query(rf"""SELECT doc_id, 1 AS page, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS block_order,
  CASE WHEN starts_with(x, '#') THEN 'heading' ELSE 'text' END AS kind, trim(regexp_replace(x, '^#+\s*', '')) AS text FROM ({LINES})""")
def src5_text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return docprep.text_blocks(table(spark, sf, "documents"))


@query(rf"""WITH b AS (SELECT DISTINCT d.source AS doc_id, d.doc_id AS page, trim(regexp_replace(regexp_replace(lower(l.x), '\s+', ' ', 'g'), '\d+', '#', 'g')) AS edge
    FROM ({LINES}) l JOIN documents d USING (doc_id)),
  p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b GROUP BY 1), s AS (SELECT doc_id, edge, count(*) AS n FROM b GROUP BY 1, 2)
  SELECT doc_id, edge FROM s JOIN p USING (doc_id) WHERE n >= greatest(2, floor(0.01 * pages + 0.999))""")
def dc8_repeated_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A source's documents as the pages of one document, their lines as blocks."""
    docs = table(spark, sf, "documents")
    lines = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text")).filter(F.trim("text") != "")
    return docprep.repeated_edges(lines, 0.01)


@query(rf"""WITH b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS block_order, trim(regexp_replace(x, '^#+\s*', '')) AS text FROM ({LINES})),
  f AS (SELECT *, lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS print FROM b) SELECT doc_id, block_order, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, print ORDER BY block_order) AS n FROM f) WHERE n = 1 OR print = ''""")
def dc10_dedup_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return docprep.dedup_blocks(docprep.text_blocks(table(spark, sf, "documents"))).select("doc_id", "block_order", "text")


@query(rf"""SELECT doc_id, 1::BIGINT AS pages, count(*) AS blocks, sum(length(text))::BIGINT AS chars, 0.0::DOUBLE AS garbled, round(1 - count(DISTINCT text)::DOUBLE / count(*), 6) AS duplicate_ratio
  FROM (SELECT doc_id, trim(regexp_replace(x, '^#+\s*', '')) AS text FROM ({LINES})) GROUP BY doc_id""")
def ag14_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return docprep.quality_report(docprep.text_blocks(table(spark, sf, "documents")))


@query(rf"""SELECT doc_id, 1 AS page, CASE WHEN chars = 0 THEN 'empty' ELSE 'text' END AS page_type FROM (
  SELECT doc_id, sum(length(trim(regexp_replace(x, '^#+\s*', '')))) AS chars FROM ({LINES}) GROUP BY doc_id)""")
def dc16_classify_pages(spark: SparkSession, sf: str) -> DataFrame:
    return docprep.classify_pages(docprep.text_blocks(table(spark, sf, "documents"))).select("doc_id", "page", "page_type")


#: Runs of three and more equal lines become one, then blanks are folded; the given texts are NFC and hold no entities or wide signs.
CLEAN = r"""l AS (SELECT doc_id, i, x, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS run FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  k AS (SELECT doc_id, i, x, count(*) OVER (PARTITION BY doc_id, x, run) AS n, min(i) OVER (PARTITION BY doc_id, x, run) AS first FROM l),
  o AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM k WHERE n < 3 OR i = first GROUP BY 1),
  c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS t FROM o)"""


def char_pieces_sql(source: str) -> str:
    """Windows of 500 characters of `source` (doc_id, t), cut behind the last sentence end, 100 before the next begins."""
    last = lambda m: f"(CASE WHEN strpos(substr(t, a + 1, 500), {m}) > 0 THEN length(substr(t, a + 1, 500)) - strpos(list_aggregate(list_reverse(string_split(substr(t, a + 1, 500), '')), 'string_agg', ''), {m}) ELSE -1 END)"
    marks = ["'。'", "'.'", "chr(10)", "'！'", "'？'"]
    end = "CASE WHEN a + 500 >= length(t) THEN length(t) - a " + " ".join(f"WHEN {last(m)} > 0 THEN {last(m)} + 1" for m in marks) + " ELSE 500 END"
    return f"""w AS (SELECT doc_id, t, piece, a, a + {end} AS b FROM (SELECT doc_id, t, 0 AS piece, 0 AS a FROM {source} WHERE t <> '')
    UNION ALL SELECT doc_id, t, piece, a, a + {end} AS b FROM (SELECT doc_id, t, piece + 1 AS piece, greatest(a + 1, b - 100) AS a FROM w WHERE b < length(t)))"""


@query(f"WITH {CLEAN} SELECT doc_id, length(t) AS n_chars, sha256(t) AS sha256 FROM c")
def dc1_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return tx.clean_text(table(spark, sf, "documents")).select("doc_id", F.length("clean").alias("n_chars"), F.sha2("clean", 256).alias("sha256"))


@query("SELECT doc_id, sha256(text || ' fi A2 SpO₂ 10⁹/L 1⁄2 x y') AS sha256 FROM documents")
def dc3_nfkc_symbol_safe(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with compatibility characters, signs and hard spaces at their end (the given texts hold none, so the oracle needs no NFKC)."""
    t = F.concat("text", F.lit(" ﬁ Ａ² SpO₂ 10⁹/L ½　x​﻿\xa0y"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.nfkc_symbol_safe(t), 256).alias("sha256"))


@query(r"""WITH t AS (SELECT doc_id, replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), 'e ', 'e-' || chr(10)) AS t FROM documents)
  SELECT doc_id, sha256(regexp_replace(t, '([A-Za-z]{2,})-\s*\n\s*([a-z][A-Za-z]*)', '\1\2', 'g') || ' Long-term LONG-term') AS sha256 FROM t""")
def dc4_repair_hyphens(spark: SparkSession, sf: str) -> DataFrame:
    """Texts, in ASCII, broken after every word that ends in e, and two compounds."""
    t = F.concat(F.replace(F.regexp_replace("text", r"[^\x00-\x7F]", ""), F.lit("e "), F.lit("e-\n")), F.lit(" Long-\nterm LONG- \n term"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.repair_hyphens(t), 256).alias("sha256"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\bl(0\s*(?:mg|g|mL|μg))\b', '1\1', 'g'), '(?i)\bu\s+g\b', 'μg', 'g') || ' 0.5 mg 10 mL xl0 g O.5 m 3 μg') AS sha256 FROM documents""")
def dc5_repair_ocr_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.repair_ocr_units(F.concat("text", F.lit(" O.5 mg l0 mL xl0 g O.5 m 3 U  g"))), 256).alias("sha256"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
  m AS (SELECT doc_id, array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = 1 THEN '' WHEN regexp_matches(ls[i - 1], '[。！？!?；;：:]$') OR regexp_matches(x, '^([-•●▪◦]|\d+[.)]|\d+(\.\d+){0,3}\s|References)') THEN chr(10) ELSE ' ' END || x), '') AS t FROM l)
  SELECT doc_id, (length(t) - length(replace(t, chr(10), '')))::INT AS line_ends, sha256(t) AS sha256 FROM m""")
def dc6_merge_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.merge_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(t, F.lit("\n")).alias("line_ends"), F.sha2(t, 256).alias("sha256"))


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A source's documents as the pages of one document: the first line as header, the last as footer."""
    lines = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.split("text", "\n").alias("lines"))
    rows = lines.select("doc_id", "page", F.size("lines").alias("n"), F.posexplode("lines").alias("block_order", "text"))
    kind = F.when(F.col("block_order") == 0, "header").when(F.col("block_order") == F.col("n") - 1, "footer").otherwise("text")
    return rows.filter(F.trim("text") != "").select("doc_id", "page", "block_order", kind.alias("kind"), "text")


PAGES = r"""l AS (SELECT source AS doc_id, doc_id AS page, string_split(text, chr(10)) AS ls FROM documents),
  r AS (SELECT doc_id, page, len(ls) AS n, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS block_order FROM l),
  b AS (SELECT *, CASE WHEN block_order = 0 THEN 'header' WHEN block_order = n - 1 THEN 'footer' ELSE 'text' END AS kind, trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '\d+', '#', 'g')) AS edge FROM r WHERE trim(text) <> ''),
  e AS (SELECT doc_id, edge FROM b WHERE kind <> 'text' GROUP BY 1, 2 HAVING count(DISTINCT page) >= greatest(2, floor({share} * (SELECT count(DISTINCT page) FROM b x WHERE x.doc_id = b.doc_id) + 0.999))),
  m AS (SELECT b.*, CASE WHEN kind <> 'text' AND e.edge IS NOT NULL THEN kind WHEN regexp_matches(trim(text), '^(-\s*)?\d+(\s*-)?$|^第\s*\d+\s*页$|^Page\s+\d+(\s+of\s+\d+)?$', 'i') THEN 'page_number'
    WHEN regexp_matches(trim(text), '^(CONFIDENTIAL|DRAFT|SAMPLE|COPY|机密|草稿|仅供内部使用)$', 'i') THEN 'watermark' END AS removed FROM b LEFT JOIN e USING (doc_id, edge))"""


@query(f"WITH {PAGES.format(share=0.01)} SELECT doc_id, page, block_order, sha256(text) AS sha256 FROM m WHERE removed IS NULL")
def dc9_remove_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = page_blocks(spark, sf)
    return docprep.remove_blocks(b, docprep.repeated_edges(b, 0.01))[0].select("doc_id", "page", "block_order", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {PAGES.format(share=0.01)} SELECT doc_id, page, block_order, 'remove_' || removed AS action, sha256(text) AS before, '' AS after, 'repeated_position_or_page_pattern' AS rule, 0.95::DOUBLE AS confidence FROM m WHERE removed IS NOT NULL")
def dc11_cleaning_audit(spark: SparkSession, sf: str) -> DataFrame:
    b = page_blocks(spark, sf)
    return docprep.remove_blocks(b, docprep.repeated_edges(b, 0.01))[1].withColumn("before", F.sha2("before", 256))


@query(rf"""WITH {PAGES.format(share=0.4)}, t AS (SELECT *, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM m WHERE removed IS NULL),
  f AS (SELECT *, lower(regexp_replace(clean, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS print FROM t WHERE clean <> ''),
  c AS (SELECT *, print <> '' AND row_number() OVER (PARTITION BY doc_id, page, print ORDER BY block_order) > 1 AS copy FROM f)
  SELECT doc_id, page, count(*) FILTER (NOT copy) AS kept, count(*) FILTER (copy) AS copies, sha256(coalesce(string_agg(clean, chr(10) ORDER BY block_order) FILTER (NOT copy), '')) AS sha256 FROM c GROUP BY 1, 2""")
def dc12_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of lines, so hyphens and lines have nothing to be merged with; the oracle takes the given texts as NFKC, which they are."""
    kept, done = docprep.clean_documents(page_blocks(spark, sf))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_order", "text"))), lambda x: x["text"]), "\n")
    a = kept.groupBy("doc_id", "page").agg(F.count("*").alias("kept"), F.sha2(text, 256).alias("sha256"))
    d = done.filter("action = 'remove_duplicate'").groupBy("doc_id", "page").agg(F.count("*").alias("copies"))
    return a.join(d, ["doc_id", "page"], "left").select("doc_id", "page", "kept", F.coalesce("copies", F.lit(0)).alias("copies"), "sha256")


@query(rf"""WITH b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS n, trim(x) AS t FROM ({LINES})),
  s AS (SELECT doc_id, n, n AS start_page, greatest(n, coalesce(lead(n) OVER (PARTITION BY doc_id ORDER BY n) - 1, (count(*) OVER (PARTITION BY doc_id))::INT)) AS end_page FROM b)
  SELECT doc_id, start_page, end_page FROM s""")
def wn9_section_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Each line opens a section on the page of its number."""
    b = docprep.text_blocks(table(spark, sf, "documents"))
    pages = b.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    s = b.select("doc_id", F.col("block_order").alias("section_id"), F.col("block_order").alias("start_page"))
    return docprep.section_ends(s, pages).select("doc_id", "start_page", F.col("end_page").cast("int").alias("end_page"))


@query()
def dc22_chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf, "documents")).select("doc_id", "chunk_index", "chunk_type", "parent_index", "section", "block_type", "start", "end", F.sha2("content", 256).alias("content_sha256"))


@query()
def dc25_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_ids(chunking.chunk_documents(table(spark, sf, "documents"))).select("doc_id", "chunk_index", "chunk_id", "content_sha256")


@query(f"WITH RECURSIVE d AS (SELECT doc_id, text AS t FROM documents), {char_pieces_sql('d')} SELECT doc_id, piece, a AS start, b - a AS n_chars FROM w")
def dc26_split_chars(spark: SparkSession, sf: str) -> DataFrame:
    return docprep.split_chars(table(spark, sf, "documents")).select("doc_id", "piece", "start", F.length("content").alias("n_chars"))


@query()
def dc28_split_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return docprep.split_recursive(table(spark, sf, "documents")).select("doc_id", "piece", F.length("content").alias("n_chars"))


@query(rf"""WITH RECURSIVE {CLEAN}, {char_pieces_sql('c')}, p AS (SELECT *, substr(t, a + 1, b - a) AS x FROM w)
  SELECT doc_id, piece, a AS start, b - a AS n_chars FROM p WHERE b - a BETWEEN 15 AND 2000 AND NOT regexp_full_match(x, '[\d[:punct:]\s]*') AND NOT (len(list_distinct(string_split(x, ''))) <= 2 AND b - a < 30)""")
def dc29_clean_and_split(spark: SparkSession, sf: str) -> DataFrame:
    clean = tx.clean_text(table(spark, sf, "documents")).select("doc_id", F.col("clean").alias("text"))
    return docprep.split_chars(clean).filter(tx.chunk_is_useful(F.col("content"))).select("doc_id", "piece", "start", F.length("content").alias("n_chars"))


@query(rf"""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{{2,}}|[\x{{4e00}}-\x{{9fff}}]{{2,8}}') AS ws FROM documents)),
  k AS (SELECT doc_id, w, min(i) AS i FROM w WHERE lower(w) NOT IN ('{"', '".join(tx.STOPWORDS)}') GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k),
  u AS (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM e WHERE n <= 80 GROUP BY doc_id, lower(w)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u),
  y AS (SELECT doc_id, count(*) AS n, string_agg(w, ',' ORDER BY i) AS ks FROM r WHERE n <= 40 GROUP BY 1),
  g AS (SELECT doc_id, least(20, count(DISTINCT lower(w))) AS n FROM w WHERE regexp_matches(w, '(mab|nib|pril|sartan|statin|cillin|mycin|azole)$', 'i') GROUP BY 1),
  h AS (SELECT doc_id, least(20, count(DISTINCT lower(c))) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:ICD-?10[:： ]*)?[A-Z][0-9]{{2}}(?:\.[0-9A-Z]{{1,4}})?\b|\bNCT\d{{8}}\b|\bPMID[:： ]*\d{{5,9}}\b', 0, 'i')) AS c FROM documents) GROUP BY 1)
  SELECT d.doc_id, coalesce(h.n, 0) AS n_codes, coalesce(g.n, 0) AS n_drugs, coalesce(y.n, 0) AS n_keywords, coalesce(ks, '') AS keywords FROM documents d LEFT JOIN y USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id)""")
def dc30_extract_metadata(spark: SparkSession, sf: str) -> DataFrame:
    m = tx.extract_metadata(table(spark, sf, "documents").select("doc_id", "text"))
    return m.select("doc_id", F.size("codes").alias("n_codes"), F.size("drugs").alias("n_drugs"), F.size("keywords").alias("n_keywords"), F.array_join("keywords", ",").alias("keywords"))


@query("SELECT DISTINCT sha256('hash|128|' || text) AS cache_key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def dc31_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without a cached vector, where those of even ids are cached."""
    d = table(spark, sf, "documents")
    texts = d.select("text")
    cache = d.filter("doc_id % 2 = 0").select(F.sha2(F.concat(F.lit("hash|128|"), "text"), 256).alias("cache_key")).distinct()
    return docprep.embed_missing(texts, cache, lambda ts: [[float(len(t))] * 128 for t in ts], "hash", 128).select("cache_key")


RISKS = {"self_harm": tx.SELF_HARM, "emergency": tx.EMERGENCY, "urgent": tx.URGENT}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{'|'.join(p)}', 'i') THEN '{k}'" for k, p in RISKS.items()) + " ELSE 'routine' END AS risk FROM documents")
def tx1_risk_level(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.risk_level(F.col("text")).alias("risk"))


@query("SELECT doc_id, (" + " + ".join(f"regexp_matches(text, '{p}', 'i')::INT" for p in tx.BOUNDARY) + ") AS n_hits FROM documents")
def tx2_pattern_hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.pattern_hits(F.col("text"), tx.BOUNDARY)).alias("n_hits"))


@query(f"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '{tx.INJECTION}', 'i') THEN '{tx.REMOVED_LINE}' ELSE x END), chr(10))) AS sha256 FROM documents""")
def tx3_neutralise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.neutralise(F.col("text")), 256).alias("sha256"))


REDACT = r"regexp_replace(regexp_replace(regexp_replace({0}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[REDACTED]', 'g'), '\b[0-9]{{17}}[0-9Xx]\b', '[REDACTED]', 'g'), '\b1[3-9][0-9]{{9}}\b', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha256({REDACT.format('text')}) AS sha256 FROM documents")
def tx4_redact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.redact(F.col("text")), 256).alias("sha256"))


@query("SELECT doc_id, substr(text, 1, 240) AS preview, sha256(text) AS sha256 FROM documents")
def tx5_minimise_trace(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"), F.sha2("text", 256).alias("sha256"))


NORMAL = rf"trim(regexp_replace(regexp_replace(trim(lower({REDACT.format('text')})), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({NORMAL}) AS sha256 FROM documents")
def tx6_normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalize_query(F.col("text")), 256).alias("sha256"))


@query(r"SELECT item_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'), ' ?!.,;:？！。，；：') AS question FROM benchmark")
def tx7_normalize_question(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", tx.normalize_question(F.col("text")).alias("question"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/\s?#]+', 'i') THEN url END AS url FROM pages")
def tx20_public_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.public_url(F.col("url")).alias("url"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{4e00}-\x{9fff}]{1,8}')))::INT AS n_tokens FROM documents""")
def mm6_fact_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.fact_tokens(F.col("text"))).alias("n_tokens"))


@query(f"""WITH k AS (SELECT doc_id, unhex('{bytes(c ^ 0x36 for c in b"key".ljust(64, bytes(1))).hex()}') AS i, unhex('{bytes(c ^ 0x5C for c in b"key".ljust(64, bytes(1))).hex()}') AS o, encode(concat_ws(':', source, doc_id, n_chars)) AS m FROM documents)
  SELECT doc_id, 'ev_' || substr(sha256(o || unhex(sha256(i || m))), 1, 16) AS evidence_id FROM k""")
def rt15_evidence_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.evidence_id("key", F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("evidence_id"))


VECTORS = f"""t AS (SELECT item_id, {NORMAL} AS t FROM benchmark),
  u AS (SELECT item_id, unnest(list_concat(list_filter(string_split(t, ' '), lambda x: x <> ''), [substr(t, i::INT, 2) FOR i IN range(1, length(t))])) AS unit FROM t),
  b AS (SELECT item_id, (('0x' || substr(sha256(unit), 1, 8))::BIGINT % 128)::INT AS bucket, count(*)::DOUBLE AS n FROM u GROUP BY 1, 2),
  v AS (SELECT item_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS weight FROM b)"""


@query(f"WITH {VECTORS} SELECT item_id, bucket, round(weight, 6) AS weight FROM v")
def ev9_hashed_vector(spark: SparkSession, sf: str) -> DataFrame:
    return tx.hashed_vector(table(spark, sf, "benchmark"), "item_id", "text").select("item_id", "bucket", F.round("weight", 6).alias("weight"))


#: The benchmark's texts as requests, a third again with a mark behind, a third with one word more; ties in time.
REQUESTS = """rq AS (SELECT item_id * 2 + n AS item_id, item_id * 2 + n AS id, (item_id * 7 + n * 3) % 50 AS tm, CASE WHEN n = 0 THEN text WHEN item_id % 3 = 0 THEN text || ' !' ELSE text || ' more' END AS text,
    CASE item_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'success' END AS status, item_id * 100 AS total_tokens, CASE WHEN item_id % 5 = 0 THEN item_id / 50.0 END AS safety_score
  FROM benchmark, (SELECT unnest([0, 1]) AS n) WHERE n = 0 OR item_id % 3 < 2)"""


@query(f"""WITH RECURSIVE {REQUESTS}, n AS (SELECT *, {NORMAL} AS normal FROM rq), o AS (SELECT *, sha256(normal) AS hash, first_value(id) OVER (PARTITION BY normal ORDER BY tm, id) AS owner FROM n),
  {VECTORS.replace("FROM benchmark", "FROM o WHERE id = owner")},
  s AS (SELECT x.item_id AS a, y.item_id AS b, round(sum(x.weight * y.weight), 6) AS similarity, max(q.tm) AS tm FROM v x JOIN v y USING (bucket) JOIN o p ON p.id = x.item_id JOIN o q ON q.id = y.item_id WHERE q.tm < p.tm OR q.tm = p.tm AND q.id < p.id GROUP BY 1, 2),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, tm, b) AS k FROM s) WHERE k = 1),
  up AS (SELECT id, id AS root FROM o WHERE id = owner AND id NOT IN (SELECT a FROM l WHERE similarity >= 0.72) UNION ALL SELECT l.a, up.root FROM l JOIN up ON l.b = up.id WHERE similarity >= 0.72),
  j AS (SELECT o.*, l.b, coalesce(l.similarity, 0) AS similarity, CASE WHEN o.id <> o.owner THEN 'existing' WHEN l.similarity >= 0.92 THEN 'duplicate' WHEN l.similarity >= 0.72 THEN 'clustered' ELSE 'novel' END AS outcome FROM o LEFT JOIN l ON l.a = o.id)
  SELECT j.id, outcome, CASE WHEN outcome = 'existing' THEN j.owner ELSE b END AS match, CASE WHEN outcome = 'existing' THEN 1 ELSE similarity END AS similarity, substr(r.hash, 1, 16) AS cluster_key,
    CASE WHEN outcome IN ('clustered', 'novel') THEN round(round(0.30 * CASE WHEN j.status = 'failed' THEN 1 ELSE 0.4 END + 0.15 * 0.5 + 0.15 * (1 - similarity) + 0.10 * 0.5 + 0.15 * least(1, coalesce(j.safety_score, 0.3)) + 0.15 * least(1, j.total_tokens / 6000.0), 9)::DECIMAL(12, 9), 4)::DOUBLE END AS score
  FROM j JOIN up ON up.id = j.owner JOIN o r ON r.id = up.root""")
def ev10_mine_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("item_id"), F.col("n")
    rows = table(spark, sf, "benchmark").select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).filter((n == 0) | (k % 3 < 2))
    requests = rows.select(
        (k * 2 + n).alias("id"), ((k * 7 + n * 3) % 50).alias("created_at"), F.when(n == 0, F.col("text")).when(k % 3 == 0, F.concat("text", F.lit(" !"))).otherwise(F.concat("text", F.lit(" more"))).alias("query"),
        F.when(k % 4 == 0, "failed").when(k % 4 == 1, "success").alias("status"), (k * 100).alias("total_tokens"), F.when(k % 5 == 0, k / 50.0).alias("safety_score"),
    )
    return mining.mine_candidates(requests).drop("breakdown")
