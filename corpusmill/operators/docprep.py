"""Document preparation: blocks, tables, sections, cleaning with an audit, chunks.

Tables: blocks (doc_id, page, block_order, kind, text, method, confidence), tables (doc_id, table_id, page_start,
page_end, headers, rows, footnotes, confidence). Chunking works on one document at a time, as its rules depend on order.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as tx
from corpusmill.operators.retrieval import keep_first
from corpusmill.operators.tables import flat_map, written


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines as blocks, blank ones dropped, `#` lines as headings, in order."""
    lines = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r")).alias("line_no", "text"))
    lines = lines.filter(F.trim("text") != "")
    order = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1
    return lines.select(key, F.lit(1).alias("page"), order.alias("block_order"), F.when(F.col("text").startswith("#"), "heading").otherwise("text").alias("kind"), F.trim(F.regexp_replace("text", r"^#+\s*", "")).alias("text"))


def edge_key(text: str = "text"):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s{2,}|[^\S ]", " "), r"\d+", "#"))


def repeated_edges(blocks: DataFrame, share: float = 0.4) -> DataFrame:
    """(doc_id, edge): texts, digits aside, on at least max(2, floor(share pages + 0.999)) pages of their document; of headers and footers, where blocks have a kind."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    edge = blocks.filter(F.col("kind").isin("header", "footer") & (F.trim("text") != "")) if "kind" in blocks.columns else blocks
    seen = edge.select("doc_id", "page", edge_key().alias("edge")).distinct().groupBy("doc_id", "edge").agg(F.count("*").alias("on"))
    return seen.join(pages, "doc_id").filter(F.col("on") >= F.greatest(F.lit(2), F.floor(share * F.col("pages") + 0.999))).select("doc_id", "edge")


def action(name, before, after, rule: str, confidence: float):
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("action"), before.alias("before"), after.alias("after"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"))


def audit(blocks: DataFrame, actions: str = "actions") -> DataFrame:
    """(doc_id, page, block_order, action, before, after, rule, confidence): one row for each thing done to a block."""
    return blocks.select("doc_id", "page", "block_order", F.explode(actions).alias("a")).select("doc_id", "page", "block_order", "a.*")


def mark_removed(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks with `removed`: header, footer, page_number, watermark, or null."""
    e = edges.select(F.col("doc_id").alias("_d"), F.col("edge").alias("_e"))
    # Others than headers and footers take keys that spread them; they have no edges.
    key = F.when(F.col("kind").isin("header", "footer"), edge_key()).otherwise(F.xxhash64("page", "block_order").cast("string"))
    j = blocks.withColumn("_key", key).join(e, (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_e")), "left")
    bare = F.trim(F.coalesce("text", F.lit("")))
    removed = (
        F.when(F.col("kind").isin("header", "footer") & F.col("_e").isNotNull(), F.col("kind"))
        .when((F.col("kind") == "page_number") | bare.rlike(tx.PAGE_NUMBER), "page_number").when(bare.rlike(tx.WATERMARK), "watermark")
    )
    return j.withColumn("removed", removed).drop("_key", "_d", "_e")


def removal(text: str = "text"):
    return action(F.concat(F.lit("remove_"), "removed"), F.col(text), F.lit(""), "repeated_position_or_page_pattern", 0.95)


def remove_blocks(blocks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks without repeated headers and footers, page numbers and watermarks; and an audit row for each removed."""
    marked = mark_removed(blocks, edges)
    return marked.filter("removed is null").drop("removed"), audit(marked.filter("removed is not null").withColumn("actions", F.array(removal())))


def fingerprint(text: str = "text"):
    """Letters, digits and low lines in lower case; null where there are none, as such blocks are no copies of each other."""
    return F.nullif(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "")), F.lit(""))


def dedup_blocks(blocks: DataFrame) -> DataFrame:
    """The first block of each fingerprint on a page."""
    same = Window.partitionBy("doc_id", "page", "_print", F.when(F.col("_print").isNull(), F.col("block_order"))).orderBy("block_order")
    return blocks.withColumn("_print", fingerprint()).withColumn("_n", F.row_number().over(same)).filter(F.col("_print").isNull() | (F.col("_n") == 1)).drop("_print", "_n")


def table_islands(tables: DataFrame) -> DataFrame:
    """Tables with `island`: those on consecutive pages with the same headers, whose rows fit them, share one. Also the headers as they are compared."""
    norm = F.transform("headers", lambda h: F.lower(F.regexp_replace(h, r"\s+", "")))
    fits = F.forall("rows", lambda r: F.size(r) == F.size("headers"))
    w = Window.partitionBy("doc_id").orderBy("page_start", "table_id")
    t = tables.withColumn("_h", norm).withColumn("_fits", fits & F.exists("headers", lambda h: F.trim(h) != ""))
    joins = (F.lag("_h").over(w) == F.col("_h")) & (F.lag("page_end").over(w) + 1 == F.col("page_start")) & F.col("_fits") & F.lag("_fits").over(w)
    return t.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new", "_fits")


def merge_tables(tables: DataFrame) -> DataFrame:
    """Tables on consecutive pages with the same headers become one; a repeated header row goes. Gaps and islands over pages."""
    t = table_islands(tables)
    t = t.withColumn("rows", F.filter("rows", lambda r: ~(F.transform(r, lambda h: F.lower(F.regexp_replace(h, r"\s+", ""))) == F.col("_h"))))
    parts = F.sort_array(F.collect_list(F.struct("page_start", "table_id", "rows", "footnotes")))
    agg = t.groupBy("doc_id", "island").agg(F.min_by("table_id", "page_start").alias("table_id"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min_by("headers", "page_start").alias("headers"), parts.alias("_p"), F.min("confidence").alias("confidence"), F.count("*").alias("merged"))
    return agg.select("doc_id", "table_id", "page_start", "page_end", "headers", F.flatten(F.transform("_p", lambda x: x["rows"])).alias("rows"), F.array_distinct(F.flatten(F.transform("_p", lambda x: x["footnotes"]))).alias("footnotes"), "confidence", "merged")


def table_markdown(tables: DataFrame) -> DataFrame:
    """A Markdown column: rows padded to the width, unnamed columns numbered."""
    width = F.greatest(F.size("headers"), F.array_max(F.transform("rows", lambda r: F.size(r))))
    names = F.transform(F.sequence(F.lit(1), F.col("_w")), lambda i: F.coalesce(F.nullif(F.trim(F.get("headers", i - 1)), F.lit("")), F.concat(F.lit("Column "), i.cast("string"))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform("rows", lambda r: line(F.transform(F.sequence(F.lit(1), F.col("_w")), lambda i: F.coalesce(F.get(r, i - 1), F.lit("")))))
    rule = line(F.transform(F.sequence(F.lit(1), F.col("_w")), lambda i: F.lit("---")))
    return tables.withColumn("_w", width).withColumn("markdown", F.array_join(F.concat(F.array(line(names), rule), body), "\n")).drop("_w")


def structural_sections(blocks: DataFrame, between: str = "\n") -> DataFrame:
    """(doc_id, section, page, block_type, heading_path, text, blocks): runs of blocks of one page and type between headings.

    blocks: doc_id, page, block_order, kind, text. Blocks without text give none. A heading's number (1.2.3) says its level.
    """
    mark = F.regexp_replace("text", r"^#{1,6}\s+", "")
    head = (F.col("kind") == "heading") | F.coalesce(F.col("text").rlike(r"^#{1,6}\s+"), F.lit(False))
    kind = F.when(F.col("kind").isin("list", "table", "caption", "figure", "footnote", "reference"), F.col("kind")).otherwise("paragraph")
    order = Window.partitionBy("doc_id").orderBy("page", "block_order")
    b = blocks.withColumn("_head", F.coalesce(head, F.lit(False))).withColumn("_heads", F.sum(F.col("_head").cast("int")).over(order)).withColumn("block_type", kind)
    level = F.size(F.split(F.regexp_extract(F.trim(mark), r"^(\d+(?:\.\d+)*)", 1), r"\."))
    titles = b.filter(F.col("_head") & (F.trim(mark) != "")).select("doc_id", "_heads", level.alias("level"), F.trim(mark).alias("title"))
    titles = titles.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("_heads", "level", "title"))).alias("_titles"))  # a document's headings
    body = b.filter(~F.col("_head") & (F.coalesce("text", F.lit("")) != ""))
    same = (F.lag("page").over(order) == F.col("page")) & (F.lag("_heads").over(order) == F.col("_heads")) & (F.lag("block_type").over(order) == F.col("block_type"))
    body = body.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("section", F.sum("_new").over(order) - 1)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block_order", "text"))), lambda x: x["text"])
    sections = body.groupBy("doc_id", "section", "page", "block_type", "_heads").agg(F.array_join(texts, between).alias("text"), F.count("*").alias("blocks")).filter(F.trim("text") != "")
    none = F.array().cast("array<string>")
    path = F.aggregate(F.filter(F.coalesce("_titles", F.array().cast("array<struct<_heads:bigint,level:int,title:string>>")), lambda t: t["_heads"] <= F.col("_heads")), none, lambda p, t: F.array_append(F.slice(p, 1, t["level"] - 1), t["title"]))
    return sections.join(titles, "doc_id", "left").select("doc_id", "section", "page", "block_type", path.alias("heading_path"), "text", "blocks")


def section_ends(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """end_page: the page before the next section, not before the start; the last one ends with the document. pages: (doc_id, page_count)."""
    w = Window.partitionBy("doc_id").orderBy("start_page", "section_id")
    return sections.join(pages, "doc_id").withColumn("end_page", F.greatest(F.col("start_page"), F.coalesce(F.lead("start_page").over(w) - 1, F.col("page_count")))).drop("page_count")


def page_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, page, section_id): the last section whose pages hold the page."""
    s = sections.select(F.col("doc_id").alias("_d"), "section_id", "start_page", "end_page")
    j = pages.join(s, (F.col("doc_id") == F.col("_d")) & F.col("page").between(F.col("start_page"), F.col("end_page")))
    return j.groupBy("doc_id", "page").agg(F.max_by("section_id", F.struct("start_page", "section_id")).alias("section_id"))


def recover_sections(blocks: DataFrame) -> DataFrame:
    """Headings as sections with a stable id and a level from their number."""
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)", 1)
    level = F.when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1).otherwise(1)
    h = blocks.filter("kind = 'heading'")
    return h.select("doc_id", F.sha1(F.concat_ws("|", "doc_id", "page", "block_order", "text")).alias("section_id"), F.col("text").alias("title"), level.alias("level"), F.col("page").alias("start_page"), "block_order")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with x0, y0, x1 and page_width: two columns if each half has two narrow blocks; wide ones first, then left, right."""
    narrow = (F.col("x1") - F.col("x0")) < 0.72 * F.col("page_width")
    left = narrow & ((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2)
    page = Window.partitionBy("doc_id", "page")
    two = (F.sum(left.cast("int")).over(page) >= 2) & (F.sum((narrow & ~left).cast("int")).over(page) >= 2)
    b = blocks.withColumn("_zone", F.when(two & narrow, F.when(left, 1).otherwise(2)).otherwise(0))
    return b.withColumn("block_order", F.row_number().over(page.orderBy("_zone", "y0", "x0", "block_id")) - 1).drop("_zone")


def page_quality(pages: DataFrame) -> DataFrame:
    """Text pages 0.75 clean + 0.25 valid, recognised ones 0.62 confidence + 0.23 valid + 0.15 clean; good, medium or review."""
    score = F.when(F.col("method") == "ocr", 0.62 * F.col("confidence") + 0.23 * F.col("valid") + 0.15 * F.col("clean")).otherwise(0.75 * F.col("clean") + 0.25 * F.col("valid"))
    return pages.withColumn("quality", F.round(score, 6)).withColumn("status", F.when(score >= 0.85, "good").when(score >= 0.65, "medium").otherwise("review"))


def classify_pages(blocks: DataFrame) -> DataFrame:
    """Page type from its blocks' totals: empty, scanned, garbled, table, mixed, text."""
    agg = blocks.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "table").alias("tables"), F.avg(tx.garbled_ratio(F.col("text"))).alias("garbled"))
    return agg.withColumn("page_type", F.when((F.col("chars") < 20) & (F.col("images") > 0), "scanned").when(F.col("chars") == 0, "empty").when(F.col("garbled") > 0.15, "garbled").when(F.col("tables") > 0, "table").when(F.col("images") > 0, "mixed").otherwise("text"))


def quality_report(blocks: DataFrame) -> DataFrame:
    """One row per document: pages, blocks, characters, mean confidence, mean garbled ratio, share of repeated blocks."""
    return blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(tx.garbled_ratio(F.col("text"))), 6).alias("garbled"), F.round(1 - F.count_distinct("text") / F.count("*"), 6).alias("duplicate_ratio"))


#: Kinds of blocks whose lines are not merged.
FIXED_LINES = ["title", "heading", "list", "table", "caption", "footnote", "reference"]


def clean_documents(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks left, and the audit of all that was done to them.

    Repeated headers and footers, page numbers and watermarks go by their given texts. The others' texts become
    symbol-safe NFKC; hyphens at line ends, units (of recognised blocks and those below a confidence of 0.9) and visual
    lines are repaired; plain blocks that open so become headings or list items. Then empty blocks go, figures aside, and
    what a page has already said. method and confidence may be missing.
    """
    b = mark_removed(blocks.withColumn("_given", F.coalesce("text", F.lit(""))), repeated_edges(blocks))
    t0 = F.regexp_replace(F.regexp_replace(tx.nfkc_symbol_safe(F.col("_given")), r"\r\n?", "\n"), tx.BLANKS, " ")
    unsure = F.coalesce(F.col("confidence") < 0.9, F.lit(False)) if "confidence" in b.columns else F.lit(False)
    unsure = unsure | F.coalesce(F.col("method") == "ocr", F.lit(False)) if "method" in b.columns else unsure
    b = b.withColumn("_t0", t0).withColumn("_t1", tx.repair_hyphens(F.col("_t0"))).withColumn("_t2", F.when(unsure, tx.repair_ocr_units(F.col("_t1"))).otherwise(F.col("_t1")))
    b = b.withColumn("_t3", F.when(F.col("kind").isin(FIXED_LINES), F.col("_t2")).otherwise(tx.merge_lines(F.col("_t2"))))
    b = b.withColumn("text", F.regexp_replace(F.regexp_replace("_t3", r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", ""))
    plain = F.col("kind") == "text"
    b = b.withColumn("kind", F.when(plain & F.col("text").rlike(tx.HEADING) & (F.length("text") <= 160), "heading").when(plain & F.col("text").rlike(tx.LIST_ITEM), "list").otherwise(F.col("kind")))
    gone = F.col("removed").isNotNull() | ((F.col("text") == "") & (F.col("kind") != "figure"))
    b = b.withColumn("_gone", gone).withColumn("_print", F.when(~gone, fingerprint()))
    same = Window.partitionBy("doc_id", "page", "_print", F.when(F.col("_print").isNull(), F.col("block_order"))).orderBy("block_order")
    b = b.withColumn("_copy", F.col("_print").isNotNull() & (F.row_number().over(same) > 1))
    lines = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""))
    done = [
        (F.col("_t1") != F.col("_t0"), action("repair_hyphenation", F.col("_given"), F.col("_t1"), "line_end_hyphen_lowercase_continuation", 0.92)),
        (F.col("_t2") != F.col("_t1"), action("repair_ocr_numeric_unit", F.col("_t1"), F.col("_t2"), "low_confidence_numeric_unit_context", 0.88)),
        (F.contains("_t2", F.lit("\n")) & (lines(F.col("_t3")) < lines(F.col("_t2"))), action("merge_visual_lines", F.col("_t2"), F.col("_t3"), "same_layout_block_without_sentence_boundary", 0.9)),
        (F.col("_copy"), action("remove_duplicate", F.col("_given"), F.lit(""), "same_page_normalized_hash", 0.98)),
    ]
    kept = F.array_compact(F.array(*[F.when(holds, a) for holds, a in done]))
    b = b.withColumn("actions", F.when(F.col("removed").isNotNull(), F.array(removal("_given"))).otherwise(kept))
    # Both results come from one table, as the rules are dear. Names of their own keep them apart from the blocks' columns.
    b = written(b.select(*blocks.columns, (F.col("_gone") | F.col("_copy")).alias("_left_out"), F.col("actions").alias("_actions")), "cleaned")
    return b.filter(~F.col("_left_out")).select(*blocks.columns), audit(b, "_actions")


TOKEN = re.compile(r"[㐀-鿿]|[A-Za-z0-9]+(?:[-'/][A-Za-z0-9]+)*|[^\sA-Za-z0-9㐀-鿿]")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))


def split_chars(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, piece, start, content): windows cut at the last sentence end; each next start lies behind the one before, so it ends."""

    def pieces(t: str):
        a, n = 0, len(t)
        while a < n:
            b = min(n, a + size)
            if b < n:
                cut = next((k for k in (t.rfind(m, a, b) for m in "。.\n！？") if k > a), -1)
                b = cut + 1 if cut >= 0 else b
            yield a, t[a:b]
            if b >= n:
                return
            a = max(a + 1, b - overlap)

    return flat_map(keyed(docs, key, text), lambda i, t: ((i, k, *p) for k, p in enumerate(pieces(t or ""))), "key long, piece int, start int, content string").withColumnRenamed("key", key)


SEPARATORS = ["\n|", "\n```", "\n# ", "\n## ", "\n- ", "\n\n", "\n", "。", ". ", "！", "？", "; ", "，", ", ", " "]


def split_recursive(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, separators: list[str] = SEPARATORS) -> DataFrame:
    """Pieces of at most `size` characters: split at the first separator that occurs, and on with the next where a part is too long."""

    def cut(t: str, seps: list[str]) -> list[str]:
        if len(t) <= size:
            return [t] if t.strip() else []
        sep = next((s for s in seps if s in t), None)
        if sep is None:
            return [t[a : a + size] for a in range(0, len(t), size)]
        parts, out, now = t.split(sep), [], ""
        parts = [parts[0], *[sep + p for p in parts[1:]]]
        for p in parts:
            if len(now) + len(p) <= size:
                now += p
                continue
            out += cut(now, seps[seps.index(sep) + 1 :]) if now else []
            now = p
        return out + (cut(now, seps[seps.index(sep) + 1 :]) if now else [])

    return flat_map(keyed(docs, key, text), lambda i, t: ((i, k, s) for k, s in enumerate(cut(t or "", separators))), "key long, piece int, content string").withColumnRenamed("key", key)


def embedding_key(model: str, size: int, text: str = "text"):
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(size)), F.col(text)), 256)


def embed_missing(texts: DataFrame, cache: DataFrame, embed_fn, model: str, size: int) -> DataFrame:
    """Vectors of texts that the cache (cache_key) lacks; embed_fn maps a list of texts to vectors, batch by batch. A wrong size is an error row."""
    keyed = texts.withColumn("cache_key", embedding_key(model, size)).select("cache_key", "text").dropDuplicates(["cache_key"])
    missing = keyed.join(cache.select("cache_key"), "cache_key", "left_anti")

    def job(batches):
        for b in batches:
            vectors = embed_fn(b["text"].tolist())
            ok = [len(v) == size for v in vectors]
            yield pd.DataFrame({"cache_key": b["cache_key"], "embedding": [v if o else None for v, o in zip(vectors, ok, strict=True)], "error": [None if o else f"size {len(v)}" for v, o in zip(vectors, ok, strict=True)]})

    return missing.mapInPandas(job, "cache_key string, embedding array<float>, error string")


def apply_quality_review(reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports after their reviews, and the decisions that their state does not allow. decisions: (doc_id, decision)."""
    j = reports.join(decisions, "doc_id", "left")
    allowed = F.col("review_status").isin("pending", "approved")
    state = F.when(F.col("decision").isNull() | ~allowed, F.col("review_status")).when(F.col("decision") == "approve", "approved").otherwise("rejected")
    done = j.withColumn("vector_status", F.when(F.col("decision").isNotNull() & allowed, F.when(F.col("decision") == "approve", "pending").otherwise("blocked")).otherwise(F.col("vector_status"))).withColumn("review_status", state).drop("decision")
    return done, j.filter(F.col("decision").isNotNull() & ~allowed).select("doc_id", "decision", "review_status")


def pack_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 320, header_lines: int = 0) -> DataFrame:
    """(key, piece, content): lines packed into pieces of at most `limit` units; the header lines stand first in each piece.

    A single line over the limit is a piece of its own.
    """

    def pieces(t: str):
        lines = t.split("\n")
        head, body = lines[:header_lines], lines[header_lines:]
        used = start = sum(len(TOKEN.findall(x)) for x in head)
        now: list[str] = []
        for x in body:
            n = len(TOKEN.findall(x))
            if now and used + n > limit:
                yield "\n".join(head + now)
                now, used = [], start
            now.append(x)
            used += n
        if now or head:
            yield "\n".join(head + now)

    return flat_map(keyed(docs, key, text), lambda i, t: ((i, k, s) for k, s in enumerate(pieces(t) if t else ())), "key long, piece int, content string").withColumnRenamed("key", key)


def split_semantic(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000) -> DataFrame:
    """(key, piece, content): Markdown sections, then paragraphs, then sentences, joined again up to `size` characters; nothing overlaps."""

    def cut(t: str) -> list[str]:
        out: list[str] = []
        for section in re.split(r"(?m)^(?=#{1,6}\s)", t):
            now = ""
            for paragraph in re.split(r"(?<=\n)\n+", section):
                parts = [paragraph] if len(paragraph) <= size else re.split(r"(?<=[.!?。！？])\s*", paragraph)
                for p in parts:
                    for q in [p[a : a + size] for a in range(0, len(p), size)]:
                        if now and len(now) + len(q) + 1 > size:
                            out.append(now)
                            now = ""
                        now = f"{now} {q}".strip() if now else q
            if now.strip():
                out.append(now)
        return out

    return flat_map(keyed(docs, key, text), lambda i, t: ((i, k, s) for k, s in enumerate(cut(t or ""))), "key long, piece int, content string").withColumnRenamed("key", key)
