"""Text rules as column expressions; the few that Spark has no function for are Arrow UDFs over whole columns."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. Patterns are Java's.
SELF_HARM = [r"suicid", r"self[- ]?harm", r"kill myself", r"自杀", r"自伤", r"不想活"]
EMERGENCY = [
    r"chest pain", r"胸痛", r"difficulty breathing", r"shortness of breath", r"呼吸困难", r"unconscious", r"意识不清", r"massive bleeding", r"大量出血", r"anaphylaxis",
    r"严重过敏", r"seizure", r"convulsion", r"抽搐", r"sudden.*severe headache", r"worst headache", r"突发.*剧烈头痛",
]
URGENT = [r"high fever", r"高烧", r"儿童高热", r"persistent vomiting", r"持续呕吐"]
BOUNDARY = [r"diagnos", r"prescri", r"stop (taking|your medication)", r"adjust (your )?dosage", r"诊断", r"处方", r"开药", r"停药", r"换药", r"调整剂量"]
INJECTION = r"(ignore (all |any )?(previous|prior) instructions|system prompt|developer message|reveal (the )?(secret|api key|prompt)|call (a )?tool|<\/?system>|忽略.{0,8}(指令|提示)|系统提示词|泄露.{0,8}(密钥|提示词))"
REMOVED_LINE = "[potential prompt-injection instruction removed]"
SYNONYMS = [("不良反应", "副作用"), ("不良事件", "副作用"), (" adverse effect ", " 副作用 "), (" side effect ", " 副作用 "), ("用药量", "剂量")]
STOPWORDS = ["this", "that", "with", "from", "have", "were", "which", "进行", "可以", "以及", "患者", "治疗", "研究", "结果", "相关", "使用", "对于", "一种", "表明", "临床"]
CJK = r"\x{3400}-\x{9fff}"
UNITS = rf"[{CJK}]|[A-Za-z0-9]+(?:[-'/][A-Za-z0-9]+)*|[^\sA-Za-z0-9{CJK}]"
DRUG_ENDING = r"(?i)(?:mab|nib|pril|sartan|statin|cillin|mycin|azole)"
HAN_DRUG = r"[\x{4e00}-\x{9fff}]{1,8}(?:单抗|西林|霉素|沙坦|普利|他汀|唑|胺|片|胶囊|注射液)"
DISEASE = r"[\x{4e00}-\x{9fff}]{1,10}(?:病|癌|瘤|炎|综合征|感染|衰竭|高血压)"
CODE = r"(?i)\b(?:ICD-?10[:： ]*)?[A-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?\b|\bNCT\d{8}\b|\bPMID[:： ]*\d{5,9}\b"


def token_units(text: Column) -> Column:
    """One CJK character, one word with inner marks, or one other character that is no space."""
    return F.regexp_extract_all(text, F.lit(UNITS), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.size(token_units(F.coalesce(text, F.lit(""))))


def full_width_to_half(text: Column) -> Column:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")


def _nfc_unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(re.sub("[​-‏⁠﻿]", "", unicodedata.normalize("NFC", t))))


def nfc_unescaped(text: Column) -> Column:
    """NFC, zero-width characters out, HTML entities read."""
    return F.pandas_udf(_nfc_unescaped, "string")(text)


#: Signs of measures that keep their form, compounds that keep their hyphen, and openings of list items, headings, page numbers and watermarks.
SYMBOLS = ["mg/mL", "μg", "mmHg", "SpO₂", "eGFR", "β", "≤", "≥", "±", "10⁹/L", "Na⁺", "K⁺"]
COMPOUNDS = ["dose-dependent", "double-blind", "case-control", "follow-up", "long-term", "short-term"]
LIST_ITEM = r"^(?:[-•●▪◦]|\d+[.)]|[一二三四五六七八九十]+[、.]|[（(][一二三四五六七八九十\d]+[）)])"
HEADING = r"^(?:第[一二三四五六七八九十百\d]+[章节]|\d+(?:\.\d+){0,3}[、.\s]|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\d]+[）)]|【(?:适应证|禁忌证|用法用量|注意事项|相互作用)】|摘要|关键词|参考文献|References)"
PAGE_NUMBER = r"(?i)^(?:-\s*)?\d+(?:\s*-)?$|^第\s*\d+\s*页$|^Page\s+\d+(?:\s+of\s+\d+)?$"
WATERMARK = r"(?i)^(?:CONFIDENTIAL|DRAFT|SAMPLE|COPY|机密|草稿|仅供内部使用)$"


SIGNS = re.compile("(" + "|".join(map(re.escape, SYMBOLS)) + ")")
UNSEEN = re.compile("[\xa0\u3000\x00\u2060\ufeff\u200b-\u200f]")
UNSEEN_TO = str.maketrans({"\xa0": " ", "\u3000": " ", "\x00": None, "\u2060": None, "\ufeff": None} | {c: None for c in range(0x200B, 0x2010)})


def nfkc_symbol_safe_text(t: str) -> str:
    if t.isascii() and "\x00" not in t:
        return t
    if unicodedata.is_normalized("NFKC", t):  # and so is each part
        return t.translate(UNSEEN_TO) if UNSEEN.search(t) else t
    parts = SIGNS.split(t)  # every second part is a sign
    return "".join(p if n % 2 else unicodedata.normalize("NFKC", p) for n, p in enumerate(parts)).translate(UNSEEN_TO)


def _nfkc_symbol_safe(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else nfkc_symbol_safe_text(t))


def nfkc_symbol_safe(text: Column) -> Column:
    """NFKC, except for signs of measures; zero-width characters and NULs out, hard and wide spaces to spaces."""
    return F.pandas_udf(_nfkc_symbol_safe, "string")(text)


def _casefold_nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def casefold_nfkc(text: Column) -> Column:
    return F.pandas_udf(_casefold_nfkc, "string")(text)


#: Blanks that are not one space already.
BLANKS = r"[ \t]{2,}|\t"


def fold_blanks(text: Column) -> Column:
    """Line ends unified, blanks and blank lines folded, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def drop_line_runs(text: Column, most: int = 3) -> Column:
    """Runs of at least `most` equal lines become one: each line is seen beside its neighbours, so time is linear in lines."""
    lines = F.split(text, "\n")
    none = F.lit(None).cast("string")
    places = range(1 - most, most)
    beside = [F.concat(F.array_repeat(none, -k), lines) if k < 0 else F.concat(F.slice(lines, k + 1, F.greatest(F.size(lines), F.lit(1))), F.array_repeat(none, k)) for k in places]

    def keeps(x: Column) -> Column:
        same = {k: F.coalesce(x[str(n)] == x[str(most - 1)], F.lit(False)) for n, k in enumerate(places)}
        run = F.lit(False)
        for first in range(1 - most, 1):  # the line lies in `most` equal ones that start there
            whole = F.lit(True)
            for k in range(first, first + most):
                whole = whole & same[k]
            run = run | whole
        return x[str(most - 1)].isNotNull() & ~(same[-1] & run)

    return F.array_join(F.transform(F.filter(F.arrays_zip(*beside), keeps), lambda x: x[str(most - 1)]), "\n")


def clean_text(df: DataFrame, col: str = "text", remove_urls: bool = False) -> DataFrame:
    """NFC, entities, widths, optional URLs, repeated lines, blanks: in this order."""
    t = full_width_to_half(nfc_unescaped(F.coalesce(F.col(col), F.lit(""))))
    t = F.regexp_replace(t, r"https?://\S+", "") if remove_urls else t
    df = df.withColumn("_clean", t)
    # Only texts with a run of equal lines take the fold.
    df = df.withColumn("_clean", F.when(F.col("_clean").rlike(r"(?m)^(.*)\n\1\n\1$"), drop_line_runs(F.col("_clean"))).otherwise(F.col("_clean")))
    return df.withColumn("clean", fold_blanks(F.col("_clean"))).drop("_clean")


def chunk_is_useful(text: Column, least: int = 15, most: int = 2000) -> Column:
    n = F.length(text)
    return n.between(least, most) & ~text.rlike(r"^[\d\p{Punct}\s]*$") & ~((F.size(F.array_distinct(F.split(text, ""))) <= 2) & (n < 30))


def garbled_ratio(text: Column) -> Column:
    """Replacement and control characters among all that are no spaces, at most 1."""
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(visible == 0, 0.0).otherwise(F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]")) / visible))


#: Not inside a word of any script, on this side.
OPENS, CLOSES = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def repair_ocr_units(text: Column) -> Column:
    """O and l read for 0 and 1 before a unit, and a parted microgram."""
    unit = rf"\s*(?:mg|g|mL|μg){CLOSES}"
    t = F.regexp_replace(text, rf"(?<![A-Za-z0-9])O(?=\.\d+{unit})", "0")
    return F.regexp_replace(F.regexp_replace(t, rf"(?<![A-Za-z0-9])l(?=0{unit})", "1"), rf"(?i){OPENS}u\s+g{CLOSES}", "μg")


def repair_hyphens(text: Column) -> Column:
    """A word broken at a line end is joined where it goes on in lower case; the listed compounds keep their hyphen."""
    end = r"-\s*\n\s*"
    halves = [c.split("-") for c in COMPOUNDS]
    kept = "|".join(rf"(?i:{a})(?={end}{b[0]}(?i:{b[1:]}){CLOSES})" for a, b in halves)
    t = F.regexp_replace(text, rf"{OPENS}({kept}){end}", "$1-")
    t = F.regexp_replace(t, rf"{OPENS}([A-Za-z]{{2,}}){end}([a-z][A-Za-z]*){CLOSES}", "$1$2")
    return F.when(F.contains(text, F.lit("\n")), t).otherwise(text)


def merge_lines(text: Column) -> Column:
    """Visual lines, trimmed and without blank ones, joined unless the one before ends a sentence or the next opens an item or a heading; no blank between CJK."""
    ends, fold = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", lambda x: F.regexp_replace(F.regexp_replace(x, BLANKS, " "), r"(?U)^\s+|\s+$", "")
    folded = F.transform(F.split(text, ends), fold)
    lines = F.filter(folded, lambda x: x != "")
    pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), lines), lines)  # each line beside the one before

    def joined(x: Column) -> Column:
        before, line = x["0"], x["1"]
        apart = before.rlike(r"[。！？!?；;：:]$") | line.rlike(LIST_ITEM) | line.rlike(HEADING)
        close = before.rlike(r"[\x{4e00}-\x{9fff}]$") & line.rlike(r"^[\x{4e00}-\x{9fff}]")
        return F.concat(F.when(before.isNull(), "").when(apart, "\n").when(close, "").otherwise(" "), line)

    return F.when(text.rlike(ends), F.array_join(F.transform(pairs, joined), "")).otherwise(fold(text))


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike("(?i)" + p), F.lit(p)) for p in patterns]))


def risk_level(text: Column) -> Column:
    hit = lambda ps: F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(ps))
    return F.when(hit(SELF_HARM), "self_harm").when(hit(EMERGENCY), "emergency").when(hit(URGENT), "urgent").otherwise("routine")


def neutralise(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike("(?i)" + INJECTION), REMOVED_LINE).otherwise(x)), "\n")


def redact(text: Column) -> Column:
    """Identity numbers, phones and mail addresses out of a trace's text."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED]")
    t = F.regexp_replace(t, r"\b[0-9]{17}[0-9Xx]\b", "[REDACTED]")
    return F.regexp_replace(t, r"\b1[3-9][0-9]{9}\b", "[REDACTED]")


def preview(text: Column, most: int = 240) -> Column:
    return F.substring(text, 1, most)


def normalize_query(text: Column) -> Column:
    t = F.trim(F.lower(redact(text)))
    for a, b in SYNONYMS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "), r"\s+", " "))


def normalize_question(text: Column) -> Column:
    return F.btrim(F.regexp_replace(casefold_nfkc(text), r"\s+", " "), F.lit(" ?!.,;:？！。，；："))


def hashed_units(text: Column) -> Column:
    """Words and character pairs of a normalized text."""
    n = F.length(text)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter(F.split(text, r"\s+"), lambda w: w != ""), pairs)


def hash_bucket(unit: Column, size: int = 128) -> Column:
    return (F.conv(F.substring(F.sha2(unit, 256), 1, 8), 16, 10).cast("long") % size).cast("int")


def hashed_vector(df: DataFrame, key: str, col: str, size: int = 128) -> DataFrame:
    """(key, bucket, weight) of unit length: sparse rows, so that joins on buckets stay joins."""
    units = df.select(key, F.explode(hashed_units(normalize_query(F.col(col)))).alias("unit"))
    counts = units.groupBy(key, hash_bucket(F.col("unit"), size).alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    norm = counts.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, F.col(key) == F.col("_k")).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def distinct_ignoring_case(values: Column, most: int) -> Column:
    """First spelling of each value, without marks at its ends, in order, at most so many."""
    bare = F.filter(F.transform(values, lambda v: F.btrim(v, F.lit(" ,.;:：()[]{}"))), lambda v: v != "")
    none = F.array().cast("array<string>")
    grown = lambda done, v: F.struct(F.array_append(done["low"], v["low"]).alias("low"), F.array_append(done["out"], v["v"]).alias("out"))
    add = lambda done, v: F.when((F.size(done["out"]) >= most) | F.array_contains(done["low"], v["low"]), done).otherwise(grown(done, v))
    pairs = F.transform(F.array_distinct(bare), lambda v: F.struct(v.alias("v"), F.lower(v).alias("low")))
    return F.aggregate(pairs, F.struct(none.alias("low"), none.alias("out")), add, lambda done: done["out"])


def extract_metadata(df: DataFrame, col: str = "text") -> DataFrame:
    """Codes, drug names, disease names and keywords of each row."""
    t = F.coalesce(F.col(col), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z0-9-]{2,}|[\x{4e00}-\x{9fff}]{2,8}"), F.lit(0))
    drugs = F.concat(  # few texts have such a word at all
        F.when(t.rlike(DRUG_ENDING + r"(?![A-Za-z0-9-])"), F.filter(F.col("_words"), lambda w: w.rlike(DRUG_ENDING + "$"))).otherwise(F.array().cast("array<string>")),
        F.regexp_extract_all(t, F.lit(HAN_DRUG), F.lit(0)),
    )
    diseases = F.regexp_extract_all(t, F.lit(DISEASE), F.lit(0))
    keywords = F.filter(F.col("_words"), lambda w: ~F.lower(w).isin(STOPWORDS))
    df = df.withColumn("_words", words)
    return df.select(
        *[c for c in df.columns if c != "_words"], distinct_ignoring_case(F.regexp_extract_all(t, F.lit(CODE), F.lit(0)), 20).alias("codes"), distinct_ignoring_case(drugs, 20).alias("drugs"),
        distinct_ignoring_case(diseases, 20).alias("diseases"), distinct_ignoring_case(F.slice(F.array_distinct(keywords), 1, 80), 40).alias("keywords"),
    )


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC from two nested digests over the padded key."""
    raw = key.encode().ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(c ^ b for c in raw).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def evidence_id(key: str, kb: Column, doc: Column, chunk: Column) -> Column:
    return F.concat(F.lit("ev_"), F.substring(hmac_sha256(key, F.concat_ws(":", kb, doc, chunk)), 1, 16))


def public_url(url: Column) -> Column:
    """The address if it is http or https with a host, else null."""
    return F.when(url.rlike(r"(?i)^https?://[^/\s?#]+"), url)


def target_url(url: Column) -> Column:
    """Where a redirect with a `uddg` argument leads, else the address itself."""
    argument = F.regexp_extract(url, r"[?&]uddg=([^&#]+)", 1)
    return public_url(F.when(argument != "", F.try_url_decode(argument)).otherwise(url))


#: How far a kind of source counts; others count 5.
AUTHORITY = {"clinical_guideline": 10, "drug_label": 9, "fda": 9, "hospital_internal": 8, "pubmed": 8, "msd_manual": 7, "local_knowledge_base": 7}


def authority(source: Column) -> Column:
    """A source without a kind is a local one."""
    known = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(F.nullif(source, F.lit("")), F.lit("local_knowledge_base"))), F.lit(5))


def fact_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]{1,8}"), F.lit(0)))


def content_units(text: Column) -> Column:
    """Distinct Latin words and pairs of CJK characters."""
    t = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(t, F.lit(rf"[{CJK}]{{2,}}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"[a-z0-9]+"), F.lit(0)), pairs))


def cohesion(left: Column, right: Column) -> Column:
    """Jaccard similarity of two texts' units, 0 where both have none."""
    a, b = content_units(left), content_units(right)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
