"""Quality rules with host-level verdicts, in built-in column functions only.

A document has fixed rules (`base_failed`) and softer ones (`soft_failed`). Failures are counted by host (here the
`source` column), each host's rate is shrunk by a beta prior fitted to all hosts by moments, and a document of a host
with a bad verdict has to pass the softer rules as well. Clean documents stay, whatever their host.

Defined cases: a null or empty text has no words and fails; null hosts form one host; rows repeated with one id, or
without one, are judged one by one; texts of any length are read whole; an empty table gives an empty result; other
columns of the input are kept out of the way by taking only the id, host and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import written

#: Java forms of the two classes of characters; fixed values.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def _repeated(hashes: Column) -> tuple[Column, Column, Column]:
    """Words that lie in a window of five words found at least twice: windows are sorted with their places, neighbours compared."""
    windows = F.transform(F.slice(hashes, 1, F.size(hashes) - 4), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2), F.get(hashes, i + 3), F.get(hashes, i + 4)))
    placed = F.array_sort(F.transform(F.col("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    m = F.size("_placed")
    same = lambda i, j: F.coalesce(F.get("_placed", i)["h"] == F.get("_placed", j)["h"], F.lit(False))
    hits = F.filter(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.when(same(i, i - 1) | same(i, i + 1), F.get("_placed", i)["i"])), lambda x: x.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(p, p + 4)))))
    return windows, placed, covered


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouted."""
    t = F.coalesce(F.col(text), F.lit(""))
    windows, placed, covered = _repeated(F.col("_h"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.regexp_replace(x, BLANKS, "") != "")
    distinct = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = docs.select(F.col(key), F.col(host).cast("string").alias("_host"), t.alias("_t")).withColumn("_w", _words(F.col("_t"))).withColumn("_lines", lines)
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_windows", F.when(F.size("_w") >= 6, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_placed", F.when(distinct, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    return df.select(
        key,
        "_host",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_placed") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def host_verdicts(stats: DataFrame, host: str = "_host", failed: str = "failed", margin: float = 2.0, least_rate: float = 0.05) -> DataFrame:
    """(host, n, failures, shrunk_rate, bad): a beta prior from the hosts' moments, weighted by their documents.

    A host is bad if its shrunk rate is over `margin` times the mean rate of all other hosts' documents, so a hot host does
    not hide itself, and at least `least_rate`. With no spread between hosts beyond chance the prior has great weight and
    no host is bad, nor is one that stands alone. The prior's two numbers come from one aggregate over hosts.
    """
    by = written(stats.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures")), "hosts")
    rate = F.col("failures") / F.col("n")
    prior = by.agg(F.sum("n").alias("_n"), F.sum("failures").alias("_f"), F.sum(F.col("failures") * rate).alias("_fr"), F.count("*").alias("_hosts"))
    mean = F.col("_f") / F.col("_n")
    spread = F.greatest(F.col("_fr") / F.col("_n") - mean * mean, F.lit(0.0))  # between hosts, by documents
    chance = mean * (1 - mean) * F.col("_hosts") / F.col("_n")  # what binomial noise alone gives
    between = F.greatest(spread - chance, mean * (1 - mean) * 1e-4)
    weight = F.coalesce(F.greatest(F.try_divide(mean * (1 - mean), between) - 1, F.lit(1.0)), F.lit(1.0))
    mean, weight, total, fails = prior.select(mean, weight, "_n", "_f").first()
    shrunk = (F.col("failures") + F.lit(mean) * F.lit(weight)) / (F.col("n") + F.lit(weight))
    others = F.try_divide(F.lit(fails) - F.col("failures"), F.lit(total) - F.col("n"))
    bad = F.coalesce((shrunk > margin * others) & (shrunk >= least_rate), F.lit(False))
    return by.select(host, "n", "failures", shrunk.alias("shrunk_rate"), bad.alias("bad"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", margin: float = 2.0) -> DataFrame:
    """Statistics, base_failed, soft_failed, the host's shrunk rate and verdict, and kept, one row per document row."""
    stats = rule_statistics(docs, key, text, host)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    soft = base | (F.col("n_symbols") > 0.2 * F.col("n_words")) | (F.col("n_dup_lines") > 0.3 * F.col("n_lines")) | (F.col("word_chars") > 12 * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", base).withColumn("soft_failed", soft), "quality-rules")
    verdicts = host_verdicts(stats.withColumn("failed", F.col("soft_failed")), margin=margin).withColumnRenamed("_host", "_verdict_host")
    joined = stats.join(verdicts, F.col("_host").eqNullSafe(F.col("_verdict_host")), "left")
    bad = F.coalesce("bad", F.lit(False))
    return joined.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~(bad & F.col("soft_failed"))).alias("kept"),
        F.col("_host").alias("host"), F.round("shrunk_rate", 6).alias("host_rate"), bad.alias("host_bad"), "soft_failed",
    )
