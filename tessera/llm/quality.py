"""Document quality rules with host-level verdicts, on DataFrame functions alone.

Base rules look at one text; a document that fails them is out.  Failures are then
counted by host, each host's failure rate is shrunk by a beta prior fitted to all
hosts, and hosts whose shrunk rate is above ``max_rate`` lose all their documents.

Null text: no words, so the base rules fail.  Null host: its documents are judged by
the base rules only.  Repeated rows are judged each for itself.  An empty table gives
an empty result.  Only the key, text and host columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_JAVA, WORD_JAVA, durable

WINDOW = 8


def _covered(words: str, windows: str) -> list[tuple[str, Column]]:
    """Steps that end in ``n_repeat_words``: words under windows found twice or more.

    Texts without a repeated window, nearly all, stop at the first step.
    """
    w, sorted_ = F.col(windows), F.col("_sorted")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    is_twin = lambda x, i: F.coalesce(F.get(sorted_, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_, i + 1)["h"] == x["h"], F.lit(False))
    return [
        ("_sorted", F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)),
        ("_at", F.sort_array(F.transform(F.filter(sorted_, is_twin), lambda x: x["i"]))),
        ("n_repeat_words", F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x)),
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, host, and the counts and base verdict of its text."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    df = docs.select(F.col(key), F.col(host).alias("_host"), F.col(text).alias("_text"))
    df = df.select(key, "_host", "_text", F.filter(F.split(t, SPACE_JAVA), lambda w: w != "").alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_JAVA)).alias("_lines"))
    n = F.size("_words")
    df = df.select(
        key,
        "_host",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    for name, step in _covered("_words", "_windows"):
        df = df.withColumn(name, step)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.drop("_windows", "_sorted", "_at").withColumn("base_failed", failed)


def beta_prior(hosts: DataFrame, least: float = 2.0, most: float = 1000.0) -> tuple[float, float]:
    """Alpha and beta by moments over the hosts' failure rates; one row reaches the driver."""
    rate = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if m is None:
        return 1.0, 1.0
    weight = most if not v else min(most, max(least, m * (1 - m) / v - 1))
    return max(m * weight, 1e-9), max((1 - m) * weight, 1e-9)


def failing_hosts(rows: DataFrame, max_rate: float) -> DataFrame:
    """(_host): hosts whose shrunk failure rate is above ``max_rate``."""
    hosts = rows.where(F.col("_host").isNotNull()).groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    alpha, beta = beta_prior(hosts)
    return hosts.where((F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)) > max_rate).select("_host")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Features of every row, and ``kept``: neither it nor its host failed.

    The features, a few numbers a row, are written once, so texts are read once and
    never shuffled.  Hosts are counted before the shuffle; verdicts go back by a join
    of narrow rows, of which Spark splits hot hosts.
    """
    rows = durable(features(docs, key, text, host))
    out = failing_hosts(rows, max_rate).withColumn("_out", F.lit(True))
    return rows.join(out, "_host", "left").withColumn("kept", ~F.col("base_failed") & F.col("_out").isNull()).drop("_host", "_out")


def keep(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5, most_hosts: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that neither fail themselves nor have a failing host, with all their columns.

    Texts are read twice, for the hosts' rates and for the rows.  The failing hosts are
    counted first: up to ``most_hosts`` of them, a few megabytes, are broadcast, so texts
    are not shuffled; more are met in a shuffled join.
    """
    out = durable(failing_hosts(durable(features(docs.select(F.lit(0).alias("_k"), text, host), "_k", text, host)), max_rate))
    n = out.count()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(text).alias("_t"), F.col(host).alias("_h"))
    # The filter must stay above the features: pushed below, it would hold all their steps many times over.
    judged = features(rows, "_doc", "_t", "_h").withColumn("_at", F.monotonically_increasing_id()).where("NOT base_failed AND _at >= 0")
    if n:
        judged = judged.join(F.broadcast(out) if n <= most_hosts else out, "_host", "left_anti")
    return judged.select("_doc.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM h),
l AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS k FROM c WHERE n > 1),
q AS (SELECT r, sum(k) AS k FROM l GROUP BY r),
f AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
s AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM s),
a AS (SELECT m, CASE WHEN v = 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, m * (1 - m) / v - 1)) END AS k FROM m),
o AS (SELECT source FROM s, a WHERE (failed + m * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM o)) AS kept
FROM b
"""
