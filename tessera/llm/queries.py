"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from . import bpe, decontaminate, html, lines, pii, quality, simhash, substrings, tokencounts, urls
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES = {
    "op1_url_filters": lambda spark, d: urls.judge(table(spark, d, "pages")),
    "op2_benchmark_decontamination": lambda spark, d: decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op3_html_extraction": lambda spark, d: html.extract(table(spark, d, "pages")),
    "op4_quality_rules": lambda spark, d: quality.judge(table(spark, d, "documents")),
    "op5_pii": lambda spark, d: pii.find(table(spark, d, "documents")),
    "op6_line_dedup": lambda spark, d: lines.out_lines(table(spark, d, "documents")),
    "op7_token_counts": lambda spark, d: tokencounts.count(table(spark, d, "documents"), VOCABULARY, public_tokenizers.PATTERN),
    "op8_simhash": lambda spark, d: simhash.groups(table(spark, d, "documents")),
    "op9_byte_bpe": lambda spark, d: bpe.encode_digests(table(spark, d, "documents"), VOCABULARY, public_tokenizers.PATTERN),
    "op10_substring_dedup": lambda spark, d: substrings.remove(table(spark, d, "documents")),
}

ORACLE_SQL = {
    "op1_url_filters": urls.ORACLE_SQL,
    "op4_quality_rules": quality.ORACLE_SQL,
}
