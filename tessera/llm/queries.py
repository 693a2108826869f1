"""Queries of this subpackage and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, decontam, htmltext, licenses, linedup, neardup, packing, pii, quality, toxicity
from .support import stage, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("quality.measures")
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("quality.base_failed").alias("base_failed"),
        F.col("quality.kept").alias("kept"),
        F.array_join("quality.failed_rules", ",").alias("failed_rules"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linedup.drop_lines(docs, "source", dropped="n_dropped").select("doc_id", "text", "n_dropped")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] == "base")

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents").select("doc_id", "text"), 85, 100).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = binary_output.new_folder(spark)
    manifest = binary_output.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, tokenizer_path())
    return binary_output.read_tokens(manifest, folder)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_quality_rules, op2_line_dedup, op3_license_scan, op4_minhash_near_dedup, op5_html_extraction,
        op6_pii_surrogates, op7_best_fit_packing, op8_benchmark_decontamination, op9_toxicity, op10_token_binary, pipeline,
    ]
    return {f.__name__: f for f in own}


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

#: Words, lines and rules of op1, written anew for DuckDB.
OP1_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text,
        list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS gram
      FROM (SELECT rid, ws, unnest(range(1, greatest(1, len(ws) - 3))) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS o(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        length(regexp_replace(text, '[^!]+', '', 'g')) AS marks,
        length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters,
        length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
        len(list_filter(ws, lambda x: list_contains([{_STOP}], lower(x)))) AS stops,
        len(list_filter(list_zip(ws[1:len(ws)-1], ws[2:]), lambda p: p[1] = p[2])) AS doubled,
        len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(?:[-*•]|\d+[.)])\s'))) AS bullets,
        len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…)\s*$'))) AS dots
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        list_filter([
          CASE WHEN n_words = 0 OR word_chars / n_words < 2.0 THEN 'word_length_low' END,
          CASE WHEN n_words > 0 AND word_chars / n_words > 15.0 THEN 'word_length_high' END,
          CASE WHEN n_words > 0 AND n_symbols / n_words > 0.3 THEN 'symbols' END,
          CASE WHEN n_words > 0 AND marks / n_words > 0.5 THEN 'exclamations' END,
          CASE WHEN letters > 0 AND capitals / letters > 0.6 THEN 'capitals' END,
          CASE WHEN n_words >= 50 AND stops / n_words < 0.02 THEN 'stop_words' END,
          CASE WHEN n_lines >= 4 AND n_dup_lines / n_lines > 0.5 THEN 'duplicate_lines' END,
          CASE WHEN n_lines >= 4 AND bullets / n_lines > 0.9 THEN 'bullet_lines' END,
          CASE WHEN n_lines >= 4 AND dots / n_lines > 0.5 THEN 'ellipsis_lines' END,
          CASE WHEN n_words >= 10 AND doubled / n_words > 0.3 THEN 'doubled_words' END
        ], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM f
"""

OP2_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT source, count(DISTINCT text) AS pages FROM t WHERE text IS NOT NULL GROUP BY source),
l AS (SELECT DISTINCT source, text, unnest(ls) AS line FROM t WHERE text IS NOT NULL),
b AS (SELECT l.source, line FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY l.source, line, pages
      HAVING count(*) >= {linedup.MIN_PAGES} AND count(*) > {linedup.RATIO} * pages),
x AS (SELECT rid, doc_id, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t WHERE text IS NOT NULL),
k AS (SELECT rid, doc_id, text, string_agg(CASE WHEN b.line IS NULL THEN x.line END, chr(10) ORDER BY i) AS kept,
        count(b.line) AS n FROM x LEFT JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.line = b.line
      GROUP BY rid, doc_id, text)
SELECT t.doc_id, CASE WHEN k.n > 0 THEN coalesce(k.kept, '') ELSE t.text END AS text, coalesce(k.n, 0) AS n_dropped
FROM t LEFT JOIN k USING (rid)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GRAMS = ", ".join(f"({tid}, '{label}', '{kind}', {grams}, {t}, '{gram}')" for tid, label, kind, grams, t, gram in licenses.templates())

#: Diagonals of two-word grams over the same templates, with windows in place of the scan.
OP3_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, unnest(list_transform(range(1, len(ws)), lambda i: {{'pos': i - 1, 'gram': ws[i] || ' ' || ws[i + 1]}}), recursive := true) FROM t),
tp(tid, label, kind, grams, tpos, tgram) AS (VALUES {_GRAMS}),
d AS (SELECT rid, tid, label, kind, grams, pos - tpos AS diag, list(DISTINCT tpos) AS tps, min(pos) AS lo, max(pos) AS hi
      FROM g JOIN tp ON gram = tgram GROUP BY ALL),
c AS (SELECT *, CASE WHEN diag - lag(diag) OVER w > CASE WHEN kind = 'notice' THEN {licenses.MAX_SHIFT} ELSE 0 END THEN 1 ELSE 0 END AS cut
      FROM d WINDOW w AS (PARTITION BY rid, tid ORDER BY diag)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY rid, tid ORDER BY diag) AS island FROM c),
s AS (SELECT rid, tid, label, kind, grams, island, len(list_distinct(flatten(list(tps)))) AS matched, min(lo) AS fw, max(hi) + {licenses.K - 1} AS lw
      FROM i GROUP BY rid, tid, label, kind, grams, island),
k AS (SELECT *, matched / grams AS coverage FROM s WHERE CASE WHEN kind = 'notice'
        THEN matched / grams >= {licenses.COVERAGE} AND lw - fw + 1 <= {licenses.MAX_STRETCH} * (grams + {licenses.K - 1}) ELSE matched = grams END)
SELECT doc_id, len(ws) AS n_words, count(*) FILTER (kind = 'base') AS n_base, min(fw) FILTER (kind = 'base') AS first_word,
  max(fw) FILTER (kind = 'base') AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base'), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(coverage), 0.0::DOUBLE) AS score
FROM t LEFT JOIN k ON t.rid = k.rid GROUP BY t.rid, doc_id, ws
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_license_scan": OP3_SQL}
