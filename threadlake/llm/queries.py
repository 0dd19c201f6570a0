"""The registered query of each operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlake.llm import bpe, decontaminate, html_text, licenses, lm_score, pii, quality_rules, resampling, simhash, spelling, substring_dedup, suffix_dedup, toxicity
from threadlake.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, from one ledger of all documents."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents").select("text")).select("ledger"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_quality_rules": op4_quality_rules,
    "quality_ablation": quality_ablation,
    "op5_html_text": op5_html_text,
    "op6_bpe": op6_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash": op10_simhash,
    "op11_resampling": op11_resampling,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling": op13_spelling,
}

ORACLES = {
    "op4_quality_rules": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
             (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (rid)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 40 * n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
             + 64 * (100 * n_capitals > 40 * word_chars)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_lines, n_capitals, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, '{policy}' AS policy FROM f
""".replace("{policy}", quality_rules.DEFAULT.version),
    "op8_lm_score": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT rid, b, lag(b) OVER w AS a, lead(b) OVER w AS c
      FROM (SELECT rid, unnest(ws) AS b, unnest(range(len(ws))) AS i FROM d) WINDOW w AS (PARTITION BY rid ORDER BY i)),
n1 AS (SELECT b, count(*) AS n FROM t GROUP BY b), n2 AS (SELECT b, c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY a, b, c),
s AS (SELECT t.rid,
        CASE WHEN t.c IS NULL THEN 0 WHEN t.a IS NOT NULL AND n3.n >= 2 THEN ln(n3.n / ab.n)
             WHEN t.a IS NOT NULL THEN ln(0.4) + ln(bc.n / n1.n) ELSE ln(bc.n / n1.n) END
        + CASE WHEN t.a IS NULL THEN ln(n1.n / (SELECT count(*) FROM t)) ELSE 0 END AS s
      FROM t JOIN n1 ON t.b = n1.b LEFT JOIN n2 bc ON bc.b = t.b AND bc.c = t.c
             LEFT JOIN n2 ab ON ab.b = t.a AND ab.c = t.b LEFT JOIN n3 ON n3.a = t.a AND n3.b = t.b AND n3.c = t.c)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, round(coalesce(x.s, 0), 6) AS log_score
FROM d LEFT JOIN (SELECT rid, sum(s) AS s FROM s GROUP BY rid) x USING (rid)
""",
}
#: DuckDB lacks the checksum: 256 table entries from its polynomial, then a fold over a text's bytes.
CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b))"


def _crc(text: str) -> str:
    """crc32 of the UTF-8 bytes of an SQL expression, with the table in a column ``crc``."""
    return f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]), 4294967295))"


# Edit distances there are of bytes, so letters stand as single ones.
ORACLES["op13_spelling"] = f"""
WITH RECURSIVE k AS (SELECT {CRC_TABLE} AS crc),
d AS (SELECT coalesce(doc_id::VARCHAR, 'null') || ':' AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+') AS ws FROM documents),
r AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(ws) AS w FROM d) WHERE length(w) > 5 GROUP BY id, w),
h AS (SELECT w, n, {_crc('id || w')} AS h FROM r, k),
c AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1),
v AS (SELECT word, n, length(word) AS l, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{{|}}~') AS p FROM c WHERE length(word) >= 6 AND n >= 5),
e AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM v a JOIN v b ON b.l BETWEEN a.l - 1 AND a.l + 1 WHERE a.word <> b.word AND levenshtein(a.p, b.p) = 1),
b AS (SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(m := -m, w := other)) AS o FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -o.m >= 5 * v.n THEN o.w END AS form, CASE WHEN -o.m >= 5 * v.n THEN -o.m END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, form, x.root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(root, step) AS root FROM t GROUP BY word) x USING (word)
"""

ORACLES["op11_resampling"] = f"""
WITH k AS (SELECT {CRC_TABLE} AS crc),
w AS (SELECT rid, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
      FROM (SELECT row_number() OVER () AS rid, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark)),
g AS (SELECT rid, own, f, count(*) AS n FROM (SELECT rid, own, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM w) GROUP BY ALL),
h AS (SELECT f, ({_crc('f')} % 10000)::BIGINT AS b FROM (SELECT DISTINCT f FROM g), k),
p AS (SELECT rid, own, b, sum(n) AS n FROM g JOIN h USING (f) GROUP BY ALL),
c AS (SELECT b, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM p GROUP BY b),
a AS (SELECT b, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS gain FROM c),
m AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM p JOIN a USING (b) WHERE own GROUP BY rid),
x AS (SELECT rid, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN m USING (rid) WHERE own),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight DESC, n_features DESC) AS place, count(*) OVER () AS n FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM x LEFT JOIN r USING (rid)
"""

ORACLES["op12_substring_dedup"] = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY k ORDER BY rid, i) AS n FROM g) WHERE n > 1),
x AS (SELECT DISTINCT rid, i + o AS i FROM r, range(20) AS v(o)),
w AS (SELECT rid, i, ws[i] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
y AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN x USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (rid)
"""

_mask = quality_rules.DEFAULT.mask
_rules = ", ".join(f"('{name}', {quality_rules.BIT[name]})" for name in sorted(set(quality_rules.DEFAULT.rules), key=quality_rules.BIT.get))
ORACLES["quality_ablation"] = f"""
WITH q AS ({ORACLES["op4_quality_rules"]}), r(rule, b) AS (VALUES {_rules}), k AS (SELECT count(*)::BIGINT AS n_docs, count_if(fail_bits & {_mask} = 0)::BIGINT AS n_kept FROM q),
x AS (SELECT rule, count_if(fail_bits & b <> 0)::BIGINT AS n_failed, count_if(fail_bits & b <> 0 AND fail_bits & ({_mask} - b) = 0)::BIGINT AS n_failed_only FROM r, q GROUP BY rule)
SELECT '{quality_rules.DEFAULT.version}' AS policy, n_docs, n_kept, rule, n_failed, n_failed_only, n_kept + n_failed_only AS n_kept_without FROM x, k
"""
