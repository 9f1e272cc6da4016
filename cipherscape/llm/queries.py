"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherscape.llm import codebooks, html_crf, importance, jaccard, licenses, lines, mixing, packing, pii, quality, substring, topk, warc
from cipherscape.llm.common import table


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages")).filter("kind = 'record'")
    return found.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("paragraph")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.withColumn("text", html_crf.extracted(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_digest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_topk": op2_topk,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality": op4_quality,
        "op5_mixing": op5_mixing,
        "op6_warc": op6_warc,
        "op7_packing": op7_packing,
        "op8_licenses": op8_licenses,
        "op9_line_rules": op9_line_rules,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_codebooks": op11_codebooks,
        "op12_importance": op12_importance,
        "op13_personal_data": op13_personal_data,
    }


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_OP2 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

_OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p), m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
 x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (k) WHERE first < doc_id),
 r AS (SELECT doc_id, list(j) AS gone FROM x GROUP BY doc_id), f AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id)),
 u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
 kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS t FROM u LEFT JOIN x ON u.doc_id = x.doc_id AND u.j = x.j WHERE x.j IS NULL GROUP BY u.doc_id)
 SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM f LEFT JOIN kept ON f.doc_id = kept.doc_id"""

_OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, octet_length(encode(coalesce(html, ''))) AS b FROM pages),
 f AS (SELECT *, CASE WHEN b >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
 SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, s AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_OP9 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
 again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
 l AS (SELECT doc_id, source, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
 n AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS norm FROM l WHERE len(lw) > 0),
 same AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n GROUP BY doc_id),
 hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
 often AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS c FROM n GROUP BY source, norm) f WHERE c > 2 AND c > 0.02 * (SELECT docs FROM hosts h WHERE h.source IS NOT DISTINCT FROM f.source)),
 gone AS (SELECT doc_id, sum(len(lw)) AS n FROM n WHERE EXISTS (SELECT 1 FROM often o WHERE o.norm = n.norm AND o.source IS NOT DISTINCT FROM n.source) GROUP BY doc_id),
 b AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(same.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words FROM d LEFT JOIN again USING (doc_id) LEFT JOIN same USING (doc_id) LEFT JOIN gone USING (doc_id))
 SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, removed_words,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= n_words * 0.5 AND n_words > removed_words AS kept FROM b"""

_OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
 ab AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
 c AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT ab.b, c.r FROM c JOIN ab ON ab.a = c.v WHERE c.r < ab.b)
 SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, m.r) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(r) AS r FROM c GROUP BY v) m ON m.v = d.doc_id"""


def _op11() -> str:
    """Every distance of every round; the rounds are spelled out one after another."""
    near = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(codebooks.ROUNDS + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT p.id, p.part, c.entry, CAST({near} AS BIGINT) AS d FROM p JOIN c{k} c ON p.part = c.part)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY id, part)")
        if k < codebooks.ROUNDS:
            steps.append(f"s{k} AS (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS pos FROM a{k} a JOIN p ON p.id = a.id AND p.part = a.part) GROUP BY part, entry, pos)")
            steps.append(f"m{k} AS (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY pos) AS x FROM s{k} GROUP BY part, entry)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)")
    last = codebooks.ROUNDS
    return f"""WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codebooks.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, e) AS id FROM w),
 p AS MATERIALIZED (SELECT id, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x FROM v, range(4) r(part)),
 c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM p WHERE id <= {codebooks.ENTRIES}),
 {", ".join(steps)},
 h AS (SELECT sha256(string_agg(CAST(t AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS t, generate_subscripts(x, 1) AS pos FROM c{last})),
 f AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY id)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (id), h"""


def _op12() -> str:
    """Features as text; the CRC of each different one by its bytes, through a table of what a byte does."""
    steps = "[" + ", ".join(str(int(c)) for c in importance.Shifts().short[1, 0]) + "]"
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
    n = importance.BUCKETS
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents), e AS (SELECT {words} AS w FROM benchmark),
 g AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest({runs}) AS f FROM d) GROUP BY doc_id, f), gb AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({runs}) AS f FROM e) GROUP BY f),
 x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM g UNION SELECT f FROM gb)),
 y AS (SELECT f, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)) AS b FROM x),
 k AS MATERIALIZED (SELECT f, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % {n} AS bucket FROM y, (SELECT {steps}::BIGINT[] AS t)),
 s AS (SELECT bucket, sum(n) AS s FROM g JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM gb JOIN k USING (f) GROUP BY bucket),
 z AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + {n}) AS DOUBLE) / CAST((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + {n}) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
 f AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM g JOIN k USING (f) JOIN z USING (bucket) GROUP BY doc_id),
 r AS (SELECT doc_id, len(w) >= {importance.LEAST_WORDS} AS long, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('{importance.SEED}:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN f USING (doc_id)),
 o AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS place FROM r)
 SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= {importance.PERCENT} * (SELECT count(*) FROM r WHERE long) // 100 THEN place END AS rank FROM o"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL expresses; the other operators are compared with brute force, round trips and held-out labels."""
    return {"op2_topk": _OP2, "op3_substring_dedup": _OP3, "op6_warc": _OP6, "op9_line_rules": _OP9, "op10_jaccard_join": _OP10, "op11_codebooks": _op11(), "op12_importance": _op12()}
