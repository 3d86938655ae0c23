"""The queries of this subpackage and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, lm, mixing, negatives, pii, quality, secret_scan, sharding, simhash, spelling, tokens, topk
from .common import ship, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


#: Words and shingles of five words (fewer: the whole sequence), then exact containment.
OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (
  SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
il AS (SELECT item_id, w, least(len(w), 5) AS n FROM iw WHERE len(w) > 0),
ish AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
isz AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
ns AS (SELECT DISTINCT n FROM ish),
dsh AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n))
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, round(count(*) / n_shingles, 6) AS containment
FROM dsh JOIN ish USING (n, s) JOIN isz USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= ceil(n_shingles * 0.8 - 1e-9)
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "source",
        F.round("rate", 9).alias("rate"),
        "copy",
        "position",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_text"),
    )


def _unit(parts: str) -> str:
    return f"(('0x' || substr(md5({parts}), 1, 13))::BIGINT)"


def op2_body(docs: str) -> str:
    """CTEs mix_rates, mix_counts and mixed (doc_id, source, rate, copy, position) over a table."""
    draw = _unit("'42:' || d.name || ':0'")
    order = _unit("'42-order:' || name || ':' || copy::VARCHAR")
    return f"""
mix_sizes AS (
  SELECT source, coalesce(sum(coalesce(strlen(text), 0)), 0)::BIGINT AS n_bytes FROM {docs} GROUP BY source),
mix_sums AS (SELECT sum(sqrt(n_bytes::DOUBLE)) AS sum_w, sum(n_bytes)::DOUBLE AS all_bytes FROM mix_sizes),
mix_rates AS (
  SELECT source, CASE WHEN n_bytes > 0 THEN sqrt(n_bytes::DOUBLE) / sum_w * all_bytes / n_bytes ELSE 1.0 END AS rate
  FROM mix_sizes, mix_sums),
mix_cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS upto FROM mix_rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), upto + p * rate / (k + 1) FROM mix_cdf
  WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)),
mix_counts AS (
  SELECT d.doc_id, d.name, d.source, c.rate, count(*) FILTER (WHERE c.upto <= {draw} / 4503599627370496.0) AS n
  FROM (SELECT *, coalesce(doc_id::VARCHAR, 'text-' || md5(coalesce(text, ''))) AS name, row_number() OVER () AS mix_row FROM {docs}) d JOIN mix_cdf c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY d.mix_row, d.doc_id, d.name, d.source, c.rate),
mix_copies AS (SELECT doc_id, name, source, rate, unnest(range(1, n + 1))::INT AS copy FROM mix_counts),
mixed AS (
  SELECT doc_id, source, rate, copy,
    row_number() OVER (ORDER BY {order}, doc_id NULLS FIRST, copy) - 1 AS position
  FROM mix_copies)"""


OP2_SQL = f"""
WITH RECURSIVE {op2_body("documents")}
SELECT m.doc_id, m.source, round(m.rate, 9) AS rate, m.copy, m.position, length(coalesce(d.text, '')) AS n_text
FROM mixed m JOIN documents d USING (doc_id)
"""


def op3_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_body(docs: str, key: str = "doc_id") -> str:
    """CTEs jumps and placed (key, shard, grown_shard) over the distinct keys of a table."""
    return f"""
jumps AS (
  SELECT k0, n, -1::BIGINT AS b, 0::BIGINT AS j, (k0::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS s
  FROM (SELECT DISTINCT coalesce({key}, 0)::BIGINT AS k0 FROM {docs}), (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT k0, n, j, floor((j + 1)::DOUBLE * (2147483648.0 / ((t // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT, t
  FROM (SELECT *, (s * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS t FROM jumps WHERE j < n)),
placed AS (
  SELECT k0, max(CASE WHEN n = 16 THEN b END)::INT AS shard, max(CASE WHEN n = 17 THEN b END)::INT AS grown_shard
  FROM jumps WHERE j >= n GROUP BY k0)"""


#: DuckDB has no CRC-32, so this leaves out text_crc32 and serves the tests only.
OP5_SQL = f"""
WITH RECURSIVE {op5_body("documents")}
SELECT d.doc_id, coalesce(strlen(d.text), 0)::BIGINT + 1 AS size, 'key' AS law, p.shard, p.grown_shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY {_unit("'slot:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))")}, d.doc_id NULLS FIRST) - 1 AS slot
FROM documents d JOIN placed p ON coalesce(d.doc_id, 0) = p.k0
"""


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY rank <= 3
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.digests(table(spark, sf_dir, "documents"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: CRC-32 by its table, whose polynomial is a fixed value; near words meet at a word with one letter left out or masked.
OP13_SQL = r"""
WITH RECURSIVE crc_steps AS (
  SELECT i::UBIGINT AS c, i, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
hits AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS name, count(*) AS n FROM runs GROUP BY ALL),
named AS (SELECT run, n, hex(encode(name)) AS digits, strlen(name) AS bytes FROM hits WHERE length(run) >= 5),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(1, bytes + 1), lambda i: ('0x' || substr(digits, (2 * i - 1)::INT, 2))::UBIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM named, crc_table),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words),
masked AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS m FROM spots),
shorter AS (SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS m FROM spots),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM masked a JOIN masked b ON a.m = b.m AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.m = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.m = w.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS top, arg_min(b, struct_pack(m := -n, w := b)) AS b FROM pairs GROUP BY a),
forms AS (
  SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.top >= 2 * w.n THEN p.b END AS form, CASE WHEN p.top >= 2 * w.n THEN p.top END AS form_n
  FROM words w LEFT JOIN best p ON w.word = p.a),
walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL
  SELECT k.word, k.next, f.form FROM walk k JOIN forms f ON k.next = f.word)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word AND k.next IS NULL
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_benchmark_decontamination,
        op2_source_mixing,
        op3_pii_sanitisation,
        op4_lm_scoring,
        op5_jump_sharding,
        op6_simhash_groups,
        op7_quality_classifier,
        op8_token_files,
        op9_exact_topk,
        op10_secret_scan,
        op11_hard_negatives,
        op12_exact_dedup,
        op13_spelling_variants,
        pipeline,
    ]

    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__ = f.__name__
        return run

    return {f.__name__: shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": OP1_SQL,
        "op2_source_mixing": OP2_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_exact_dedup": OP12_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
