"""Batches that are resumed: results judged and applied once, failures and retries, over every session."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skeinlake.operators import manifest
from skeinlake.operators.graph import scratch_dir
from skeinlake.operators.packing import priced
from skeinlake.plans.q_sessions import SESS, sess
from skeinlake.plans.registry import query

#: One request for each session, sixteen to a batch, and a first delivery of results of all kinds.
DELIVERED = f"""{SESS},
req AS (SELECT 'b-' || session_id AS custom_id, session_id AS id, session_id // 16 AS batch, round(tok_total * 3.0::DOUBLE / 1000000 + 500 * 15.0::DOUBLE / 1000000, 8) AS dollars FROM sess),
res AS (SELECT id, k, id * 10 + k AS seq, CASE WHEN id % 10 = 9 THEN 'x-' || id ELSE custom_id END AS custom_id, id % 8 AS kind FROM req, (SELECT unnest(range(0, 3)) AS k) WHERE id % 8 <> 0 AND (k = 0 OR (k = 1 AND id % 8 IN (3, 4)) OR (k = 2 AND id % 8 = 4))),
told AS (SELECT *, CASE WHEN id % 10 = 9 THEN 'unknown' WHEN kind = 1 THEN 'identity' WHEN kind = 2 THEN 'tokens' WHEN kind = 5 THEN 'output' WHEN kind = 6 AND id % 3 = 0 THEN 'input' WHEN kind = 6 AND id % 3 = 1 THEN 'provider' WHEN k = 0 THEN 'applied' WHEN kind = 3 THEN 'conflict' ELSE 'replay' END AS verdict FROM res)"""


def _planned(spark, sf_dir):
    s = sess(spark, sf_dir)
    k = F.col("session_id")
    rows = s.select(
        F.concat(F.lit("b-"), k.cast("string")).alias("custom_id"), F.floor(k / 16).cast("long").alias("batch"), "harness", "native_id", F.sha2(k.cast("string"), 256).alias("input_hash"), F.col("tok_total").alias("input_tokens")
    )
    return manifest.plan(priced(rows, 500, 3.0, 15.0), now=1)


def _results(requests, good=False):
    """What is delivered for requests: of every kind, or all ``good``."""
    k = F.substring("custom_id", 3, 20).cast("long")
    rows = requests.select("*", k.alias("id"))
    kind = F.lit(7) if good else F.col("id") % 8
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).when(kind == 4, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    rows = rows.filter(kind != 0).withColumn("copy", F.explode(copies))
    text = F.concat(F.lit("r"), F.col("id").cast("string"), F.when((kind == 3) & (F.col("copy") == 1), "!").otherwise(""))
    six = lambda n: (kind == 6) & (F.col("id") % 3 == n)
    lost = F.lit(False) if good else F.col("id") % 10 == 9
    return rows.select(
        (F.col("id") * 10 + F.col("copy")).alias("seq"), F.when(lost, F.concat(F.lit("x-"), F.col("id").cast("string"))).otherwise(F.col("custom_id")).alias("custom_id"), "harness",
        F.when(kind == 1, "else").otherwise(F.col("native_id")).alias("native_id"), F.lit("fixture").alias("provider"), F.when(six(1), "other").otherwise("small").alias("model"),
        F.when(six(0), "stale").otherwise(F.col("input_hash")).alias("input_hash"), F.when(kind == 2, F.col("output_tokens") + 1).otherwise(F.lit(10)).alias("output_tokens"),
        text.alias("output_text"), F.when(kind == 5, F.lit("00")).otherwise(F.sha2(text, 256)).alias("output_hash"),
    )


@query("manifest_verdicts", f"WITH {DELIVERED} SELECT seq, custom_id, verdict FROM told")
def manifest_verdicts(spark, sf_dir):
    """Every delivered result with what becomes of it."""
    m = _planned(spark, sf_dir)
    return manifest.verdicts(m, _results(m[0]), "fixture", "small").select("seq", "custom_id", "verdict")


@query("manifest_resume", f"""WITH {DELIVERED},
one AS (SELECT req.*, custom_id IN (SELECT custom_id FROM told WHERE verdict = 'applied') AS a1 FROM req),
two AS (SELECT *, a1 OR batch % 4 = 1 AS a2, NOT a1 AND batch % 4 IN (0, 1, 2) AS f FROM one),
b AS (SELECT batch, count(*) AS requests, count(*) FILTER (WHERE a2) AS applied, count(*) FILTER (WHERE NOT a2 AND f AND batch % 4 <> 2) AS failed, count(*) FILTER (WHERE NOT a2 AND NOT (f AND batch % 4 <> 2)) AS pending,
  round(coalesce(sum(dollars) FILTER (WHERE NOT a2), 0), 8) AS dollars, coalesce(sum(500) FILTER (WHERE NOT a2), 0)::BIGINT AS tokens, count(*) FILTER (WHERE NOT a1) AS open FROM two GROUP BY 1)
SELECT batch, CASE WHEN batch % 4 = 1 AND open > 0 THEN 'completed' WHEN batch % 4 = 0 THEN 'failed' WHEN batch % 4 = 3 AND open = 0 THEN 'completed' ELSE 'running' END AS status,
  CASE WHEN batch % 4 IN (0, 1) THEN 'timeout' END AS error, requests, applied, failed, pending, dollars, tokens FROM b""")
def manifest_resume(spark, sf_dir):
    """What is left after a delivery, failures of three batches in four, a retry of some, and a second delivery, saved and read in between."""
    root = f"{scratch_dir(spark)}/manifest-{uuid.uuid4().hex}"
    m = _planned(spark, sf_dir)
    m = manifest.start(m, m[1].select("batch"), now=2)
    m = manifest.apply(m, manifest.verdicts(m, _results(m[0]), "fixture", "small"), now=3)
    manifest.save(m, root)
    m = manifest.load(spark, root)
    quarter = F.col("batch") % 4
    m = manifest.fail(m, m[0].filter((quarter < 3) & (F.col("status") != "applied")).select("batch", "custom_id", F.lit("timeout").alias("error")), now=4)
    m = manifest.retry(m, m[1].filter(quarter == 2), now=5)
    manifest.save(m, root)
    m = manifest.load(spark, root)
    late = _results(m[0].filter((quarter == 1) & (F.col("status") != "applied")), good=True)
    m = manifest.apply(m, manifest.verdicts(m, late, "fixture", "small"), now=6)
    manifest.save(m, root)
    return manifest.resume(manifest.load(spark, root))
