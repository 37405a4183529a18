"""Queries 11 to 13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import fill_in_middle, source_audit, toxicity
from tapeloom.llm.registry import query, table

# ── 11 source divergence audit ───────────────────────────────────────────────

#: Common table ``audit`` of a view; ``least`` documents keep a term.
AUDIT = r"""d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {view}),
  t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
  kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= {least}),
  c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
  v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
  s AS (SELECT DISTINCT lang, source FROM d),
  n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
  full_ AS (SELECT s.lang, s.source, kept.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (coalesce(n, 0) + 2 * v) AS p
      FROM s JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = s.lang AND n.source = s.source LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
  whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 2) // (any_value(n) + 2 * any_value(v)) AS q
      FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY 1) USING (lang) GROUP BY 1, 2),
  pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN full_ x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN full_ y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
  ahead AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM full_ JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM ahead)),
  audit AS (SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10)"""


@query("op11_source_audit", "WITH " + AUDIT.format(view="documents", least=10) + " SELECT * FROM audit")
def source_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


# ── 12 toxicity ──────────────────────────────────────────────────────────────


@query("op12_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held_out = toxicity.held_out(F.col("doc_id"))
    scorer = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, scorer)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


# ── 13 fill in the middle ────────────────────────────────────────────────────


def _draw(number: int) -> str:
    return f"('0x' || substr(h, {8 * number - 7}, 8))::BIGINT"


@query(
    "op13_fill_in_middle",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
    r AS (SELECT *, len(w)::BIGINT AS n, least({_draw(1)} % (len(w) + 1), {_draw(2)} % (len(w) + 1)) AS a, greatest({_draw(1)} % (len(w) + 1), {_draw(2)} % (len(w) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_draw(3)} % 100 >= 90 THEN 'plain' WHEN {_draw(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    c AS (SELECT *, length(array_to_string(w[1:a], '')) AS x, length(array_to_string(w[a + 1:b], '')) AS y FROM r),
    p AS (SELECT *, substr(t, 1, x) AS head, substr(t, x + 1, y) AS mid, substr(t, x + y + 1) AS tail FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN y::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || mid ELSE t END) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN t ELSE head || mid || tail END) AS restored_sha256 FROM p""",
)
def fill_in_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fill_in_middle.transform(docs)
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")
    )
