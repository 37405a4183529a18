"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (
    audit_queries,
    chat,
    decontaminate,
    html_text,
    language_id,
    mixing,
    near_duplicates,
    quality_rules,
    quality_votes,
    token_files,
    url_filter,
)
from tapeloom.llm.registry import QUERIES, SQL, query, table
from tapeloom.runtime import shared_path

__all__ = ["QUERIES", "SQL", "audit_queries"]

# ── 1 quality rules ──────────────────────────────────────────────────────────

#: Common table ``judged``: counts and verdicts of every row of a view.
JUDGED = r"""judged AS (
  WITH t AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS s FROM {view}),
  w AS (SELECT *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w FROM t),
  win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
  cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
  c AS (SELECT w.* EXCLUDE (w), len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      len(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
      len(list_distinct(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS d_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
  f AS (SELECT *, (n_lines - d_lines)::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      100 * n_symbols > 30 * n_words
      OR 2 * length(regexp_replace(s, '[^\p{{Lu}}]+', '', 'g')) > length(regexp_replace(s, '[^\p{{L}}]+', '', 'g'))
      OR word_chars < 2 * n_words OR word_chars > 15 * n_words
      OR 2 * (n_lines - d_lines) > len(string_split(s, chr(10))) AS rule_failed FROM c)
  SELECT * EXCLUDE (rid, s, n_lines, d_lines, rule_failed), NOT base_failed AND NOT rule_failed AS kept FROM f)"""


@query(
    "op1_quality_rules",
    "WITH " + JUDGED.format(view="documents") + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
)
def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ── 2 quality classifier ─────────────────────────────────────────────────────


@query("op2_quality_votes")
def quality_votes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = quality_votes.held_out(F.col("doc_id"))
    votes = quality_votes.fit(docs, labels.where(~held_out))
    scored = quality_votes.score(docs, votes)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


# ── 3 n-gram Jaccard join ────────────────────────────────────────────────────

#: Query text that gives ``groups`` (doc_id, n_shingles, component_id) of a view.
GROUPS = r"""sh AS (
  SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {last} + 1), lambda i: array_to_string(w[i:i + {last}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {view})),
  one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
  pair AS (SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
  link AS (SELECT x, y FROM pair UNION SELECT y, x FROM pair),
  reach(d, c) AS (SELECT doc_id, doc_id FROM sh UNION SELECT reach.d, link.y FROM reach JOIN link ON reach.c = link.x),
  groups AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(c) FROM reach WHERE d = doc_id) AS component_id FROM sh)"""


@query("op3_near_duplicates", "WITH RECURSIVE " + GROUPS.format(view="documents", words=4, last=3, percent=85) + " SELECT * FROM groups")
def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "documents"), words=4, percent=85)


# ── 4 token files ────────────────────────────────────────────────────────────


@query("op4_token_files")
def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(spark, path)


# ── 5 chat formatting ────────────────────────────────────────────────────────


@query(
    "op5_chat_perspectives",
    """WITH said AS (SELECT conv_id AS c, turn AS t, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
    people AS (SELECT DISTINCT c AS pc, speaker AS perspective FROM said WHERE speaker <> 'system'),
    r AS (SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS as_role FROM said JOIN people ON c IS NOT DISTINCT FROM pc),
    h AS (SELECT *, CASE WHEN as_role = 'user' THEN speaker END AS name,
        '<|im_start|>' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || replace(speaker, '<|', '< |') ELSE '' END || chr(10) AS head FROM r),
    g AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM h),
    o AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY c, perspective ORDER BY t NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM g)
    SELECT c AS conv_id, perspective, t AS turn, as_role AS role, name, segment, e - length(segment) AS start, e AS "end",
      CASE WHEN as_role = 'assistant' THEN e - length(segment) + length(head) END AS loss_start, CASE WHEN as_role = 'assistant' THEN e - 1 END AS loss_end FROM o""",
)
def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


# ── 6 language identification ────────────────────────────────────────────────


@query("op6_language_id")
def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by text, declared language and source; pages by text, markup and address."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    languages, model = language_id.train(docs)
    none = F.lit(None).cast("string")
    host = url_filter.host(F.col("url"))
    rows = docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.lit(False).alias("markup"), F.col("lang").alias("declared"),
        none.alias("suffix"), none.alias("domain"), F.col("source").alias("host"),
    ).unionByName(
        pages.select(
            F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), F.lit(True).alias("markup"),
            language_id.declared_in(F.col("html")).alias("declared"), F.substring_index(host, ".", -1).alias("suffix"),
            F.substring_index(host, ".", -2).alias("domain"), host.alias("host"),
        )
    )
    found = language_id.identify(rows, languages, model)
    return found.select("doc_id", "page_id", "language", F.round("probability", 6).alias("probability"), "text_language", "declared")


# ── 7 HTML extraction ────────────────────────────────────────────────────────


@query("op7_html_text")
def html_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# ── 8 mixing ─────────────────────────────────────────────────────────────────

#: Target shares of the named sources; all others have equal parts of ``MIX_OTHER``.
MIX_WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.05, "src4": 0.05}
MIX_OTHER = 0.5


@query("op8_mix_sources")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs, MIX_WEIGHTS, other=MIX_OTHER, every_source=True)


# ── 9 decontamination ────────────────────────────────────────────────────────


#: Common table ``leaks`` (doc_id, item_id, matched, aligned) of a view's rows, by definition: every shift of an item
#: against a document at which enough words agree at all is looked at word by word; no seeds are involved.
LEAKS = (
    r"""leaks AS (
  WITH dw AS (SELECT DISTINCT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {view} WHERE text IS NOT NULL),
  bw AS (SELECT * FROM (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL)"""
    + f""" WHERE len(w) >= {decontaminate.SHORTEST}),
  du AS (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM dw),
  bu AS (SELECT id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM bw),
  sh AS (SELECT du.id AS d, bu.id AS b, du.i - bu.i AS s FROM du JOIN bu USING (x) GROUP BY 1, 2, 3 HAVING 100 * count(*) >= {decontaminate.AGREE} * least({decontaminate.STRETCH}, any_value(n))),
  pr AS (SELECT d, b, s, dw.w AS x, bw.w AS y, greatest(0, -s) AS f, least(len(bw.w), len(dw.w) - s) - greatest(0, -s) AS a, least({decontaminate.STRETCH}, len(bw.w)) AS need
      FROM sh JOIN dw ON dw.id = d JOIN bw ON bw.id = b),
  fl AS (SELECT d, b, a, need, list_transform(range(1, a + 1), lambda k: (x[f + s + k] = y[f + k])::INT) AS m FROM pr WHERE a >= need),
  ok AS (SELECT d, b, a, list_sum(m) AS t FROM fl WHERE len(list_filter(range(1, a - need + 2), lambda k: 100 * list_sum(m[k:k + need - 1]) >= {decontaminate.AGREE} * need)) > 0)
  SELECT d AS doc_id, b AS item_id, max(t)::BIGINT AS matched, arg_min(a, (-t, a))::BIGINT AS aligned FROM ok GROUP BY 1, 2)"""
)


@query("op9_decontaminate", "WITH " + LEAKS.format(view="documents") + " SELECT * FROM leaks")
def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ── 10 URL filters ───────────────────────────────────────────────────────────

#: The list of the query: canonical URLs of pages on hosts with these words.
SPAM_WORDS = ("spam", "pills", "casino")


@query(
    "op10_url_filter",
    r"""WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS q FROM u),
    c AS (SELECT page_id, host, path, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canon FROM h),
    listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, 'spam|pills|casino')),
    r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    best AS (SELECT page_id, host, path, canon, arg_max({'r': rhost || rpath, 'a': action}, length(rhost || rpath)) AS b FROM c LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
    SELECT page_id, host, path, b.r AS rule, coalesce(b.a, CASE WHEN canon IN (SELECT canon FROM listed WHERE canon IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict FROM best""",
)
def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    spam = url_filter.host(F.col("url")).rlike("|".join(SPAM_WORDS))
    listing = pages.where(spam).select(url_filter.canonical(F.col("url")).alias("canonical"))
    return url_filter.judge(pages, listing).select("page_id", "host", "path", "rule", "verdict")
