"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import WORD
from strandloom.llm.conversations import damage, repair_conversations
from strandloom.llm.decontaminate import find_contamination
from strandloom.llm.html_text import extract_main_text
from strandloom.llm.importance import resample_by_importance
from strandloom.llm.licenses import scan_licenses
from strandloom.llm.packing import pack_by_length
from strandloom.llm.quality_rules import rate_documents, train_line_model
from strandloom.llm.repeats import find_repeats
from strandloom.llm.runs import find_runs
from strandloom.llm.secrets import find_secrets
from strandloom.llm.sharding import shard_by_vector_packing
from strandloom.llm.simhash import near_duplicates
from strandloom.llm.url_rules import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_vector_packing(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_by_importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate_documents(docs, train_line_model(docs, table(spark, sf_dir, "labels")), min_share=0.4)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_length(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text made periodic from some word on, its runs and the text without their repeats."""
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.explode_outer(F.when((h % 10 == 0) & F.col("text").isNotNull(), F.array(words))).alias("w"))
    n, a = F.size("w"), F.col("g") % F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, a)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    found = find_runs(rows.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.floor(-1000 * F.col("b.l") / F.col("b.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The rules that op12 judges by: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).drop("url")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_secrets, op3_main_text, op4_decontamination, op5_repeats, op6_importance, op7_quality_rules, op8_licenses, op9_simhash, op10_packing, op11_runs, op12_url_rules, op13_conversations)
}

_HOST = "translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))
_VERDICT = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in URL_RULES)
URL_SQL = f"""WITH parts AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (SELECT *, CASE {_RULE} END AS rule FROM parts) SELECT page_id, host, path, rule, CASE rule {_VERDICT} ELSE 'allow' END AS verdict FROM judged"""

# crc32, bit by bit over the bytes of an ASCII text.
_CRC = "xor(list_reduce(list_transform(str_split({0}, ''), lambda c: cast(ascii(c) AS BIGINT)), lambda crc, byte: list_reduce(range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)), 4294967295), 4294967295)"
_BLANK = "regexp_matches(text, '^[\\x20\\x09-\\x0D]*$')"
#: Edits of one turn or before one: from state, to state, cost, letter; the roles are a walk over states 0 (begin), 1 (after s), 2 (after u), 3 (after a).
REPAIR_SQL = f"""WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM given WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM damaged),
rated AS (SELECT *, CASE WHEN {_BLANK} THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
 CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS i, lag(CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
walk(p, i, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edits AS (SELECT conv_id, place, p, q, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cost, 'K' AS edit, role || ':' || text AS line FROM rated JOIN walk USING (i) WHERE fault IS NULL OR fault = 'truncated'
 UNION ALL SELECT conv_id, place, p, q, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R', CASE walk.i WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text FROM rated, walk WHERE walk.i <> 's' AND (fault IS NULL OR fault = 'truncated')
 UNION ALL SELECT conv_id, place, p, p, 3, 'D', NULL FROM rated, range(4) states(p)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ends AS (SELECT ids.conv_id, count(place) AS n FROM ids LEFT JOIN rated ON rated.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
inserts AS (SELECT p, q, 2 AS cost, 'I' AS edit, [CASE i WHEN 'u' THEN 'user:' ELSE 'assistant:' END] AS lines FROM walk WHERE i <> 's' UNION ALL SELECT p, p, 0, '', [] FROM range(4) states(p)),
twice AS (SELECT a.p, b.q, a.cost + b.cost AS cost, a.edit || b.edit AS edit, a.lines || b.lines AS lines FROM inserts a JOIN inserts b ON a.q = b.p WHERE NOT (a.edit = '' AND b.edit <> '')),
best AS (SELECT conv_id, 0 AS place, 0 AS q, {{'cost': 0, 'audit': '', 'lines': cast([] AS VARCHAR[])}} AS held FROM ends
 UNION ALL SELECT best.conv_id, best.place + 1, edits.q, min({{'cost': held.cost + twice.cost + edits.cost, 'audit': held.audit || twice.edit || edits.edit, 'lines': held.lines || twice.lines || CASE WHEN line IS NULL THEN [] ELSE [line] END}})
  FROM best JOIN twice ON twice.p = best.q JOIN edits ON edits.conv_id IS NOT DISTINCT FROM best.conv_id AND edits.place = best.place + 1 AND edits.p = twice.q GROUP BY best.conv_id, best.place, edits.q),
done AS (SELECT best.conv_id, min({{'cost': held.cost + twice.cost, 'audit': held.audit || twice.edit, 'lines': held.lines || twice.lines}}) AS held FROM best JOIN ends ON ends.conv_id IS NOT DISTINCT FROM best.conv_id AND ends.n = best.place
 JOIN twice ON twice.p = best.q WHERE twice.q IN (0, 3) GROUP BY best.conv_id)
SELECT done.conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, cast(any_value(held.cost) AS BIGINT) AS cost, any_value(held.audit) AS audit, sha256(any_value(array_to_string(held.lines, chr(10)))) AS repaired_sha256
FROM done LEFT JOIN rated ON rated.conv_id IS NOT DISTINCT FROM done.conv_id GROUP BY done.conv_id"""

#: None for the others: trained models, graph components, placement, grammars and dynamic programmes over texts are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op12_url_rules": URL_SQL, "op13_conversations": REPAIR_SQL}
