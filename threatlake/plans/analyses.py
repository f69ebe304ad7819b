"""Queries over analysis outputs, which are made from the chunks of the events, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.operators import chunks, outputs
from threatlake.plans import oracle
from threatlake.plans.adapter import events
from threatlake.sources.workspace import new_folder

#: Each output's parts, told from the chunk's numbers: those of chunks with so many events are absent.
PRIORITIES = ["informational", "low", "medium", "high", "critical"]


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Stored outputs of the chunks by source, with a quarter of an hour as a file."""
    c = chunks.profiles(chunks.indexed(events(spark, sf))).where("strategy = 'src_ip'")
    n, port = F.col("events"), F.get("ports", F.lit(0))
    start = F.col("window_start")
    part = lambda there, **fields: F.when(there, F.struct(*(v.alias(k) for k, v in fields.items())))
    share, tactic = F.round(F.col("denied") / n, 3), F.concat(F.lit("tactic-"), n % 4)
    rows = c.select(
        F.concat_ws("-", "entity", start).alias("analysis_id"), F.concat_ws(":", "entity", start).alias("chunk_id"), F.concat(F.lit("file-"), F.expr("window_start div 900000000")).alias("file_id"), start.alias("created_at"),
        F.col("entity").alias("src_ip"), "window_start", "window_end", F.transform(F.coalesce("ports", F.array().cast("array<int>")), lambda p: F.concat(F.lit("host-"), p)).alias("hosts"),
        part(n % 7 != 0, interpretation=F.concat(F.col("pattern"), F.lit(" requests to port "), port.cast("string")), is_suspicious=F.col("denied") > 0, confidence=F.round(1 - share, 3), key_indicators=F.array(F.concat(F.lit("port "), port.cast("string")), F.col("pattern"), F.lit(None).cast("string"), F.lit("never kept"))).alias("behavioral"),
        part(n % 3 == 0, suspected_intent=F.concat(F.lit("intent "), n % 11), kill_chain_stage=F.concat(F.lit("stage-"), n % 5), confidence=share).alias("intent"),
        part(n % 2 == 0, technique_id=F.concat(F.lit("T"), n % 9), technique_name=F.concat(F.lit("Technique "), n % 9), tactic=tactic, confidence=F.lit(0.9)).alias("mitre"),
        part(n % 5 == 0, priority=F.element_at(F.array(*map(F.lit, PRIORITIES)), (n % 25 / 5 + 1).cast("int")), risk_reason=F.lit("seen often"), recommended_action=F.concat(F.lit("action "), n % 13), executive_summary=F.when(n % 2 == 0, F.concat(F.lit("summary "), n)).otherwise(""), confidence=F.lit(0.7)).alias("triage"),
    )
    path = new_folder(spark, "outputs")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _rounded(c: str) -> F.Column:
    """Six decimals; a hair more, so that halves go up in whatever order a mean was summed."""
    return F.round(F.col(c) + 1e-10, 6)


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ";") for c in columns})


def analysis_file_summaries(spark: SparkSession, sf: str) -> DataFrame:
    out = outputs.file_summary(_outputs(spark, sf)).withColumn("avg_confidence", _rounded("avg_confidence"))
    return _joined(out, *outputs.VALUES, "interpretations", "summaries", "techniques")


def analysis_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.from_outputs(_outputs(spark, sf)).drop("incident_id").withColumn("confidence", _rounded("confidence"))


def merged_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(outputs.merged(_outputs(spark, sf)), "hosts").drop("incident_id").withColumn("confidence", _rounded("confidence"))


def incident_members(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.members(_outputs(spark, sf)).groupBy("incident_id").agg(F.count("*").alias("outputs"), F.count_distinct("file_id").alias("files"), F.min("at").alias("first_at"), F.count_distinct("description").alias("descriptions"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (analysis_file_summaries, analysis_incidents, merged_incidents, incident_members)}


def _indicator(t: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({t}), 'url|uri|path') THEN 'url' WHEN regexp_matches(lower({t}), 'referer|referrer') THEN 'referer' WHEN regexp_matches(lower({t}), 'user agent|user_agent') THEN 'user_agent'
    WHEN regexp_matches(lower({t}), 'payload|injection|command') THEN 'payload' WHEN regexp_matches(lower({t}), 'ip|scanner|recon') THEN 'source ip' ELSE 'null' END"""


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"'{p}'" for p in PRIORITIES)
    base = f"""{oracle.CHUNKS}, o AS (
  SELECT entity || '-' || window_start AS analysis_id, entity || ':' || window_start AS chunk_id, 'file-' || (window_start // 900000000) AS file_id, entity AS src_ip, window_start, window_end, ports,
    CASE WHEN events % 7 <> 0 THEN pattern || ' requests to port ' || ports[1] END AS said, CASE WHEN events % 7 <> 0 THEN denied > 0 END AS odd, CASE WHEN events % 7 <> 0 THEN round(1 - round(denied / events, 3), 3) END AS cb,
    CASE WHEN events % 7 <> 0 THEN ['port ' || ports[1], pattern] END AS hints, CASE WHEN events % 3 = 0 THEN 'intent ' || (events % 11) END AS intent, CASE WHEN events % 3 = 0 THEN 'stage-' || (events % 5) END AS stage,
    CASE WHEN events % 3 = 0 THEN round(denied / events, 3) END AS ci, CASE WHEN events % 2 = 0 THEN 'T' || (events % 9) END AS tid, CASE WHEN events % 2 = 0 THEN 'Technique ' || (events % 9) END AS tname,
    CASE WHEN events % 2 = 0 THEN 'tactic-' || (events % 4) END AS tactic, CASE WHEN events % 2 = 0 THEN 0.9 END AS cm, CASE WHEN events % 5 = 0 THEN list_extract([{names}], CAST(events % 25 // 5 + 1 AS INT)) END AS told,
    CASE WHEN events % 5 = 0 THEN 'action ' || (events % 13) END AS advice, CASE WHEN events % 5 = 0 THEN CASE WHEN events % 2 = 0 THEN 'summary ' || events ELSE '' END END AS summary, CASE WHEN events % 5 = 0 THEN 0.7 END AS ct
  FROM chunks WHERE strategy = 'src_ip'
), k AS (SELECT *, coalesce(list_avg([cb, ci, cm, ct]), 0) AS conf FROM o
), d AS (SELECT *, coalesce(told, CASE WHEN conf >= 0.8 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END) AS priority FROM k)"""
    score = lambda c: f"CAST(greatest(1, least(10, round_even(round({c}, 9) * 10, 0))) AS INT)"
    some = lambda c, n: f"coalesce(array_to_string(list_sort(list_distinct(list({c}) FILTER ({c} <> ''))){n}, ';'), '')"
    first = lambda c, n, has: f"(list({c} ORDER BY window_start, analysis_id) FILTER ({has} IS NOT NULL))[1:{n}]"
    title = "CASE WHEN odd THEN substr(said, 1, 50) ELSE 'Behavioral anomaly detected' END || ' from ' || coalesce(nullif(src_ip, ''), 'Unknown actor')"
    return {
        "analysis_file_summaries": f"""{base}, h AS (SELECT file_id, array_to_string(list_sort(list_distinct(list(hint)))[1:10], ';') AS key_indicators FROM (SELECT file_id, unnest(hints) AS hint FROM d) WHERE hint <> '' GROUP BY file_id
), s AS (
  SELECT file_id, count(*) AS chunks, round(avg(conf) + 1e-10, 6) AS avg_confidence, count(said) AS behavioral, count(intent) AS intent, count(tid) AS mitre, count(told) AS triage, count(*) FILTER (odd) AS suspicious,
    {some("intent", "[1:5]")} AS intents, {some("stage", "")} AS stages, {some("tactic", "")} AS tactics, {some("told", "")} AS priorities, {some("advice", "[1:5]")} AS actions,
    coalesce(array_to_string({first("said", 3, "said")}, ';'), '') AS interpretations, coalesce(array_to_string(list_filter({first("summary", 3, "summary")}, lambda x: x <> ''), ';'), '') AS summaries,
    coalesce(array_to_string({first("tid || '|' || tname || '|' || tactic", 10, "tid")}, ';'), '') AS techniques FROM d GROUP BY file_id
) SELECT s.*, coalesce(key_indicators, '') AS key_indicators FROM s LEFT JOIN h USING (file_id)""",
        "analysis_incidents": f"""{base}, t AS (
  SELECT *, {title} AS title, concat_ws(chr(10), 'Behavior: ' || said, 'Suspected intent: ' || intent, 'MITRE mapping: ' || tname || ' (' || tid || ')', CASE WHEN told IS NOT NULL THEN 'Risk: seen often' END) AS description FROM d
) SELECT 'ai_detection' AS source, analysis_id, chunk_id, file_id, src_ip, title, description, priority, 'new' AS status, told IS NOT NULL OR coalesce(odd, priority <> 'informational') AS suspicious, round(conf + 1e-10, 6) AS confidence, {score("conf")} AS score,
  {_indicator("concat_ws(' ', title, description, intent, tname)")} AS indicator, coalesce(intent, tname, title) AS attack, substr(coalesce(said, description), 1, 260) AS brief,
  coalesce(advice, 'Investigate and validate findings.') AS action, tid AS technique_id, tactic, window_start AS first_seen, window_end AS last_seen FROM t""",
        "merged_incidents": f"""{base}, m AS (
  SELECT src_ip, count(*) AS activities, count(DISTINCT file_id) AS files, avg(conf) AS conf, max(list_position([{names}], priority)) AS p, arg_min(struct_pack(said, intent, tid, tactic, advice), struct_pack(window_start, analysis_id)) AS f,
    min(window_start) AS first_seen, arg_max(window_end, struct_pack(window_start, analysis_id)) AS last_seen, CASE WHEN count(DISTINCT tactic) = 1 THEN min(tactic) END AS primary_tactic FROM d GROUP BY src_ip
), hosts AS (SELECT src_ip, array_to_string(list_sort(list_distinct(list(host)))[1:50], ';') AS hosts FROM (SELECT src_ip, 'host-' || unnest(ports) AS host FROM d) GROUP BY src_ip
), t AS (SELECT *, 'Multi-event incident: ' || activities || ' related activities' AS title, list_extract([{names}], p) AS priority FROM m LEFT JOIN hosts USING (src_ip))
SELECT 'correlation' AS source, src_ip, title, 'Correlated incident spanning ' || activities || ' behavioral chunks' AS description, priority, 'new' AS status, priority <> 'informational' AS suspicious, round(conf + 1e-10, 6) AS confidence, {score("conf")} AS score,
  activities, files, coalesce(hosts, '') AS hosts, {_indicator("concat_ws(' ', title, f.said)")} AS indicator, coalesce(f.intent, title) AS attack, substr(coalesce(f.said, title), 1, 260) AS brief,
  coalesce(f.advice, 'Investigate correlated sequence.') AS action, f.tid AS technique_id, coalesce(f.tactic, primary_tactic) AS tactic, primary_tactic, first_seen, last_seen FROM t""",
        "incident_members": f"""{base} SELECT md5('correlation|' || src_ip) AS incident_id, count(*) AS outputs, count(DISTINCT file_id) AS files, min(window_start) AS first_at,
  count(DISTINCT coalesce(said, 'Activity detected')) AS descriptions FROM d GROUP BY src_ip""",
    }
