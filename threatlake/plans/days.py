"""Queries over the day state, which is built from the events in four batches a day, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.operators import day_state, detect
from threatlake.plans import oracle
from threatlake.plans.adapter import EV, events
from threatlake.sources.state_store import DayStateStore
from threatlake.sources.workspace import new_folder, written

KEYS = ("day", "quarter")


def _store(spark: SparkSession, sf: str) -> DayStateStore:
    """The events' state, merged in four batches one after the other."""
    e = events(spark, sf).withColumns({"day": F.to_date("event_ts"), "quarter": F.floor(F.hour("event_ts") / 6).cast("int")})
    parts = written(day_state.parts(e, detect.threats(detect.all_matches(e, keys=KEYS), KEYS), KEYS), "quarters")
    store = DayStateStore(spark, new_folder(spark, "state"))
    for q in range(4):
        store.update(f"q{q}", parts.where(F.col("quarter") == q).drop("quarter"))
    return store


def _text(c: str, sep: str = ",") -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), sep).alias(c)


def _pairs(c: str) -> F.Column:
    pair = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), pair), ",").alias(c)


def _day() -> F.Column:
    return F.col("day").cast("string").alias("day")


def actor_day_state(spark: SparkSession, sf: str) -> DataFrame:
    a = _store(spark, sf).actors()
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return a.select(
        _day(), "src_ip", F.col("batches").cast("bigint").alias("batches"), "requests", _pairs("statuses"), "auth_failures", "auth_successes", "unique_uris", clock("first_seen"), clock("last_seen"),
        _text("signatures"), _text("categories"), F.array_join(F.transform("timeline", lambda x: F.concat(x["rule_name"], F.lit(":"), x["batch"].cast("string"))), ",").alias("timeline"),
        _text("agents", "|"), F.array_join(F.transform("rates", lambda x: F.concat(x["batch"].cast("string"), F.lit(":"), x["requests"].cast("string"))), ",").alias("rates"), F.round("threat_score", 9).alias("threat_score"),
    )


def corr_new_findings(spark: SparkSession, sf: str) -> DataFrame:
    f = _store(spark, sf).findings()
    return f.select(_day(), "src_ip", "correlation_rule", "category", "severity", "confidence", "description", F.col("number").cast("bigint").alias("number"))


def day_reports(spark: SparkSession, sf: str) -> DataFrame:
    s = _store(spark, sf)
    r = day_state.day_reports(s.actors(), s.commits())
    return r.select(_day(), F.col("batches").cast("bigint").alias("batches"), "events", "sources", "attackers", "high_risk", _pairs("by_category"), _pairs("by_hour"))


def high_risk_actors(spark: SparkSession, sf: str) -> DataFrame:
    h = day_state.high_risk(_store(spark, sf).actors().withColumn("threat_score", F.round("threat_score", 9)))
    return h.select(_day(), "src_ip", "threat_score", _text("categories"), F.col("place").cast("bigint").alias("place")).orderBy("day", "place")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (actor_day_state, corr_new_findings, day_reports, high_risk_actors)}


_EVENTS = EV.replace("CAST(ts AS DATE) AS batch", "CAST(ts AS DATE) AS day, hour(ts) // 6 AS batch")
_SEVERITY = "CASE severity WHEN 'critical' THEN 0.3 WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.1 WHEN 'low' THEN 0.05 WHEN 'info' THEN 0.02 END"
#: The state after each batch of each day (`upto`), each from all rows up to it and in one pass.
STATES = f"""WITH RECURSIVE {_EVENTS}, {oracle._RATES.format(k="day, batch, ")}, {oracle.RULES}, numbers AS (
  SELECT day, batch, dense_rank() OVER (PARTITION BY day ORDER BY batch) AS number, count(*) AS events FROM ev GROUP BY day, batch
), found AS (
  SELECT CAST(event_ts AS DATE) AS day, batch, src_ip, rule_name, 0 AS phase, row_number, event_ts FROM ({oracle._matches(oracle.rules.FAMILIES)})
  UNION ALL SELECT day, batch, src_ip, rule_name, 1, row_number, event_ts FROM rates
), threats AS (
  SELECT * FROM (SELECT day, batch, src_ip, rule_name, count(*) AS match_count, min(event_ts) AS first_seen, min(phase * 1000000000000 + row_number) AS pos FROM found GROUP BY ALL)
  JOIN rules USING (rule_name) JOIN numbers USING (day, batch)
), entries AS (
  SELECT *, row_number() OVER (PARTITION BY day, src_ip
    ORDER BY batch, list_position(['critical', 'high', 'medium', 'low', 'info'], severity), -match_count, pos, rule_name) AS k FROM threats
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY day, src_ip, category ORDER BY k) = 1 AS new, row_number() OVER (PARTITION BY day, src_ip, rule_name ORDER BY k) = 1 AS new_rule FROM entries
), running AS (
  SELECT *, count(*) FILTER (new) OVER (PARTITION BY day, src_ip ORDER BY k ROWS UNBOUNDED PRECEDING) AS kinds FROM firsts
), upto AS (SELECT day, number AS upto FROM numbers
), folded AS (
  SELECT r.day, upto, src_ip, least(1, sum({_SEVERITY} * CASE WHEN kinds >= 3 THEN 1.5 ELSE 1 END))::DOUBLE AS threat_score, list(category ORDER BY k) FILTER (new) AS categories,
    list(rule_name ORDER BY k) FILTER (new_rule) AS signatures, list(rule_name || ':' || number ORDER BY k)[1:200] AS timeline, count(*) FILTER (k <= 200 AND hour(first_seen) < 6) AS night
  FROM running r JOIN upto u ON u.day = r.day AND number <= upto GROUP BY ALL
), per_batch AS (
  SELECT day, number, src_ip, count(*) AS requests, count(*) FILTER (http_status = 401) AS auth_failures, count(*) FILTER (http_status = 200) AS auth_successes,
    count(DISTINCT uri_path) AS unique_uris, arg_min(event_ts, row_number) AS first_seen, arg_max(event_ts, row_number) AS last_seen
  FROM ev JOIN numbers USING (day, batch) GROUP BY ALL
), sums AS (
  SELECT p.day, upto, src_ip, count(*) AS batches, sum(requests)::BIGINT AS requests, sum(auth_failures)::BIGINT AS auth_failures, sum(auth_successes)::BIGINT AS auth_successes,
    sum(unique_uris)::BIGINT AS unique_uris, min(first_seen) AS first_seen, max(last_seen) AS last_seen, list(requests ORDER BY number) AS rates, list(number || ':' || requests ORDER BY number) AS rate_texts
  FROM per_batch p JOIN upto u ON u.day = p.day AND number <= upto GROUP BY ALL
), agents AS (
  SELECT day, src_ip, user_agent, min(number) AS number, min(number * 1000000000000 + row_number) AS pos FROM ev JOIN numbers USING (day, batch) GROUP BY ALL
), agent_lists AS (
  SELECT a.day, upto, src_ip, list(user_agent ORDER BY pos)[1:50] AS agents FROM agents a JOIN upto u ON u.day = a.day AND number <= upto GROUP BY ALL
), counted AS (
  SELECT day, number, src_ip, http_status, count(*) AS n FROM ev JOIN numbers USING (day, batch) GROUP BY ALL
), statuses AS (
  SELECT day, upto, src_ip, string_agg(http_status || ':' || n, ',' ORDER BY http_status) AS statuses
  FROM (SELECT c.day, upto, src_ip, http_status, sum(n)::BIGINT AS n FROM counted c JOIN upto u ON u.day = c.day AND number <= upto GROUP BY ALL) GROUP BY ALL
), actors AS (
  SELECT s.*, coalesce(f.threat_score, 0) AS threat_score, coalesce(f.categories, []) AS categories, coalesce(f.signatures, []) AS signatures, coalesce(f.timeline, []) AS timeline,
    coalesce(f.night, 0) AS night, a.agents, len(list_filter(a.agents, lambda x: regexp_matches(lower(x), '{oracle.state.SCANNERS}'))) > 0 AS scanner, t.statuses
  FROM sums s JOIN agent_lists a USING (day, upto, src_ip) JOIN statuses t USING (day, upto, src_ip) LEFT JOIN folded f USING (day, upto, src_ip)
), latest AS (SELECT a.* FROM actors a JOIN (SELECT day, max(upto) AS upto FROM upto GROUP BY day) USING (day, upto))"""


def oracle_sql() -> dict[str, str]:
    found = " UNION ALL ".join(
        f"SELECT day, upto, src_ip, '{r}' AS correlation_rule, '{c}' AS category, '{s}' AS severity, {p}::DOUBLE AS confidence, {d} AS description FROM actors WHERE {w}" for r, c, s, p, w, d in oracle._FINDINGS
    )
    return {
        "actor_day_state": f"""{STATES} SELECT CAST(day AS VARCHAR) AS day, src_ip, batches, requests, statuses, auth_failures, auth_successes, unique_uris,
  strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, array_to_string(signatures, ',') AS signatures,
  array_to_string(categories, ',') AS categories, array_to_string(timeline, ',') AS timeline, array_to_string(agents, '|') AS agents, array_to_string(rate_texts, ',') AS rates,
  round(threat_score, 9) AS threat_score FROM latest""",
        "corr_new_findings": f"""{STATES}, findings AS ({found})
SELECT CAST(day AS VARCHAR) AS day, src_ip, correlation_rule, category, severity, confidence, arg_min(description, upto) AS description, min(upto) AS number FROM findings GROUP BY ALL""",
        "day_reports": f"""{STATES}, per_day AS (SELECT day, max(number) AS batches, sum(events)::BIGINT AS events FROM numbers GROUP BY day
), kinds AS (SELECT day, string_agg(c || ':' || n, ',' ORDER BY c) AS by_category FROM (SELECT day, c, count(*) AS n FROM (SELECT day, unnest(categories) AS c FROM latest) GROUP BY ALL) GROUP BY day
), hours AS (SELECT day, string_agg(h || ':' || n, ',' ORDER BY h) AS by_hour FROM (SELECT day, strftime(first_seen, '%Y-%m-%d %H') AS h, count(*) AS n FROM running WHERE k <= 200 GROUP BY ALL) GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, batches, events, count(*) AS sources, count(*) FILTER (len(signatures) > 0) AS attackers, count(*) FILTER (threat_score >= 0.5) AS high_risk,
  any_value(by_category) AS by_category, any_value(by_hour) AS by_hour
FROM per_day JOIN (SELECT day, src_ip, signatures, threat_score FROM latest) USING (day) LEFT JOIN kinds USING (day) LEFT JOIN hours USING (day) GROUP BY day, batches, events""",
        "high_risk_actors": f"""{STATES} SELECT CAST(day AS VARCHAR) AS day, src_ip, round(threat_score, 9) AS threat_score, array_to_string(categories, ',') AS categories,
  row_number() OVER (PARTITION BY day ORDER BY round(threat_score, 9) DESC, src_ip) AS place FROM latest WHERE round(threat_score, 9) >= 0.5 ORDER BY day, place""",
    }
