"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from threatlake.operators import chunks, incidents, mitre, rules, state
from threatlake.plans.adapter import EV

quoted = lambda s: "'" + s.replace("'", "''") + "'"
values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _signature(rule: rules.Rule) -> str:
    if rule.name == "http_param_pollution":  # RE2 has no back-references
        names = "list_transform(regexp_extract_all({0}, '[?&](\\w+)=', 1), lambda x: lower(x))"
        cond = {f: f"len({names.format(f)}) > len(list_distinct({names.format(f)}))" for f in rule.fields}
    else:
        pattern = "|".join(f"(?:{p})" for p in rule.patterns).replace("(?!/)", "([^/]|$)")
        cond = {f: f"regexp_matches({f}, {quoted(pattern)}, 'i')" for f in rule.fields}
    cond = {f: f"(coalesce({f}, '') <> '' AND {c})" for f, c in cond.items()}
    gate = "(http_status IS NULL OR http_status BETWEEN 200 AND 399) AND " if rule.family in rules.SUCCESS_ONLY else ""
    return (
        f"SELECT row_number, event_id, event_ts, src_ip, batch, '{rule.name}' AS rule_name, CASE {' '.join(f'WHEN {c} THEN {quoted(f)}' for f, c in cond.items())} END AS matched_field, "
        f"CASE {' '.join(f'WHEN {c} THEN substr({f}, 1, 200)' for f, c in cond.items())} END AS evidence FROM ev WHERE {gate}({' OR '.join(cond.values())})"
    )


_HEAD = "SELECT row_number, event_id, event_ts, src_ip, batch, "
_ADMIN = " OR ".join(f"starts_with(lower(uri_path), '{p}')" for p in rules.ADMIN_PATHS)
_EXPORT = " OR ".join(f"contains(lower(uri_path), '{p}')" for p in rules.EXPORT_PATHS)
_SURFACE = "concat_ws(' ', nullif(uri_query, ''), nullif(original_message, ''))"
_TARGET = f"regexp_extract({_SURFACE}, {quoted('(?i)' + rules.REDIRECTS)}, 1)"
_HOST = f"lower(regexp_extract({_TARGET}, '^https?://([^/?#:]*)', 1))"
CODED = {
    "jwt_manipulation": _signature(rules.Rule("jwt_manipulation", "", "auth_access", "", 0.0, "", rules.PQM, (rules.JWT,))),
    "csrf_indicator": f"{_HEAD}'csrf_indicator' AS rule_name, 'referrer' AS matched_field, http_method || ' cross-origin from ' || substr(referrer, 1, 100) || ' with missing token' AS evidence FROM ev "
    f"WHERE http_method = 'POST' AND starts_with(referrer, 'http') AND NOT regexp_matches(referrer, '^https?://([^/]*[.])?corp[.]example(/|$)') AND NOT regexp_matches({_SURFACE}, '{rules.TOKENS}', 'i')",
    "broken_function_auth": f"{_HEAD}'broken_function_auth' AS rule_name, 'uri_path' AS matched_field, '200 OK on admin path: ' || substr(lower(uri_path), 1, 100) AS evidence FROM ev WHERE http_status BETWEEN 200 AND 299 AND ({_ADMIN})",
    "error_detail_disclosure": f"{_HEAD}'error_detail_disclosure' AS rule_name, 'http_status' AS matched_field, 'HTTP ' || http_status || ' with ' || bytes_sent || 'B response' AS evidence FROM ev WHERE http_status >= 500 AND bytes_sent > 5000",
    "data_exfiltration_pattern": f"{_HEAD}'data_exfiltration_pattern' AS rule_name, 'uri_path' AS matched_field, 'Large response (' || bytes_sent || 'B) from ' || substr(lower(uri_path), 1, 80) AS evidence FROM ev WHERE bytes_sent > 100000 AND ({_EXPORT})",
    "open_redirect": f"{_HEAD}'open_redirect' AS rule_name, 'uri_query' AS matched_field, 'Open redirect to external target: ' || substr({_TARGET}, 1, 100) AS evidence FROM ev "
    f"WHERE starts_with({_TARGET}, '//') OR ({_HOST} <> '' AND {_HOST} NOT IN ('localhost', '127.0.0.1', '0.0.0.0') AND NOT regexp_matches({_HOST}, '^(10|127|169[.]254|192[.]168)[.]'))",
}


def _matches(families: list[str]) -> str:
    return "\nUNION ALL ".join([*(_signature(r) for r in rules.RULES if r.family in families), *(CODED[r.name] for r in rules.CODED if r.family in families)])


_LOGIN = " OR ".join(f"contains(lower(uri_path), '{p}')" for p in rules.LOGIN_PATHS)
_HINTS = " OR ".join(f"contains(lower(uri_path), '{p}')" for p in rules.AUTH_HINTS)
_LAST = {
    "all": "true", "login": f"http_status = 401 OR (http_status = 403 AND ({_LOGIN}))", "s401": "http_status = 401", "auth": f"http_status IN (401, 403) AND ({_HINTS} OR coalesce(username, '') <> '')",
    "s404": "http_status = 404", "s200": "http_status = 200", "ok": "http_status BETWEEN 200 AND 299", "s429": "http_status = 429", "other": "http_status <> 429", "costly": f"regexp_matches(lower(uri_path), '{rules.EXPENSIVE}')",
}
_PRIVATE = "(starts_with(src_ip, '10.') OR starts_with(src_ip, '192.168.') OR starts_with(src_ip, '127.'))"


def _rate(name: str, when: str, last: str, field: str, uri: bool, evidence: str) -> str:
    return f"SELECT {{k}}src_ip, '{name}' AS rule_name, '{field}' AS matched_field, {evidence} AS evidence, last_{last}.row_number AS row_number, last_{last}.event_id AS event_id, last_{last}.event_ts AS event_ts, {f'last_{last}.uri_path' if uri else 'NULL'} AS uri FROM sources WHERE {when}"


_RATES = f"""sources AS (
  SELECT {{k}}src_ip, {", ".join(f"count(*) FILTER ({c}) AS n_{k}, max({{{{'row_number': row_number, 'event_id': event_id, 'event_ts': event_ts, 'uri_path': uri_path}}}}) FILTER ({c}) AS last_{k}" for k, c in _LAST.items())},
    count(DISTINCT uri_path) AS paths, count(DISTINCT uri_path) FILTER (http_status = 404) AS paths_404, count(DISTINCT uri_path) FILTER (http_status BETWEEN 200 AND 299) AS paths_ok
  FROM ev GROUP BY {{k}}src_ip
), api AS (
  SELECT {{k}}src_ip, arg_min(api, pos) AS api, arg_min(n, pos) AS n, arg_min(last, pos) AS last FROM (
    SELECT {{k}}src_ip, lower(uri_path) AS api, count(*) AS n, min(row_number) AS pos, max({{{{'row_number': row_number, 'event_id': event_id, 'event_ts': event_ts, 'uri_path': uri_path}}}}) AS last
    FROM ev WHERE contains(lower(uri_path), '/api/') GROUP BY {{k}}src_ip, lower(uri_path) HAVING count(*) >= 300) GROUP BY {{k}}src_ip
), rates AS (
  {_rate("brute_force_login", "n_login >= 10", "login", "http_status", False, "n_login || ' auth failures from ' || src_ip")}
  UNION ALL {_rate("credential_stuffing", "n_s401 >= 20", "s401", "http_status", False, "n_s401 || ' 401 responses from ' || src_ip")}
  UNION ALL {_rate("authentication_failures", "n_auth >= 8", "auth", "http_status", False, "n_auth || ' authentication failures from ' || src_ip")}
  UNION ALL {_rate("rapid_404_generation", f"NOT {_PRIVATE} AND n_s200 <= 1 AND paths_404 >= 50", "s404", "http_status", True, "paths_404 || ' unique 404s from ' || src_ip || ' on ' || last_s404.uri_path || ' (successes: ' || n_s200 || ')'")}
  UNION ALL {_rate("content_scraping", f"NOT {_PRIVATE} AND paths_ok >= 200", "ok", "uri_path", True, "paths_ok || ' unique URIs from ' || src_ip || ' (sample: ' || last_ok.uri_path || ')'")}
  UNION ALL {_rate("http_flood", "n_all >= 500", "all", "rate", True, "n_all || ' requests from ' || src_ip || ' in batch (target: ' || last_all.uri_path || ')'")}
  UNION ALL {_rate("rate_limiting_bypass_after_429", "n_all >= 60 AND n_s429 >= 3 AND n_other >= 60", "all", "http_status", True, "n_all || ' requests with ' || n_s429 || ' HTTP 429 responses from ' || src_ip || ' (target: ' || last_all.uri_path || ')'")}
  UNION ALL {_rate("slowloris_suspected", f"NOT {_PRIVATE} AND src_ip <> '-' AND paths >= 100", "all", "uri_path", True, "'Slowloris suspected: ' || paths || ' unique URIs hit from public IP ' || src_ip")}
  UNION ALL SELECT {{k}}src_ip, 'api_rate_abuse', 'uri_path', 'API rate abuse from ' || src_ip || ' targeting ' || api || ' (' || n || ' requests)', last.row_number, last.event_id, last.event_ts, last.uri_path FROM api
  UNION ALL {_rate("resource_exhaustion", "n_costly >= 30", "costly", "uri_path", True, "n_costly || ' expensive endpoint hits from ' || src_ip || ' (last: ' || last_costly.uri_path || ')'")}
)"""
RATES = _RATES.format(k="")
RULES = f"rules(rule_name, category, family, severity, confidence) AS (VALUES {values((r.name, r.category, r.family, r.severity, r.confidence) for r in rules.EVERY.values())})"
THREATS = f"""WITH RECURSIVE {EV}, {RATES}, {RULES}, found AS (
  SELECT src_ip, rule_name, row_number, event_id, event_ts, evidence, batch FROM ({_matches(rules.FAMILIES)})
  UNION ALL SELECT src_ip, rule_name, row_number, event_id, event_ts, evidence, NULL FROM rates
), firsts AS (SELECT src_ip, rule_name, evidence, min(row_number) AS pos FROM found GROUP BY ALL
), said AS (SELECT src_ip, rule_name, array_to_string(list(evidence ORDER BY pos)[1:5], ' || ') AS sample_evidence FROM firsts GROUP BY ALL
), grouped AS (SELECT src_ip, rule_name, count(*) AS match_count, min(event_ts) AS first_seen, max(event_ts) AS last_seen, len(list(event_id)[1:100]) AS n_ids FROM found GROUP BY ALL
), threats AS (SELECT * FROM grouped JOIN said USING (src_ip, rule_name) JOIN rules USING (rule_name))"""
#: The same by source, rule and batch; rate rules count within a batch.
BATCHES = f"""WITH RECURSIVE {EV}, {_RATES.format(k="batch, ")}, {RULES}, found AS (
  SELECT batch, src_ip, rule_name, 0 AS phase, row_number, event_ts FROM ({_matches(rules.FAMILIES)}) UNION ALL SELECT batch, src_ip, rule_name, 1, row_number, event_ts FROM rates
), threats AS (
  SELECT * FROM (SELECT batch, src_ip, rule_name, count(*) AS match_count, min(event_ts) AS first_seen, min(phase * 1000000000000 + row_number) AS pos FROM found GROUP BY ALL) JOIN rules USING (rule_name)
), entries AS (
  SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY batch, list_position(['critical', 'high', 'medium', 'low', 'info'], severity), -match_count, pos, rule_name) AS k FROM threats
), firsts AS (SELECT *, row_number() OVER (PARTITION BY src_ip, category ORDER BY k) = 1 AS new FROM entries
), running AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY src_ip ORDER BY k ROWS UNBOUNDED PRECEDING) AS kinds FROM firsts
), folded AS (
  SELECT src_ip, least(1, sum(CASE severity WHEN 'critical' THEN 0.3 WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.1 WHEN 'low' THEN 0.05 WHEN 'info' THEN 0.02 END * CASE WHEN kinds >= 3 THEN 1.5 ELSE 1 END))::DOUBLE AS threat_score,
    list(category ORDER BY k) FILTER (new) AS categories, count(*) FILTER (k <= 200 AND hour(first_seen) < 6) AS night FROM running GROUP BY src_ip
), per_batch AS (
  SELECT batch, src_ip, count(*) AS requests, count(*) FILTER (http_status = 401) AS auth_failures, count(*) FILTER (http_status = 200) AS auth_successes, count(DISTINCT uri_path) AS unique_uris FROM ev GROUP BY ALL
), agents AS (SELECT src_ip, bool_or(regexp_matches(lower(user_agent), '{state.SCANNERS}')) AS scanner FROM ev GROUP BY src_ip
), sums AS (
  SELECT src_ip, count(*) AS batches, sum(requests)::BIGINT AS requests, sum(auth_failures)::BIGINT AS auth_failures, sum(auth_successes)::BIGINT AS auth_successes, sum(unique_uris)::BIGINT AS unique_uris, list(requests ORDER BY batch) AS rates FROM per_batch GROUP BY src_ip
), actors AS (SELECT s.*, f.threat_score, coalesce(f.categories, []) AS categories, coalesce(f.night, 0) AS night, a.scanner FROM sums s JOIN agents a USING (src_ip) LEFT JOIN folded f USING (src_ip))"""
_FAN = " UNION ALL ".join(f"SELECT *, '{s}' AS strategy, {e} AS entity, CAST({chunks.STRATEGIES[s] * 60_000_000} AS BIGINT) AS width FROM ev WHERE {e} IS NOT NULL" for s, e in (("src_ip", "src_ip"), ("dst_host", "coalesce(dst_host, dst_ip)"), ("user", "username")))
CHUNKS = f"""WITH RECURSIVE {EV}, fan AS ({_FAN}), starts AS (
  SELECT strategy, entity, width, min(t_us) AS s FROM fan GROUP BY ALL
  UNION SELECT s.strategy, s.entity, s.width, min(f.t_us) FROM starts s JOIN fan f ON f.strategy = s.strategy AND f.entity = s.entity AND f.t_us > s.s + s.width GROUP BY s.strategy, s.entity, s.width, s.s
), placed AS (SELECT f.*, s.s AS window_start FROM fan f ASOF JOIN starts s ON f.strategy = s.strategy AND f.entity = s.entity AND f.t_us >= s.s
), profile AS (
  SELECT strategy, entity, window_start, max(t_us) AS window_end, count(*) AS events, count(*) FILTER (action = 'ALLOW') AS allowed, count(*) FILTER (action = 'DENY') AS denied, count(DISTINCT src_ip) AS sources,
    count(DISTINCT dst_ip) + count(DISTINCT dst_host) AS targets, list_sort(list_distinct(list(dst_port)))[1:20] AS ports, sum(bytes_sent) AS bytes_sent, list(t_us ORDER BY t_us) AS ts FROM placed GROUP BY ALL
), intervals AS (SELECT *, list_transform(range(2, len(ts) + 1), lambda i: (ts[i] - ts[i - 1]) / 1e6) AS x, denied / events AS failure_rate, CASE WHEN window_end > window_start AND events > 1 THEN events / ((window_end - window_start) / 60e6) ELSE events END AS per_minute FROM profile
), measured AS (SELECT *, len(x) AS n, coalesce(list_avg(x), 0) AS average, coalesce(list_avg(x[1:len(x) // 2]), 0) AS h1, coalesce(list_avg(x[len(x) // 2 + 1:]), 0) AS h2, list_sort(x)[len(x) // 2 + 1] AS median,
    coalesce(list_avg(x[1:len(x) // 3]), 0) AS t1, coalesce(list_avg(x[len(x) - CAST(ceil(len(x) / 3) AS BIGINT) + 1:]), 0) AS t3, coalesce(sqrt(list_var_pop(x)), 0) AS deviation FROM intervals
), chunks AS (SELECT *, CASE WHEN n < 2 THEN 'random' WHEN len(list_filter(x, lambda v: v < 5)) > n * 0.7 THEN CASE WHEN h1 < h2 * 0.5 THEN 'bursty_then_idle' WHEN h2 < h1 * 0.5 THEN 'idle_then_bursty' ELSE 'bursty' END
    WHEN CASE WHEN average > 0 THEN deviation / average ELSE 0 END < 0.5 THEN 'steady' WHEN n >= 5 AND len(list_filter(x, lambda v: abs(v - median) < median * 0.3)) > n * 0.6 THEN 'periodic'
    WHEN n >= 4 AND t3 < t1 * 0.5 THEN 'escalating' WHEN n >= 4 AND t1 < t3 * 0.5 THEN 'declining' ELSE 'random' END AS pattern FROM measured
), suspicious AS (SELECT * FROM chunks WHERE events >= 10 AND (failure_rate >= 0.3 OR targets >= 3 OR (len(list_intersect(ports, {chunks.SUSPICIOUS_PORTS})) > 0 AND denied > 0) OR (pattern IN ('bursty', 'escalating') AND per_minute > 10)))"""
CHUNK_COLUMNS = "strategy, entity, window_start, window_end, events, allowed, denied, sources, targets, array_to_string(ports, ',') AS ports, CAST(bytes_sent AS BIGINT) AS bytes_sent, round(failure_rate, 9) AS failure_rate, round(per_minute, 6) AS per_minute, pattern"
_GUESS = f"by_rule(rule_name, technique_id, mitre_confidence) AS (VALUES {values((k, *v) for k, v in mitre.BY_RULE.items())}), by_family(family, technique_id, mitre_confidence) AS (VALUES {values((k, *v) for k, v in mitre.BY_FAMILY.items())})"
_TECH = f"techniques(technique_id, technique, tactic, parent) AS (VALUES {values(mitre.TECHNIQUES)})"
_MAPPED = f"{_GUESS}, {_TECH}, mapped AS (SELECT t.*, coalesce(r.technique_id, f.technique_id) AS technique_id, coalesce(r.mitre_confidence, f.mitre_confidence) AS mitre_confidence FROM threats t LEFT JOIN by_rule r USING (rule_name) LEFT JOIN by_family f USING (family))"
_STATS = "stats AS (SELECT batch, src_ip, count(*) AS requests, count(*) FILTER (http_status = 401) AS auth_failures, count(*) FILTER (http_status = 200) AS auth_successes, count(DISTINCT uri_path) AS unique_uris, arg_min(event_ts, row_number) AS first_seen, arg_max(event_ts, row_number) AS last_seen FROM ev GROUP BY ALL)"
_SCANNERS = state.SCANNERS


def oracle_sql() -> dict[str, str]:
    out = {f"rule_matches_{f}": f"WITH {EV} SELECT event_id, src_ip, rule_name, matched_field, evidence FROM ({_matches([f])})" for f in rules.FAMILIES}
    out |= {
        "rate_rules": f"WITH {EV}, {RATES} SELECT src_ip, rule_name, matched_field, evidence, event_id, uri FROM rates",
        "threat_groups": f"{THREATS} SELECT src_ip, rule_name, category, family, severity, confidence, match_count, first_seen, last_seen, sample_evidence, n_ids FROM threats",
        "threats_by_category": f"{THREATS} SELECT category, count(*) AS threats, array_to_string(list_sort(list(DISTINCT src_ip)), ',') AS sources FROM threats GROUP BY category",
        "threats_by_severity": f"{THREATS} SELECT severity, count(*) AS threats, CAST(sum(match_count) AS BIGINT) AS matches FROM threats GROUP BY severity",
        "attacker_ips": f"{THREATS} SELECT DISTINCT src_ip FROM threats",
        "ai_need": f"{THREATS}, s AS (SELECT count(*) AS threats, count(*) FILTER (confidence < 0.6) AS weak, CAST(sum(match_count) AS BIGINT) AS matches FROM threats) SELECT (SELECT count(*) FROM ev) AS events, threats, matches, weak > 0 OR matches > 500 AS needs_review, concat_ws('; ', CASE WHEN weak > 0 THEN weak || ' low-confidence threats' END, CASE WHEN matches > 500 THEN matches || ' matches' END) AS reasons FROM s",
        "mitre_mapping": f"{THREATS}, {_MAPPED} SELECT m.src_ip, m.rule_name, m.technique_id, m.mitre_confidence, x.technique, x.tactic FROM mapped m LEFT JOIN techniques x USING (technique_id)",
        "top_tactics": f"{THREATS}, {_MAPPED} SELECT x.tactic, count(*) AS incidents FROM mapped m JOIN techniques x USING (technique_id) WHERE m.confidence >= {incidents.LEAST} GROUP BY x.tactic ORDER BY incidents DESC, tactic LIMIT 8",
        "incident_stats": f"{THREATS} SELECT 'new' AS status, CASE severity WHEN 'info' THEN 'informational' ELSE severity END AS priority, count(*) AS incidents FROM threats WHERE confidence >= 0.7 GROUP BY ALL",
        "incidents_per_day": f"{THREATS} SELECT strftime(first_seen + INTERVAL 330 MINUTE, '%d/%m/%Y') AS day, count(*) AS incidents FROM threats WHERE confidence >= {incidents.LEAST} GROUP BY 1",
        "technique_context": f"{THREATS}, {_MAPPED}, hits AS (SELECT technique_id, count(*) AS threats FROM mapped GROUP BY technique_id) SELECT t.technique_id, t.technique, t.tactic, t.parent, p.technique AS parent_name, coalesce((SELECT array_to_string(list(o.technique_id ORDER BY o.technique_id)[1:5], ',') FROM techniques o WHERE o.tactic = t.tactic AND o.parent IS NULL AND o.technique_id <> t.technique_id), '') AS related, coalesce(hits.threats, 0) AS threats FROM techniques t LEFT JOIN hits ON hits.technique_id = t.technique_id LEFT JOIN techniques p ON p.technique_id = t.parent",
        "chunks_multi_index": f"{CHUNKS} SELECT {CHUNK_COLUMNS} FROM chunks",
        "suspicious_chunks": f"{CHUNKS} SELECT {CHUNK_COLUMNS} FROM suspicious",
        "temporal_patterns": f"{CHUNKS} SELECT strategy, pattern, count(*) AS chunks FROM chunks GROUP BY ALL",
        "chunk_risk_topk": f"{CHUNKS} SELECT strategy, entity, window_start, events, round(least(per_minute / 50, 2) + 3 * failure_rate + least(targets / 10, 2) + CASE pattern WHEN 'escalating' THEN 2 WHEN 'bursty' THEN 1 ELSE 0 END + least(events / 500, 1), 6) AS risk FROM suspicious ORDER BY least(per_minute / 50, 2) + 3 * failure_rate + least(targets / 10, 2) + CASE pattern WHEN 'escalating' THEN 2 WHEN 'bursty' THEN 1 ELSE 0 END + least(events / 500, 1) DESC, window_start, strategy, entity LIMIT 20",
        "anchored_windows_orders": "WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS day FROM orders), starts AS (SELECT o_custkey, min(day) AS s FROM o GROUP BY o_custkey UNION SELECT s.o_custkey, min(o.day) FROM starts s JOIN o ON o.o_custkey = s.o_custkey AND o.day > s.s + 90 GROUP BY s.o_custkey, s.s) SELECT o.o_custkey, s.s AS window_start, count(*) AS orders FROM o ASOF JOIN starts s ON o.o_custkey = s.o_custkey AND o.day >= s.s GROUP BY o.o_custkey, s.s",
        "actor_batch_stats": f"WITH {EV}, {_STATS} SELECT * REPLACE (CAST(batch AS VARCHAR) AS batch) FROM stats",
        "actor_totals": f"WITH {EV}, {_STATS} SELECT src_ip, count(*) AS batches, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(auth_failures) AS BIGINT) AS auth_failures, CAST(sum(auth_successes) AS BIGINT) AS auth_successes, CAST(sum(unique_uris) AS BIGINT) AS unique_uris, min(first_seen) AS first_seen, max(last_seen) AS last_seen, array_to_string(list(requests ORDER BY batch), ',') AS rates FROM stats GROUP BY src_ip",
        "internal_external_split": f"WITH {EV} SELECT starts_with(src_ip, '10.') AS internal_src, true AS internal_dst, count(*) AS events FROM ev GROUP BY 1",
        "page_hosts": "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1",
        "page_xss_scan": "SELECT page_id, regexp_matches(html, '<\\s*script[^>]*>', 'i') AS script, regexp_matches(html, 'javascript\\s*:', 'i') AS script_url, len(regexp_extract_all(html, '<\\s*(?:img|svg|iframe|object|embed)\\s', 0, 'i')) AS embeds FROM pages",
        "doc_pattern_scan": "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS quads, regexp_matches(text, 'AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}') AS secret FROM documents",
        "dedup_by_hash": "SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
        "rollup_actors": f"{CHUNKS}, r AS (SELECT entity, count(*) AS chunks, CAST(sum(events) AS BIGINT) AS events, CAST(sum(denied) AS BIGINT) AS denied, max(targets) AS most_targets, min(window_start) AS first_seen, max(window_end) AS last_seen, count(DISTINCT window_start // 86400000000) AS active_days FROM chunks WHERE strategy = 'src_ip' GROUP BY entity) SELECT *, round(least(40 * denied / events + least(most_targets, 20) + least(chunks, 20) + least(4 * active_days, 20), 100), 6) AS risk_score FROM r",
        "geo_range_join": f"WITH {EV} SELECT src_ip, CASE WHEN starts_with(src_ip, '45.33.') THEN 'AA' WHEN starts_with(src_ip, '52.10.') THEN 'BB' WHEN starts_with(src_ip, '91.') THEN 'CC' END AS country, count(*) AS events FROM ev GROUP BY 1, 2",
    }
    return out | more_sql()


_HAS = lambda names: f"len(list_intersect(categories, {names})) > 0"
#: (rule, category, severity, confidence, condition, description) over actors.
_FINDINGS = [
    ("low_slow_brute_force", "broken_authentication", "high", 0.85, "auth_failures >= 50", "'Low-and-slow brute force: ' || auth_failures || ' auth failures across ' || batches || ' batches'"),
    ("distributed_recon", "recon_scanner", "high", 0.8, "unique_uris >= 200 AND batches >= 2", "'Distributed recon: ' || unique_uris || ' unique URIs across ' || batches || ' batches'"),
    ("multi_vector_attacker", "multi_vector_attack", "critical", 0.9, "len(categories) >= 3", "'Multi-vector: ' || len(categories) || ' attack types (' || array_to_string(categories[1:5], ', ') || ')'"),
    ("kill_chain_progression", "kill_chain", "critical", 0.9, f"{_HAS(state.RECON)} AND {_HAS(state.EXPLOIT)}", f"'Kill-chain: recon \u2192 exploit' || CASE WHEN {_HAS(state.POST_EXPLOIT)} THEN ' \u2192 post-exploitation' ELSE '' END"),
    ("scanner_persistence", "recon_scanner", "high", 0.9, "scanner AND batches >= 3", "'Scanner persists across ' || batches || ' batches'"),
    ("rate_acceleration", "rate_limiting", "medium", 0.7, "len(rates) >= 3 AND rates[-1] >= 2 * rates[-3] AND rates[-1] > 50", "'Rate acceleration: ' || rates[-3] || ' \u2192 ' || rates[-1] || ' requests across last 3 batches'"),
    ("off_hours_anomaly", "suspicious_timing", "medium", 0.6, "night >= 5", "night || ' attack events during off-hours (00:00-06:00)'"),
    ("data_exfiltration_pattern", "data_exfiltration", "high", 0.6, "len(categories) > 0 AND auth_successes > 100 AND requests > 200 AND auth_successes / requests > 0.5 AND threat_score > 0.3", "'Potential data exfil: attacker with ' || auth_successes || ' successful requests'"),
]
FOUND = "findings AS (" + " UNION ALL ".join(f"SELECT src_ip, '{r}' AS correlation_rule, '{c}' AS category, '{s}' AS severity, {p}::DOUBLE AS confidence, {d} AS description FROM actors WHERE {w}" for r, c, s, p, w, d in _FINDINGS) + ")"
_TEXTS = f"texts(rule_name, description) AS (VALUES {values((r.name, r.description) for r in rules.EVERY.values())})"
#: What an incident's fields are, written out here on their own.
_LADDER = """CASE WHEN contains(c, 'url') OR contains(c, 'uri') OR contains(c, 'path') THEN 'url' WHEN contains(c, 'referer') OR contains(c, 'referrer') THEN 'referer' WHEN contains(c, 'user agent') OR contains(c, 'user_agent') THEN 'user_agent'
  WHEN contains(c, 'payload') OR contains(c, 'injection') OR contains(c, 'command') THEN 'payload' WHEN contains(c, 'ip') OR contains(c, 'scanner') OR contains(c, 'recon') THEN 'source ip' ELSE 'null' END"""
INCIDENTS = f"""{THREATS}, {_TEXTS}, three AS (SELECT src_ip, rule_name, array_to_string(list(evidence ORDER BY pos)[1:3], '; ') AS e, list(evidence ORDER BY pos)[1] AS first FROM firsts GROUP BY ALL
), made AS (SELECT t.*, x.description, coalesce(h.e, '') AS e, h.first, lower(t.category || ' ' || t.rule_name || ' ' || coalesce(h.e, '')) AS c FROM threats t JOIN texts x USING (rule_name) JOIN three h USING (src_ip, rule_name) WHERE confidence >= 0.7)
SELECT src_ip, rule_name AS rule, 'deterministic' AS source, 'new' AS status, CASE severity WHEN 'info' THEN 'informational' ELSE severity END AS priority, '[' || upper(category) || '] ' || substr(description, 1, 60) || ' from ' || src_ip AS title,
  substr(e, 1, 300) AS evidence, substr(first, 1, 300) AS raw_log, regexp_extract_all(e, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b')[2] AS destination_ip, {_LADDER} AS indicator,
  CAST(greatest(1, least(10, round_even(confidence * 10, 0))) AS INT) AS score, match_count FROM made"""
_PCT = "CAST(round_even(failure_rate * 100, 0) AS INT) || '%'"
_FLAGS = f"concat_ws('; ', CASE WHEN failure_rate > 0.5 THEN 'High failure rate: ' || {_PCT} END, CASE WHEN targets > 5 THEN 'Multiple targets: ' || targets || ' hosts' END, CASE WHEN len(list_intersect(ports, [22, 3389])) > 0 AND denied > 5 THEN 'Blocked remote access attempts' END)"
_SCORE = "(CASE WHEN failure_rate > 0.7 THEN 30 ELSE 0 END + CASE WHEN targets > 5 THEN 20 ELSE 0 END + CASE WHEN events > 100 THEN 15 ELSE 0 END)"
_RISK = "least(per_minute / 50, 2) + 3 * failure_rate + least(targets / 10, 2) + CASE pattern WHEN 'escalating' THEN 2 WHEN 'bursty' THEN 1 ELSE 0 END + least(events / 500, 1)"
_PORTS = lambda *p: f"len(list_intersect(ports, {list(p)})) > 0"
_SUGGESTED = [
    (f"{_PORTS(22, 3389, 5900)} AND denied > 0", "T1110", "CASE WHEN targets > 1 THEN 0.7 ELSE 0.5 END", "remote access attempts with failures"),
    (f"{_PORTS(22, 3389, 5900)} AND denied = 0", "T1021", "0.6", "remote service access"), (_PORTS(445, 139, 135), "T1021.002", "0.6", "file share ports"),
    (f"{_PORTS(445, 139, 135)} AND targets > 1", "T1135", "0.5", "file shares on several targets"), (_PORTS(53), "T1071.004", "0.4", "name service traffic"), (_PORTS(3306, 5432, 1433, 27017), "T1046", "0.5", "database ports"),
    ("targets > 1 AND len(ports) > 5", "T1046", "0.7", "many targets and ports"), ("pattern IN ('periodic', 'bursty') AND denied > 0 AND targets > 1", "T1110.003", "0.6", "automated failures across targets"),
]
_CONTEXT = """who AS (
  SELECT strategy, entity, window_start, list(DISTINCT username) FILTER (username <> '') AS users, list_sort(list(DISTINCT src_ip))[1:20] AS sources, arg_min(starts_with(src_ip, '10.'), t_us * 10000000 + row_number) AS first_inside,
    bool_and(starts_with(src_ip, '10.')) AS all_inside, list_sort(list(DISTINCT dst_ip))[1:20] AS dst_ips, coalesce(list_sort(list(DISTINCT dst_host) FILTER (dst_host IS NOT NULL))[1:20], []) AS dst_hosts, count(DISTINCT dst_ip) AS unique_ips, count(DISTINCT dst_host) AS unique_hosts,
    count(DISTINCT dst_port) AS unique_ports, list_sort(list(DISTINCT dst_port)) AS ports, arg_min(CASE WHEN dst_host LIKE 'prod%' THEN 'PROD' WHEN dst_host LIKE 'stag%' THEN 'STAGING' WHEN dst_host LIKE 'dev%' THEN 'DEV' END, t_us * 10000000 + row_number) FILTER (dst_host IS NOT NULL) AS environment
  FROM placed GROUP BY ALL)"""
_NAMES = "MAP {22: 'SSH', 80: 'HTTP', 443: 'HTTPS', 3389: 'RDP', 445: 'SMB', 53: 'DNS', 3306: 'MySQL', 8080: 'HTTP-Alt'}"
_SERVED = "MAP {22: 'SSH', 80: 'HTTP', 443: 'HTTPS', 3389: 'RDP', 445: 'SMB', 53: 'DNS', 3306: 'MySQL', 8080: 'HTTP-Proxy'}"


def more_sql() -> dict[str, str]:
    return {
        "threat_scores": f"{BATCHES} SELECT src_ip, CASE WHEN threat_score IS NOT NULL THEN array_to_string(categories, ',') END AS categories, round(threat_score, 9) AS threat_score FROM actors",
        "correlations": f"{BATCHES}, {FOUND} SELECT * FROM findings",
        "day_summary": f"{BATCHES} SELECT count(*) AS actors, sum(requests)::BIGINT AS requests, count(*) FILTER (len(categories) > 0) AS active, count(*) FILTER (threat_score >= 0.5) AS high_risk FROM actors",
        "category_breakdown": f"{BATCHES} SELECT category, count(*) AS actors FROM (SELECT unnest(categories) AS category FROM actors) GROUP BY category",
        "hourly_timeline": f"{BATCHES} SELECT strftime(first_seen, '%Y-%m-%d %H') AS hour, count(*) AS entries FROM running WHERE k <= 200 GROUP BY 1",
        "incidents_list": INCIDENTS,
        "incidents_all": f"SELECT 'new' AS status, priority, sum(n)::BIGINT AS incidents FROM (SELECT * FROM ({THREATS} SELECT CASE severity WHEN 'info' THEN 'informational' ELSE severity END AS priority, count(*) AS n FROM threats WHERE confidence >= 0.7 GROUP BY ALL) UNION ALL SELECT * FROM ({BATCHES}, {FOUND} SELECT severity AS priority, count(*) AS n FROM findings GROUP BY ALL)) GROUP BY priority",
        "chunk_risk_covered": f"{THREATS}, {CHUNKS.removeprefix(f'WITH RECURSIVE {EV}, ')}, covered AS (SELECT src_ip FROM threats GROUP BY src_ip HAVING min(confidence) >= 0.8) SELECT strategy, entity, window_start, round(({_RISK}) * CASE WHEN strategy = 'src_ip' AND entity IN (SELECT src_ip FROM covered) THEN 0.5 ELSE 1 END, 6) AS risk, {_SCORE} AS anomaly_score, {_FLAGS} AS red_flags FROM suspicious",
        "correlation_incidents": f"{BATCHES}, {FOUND}, made AS (SELECT *, lower(description || ' ' || correlation_rule) AS c FROM findings) SELECT src_ip, correlation_rule AS rule, 'new' AS status, severity AS priority, '[CORRELATION] ' || substr(description, 1, 80) AS title, {_LADDER} AS indicator, 'Investigate correlated activity from ' || src_ip AS action FROM made",
        "red_flags": f"{CHUNKS} SELECT strategy, entity, window_start, {_FLAGS} AS red_flags FROM chunks WHERE {_FLAGS} <> ''",
        "anomaly_score": f"{CHUNKS} SELECT strategy, entity, window_start, {_SCORE} AS anomaly_score, concat_ws('; ', CASE WHEN failure_rate > 0.7 THEN 'High failure rate: ' || {_PCT} END, CASE WHEN targets > 5 THEN 'Scanning behavior: ' || targets || ' targets' END, CASE WHEN events > 100 THEN 'High activity volume: ' || events || ' events' END) AS reasons FROM chunks",
        "chunk_summaries": f"{CHUNKS} SELECT strategy, entity, window_start, strftime(make_timestamp(window_start), '%H:%M') || '\u2013' || strftime(make_timestamp(window_end), '%H:%M') || ' UTC' AS time_window, array_to_string(list_transform(ports[1:15], lambda p: {_SERVED}[p] || ' (' || p || ')'), ',') AS port_descriptions, CASE WHEN per_minute > 10 THEN 'bursty' WHEN per_minute < 0.5 THEN 'random' ELSE 'steady' END AS simple_pattern, CASE WHEN bytes_sent < 1024 THEN bytes_sent || ' B' WHEN bytes_sent < 1048576 THEN format('{{:.1f}} KB', bytes_sent / 1024) WHEN bytes_sent < 1073741824 THEN format('{{:.1f}} MB', bytes_sent / 1048576) ELSE format('{{:.1f}} GB', bytes_sent / 1073741824) END AS bytes_text, CASE strategy WHEN 'dst_host' THEN 'Unknown' ELSE entity END || ' engaged in ' || events || ' events targeting ' || targets || ' target(s) with ' || CASE WHEN per_minute > 10 THEN 'bursty' WHEN per_minute < 0.5 THEN 'random' ELSE 'steady' END || ' pattern (anomaly score: ' || {_SCORE} || ')' AS narrative, coalesce(nullif(concat_ws('; ', CASE WHEN {_SCORE} > 40 THEN 'Monitor for escalation' END, CASE WHEN targets > 10 THEN 'Possible reconnaissance - review firewall rules' END), ''), 'Continue monitoring') AS recommendations FROM chunks",
        "chunk_context": f"{CHUNKS}, {_CONTEXT} SELECT strategy, entity, window_start, CASE WHEN strategy = 'user' THEN entity WHEN strategy = 'src_ip' AND len(users) = 1 THEN users[1] END AS actor_user, CASE WHEN strategy <> 'src_ip' THEN array_to_string(sources, ',') END AS actor_sources, CASE strategy WHEN 'src_ip' THEN first_inside WHEN 'dst_host' THEN all_inside END AS actor_internal, array_to_string(dst_ips, ',') AS dst_ips, array_to_string(dst_hosts, ',') AS dst_hosts, unique_ips, unique_hosts, unique_ports, array_to_string(list_sort(list_distinct(list_transform(ports[1:10], lambda p: {_NAMES}[p]))), ',') AS port_categories, environment FROM who",
        "http_analysis": f"""{CHUNKS}, phrases(kind, nth, phrase) AS (VALUES
  ('SQL injection pattern', 1, 'union select'), ('SQL injection pattern', 2, ''' or ''1''=''1'), ('SQL injection pattern', 3, '''; drop table'), ('SQL injection pattern', 4, 'exec('),
  ('SQL injection pattern', 5, 'xp_cmdshell'), ('SQL injection pattern', 6, 'information_schema'), ('XSS pattern', 1, '<script>'), ('XSS pattern', 2, 'javascript:'), ('XSS pattern', 3, 'onerror='),
  ('XSS pattern', 4, 'onload='), ('XSS pattern', 5, '<iframe'), ('XSS pattern', 6, '<embed'), ('XSS pattern', 7, 'eval('), ('Path traversal', 1, '../'), ('Path traversal', 2, '..\\'),
  ('Path traversal', 3, '%2e%2e'), ('Path traversal', 4, '....//'), ('Path traversal', 5, '..\\..\\')
), found AS (
  SELECT strategy, entity, window_start, t_us, row_number, uri_path, kind, arg_min(phrase, nth) AS phrase
  FROM placed JOIN phrases ON contains(CASE kind WHEN 'Path traversal' THEN uri_path ELSE lower(uri_path) END, phrase) GROUP BY ALL
), st AS (SELECT strategy, entity, window_start, http_status, count(*) AS n FROM placed GROUP BY ALL
), h AS (SELECT strategy, entity, window_start, array_to_string(list(http_status || ':' || n ORDER BY http_status), ',') AS statuses FROM st GROUP BY ALL
), o AS (
  SELECT strategy, entity, window_start, array_to_string(list(uri_path ORDER BY t_us, row_number, list_position(['SQL injection pattern', 'XSS pattern', 'Path traversal'], kind))[1:10], ' ') AS suspicious_uris,
    array_to_string(list_sort(list(DISTINCT kind || ': ' || phrase)), ',') AS indicators FROM found GROUP BY ALL
) SELECT p.strategy, p.entity, p.window_start, array_to_string(list_sort(list(DISTINCT http_method)), ',') AS methods, any_value(h.statuses) AS statuses,
  array_to_string(list_sort(list(DISTINCT user_agent))[1:5], ',') AS agents, any_value(o.indicators) AS indicators, any_value(o.suspicious_uris) AS suspicious_uris
FROM placed p JOIN h USING (strategy, entity, window_start) LEFT JOIN o USING (strategy, entity, window_start) GROUP BY p.strategy, p.entity, p.window_start""",
        "technique_suggestions": f"{CHUNKS} " + " UNION ALL ".join(f"SELECT strategy, entity, window_start, '{t}' AS technique_id, CAST({c} AS DOUBLE) AS confidence, '{r}' AS reason FROM chunks WHERE {w}" for w, t, c, r in _SUGGESTED),
        "normalize_events": f"WITH {EV} SELECT row_number, md5(concat_ws('|', row_number, event_ts::VARCHAR, src_ip, uri_path || coalesce('?' || uri_query, ''))) AS event_id, event_ts, src_ip, NULL::BIGINT AS src_port, dst_ip, NULL::VARCHAR AS dst_host, dst_port::BIGINT AS dst_port, action, 'TCP' AS protocol, username, bytes_sent, NULL::BIGINT AS bytes_received, NULL::BIGINT AS response_size, starts_with(src_ip, '10.') AS is_internal_src, true AS is_internal_dst, http_method, http_status, uri_path, nullif(split_part(uri_query, '#', 1), '') AS uri_query, user_agent, referrer, substr(http_method || ' ' || uri_path || coalesce('?' || nullif(split_part(uri_query, '#', 1), ''), ''), 1, 2000) AS original_message FROM ev",
        "status_histogram": f"WITH {EV}, c AS (SELECT src_ip, http_status, count(*) AS n FROM ev GROUP BY ALL) SELECT src_ip, array_to_string(list(http_status || ':' || n ORDER BY http_status), ',') AS statuses FROM c GROUP BY src_ip",
    }
