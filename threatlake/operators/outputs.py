"""Stored analysis outputs: their confidence, summaries of files, and incidents from one output or from all of an actor.

An output row holds analysis_id, chunk_id, file_id, created_at, the chunk's src_ip, window_start, window_end and hosts (an
array), and up to four parts, each of which is a struct or null: behavioral (interpretation, is_suspicious, confidence,
key_indicators), intent (suspected_intent, kill_chain_stage, confidence), mitre (technique_id, technique_name, tactic,
confidence) and triage (priority, risk_reason, recommended_action, executive_summary, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.operators import incidents

# Parts of an output, priorities of outputs without triage, lengths of texts, and how many of each are listed.
PARTS = ("behavioral", "intent", "mitre", "triage")
HIGH, MEDIUM = 0.8, 0.6
SAMPLE, SUMMARY, TITLE, BRIEF = 200, 300, 50, 260
INDICATORS_EACH, INDICATORS, INTENTS, ACTIONS, SAMPLES, TECHNIQUES, HOSTS = 3, 10, 5, 5, 3, 10, 50
# End of the fixed values.

#: A kind of listed value, and how many are kept of a group; kinds without a number have few values (stages, tactics, priorities).
VALUES = {"key_indicators": INDICATORS, "intents": INTENTS, "stages": None, "tactics": None, "priorities": None, "actions": ACTIONS}


def overall_confidence() -> Column:
    """The mean confidence of the parts that are there; 0 without any."""
    known = F.array_compact(F.array(*(F.col(f"{p}.confidence").cast("double") for p in PARTS)))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)


def priority() -> Column:
    """The triage's priority (medium if it is none of the five); without triage by the overall confidence."""
    said = F.lower("triage.priority")
    given = F.when(said.isin(*incidents.PRIORITIES), said).otherwise("medium")
    c = F.col("overall_confidence")
    return F.when(F.col("triage").isNotNull(), given).otherwise(F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low"))


def _score(confidence: str) -> Column:
    """incidents.score() of a mean, the same in whatever order it was summed."""
    return incidents.score(F.round(F.col(confidence), 9))


def _rank(column: Column) -> Column:
    """5 for critical down to 1."""
    return len(incidents.PRIORITIES) + 1 - F.array_position(F.array(*map(F.lit, incidents.PRIORITIES)), column)


def _listed(rows: DataFrame, key: str) -> DataFrame:
    """key and a column of each kind in VALUES: the distinct values that aren't empty, in order, the smallest where there are
    more than are kept. Values are made distinct and numbered over tasks before any are gathered."""
    one = lambda kind, c: F.transform(F.array(c), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    few = F.transform(F.slice(F.coalesce("behavioral.key_indicators", F.array().cast("array<string>")), 1, INDICATORS_EACH), lambda v: F.struct(F.lit("key_indicators").alias("kind"), v.alias("value")))
    parts = {"intents": "intent.suspected_intent", "stages": "intent.kill_chain_stage", "tactics": "mitre.tactic", "priorities": "triage.priority", "actions": "triage.recommended_action"}
    values = rows.select(key, F.inline(F.concat(few, *(one(k, F.col(c)) for k, c in parts.items())))).where("value <> ''").distinct()
    n = F.row_number().over(Window.partitionBy(key, "kind").orderBy("value"))
    most = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in VALUES.items() if v), F.lit(2**31 - 1))
    kept = values.withColumn("n", n).where(F.col("n") <= most)
    return kept.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in VALUES))


def _samples(rows: DataFrame, key: str) -> DataFrame:
    """key, the first interpretations and summaries, and the first techniques, by (created_at, analysis_id) of the outputs
    that have the part."""
    part = lambda kind, p, value: F.when(F.col(p).isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    technique = F.concat_ws("|", *(F.coalesce(f"mitre.{f}", F.lit("")) for f in ("technique_id", "technique_name", "tactic")))
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    entries = F.array_compact(F.array(part("interpretations", "behavioral", text("behavioral.interpretation", SAMPLE)), part("summaries", "triage", text("triage.executive_summary", SUMMARY)), part("techniques", "mitre", technique)))
    placed = rows.select(key, "created_at", "analysis_id", F.inline(entries))
    placed = placed.withColumn("n", F.row_number().over(Window.partitionBy(key, "kind").orderBy("created_at", "analysis_id", "value")))
    kept = placed.where(F.col("n") <= F.when(F.col("kind") == "techniques", TECHNIQUES).otherwise(SAMPLES))
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "value")))), lambda e: e["value"])
    return kept.groupBy(key).agg(texts("interpretations").alias("interpretations"), F.filter(texts("summaries"), lambda s: s != "").alias("summaries"), texts("techniques").alias("techniques"))


def file_summary(outputs: DataFrame) -> DataFrame:
    """A row for each file: chunks, avg_confidence, how many outputs have each part, suspicious, and the lists of values and samples."""
    rows = outputs.withColumn("overall_confidence", overall_confidence())
    sums = rows.groupBy("file_id").agg(F.count("*").alias("chunks"), F.avg("overall_confidence").alias("avg_confidence"), *(F.count(p).alias(p) for p in PARTS), F.count_if(F.col("behavioral.is_suspicious")).alias("suspicious"))
    none = F.array().cast("array<string>")
    out = sums.join(_listed(rows, "file_id"), "file_id", "left").join(_samples(rows, "file_id"), "file_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in [*VALUES, "interpretations", "summaries", "techniques"]})


def _detailed(outputs: DataFrame) -> DataFrame:
    rows = outputs.withColumn("overall_confidence", overall_confidence())
    return rows.withColumn("priority", priority())


def from_outputs(outputs: DataFrame) -> DataFrame:
    """An incident for each output."""
    said, actor = F.col("behavioral.interpretation"), F.coalesce(F.nullif("src_ip", F.lit("")), F.lit("Unknown actor"))
    title = F.concat(F.when(F.col("behavioral.is_suspicious"), F.substring(said, 1, TITLE)).otherwise("Behavioral anomaly detected"), F.lit(" from "), actor)
    line = lambda p, *xs: F.when(F.col(p).isNotNull(), F.concat(*(F.coalesce(x, F.lit("")) for x in xs)))
    text = F.concat_ws(
        "\n", line("behavioral", F.lit("Behavior: "), said), line("intent", F.lit("Suspected intent: "), F.col("intent.suspected_intent")),
        line("mitre", F.lit("MITRE mapping: "), F.col("mitre.technique_name"), F.lit(" ("), F.col("mitre.technique_id"), F.lit(")")), line("triage", F.lit("Risk: "), F.col("triage.risk_reason")),
    )
    filled = lambda c: F.nullif(c, F.lit(""))
    rows = _detailed(outputs).withColumns({"title": title, "description": text})
    suspicious = F.coalesce(F.col("behavioral.is_suspicious"), F.col("priority") != "informational")
    return rows.select(
        F.md5(F.concat_ws("|", F.lit("ai_detection"), "analysis_id")).alias("incident_id"), F.lit("ai_detection").alias("source"), "analysis_id", "chunk_id", "file_id", "src_ip", "title", "description", "priority", F.lit(incidents.NEW).alias("status"),
        F.when(F.col("triage").isNotNull(), True).otherwise(suspicious).alias("suspicious"), F.col("overall_confidence").alias("confidence"), _score("overall_confidence").alias("score"),
        incidents.indicator(F.concat_ws(" ", "title", "description", "intent.suspected_intent", "mitre.technique_name")).alias("indicator"), F.coalesce(filled("intent.suspected_intent"), "mitre.technique_name", "title").alias("attack"),
        F.substring(F.coalesce(filled("behavioral.interpretation"), "description"), 1, BRIEF).alias("brief"), F.coalesce("triage.recommended_action", F.lit("Investigate and validate findings.")).alias("action"),
        F.col("mitre.technique_id").alias("technique_id"), F.col("mitre.tactic").alias("tactic"), F.col("window_start").alias("first_seen"), F.col("window_end").alias("last_seen"),
    )


def merged(outputs: DataFrame, key: str = "src_ip") -> DataFrame:
    """An incident for each group of outputs (by default of an actor).

    Priority is the highest of all; what an incident says comes from its first output by (window_start, analysis_id), its
    end from the last. Hosts are the first 50 in order. The outputs of an incident are rows of `members`, as a
    group may hold any number of them. Rows without a key are in no group.
    """
    rows = _detailed(outputs.where(F.col(key).isNotNull()))
    order = F.struct("window_start", "analysis_id")
    first = F.min_by(F.struct("behavioral", "intent", "mitre", "triage", "window_start"), order)
    tops = F.max_by("priority", _rank(F.col("priority")))
    sums = rows.groupBy(key).agg(
        F.count("*").alias("activities"), tops.alias("priority"), first.alias("f"), F.max_by("window_end", order).alias("last_seen"), F.avg("overall_confidence").alias("confidence"), F.count_distinct("file_id").alias("files"),
        F.min("mitre.tactic").alias("_least"), F.max("mitre.tactic").alias("_most"),
    )
    hosts = rows.select(key, F.explode("hosts").alias("host")).where("host <> ''").distinct().withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("host"))).where(F.col("n") <= HOSTS)
    listed = hosts.groupBy(key).agg(F.array_sort(F.collect_list("host")).alias("hosts"))
    title = F.concat(F.lit("Multi-event incident: "), F.col("activities"), F.lit(" related activities"))
    out = sums.join(listed, key, "left").withColumns({"title": title, "tactic_of_all": F.when(F.col("_least") == F.col("_most"), F.col("_least"))})
    said = F.col("f.behavioral.interpretation")
    return out.select(
        F.md5(F.concat_ws("|", F.lit("correlation"), key)).alias("incident_id"), F.lit("correlation").alias("source"), key, "title", F.concat(F.lit("Correlated incident spanning "), F.col("activities"), F.lit(" behavioral chunks")).alias("description"),
        "priority", F.lit(incidents.NEW).alias("status"), (F.col("priority") != "informational").alias("suspicious"), "confidence", _score("confidence").alias("score"), "activities", "files", F.coalesce("hosts", F.array().cast("array<string>")).alias("hosts"),
        incidents.indicator(F.concat_ws(" ", "title", said)).alias("indicator"), F.coalesce("f.intent.suspected_intent", "title").alias("attack"), F.substring(F.coalesce(said, "title"), 1, BRIEF).alias("brief"),
        F.coalesce("f.triage.recommended_action", F.lit("Investigate correlated sequence.")).alias("action"), F.col("f.mitre.technique_id").alias("technique_id"), F.coalesce("f.mitre.tactic", "tactic_of_all").alias("tactic"),
        F.col("tactic_of_all").alias("primary_tactic"), F.col("f.window_start").alias("first_seen"), "last_seen",
    )


def members(outputs: DataFrame, key: str = "src_ip") -> DataFrame:
    """The timeline of merged incidents: a row for each output with its incident, time and description."""
    told = F.coalesce("behavioral.interpretation", F.lit("Activity detected"))
    return outputs.where(F.col(key).isNotNull()).select(F.md5(F.concat_ws("|", F.lit("correlation"), key)).alias("incident_id"), "analysis_id", "chunk_id", "file_id", F.col("window_start").alias("at"), told.alias("description"), F.col("src_ip").alias("actor"))
