"""Entity-centred time windows that start at an event, their profiles, temporal pattern, filter and rank.

A window starts at the entity's first event and holds every event up to start + width, that included; the next event
starts the next one. So a start's successor is a known event, whatever came before: the first one later than start +
width. The starts of an entity are found by a fold over its distinct times in an array, or, where these are more than
LONG, by pointers that are composed with themselves round by round.

Time is cut into cells of one width. A cell holds one start at most, and an event's window begins in its own cell or in
the one before, so events find their window by an equality join with the cells, which are few beside the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake.functions import net
from threatlake.functions.text import filled
from threatlake.sources.workspace import written

# Window widths in minutes, ports that matter.
STRATEGIES = {"src_ip": 15, "dst_host": 30, "user": 120}
SUSPICIOUS_PORTS = [22, 23, 3389, 445, 135, 139]
# End of the fixed values.


#: Most distinct times of an entity that one array holds (0.8 MB), starts that a fold appends to before it begins a new
#: list, and most rows of cells (keys and two numbers) that are broadcast.
LONG, PART, BROADCAST_ROWS = 100_000, 256, 200_000


def _cell(at: Column, width: Column) -> Column:
    """Where the cell of a time begins."""
    return at - F.pmod(at, width)


def _short_starts(times: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width, s): the starts of entities whose times fit into an array."""
    kind = "struct<last: bigint, some: array<bigint>, full: array<array<bigint>>>"
    none = F.struct(F.lit(None).cast("bigint"), F.array().cast("array<bigint>"), F.array().cast("array<array<bigint>>")).cast(kind)
    by = times.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("x"), F.first("width").alias("width"))

    def step(a, t):
        room = F.size(a["some"]) < PART
        some = F.when(room, F.concat(a["some"], F.array(t))).otherwise(F.array(t))
        full = F.when(room, a["full"]).otherwise(F.concat(a["full"], F.array(a["some"])))
        return F.when(a["last"].isNull() | (t > a["last"] + F.col("width")), F.struct(t.alias("last"), some.alias("some"), full.alias("full")).cast(kind)).otherwise(a)

    starts = F.aggregate("x", none, step, lambda a: F.flatten(F.concat(a["full"], F.array(a["some"]))))
    return by.select(*keys, "width", F.explode_outer(starts).alias("s"))


def _successors(times: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width, t, next, first): the first time later than t + width, and whether t has no time in the width before it.

    No window runs over more than one cell's times and those of its neighbour; what lies beyond is in a table of cells.
    """
    times = times.withColumn("cell", _cell(F.col("t"), F.col("width")))
    cells = times.groupBy(*keys, "width", "cell").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    order = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.select(*keys, "cell", F.lead("low").over(order).alias("after"), F.lag("high").over(order).alias("before"))
    # each time, and each time plus the width, in the cell where it lies; from the latest on
    points = times.select(*keys, "width", "cell", F.col("t").alias("v"), F.col("t").alias("real"), F.lit(1).alias("kind")).unionByName(
        times.select(*keys, "width", (F.col("cell") + F.col("width")).alias("cell"), (F.col("t") + F.col("width")).alias("v"), F.lit(None).cast("bigint").alias("real"), F.lit(0).alias("kind"))
    )
    here = Window.partitionBy(*keys, "cell").orderBy(F.desc("v"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = points.withColumn("next", F.last("real", True).over(here)).where("kind = 0")
    found = found.select(*keys, "width", (F.col("v") - F.col("width")).alias("t"), (F.col("cell") - F.col("width")).alias("cell"), "next")
    # without one in the next cell it is the first time of the first cell after that
    later = cells.select(*keys, F.col("cell").alias("cell"), "after")
    after_next = later.withColumnsRenamed({"cell": "c2", "after": "after2"})
    joined = found.join(later, [*keys, "cell"], "left").withColumn("c2", F.col("cell") + F.col("width")).join(after_next, [*keys, "c2"], "left")
    beyond = F.when(F.col("after") >= F.col("c2") + F.col("width"), F.col("after")).otherwise(F.col("after2"))
    out = joined.select(*keys, "width", "t", F.coalesce("next", beyond).alias("next"))
    firsts = times.groupBy(*keys, "width", "cell").agg(F.min("t").alias("t")).join(cells.select(*keys, "cell", "before"), [*keys, "cell"])
    # a gap of more than a width always ends a cell's times
    firsts = firsts.where(F.col("before").isNull() | (F.col("t") - F.col("before") > F.col("width"))).select(*keys, "t", F.lit(True).alias("first"))
    return out.join(firsts, [*keys, "t"], "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _long_starts(times: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width, s) for any number of times of an entity, dealt over all tasks by entity and time.

    Starts that are known (first: those after gaps) and the pointers are advanced together: after k rounds the pointers
    skip 2^k windows and all starts up to that far from a known one are found. Each round is written.
    """
    pointers = written(_successors(times, keys), "pointers")
    starts = written(pointers.where("first").select(*keys, "width", "t"), "starts")
    jump = pointers.where("next is not null").select(*keys, "t", "next")
    n = starts.count()
    while True:
        reached = starts.join(jump, [*keys, "t"]).select(*keys, "width", F.col("next").alias("t"))
        starts = written(starts.unionByName(reached).distinct(), "starts")
        before, n = n, starts.count()
        if n == before:
            return starts.withColumnRenamed("t", "s")
        twice = jump.alias("x").join(jump.toDF(*keys, "next", "then"), [*keys, "next"]).select(*keys, F.col("x.t").alias("t"), F.col("then").alias("next"))
        jump = written(twice, "pointers")


def starts(rows: DataFrame, keys: list[str], at: str, width: str) -> DataFrame:
    """(keys, width, s) of every entity's windows."""
    times = written(rows.select(*keys, F.col(at).cast("bigint").alias("t"), F.col(width).cast("bigint").alias("width")).where("t is not null").distinct(), "times")
    sizes = times.groupBy(*keys).count().where(F.col("count") > LONG).select(*keys)
    if sizes.isEmpty():
        return _short_starts(times, keys)
    sizes = written(sizes, "sizes")  # few: each stands for more than LONG times
    same = lambda how: times.alias("a").join(F.broadcast(sizes.alias("b")) if sizes.count() <= BROADCAST_ROWS else sizes.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], how).select("a.*")
    return _short_starts(same("left_anti"), keys).unionByName(_long_starts(same("left_semi"), keys))


def anchored_windows(rows: DataFrame, keys: list[str], at: str, width: str) -> DataFrame:
    """Adds window_start; `at` and the column `width` are numbers of the same unit. Rows with a null key or time are left out."""
    s, w = F.col("s"), F.col("width")
    rows = rows.dropna(subset=[*keys, at])
    both = F.array(F.struct(_cell(s, w).alias("cell"), s.alias("own"), F.lit(None).cast("bigint").alias("last")), F.struct((_cell(s, w) + w).alias("cell"), F.lit(None).cast("bigint").alias("own"), s.alias("last")))
    cells = starts(rows, keys, at, width).select(*keys, F.inline(both)).groupBy(*keys, F.col("cell").alias("_cell")).agg(F.max("own").alias("_own"), F.max("last").alias("_last"))
    cells = written(cells, "cells")
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    out = rows.withColumn("_cell", _cell(F.col(at).cast("bigint"), F.col(width).cast("bigint"))).join(cells, [*keys, "_cell"])
    return out.withColumn("window_start", F.when(F.col(at) >= F.col("_own"), F.col("_own")).otherwise(F.col("_last"))).drop("_cell", "_own", "_last")


def indexed(events: DataFrame, strategies: dict[str, int] = STRATEGIES, unit: int = 60_000_000) -> DataFrame:
    """Each event once for each strategy that has an entity for it, with its window."""
    entity = {"src_ip": F.nullif("src_ip", F.lit("")), "dst_host": F.coalesce(F.nullif("dst_host", F.lit("")), F.nullif("dst_ip", F.lit(""))), "user": F.nullif("username", F.lit(""))}
    fan = F.array_compact(F.array(*(F.when(entity[s].isNotNull(), F.struct(F.lit(s).alias("strategy"), entity[s].alias("entity"), F.lit(m * unit).cast("bigint").alias("width"))) for s, m in strategies.items())))
    return anchored_windows(events.select("*", F.inline(fan)), ["strategy", "entity"], "t_us", "width")


def temporal_pattern(intervals: Column) -> Column:
    """The class of a chunk by its sorted events' intervals in seconds, an array of doubles."""
    x, n = intervals, F.size(intervals)
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)).otherwise(0.0)
    half = F.floor(n / 2).cast("int")
    first, second = mean(F.slice(x, 1, half)), mean(F.slice(x, half + 1, n - half))
    average = mean(x)
    # folds carry the mean and the median along, so that they aren't computed again for each interval
    squares = F.aggregate(x, F.struct(average.alias("m"), F.lit(0.0).alias("s")), lambda a, v: F.struct(a["m"].alias("m"), (a["s"] + (v - a["m"]) * (v - a["m"])).alias("s")), lambda a: a["s"])
    deviation = F.sqrt(squares / F.greatest(n, F.lit(1)))
    cv = F.when(average > 0, deviation / average).otherwise(0.0)
    median = F.get(F.array_sort(x), half)
    near = F.aggregate(x, F.struct(median.alias("m"), F.lit(0).alias("k")), lambda a, v: F.struct(a["m"].alias("m"), (a["k"] + F.when(F.abs(v - a["m"]) < a["m"] * 0.3, 1).otherwise(0)).alias("k")), lambda a: a["k"])
    third, last = F.floor(n / 3).cast("int"), F.ceil(n / 3).cast("int")
    early, late = mean(F.slice(x, 1, third)), mean(F.slice(x, n - last + 1, last))
    burst = F.when(first < second * 0.5, "bursty_then_idle").when(second < first * 0.5, "idle_then_bursty").otherwise("bursty")
    return (
        F.when(n < 2, "random").when(F.size(F.filter(x, lambda v: v < 5)) > n * 0.7, burst).when(cv < 0.5, "steady")
        .when((n >= 5) & (near > n * 0.6), "periodic").when((n >= 4) & (late < early * 0.5), "escalating").when((n >= 4) & (early < late * 0.5), "declining").otherwise("random")
    )


def profiles(windows: DataFrame) -> DataFrame:
    """One row for each chunk: counts, distinct values, rates, ports and the temporal pattern."""
    deny, port = F.count_if(F.col("action") == "DENY"), F.when(F.col("dst_port") != 0, F.col("dst_port"))
    times = F.array_sort(F.collect_list("t_us"))
    host = F.nullif("dst_host", F.lit(""))
    out = windows.groupBy("strategy", "entity", "window_start").agg(
        F.count("*").alias("events"), F.count_if(F.col("action") == "ALLOW").alias("allowed"), deny.alias("denied"), F.max("t_us").alias("window_end"),
        F.size(F.collect_set(F.when(filled(F.col("src_ip")), F.col("src_ip")))).alias("sources"), F.collect_set(F.nullif("dst_ip", F.lit(""))).alias("ips"), F.collect_set(host).alias("hosts"),
        F.array_sort(F.collect_set(port)).alias("ports"), F.sum(F.coalesce("bytes_sent", F.lit(0))).alias("bytes_sent"), times.alias("times"),
    )
    minutes = (F.col("window_end") - F.col("window_start")) / 60e6
    intervals = F.transform(F.sequence(F.lit(2), F.size("times")), lambda i: (F.element_at("times", i) - F.element_at("times", i - 1)) / 1e6)
    intervals = F.when(F.size("times") > 1, intervals).otherwise(F.array().cast("array<double>"))
    out = out.select(
        "strategy", "entity", "window_start", "window_end", "events", "allowed", "denied", "sources", F.size(F.array_union("ips", "hosts")).alias("targets"), F.slice("ports", 1, 20).alias("ports"), "bytes_sent",
        (F.col("denied") / F.col("events")).alias("failure_rate"), F.when((minutes > 0) & (F.col("events") > 1), F.col("events") / minutes).otherwise(F.col("events").cast("double")).alias("per_minute"),
        intervals.alias("intervals"),
    )
    # filters on the pattern stay above a generator; through a projection they would take copies of the expression along
    return out.select("*", F.inline(F.array(F.struct(temporal_pattern(F.col("intervals")).alias("pattern"))))).drop("intervals")


def suspicious(chunks: DataFrame, events: int = 10, failures: float = 0.3, targets: int = 3) -> DataFrame:
    ports = F.arrays_overlap("ports", F.array(*map(F.lit, SUSPICIOUS_PORTS))) & (F.col("denied") > 0)
    burst = F.col("pattern").isin("bursty", "escalating") & (F.col("per_minute") > 10)
    return chunks.where((F.col("events") >= events) & ((F.col("failure_rate") >= failures) | (F.col("targets") >= targets) | F.coalesce(ports, F.lit(False)) | burst))


def risk(chunks: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Adds risk; halved for sources all of whose threats are certain (`covered`: src_ip)."""
    score = F.least(F.col("per_minute") / 50, F.lit(2.0)) + 3 * F.col("failure_rate") + F.least(F.col("targets") / 10, F.lit(2.0)) + F.when(F.col("pattern") == "escalating", 2.0).when(F.col("pattern") == "bursty", 1.0).otherwise(0.0) + F.least(F.col("events") / 500, F.lit(1.0))
    if covered is None:
        return chunks.withColumn("risk", score)
    known = covered.select(F.col("src_ip").alias("entity"), F.lit("src_ip").alias("strategy"), F.lit(0.5).alias("share"))
    return chunks.join(known, ["strategy", "entity"], "left").withColumn("risk", score * F.coalesce("share", F.lit(1.0))).drop("share")


def riskiest(chunks: DataFrame, k: int = 20) -> DataFrame:
    return chunks.orderBy(F.desc("risk"), "window_start", "strategy", "entity").limit(k)


def covered_sources(threats: DataFrame) -> DataFrame:
    return threats.groupBy("src_ip").agg(F.min("confidence").alias("least")).where("least >= 0.8").select("src_ip")


def internal_external(events: DataFrame) -> DataFrame:
    return events.groupBy(net.is_internal(F.col("src_ip")).alias("internal_src"), net.is_internal(F.col("dst_ip")).alias("internal_dst")).agg(F.count("*").alias("events"))
