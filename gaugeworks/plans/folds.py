"""Queries of sequential operators and live folds.  Those without SQL are compared with
brute force in the tests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.expr import predicted_size
from gaugeworks.operators import intervals, ranks, rounds, sampling_plan, search, sizes, state
from gaugeworks.plans.queries import SQL as PLAN_SQL
from gaugeworks.plans.queries import table
from gaugeworks.plans.shared import Tables, settled, shared_folder
from gaugeworks.sources import batches, readers, sinks
from gaugeworks.streaming import fold, live


def scout_grid(orders: DataFrame, slots: int = 32, length: float = 600.0) -> DataFrame:
    """Orders as measured frames of their customers' timelines, gathered into at most
    ``slots`` evenly spaced scouted windows a customer, however many orders there are."""
    at = (F.col("o_orderkey") % int(length)).cast("double")
    slot = F.floor(at * slots / length).cast("int")
    cut = F.col("o_orderstatus") == "P"
    seen = orders.groupBy(F.col("o_custkey").alias("source"), slot.alias("slot")).agg(
        F.max(F.col("o_totalprice") / 5000).alias("spatial"), F.max((F.col("o_orderkey") % 50).cast("double")).alias("motion"), F.max(F.when(cut, 20.0).otherwise(0.0)).alias("transition"), F.count_if(cut).alias("cuts")
    )
    named = [F.format_string("scout-%03d", F.col("slot") + 1).alias("id"), ((F.col("slot") + 0.5) * (length / slots)).alias("centre"), F.lit(length).alias("duration")]
    return seen.select("source", *named, "spatial", "motion", "transition", *(F.lit(0.2).alias(c) for c in ("dark", "flat", "noise")), "cuts")


def sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for every customer's timeline."""
    return sampling_plan.sample_plan(scout_grid(table(spark, sf_dir, "orders")), "source", "duration")


def aligned_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans with their windows moved off the cuts, where there is room;
    windows that look for a transition stay."""
    orders = table(spark, sf_dir, "orders")
    plans = settled(sampling_plan.sample_plan(scout_grid(orders), "source", "duration"))
    size = sampling_plan.PlanSettings().sample_sec
    cuts = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 600).cast("double").alias("p"))
    points = plans.where("scout_id is not null").select("source").distinct().join(cuts, "source", "left")
    shots = ranks.segments(points, "source", "p", F.lit(0.0), F.lit(600.0))
    windows = plans.where("scout_id is not null").select("source", F.col("scout_id").alias("id"), F.col("start_sec").alias("start"), (F.col("start_sec") + size).alias("end"), F.col("reasons").contains(sampling_plan.TRANSITION).alias("fixed"))
    moved = intervals.align_to_segments(windows, shots, "source")
    moved = moved.select("source", F.col("id").alias("scout_id"), "new_start", (~F.col("held")).alias("crosses"))
    return sampling_plan.aligned_plans(plans, moved, "source", size)


def frame_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frame logs, written as text and read back by ranges of bytes."""
    folder = f"{shared_folder(spark)}/frames_{uuid.uuid4().hex[:12]}"
    events = table(spark, sf_dir, "events")
    lines = F.format_string("frame:%d pts:%d\nvalue=%s\nkind=%s\nuser=%s", "event_id", "event_id", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("value", "event_type", "user_id")))
    events.select(lines.alias("line")).write.text(folder)
    found = readers.frame_logs(spark, folder)
    return found.select("frame", F.col("values")["value"].alias("value"), F.col("values")["user"].cast("long").alias("user"), F.col("bad").cast("long").alias("bad"))


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3, C4: results saved as batches, one of them tried again after it was there and
    another after a compaction; later batches replace what earlier ones said of a key."""
    held = batches.BatchLog(spark, f"{shared_folder(spark)}/batches_{uuid.uuid4().hex[:12]}", "key")
    rows = table(spark, sf_dir, "customer").select(sinks.fingerprint(["c_custkey"]).alias("key"), "c_custkey", "c_nationkey", "c_acctbal")
    held.append(rows, 0)
    held.append(rows.where("c_nationkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2), 1)
    held.append(rows, 1)
    held.compact()
    held.append(rows.where("c_nationkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 4), 2)
    held.append(rows, 0)
    return held.rows().select("c_custkey", F.col("__batch").alias("batch"), F.round("c_acctbal", 4).alias("value"))


def search_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed searches over measured curves."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("long").alias("rate"), (F.col("o_totalprice") / 5000).alias("quality"))
    return search.search_measured(rows, "o_custkey", "rate", "quality", 40.0)


def measured_lines(rows: DataFrame) -> DataFrame:
    """What a line of an order measures at a rate: better rates are mostly better, harder
    parts need more, some rates dip, and a coarse or repeated look differs a little."""
    hard, dip = (F.col("l_partkey") % 17) / 17.0, F.when((F.col("l_partkey") + F.floor(F.col("rate") / 1000)) % 11 == 0, 3.0).otherwise(0.0)
    look = F.when(F.col("tier") == "coarse", (F.col("l_partkey") % 3 - 1) * 0.3).when(F.col("tier") == "again", 0.25).otherwise(0.0)
    got = F.floor(F.col("rate") * (90 + F.col("l_partkey") % 5 * 5) / 100).cast("long")
    return rows.withColumns({"quality": 84.0 + F.col("rate") / 1000 * 1.9 - hard * 4 - dip + look, "observed": got})


def line_windows(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows, sources): the lines of an order as the windows of a source."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = lineitem.select(F.col("l_orderkey").alias("source"), F.row_number().over(order).alias("window"), "l_partkey")
    pool = F.when(F.col("window") <= 2, "search").when(F.col("window") <= 4, "holdout").otherwise("reserve")
    centre = (F.col("l_partkey") % 600).cast("double")
    windows = rows.select("source", "window", pool.alias("pool"), centre.alias("start"), (F.col("l_partkey") % 3 + 1).alias("reasons"), ((F.col("l_partkey") % 20) / 20.0).alias("risk"), centre.alias("centre"), "l_partkey")
    part = F.max("l_partkey")
    longs = {"least": part % 3 * 1000 + 1000, "budget": part % 5 * 1000 + 5000, "ceiling": F.lit(14000), "cap": F.when(part % 7 == 0, 9000), "most": part % 4 * 15000 + 45000, "tolerance": F.lit(1000), "audio": F.lit(0)}
    sources = rows.groupBy("source").agg(F.lit(92.0).alias("target"), *(x.cast("long").alias(n) for n, x in longs.items()), F.lit(60.0).alias("duration"), F.lit(0.5).alias("middle"))
    return windows, sources


#: Lines that a bucket of sources holds.
ROWS_A_BUCKET = 300_000


def verified_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lines are searched,
    verified and measured as the rounds ask for them."""
    lineitem = table(spark, sf_dir, "lineitem")
    buckets = max(2 * spark.sparkContext.defaultParallelism, lineitem.count() // ROWS_A_BUCKET)
    tables = Tables("source", buckets)
    windows, sources = line_windows(lineitem.repartition(buckets, "l_orderkey"))
    return tables.last(rounds.verified(sources, windows, "source", measured_lines, tables))


def calibrated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose size fits only without its uncertainty are measured
    in two more windows, those of the middle risk, and predicted anew."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = line.select(F.col("l_orderkey").alias("source"), F.row_number().over(order).alias("window"), (F.col("l_quantity") / 50).alias("risk"), F.col("l_extendedprice").cast("long").alias("rate"), (F.col("l_partkey") % 600).cast("double").alias("centre"))
    search = rows.where("window <= 2").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "rate"))), lambda r: r["rate"]).alias("observed"))
    base = search.withColumns({"asked": F.lit(30000), "duration": F.lit(60.0), "audio": F.lit(0), "bytes": F.lit(None).cast("long"), "most": (F.element_at("observed", 1) * 8.5).cast("long")})
    first = sizes.predicted_sizes(base, "asked", "observed", "duration", "audio", "bytes")
    first = settled(first.withColumn("central", predicted_size(F.col("mean_rate"), F.col("audio"), F.col("duration"))))
    close = first.where(rounds.near_boundary("central", "predicted_bytes", "most")).select("source")
    middle = rows.groupBy("source").agg(F.sort_array(F.collect_list("risk")).alias("r")).select("source", F.get("r", F.floor(F.size("r") / 2).cast("int")).alias("middle"))
    reserves = rows.where("window > 2").join(close, "source", "left_semi").join(middle, "source").withColumn("half", F.lit(300.0))
    chosen = rounds.size_representatives(reserves, "source", "risk", "middle", "centre", "half")
    again = rounds.calibrated(first.select("source", "observed", "asked", "duration", "audio", "bytes", "most"), chosen, "source", "observed", "rate")
    out = sizes.predicted_sizes(again, "asked", "observed", "duration", "audio", "bytes")
    return out.select("source", F.size("observed").alias("windows"), "mean_rate", "upper_rate", "predicted_bytes", (F.col("predicted_bytes") <= F.col("most")).alias("fits"))


def live_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/live_{uuid.uuid4().hex[:12]}"


def live_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 as a stream: the same state as the batch fold, written by changes."""
    folder = live_folder(spark)
    fields = {"last_type": F.col("event_type"), "last_large": F.when(F.col("value") > 50, F.col("value")), "last_event": F.col("event_id")}
    live.kept_changes(live.changes(fold.read_events(spark, f"{sf_dir}/events.parquet"), "user_id", ["event_id"], fields), folder)
    return live.current(spark, folder, "user_id", list(fields))


#: What an event says of its user's row in a queue.
EVENT_STATUS = {"view": "analyzing", "click": "encoding", "signup": "done", "error": "failed"}


def queue_fields() -> dict[str, Column]:
    status = F.lit("queued")
    for kind, name in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return {"status": status, "percent": F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "value"))).cast("double")}


def queue_shares(get: Callable[[str], Column]) -> dict[str, Column]:
    """What a row adds to the totals of its queue."""
    status, percent = get("status"), F.coalesce(get("percent"), F.lit(0.0))
    groups = {f"n_{g}": status.isin(*states).cast("int") for g, states in state.GROUPS.items()}
    return {"n": F.lit(1), **groups, "finished": F.round(state.progress_share(status, percent) * 100).cast("long")}


def live_queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the queue, kept after every batch by what its changes take away and
    add."""
    folder, batches = live_folder(spark), []
    totals = live.Totals(spark, folder, queue_shares)

    def each(changed: DataFrame, n: int) -> None:
        totals(changed, n)
        batches.append(n)

    live.kept_changes(live.changes(fold.read_events(spark, f"{sf_dir}/events.parquet"), "user_id", ["event_id"], queue_fields()), folder, each)
    names = ["n", *(f"n_{g}" for g in state.GROUPS), "finished"]
    last = totals.after(batches[-1]) if batches else {}
    return spark.createDataFrame([tuple(int(last.get(k, 0)) for k in names)], ", ".join(f"{k} long" for k in names))


LIVE_QUEUE = """
    with s as (select user_id, arg_max(event_type, event_id) filter (event_type is not null) t, arg_max(value, event_id) filter (value is not null) v from events where user_id is not null group by user_id),
    q as (select case t when 'view' then 'analyzing' when 'click' then 'encoding' when 'signup' then 'done' when 'error' then 'failed' else 'queued' end s, floor(least(100.0, greatest(0.0, coalesce(v, 0)))) p from s)
    select count(*) n, count(*) filter (s = 'queued') n_queued, count(*) filter (s in ('analyzing', 'encoding')) n_running, count(*) filter (s = 'failed') n_failed, 0::bigint n_needs_decision, count(*) filter (s = 'done') n_done,
           0::bigint n_skipped, 0::bigint n_cancelled, coalesce(sum(case when s = 'done' then 100 else p end), 0)::bigint finished from q"""

#: A kind is no number, so each frame has one bad value at least.
FRAME_LOGS = "select event_id as frame, value, user_id as \"user\", 1 + (value is null)::bigint + (user_id is null)::bigint as bad from events"

BATCH_LOG = """
    select c_custkey, case when c_nationkey % 3 = 0 then 2 when c_nationkey % 2 = 0 then 1 else 0 end::bigint as batch,
           round(c_acctbal * case when c_nationkey % 3 = 0 then 4 when c_nationkey % 2 = 0 then 2 else 1 end, 4) as value from customer"""

QUERIES = {f.__name__: f for f in (frame_logs, batch_log, sample_plan, aligned_plan, search_trace, verified_rounds, calibrated_sizes, live_state_fold, live_queue_metrics)}
SQL = {"frame_logs": FRAME_LOGS, "batch_log": BATCH_LOG, "live_state_fold": PLAN_SQL["state_fold"], "live_queue_metrics": LIVE_QUEUE}
