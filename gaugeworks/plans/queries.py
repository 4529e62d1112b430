"""The operators as queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import expr as X
from gaugeworks.operators import catalogs, evaluation, intervals, longkeys, ranks, robust, selection, series, sizes, state
from gaugeworks.plans.shared import settled
from gaugeworks.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 86400.0
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def seconds(column: str):
    """Seconds since 1970 of a timestamp without zone, to the microsecond."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})") / 1e6


SECONDS = "(date_diff('microsecond', TIMESTAMP '1970-01-01', {}) / 1e6)"
TS, ODATE = SECONDS.format("ts"), SECONDS.format("o_orderdate")

# --- corpus evaluation


@query("""
    with c as (select d.doc_id, d.n_chars, l.quality = 1 as passed, l.toxic = 0 as truth, d.n_chars / 1000.0::double as analysis, (d.doc_id % 7)::double as final
               from documents d left join labels l using (doc_id)),
         m as (select *, n_chars < 100 as failed, case when passed is not null and truth is not null then passed and not truth end as false_pass, case when final > 0 then analysis / final end as cost from c)
    select count(*) n_cases, count(*) filter (not failed) n_ok, count(*) filter (failed) n_failed,
           count(*) filter (not failed and false_pass) false_pass_count, count(case when not failed then false_pass end) false_pass_observed,
           round(count(*) filter (not failed and false_pass)::double / nullif(count(case when not failed then false_pass end), 0), 6) false_pass_rate,
           round(avg(case when not failed then cost end), 6) cost_mean, count(case when not failed then cost end) cost_observed,
           coalesce(sum(case when n_chars >= 0 then n_chars end), 0)::bigint n_chars_total
    from m""")
def eval_summary(t):
    """Rates and means of a corpus with explicit denominators."""
    cases = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "n_chars", (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 0).alias("truth"), (F.col("n_chars") / 1000.0).alias("analysis"), (F.col("doc_id") % 7).cast("double").alias("final"))
    cases = cases.withColumn("false_pass", evaluation.false_pass(F.col("passed"), F.col("truth"))).withColumn("cost", evaluation.analysis_cost(F.col("analysis"), F.col("final")))
    out = evaluation.summary(cases, F.col("n_chars") < 100, ["false_pass"], ["cost"], ["n_chars"])
    return out.withColumns({c: F.round(c, 6) for c in ("false_pass_rate", "cost_mean")})


@query("""
    select c_custkey, round(sum(o_totalprice), 2) as selected, round(sum(o_totalprice) - c_acctbal, 2) as regret,
           case when c_acctbal > 0 then round((sum(o_totalprice) - c_acctbal) / c_acctbal, 4) end as relative_regret,
           case when c_acctbal > 0 and c_nationkey <> 3 then c_custkey % 2 = 0 and count(*) <= c_acctbal / 500 end as false_block
    from customer join orders on c_custkey = o_custkey group by c_custkey, c_acctbal, c_nationkey""")
def case_regret(t):
    """A10: absolute and relative regret, null where the best is not positive; sources
    blocked for a size that the whole output keeps, null where something is missing."""
    spent = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("selected"), F.count("*").alias("size"))
    rows = t("customer").join(spent, F.col("c_custkey") == F.col("o_custkey"))
    gap, share = evaluation.regret(F.col("selected"), F.col("c_acctbal"))
    blocked = F.when(F.col("c_nationkey") != 3, F.col("c_custkey") % 2 == 0)
    wrong = evaluation.false_block(blocked, F.col("size"), F.col("c_acctbal") / 500)
    return rows.select("c_custkey", F.round("selected", 2).alias("selected"), F.round(gap, 2).alias("regret"), F.round(share, 4).alias("relative_regret"), wrong.alias("false_block"))


# --- series


@query("select user_id, quantile_disc(value, 0.9) p90, quantile_disc(value, 0.1) p10 from events group by user_id")
def nearest_rank_p90_p10(t):
    """A1, A2."""
    return longkeys.nearest_ranks(t("events"), "user_id", "value", {"p90": 0.9, "p10": 0.1})


@query("""
    with e as (select user_id, value v, event_type = 'error' as cut, row_number() over (partition by user_id order by ts, event_id) = 1 as first from events)
    select user_id, count(*) n, quantile_disc(v, 0.9) p90, quantile_disc(v, 0.9) filter (not cut and not first) p90_inner,
           coalesce(max(case when cut then v end), 0.0)::double max_cut, count(*) filter (cut) n_cuts from e group by user_id""")
def series_metrics(t):
    """Scout metrics of a series."""
    return series.series_metrics(t("events"), "user_id", ["ts", "event_id"], "value", F.col("event_type") == "error")


@query("""
    with r as (select user_id, value, avg(value) over w m, count(value) over w n, count(value) over (partition by user_id) total
               from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row))
    select user_id, round(avg(value), 6) mean, round(min(m) filter (n = least(10, total)), 6) worst,
           round(least(avg(value), min(m) filter (n = least(10, total)) + 4.0), 6) gate from r group by user_id""")
def gate_score(t):
    """Worst rolling mean and gate."""
    out = series.gate_score(t("events"), "user_id", ["ts", "event_id"], "value", 10)
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("mean", "worst", "gate")))


@query(f"""
    with g as (select user_id, {TS} - lag({TS}) over (partition by user_id order by ts, event_id) as step from events),
         s as (select user_id, list_sort(list(step)) l from g where step is not null group by user_id)
    select user_id, round(l[len(l) // 2 + 1], 3) gap from s""")
def upper_median_gap(t):
    """Cadence as the upper median of successive gaps."""
    out = series.upper_median_gap(t("events").select("user_id", seconds("ts").alias("s")), "user_id", "s")
    return out.select("user_id", F.round("gap", 3).alias("gap"))


@query("""
    with m as (select user_id, median(value) median from events group by user_id)
    select user_id, round(any_value(median), 6) median, round(median(abs(value - median)), 6) mad from events join m using (user_id) group by user_id""")
def median_deviation(t):
    """Median and median absolute deviation."""
    out = series.median_deviation(t("events"), "user_id", "value")
    return out.select("user_id", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("""
    with v as (select label, vec_id % 3 cuts, [least(1.0::double, abs(x::double) * 4) for x in embedding[1:7]] r from embeddings),
         x as (select label, i, r[i] v from v, unnest(range(1, 8)) u(i)),
         d as (select label, i, stddev_pop(v) sd, max(v) mx from x group by label, i),
         m as (select label, avg(sd) dispersion, sum((i <= 6 and mx >= 0.65)::int) / 6.0::double high from d group by label),
         g as (select label, count(*) n, sum(cuts) / count(*)::double density, avg(0.27 * r[1] + 0.30 * r[2] + 0.17 * r[3] + 0.08 * r[4] + 0.08 * r[5] + 0.10 * r[6]) mean from v group by label),
         h as (select *, least(1.0, 2.2 * dispersion + 0.12 * density + 0.25 * high) het from m join g using (label))
    select label, round(dispersion, 6) dispersion, round(density, 6) density, round(high, 6) high_modes, round(het, 6) heterogeneity, round(least(1.0, 0.55 * het + 0.30 * mean + 0.15 / sqrt(n)), 6) uncertainty from h""")
def content_statistics(t):
    """A5: dispersion over seven dimensions, cuts a window, share of high ones among the
    first six, and what they leave unsure."""
    risks = F.transform(F.slice("embedding", 1, 7), lambda x: F.least(F.lit(1.0), F.abs(x.cast("double")) * 4))
    rows = t("embeddings").select("label", (F.col("vec_id") % 3).alias("cuts"), risks.alias("risks"))
    out = series.content_statistics(rows, "label", "risks", "cuts")
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("dispersion", "density", "high_modes", "heterogeneity", "uncertainty")))


@query("""
    with f as (select user_id k, event_id n, value v, 20 + user_id % 30 as fps from events),
         g as (select k, n - lag(n) over (partition by k order by n) as gap from f),
         c as (select k, list_sort(list(gap)) l from g where gap is not null group by k),
         w as (select f.k, count(*) cnt, max(fps) fps, coalesce(max(l[len(l) // 2 + 1]), 1) gap from f left join c using (k) group by f.k),
         z as (select k, gap, least(cnt, greatest(1, ceil(fps / gap::double)::bigint)) as rows from w),
         p as (select f.k, f.v, row_number() over (partition by f.k order by n) i, gap, rows from f join z using (k)),
         m as (select a.k, a.i, any_value(a.gap) gap, any_value(a.rows) rows, avg(b.v) mean from p a join p b on a.k = b.k and b.i > a.i - a.rows and b.i <= a.i where a.i >= a.rows group by a.k, a.i)
    select k, any_value(gap)::double gap, any_value(rows) as rows, round(min(mean), 6) worst from m group by k""")
def worst_second(t):
    """The worst mean of one second, its rows by rate and cadence of each series."""
    frames = t("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("n"), "value", (20 + F.col("user_id") % 30).cast("double").alias("fps"))
    out = series.cadenced_worst(frames, "k", "n", "value", "fps")
    return out.select("k", "gap", "rows", F.round("worst", 6).alias("worst"))


@query("select user_id, list_sort(coalesce(list(distinct event_id) filter (event_type = 'error'), [])) as cuts from events group by user_id")
def cut_times(t):
    """The sorted distinct times of a series' cuts."""
    return series.cut_times(t("events"), "user_id", "event_id", F.col("event_type") == "error")


@query("""
    select conv_id, turn, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding)::bigint as record from conversations""")
def record_number(t):
    """Records begin at marker rows."""
    return series.number_records(t("conversations"), "conv_id", ["turn"], F.col("role") == "user").select("conv_id", "turn", F.col("record").cast("long").alias("record"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def json_field(t):
    """A field of semi-structured text by an explicit schema."""
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --- ranks


@query("""
    select o_orderkey, case when count(*) over () = 1 then 0.5 else round(((rank() over (order by o_totalprice) - 1) + (count(*) over (partition by o_totalprice) - 1) / 2.0::double) / (count(*) over () - 1), 9) end as midrank from orders""")
def midrank_global(t):
    """W1 over a whole table, without a window over all rows."""
    return ranks.midrank(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.round("midrank", 9).alias("midrank"))


@query("""
    with r as (select o_orderkey, o_totalprice v, o_orderpriority p, ((rank() over (partition by o_orderpriority order by o_totalprice) - 1) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0::double) / nullif(count(*) over (partition by o_orderpriority) - 1, 0) as mr from orders)
    select o_orderkey, round(0.55 * least(1.0, greatest(0.0, v / 500000.0)) + 0.45 * coalesce(mr, 0.5), 6) as risk from r""")
def risk_vector(t):
    """Value on its scale and rank within a group."""
    rows = ranks.midrank(t("orders"), "o_totalprice", ["o_orderpriority"])
    return rows.select("o_orderkey", F.round(ranks.risk(F.col("o_totalprice"), F.col("midrank"), 500000.0), 6).alias("risk"))


@query("""
    with n as (select user_id, event_id, value, lead(value) over (partition by user_id order by ts, event_id) next_value from events)
    select event_id, value, next_value from n where next_value < value - 0.5""")
def rd_violation(t):
    """Neighbours that fall by more than a tolerance."""
    return ranks.falls(t("events"), "user_id", ["ts", "event_id"], "value", 0.5).select("event_id", "value", "next_value")


@query("""
    with p as (select o_custkey, o_orderkey::double x, o_totalprice y, lead(o_orderkey::double) over w x2, lead(o_totalprice) over w y2 from orders window w as (partition by o_custkey order by o_orderkey)),
         c as (select o_custkey, arg_min(round_even(x + (250000.0 - y) / (y2 - y) * (x2 - x), 0), x) filter (y < 250000 and y2 >= 250000) c, min(x) filter (y >= 250000) p from p group by o_custkey)
    select o_custkey, coalesce(c, p) as x_at from c where coalesce(c, p) is not null""")
def threshold_interp(t):
    """First crossing of a target, interpolated."""
    rows = t("orders").select("o_custkey", F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return ranks.threshold_crossing(rows, "o_custkey", "x", "y", 250000.0)


@query("""
    with s as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when l_partkey < m * 1 / 4 then 0 when l_partkey < m * 2 / 4 then 1 when l_partkey < m * 3 / 4 then 2 else 3 end as bin
               from lineitem, (select max(p_partkey)::double m from part))
    select bin, l_orderkey, l_linenumber, l_extendedprice from s qualify row_number() over (partition by bin order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) = 1""")
def strata_top1(t):
    """Best of every equal part of an axis, with full tie-breaks."""
    rows = t("lineitem").crossJoin(F.broadcast(t("part").agg(F.max("p_partkey").cast("double").alias("m"))))
    rows = rows.withColumn("bin", ranks.stratum(F.col("l_partkey"), F.col("m"), 4))
    best = rows.groupBy("bin").agg(F.min_by(F.struct("l_orderkey", "l_linenumber", "l_extendedprice"), F.struct(-F.col("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")).alias("r"))
    return best.select("bin", "r.*")


def _segments(t, orders="true"):
    keys = t("customer").select(F.col("c_custkey").alias("k"))
    points = keys.join(t("orders").where(orders).select(F.col("o_custkey").alias("k"), seconds("o_orderdate").alias("p")), "k", "left")
    return ranks.segments(points, "k", "p", F.lit(6e8), F.lit(1.2e9))


@query(f"""
    with cuts as (select o_custkey k, {ODATE} p from orders where {ODATE} > 6e8 and {ODATE} < 1.2e9 and o_custkey in (select c_custkey from customer) union select c_custkey, 6e8 from customer union select c_custkey, 1.2e9 from customer)
    select k, p::double as start, lead(p) over (partition by k order by p)::double as "end" from cuts qualify "end" is not null""")
def segments(t):
    """Parts between sorted cuts, bounds included."""
    return _segments(t)


@query("""
    select o_orderkey, i as nth, round(case when n = 1 then o_totalprice / 2 else i * o_totalprice / (n - 1) end, 6) as start
    from (select o_orderkey, o_totalprice, 1 + o_orderkey % 5 as n, unnest(range(0, (1 + o_orderkey % 5)::bigint)) i from orders)""")
def even_windows(t):
    """Evenly spaced starts, a lone one centred."""
    rows = t("orders").select("o_orderkey", F.posexplode(ranks.even_starts(F.col("o_totalprice"), (1 + F.col("o_orderkey") % 5))).alias("nth", "start"))
    return rows.select("o_orderkey", F.col("nth").cast("long").alias("nth"), F.round("start", 6).alias("start"))


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10")
def recent_k(t):
    """The ten latest of each key."""
    return ranks.first_by(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "event_type")


@query("select o_orderkey, ((row_number() over (order by o_orderdate, o_orderkey) - 1) % 3)::int as lane from orders")
def round_robin(t):
    """Lanes by place in the whole order."""
    return ranks.round_robin(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 3).select("o_orderkey", "lane")


@query("select conv_id, turn, round(row_number() over (partition by conv_id order by turn) * 100.0::double / count(*) over (partition by conv_id), 6) as percent from conversations")
def running_percent(t):
    """Progress by running index."""
    by = Window.partitionBy("conv_id")
    return t("conversations").select("conv_id", "turn", F.round(F.row_number().over(by.orderBy("turn")) * 100.0 / F.count("*").over(by), 6).alias("percent"))


def _hardest(rows):
    each = rows.select("vec_id", F.array_position("s", F.array_min("s")).alias("arg"), F.posexplode("s").alias("pos", "v"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("pos") != F.col("arg") - 1, "pos"))
    return each.select("vec_id", F.col("pos").cast("long").alias("pos"), place.cast("long").alias("rank"))


@query("select vec_id, i - 1 as pos, row_number() over (partition by vec_id order by (i - 1) <> arg, i) as rank from (select vec_id, unnest(range(1, len(embedding) + 1)) i, list_position(embedding, list_min(embedding)) - 1 arg from embeddings)")
def hardest_first(t):
    """The least score first, the others in order."""
    return _hardest(t("embeddings").select("vec_id", F.col("embedding").alias("s")))


@query("select distinct lang, (row_number() over (order by lang <> 'en', lang))::bigint as place from (select distinct lang from documents where lang is not null)")
def english_first(t):
    """Languages with English first (as many rows as languages)."""
    langs = t("documents").where("lang is not null").select("lang").distinct()
    return langs.select("lang", F.row_number().over(Window.orderBy(F.col("lang") != "en", "lang")).cast("long").alias("place"))


# --- intervals

WIN30 = f"(select o_custkey k, o_orderkey id, {ODATE} as start, {ODATE} + 30 * 86400.0 as \"end\" from orders)"


def _windows(t, days, where="true"):
    start = seconds("o_orderdate")
    return t("orders").where(where).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + days * DAY).alias("end"))


@query(f"""
    select a.k, a.id, b.id as id_r from {WIN30} a join {WIN30} b on a.k = b.k and a.id < b.id and a.start < b."end" - 1e-9 and b.start < a."end" - 1e-9""")
def interval_overlap(t):
    """Overlapping pairs, by bins of every size."""
    w = _windows(t, 30)
    return intervals.overlap_join(w, w, "k").where("id < id_r").select("k", "id", "id_r")


@query(f"""
    select a.k, a.id from (select * from {WIN30}) a join orders o on o.o_orderkey = a.id and o.o_orderstatus <> 'P'
    where not exists (select 1 from {WIN30} b join orders p on p.o_orderkey = b.id and p.o_orderstatus = 'P' where b.k = a.k and a.start < b."end" - 1e-9 and b.start < a."end" - 1e-9)""")
def anti_overlap(t):
    """Windows that overlap no protected one."""
    return intervals.overlap_anti(_windows(t, 30, "o_orderstatus <> 'P'"), _windows(t, 30, "o_orderstatus = 'P'"), "k").select("k", "id")


@query(f"""
    select w.k, w.id, p.point from (select o_custkey k, o_orderkey id, {ODATE} as start, {ODATE} + 60 * 86400.0 as "end" from orders) w
    join (select o_custkey k, {ODATE} as point from orders where o_orderstatus = 'F') p on p.k = w.k and p.point > w.start + 1e-9 and p.point < w."end" - 1e-9""")
def point_in_interval(t):
    """Points strictly inside windows."""
    points = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), seconds("o_orderdate").alias("point"))
    return intervals.points_inside(_windows(t, 60), points, "k")


@query(f"""
    with recursive w as (select o_custkey k, o_orderkey id, {ODATE} as start, {ODATE} + 90 * 86400.0 as "end" from orders),
    taken as (
        select k, id, start, "end" from (select *, row_number() over (partition by k order by "end", start, id) n from w) where n = 1
        union all
        select n.k, n.id, n.start, n."end" from taken t, lateral (select * from w where w.k = t.k and w.start >= t."end" - 1e-9 order by w."end", w.start, w.id limit 1) n)
    select k, id from taken""")
def capacity(t):
    """G1: the most windows that don't overlap."""
    return intervals.capacity(_windows(t, 90), "k", settled).select("k", "id")


def _aligned(t):
    out = intervals.align_to_segments(_windows(t, 20), _segments(t, "o_orderstatus = 'F'"), "k")
    return out.select("k", "id", F.round("new_start", 3).alias("new_start"), "moved", "held")


@query(f"""
    with w as (select o_custkey k, o_orderkey id, {ODATE} as start, {ODATE} + 20 * 86400.0 as "end" from orders),
    cuts as (select o_custkey k, {ODATE} p from orders where o_orderstatus = 'F' and {ODATE} > 6e8 and {ODATE} < 1.2e9 and o_custkey in (select c_custkey from customer) union select c_custkey, 6e8 from customer union select c_custkey, 1.2e9 from customer),
    s as (select k, p as s, lead(p) over (partition by k order by p) as e from cuts qualify e is not null),
    f as (select w.k, w.id, w.start, least(greatest(w.start, s.s), s.e - (w."end" - w.start)) as goal from w join s on s.k = w.k and s.e - s.s >= w."end" - w.start - 1e-9)
    select w.k, w.id, round(coalesce(b.goal, w.start), 3) as new_start, abs(coalesce(b.goal, w.start) - w.start) > 1e-9 as moved, b.id is not null as held
    from w left join (select * from f qualify row_number() over (partition by k, id order by abs(goal - start), goal) = 1) b on b.k = w.k and b.id = w.id""")
def shot_align(t):
    """Windows moved into the nearest segment that holds them."""
    return _aligned(t)


@query("""
    select s.s_suppkey, round(coalesce((select min(abs(a.s_acctbal - s.s_acctbal)) from supplier a where a.s_nationkey = s.s_nationkey and a.s_suppkey % 2 = 1), 10000.0), 6) as distance
    from supplier s where s.s_suppkey % 2 = 0""")
def min_anchor_distance(t):
    """Distance to the nearest anchor of a group, with a default."""
    s = t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    out = intervals.nearest_distance(s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 2 = 1"), "s_nationkey", "s_acctbal", 10000.0)
    return out.select("s_suppkey", F.round("distance", 6).alias("distance"))


@query("""
    with m as (select s_nationkey n, avg(s_acctbal) mid from supplier group by s_nationkey)
    select c_nationkey, c_custkey from customer join m on n = c_nationkey qualify row_number() over (partition by c_nationkey order by abs(c_acctbal - mid), c_acctbal, c_custkey) = 1""")
def nearest_row(t):
    """The row nearest to a middle, with tie-breaks."""
    mid = t("supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.avg("s_acctbal").alias("mid"))
    rows = t("customer").join(mid, "c_nationkey")
    return rows.groupBy("c_nationkey").agg(F.min(F.struct(F.abs(F.col("c_acctbal") - F.col("mid")), "c_acctbal", "c_custkey"))["c_custkey"].alias("c_custkey"))


# --- fits and selection


@query("""
    with p as (select a.s_nationkey n, (b.s_acctbal - a.s_acctbal) / (b.s_suppkey - a.s_suppkey) s from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey),
    m as (select s_nationkey n, coalesce(any_value(sl), 0.0) sl from supplier left join (select n, median(s) sl from p group by n) on n = s_nationkey group by s_nationkey)
    select s_nationkey, round(any_value(sl), 6) slope, round(median(s_acctbal - sl * s_suppkey), 6) "intercept", count(*) n from supplier join m on n = s_nationkey group by s_nationkey""")
def theil_sen(t):
    """Robust line of a group."""
    out = robust.theil_sen(t("supplier"), "s_nationkey", "s_suppkey", "s_acctbal")
    return out.select("s_nationkey", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


CHOICE = """
    with c as (select o_custkey, o_totalprice cost, (o_orderkey % 100)::double q, o_totalprice <= 200000 fits, o_totalprice < 5000 small from orders)
    select o_custkey, min(cost) filter (q >= 60) required, coalesce(min(cost) filter (q >= 60 and fits and q >= 80), min(cost) filter (q >= 60 and fits)) selected,
           arg_min(cost, (-q, cost)) filter (fits) best_fit, bool_or(small) small from c group by o_custkey"""


def _choices(t):
    rows = t("orders").select("o_custkey", F.col("o_totalprice").alias("cost"), (F.col("o_orderkey") % 100).cast("double").alias("q"))
    return selection.choose(rows, "o_custkey", "cost", "q", F.col("cost") <= 200000, 60.0, 20.0, F.col("cost") < 5000)


@query(f"select o_custkey, required, selected, best_fit from ({CHOICE})")
def cheapest_and_best(t):
    """Cheapest that passes, with margin preferred; best that fits."""
    return _choices(t).select("o_custkey", "required", "selected", "best_fit")


@query(f"select o_custkey, case when selected is not null then 'found' when small then 'budget_too_small' when required is not null then 'size_blocked' else 'unreachable' end as outcome from ({CHOICE})")
def failure_taxonomy(t):
    """Kind of outcome of a source."""
    return _choices(t).select("o_custkey", "outcome")


@query("select o_custkey, max(o_totalprice) filter (o_orderkey % 100 < 60) as lower, min(o_totalprice) filter (o_orderkey % 100 >= 60) as seed from orders group by o_custkey")
def search_bounds(t):
    """Bounds of an exact search from coarse candidates."""
    return selection.search_bounds(t("orders").withColumn("q", F.col("o_orderkey") % 100), "o_custkey", "o_totalprice", "q", 60)


@query("select event_id, user_id from events qualify coalesce(sum((value < 5)::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 0")
def early_reject(t):
    """Rows up to the first failure."""
    return selection.until_first(t("events"), "user_id", ["ts", "event_id"], F.col("value") < 5).select("event_id", "user_id")


@query("select vec_id, len(embedding) = 64 and abs(list_min(embedding) - list_min(embedding[1:32])) <= 1e-9 as complete from embeddings")
def array_min_complete(t):
    """Complete score arrays whose minimum agrees."""
    return t("embeddings").select("vec_id", selection.complete(F.col("embedding"), F.array_min(F.slice("embedding", 1, 32)), 64).alias("complete"))


# --- joins on keys


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def key_anti(t):
    """Keys that are not in a history."""
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select d.doc_id, coalesce(l.quality, 0.5::double)::double risk from documents d left join labels l using (doc_id)")
def lookup_default(t):
    """Lookup with a default."""
    labels = t("labels").select("doc_id", F.col("quality").cast("double").alias("risk"))
    return catalogs.overlay(t("documents").select("doc_id", F.lit(None).cast("double").alias("risk")), [labels], "doc_id", "risk", 0.5)


@query("select c.c_custkey, coalesce(o.v, s.v, c.c_acctbal) as v from customer c left join (select o_custkey k, max(o_totalprice) v from orders group by 1) o on o.k = c_custkey left join (select s_suppkey k, s_acctbal v from supplier) s on s.k = c_custkey")
def overlay(t):
    """Layers with precedence."""
    base = t("customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    top = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    second = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("v"))
    return catalogs.overlay(base, [top, second], "c_custkey", "v")


@query("select c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) last_order from customer join orders on o_custkey = c_custkey group by c_custkey")
def last_result(t):
    """The last result of each item."""
    rows = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("o"))
    last = catalogs.last_per_key(rows, "c_custkey", "o").select("c_custkey", F.col("o_orderkey").alias("last_order"))
    return t("customer").select("c_custkey").join(last, "c_custkey")


@query("select n.n_nationkey, s.s_suppkey from nation n join supplier s on s.s_nationkey = n.n_nationkey and s.s_suppkey % 5 = n.n_regionkey")
def capability_lookup(t):
    """Equality on keys and on the expected name."""
    n, s = t("nation"), t("supplier")
    return n.join(s, (n.n_nationkey == s.s_nationkey) & (s.s_suppkey % 5 == n.n_regionkey)).select("n_nationkey", "s_suppkey")


# --- state


@query("""
    select user_id, arg_max(event_type, event_id) last_type, arg_max(value, event_id) filter (value > 50) last_large, max(event_id) last_event from events group by user_id""")
def state_fold(t):
    """Last known fields of each key."""
    fields = {"last_type": F.col("event_type"), "last_large": F.when(F.col("value") > 50, F.col("value")), "last_event": F.col("event_id")}
    return state.fold(t("events"), "user_id", ["event_id"], fields)


QUEUE = "select event_id id, user_id, value dur, event_id % 130 - 10 pct, 1 + event_id % 2 passes, case when event_id % 3 = 0 then value || 'x' when event_id % 3 = 1 then 'n/a' end sp, case event_id % 9 when 0 then 'queued' when 1 then 'waiting_analysis' when 2 then 'analyzing' when 3 then 'encoding' when 4 then 'failed' when 5 then 'needs_decision' when 6 then 'done' when 7 then 'skipped' else 'cancelled' end st from events"


@query(f"""
    with q as ({QUEUE}), w as (select *, greatest(0, dur) * greatest(passes, 1) weight, case when st in ('done', 'skipped') then 1.0 when st = 'needs_decision' then 0.99 else greatest(0, least(100, pct)) / 100.0 end share from q),
    last as (select * from w where st in ('analyzing', 'encoding') order by id desc limit 1),
    m as (select count(*) n, count(*) filter (st in ('queued', 'waiting_analysis')) n_queued, count(*) filter (st in ('analyzing', 'encoding')) n_running, count(*) filter (st = 'failed') n_failed, count(*) filter (st = 'needs_decision') n_needs_decision,
          count(*) filter (st = 'done') n_done, count(*) filter (st = 'skipped') n_skipped, count(*) filter (st = 'cancelled') n_cancelled, sum(dur) filter (dur > 0) duration, sum(weight) total, sum(weight * share) finished from w)
    select n, n_queued, n_running, n_failed, n_needs_decision, n_done, n_skipped, n_cancelled, n_done + n_skipped as n_completed, n_queued as n_ready, round(m.duration, 3) duration, round(total, 3) total, round(finished, 3) finished,
           last.sp as speed, last.id as current, last.pct::double as current_percent, last.dur as current_duration, last.user_id as current_name,
           round(greatest(0.0, least(100.0, finished / total * 100)), 6) percent,
           round((total - finished) / nullif(try_cast(regexp_extract(last.sp, '^([0-9]+([.][0-9]+)?)x$', 1) as double), 0), 3) eta
    from m, last""")
def queue_metrics(t):
    """One row of queue metrics."""
    n = F.col("event_id")
    states = ["queued", "waiting_analysis", "analyzing", "encoding", "failed", "needs_decision", "done", "skipped", "cancelled"]
    status = F.element_at(F.array(*(F.lit(s) for s in states)), (n % 9 + 1).cast("int"))
    speed = F.when(n % 3 == 0, F.concat(F.col("value").cast("string"), F.lit("x"))).when(n % 3 == 1, "n/a")
    rows = t("events").select("event_id", "user_id", status.alias("st"), F.col("value").alias("dur"), (n % 130 - 10).cast("double").alias("pct"), (1 + n % 2).alias("passes"), speed.alias("sp"))
    out = state.queue_metrics(rows, "st", "dur", "pct", "event_id", "sp", "passes", "user_id")
    return out.withColumns({c: F.round(c, 3) for c in ("duration", "total", "finished", "eta")} | {"percent": F.round("percent", 6)})


@query("select round(sum(o_totalprice - c_acctbal * 40) filter (o_totalprice > 0 and c_acctbal > 0), 2) saved, count(*) filter (o_totalprice > 0 and c_acctbal > 0) n from orders join customer on c_custkey = o_custkey")
def saved_bytes(t):
    """Savings over rows with an estimate, losses among them."""
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("estimate", F.col("c_acctbal") * 40)
    return state.saved_bytes(rows, "o_totalprice", "estimate").select(F.round("saved", 2).alias("saved"), "n")


@query("""
    with a as (select o_custkey k, arg_max(case o_orderkey % 5 when 0 then 'start' when 1 then 'retry' when 2 then 'cancel' when 3 then 'fail' else 'done' end, o_orderkey) c from orders group by 1),
    p as (select o_custkey k, arg_max(case o_orderkey % 5 when 0 then 0.0 when 1 then 0.0 else 100.0 end, o_orderkey) filter (o_orderkey % 5 in (0, 1, 4)) pct,
                 arg_max(case o_orderkey % 5 when 2 then 'because of ' || o_orderkey when 3 then 'because of ' || o_orderkey end, o_orderkey) filter (o_orderkey % 5 in (2, 3)) msg,
                 max(o_orderkey) filter (o_orderkey % 5 in (0, 1, 4)) cleared, max(o_orderkey) filter (o_orderkey % 5 in (2, 3)) told from orders group by 1)
    select c_custkey, case a.c when 'start' then case when c_custkey % 2 = 0 then 'waiting_analysis' else 'encoding' end when 'retry' then case when c_custkey % 2 = 0 then 'waiting_analysis' else 'queued' end when 'cancel' then 'cancelled' when 'fail' then 'failed' when 'done' then 'done' else 'queued' end as status,
           coalesce(p.pct, 7.0)::double as pass_percent, case when p.told > coalesce(p.cleared, -1) then p.msg when p.cleared is not null then null else 'none' end as error
    from customer left join a on a.k = c_custkey left join p on p.k = c_custkey""")
def lifecycle(t):
    """Rows after all commands of their keys."""
    n = F.col("o_orderkey")
    names = ["start", "retry", "cancel", "fail", "done"]
    commands = t("orders").select(F.col("o_custkey").alias("c_custkey"), n.alias("seq"), F.element_at(F.array(*(F.lit(x) for x in names)), (n % 5 + 1).cast("int")).alias("command"), n.cast("double").alias("at"), F.concat(F.lit("because of "), n.cast("string")).alias("message"))
    rows = t("customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("smart"), F.lit("queued").alias("status"), F.lit(7.0).alias("pass_percent"), F.lit("none").alias("error"))
    return state.transition(rows, commands, "c_custkey", "seq").select("c_custkey", "status", "pass_percent", "error")


@query("select event_id, case when event_type = 'view' then 'needs_decision' when event_type = 'signup' then 'skipped' when value > 40 then 'done' else 'failed' end as outcome, round(least(100.0, greatest(0.0, (event_id % 2 + least(100.0, value) / 100) / 2 * 100)), 6) as percent from events")
def terminal_state(t):
    """Outcome by precedence, progress over two passes."""
    e = F.col("event_type")
    done = state.outcome(e == "view", e == "signup", F.col("value") > 40)
    percent = state.pass_percent(F.col("event_id") % 2 + 1, F.least(F.lit(100.0), "value"), F.lit(2))
    return t("events").select("event_id", done.alias("outcome"), F.round(percent, 6).alias("percent"))


# --- sets, rules and expressions


@query("select k, 'missing' as side from (select distinct s_suppkey k from supplier except select c_custkey from customer where c_custkey % 3 = 0) union all select k, 'extra' from (select c_custkey k from customer where c_custkey % 3 = 0 except select s_suppkey from supplier)")
def set_difference(t):
    """Keys only one side has."""
    left = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return catalogs.key_differences(left, t("supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("select page_id, case when regexp_matches(url, '^https://.*$') then 'secure' when regexp_matches(url, '/en/') then 'english' when regexp_matches(url, '[?]') then 'query' else 'other' end as route from pages")
def rule_route(t):
    """The first rule that matches."""
    return t("pages").select("page_id", catalogs.first_rule(F.col("url"), [("^https://.*$", "secure"), ("/en/", "english"), ("[?]", "query")], "other").alias("route"))


@query("select list_sort(list(distinct f)) as features from (select unnest(case when url like 'https://%' then ['lint', 'tls'] when url like '%/en/%' then ['docs'] else ['docs', 'lint', 'tls', 'unit'] end) f from pages)")
def required_features(t):
    """Union of what changed paths need."""
    return catalogs.required_features(t("pages"), "url", [("https://*", ["lint", "tls"]), ("*/en/*", ["docs"])], ["unit", "docs", "lint", "tls"])


@query("select distinct role as value, 'conversations' as src from conversations union select distinct lang, 'documents' from documents where lang is not null")
def set_union(t):
    """Union of key sets."""
    return t("conversations").select(F.col("role").alias("value"), F.lit("conversations").alias("src")).unionByName(t("documents").where("lang is not null").select(F.col("lang").alias("value"), F.lit("documents").alias("src"))).distinct()


@query("select conv_id, string_agg(role, ',' order by o) as roles from (select conv_id, role, min(turn) o from conversations group by conv_id, role) group by conv_id")
def distinct_in_order(t):
    """Distinct values by first appearance."""
    return catalogs.distinct_in_order(t("conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("values", ",").alias("roles"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(greatest(round_even(l_extendedprice * 0.76, 0)::bigint, 20000), 50000) as rate, greatest(1000, floor(l_extendedprice / 1000)::bigint * 1000) as low_step, greatest(1000, ceil(l_extendedprice / 1000)::bigint * 1000) as high_step, ceil((l_extendedprice + 128) * l_quantity / 8 / 0.98)::bigint as size from lineitem")
def rate_clamps(t):
    """Targets, steps and predicted sizes."""
    p = F.col("l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.target_rate(p, 0.76, 20, 0).alias("rate"), X.floor_step(p).alias("low_step"), X.ceil_step(p).alias("high_step"), X.predicted_size(p, F.lit(128), F.col("l_quantity")).alias("size"))


@query("select o_orderkey, floor(greatest(1, floor(o_totalprice * 0.7)::bigint) * 8 * 0.98 / (1 + o_orderkey % 100))::bigint - 128000 as budget, greatest(5000, round_even(o_totalprice * 0.02, 0)::bigint) as tolerance from orders")
def rate_budget(t):
    """Budgets and search tolerances."""
    return t("orders").select("o_orderkey", X.rate_budget(F.col("o_totalprice"), 1 + F.col("o_orderkey") % 100, F.lit(128000), 0.7).alias("budget"), X.search_tolerance(F.col("o_totalprice"), 5000, 0.02).alias("tolerance"))


@query("select case when n_chars < 600 then 3 when n_chars < 3600 then 4 when n_chars <= 10800 then 5 else 6 end as windows, count(*) n from documents group by 1")
def duration_bucket(t):
    """Configured counts by length."""
    return t("documents").groupBy(X.by_limits(F.col("n_chars"), [(600, 3), (3600, 4), (10800, 5)], 6, closed=1).alias("windows")).agg(F.count("*").alias("n"))


@query(r"""
    with n as (select page_id, url, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1') stem from pages),
         s as (select page_id, url, stem, regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') safe from n)
    select page_id, case when safe = '' then 'item' else safe end || '_' || substr(sha1(url), 1, 10) as token, '/w/logs/' || case when safe = '' then 'item' else safe end || '_' || substr(sha1(url), 1, 10) || '_encode.log' as log,
           '/w/preview/' || case when safe = '' then 'item' else safe end || '_' || substr(sha1(url), 1, 10) || '/' || stem || '_hevc_preview.mkv' as sample from s""")
def safe_token(t):
    """stable names and the paths made of them."""
    paths = X.work_paths(F.lit("/w"), F.col("url"), "hevc", "mkv", "encode")
    return t("pages").select("page_id", X.source_token(F.col("url")).alias("token"), paths["log"].alias("log"), paths["encoded_sample"].alias("sample"))


@query(r"select doc_id, case when length(f) <= 40 then f else rtrim(substr(f, 1, 37), ' ') || '...' end as short from (select doc_id, coalesce(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '') f from documents)")
def short_text(t):
    """shortened text."""
    return t("documents").select("doc_id", X.shorten(F.col("text"), 40).alias("short"))


@query("""
    select p_partkey, case when p_size % 4 = 3 then null else round_even(p_size * case p_size % 4 when 0 then 1000 when 1 then 1000000 else 1 end, 0)::bigint end as rate,
           case p_size % 4 when 0 then floor((p_size + 0.98765::double) * 1000)::bigint when 1 then 0 when 2 then p_size::bigint * 1000000000 end as rate_down,
           case when p_size % 3 = 0 then null when p_size % 3 = 1 then p_size + 0.5::double end as speed, p_size * 3600 + 120 + 3.5::double as clock, p_size / 1001.0::double as fraction, case when p_size % 2 = 0 then p_size else 0 end::bigint as lenient from part where p_size > 0""")
def parse_units(t):
    """Numbers in text."""
    s, n = F.col("p_size").cast("string"), F.col("p_size")
    unit = F.element_at(F.array(F.lit("k"), F.lit("M"), F.lit(""), F.lit("q")), n % 4 + 1)
    return t("part").where("p_size > 0").select(
        "p_partkey",
        X.parse_rate(F.concat(s, unit)).alias("rate"),
        X.parse_rate_down(F.when(n % 4 == 0, F.concat(s, F.lit(".98765K "))).when(n % 4 == 1, "0m").when(n % 4 == 2, F.concat(s, F.lit("g"))).otherwise(F.concat(s, F.lit("q")))).alias("rate_down"),
        X.parse_speed(F.when(n % 3 == 0, F.concat(s, F.lit(".5"))).when(n % 3 == 1, F.concat(s, F.lit(".5x"))).otherwise("0x")).alias("speed"),
        X.parse_clock(F.concat(s, F.lit(":2:3.50"))).alias("clock"),
        X.parse_fraction(F.concat(s, F.lit("/1001"))).alias("fraction"),
        X.lenient_long(F.when(n % 2 == 0, F.concat(s, F.lit(".7"))).otherwise("x")).alias("lenient"),
    )


@query("""
    with d as (select doc_id, case when doc_id % 10 = 9 then null else (n_chars - 300) * 37 end b, case when doc_id % 10 = 8 then null when doc_id % 10 = 7 then 0.0 else n_chars * 1.7::double end s from documents)
    select doc_id, case when b is null then 'n/a' else case when b < 0 then '-' else '' end || case when abs(b) < 1024 then printf('%.2f B', abs(b)::double) when abs(b) < 1048576 then printf('%.2f KiB', abs(b) / 1024.0::double) else printf('%.2f MiB', abs(b) / 1048576.0::double) end end as size,
           case when coalesce(s, 0) = 0 then 'n/a' when round_even(s, 0) < 3600 then printf('%d:%02d', round_even(s, 0)::bigint // 60, round_even(s, 0)::bigint % 60) else printf('%d:%02d:%02d', round_even(s, 0)::bigint // 3600, round_even(s, 0)::bigint // 60 % 60, round_even(s, 0)::bigint % 60) end as duration,
           case when doc_id % 3 = 0 then '-' else n_chars || 'x' || doc_id end as geometry from d join documents using (doc_id)""")
def human_labels(t):
    """sizes, durations and geometry in words, what is missing too."""
    n, m = F.col("doc_id"), F.col("n_chars")
    size = F.when(n % 10 != 9, (m - 300) * 37)
    seconds = F.when(n % 10 == 7, 0.0).when(n % 10 != 8, m * 1.7)
    return t("documents").select("doc_id", X.human_size(size).alias("size"), X.human_duration(seconds).alias("duration"), X.geometry_label(F.when(n % 3 != 0, m), n).alias("geometry"))


@query(r"select event_id, case when starts_with(l, '$ ') then 'command' when regexp_matches(lower(l), 'error|failed|traceback|cancelled') then 'error' else 'process' end as kind from (select event_id, case when event_id % 5 = 0 then '$ ' else '' end || event_type || ' ' || props as l from events)")
def classify_lines(t):
    """Log lines by class."""
    line = F.concat(F.when(F.col("event_id") % 5 == 0, "$ ").otherwise(""), "event_type", F.lit(" "), "props")
    return t("events").select("event_id", X.classify_line(line).alias("kind"))


@query("""
    select p_partkey, case p_size % 12 when 0 then 8 when 1 then 8 when 2 then 10 when 3 then 10 when 4 then 8 when 5 then 10 when 6 then 12 when 7 then null when 8 then 16 when 9 then null when 10 then null else 14 end::int as bits from part""")
def bit_depths(t):
    """depth from a format name."""
    names = [" YUV420P", "yuvj444p", "p210le", "p010", "bgr24", "yuv422p10be", "yuv420p12", "rgb48le", "gray16le", "gray", "yuv444p11le", "gbrp14"]
    name = F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("p_size") % 12 + 1).cast("int"))
    return t("part").select("p_partkey", X.bit_depth(name).cast("int").alias("bits"))


@query("select o_orderkey, concat_ws(',', case when o_orderstatus = 'F' then 'final' end, case when o_totalprice > 300000 then 'large' end, case when o_orderpriority like '1%' then 'urgent' end) as tags from orders")
def condition_tags(t):
    """Tags whose condition holds."""
    tags = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "final"), F.when(F.col("o_totalprice") > 300000, "large"), F.when(F.col("o_orderpriority").startswith("1"), "urgent")))
    return t("orders").select("o_orderkey", F.array_join(tags, ",").alias("tags"))


@query("select st as o_orderstatus, coalesce(n, 0) n from (values ('F'), ('O'), ('P'), ('X')) d(st) left join (select o_orderstatus, count(*) n from orders group by 1) on o_orderstatus = st")
def empty_groups(t):
    """Groups of a domain, empty ones included."""
    spark = t("orders").sparkSession
    domain = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "o_orderstatus string")
    return domain.join(t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), "o_orderstatus", "left").select("o_orderstatus", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("select o_custkey, count(*) as n, count(distinct o_orderpriority) = 1 as same, bool_or(o_orderstatus = 'P') as any_pending, bool_and(o_totalprice > 10000) as all_large from orders group by o_custkey")
def consistency(t):
    """One setting for all, any and every."""
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.count_distinct("o_orderpriority") == 1).alias("same"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.bool_and(F.col("o_totalprice") > 10000).alias("all_large"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, ceil(l_extendedprice * 8 / l_quantity)::bigint as observed, case when l_discount = 0 then 0.0::double else round(l_tax / l_discount, 6) end as ratio from lineitem")
def observed_rates(t):
    """Observed rates and sample ratios, 0 without a sample."""
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.ceil(F.col("l_extendedprice") * 8 / F.col("l_quantity")).cast("long").alias("observed"), F.when(F.col("l_discount") == 0, 0.0).otherwise(F.round(F.col("l_tax") / F.col("l_discount"), 6)).alias("ratio"))


@query("""
    with c as (select c_custkey i, 1000000 + c_custkey * 10 size, c_custkey % 2 = 0 has_rate, c_custkey % 3 sound, c_custkey % 5 = 0 has_video, c_custkey % 7 format_seconds, c_custkey % 4 own_seconds from customer),
    d as (select *, case when format_seconds > 0 then format_seconds * 10.5::double when own_seconds > 0 then own_seconds * 7.0::double end dur, case sound when 0 then 0 when 1 then 128000 else 2256000 end audio from c),
    r as (select *, case when has_rate then 900000 + i else greatest(1, round_even(size * 8 / dur, 0)::bigint) end rate from d)
    select i as id, dur as duration, rate::bigint as rate, audio::bigint as audio_rate, sound::int as audio_streams, case when has_video then 777000 when rate - audio > 0 then rate - audio else greatest(300000, round_even(rate * 0.85::double, 0)::bigint) end::bigint as video_rate,
           case when i % 6 = 0 then 12 else 10 end as bits, case when sound > 0 then 'aac' end as audio_codec, case when dur is null then 'no duration' end as reason from r""")
def media_rows(t):
    """Media rows with all their fallbacks."""
    n = F.col("c_custkey")
    text = lambda value: F.when(value > 0, value.cast("string"))
    tone = lambda rate: F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(None).cast("string").alias("duration"), F.lit(rate).alias("bit_rate"), *(F.lit(None).cast("string").alias(c) for c in ("pix_fmt", "bits_per_raw_sample")))
    own = F.when(n % 4 > 0, (n % 4 * 7.0).cast("string")).otherwise("0.0")
    picture = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), own.alias("duration"), F.when(n % 5 == 0, "777000").otherwise("N/A").alias("bit_rate"), F.lit("yuv420p10le").alias("pix_fmt"), F.when(n % 6 == 0, "12").alias("bits_per_raw_sample"))
    sounds = F.when(n % 3 == 0, F.array(picture)).when(n % 3 == 1, F.array(tone("128000"), picture)).otherwise(F.array(tone("256000"), picture, tone("2000000.9")))
    form = F.struct(text(n % 7 * 10.5).alias("duration"), F.when(n % 2 == 0, (900000 + n).cast("string")).otherwise("0").alias("bit_rate"))
    probes = t("customer").select(n.alias("id"), F.to_json(F.struct(form.alias("format"), sounds.alias("streams"))).alias("value"), (1000000 + n * 10).alias("size"))
    return readers.media_rows(probes).select("id", "duration", "rate", "audio_rate", "audio_streams", "video_rate", "bits", "audio_codec", "reason")


@query("""
    with w as (select l_orderkey k, least(4.0, greatest(0.0001, l_extendedprice / 40000)) y, l_quantity / 50 x, l_tax t from lineitem),
    u as (select k, y, x, t, row_number() over (partition by k order by x, y, t) i from w),
    s as (select a.k, median((b.y - a.y) / (b.x - a.x)) slope from u a join u b on a.k = b.k and a.i < b.i and abs(b.x - a.x) > 1e-9 group by a.k),
    z as (select k, any_value(case when slope is null then 0.0 else least(0.75, greatest(-0.75, slope)) end) slope from u left join s using (k) group by k),
    l as (select k, any_value(slope) slope, median(y - slope * x) low, case when count(*) > 1 then stddev_pop(t) else 0 end varied, count(*) n from u join z using (k) group by k),
    f as (select k, avg(least(4.0, greatest(0.0001, low + slope * t))) central, median(abs(y - least(4.0, greatest(0.0001, low + slope * x)))) mad, any_value(varied) varied, any_value(n) n from u join l using (k) group by k),
    e as (select *, least(0.30, greatest(0.05, 0.03 + 0.14 / sqrt(n) + 1.5 * mad + 0.20 * varied)) unsure, greatest(1, round_even(40000 * central, 0)::bigint) mean from f)
    select k, mean as mean_rate, greatest(mean, round_even(mean * (1 + round(unsure, 9)), 0)::bigint) as upper_rate, round(unsure, 6) as uncertainty from e""")
def size_predictions(t):
    """Rates of sources from those of their windows, by a robust line over
    the windows' risks."""
    window = F.struct((F.col("l_quantity") / 50).alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("t"))
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(window)).alias("w"))
    rows = rows.select("k", *(F.col(f"w.{c}").alias(c) for c in ("x", "y", "t")), F.lit(40000).alias("asked"), F.lit(60.0).alias("duration"), F.lit(0).alias("audio"), F.lit(None).cast("long").alias("source"))
    out = sizes.predicted_sizes(rows, "asked", "y", "duration", "audio", "source", "x", "t")
    upper = F.greatest(F.col("mean_rate"), X.whole(F.col("mean_rate") * (1 + F.round("uncertainty", 9))))
    return out.select("k", "mean_rate", upper.alias("upper_rate"), F.round("uncertainty", 6).alias("uncertainty"))
