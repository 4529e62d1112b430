"""Queries of row rules: routing, validation, policies, layers, labels, cache keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import expr as X
from gaugeworks.functions import rules as R
from gaugeworks.functions import settings
from gaugeworks.operators import catalogs
from gaugeworks.operators import state as S
from gaugeworks.plans.queries import query
from gaugeworks.sources import sinks


@query("""
    select p_partkey, case when least(p_size * 100, 2160) >= 2160 and greatest(p_size * 100, 2160) >= 3840 and p_partkey % 2 = 0 then '4k' when p_size >= 30 then 'hfr' else 'standard' end as model from part""")
def model_routing(t):
    """Model by geometry and rate."""
    n = F.col("p_size")
    return t("part").select("p_partkey", R.model_route(n * 100, F.lit(2160), n, F.col("p_partkey") % 2 == 0, 30).alias("model"))


@query("""
    select o_orderkey, case when lower(o_orderpriority) in ('1-urgent', '2-high') then 'unsupported: priority' when o_totalprice < 20000 then 'unsupported: small' end as reason from orders""")
def unsupported_reason(t):
    """P10: first reason a row can't be used."""
    return t("orders").select("o_orderkey", R.first_reason([(F.lower("o_orderpriority").isin("1-urgent", "2-high"), "unsupported: priority"), (F.col("o_totalprice") < 20000, "unsupported: small")]).alias("reason"))


@query("""
    select event_id, try_cast(case when event_id % 7 = 0 then 'bad' else value::varchar end as double) as value, case when event_id % 7 = 0 then 'not a number' when value > 100 then 'out of range' end as reason from events""")
def isolated_errors(t):
    """A bad row becomes a row with its reason."""
    text = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string"))
    number = text.try_cast("double")
    return t("events").select("event_id", number.alias("value"), R.number_reason(number, 0, 100).alias("reason"))


@query("""
    select p_partkey, least(10, greatest(3, p_size)) as windows, case when p_size % 2 = 0 then p_size - 1 else p_size end as subsample, case when p_size > 25 then 'precise' when p_size > 10 then 'balance' else 'fast' end as profile from part where p_size is not null""")
def settings_clamp(t):
    """Settings forced into their ranges, a profile by name."""
    n = F.col("p_size")
    return t("part").where("p_size is not null").select("p_partkey", X.clamp(n, 3, 10).alias("windows"), X.odd_below(n).alias("subsample"), F.when(n > 25, "precise").when(n > 10, "balance").otherwise("fast").alias("profile"))


@query("""
    select o_orderkey, concat_ws(',', case when o_totalprice > 200000 then 'raise_size_limit' end, case when o_orderkey % 100 < 60 then 'lower_target' end, 'skip') as options,
           case when o_orderstatus = 'P' then least(100, greatest(1, greatest(1000, floor(o_totalprice * 0.7 / (1 + o_orderkey % 3) * 0.98)::bigint) // 1000)) else greatest(1, greatest(1000, floor(o_totalprice * 0.7 / (1 + o_orderkey % 3) * 0.98)::bigint) // 1000) end as retry_kbps from orders""")
def decision_options(t):
    """Actions that apply, and the retry rate after a miss."""
    options = R.actions([(F.col("o_totalprice") > 200000, "raise_size_limit"), (F.col("o_orderkey") % 100 < 60, "lower_target"), (F.lit(True), "skip")])
    cap = F.when(F.col("o_orderstatus") == "P", 100).otherwise(0)
    return t("orders").select("o_orderkey", F.array_join(options, ",").alias("options"), R.retry_kbps(F.col("o_totalprice"), F.lit(0.7), 1 + F.col("o_orderkey") % 3, cap).alias("retry_kbps"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'keep' when 'O' then 'ask' else 'skip' end as policy, case when lower(trim(o_orderpriority)) in ('1-urgent', '5-low') then lower(o_orderpriority) else 'auto' end as choice from orders")
def policy_map(t):
    """Mapped policies and lenient choices with a default."""
    return t("orders").select("o_orderkey", R.mapped(F.col("o_orderstatus"), {"F": "keep", "O": "ask"}, "skip").alias("policy"), R.lenient_choice(F.col("o_orderpriority"), ["1-urgent", "5-low"], "auto").alias("choice"))


@query("select doc_id, greatest(0.0, least(case when doc_id % 2 = 0 then n_chars / 2.0 - 15 else doc_id::double end, n_chars - 30.0))::double as start, least(30, n_chars)::double as size from documents")
def preview_window(t):
    """A middle or chosen window inside the whole."""
    at = F.when(F.col("doc_id") % 2 == 1, F.col("doc_id").cast("double"))
    start, size = R.inner_window(F.col("n_chars").cast("double"), F.lit(30.0), at)
    return t("documents").select("doc_id", start.alias("start"), size.alias("size"))


@query("select c_custkey, coalesce(case when c_custkey % 3 = 0 then 'flag' end, case when c_custkey % 2 = 0 then c_mktsegment end, 'default') as value, case when c_acctbal < 0 and c_custkey % 2 = 0 then 'needs balance' when c_mktsegment = 'MACHINERY' and c_acctbal > 5000 then 'too large' end as reason from customer")
def option_layers(t):
    """Layers of options, blank as missing, and checks across them."""
    even = F.col("c_custkey") % 2 == 0
    value = R.layered(F.when(F.col("c_custkey") % 3 == 0, "flag"), F.when(even, F.col("c_mktsegment")), F.lit(" "), F.lit("default"))
    reason = R.first_reason([((F.col("c_acctbal") < 0) & even, "needs balance"), ((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 5000), "too large")])
    return t("customer").select("c_custkey", value.alias("value"), reason.alias("reason"))


@query("select o_custkey, count(*) = count(distinct o_orderpriority) as all_distinct, list_sort(list(distinct o_orderstatus)) = ['F', 'O', 'P'] as complete from orders group by o_custkey")
def assertions(t):
    """No duplicates, and the observed set equals the planned one."""
    same = F.array_sort(F.collect_set("o_orderstatus")) == F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return t("orders").groupBy("o_custkey").agg((F.count("*") == F.count_distinct("o_orderpriority")).alias("all_distinct"), same.alias("complete"))


@query("select c_nationkey, arg_min(c_custkey, c_custkey) filter (c_acctbal > 0) as first_valid, arg_max(c_custkey, (length(c_mktsegment), -c_acctbal, c_custkey)) as most, count(*) filter (c_acctbal > 5000) > 0 as has_peak from customer group by c_nationkey")
def picks(t):
    """First valid row, most with the earliest tie, any above a level."""
    ok = F.col("c_acctbal") > 0
    return t("customer").groupBy("c_nationkey").agg(F.min(F.when(ok, F.col("c_custkey"))).alias("first_valid"), F.max(F.struct(F.length("c_mktsegment"), -F.col("c_acctbal"), "c_custkey"))["c_custkey"].alias("most"), (F.count_if(F.col("c_acctbal") > 5000) > 0).alias("has_peak"))


@query("select s_nationkey, count(*) filter (s_acctbal > 0) as usable, string_agg(s_suppkey::varchar, ',' order by s_acctbal desc, s_suppkey) filter (s_acctbal > 0) as names from supplier group by s_nationkey")
def usable_by_priority(t):
    """Usable names of a group in order of priority."""
    ok = F.col("s_acctbal") > 0
    listed = F.array_sort(F.collect_list(F.when(ok, F.struct((-F.col("s_acctbal")).alias("p"), "s_suppkey"))))
    out = t("supplier").groupBy("s_nationkey").agg(F.count_if(ok).alias("usable"), F.array_join(F.transform(listed, lambda s: s["s_suppkey"].cast("string")), ",").alias("names"))
    return out.withColumn("names", F.when(F.col("usable") > 0, F.col("names")))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then ceil((o_totalprice + 64) * 60 / 8 / 0.98)::bigint else ceil((o_totalprice * 1.1 + 128) * 60 / 8 / 0.98)::bigint end as size, case when o_orderkey % 3 = 0 then 'kept' else 'measured' end as method from orders")
def refreshed_predictions(t):
    """An earlier model is kept with a new audio budget, else computed anew."""
    kept = F.col("o_orderkey") % 3 == 0
    rate = F.col("o_totalprice")
    size = F.when(kept, X.predicted_size(rate, F.lit(64), F.lit(60))).otherwise(X.predicted_size(rate * 1.1, F.lit(128), F.lit(60)))
    return t("orders").select("o_orderkey", size.alias("size"), F.when(kept, "kept").otherwise("measured").alias("method"))


@query("select page_id, case when b.k is null then 'unknown key' when length(url) % 5 = 0 then 'not text' when regexp_matches(url, '[?]') <> (page_id % 2 = 0) then 'placeholders differ' end as reason from pages left join (select page_id k from pages where page_id % 4 <> 3) b on b.k = page_id")
def entry_diagnostics(t):
    """Entries against a baseline, with the reason they are refused."""
    base = t("pages").where("page_id % 4 <> 3").select("page_id", F.lit(True).alias("known"))
    rows = t("pages").join(base, "page_id", "left")
    return rows.select("page_id", R.first_reason([(F.col("known").isNull(), "unknown key"), (F.length("url") % 5 == 0, "not text"), (F.col("url").contains("?") != (F.col("page_id") % 2 == 0), "placeholders differ")]).alias("reason"))


@query("""
    select c_custkey, case c_custkey % 5 when 0 then c_name || ' has ' || c_custkey when 1 then '{name} has {n} of {rest}' when 2 then '{' || c_name || '} {x' when 3 then '{name} {n:>5}' else '{name} } {n}' end as text,
           case c_custkey % 5 when 2 then 'name' else 'n' end as first_name from customer""")
def template_text(t):
    """Templates filled by name, all names or none: one that is missing, a format
    or a lone brace leaves the template as it is."""
    forms = ["{name} has {n}", "{name} has {n} of {rest}", "{{{name}}} {{x", "{name} {n:>5}", "{name} } {n}"]
    template = F.element_at(F.array(*(F.lit(f) for f in forms)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t("customer").select("c_custkey", R.filled(template, {"name": F.col("c_name"), "n": F.col("c_custkey").cast("string")}).alias("text"), catalogs.placeholders(template)[0].alias("first_name"))


@query("select doc_id, least(6, 3 + round_even(3 * (0.30 * least(1.0, ln(1 + n_chars / 600.0) / ln(19)) + 0.45 * 0.5 + 0.25 * 0.4), 0)::int) as windows from documents")
def adaptive_count(t):
    """how many windows a length and its content ask for."""
    return t("documents").select("doc_id", R.adaptive_windows(F.col("n_chars"), F.lit(0.5), F.lit(0.4), 3, 6).alias("windows"))


@query("select event_id, try_cast(list_extract(regexp_extract_all('score: ' || value || ' then score: ' || (value * 2), 'score: ([0-9.]+)', 1), -1) as double) between 0 and 100 as fine, case when event_type like '%up' then 'signing' when event_type like '%c%' then 'contains c' else 'other' end as label from events")
def last_score(t):
    """the last score of a text, in range or not; labels by suffix."""
    text = F.concat(F.lit("score: "), F.col("value").cast("string"), F.lit(" then score: "), (F.col("value") * 2).cast("string"))
    return t("events").select("event_id", R.last_score(text, r"score: ([0-9.]+)").between(0, 100).alias("fine"), F.when(F.col("event_type").endswith("up"), "signing").when(F.col("event_type").contains("c"), "contains c").otherwise("other").alias("label"))


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then '2-HIGH' when '2-HIGH' then '3-MEDIUM' when '3-MEDIUM' then '4-NOT SPECIFIED' else o_orderpriority end as faster, case when o_orderstatus = 'P' then 'ready' when o_totalprice > 300000 then 'waiting_analysis' else 'waiting' end as state from orders")
def step_down(t):
    """The next faster preset, and first states of planned rows."""
    steps = {"1-URGENT": "2-HIGH", "2-HIGH": "3-MEDIUM", "3-MEDIUM": "4-NOT SPECIFIED"}
    state = F.when(F.col("o_orderstatus") == "P", "ready").when(F.col("o_totalprice") > 300000, "waiting_analysis").otherwise("waiting")
    return t("orders").select("o_orderkey", R.mapped(F.col("o_orderpriority"), steps, F.col("o_orderpriority")).alias("faster"), state.alias("state"))


def _round_trip(orders):
    packed = F.to_json(F.struct(F.struct(F.col("o_totalprice").alias("start"), F.array("o_orderpriority").alias("reasons")).alias("window"), F.array(F.when(F.col("o_orderkey") % 3 == 0, 1.0).otherwise(float("nan"))).alias("scores")))
    back = F.from_json(packed, "window struct<start:double,reasons:array<string>>, scores array<double>", {"allowNonNumericNumbers": "true"})
    return orders.select("o_orderkey", back.window.start.alias("start"), back.window.reasons[0].alias("why"), F.forall(back.scores, lambda s: ~F.isnan(s)).alias("fine"))


@query("select o_orderkey, o_totalprice as start, o_orderpriority as why, o_orderkey % 3 = 0 as fine from orders")
def payload_round_trip(t):
    """records through JSON and back, nested numbers checked."""
    return _round_trip(t("orders"))


@query("select c_custkey, case when c_custkey % 4 = 0 then 'decision' when c_nationkey % 2 = 0 then 'measurement' else 'measure' end as source from customer")
def reuse_ladder(t):
    """A decision, else a measurement to decide on, else nothing yet."""
    rows = t("customer").select("c_custkey", sinks.fingerprint(["c_custkey", "c_nationkey"]).alias("decision"), sinks.fingerprint(["c_nationkey"]).alias("measurement"), "c_nationkey")
    exact, measured = rows.where("c_custkey % 4 = 0"), rows.where("c_nationkey % 2 = 0")
    return sinks.reuse(rows, exact, measured).select("c_custkey", "source")


@query("select a.s_suppkey, a.s_nationkey is not distinct from c.c_nationkey and a.s_acctbal is not distinct from c.c_acctbal as same from supplier a join customer c on c.c_custkey = a.s_suppkey")
def identity_match(t):
    """All parts of an identity agree, nulls included."""
    rows = t("supplier").join(t("customer"), F.col("c_custkey") == F.col("s_suppkey"))
    same = sinks.same_identity({"n": F.col("s_nationkey"), "b": F.col("s_acctbal")}, {"n": F.col("c_nationkey"), "b": F.col("c_acctbal")})
    return rows.select("s_suppkey", same.alias("same"))


@query("select o_orderkey, case when o_totalprice > 200000 then '/out/a.b/' || o_orderkey || '.size-miss-xxxxxxxx.mp4' when o_orderkey % 7 <> 0 then '/out/a.b/' || o_orderkey || '.mp4' end as to_path, o_totalprice <= 200000 and o_orderkey % 7 <> 0 as accepted, case when o_orderstatus = 'P' then 'source is missing' when o_orderkey % 7 = 0 and o_orderkey % 2 = 0 then 'output exists' when o_orderkey % 10 = 0 then 'source and output are the same file' end as reason from orders")
def publish_reasons(t):
    """Accepted outputs, and why a source isn't copied."""
    key = F.col("o_orderkey")
    rows = t("orders").select(key, (F.col("o_orderstatus") != "P").alias("source_exists"), F.lit("a").alias("source"), F.when(key % 10 == 0, "a").otherwise("b").alias("target"), (key % 7 == 0).alias("target_exists"), (key % 2 == 1).alias("overwrite"), F.col("o_totalprice").alias("size"), F.lit(200000.0).alias("most"), F.concat(F.lit("/out/a.b/"), key.cast("string"), F.lit(".mp4")).alias("path"))
    to = F.regexp_replace("to", r"(size-miss-)[0-9a-f]{8}\.", "$1xxxxxxxx.")
    return sinks.copy_reasons(sinks.publish_split(rows, "most", "size", "path")).select("o_orderkey", to.alias("to_path"), "accepted", "reason")


@query("""
    with raw as (select p_partkey, p_size - 5 i, (p_size - 5) / 10.0::double d from part where p_size is not null)
    select p_partkey, greatest(1.0, d) whole_video_max_sec, greatest(0.5, d) scout_duration_sec, least(10, greatest(1, i)) scout_multiplier, least(128, greatest(1, i)) scout_max_windows, greatest(1.0, d) sample_duration_sec,
      least(16, greatest(1, i)) sample_count_under_10m, least(16, greatest(1, i)) sample_count_10_to_60m, least(16, greatest(1, i)) sample_count_60_to_180m, least(16, greatest(1, i)) sample_count_over_180m,
      least(8, greatest(0, i)) holdout_window_count, least(8, greatest(0, i)) holdout_window_count_over_180m, least(8, greatest(1, i)) coarse_max_candidates, least(8, greatest(2, i)) exact_max_candidates,
      greatest(1, i) - (greatest(1, i) + 1) % 2 coarse_vmaf_subsample, greatest(1, i) - (greatest(1, i) + 1) % 2 exact_vmaf_subsample, greatest(1000, i) min_search_tolerance_bps, least(0.25, greatest(0.005, d)) search_tolerance_ratio,
      least(4, greatest(0, i)) max_refinement_rounds, least(5.0, greatest(0.0, d)) preferred_vmaf_margin, least(16, greatest(1, i)) search_min_windows, least(16, greatest(i, i)) search_max_windows,
      least(8, greatest(0, i)) holdout_target_min, least(8, greatest(i, i)) holdout_target_max, least(8, greatest(0, i)) reserve_window_count, least(2.0, greatest(0.1, d)) quality_confidence_band from raw""")
def settings_ranges(t):
    """All settings within their ranges."""
    n = F.col("p_size") - 5
    given = {name: n / 10.0 if isinstance(values[0], float) else n for name, values in settings.SETTINGS.items()}
    return t("part").where("p_size is not null").select("p_partkey", *(c.alias(k) for k, c in settings.clamped(given).items()))


@query("""
    with p as (select * from (values ('fast', 12.0::double, 12, 4.0::double, 3, 1, 0.06::double, 2, 4, 1), ('balance', 20.0, 32, 5.0, 4, 2, 0.03, 3, 6, 2), ('precise', 30.0, 64, 6.0, 6, 3, 0.015, 4, 10, 4)) v(name, whole_video_max_sec, scout_max_windows, sample_duration_sec, sample_count_under_10m, holdout_window_count, search_tolerance_ratio, search_min_windows, search_max_windows, reserve_window_count))
    select c_custkey, p.* exclude (name) from (select c_custkey, case c_custkey % 4 when 0 then 'fast' when 1 then 'precise' else 'balance' end n from customer) join p on name = n""")
def profile_settings(t):
    """Settings of a named profile; an unknown name counts as balance."""
    n = F.col("c_custkey") % 4
    rows = t("customer").select("c_custkey", F.when(n == 0, "fast").when(n == 1, "precise").when(n == 2, "no such profile").alias("profile_name"))
    return settings.bound(rows, "profile_name").select("c_custkey", "whole_video_max_sec", "scout_max_windows", "sample_duration_sec", "sample_count_under_10m", "holdout_window_count", "search_tolerance_ratio", "search_min_windows", "search_max_windows", "reserve_window_count")


@query("""
    select page_id, case when page_id % 3 = 0 then '/out/a' || page_id || '.en.srt' when page_id % 3 = 1 then '/out/a' || page_id || '.srt' else '/out/a' || page_id || '.ass' end as target from pages""")
def sidecar_targets(t):
    """New paths of sidecar files."""
    n = F.col("page_id").cast("string")
    side = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/in/m"), n, F.lit(".en.srt"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/in/m"), n, F.lit(".srt"))).otherwise(F.lit("/in/x.y.ass"))
    rows = t("pages").select("page_id", F.concat(F.lit("/in/m"), n, F.lit(".mkv")).alias("source"), side.alias("sidecar"), F.concat(F.lit("/out/a"), n, F.lit(".mp4")).alias("target"))
    return sinks.sidecar_targets(rows).select("page_id", F.col("to").alias("target"))


@query("""
    select o_custkey, case when bool_or(o_orderkey % 8 in (1, 2)) then 'running' when bool_or(o_orderkey % 8 = 3) then 'decision_pending' else 'idle' end as state,
           count(*) filter (o_orderkey % 8 in (0)) executable, count(*) filter (o_orderkey % 8 not in (1, 2)) removable, count(*) filter (o_orderkey % 8 in (4, 7)) retryable, count(*) filter (o_orderkey % 8 in (5, 6, 7)) completed from orders group by o_custkey""")
def queue_states(t):
    """What may be done with the rows of a queue, and where it stands."""
    names = ["queued", "analyzing", "encoding", "needs_decision", "failed", "done", "skipped", "cancelled"]
    status = F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = t("orders").select("o_custkey", status.alias("status"))
    that = S.rows_that(F.col("status"))
    return rows.groupBy("o_custkey").agg(S.end_state(F.col("status")).alias("state"), *(F.count_if(c).alias(k) for k, c in that.items()))


@query("""
    with o as (select o_orderkey k, o_orderkey % 8 s, (o_orderkey // 8) % 7 a, o_orderkey % 3 = 0 aside, o_orderkey % 5 f, case when o_orderkey % 2 = 0 then 'waiting_analysis' else 'queued' end waits from orders),
    d as (select *, case when a in (0, 1, 2) and s = 3 and not aside then ['skip', 'retry', case when f in (0, 1) then 'retry' else 'pending' end][a + 1] when a = 3 and s in (3, 4, 7) then 'retry'
                         when a = 4 and s = 3 and aside then 'accept' when a = 5 and s = 3 and aside then 'skip' when a = 6 and s in (0, 1, 2) then 'cancel' end c from o)
    select k as o_orderkey, case when c = 'skip' then 'skipped' when c = 'retry' then waits when c = 'accept' then 'done' when c = 'cancel' then 'cancelled' else ['queued', 'analyzing', 'encoding', 'needs_decision', 'failed', 'done', 'skipped', 'cancelled'][s + 1] end as status,
           case when c in ('skip', 'cancel', 'pending') then 'because of ' || k when c in ('retry', 'accept') then null else 'old' end as error, case c when 'retry' then 0.0 when 'accept' then 100.0 else 50.0 end::double as file_percent,
           case when c = 'retry' then 0.0 else 30.0 end::double as pass_percent, case when a = 2 and c = 'retry' and f = 0 then k else 7 end::bigint as target_rate, (c is not null)::int as applied from d""")
def decision_actions(t):
    """What people decide about queue rows, and the fields that changes."""
    key = F.col("o_orderkey")
    names = ["queued", "analyzing", "encoding", "needs_decision", "failed", "done", "skipped", "cancelled"]
    told = ["skip", "reanalyze", "reselect", "retry", "accept", "discard", "cancel"]
    at = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n + 1).cast("int"))
    rows = t("orders").select("o_orderkey", at(names, key % 8).alias("status"), (key % 2 == 0).alias("smart"), F.when(key % 3 == 0, "kept aside").alias("rejected"), F.lit("old").alias("error"), F.lit(50.0).alias("file_percent"), F.lit(30.0).alias("pass_percent"), F.lit(7).cast("long").alias("target_rate"))
    acts = t("orders").select("o_orderkey", F.lit(1).alias("n"), at(told, F.floor(key / 8) % 7).alias("action"), (key % 5 == 0).alias("found"), (key % 5 == 1).alias("requires_analysis"), key.cast("long").alias("rate"), F.concat(F.lit("because of "), key.cast("string")).alias("message"))
    return S.apply_actions(rows, acts, "o_orderkey", "n").select("o_orderkey", "status", "error", "file_percent", "pass_percent", "target_rate", "applied")


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey <> first, o_orderkey) as place from (select *, max(o_orderkey) over (partition by o_custkey) first from orders)")
def move_to_front(t):
    """One row moved to the front, the others in order."""
    by = Window.partitionBy("o_custkey")
    rows = t("orders").withColumn("first", F.max("o_orderkey").over(by))
    return rows.select("o_orderkey", F.row_number().over(by.orderBy(F.col("o_orderkey") != F.col("first"), "o_orderkey")).cast("long").alias("place"))


@query("select n, least(8, greatest(1, (n - 2) // 2)) as threads, case when n >= 8 then 2 else 1 end as analyses from (select distinct p_size n from part where p_size > 0)")
def budgets(t):
    """Threads and concurrent analyses by processors."""
    n = F.col("n")
    return t("part").where("p_size > 0").select(F.col("p_size").alias("n")).distinct().select("n", X.clamp(F.floor((n - 2) / 2), 1, 8).cast("long").alias("threads"), F.when(n >= 8, 2).otherwise(1).alias("analyses"))


@query("select k, case when bool_or(o = 'needs') then 3 when bool_and(o in ('done', 'skipped')) then 0 else 2 end as code from (select user_id k, case event_type when 'view' then case when event_id % 50 = 0 then 'needs' else 'done' end when 'error' then case when event_id % 20 = 0 then 'failed' else 'skipped' end else 'done' end o from events) group by k")
def exit_codes(t):
    """One code for all outcomes of a key."""
    e, n = F.col("event_type"), F.col("event_id")
    outcome = F.when(e == "view", F.when(n % 50 == 0, "needs").otherwise("done")).when(e == "error", F.when(n % 20 == 0, "failed").otherwise("skipped")).otherwise("done")
    rows = t("events").select(F.col("user_id").alias("k"), outcome.alias("o"))
    return rows.groupBy("k").agg(F.when(F.bool_or(F.col("o") == "needs"), 3).when(F.bool_and(F.col("o").isin("done", "skipped")), 0).otherwise(2).alias("code"))


def _uncertainty(orders):
    counts = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return counts.select("k", "n", X.clamp(0.03 + 0.14 / F.sqrt("n"), 0.05, 0.30).alias("unsure"))


@query("select o_custkey k, count(*) n, least(0.30, greatest(0.05, 0.03 + 0.14 / sqrt(count(*))))::double as unsure from orders group by o_custkey")
def base_uncertainty(t):
    """The uncertainty a number of samples leaves, clamped."""
    return _uncertainty(t("orders"))


@query("""
    with l as (select l_orderkey k, l_linenumber p, l_partkey n, l_suppkey s, l_tax > 0.06 runs, case when l_discount > 0.03 then 'discount ' || l_quantity::int end as said from lineitem)
    select k, coalesce(arg_min(n, (p, n)) filter (runs), arg_max(n, (p, n))) as n, bool_or(runs) as runnable,
           case when not bool_or(runs) then coalesce(string_agg(n || ': ' || said, '; ' order by p, n, said), 'no candidate can run') end as error from l group by k""")
def first_runnable(t):
    """The first candidate that runs, else what all of them said."""
    said = F.when(F.col("l_discount") > 0.03, F.concat(F.lit("discount "), F.col("l_quantity").cast("int").cast("string")))
    rows = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("p"), F.col("l_partkey").alias("n"), (F.col("l_tax") > 0.06).alias("runs"), said.alias("said"))
    return catalogs.first_runnable(rows, "k", "p", "n", "runs", "said")


@query("""
    with e as (select p_partkey, case p_size % 6 when 0 then 'libx265' when 1 then 'hevc_nvenc' when 2 then 'hevc_amf' when 3 then 'hevc_videotoolbox' when 4 then 'libsvtav1' else 'av1_qsv' end as enc, p_size % 4 as l, p_size % 7 = 0 as asked from part where p_size is not null),
    c as (select *, case when enc = 'hevc_videotoolbox' then [] when l = 1 then ['a', 'HighQuality', 'quality'] when l = 2 then ['slow', '5']
                    when enc = 'libx265' then ['ultrafast', 'superfast', 'veryfast', 'faster', 'fast', 'medium', 'slow', 'slower', 'veryslow', 'placebo'] when enc = 'hevc_nvenc' then ['p1', 'p2', 'p3', 'p4', 'p5', 'p6', 'p7']
                    when enc = 'av1_qsv' then ['veryfast', 'faster', 'fast', 'medium', 'slow', 'slower', 'veryslow'] else [] end as choices,
                 case enc when 'libx265' then 'slow' when 'libsvtav1' then '5' when 'hevc_nvenc' then 'p6' when 'av1_qsv' then 'slow' when 'hevc_amf' then case when l = 1 then 'HighQuality' end end as fit from e)
    select p_partkey, len(choices)::int as n_choices, case when asked then 'own' when len(choices) = 0 or list_contains(choices, fit) then fit end as preset from c""")
def preset_choices(t):
    """Presets listed when asked, else fixed ones, and the one to take."""
    n = F.col("p_size")
    names = ["libx265", "hevc_nvenc", "hevc_amf", "hevc_videotoolbox", "libsvtav1", "av1_qsv"]
    encoder = F.element_at(F.array(*(F.lit(x) for x in names)), (n % 6 + 1).cast("int"))
    listed = F.when(n % 4 == 1, F.array(F.lit("a"), F.lit("HighQuality"), F.lit(""), F.lit("quality"))).when(n % 4 == 2, F.array(F.lit("slow"), F.lit("5"))).when(n % 4 == 3, F.array(F.lit("")))
    choices = R.preset_choices(encoder, listed)
    return t("part").where("p_size is not null").select("p_partkey", F.size(choices).alias("n_choices"), R.chosen_preset(encoder, F.when(n % 7 == 0, "own"), choices).alias("preset"))


@query("select o_orderkey, not (o_orderstatus = 'P') and lower(substr(o_orderpriority, 3)) = 'high' as needed from orders")
def analysis_needed(t):
    """Rows that are analysed before anything else."""
    skip = F.when(F.col("o_orderstatus") == "P", "pending")
    return t("orders").select("o_orderkey", R.needs_analysis(skip, F.lower(F.substring("o_orderpriority", 3, 20)), "high").alias("needed"))


@query("""
    select s_suppkey, case when s_suppkey % 9 = 0 then 'no bound encoder' when s_nationkey <> c_nationkey or s_suppkey % 4 = 0 then
      'measured by ' || case when s_suppkey % 4 = 0 then 'none' else c_nationkey::varchar end || '/cpu, expected ' || s_nationkey || '/cpu' end as reason
    from supplier join customer on c_custkey = s_suppkey""")
def encoder_mismatch(t):
    """Measurements of another encoder than the one bound to the row."""
    rows = t("supplier").join(t("customer"), F.col("c_custkey") == F.col("s_suppkey"))
    n = F.col("s_suppkey")
    bound, measured = F.when(n % 9 != 0, F.col("s_nationkey")), F.when(n % 4 != 0, F.col("c_nationkey"))
    return rows.select("s_suppkey", R.encoder_mismatch(bound, F.lit("cpu"), measured, F.lit("cpu")).alias("reason"))
