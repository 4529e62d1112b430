"""Event folds and queue metrics: batch forms of keyed state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expr import parse_speed, shorten


def latest(value: Column, sequence: Sequence[str]) -> Column:
    """The last value that is not null, by a unique sequence."""
    order = F.struct(*sequence) if len(sequence) > 1 else F.col(sequence[0])
    return F.max_by(value, F.when(value.isNotNull(), order))


def fold(events: DataFrame, key: str, sequence: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """Current state of each key: of every field the last value that is not null.
    Events without a key change nothing."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(*(latest(v, sequence).alias(n) for n, v in fields.items()))


def outcome(needs_decision: Column, skipped: Column, success: Column) -> Column:
    """The final state, by precedence."""
    return F.when(needs_decision, "needs_decision").when(skipped, "skipped").when(success, "done").otherwise("failed")


def pass_percent(nth: Column, percent: Column, passes: Column) -> Column:
    """Progress over several passes, 0 to 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (nth - 1 + percent / 100) / passes * 100))


# The groups that states are counted in.
GROUPS = {
    "queued": ("queued", "waiting_analysis"),
    "running": ("running", "analyzing", "encoding", "validating"),
    "failed": ("failed",),
    "needs_decision": ("needs_decision",),
    "done": ("done",),
    "skipped": ("skipped",),
    "cancelled": ("cancelled",),
}


def progress_share(status: Column, percent: Column) -> Column:
    """How much of a row's weight is done: all of a finished one, 0.99 of one that waits
    for a decision, else its percentage."""
    done = status.isin(*GROUPS["done"], *GROUPS["skipped"])
    return F.when(done, 1.0).when(status == "needs_decision", 0.99).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), percent)) / 100)


def queue_metrics(rows: DataFrame, status: str, duration: str, percent: str, order: str, speed: str, passes: str | None = None, name: str | None = None, elapsed: str | None = None) -> DataFrame:
    """One row: counts by ``GROUPS``, durations, weighted progress within 0..100
    (a row weighs its duration times its passes), what is known of the last running row,
    and the time left at its ``speed``, a number or a text like ``1.5x``."""
    st, lasts = F.col(status), F.coalesce(F.col(duration), F.lit(0.0))
    weight = F.when(lasts > 0, lasts).otherwise(0.0) * (F.greatest(F.col(passes), F.lit(1)) if passes else 1)
    total, finished = F.sum(weight), F.sum(weight * progress_share(st, F.coalesce(F.col(percent), F.lit(0.0))))
    now = F.when(st.isin(*GROUPS["running"]), F.col(order))

    def current(column: str):
        return F.max_by(column, now)

    told = {"speed": current(speed), "current": F.max(now), "current_percent": current(percent), "current_duration": F.nullif(current(duration), F.lit(0.0))}
    told |= {"current_name": current(name)} if name else {}
    told |= {"current_elapsed": current(elapsed)} if elapsed else {}
    out = rows.agg(
        F.count("*").alias("n"),
        *(F.count_if(st.isin(*states)).alias(f"n_{group}") for group, states in GROUPS.items()),
        F.coalesce(F.sum(F.when(lasts > 0, lasts)), F.lit(0.0)).alias("duration"),
        F.coalesce(total, F.lit(0.0)).alias("total"),
        F.coalesce(finished, F.lit(0.0)).alias("finished"),
        *(column.alias(key) for key, column in told.items()),
    )
    factor = F.col("speed") if dict(out.dtypes)["speed"] != "string" else parse_speed(F.col("speed"))
    percent_ = F.when(F.col("total") > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("finished") / F.col("total") * 100))).otherwise(0.0)
    left = F.greatest(F.lit(0.0), F.col("total") - F.col("finished"))
    out = out.withColumn("n_completed", F.col("n_done") + F.col("n_skipped")).withColumn("n_ready", F.col("n_queued"))
    return out.withColumn("percent", percent_).withColumn("eta", F.when(factor > 0, left / factor))


def saved_bytes(rows: DataFrame, source: str, predicted: str) -> DataFrame:
    """One row: bytes saved over the rows that have an estimate, losses included;
    null without one."""
    gain = F.when((F.col(source) > 0) & (F.col(predicted) > 0), F.col(source) - F.col(predicted))
    return rows.agg(F.sum(gain).alias("saved"), F.count(gain).alias("n"))


def output_estimate(duration: Column, video: Column, audio: Column) -> Column:
    """Whole bytes of a duration at these rates; null unless duration and video rate
    are positive."""
    return F.when((duration > 0) & (video > 0), F.floor(duration * (video + F.greatest(F.coalesce(audio, F.lit(0)), F.lit(0))) / 8.0).cast("long"))


def initial(plan: DataFrame, skip_reason: str, smart: Column, two_pass: Column | None = None) -> DataFrame:
    """First states of planned rows: skipped (done at once, with the reason), waiting
    for analysis, or queued."""
    skipped = F.col(skip_reason).isNotNull() & (F.col(skip_reason) != "")
    passes = F.lit(1) if two_pass is None else F.when(two_pass, 2).otherwise(1)
    out = plan.withColumn("status", F.when(skipped, "skipped").when(smart, "waiting_analysis").otherwise("queued"))
    out = out.withColumn("total_passes", passes)
    done = F.when(skipped, 100.0).otherwise(0.0)
    return out.withColumns({"pass_index": F.when(skipped, passes).otherwise(0), "pass_percent": done, "file_percent": done, "error": F.col(skip_reason)})


# What each transition sets.  ``@waiting`` is the state a row waits in,
# ``@working`` the one it works in; fields that are not named keep their values.
_CLEARED = {"pass_percent": 0.0, "file_percent": 0.0, "error": None, "log_path": None, "finished_at": None, "result": None, "candidate": 0, "candidate_limit": 0}
TRANSITIONS: dict[str, dict[str, object]] = {
    "start": {**_CLEARED, "status": "@working", "started_at": "@at", "pass_index": 1},
    "prepare": {"speed": "", "elapsed": None},
    "retry": {**_CLEARED, "status": "@waiting", "pass_index": 0, "speed": "", "elapsed": None, "started_at": None, "backend": None, "encoder": None},
    "cancel": {"status": "cancelled", "finished_at": "@at", "error": "@message"},
    "fail": {"status": "failed", "finished_at": "@at", "error": "@message"},
    "needs_decision": {"status": "needs_decision", "finished_at": "@at", "file_percent": 100.0, "pass_percent": 100.0, "error": "@message"},
    "skip": {"status": "skipped", "finished_at": "@at", "file_percent": 100.0, "error": "@message"},
    "done": {"status": "done", "finished_at": "@at", "file_percent": 100.0, "pass_percent": 100.0, "pass_index": "@passes", "error": None},
    "assign": {"backend": "@backend", "encoder": "@encoder"},
    "decline": {"status": "skipped", "error": "@message"},
    "accept": {"status": "done", "file_percent": 100.0, "error": None},
    "rate": {"target_rate": "@rate"},
    "pending": {"error": "@message"},
}


def transition(rows: DataFrame, commands: DataFrame, key: str, order: str, smart: str = "smart", message_limit: int = 120) -> DataFrame:
    """``rows`` after the commands of their keys (key, order, command, at,
    message), one after the other.  A field ends as the last command that sets it leaves
    it, so all commands of a key are one aggregation.  Commands of unknown names or keys
    change nothing; messages are shortened."""
    held = {f.name: f.dataType for f in rows.schema.fields}
    known = commands.where(F.col("command").isin(*TRANSITIONS))
    short = shorten(F.col("message"), message_limit)
    last = []
    for name in held:
        sets = {c: fields[name] for c, fields in TRANSITIONS.items() if name in fields}
        if name != key and sets:
            takes = F.col("command").isin(*sets)
            told = [F.col(n) if n in commands.columns else F.lit(None).cast(kind).alias(n) for n, kind in (("backend", "string"), ("encoder", "string"), ("rate", "long"))]
            value = F.struct(F.col("command").alias("c"), F.col("at").alias("at"), short.alias("m"), *told)
            last.append(F.max_by(F.when(takes, value), F.when(takes, F.col(order))).alias(f"__{name}"))
    folded = known.groupBy(key).agg(*last)
    joined = rows.join(folded, key, "left")
    for name, kind in held.items():
        if f"__{name}" not in joined.columns:
            continue
        by, out = F.col(f"__{name}"), F.col(name)
        for command, fields in TRANSITIONS.items():
            if name in fields:
                what = fields[name]
                places = {"@at": by["at"], "@message": by["m"], "@backend": by["backend"], "@encoder": by["encoder"], "@rate": by["rate"], "@passes": F.greatest(F.col("total_passes"), F.lit(1)) if "total_passes" in held else F.lit(1)}
                places["@waiting"] = F.when(F.col(smart), "waiting_analysis").otherwise("queued") if smart in held else F.lit("queued")
                places["@working"] = F.when(F.col(smart), "waiting_analysis").otherwise("encoding") if smart in held else F.lit("encoding")
                value = places[what] if isinstance(what, str) and what in places else F.lit(what)
                out = F.when(by["c"] == command, value.cast(kind)).otherwise(out)
        joined = joined.withColumn(name, out)
    return joined.select(*held)


# The state each kind of progress event stands for.
EVENT_STATES = {
    "waiting_analysis": ("waiting_analysis",),
    "analyzing": ("analyzing", "candidate_finished", "scouting", "scout_finished", "sample_plan_ready", "boundary_alignment", "searching", "holdout_verification", "refining"),
    "queued": ("analysis_finished",),
    "encoding": ("starting_file", "running_pass"),
    "validating": ("validating",),
    "needs_decision": ("needs_decision",),
    "failed": ("failed",),
}


def event_status(state: Column) -> Column:
    """The status an event's state leads to; null if it changes none."""
    out = F.lit(None).cast("string")
    for status, states in EVENT_STATES.items():
        out = F.when(state.isin(*states), status).otherwise(out)
    return out


def event_fields(state: Column, **given: Column) -> dict[str, Column]:
    """What an event says of its row: a status, clamped percentages (``percent`` goes
    to the file's progress unless the file has ended), positive numbers of passes,
    messages of failed or cancelled files.  Null where it says nothing."""
    within = lambda x: F.when(x.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)))
    out = {"status": event_status(state)}
    for name, value in given.items():
        if name == "percent":
            out["file_percent"] = F.coalesce(F.when(~state.isin("finished_file", "failed_file"), within(value)), *([within(given["file_percent"])] if "file_percent" in given else []))
        elif name in ("pass_percent", "file_percent"):
            out.setdefault(name, within(value))
        elif name == "total_passes":
            out[name] = F.when(value > 0, value)
        elif name == "speed":
            out[name] = F.when(value != "", value)
        elif name == "message":
            out["error"] = F.when(state.isin("failed_file", "cancelled_file"), F.nullif(shorten(value, 120), F.lit("")))
        else:
            out[name] = value
    return out


def inserted(rows: DataFrame, plan: DataFrame, key: str, skip_reason: str, smart: Column, two_pass: Column | None = None) -> DataFrame:
    """``rows`` and the first states of the planned rows whose key they do not hold;
    columns that only one side has are null on the other."""
    new = initial(plan, skip_reason, smart, two_pass).join(rows.select(key), key, "left_anti")
    return rows.unionByName(new, allowMissingColumns=True)


#: Which states an action applies to, and the commands (see ``TRANSITIONS``) it stands for.
#: ``@aside``: only where an output was kept aside (``rejected``); ``@decided``: only where
#: none was.
ACTIONS: dict[str, tuple[tuple[str, ...], str | None, tuple[str, ...]]] = {
    "skip": (("needs_decision",), "@decided", ("decline",)),
    "reanalyze": (("needs_decision",), "@decided", ("retry",)),
    "reselect": (("needs_decision",), "@decided", ("rate", "retry")),
    "retry": (("failed", "cancelled", "needs_decision"), None, ("retry",)),
    "accept": (("needs_decision",), "@aside", ("accept",)),
    "discard": (("needs_decision",), "@aside", ("decline",)),
    "cancel": (("queued", "waiting_analysis", "analyzing", "encoding"), None, ("cancel",)),
}


def apply_actions(rows: DataFrame, actions: DataFrame, key: str, order: str, smart: str = "smart") -> DataFrame:
    """``rows`` after the actions of their keys (key, order, action, and where known
    ``found``, ``requires_analysis``, ``rate``, ``message``, ``at``), one after the other, each where
    the state it finds allows it; ``applied`` counts those.

    An action changes the fields that its transition changes.  ``reselect`` sets the rate
    and the row waits again where a rate was ``found``, waits again to be analysed where that
    is required, and else stays pending with the reason as its error.  Which actions apply
    is decided from the states alone: a key's actions are few (people give them) and are
    folded as one array; what they change is one aggregation, as in :func:`transition`."""
    told = {"found": "boolean", "requires_analysis": "boolean", "rate": "long", "message": "string", "at": "double"}
    given = actions.select(key, F.col(order).cast("long").alias("o"), F.col("action").alias("a"), *(F.col(n).cast(k).alias(n) if n in actions.columns else F.lit(None).cast(k).alias(n) for n, k in told.items()))
    given = given.where(F.col("a").isin(*ACTIONS)).withColumn("keeps", (F.col("a") == "reselect") & ~F.coalesce("found", F.lit(False)) & ~F.coalesce("requires_analysis", F.lit(False)))
    acts = given.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "a", "keeps"))).alias("acts"))
    aside = F.col("rejected").isNotNull() if "rejected" in rows.columns else None
    smart_ = F.coalesce(F.col(smart), F.lit(False)) if smart in rows.columns else F.lit(False)
    states = rows.select(key, "status", smart_.alias("smart"), (F.lit(None).cast("boolean") if aside is None else aside).alias("aside")).join(acts, key)
    waiting = F.when(F.col("smart"), "waiting_analysis").otherwise("queued")
    leads = {"decline": F.lit("skipped"), "accept": F.lit("done"), "cancel": F.lit("cancelled"), "retry": waiting}

    def step(held: Column, act: Column) -> Column:
        to = F.lit(None).cast("string")
        for name, (from_, which, commands) in ACTIONS.items():
            may = held["s"].isin(*from_)
            if which:
                may = may & F.coalesce(F.col("aside") == F.lit(which == "@aside"), F.lit(True)) & (held["first"] if which == "@aside" else F.lit(True))
            to = F.when((act["a"] == name) & may, F.when(act["keeps"], held["s"]).otherwise(leads[commands[-1]])).otherwise(to)
        done = F.when(to.isNotNull(), F.concat(held["done"], F.array(act["o"]))).otherwise(held["done"])
        return F.struct(F.coalesce(to, held["s"]).alias("s"), done.alias("done"), (held["first"] & (to.isNull() | act["keeps"])).alias("first"))

    start = F.struct(F.col("status").alias("s"), F.array().cast("array<bigint>").alias("done"), F.lit(True).alias("first"))
    effective = states.select(key, F.explode(F.aggregate("acts", start, step)["done"]).alias("o"))
    kept = effective.join(given, [key, "o"])
    commands = F.when(F.col("keeps"), F.array(F.lit("pending")))
    for name, (_, _, names) in ACTIONS.items():
        whole = F.array(*(F.lit(c) for c in names))
        if name == "reselect":
            whole = F.when(F.coalesce("found", F.lit(False)), whole).otherwise(F.array(F.lit("retry")))
        commands = F.when((F.col("a") == name) & ~F.col("keeps"), whole).otherwise(commands)
    each = kept.select(key, "o", F.posexplode(commands).alias("nth", "command"), "at", "message", "rate").withColumn("o", F.col("o") * 4 + F.col("nth"))
    counts = effective.groupBy(key).agg(F.count("*").cast("int").alias("applied"))
    out = transition(rows, each, key, "o", smart).join(counts, key, "left")
    return out.withColumn("applied", F.coalesce("applied", F.lit(0)))


def end_state(status: Column) -> Column:
    """An aggregate: whether rows are running, else wait for a decision, else all is idle."""
    running = F.coalesce(F.bool_or(status.isin(*GROUPS["running"])), F.lit(False))
    pending = F.coalesce(F.bool_or(status == "needs_decision"), F.lit(False))
    return F.when(running, "running").when(pending, "decision_pending").otherwise("idle")


def rows_that(status: Column) -> dict[str, Column]:
    """Which rows may be executed, removed or retried, and which are complete."""
    return {
        "executable": status.isin("queued", "waiting_analysis"),
        "removable": ~status.isin(*GROUPS["running"]),
        "retryable": status.isin("failed", "cancelled"),
        "completed": status.isin(*GROUPS["done"], *GROUPS["skipped"], *GROUPS["cancelled"]),
    }
