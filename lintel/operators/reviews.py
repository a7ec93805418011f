"""Fire-review monitor: diff snapshots, find HOT signals, one alert per cycle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions import patterns as P
from lintel.plans.skew import HotKeys, checked_broadcast, hot_keys, latest, salted_lookup, split_lag
from lintel.schemas import PERMIT_KEY, REVIEW_KEY
from lintel.session import stored

CYCLE_KEY = [*PERMIT_KEY, "cycle_number"]
REVIEW_ORDER = ["status_date", "observed_at"]
REASON_RANK = {"rejection": 1, "repeat_cycle": 2, "stalled": 3}
MIN_BASELINE = 20
SIGNAL_COLUMNS = [*CYCLE_KEY, "reason", "department", "status", "signal_date", "comment_text"]


def _total_order(reviews: DataFrame) -> list[str]:
    rest = sorted(c for c in reviews.columns if c not in REVIEW_KEY and c not in REVIEW_ORDER)
    return [*REVIEW_ORDER, *rest]


def with_opened_on(reviews: DataFrame, permits: DataFrame) -> DataFrame:
    """Day a review could start: the permit's applied date."""
    opened = permits.select(*PERMIT_KEY, F.col("applied_date").alias("opened_on"))
    return salted_lookup(reviews, opened, PERMIT_KEY, "left")


def review_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New, changed, vanished and unchanged reviews between two snapshots.

    Each side is first reduced to its latest row per review, so the join meets
    one row per key on both sides.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        slim = df.select(*REVIEW_KEY, *REVIEW_ORDER, "status", "comment_text")
        one = latest(slim, REVIEW_KEY, REVIEW_ORDER)
        return one.select(*REVIEW_KEY, F.struct("status", "status_date", "comment_text").alias(name))

    joined = side(previous, "old").join(side(current, "new"), REVIEW_KEY, "full_outer")
    change = (F.when(F.col("old").isNull(), F.lit("new"))
              .when(F.col("new").isNull(), F.lit("vanished"))
              .when(F.col("old").eqNullSafe(F.col("new")), F.lit("unchanged"))
              .otherwise(F.lit("changed")))
    return joined.select(
        *REVIEW_KEY, change.alias("change"),
        F.col("old.status").alias("old_status"), F.col("new.status").alias("new_status"),
        F.col("old.status_date").alias("old_status_date"),
        F.col("new.status_date").alias("new_status_date"))


def status_transitions(reviews: DataFrame, **hot) -> DataFrame:
    """Every review row with the status that came before it, null when first."""
    slices = [F.col("status_date"), F.date_trunc("hour", F.col("observed_at"))]
    return (split_lag(reviews, REVIEW_KEY, _total_order(reviews), ["status", "status_date"], slices, **hot)
            .withColumn("has_previous", F.col("_prev").isNotNull())
            .withColumn("previous_status", F.col("_prev.status"))
            .withColumn("previous_status_date", F.col("_prev.status_date"))
            .drop("_prev"))


def hot_rejections(transitions: DataFrame, exempt: str | None = None) -> DataFrame:
    """A fire department moves into an adverse status, or starts there."""
    was_adverse = F.col("has_previous") & P.is_adverse(F.col("previous_status"), exempt)
    return (
        transitions.filter(P.is_fire_department(F.col("department"))
                           & P.is_adverse(F.col("status"), exempt) & ~was_adverse)
        .select(*CYCLE_KEY, F.lit("rejection").alias("reason"), "department", "status",
                F.col("status_date").alias("signal_date"), "comment_text")
    )


def repeat_cycle(reviews: DataFrame) -> DataFrame:
    """Second or later cycle of a fire discipline, at its first row."""
    fire = reviews.filter((F.col("cycle_number") >= 2) & P.is_fire_department(F.col("department")))
    first = F.min(F.struct("status_date", "observed_at", "comment_text", "status"))
    return (
        fire.groupBy(*REVIEW_KEY).agg(first.alias("f"))
        .select(*CYCLE_KEY, F.lit("repeat_cycle").alias("reason"), "department", "f.status",
                F.col("f.status_date").alias("signal_date"), "f.comment_text")
    )


def turnaround_counts(reviews: DataFrame, by: Sequence[str] = ("jurisdiction_id",)) -> DataFrame:
    """Completed fire reviews per number of days, ``days`` and ``n``; counts of disjoint batches add up."""
    days = F.datediff("status_date", "opened_on")
    done = reviews.filter(P.is_fire_department(F.col("department"))
                          & ~P.is_open_review(F.col("status")) & (days >= 0))
    return done.groupBy(*by, days.alias("days")).agg(F.count(F.lit(1)).alias("n"))


def baseline_of(counts: DataFrame, by: Sequence[str] = ("jurisdiction_id",)) -> DataFrame:
    """Exact p50/p90 days from ``turnaround_counts``, of one batch or of many."""
    return counts.groupBy(*by).agg(
        F.percentile("days", 0.5, F.col("n")).alias("p50_days"),
        F.percentile("days", 0.9, F.col("n")).alias("p90_days"),
        F.sum("n").alias("completed"))


def turnaround_baseline(reviews: DataFrame, by: Sequence[str] = ("jurisdiction_id",)) -> DataFrame:
    """Exact p50/p90 days of completed fire reviews.

    Rows shrink to one per day count before the percentile, so its state is as
    small as the number of distinct durations.
    """
    return baseline_of(turnaround_counts(reviews, by), by)


def open_fire_reviews(reviews: DataFrame) -> DataFrame:
    """Latest row of each fire review that is still open."""
    fire = reviews.filter(P.is_fire_department(F.col("department")))
    return latest(fire, REVIEW_KEY, REVIEW_ORDER).filter(P.is_open_review(F.col("status")))


def stalled_reviews(reviews: DataFrame, baseline: DataFrame, as_of: date) -> DataFrame:
    """Open fire reviews past their due date, or older than the local p90.

    Jurisdictions with too few completed reviews give no verdict; they appear
    with ``stall_basis`` "no baseline" so the silence is visible.
    """
    still_open = open_fire_reviews(reviews)
    joined = still_open.join(checked_broadcast(baseline), "jurisdiction_id", "left")
    return (joined.withColumn("age_days", _age(as_of)).withColumn("stall_basis", _stall_basis(as_of))
            .filter(F.col("stall_basis").isNotNull()))


def _age(as_of: date) -> Column:
    return F.datediff(F.lit(as_of), "opened_on")


def _stall_basis(as_of: date) -> Column:
    return (F.when(F.col("due_date").isNotNull(),
                   F.when(F.col("due_date") < F.lit(as_of), F.lit("past due")))
            .when(F.coalesce(F.col("completed"), F.lit(0)) < MIN_BASELINE, F.lit("no baseline"))
            .when(_age(as_of) > F.col("p90_days"), F.lit("over p90")))


def stalled_signals(stalled: DataFrame, as_of: date) -> DataFrame:
    return (
        stalled.filter(F.col("stall_basis") != "no baseline")
        .select(*CYCLE_KEY, F.lit("stalled").alias("reason"), "department", "status",
                F.lit(as_of).cast("date").alias("signal_date"), "comment_text")
    )


def _rank(reason: Column) -> Column:
    ranks = F.create_map(*[F.lit(v) for pair in REASON_RANK.items() for v in pair])
    return F.try_element_at(ranks, reason)


def pick_signals(signals: DataFrame) -> DataFrame:
    """One signal per permit and cycle: the strongest, then the earliest.

    ``reasons`` keeps every reason that fired, at most one of each kind.
    """
    best = F.min(F.struct(_rank(F.col("reason")).alias("rank"), "signal_date", "department",
                          "comment_text", "status", "reason"))
    return (
        signals.groupBy(*CYCLE_KEY)
        .agg(best.alias("b"), F.array_sort(F.collect_set("reason")).alias("reasons"))
        .select(*CYCLE_KEY, "b.reason", "b.department", "b.status", "b.signal_date",
                "b.comment_text", "reasons")
    )


def picked_at_once(fire: DataFrame, baseline: DataFrame, as_of: date) -> DataFrame:
    """``pick_signals`` of ``signals_at_once``, over the reviews as they lie: a row's own signals are picked from first.

    No signal becomes a row of its own and nothing is sorted again.
    """
    fired = _fired(fire, baseline, as_of)
    rows = fired.select(*CYCLE_KEY, F.least(*_FIRED).alias("b"), *(F.col(c).isNotNull().alias(c) for c in _FIRED))
    reasons = F.array_compact(F.array(*(F.when(F.bool_or(c), F.lit(r)) for c, r in sorted(_FIRED.items(), key=lambda f: f[1]))))
    return (rows.groupBy(*CYCLE_KEY).agg(F.min("b").alias("b"), reasons.alias("reasons"))
            .select(*CYCLE_KEY, "b.reason", "b.department", "b.status", "b.signal_date", "b.comment_text", "reasons"))


def emit_hot(signals: Sequence[DataFrame], history: DataFrame | None = None,
             allow_escalation: bool = False) -> DataFrame:
    """New alerts: one per permit and review cycle, ever.

    With ``allow_escalation`` a stronger reason than the one already sent may
    alert again.
    """
    merged = signals[0]
    for more in signals[1:]:
        merged = merged.unionByName(more)
    picked = pick_signals(merged)
    return picked if history is None else not_sent(picked, history, allow_escalation)


def not_sent(picked: DataFrame, history: DataFrame, allow_escalation: bool = False) -> DataFrame:
    """The picked signals that ``history`` does not hold yet."""
    sent = history.groupBy(*CYCLE_KEY).agg(F.min(_rank(F.col("reason"))).alias("_sent"))
    if not allow_escalation:
        return picked.join(sent, CYCLE_KEY, "left_anti")
    return (picked.join(sent, CYCLE_KEY, "left")
            .filter(F.col("_sent").isNull() | (_rank(F.col("reason")) < F.col("_sent")))
            .drop("_sent"))


def update_history(history: DataFrame, picked: DataFrame) -> DataFrame:
    """History after a run: new alerts added, later reasons folded into old ones."""
    return fold_runs(history.withColumn("run", F.lit(0)).unionByName(picked.withColumn("run", F.lit(1))), "run")


def fold_runs(signals: DataFrame, run: str) -> DataFrame:
    """One row per cycle over the signals of many runs: the strongest reason, the date of the first run's, all reasons."""
    first = F.min(F.struct(run, "signal_date"))
    best = F.min(F.struct(_rank(F.col("reason")).alias("rank"), run, "signal_date", "department",
                          "comment_text", "status", "reason"))
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons"))))
    return (
        signals.groupBy(*CYCLE_KEY)
        .agg(best.alias("b"), first.alias("f"), reasons.alias("reasons"))
        .select(*CYCLE_KEY, "b.reason", "b.department", "b.status", "f.signal_date",
                "b.comment_text", "reasons")
    )


def hot_signals(reviews: DataFrame, as_of: date, history: DataFrame | None = None,
                hot: HotKeys | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """The whole monitor over one set of review snapshots.

    ``hot`` are their hot review keys and ``baseline`` their turnaround, if known (``operators.partials``).
    """
    fire = reviews.filter(P.is_fire_department(F.col("department")))
    if hot is None:
        hot = hot_keys(fire, REVIEW_KEY)
    baseline = stored(turnaround_baseline(fire) if baseline is None else baseline, "baseline")
    if not hot:
        picked = picked_at_once(fire, baseline, as_of)
        return picked if history is None else not_sent(picked, history)
    rejected = hot_rejections(status_transitions(fire, hot=hot))
    stalled = stalled_signals(stalled_reviews(fire, baseline, as_of), as_of)
    return emit_hot([rejected, repeat_cycle(fire), stalled], history)


#: Columns of the signals a review row fires, by the rule's reason.
_FIRED = {"_rejection": "rejection", "_repeat": "repeat_cycle", "_stall": "stalled"}


def _fired(fire: DataFrame, baseline: DataFrame, as_of: date) -> DataFrame:
    """Fire reviews that fire, with a struct per rule, null where it does not, whose order is the order of picking.

    The reviews are dealt and sorted once, by cycle, and what follows by cycle stays where it is.  For reviews
    without a hot key: a review's rows are looked at by one task.
    """
    ordered = Window.partitionBy(*REVIEW_KEY).orderBy(*_total_order(fire))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.struct("status_date", "observed_at", "comment_text", "status")).over(whole)
    judged = fire.withColumns({"_adverse": P.is_adverse(F.col("status")), "_waits": P.is_open_review(F.col("status"))})
    seen = judged.repartition(*CYCLE_KEY).withColumns({
        "_prev": F.lag(F.struct("_adverse")).over(ordered), "_first": first,
        "_open": F.lead(F.lit(True)).over(ordered).isNull() & F.col("_waits")})
    starts = F.col("_prev").isNull()
    marked = seen.withColumns({
        "_rejected": F.col("_adverse") & ~(~starts & F.col("_prev._adverse")),
        "_repeated": starts & (F.col("cycle_number") >= 2)}).filter("_rejected or _repeated or _open")
    stalls = F.col("_open") & (_stall_basis(as_of) != "no baseline")
    fields = ["rank", "signal_date", "department", "comment_text", "status", "reason"]

    def signal(fires, reason, status, day, comment):
        values = [F.lit(REASON_RANK[reason]), day, F.col("department"), F.col(comment), F.col(status), F.lit(reason)]
        return F.when(fires, F.struct(*(v.alias(f) for v, f in zip(values, fields))))

    fired = marked.join(checked_broadcast(baseline), "jurisdiction_id", "left").select(
        *CYCLE_KEY,
        signal(F.col("_rejected"), "rejection", "status", F.col("status_date"), "comment_text").alias("_rejection"),
        signal(F.col("_repeated"), "repeat_cycle", "_first.status", F.col("_first.status_date"), "_first.comment_text").alias("_repeat"),
        signal(stalls, "stalled", "status", F.lit(as_of).cast("date"), "comment_text").alias("_stall"))
    return fired.filter(F.coalesce(*_FIRED).isNotNull())


def signals_at_once(fire: DataFrame, baseline: DataFrame, as_of: date) -> DataFrame:
    """Signals of all three rules over the fire reviews, as the rules give them one by one."""
    fired = _fired(fire, baseline, as_of)
    return (fired.select(*CYCLE_KEY, F.inline(F.array_compact(F.array(*_FIRED))))
            .select(*SIGNAL_COLUMNS))


def permit_review_status(reviews: DataFrame) -> DataFrame:
    """Per permit: latest fire status, highest fire cycle, last adverse date."""
    fire = reviews.filter(P.is_fire_department(F.col("department")))
    newest = F.max(F.struct("status_date", "observed_at", "cycle_number", "comment_text",
                            "department", "status"))
    return (
        fire.groupBy(*PERMIT_KEY)
        .agg(newest.alias("n"), F.max("cycle_number").alias("fire_cycles"),
             F.max(F.when(P.is_adverse(F.col("status")), F.col("status_date"))).alias("last_adverse_on"))
        .select(*PERMIT_KEY, F.col("n.status").alias("fire_status"),
                F.col("n.status_date").alias("fire_status_date"), "fire_cycles", "last_adverse_on")
    )
