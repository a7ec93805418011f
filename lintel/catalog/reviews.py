"""Queries: the fire-review monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.catalog.bindings import AS_OF, SNAPSHOT_CUT
from lintel.catalog.registry import query
from lintel.operators import partials, reviews
from lintel.plans import jobs
from lintel.session import scratch_path, stored

_KEY = "jurisdiction_id, record_number, cycle_number, department"
_CYCLE = "jurisdiction_id, record_number, cycle_number"
_FIRE = "regexp_matches(department, '(?i)fire|life safety|fire marshal|FPB')"
_ADVERSE = ("regexp_matches({0}, '(?i)reject|denied|corrections|comments|revise|resubmit|disapprov"
            "|incomplete|not approved')")
_OPEN = "regexp_matches(status, '(?i)in review|under review|pending|received|assigned|routed')"
_DESC = ("status_date desc, observed_at desc, comment_text desc, due_date desc nulls last, "
         "opened_on desc, reviewer_name desc, status desc")
_ASC = ("status_date, observed_at, comment_text, due_date nulls first, opened_on, reviewer_name, status")

_MOVES = f"""moves as (
  select *, lag(status) over w as previous_status, lag(status_date) over w as previous_status_date,
    row_number() over w > 1 as has_previous
  from b_review window w as (partition by {_KEY} order by {_ASC}))"""

_REJECTED = f"""rejected as (
  select {_CYCLE}, 'rejection' as reason, department, status, status_date as signal_date, comment_text
  from moves where {_FIRE} and {_ADVERSE.format('status')}
    and not (has_previous and {_ADVERSE.format("coalesce(previous_status, '')")}))"""

_REPEATED = f"""repeated as (
  select {_CYCLE}, 'repeat_cycle' as reason, department, status, status_date as signal_date, comment_text from (
    select *, row_number() over (partition by {_KEY} order by status_date, observed_at, comment_text, status) as rn
    from b_review where {_FIRE} and cycle_number >= 2) where rn = 1)"""

_BASELINE = f"""baseline as (
  select jurisdiction_id, quantile_cont(days, 0.5) as p50_days, quantile_cont(days, 0.9) as p90_days,
    count(*) as completed
  from (select *, date_diff('day', opened_on, status_date) as days from b_review
        where {_FIRE} and not {_OPEN}) where days >= 0 group by jurisdiction_id)"""

_STALLED = f"""stalled as (
  select * from (
    select {_KEY}, status, due_date, opened_on, comment_text,
      cast(date_diff('day', opened_on, date '2001-08-01') as int) as age_days,
      case when due_date is not null then case when due_date < date '2001-08-01' then 'past due' end
        when coalesce(completed, 0) < 20 then 'no baseline'
        when date_diff('day', opened_on, date '2001-08-01') > p90_days then 'over p90' end as stall_basis
    from (select *, row_number() over (partition by {_KEY} order by {_DESC}) as rn from b_review where {_FIRE})
    left join baseline using (jurisdiction_id) where rn = 1 and {_OPEN})
  where stall_basis is not null)"""

_PICKED = f"""signals as (
  select *, 1 as pri from rejected union all by name select *, 2 as pri from repeated
  union all by name select {_CYCLE}, 'stalled' as reason, department, status, date '2001-08-01' as signal_date,
    comment_text, 3 as pri from stalled where stall_basis <> 'no baseline'),
picked as (
  select {_CYCLE}, reason, department, status, signal_date, comment_text, reasons from (
    select *, row_number() over (partition by {_CYCLE} order by pri, signal_date, department, comment_text, status) as rn
    from signals)
  join (select {_CYCLE}, string_agg(distinct reason, ',' order by reason) as reasons from signals group by all)
    using ({_CYCLE})
  where rn = 1)"""

_ALL = ", ".join([_MOVES, _REJECTED, _REPEATED, _BASELINE, _STALLED, _PICKED])
_SIGNAL = f"{_CYCLE}, reason, department, status, signal_date, comment_text"
_CUT = SNAPSHOT_CUT.isoformat()


@query("review_diff", f"""
with prv as (select * from (select *, row_number() over (partition by {_KEY}
    order by status_date desc, observed_at desc, comment_text desc, status desc) as rn
    from b_review where status_date < date '{_CUT}') where rn = 1),
cur as (select * from (select *, row_number() over (partition by {_KEY}
    order by status_date desc, observed_at desc, comment_text desc, status desc) as rn
    from b_review where status_date >= date '{_CUT}') where rn = 1)
select {_KEY}, case when prv.status is null then 'new' when cur.status is null then 'vanished'
    when prv.status = cur.status and prv.status_date = cur.status_date and prv.comment_text = cur.comment_text
    then 'unchanged' else 'changed' end as change,
  prv.status as old_status, cur.status as new_status,
  prv.status_date as old_status_date, cur.status_date as new_status_date
from prv full outer join cur using ({_KEY})""")
def review_diff(t):
    early = F.col("status_date") < F.lit(SNAPSHOT_CUT)
    return reviews.review_diff(t.b_review.filter(early), t.b_review.filter(~early))


@query("status_transitions", f"""
with {_MOVES}
select {_KEY}, status, status_date, comment_text, previous_status, previous_status_date, has_previous from moves""")
def status_transitions(t):
    return (reviews.status_transitions(t.b_review)
            .select(*_KEY.split(", "), "status", "status_date", "comment_text", "previous_status",
                    "previous_status_date", "has_previous"))


@query("hot_rejections", f"with {_MOVES}, {_REJECTED} select * from rejected")
def hot_rejections(t):
    return reviews.hot_rejections(reviews.status_transitions(t.b_review))


@query("repeat_cycle", f"with {_REPEATED} select * from repeated")
def repeat_cycle(t):
    return reviews.repeat_cycle(t.b_review)


@query("turnaround_baseline", f"with {_BASELINE} select * from baseline")
def turnaround_baseline(t):
    return reviews.turnaround_baseline(t.b_review)


def _kept_turnaround(t):
    """Five batches of the reviews, one of them loaded twice; returns where their counts lie."""
    path = scratch_path(t.spark, "turnaround")
    for batch in (0, 1, 2, 3, 4, 2):
        partials.add_turnaround(t.b_review.filter(F.pmod(F.month("status_date"), F.lit(5)) == batch), path, str(batch))
    return path


@query("turnaround_baseline_kept", f"with {_BASELINE} select * from baseline")
def turnaround_baseline_kept(t):
    return partials.kept_baseline(t.b_review, _kept_turnaround(t))


@query("hot_signals_kept_baseline", f"with {_ALL} select * from picked")
def hot_signals_kept_baseline(t):
    """The monitor with the turnaround kept by batches: no history is read for it."""
    return (reviews.hot_signals(t.b_review, AS_OF, baseline=partials.kept_baseline(t.b_review, _kept_turnaround(t)))
            .withColumn("reasons", F.array_join("reasons", ",")))


@query("review_opened_on", """
select r.record_number, r.cycle_number, r.department, r.status_date, r.comment_text, p.applied_date as opened_on
from b_review r left join b_permit p using (jurisdiction_id, record_number)""")
def review_opened_on(t):
    return (reviews.with_opened_on(t.b_review.drop("opened_on"), t.b_permit)
            .select("record_number", "cycle_number", "department", "status_date", "comment_text", "opened_on"))


@query("stalled_reviews", f"""
with {_BASELINE}, {_STALLED}
select {_KEY}, status, due_date, opened_on, age_days, stall_basis from stalled""")
def stalled_reviews(t):
    found = reviews.stalled_reviews(t.b_review, stored(reviews.turnaround_baseline(t.b_review), "baseline"), AS_OF)
    return found.select(*_KEY.split(", "), "status", "due_date", "opened_on", "age_days", "stall_basis")


@query("hot_signals", f"with {_ALL} select * from picked")
def hot_signals(t):
    return (reviews.hot_signals(t.b_review, AS_OF)
            .withColumn("reasons", F.array_join("reasons", ",")))


@query("emit_hot_with_history", f"""
with {_ALL}, sent as (
  select distinct {_CYCLE} from b_review where {_FIRE} and {_ADVERSE.format('status')}
    and status_date < date '{_CUT}')
select p.* from picked p anti join sent using ({_CYCLE})""")
def emit_hot_with_history(t):
    early = t.b_review.filter(F.col("status_date") < F.lit(SNAPSHOT_CUT))
    history = reviews.pick_signals(reviews.hot_rejections(reviews.status_transitions(early)))
    return (reviews.hot_signals(t.b_review, AS_OF, history)
            .withColumn("reasons", F.array_join("reasons", ",")))


_EARLIER = _ALL.replace("b_review", "e_review").replace("2001-08-01", _CUT)


@query("monitor_run", f"""
with {_ALL}, sent as (
  with e_review as (select * from b_review where status_date < date '{_CUT}'), {_EARLIER}
  select {_CYCLE} from picked)
select p.* from picked p anti join sent using ({_CYCLE})""")
def monitor_run(t):
    """The second of two days, and the second day again: what the first has sent is not sent again."""
    path = scratch_path(t.spark, "alerts")
    jobs.monitor_run(t.b_review.filter(F.col("status_date") < F.lit(SNAPSHOT_CUT)), SNAPSHOT_CUT, path)
    jobs.monitor_run(t.b_review, AS_OF, path)
    return jobs.monitor_run(t.b_review, AS_OF, path).withColumn("reasons", F.array_join("reasons", ","))


@query("permit_review_status", f"""
select jurisdiction_id, record_number, status as fire_status, status_date as fire_status_date, fire_cycles,
  last_adverse_on from (
  select *, max(cycle_number) over k as fire_cycles,
    max(case when {_ADVERSE.format('status')} then status_date end) over k as last_adverse_on,
    row_number() over (partition by jurisdiction_id, record_number order by status_date desc, observed_at desc,
      cycle_number desc, comment_text desc, department desc, status desc) as rn
  from b_review where {_FIRE} window k as (partition by jurisdiction_id, record_number)) where rn = 1""")
def permit_review_status(t):
    return reviews.permit_review_status(t.b_review)
