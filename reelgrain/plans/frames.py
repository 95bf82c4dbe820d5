"""Queries over frames, outlines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrain.functions import geometry as g
from reelgrain.functions import numeric as num
from reelgrain.operators import aggregates, folds, grouping, joins, matching, rules, sequences, tracking
from reelgrain.plans import base
from reelgrain.plans.base import FRAMES, OUTLINES
from reelgrain.sources.tables import clean_clip, table

SPAN = 30_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def by_frame():
    return F.floor(F.col("frame") / SPAN)


def by_day():
    return F.unix_date(F.col("ts").cast("date"))


@query(f"""with {FRAMES}, s as (select distinct lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip, lit[1] as start from clips where lit is not null)
select h.clip, h.frame from held h join s using (clip) where h.frame >= s.start and (h.frame - s.start) % 90 = 0""")
def every_nth(spark, d):
    """Every third kept frame from where a clip is lit."""
    start = table(spark, d, "clips").where("lit is not null").select(clean_clip(F.col("clip")).alias("clip"), F.get("lit", F.lit(0)).alias("start")).distinct()
    return sequences.every_nth(base.frames(spark, d, "item_id").join(start, "clip"), 90, F.col("start")).select("clip", "frame")


_FLAGGED = f"""{FRAMES}, n as (select clip, accepted, row_number() over (partition by clip order by frame) as rn from held),
g as (select clip, rn, rn - row_number() over (partition by clip order by rn) as isle from n where not accepted),
r as (select clip, min(rn) as start, max(rn) as end_, count(*) as length from g group by clip, isle)"""


@query(f"""with {_FLAGGED}, t as (select clip, count(*) as total, count(*) filter (where not accepted) as flagged from n group by clip),
m as (select clip, count(*) as runs, max(length) as longest from r group by clip),
u as (select clip, total::bigint as total, flagged::bigint as flagged, coalesce(runs, 0)::bigint as runs, coalesce(longest, 0)::bigint as longest,
 coalesce(longest, 0) / total::double as gap, 1 - flagged / total::double as ratio from t left join m using (clip))
select *, case when ratio < 0.4 then 'NO-GO' when ratio >= 0.8 and gap <= 0.05 then 'GO' else 'MARGINAL' end as verdict from u""")
def flagged_runs_report(spark, d):
    """Per clip the runs of frames that weren't accepted, the longest one's share and a verdict."""
    f = base.frames(spark, d, "accepted")
    run = sequences.flagged_runs(f, ["clip"], ["frame"], by_frame(), ~F.col("accepted"))
    totals = f.groupBy("clip").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("accepted")).alias("flagged"))
    most = run.groupBy("clip").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"))
    out = totals.join(most, "clip", "left").fillna(0, ["runs", "longest"])
    gap, ratio = F.col("longest") / F.col("total"), 1 - F.col("flagged") / F.col("total")
    return out.withColumns({"gap": gap, "ratio": ratio, "verdict": rules.graded(ratio < 0.4, (ratio >= 0.8) & (gap <= 0.05))})


@query(f"""with {_FLAGGED} select clip, start::bigint as start, end_::bigint as "end", length::bigint as length from r order by length desc, clip, start limit 5""")
def top_runs(spark, d):
    """The five longest runs over all clips; equally long ones in order."""
    run = sequences.flagged_runs(base.frames(spark, d, "accepted"), ["clip"], ["frame"], by_frame(), ~F.col("accepted"))
    return run.orderBy(F.desc("length"), "clip", "start").limit(5)


@query("""with m as (select user_id, median(value) as mid from events group by user_id),
n as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (select user_id, rn, rn - row_number() over (partition by user_id order by rn) as isle from n join m using (user_id) where abs(value - mid) < 0.3 * mid),
r as (select user_id, min(rn) as start, max(rn) as e, count(*) as length from f group by user_id, isle)
select user_id, start::bigint as start, e::bigint as "end", length::bigint as length from (select *, row_number() over (partition by user_id order by length desc, start desc) as k from r) where k = 1""")
def run_near_level(spark, d):
    """Per user the longest run of events near the median value, of equally long ones the later."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    mid = e.groupBy("user_id").agg(F.median("value").alias("mid"))
    near = F.abs(F.col("value") - F.col("mid")) < 0.3 * F.col("mid")
    return sequences.longest(sequences.flagged_runs(e.join(mid, "user_id"), ["user_id"], ["ts", "event_id"], by_day(), near), ["user_id"], later=True)


# boxes share a pixel
_TOUCH = "({a}[1] <= {b}[3] and {b}[1] <= {a}[3] and {a}[2] <= {b}[4] and {b}[2] <= {a}[4])"
_CONTACT = f"""{FRAMES}, c as (select clip, frame from held where len(robots) >= 2 and {_TOUCH.format(a='robots[1].bbox', b='robots[2].bbox')}),
s as (select *, sum(case when frame - before <= 60 then 0 else 1 end) over (partition by clip order by frame) as g
 from (select *, lag(frame) over (partition by clip order by frame) as before from c)),
stretch as (select clip, min(frame) as first, max(frame) as last, count(*) as n from s group by clip, g)"""


def _stretches(spark, d):
    two = base.frames(spark, d, "robots").where(F.size("robots") >= 2)
    box = lambda i: F.get("robots", F.lit(i))["bbox"]
    return sequences.sessions(two.where(g.touches(box(0), box(1))), ["clip"], "frame", 60, by_frame())


@query(f"with {_CONTACT} select clip, first, last, n::bigint as n from stretch")
def stretch_sessions(spark, d):
    """Stretches of frames whose first two outlines touch, gaps of up to 60 frames joined."""
    return _stretches(spark, d)


_APART = """apart as (select clip, frame from held where len(robots) = 2 and robots[1].on_change >= 0.55 and robots[2].on_change >= 0.55
 and not (robots[1].bbox[1] - 60 <= robots[2].bbox[3] and robots[2].bbox[1] - 60 <= robots[1].bbox[3]
 and robots[1].bbox[2] - 60 <= robots[2].bbox[4] and robots[2].bbox[2] - 60 <= robots[1].bbox[4]))"""


@query(f"""with {_CONTACT}, {_APART}
select s.clip, s.first, s.last, s.n::bigint as n, (select max(frame) from apart a where a.clip = s.clip and a.frame between s.first - 150 and s.first) as before,
(select min(frame) from apart a where a.clip = s.clip and a.frame between s.last and s.last + 150) as after from stretch s""")
def asof_bounded_both(spark, d):
    """For each stretch the latest frame apart before it and the earliest after it, within 150 frames."""
    f = base.frames(spark, d, "robots").where(F.size("robots") == 2)
    r = lambda i: F.get("robots", F.lit(i))
    apart = f.where((r(0)["on_change"] >= 0.55) & (r(1)["on_change"] >= 0.55) & ~g.touches(r(0)["bbox"], r(1)["bbox"], 60))
    return joins.bounded_asof(_stretches(spark, d), apart, ["clip"], "first", "last", "frame", 150)


@query(f"""with {_CONTACT} select clip, frame from held h where not exists (select 1 from stretch s where s.clip = h.clip and h.frame between s.first - 150 and s.last + 98)""")
def range_anti(spark, d):
    """Frames in no stretch, with 150 frames before and 98 after it."""
    s = _stretches(spark, d).select("clip", (F.col("first") - 150).alias("lo"), (F.col("last") + 98).alias("hi"))
    return joins.outside_spans(base.frames(spark, d, "item_id"), s, ["clip"], "frame", "lo", "hi", 3000).select("clip", "frame")


@query(f"""with {FRAMES}, n as (select clip, frame, unlabelled, row_number() over (partition by clip order by frame) as rn from held),
b as (select *, (rn - 1) // 5 as block, count(*) over (partition by clip, (rn - 1) // 5) as size, row_number() over (partition by clip, (rn - 1) // 5 order by unlabelled desc nulls last, rn) as k from n)
select clip, frame, unlabelled, block::bigint as block from b where size = 5 and k = 1""")
def block_argmax(spark, d):
    """Of every five kept frames the one of greatest unlabelled share; an incomplete last block gives none."""
    return sequences.block_best(base.frames(spark, d, "unlabelled"), ["clip"], ["frame"], by_frame(), "unlabelled", 5)


@query(f"""with {OUTLINES}, p as (select clip, frame, (bbox[1] + bbox[3]) / 2.0 as x, bbox[4]::double as y from outl where k = 0 and bbox is not null),
s as (select clip, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as d from p window w as (partition by clip order by frame))
select clip, count(*)::bigint as n, round(coalesce(sum(d), 0), 3) as path from s group by clip""")
def path_length(spark, d):
    """How far the first outline's stand point travels in each clip."""
    o = base.outlines(spark, d).where("k = 0 and bbox is not null").withColumn("at", g.stand(F.col("bbox"))).select("clip", "frame", "at.x", "at.y")
    out = sequences.path_length(o, ["clip"], ["frame"], ["x", "y"], by_frame())
    return out.withColumn("path", F.round("path", 3))


@query("""select event_id, user_id, sum(coalesce(round(value * 100)::bigint, 0)) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as offset_sum from events""")
def running_offsets(spark, d):
    """Running sum of whole offsets per user."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("step"))
    return sequences.running_sums(e, ["user_id"], ["ts", "event_id"], {"offset_sum": "step"}, by_day()).select("event_id", "user_id", "offset_sum")


@query("""select event_id, array_to_string(list(event_id) over (partition by user_id order by ts, event_id rows 19 preceding), ',') as trail from events""")
def trail_buffer(spark, d):
    """The last 20 events of the user at each event."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    out = sequences.trail(e, ["user_id"], ["ts", "event_id"], "event_id", 20, by_day())
    return out.select("event_id", F.array_join(F.transform("trail", lambda v: v.cast("string")), ",").alias("trail"))


@query("""with n as (select user_id, epoch_us(ts) / 1000000.0 as t, row_number() over (partition by user_id order by ts, event_id) as rn from events)
select user_id, rn::bigint as rn, case when t - lag(t) over w = 0 then null else round(10 / (t - lag(t) over w), 9) end as fps from n where rn % 10 = 0 window w as (partition by user_id order by rn)""")
def fps_meter(spark, d):
    """Rate over every ten events of a user."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return sequences.frame_rate(e, ["user_id"], ["ts", "event_id"], "t", by_day()).withColumn("fps", F.round("fps", 9))


@query("""select event_id, coalesce(greatest(round(epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) over (partition by user_id order by ts, event_id), 6), 0.001), round(1 / 98.0::double, 9)) as dt from events""")
def dt_floor(spark, d):
    """Seconds since the user's last event, at least a thousandth; 1/98 for the first."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    out = sequences.step_time(e, ["user_id"], ["ts", "event_id"], "t", by_day())
    return out.select("event_id", F.when(F.col("dt") == 1 / 98, F.round(F.lit(1 / 98), 9)).otherwise(F.greatest(F.round("dt", 6), F.lit(0.001))).alias("dt"))


@query("""with recursive n as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as rn from events),
e(user_id, event_id, rn, s) as (select user_id, event_id, rn, value from n where rn = 1 union all
 select n.user_id, n.event_id, n.rn, 0.9::double * e.s + 0.1::double * n.value from e join n on n.user_id = e.user_id and n.rn = e.rn + 1)
select event_id, round(s + 1.3e-8, 6) as ewma from e""")
def ewma_fold(spark, d):
    """Exponentially weighted mean of a user's values, seeded by the first; shifted off the decimal ties before rounding."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return folds.ewma(e, ["user_id"], ["ts", "event_id"], "value", by_day()).select("event_id", F.round(F.col("ewma") + 1.3e-8, 6).alias("ewma"))


@query(f"""with {FRAMES} select clip, frame, coalesce(lag(unlabelled) over w, lead(unlabelled) over w) as against from held window w as (partition by clip order by frame)""")
def against_previous(spark, d):
    """What each frame is compared with: the frame before, or for want of one the frame after."""
    f = base.frames(spark, d, "unlabelled")
    out = sequences.neighbours(f, ["clip"], ["frame"], by_frame(), {"p": "unlabelled"}, {"q": "unlabelled"})
    return out.select("clip", "frame", F.coalesce("p", "q").alias("against"))


@query(f"""with {FRAMES}, n as (select clip, frame, accepted, row_number() over (partition by clip order by frame) as rn from held)
select clip, frame, (rn - coalesce(max(case when accepted then rn end) over (partition by clip order by rn), 0))::bigint as stale from n""")
def stale_counter(spark, d):
    """Frames since the last accepted one."""
    return sequences.stale(base.frames(spark, d, "accepted"), ["clip"], ["frame"], by_frame(), F.col("accepted")).select("clip", "frame", "stale")


@query("""with m as (select event_type, max(value) as best from events group by event_type)
select event_type, max(best) as best, min(event_id) as step from events join m using (event_type) where value >= best - 0.25 group by event_type""")
def plateau_step(spark, d):
    """First step at which a metric is within 0.25 of its best."""
    return sequences.plateau(table(spark, d, "events"), ["event_type"], "event_id", "value", 0.25)


@query("""select event_type, max(value) filter (where k = 1) as last, round(avg(value), 6) as tail_mean
from (select *, row_number() over (partition by event_type order by event_id desc) as k from events) where k <= 100 group by event_type""")
def last_and_tail_mean(spark, d):
    """Last value and mean of the last hundred per metric."""
    out = sequences.last_and_tail(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], "value", 100)
    return out.withColumn("tail_mean", F.round("tail_mean", 6))


@query("""with n as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents),
j as (select range as j from range(12))
select distinct doc_id from n, j where j < least(12, n) and i = case when least(12, n) = 1 then 0 else floor(j * (n - 1) / (least(12, n) - 1)) end""")
def even_sample(spark, d):
    """Twelve documents spread evenly over their order."""
    return sequences.even_sample(table(spark, d, "documents").select("doc_id"), ["doc_id"], F.floor(F.col("doc_id") / 5000), 12)


@query("""with n as (select doc_type, doc_id, row_number() over (partition by doc_type order by doc_id) - 1 as i from documents)
select doc_type, doc_id, (i // 9)::bigint as page, (i % 9)::bigint as slot, (i // 9) % 5 = 4 as invented from n""")
def pages_of_nine(spark, d):
    """Documents in pages of nine per type; every fifth page is marked."""
    out = sequences.pages(table(spark, d, "documents").select("doc_type", "doc_id"), ["doc_type"], ["doc_id"], F.floor(F.col("doc_id") / 5000), 9)
    return out.withColumn("invented", F.col("page") % 5 == 4)


@query("""(select p_partkey, 'first' as "end" from part order by p_retailprice desc, p_partkey limit 3) union all
(select p_partkey, 'last' as "end" from part order by p_retailprice, p_partkey desc limit 3)""")
def best_and_worst(spark, d):
    """The three best and three worst of a ranking."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return sequences.ends(p, [("p_retailprice", False), ("p_partkey", True)], 3).select("p_partkey", "end")


@query(f"with {FRAMES}, f as (select clip, frame, row_number() over (partition by clip order by frame) as k from held where accepted) select clip, frame, k::bigint as number from f")
def renumbered(spark, d):
    """Accepted frames of each clip numbered from 1."""
    from reelgrain.operators.ranks import numbered

    return numbered(base.frames(spark, d, "accepted").where("accepted").select("clip", "frame"), ["clip"], ["frame"], by_frame(), "number")


@query(f"""with {OUTLINES}, s as (select *, row_number() over (partition by clip order by frame) as rn from outl where k = 0),
w as (select *, lag(area) over q as a0, (bbox[1] + bbox[3]) / 2.0::double as cx, (bbox[2] + bbox[4]) / 2.0::double as cy, lag(bbox) over q as b0 from s window q as (partition by clip order by rn)),
b as (select clip, frame, rn, coalesce(not (area / nullif(a0, 0)::double between 0.6 and 1.6), false) or coalesce(sqrt(power(cx - (b0[1] + b0[3]) / 2.0::double, 2) + power(cy - (b0[2] + b0[4]) / 2.0::double, 2)) > 90, false) or coalesce(on_change < 0.55, false) as lost from w),
t as (select clip, min(rn) filter (where lost) as gone from b group by clip)
select clip, frame from b join t using (clip) where rn < coalesce(gone, 9e18)""")
def follow_until_lost(spark, d):
    """Frames of the first outline of each clip up to where it can't be the same any more: its size, place or change."""
    at = lambda i: (F.get("bbox", F.lit(i)) + F.get("bbox", F.lit(i + 2))) / 2
    o = base.outlines(spark, d).where("k = 0").select("clip", "frame", F.col("area").cast("double").alias("area"), at(0).alias("cx"), at(1).alias("cy"), "on_change")
    rows = sequences.neighbours(o, ["clip"], ["frame"], by_frame(), {"a0": "area", "x0": "cx", "y0": "cy"}, {})
    jump = F.sqrt((F.col("cx") - F.col("x0")) * (F.col("cx") - F.col("x0")) + (F.col("cy") - F.col("y0")) * (F.col("cy") - F.col("y0")))
    return folds.followed(rows, ["clip"], ["frame"], folds.lost_track(F.col("area"), F.col("a0"), jump, F.col("on_change")), by_frame()).select("clip", "frame")


@query(f"with {_CONTACT}, n as (select *, row_number() over (partition by clip order by frame) as rn from c) select clip, frame from n where rn % 2 = 1")
def one_in_two_touching(spark, d):
    """Every second touching frame of a clip, from the first."""
    f = base.frames(spark, d, "robots")
    box = lambda i: F.get("robots", F.lit(i))["bbox"]
    return folds.one_in(f, ["clip"], ["frame"], by_frame(), (F.size("robots") >= 2) & g.touches(box(0), box(1)), 2).select("clip", "frame")


_GROWN = "(o[1] - 60 <= p[3] and p[1] - 60 <= o[3] and o[2] - 60 <= p[4] and p[2] - 60 <= o[4])"


_FOLD = f"""{FRAMES}, n as (select clip, frame, coalesce([r.bbox for r in robots if r.bbox is not null], []) as b, row_number() over (partition by clip order by frame) as rn from held),
f(clip, frame, rn, pair, contact) as (
 select clip, frame, rn, case when len(b) = 2 then b end, false from n where rn = 1
 union all
 select n.clip, n.frame, n.rn, case when len(n.b) = 2 then n.b when x.hit then [n.b[1], n.b[1]] end, x.hit
 from f join n on n.clip = f.clip and n.rn = f.rn + 1,
 lateral (select coalesce(len(n.b) = 1 and f.pair is not null and {_GROWN.replace('o[', 'n.b[1][').replace('p[', 'f.pair[1][')} and {_GROWN.replace('o[', 'n.b[1][').replace('p[', 'f.pair[2][')}, false) as hit) x)"""


@query(f"with recursive {_FOLD} select clip, frame, contact from f")
def contact_fold(spark, d):
    """Whether a frame's one box stands for two robots in contact, carried through chains of such frames."""
    f = base.frames(spark, d, "robots").select("clip", "frame", F.transform("robots", lambda r: r["bbox"]).alias("boxes"))
    return folds.contact_fold(f, ["clip"], "frame", "boxes")


@query(f"with {FRAMES}, r as (select unnest(reasons) as r from held) select split_part(r, ':', 1) as reason, count(*)::bigint as n from r where r is not null group by 1")
def reason_counts(spark, d):
    """How often each reason was given."""
    return aggregates.reason_counts(base.frames(spark, d, "reasons"), "reasons")


_SAID = rules.REASONS
_RULES = f"""case when coalesce(len(robots), 0) = 0 then '{_SAID["none"]}' end, case when len(robots) = 1 then '{_SAID["one"]}' end,
case when coalesce(len(robots), 0) > 2 or extra then '{_SAID["many"]}' end, case when missed then '{_SAID["missed"]}' end, case when unlabelled > 0.25 then '{_SAID["change"]}' end,
case when len([r for r in robots if r.moving < 0.15]) > 0 then '{_SAID["static"]}' end, case when len([r for r in robots if r.at_edge]) > 0 then '{_SAID["edge"]}' end"""


@query(f"""with recursive {_FOLD}, q as (select lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip, frame, coalesce(min(why), '') as why from rejected where frame is not null group by 1, 2),
u as (select lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip, min('source not known') as note from clips where source is null group by 1),
s as (select h.*, q.why, f.contact, u.note, list_sort([robots[1].area, robots[2].area]) as areas from held h left join q using (clip, frame) left join f using (clip, frame) left join u using (clip)),
e as (select clip, frame, array_to_string([x for x in [{_RULES}, case when len(robots) = 2 and areas[1] < 0.07 * areas[2] and
 (robots[1].bbox[1] - 15 <= robots[2].bbox[3] and robots[2].bbox[1] - 15 <= robots[1].bbox[3] and robots[1].bbox[2] - 15 <= robots[2].bbox[4] and robots[2].bbox[2] - 15 <= robots[1].bbox[4]) then '{_SAID["piece"]}' end,
 case when contact then '{_SAID["contact"]}' end, case when note is not null then '{_SAID["clip"]}' || note end, case when why is not null then '{_SAID["review"]}' || why end] if x is not null], '|') as reasons from s) select clip, frame, reasons from e""")
def outline_reasons(spark, d):
    """Why each frame isn't trusted: by the rules over its outlines, contact carried over the clip, and the lists of clips
    and frames."""
    f = base.frames(spark, d, "robots", "extra", "missed", "unlabelled")
    why = table(spark, d, "rejected").where("frame is not null").groupBy(clean_clip(F.col("clip")).alias("clip"), "frame").agg(F.coalesce(F.min("why"), F.lit("")).alias("why"))
    note = table(spark, d, "clips").where("source is null").select(clean_clip(F.col("clip")).alias("clip"), F.lit("source not known").alias("note")).distinct()
    touching = folds.contact_fold(f.select("clip", "frame", F.transform("robots", lambda r: r["bbox"]).alias("boxes")), ["clip"], "frame", "boxes")
    out = f.join(why, ["clip", "frame"], "left").join(touching, ["clip", "frame"], "left").join(note, "clip", "left")
    return out.select("clip", "frame", F.array_join(rules.outline_reasons(contact=F.col("contact"), untrusted=F.col("note"), rejected=F.col("why")), "|").alias("reasons"))


@query(f"""with {FRAMES}, q as (select distinct lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip, frame from rejected) select h.clip, h.frame from held h semi join q using (clip, frame)""")
def semi_registered(spark, d):
    """Frames on the review list."""
    q = table(spark, d, "rejected").select(clean_clip(F.col("clip")).alias("clip"), "frame")
    return base.frames(spark, d, "item_id").join(q, ["clip", "frame"], "left_semi").select("clip", "frame")


@query(f"""with {FRAMES}, q as (select distinct lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip, frame from rejected) select h.clip, h.frame from held h anti join q using (clip, frame)""")
def anti_registered(spark, d):
    """Frames not on the review list."""
    q = table(spark, d, "rejected").select(clean_clip(F.col("clip")).alias("clip"), "frame")
    return base.frames(spark, d, "item_id").join(q, ["clip", "frame"], "left_anti").select("clip", "frame")


@query(f"""with {FRAMES}, q as (select distinct lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip, frame from rejected)
select count(*)::bigint as listed, count(*) filter (where h.clip is null)::bigint as missing from q left join held h using (clip, frame)""")
def listed_and_missing(spark, d):
    """How many listed frames there are, and how many of them the manifest lacks."""
    from reelgrain.sources.documents import frame_list_gaps

    q = table(spark, d, "rejected").select(F.struct(clean_clip(F.col("clip")).alias("clip"), "frame").alias("name")).distinct()
    return frame_list_gaps(q, base.frames(spark, d, "item_id").select(F.struct("clip", "frame").alias("name")))


@query(f"""with {OUTLINES}, p as (select *, case when on_change >= 0.55 and not coalesce(at_edge, false) then case when moving < 0.15 then 'still' when (bbox[3] - bbox[1]) / (40 + 0.2 * bbox[4]) > 1.4 then 'lifted' end end as kind from outl)
select clip, kind, count(*)::bigint as n from p where kind is not null group by 1, 2""")
def pose_kinds(spark, d):
    """Outlines standing still, or else lifted off the floor."""
    b = lambda i: F.get("bbox", F.lit(i))
    kind = rules.pose_kind(F.col("on_change"), F.col("at_edge"), F.col("moving"), (b(2) - b(0)) / (40 + 0.2 * b(3)))
    return base.outlines(spark, d).withColumn("kind", kind).where("kind is not null").groupBy("clip", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {OUTLINES}, v as (select w.*, y from (select bbox[3] - bbox[1] as width, bbox[4] as y0 from outl where bbox is not null and on_change >= 0.75 and moving >= 0.15) w, lateral (select y0 as y)),
f as (select regr_slope(width, y) as a, regr_intercept(width, y) as b from v), s as (select sqrt(avg(power(width - (a * y + b), 2))) as s from v, f),
k as (select width, y from v, f, s where abs(width - (a * y + b)) <= 2 * s)
select round(regr_slope(width, y), 6) as slope, round(regr_intercept(width, y), 6) as intercept, count(*)::bigint as kept from k""")
def robust_fit(spark, d):
    """Width of real robots by the row they stand on: fitted, trimmed at two deviations, fitted again."""
    b = lambda i: F.get("bbox", F.lit(i))
    real = base.outlines(spark, d).where("bbox is not null and on_change >= 0.75 and moving >= 0.15").select((b(2) - b(0)).alias("width"), b(3).alias("y"))
    out = aggregates.robust_fit(real, [], "y", "width")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "kept")


@query(f"""with {OUTLINES} select clip, count(*) filter (where on_change >= 0.75)::bigint as hits, count(*)::bigint as total, count(*) filter (where on_change >= 0.75) / greatest(count(*), 1)::double as recall from outl group by clip""")
def recall_by_clip(spark, d):
    """Outlines firmly on changed pixels, per clip."""
    return aggregates.recall(base.outlines(spark, d), ["clip"], F.col("on_change") >= 0.75)


@query(f"""with {FRAMES} select clip, frame, round((greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0))::double /
 ((a[3]-a[1]) * (a[4]-a[2]) + (b[3]-b[1]) * (b[4]-b[2]) - greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) + 1e-9::double), 9) as iou
from (select clip, frame, robots[1].bbox as a, robots[2].bbox as b from held) where a is not null and b is not null""")
def outline_iou(spark, d):
    """Overlap of the first two outlines of a frame."""
    f = base.frames(spark, d, "robots").select("clip", "frame", F.get("robots", F.lit(0))["bbox"].alias("a"), F.get("robots", F.lit(1))["bbox"].alias("b")).where("a is not null and b is not null")
    return f.select("clip", "frame", F.round(g.iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query(f"""with {OUTLINES} select printf('%.1f', on_change)::double as rounded, count(*)::bigint as n from outl where on_change is not null group by 1""")
def even_rounding(spark, d):
    """All outlines by their rounded share of changed pixels; ties and near ties go by the exact binary value."""
    o = base.outlines(spark, d).where("on_change is not null")
    return o.groupBy(num.even_round(F.col("on_change"), 1).alias("rounded")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {OUTLINES}, o as (select clip, frame, k, (bbox[1] + bbox[3]) / 2.0::double as x, bbox[4]::double as y from outl where bbox is not null),
q as (select clip, frame, lag(frame) over (partition by clip order by frame) as before from held),
c as (select o.clip, o.frame, o.k, p.k as k0, sqrt((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y)) as cost from o join q using (clip, frame) join o p on p.clip = o.clip and p.frame = q.before),
r as (select *, row_number() over (partition by clip, frame order by cost, k, k0) as rn from c where cost <= 70),
t(clip, frame, rn, k, k0, cost, taken, ls, rs) as (select clip, frame, rn, k, k0, cost, true, [k], [k0] from r where rn = 1
 union all select r.clip, r.frame, r.rn, r.k, r.k0, r.cost, x.ok, case when x.ok then list_append(t.ls, r.k) else t.ls end, case when x.ok then list_append(t.rs, r.k0) else t.rs end
 from t join r on r.clip = t.clip and r.frame = t.frame and r.rn = t.rn + 1, lateral (select not list_contains(t.ls, r.k) and not list_contains(t.rs, r.k0) as ok) x)
select clip, frame, k, k0, round(cost, 9) as cost from t where taken""")
def greedy_match(spark, d):
    """Outlines of each kept frame matched one to one with those of the frame before, cheapest pair first."""
    o = base.outlines(spark, d).where("bbox is not null").withColumn("at", g.stand(F.col("bbox"))).select("clip", "frame", "k", "at")
    f = sequences.neighbours(base.frames(spark, d, "item_id"), ["clip"], ["frame"], by_frame(), {"before": "frame"}, {}).select("clip", "frame", "before")
    prev = o.select("clip", F.col("frame").alias("before"), F.col("k").alias("k0"), F.col("at").alias("at0"))
    pairs = o.join(f, ["clip", "frame"]).join(prev, ["clip", "before"])
    x, y = F.col("at.x") - F.col("at0.x"), F.col("at.y") - F.col("at0.y")
    out = matching.greedy_assign(pairs.withColumn("cost", F.sqrt(x * x + y * y)).where("cost <= 70"), ["clip", "frame"], "k", "k0", "cost")
    return out.withColumn("cost", F.round("cost", 9))


_POSE = "case when on_change >= 0.55 and not coalesce(at_edge, false) then case when moving < 0.15 then 'still' when (bbox[3] - bbox[1]) / (40 + 0.2 * bbox[4]) > 1.4 then 'lifted' end end"


@query(f"""with recursive {OUTLINES}, p as (select clip, frame, k, bbox, {_POSE} as kind from outl), r as (select *, row_number() over (partition by clip, kind order by frame, k) as rn from p where kind is not null and bbox is not null),
t(clip, kind, frame, k, rn, hit, kept) as (select clip, kind, frame, k, rn, false, [bbox] from r where rn = 1
 union all select r.clip, r.kind, r.frame, r.k, r.rn, x.hit, case when x.hit then t.kept else list_append(t.kept, r.bbox) end from t join r on r.clip = t.clip and r.kind = t.kind and r.rn = t.rn + 1,
 lateral (select len([o for o in t.kept if greatest(least(o[3], r.bbox[3]) - greatest(o[1], r.bbox[1]), 0)::double * greatest(least(o[4], r.bbox[4]) - greatest(o[2], r.bbox[2]), 0) /
  ((o[3] - o[1]) * (o[4] - o[2]) + (r.bbox[3] - r.bbox[1]) * (r.bbox[4] - r.bbox[2]) - greatest(least(o[3], r.bbox[3]) - greatest(o[1], r.bbox[1]), 0)::double * greatest(least(o[4], r.bbox[4]) - greatest(o[2], r.bbox[2]), 0) + 1e-9::double) > 0.7]) > 0 as hit) x)
select clip, kind, frame, k from t where not hit""")
def suppressed_outlines(spark, d):
    """Poses of each clip and kind without those that mostly repeat an earlier one."""
    b = lambda i: F.get("bbox", F.lit(i))
    kind = rules.pose_kind(F.col("on_change"), F.col("at_edge"), F.col("moving"), (b(2) - b(0)) / (40 + 0.2 * b(3)))
    o = base.outlines(spark, d).withColumn("kind", kind).where("kind is not null").select("clip", "kind", "frame", "k", "bbox")
    return matching.suppress(o, ["clip", "kind"], ["frame", "k"], "bbox").select("clip", "kind", "frame", "k")


def _tracks_sql() -> str:
    """The tracks as a recursive query: one step a frame, both tracks of a clip as structs."""
    step = lambda t: f"""struct_pack(x := {t}.x + {t}.vx * dt, y := {t}.y + {t}.vy * dt, vx := {t}.vx, vy := {t}.vy, p := {t}.p + dt * (2 * {t}.c + dt * {t}.q + 1.0::double), c := {t}.c + dt * {t}.q, q := {t}.q + 400.0::double * dt, stale := {t}.stale, level := {t}.level, area := {t}.area)"""
    away = lambda t: f"sqrt(({t}.x - u.cx) * ({t}.x - u.cx) + ({t}.y - u.cy) * ({t}.y - u.cy))"
    inside = lambda t, u, pad: f"({u}.x - {pad} <= {t}.x and {t}.x <= {u}.x + {u}.w + {pad} and {u}.y - {pad} <= {t}.y and {t}.y <= {u}.y + {u}.h + {pad})"
    cost = lambda t: f"[case when {away(t)} <= 70.0::double * (1 + 0.5::double * {t}.stale) or {inside(t, 'u', 0)} then {away(t)} + coalesce(0.5::double * abs({t}.level - u.i), 0) + coalesce(30.0::double * abs(ln(u.area / {t}.area)), 0) end for u in bl]"

    def moved(t: str, u: str, noise: str, source: str, stale: str, seen: bool) -> str:
        gain, speed = f"({t}.p / ({t}.p + {noise}))", f"({t}.c / ({t}.p + {noise}))"
        mix = lambda c, v: f"case when {t}.{c} is null then {u}.{v}::double else 0.9::double * {t}.{c} + 0.1::double * {u}.{v} end" if seen else f"{t}.{c}"
        return f"""struct_pack(x := {t}.x + {gain} * ({u}.cx - {t}.x), y := {t}.y + {gain} * ({u}.cy - {t}.y), vx := {t}.vx + {speed} * ({u}.cx - {t}.x), vy := {t}.vy + {speed} * ({u}.cy - {t}.y),
 p := {t}.p - {gain} * {t}.p, c := {t}.c - {gain} * {t}.c, q := {t}.q - {speed} * {t}.c, stale := {stale}, source := '{source}', level := {mix('level', 'i')}, area := {mix('area', 'area')})"""

    def after(t: str, own: str, other: str) -> str:
        coast = f"struct_pack(x := {t}.x, y := {t}.y, vx := 0.8::double * {t}.vx, vy := 0.8::double * {t}.vy, p := {t}.p, c := {t}.c, q := {t}.q, stale := {t}.stale + 1, source := 'coast', level := {t}.level, area := {t}.area)"
        return f"""case when {own} is not null then {moved(t, f'bl[{own}]', '4.0::double', 'blob', '0', True)}
 when {other} is not null and {inside(t, f'bl[{other}]', 30)} then {moved(t, f'bl[{other}]', '400.0::double', 'clinch', f'{t}.stale + 1', False)} else {coast} end"""

    skip = lambda costs, at: f"[case when i = {at} then null else {costs}[i] end for i in range(1, len({costs}) + 1)]"
    first = lambda costs: f"case when list_min({costs}) is not null then list_position({costs}, list_min({costs})) end"
    new = lambda c: f"struct_pack(x := {c}.x, y := {c}.y, vx := 0.0::double, vy := 0.0::double, p := 10.0::double, c := 0.0::double, q := 10.0::double, stale := 0, source := 'init', level := null::double, area := null::double)"
    body = f"""select clip, frame, rn, {after('pa', 'ja', 'jb')} as a, {after('pb', 'jb', 'ja')} as b from
 (select *, case when a_first then {first('ca')} else {first(skip('ca', 'fb'))} end as ja, case when a_first then {first(skip('cb', 'fa'))} else {first('cb')} end as jb from
 (select *, {first('ca')} as fa, {first('cb')} as fb, list_min(ca) is not null and (list_min(cb) is null or list_min(ca) <= list_min(cb)) as a_first from
 (select *, {cost('pa')} as ca, {cost('pb')} as cb from (select *, {step('a')} as pa, {step('b')} as pb from (%s)))))"""
    return f"""with recursive {OUTLINES}, bs as (select clip, frame, {{'cx': (bbox[1] + bbox[3]) / 2.0::double, 'cy': (bbox[2] + bbox[4]) / 2.0::double, 'x': bbox[1], 'y': bbox[2], 'w': bbox[3] - bbox[1] + 1, 'h': bbox[4] - bbox[2] + 1, 'area': area, 'i': coalesce(mean, 0.0)}} as u
 from outl where bbox is not null and area > 0), fr as (select clip, frame, frame / 98.0::double as ts, list(u order by u) as bl from bs group by clip, frame),
n as (select *, row_number() over w as rn, case when lag(ts) over w is null then 1 / 98.0::double else greatest(ts - lag(ts) over w, 0.001::double) end as dt from fr join (select clip, min(frame) as f0 from fr where len(bl) >= 2 group by clip) using (clip) where frame >= f0 window w as (partition by clip order by frame)),
sd as (select clip, list({{'x': cx, 'y': cy}} order by cx, cy) as s from (select clip, u.cx as cx, u.cy as cy, row_number() over (partition by clip order by u.area desc, u.cx, u.cy) as k from (select clip, unnest(bl) as u from n where rn = 1)) where k <= 2 group by clip),
t(clip, frame, rn, a, b) as ({body % f"select n.clip, n.frame, n.rn, n.bl, n.dt, {new('sd.s[1]')} as a, {new('sd.s[2]')} as b from n join sd using (clip) where n.rn = 1"}
 union all {body % "select n.clip, n.frame, n.rn, n.bl, n.dt, t.a, t.b from t join n on n.clip = t.clip and n.rn = t.rn + 1"}),
both_ as (select clip, frame, 'home' as label, a as t from t union all select clip, frame, 'opponent', b from t)
select clip, frame, label, round(t.x, 6) as x, round(t.y, 6) as y, round(t.vx, 6) as vx, round(t.vy, 6) as vy, t.stale::int as stale, t.source as source from both_"""


_TRACKS = _tracks_sql()


def _rounded(tracks):
    return tracks.select("clip", "frame", "label", *[F.round(c, 6).alias(c) for c in ("x", "y", "vx", "vy")], "stale", "source")


@query(_TRACKS)
def kalman_track(spark, d):
    """Two tracks of fixed identity through every clip."""
    return _rounded(tracking.track(base.blobs(spark, d)))


@query(_TRACKS)
def stream_track(spark, d):
    """The same tracks from a stream with state per clip."""
    from reelgrain.sources.scratch import Scratch
    from reelgrain.streaming import tracks

    scratch = Scratch(spark, "stream")
    staged = scratch.write(tracking.frames_of(base.blobs(spark, d)))
    stream = spark.readStream.schema(staged.schema).parquet(scratch.path_of(staged))
    return _rounded(tracks.run_all(tracks.track_stream(stream), scratch.root, "tracks"))


@query()
def two_groups(spark, d):
    """Which way round the two outlines of a frame belong, by mean, size and shape within their clip."""
    f = base.frames(spark, d, "robots").where("size(robots) = 2")
    r = lambda i: F.get("robots", F.lit(i))
    b = lambda i, j: F.get(r(i)["bbox"], F.lit(j))
    tall = lambda i: (b(i, 3) - b(i, 1)) / F.greatest(b(i, 2) - b(i, 0), F.lit(1))
    size = lambda i: F.ln(F.greatest(r(i)["area"], F.lit(1))) - 2 * F.ln(F.greatest(b(i, 3), F.lit(60)))
    pairs = f.select("clip", "frame", *[F.array(r(i)["mean"], size(i), tall(i)).alias(f"f{i}") for i in (0, 1)], *[r(i)["area"].alias(f"a{i}") for i in (0, 1)])
    whole = " and ".join(f"forall(f{i}, v -> v is not null)" for i in (0, 1))
    return grouping.two_groups(pairs.where(whole), ["clip"], ["frame"], 3, 0)
