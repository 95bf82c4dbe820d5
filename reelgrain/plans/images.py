"""Queries over composed images, splat points, documents and the star schema."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reelgrain.functions import geometry as g
from reelgrain.functions import numeric as num
from reelgrain.functions import splat, text
from reelgrain.operators import aggregates, cloud, joins, matching, rules, sampling, sequences
from reelgrain.plans import base
from reelgrain.plans.base import HEIGHT, IMAGES, OUTLINES, PLACED, POINTS, WIDTH
from reelgrain.plans.frames import FRAMES
from reelgrain.sources.tables import clean_clip, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KINDS = [("two", 0.85), ("one", 0.10), ("empty", 0.05), ("contact", 0.0)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def robot_of(source):
    return F.lower(F.regexp_replace(F.get(F.split(source, ":"), F.lit(1)), r"[\s_-]+", ""))


_ROBOT = r"lower(regexp_replace(string_split({s}, ':')[2], '[\s_-]+', '', 'g'))"


@query(f"""with {IMAGES}, t(kind, target) as (values {', '.join(f"('{k}', {v}::double)" for k, v in KINDS)}), n as (select kind, count(*) as n from img group by kind), w as (select count(*) as total from img)
select t.kind, target, coalesce(n, 0)::bigint as n, coalesce(n, 0) / total::double as share,
 abs(coalesce(n, 0) / total::double - target) > greatest(0.04, 3 * sqrt(target * (1 - target) / total)) as off from t left join n using (kind), w""")
def kind_shares(spark, d):
    """Kinds of images against their target shares."""
    targets = spark.createDataFrame(KINDS, "kind string, target double")
    return aggregates.kind_shares(base.images(spark, d, "kind"), "kind", targets)


@query(f"""with {PLACED}, s as (select case when source like 'cutout:%' or source = 'cutout' then array_to_string(string_split(source, ':')[2:3], ':') when split_part(source, ':', 1) in ('mesh', 'new') then source
 else array_to_string(string_split(source, ':')[1:3], ':') end as source from placed where source is not null) select source, count(*)::bigint as n from s group by source""")
def source_key_counts(spark, d):
    """Robots per source key."""
    return base.placed(spark, d).where("source is not null").groupBy(text.source_key(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


_CELL = f"trunc((bbox[1] + bbox[3]) / 2.0 / {WIDTH + 1} * 6)::int as gx, trunc(bbox[4] / {HEIGHT + 1}::double * 3)::int as gy"


@query(f"""with {PLACED}, c as (select distinct run, {_CELL} from placed where visible > 0.9 and bbox is not null)
select run, count(*)::bigint as cells, count(*) / 18.0::double as coverage from c where gx between 0 and 5 and gy between 0 and 2 group by run""")
def grid_coverage(spark, d):
    """Share of the floor grid with a visible robot in it, per run."""
    p = base.placed(spark, d).where("visible > 0.9 and bbox is not null")
    b = lambda i: F.get("bbox", F.lit(i))
    return aggregates.grid_coverage(p, ["run"], (b(0) + b(2)) / 2, b(3).cast("double"), (0, 0, WIDTH, HEIGHT), (6, 3))


@query(f"""with {IMAGES}, k as (select run, plate, array_to_string([coalesce(r.source, '') || '/' || coalesce(array_to_string([floor(v / 8.0)::int for v in r.bbox], ','), '') for r in coalesce(robots, [])], ';') as sig,
 len(coalesce(robots, [])) > 0 as counts from img), n as (select run, plate, sig, any_value(counts) as counts, count(*) as n from k group by all)
select run, sum(case when counts then n - 1 else 0 end)::bigint as repeats from n group by run""")
def near_duplicates(spark, d):
    """Images of a run that repeat another's plate, sources and boxes (to 8 pixels)."""
    cells = F.transform("robots", lambda r: F.concat_ws("/", F.coalesce(r["source"], F.lit("")), F.coalesce(F.array_join(F.transform(r["bbox"], lambda v: num.floor_div(v, 8).cast("string")), ","), F.lit(""))))
    i = base.images(spark, d, "run", "plate", "robots")
    return aggregates.repeats(i, ["run"], [F.col("plate"), F.coalesce(F.array_join(cells, ";"), F.lit(""))], F.coalesce(F.size("robots") > 0, F.lit(False)))


@query(f"""with {PLACED} select run, round(median((bbox[3] - bbox[1]) / (40 + 0.2 * bbox[4])), 9) as ratio from placed where visible > 0.9 and bbox is not null group by run""")
def median_ratio(spark, d):
    """Median width of visible robots against a modelled one, per run."""
    b = lambda i: F.get("bbox", F.lit(i))
    p = base.placed(spark, d).where("visible > 0.9 and bbox is not null")
    return p.groupBy("run").agg(F.round(F.median((b(2) - b(0)) / (40 + 0.2 * b(3))), 9).alias("ratio"))


_TWO = f"""{IMAGES}, two as (select run, {_ROBOT.format(s='robots[1].source')} as a, {_ROBOT.format(s='robots[2].source')} as b from img where len(robots) = 2)"""


@query(f"""with {_TWO} select case when a = b then a else least(a, b) || '+' || greatest(a, b) end as pair, count(*)::bigint as n from two where a is not null and b is not null group by 1""")
def unordered_pairs(spark, d):
    """How often two robots meet in an image, whichever comes first."""
    two = base.images(spark, d, "robots").where(F.size("robots") == 2)
    r = lambda i: robot_of(F.get("robots", F.lit(i))["source"])
    both = two.select(r(0).alias("a"), r(1).alias("b")).where("a is not null and b is not null")
    return both.groupBy(joins.unordered(F.col("a"), F.col("b")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_TWO}, f(pair) as (values ('ironmoth+rustjaw'), ('quillback+tinderbox')) select run, count(distinct case when a is null or b is null then null when a = b then a else least(a, b) || '+' || greatest(a, b) end)::bigint as match_ups,
count(*) filter (where (case when a is null or b is null then null when a = b then a else least(a, b) || '+' || greatest(a, b) end) in (select pair from f)) / greatest(count(*), 1)::double as as_filmed from two group by run""")
def match_ups(spark, d):
    """Different match-ups of a run, and the share of two-robot images that show a filmed one."""
    filmed = ["ironmoth+rustjaw", "quillback+tinderbox"]
    two = base.images(spark, d, "run", "robots").where(F.size("robots") == 2)
    r = lambda i: robot_of(F.get("robots", F.lit(i))["source"])
    pair = F.when(r(0).isNotNull() & r(1).isNotNull(), joins.unordered(r(0), r(1)))
    return two.select("run", pair.alias("pair")).groupBy("run").agg(F.countDistinct("pair").alias("match_ups"), aggregates.guarded_share(F.col("pair").isin(filmed)).alias("as_filmed"))


@query(f"""with {IMAGES}, c as (select distinct lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip from clips),
j as (select image_id, c.clip is not null as there, img.kind, robots from img left join c on lower(regexp_replace(img.clip, '^\\s+|\\s+$', '', 'g')) = c.clip)
select image_id, p as problem from (select image_id, unnest([case when not there then 'missing' end, case when there and kind = 'two' and coalesce(len(robots) <> 2, true) then 'count' end,
 case when there and coalesce(len([r for r in robots if r.bbox[1] < 0 or r.bbox[2] < 0 or r.bbox[3] >= {WIDTH} or r.bbox[4] >= {HEIGHT}]) > 0, false) then 'outside' end]) as p from j) where p is not null""")
def label_reconcile(spark, d):
    """Images whose clip isn't known, whose robots don't fit their kind or whose boxes leave the picture."""
    c = table(spark, d, "clips").select(clean_clip(F.col("clip")).alias("clip")).where("clip is not null").distinct()
    i = base.images(spark, d, "clip", "kind", "robots").withColumn("clip", clean_clip(F.col("clip")))
    out = lambda r: (F.get(r["bbox"], F.lit(0)) < 0) | (F.get(r["bbox"], F.lit(1)) < 0) | (F.get(r["bbox"], F.lit(2)) >= WIDTH) | (F.get(r["bbox"], F.lit(3)) >= HEIGHT)
    checks = [("count", (F.col("kind") == "two") & F.coalesce(F.size("robots") != 2, F.lit(True))), ("outside", F.exists("robots", out))]
    return joins.reconcile(i, c, "clip", checks, ["image_id"])


@query(f"""with {PLACED}, s as (select image_id, k, string_split(source, ':') as p from placed where source is not null),
u as (select image_id, k, lower(regexp_replace(string_split(p[4], '/')[-1], '^\\s+|\\s+$', '', 'g')) as clip, try_cast(nullif(regexp_extract(p[5], '([0-9]+)', 1), '') as bigint) as frame from s where len(p) = 5), {FRAMES}
select image_id, k, clip, frame from u join held using (clip, frame) where accepted""")
def cutouts_accepted(spark, d):
    """Placed robots whose filmed frame is an accepted one."""
    p = base.placed(spark, d).where("source is not null").select("image_id", "k", F.split("source", ":").alias("p")).where(F.size("p") == 5)
    clip = clean_clip(F.element_at(F.split(F.element_at("p", 4), "/"), -1))
    used = p.select("image_id", "k", clip.alias("clip"), F.expr("try_cast(regexp_extract(p[4], '([0-9]+)', 1) as bigint)").alias("frame"))
    return used.join(base.frames(spark, d, "accepted").where("accepted").select("clip", "frame"), ["clip", "frame"]).select("image_id", "k", "clip", "frame")


@query(f"""with {PLACED}, p as (select run, image_id, {_ROBOT.format(s='source')} as robot, k from placed where source like 'pair:%')
select run, image_id, array_to_string(list(robot order by k), '+') as members from p group by run, image_id having count(*) = 2 and count(robot) = 2""")
def pair_members(spark, d):
    """Images with exactly two filmed-pair robots and who they are, in order."""
    p = base.placed(spark, d).where("source like 'pair:%'").select("run", "image_id", "k", robot_of(F.col("source")).alias("robot"))
    out = p.groupBy("run", "image_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("robot").isNotNull(), F.struct("k", "robot")))).alias("m")).where("n = 2 and size(m) = 2")
    return out.select("run", "image_id", F.array_join(F.transform("m", lambda r: r["robot"]), "+").alias("members"))


@query(f"""with {PLACED} select image_id, k, printf('%d %.6f %.6f %.6f %.6f', 0, (bbox[1] + bbox[3] + 1) / 2.0::double / {WIDTH}, (bbox[2] + bbox[4] + 1) / 2.0::double / {HEIGHT}, (bbox[3] - bbox[1] + 1)::double / {WIDTH}, (bbox[4] - bbox[2] + 1)::double / {HEIGHT}) as line
from placed where bbox is not null""")
def label_lines(spark, d):
    """Label rows of every placed robot."""
    return base.placed(spark, d).where("bbox is not null").select("image_id", "k", g.label_row(F.col("bbox"), WIDTH, HEIGHT).alias("line"))


@query(f"""with {OUTLINES}, s as (select distinct floor((bbox[1] + bbox[3]) / 2.0)::bigint as x, bbox[4]::bigint as y from outl where bbox is not null),
c as (select distinct (bbox[1] + bbox[3]) / 2.0 as cx, bbox[4]::double as cy from outl where bbox is not null and area > 20000)
select x, y from s where exists (select 1 from c where (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 8100)""")
def within_radius(spark, d):
    """Places where a robot stood within 90 pixels of where a large one did."""
    o = base.outlines(spark, d).where("bbox is not null").withColumn("at", g.stand(F.col("bbox")))
    places = o.select(F.floor("at.x").alias("x"), F.col("at.y").cast("bigint").alias("y")).distinct()
    centres = o.where("area > 20000").select(F.col("at.x").alias("cx"), F.col("at.y").alias("cy"))
    return joins.within_radius(places, centres, "x", "y", 90.0)


@query("""select r_name as robot, e.elevation, y.yaw from region, (values (20), (35), (50)) e(elevation), (select range::int as yaw from range(16)) y""")
def variant_grid(spark, d):
    """Every view of every sprite: three elevations by sixteen headings."""
    e = spark.createDataFrame([(20,), (35,), (50,)], "elevation int")
    y = spark.range(16).select(F.col("id").cast("int").alias("yaw"))
    return table(spark, d, "region").select(F.col("r_name").alias("robot")).crossJoin(F.broadcast(e)).crossJoin(F.broadcast(y))


@query("""select n_nationkey, coalesce(o.name, n_name) as n_name from nation left join (values (3, 'third'), (7, 'seventh'), (8, null), (99, 'none')) o(k, name) on o.k = n_nationkey""")
def override_coalesce(spark, d):
    """Automatic names with the hand-given ones over them."""
    o = spark.createDataFrame([(3, "third"), (7, "seventh"), (8, None), (99, "none")], "n_nationkey int, n_name string")
    return joins.overridden(table(spark, d, "nation").select("n_nationkey", "n_name"), o, ["n_nationkey"], "n_name")


@query("""select o_custkey, o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as k from orders) where k = 1""")
def first_wins(spark, d):
    """The first of each customer and priority."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return joins.first_per(o, ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as k, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey, l_linenumber, k::int as rank, n > 4 as extra from r where k <= 4""")
def topk_regions(spark, d):
    """The four largest of each group, and whether there were more."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")  # noqa: E741
    return joins.top_per(l, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 4).select("l_orderkey", "l_linenumber", "rank", "extra")


@query(f"""with {POINTS}, q as (select scene, [quantile_cont(x::double, [0.01, 0.99]), quantile_cont(y::double, [0.01, 0.99]), quantile_cont(z::double, [0.01, 0.99])] as q from pts group by scene),
b as (select scene, [(v[1] + v[2]) / 2 - (v[2] - v[1]) / 2 * 1.25 for v in q] as lo, [(v[1] + v[2]) / 2 + (v[2] - v[1]) / 2 * 1.25 for v in q] as hi from q)
select scene, count(*) filter (where not (x between lo[1] and hi[1] and y between lo[2] and hi[2] and z between lo[3] and hi[3]))::bigint as outside, count(*)::bigint as n from pts join b using (scene) group by scene""")
def region_outside(spark, d):
    """Points of each scene beyond its padded 1-99 % box."""
    p = base.points(spark, d).select("row_id", "scene", "x", "y", "z")
    marked = cloud.outside(["scene"], p, cloud.region(p, ["scene"]))
    return marked.groupBy("scene").agg(F.count_if("outside").alias("outside"), F.count(F.lit(1)).alias("n"))


@query(f"""with {POINTS}, n as (select a.row_id, a.scene, sqrt((a.x::double-b.x::double)*(a.x::double-b.x::double) + (a.y::double-b.y::double)*(a.y::double-b.y::double) + (a.z::double-b.z::double)*(a.z::double-b.z::double)) as dist, b.row_id as o
 from pts a join pts b on a.scene = b.scene and a.row_id <> b.row_id), r as (select *, row_number() over (partition by scene, row_id order by dist, o) as k from n),
m as (select scene, row_id, avg(dist) as knn from r where k <= 8 group by scene, row_id), q as (select scene, median(knn) as mid from m group by scene)
select row_id, scene, round(knn, 6) as knn, knn > 5 * mid as isolated from m join q using (scene)""")
def knn_isolated(spark, d):
    """Mean distance of each point to its eight nearest, and whether it is isolated."""
    p = base.points(spark, d).select("row_id", "scene", "x", "y", "z")
    return cloud.isolated(p, ["scene"], "row_id", 1.0).select("row_id", "scene", F.round("knn", 6).alias("knn"), "isolated")


_ATTR = f"{POINTS}, attr as (select *, 1 / (1 + exp(-opacity::double)) as alpha, list_sort([exp(scale_0::double), exp(scale_1::double), exp(scale_2::double)]) as s from pts)"


@query(f"""with {_ATTR} select scene, round(avg((alpha < 0.1)::int), 9) as faint, round(avg((alpha > 0.9)::int), 9) as solid, round(avg((s[3] > 0.1)::int), 9) as oversized, round(avg((s[3] / s[1] > 100)::int), 9) as needles from attr group by scene""")
def quality_mix(spark, d):
    """Shares of faint, solid, oversized and needle-shaped points."""
    out = cloud.quality_mix(cloud.attributes(base.points(spark, d)), ["scene"])
    return out.select("scene", *[F.round(c, 9).alias(c) for c in ("faint", "solid", "oversized", "needles")])


@query(f"""with {_ATTR}, w as (select scene, s[3] > 0.03 as big, coalesce(alpha * least(pi() * s[2] * s[3] / power(greatest(sqrt(x::double*x::double + y::double*y::double + z::double*z::double), 0.02), 2), 4 * pi()), 0) as w from attr)
select scene, round(avg(big::int), 9) as share, round(sum(case when big then w else 0 end) / sum(w), 9) as weight_share from w group by scene""")
def weighted_share(spark, d):
    """Large points by count and by visual weight as seen from the origin."""
    a = cloud.attributes(base.points(spark, d))
    dist = F.sqrt(num.dot([F.col(c).cast("double") for c in "xyz"], [F.col(c).cast("double") for c in "xyz"]))
    s = lambda i: F.get("sizes", F.lit(i))
    w = F.coalesce(splat.visual_weight(F.col("alpha"), s(1), s(2), dist), F.lit(0.0))
    out = aggregates.weighted_share(a, ["scene"], s(2) > 0.03, w)
    return out.select("scene", F.round("share", 9).alias("share"), F.round("weight_share", 9).alias("weight_share"))


@query(f"""with {POINTS} select scene, bool_and(coalesce(isfinite(opacity) and isfinite(scale_0) and isfinite(scale_1) and isfinite(scale_2) and sqrt(rot_0::double*rot_0 + rot_1::double*rot_1 + rot_2::double*rot_2 + rot_3::double*rot_3) > 1e-6, false)) as intact from pts group by scene""")
def scene_intact(spark, d):
    """Whether every point of a scene is whole."""
    return cloud.attributes(base.points(spark, d)).groupBy("scene").agg(F.bool_and("fine").alias("intact"))


@query(f"""with {POINTS} select scene, floor(x::double)::bigint as px, floor(y::double)::bigint as py, arg_max(row_id, (z, row_id)) as row_id from pts group by all""")
def depth_overwrite(spark, d):
    """The topmost point of every cell."""
    p = base.points(spark, d)
    return aggregates.overwrite(p, [F.col("scene"), F.floor(F.col("x").cast("double")).alias("px"), F.floor(F.col("y").cast("double")).alias("py")], [F.col("z"), F.col("row_id")], F.col("row_id"), "row_id")


@query("""select event_type, quantile_cont(value, 0.01) as value_lo, quantile_cont(value, 0.99) as value_hi, min(value) as value_min, max(value) as value_max from events group by event_type""")
def robust_box(spark, d):
    """Extents with and without the outer percents."""
    out = aggregates.quantile_box(table(spark, d, "events"), ["event_type"], ["value"])
    return out


@query("""select o_orderpriority, least(floor((log10(o_totalprice) - 2) / ((6 - 2) / 50.0::double)), 49)::bigint as bin, count(*)::bigint as n from orders where log10(o_totalprice) between 2 and 6 group by all""")
def histogram(spark, d):
    """Fifty equal bins on a logarithmic axis."""
    return aggregates.histogram(table(spark, d, "orders"), ["o_orderpriority"], F.log10("o_totalprice"), 2.0, 6.0, 50)


@query(f"""with {POINTS}, n as (select scene, count(*) as n from pts group by scene), i as (select row_number() over (order by scene) - 1 as i, n from n)
select sum(n) filter (where i = 0) / sum(n)::double as dominance, max(n) / sum(n)::double as largest from i""")
def dominance(spark, d):
    """Share of sub-model 0, and of the largest."""
    from pyspark.sql import Window

    n = base.points(spark, d).groupBy("scene").agg(F.count(F.lit(1)).alias("images"))
    # one row per scene is left: a global window over the few sub-models
    return aggregates.dominance(n.withColumn("index", F.row_number().over(Window.orderBy("scene")) - 1))


@query(f"""with {FRAMES} select median(unlabelled) as median_all, median(unlabelled) filter (where accepted) as median_kept, min(unlabelled) filter (where accepted) as min_kept from held""")
def blur_summary(spark, d):
    """Medians of all scores and of the kept ones."""
    return aggregates.blur_summary(base.frames(spark, d, "unlabelled", "accepted").withColumnRenamed("unlabelled", "score"), F.col("accepted"))


@query("""select user_id, max(case when event_type = 'view' then value end) as view_value, max(case when event_type = 'click' then value end) as click_value, max(case when event_type = 'purchase' then value end) as purchase_value from events group by user_id""")
def wide_tracks(spark, d):
    """One wide row per key with a column per label."""
    return aggregates.wide(table(spark, d, "events"), ["user_id"], "event_type", ["view", "click", "purchase"], ["value"])


_RUN = f"""{PLACED}, s as (select run, count(*)::bigint as n, count(*) filter (where visible > 0.9) / count(*)::double as clear, count(*) filter (where source is null)::bigint as unnamed from placed group by run)"""


@query(f"""with {_RUN} select run, array_to_string([x for x in [case when n < 20 then 'few robots' end, case when n >= 500 and clear < 0.6 then 'hidden robots' end, case when unnamed > 0 then unnamed || ' without source' end] if x is not null], '|') as warnings,
case when n < 20 then 'NO-GO' when unnamed > 0 or (n >= 500 and clear < 0.6) then 'MARGINAL' else 'GO' end as verdict from s""")
def run_verdicts(spark, d):
    """Warnings of each run and its verdict: failures before warnings."""
    s = base.placed(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("visible") > 0.9) / F.count(F.lit(1))).alias("clear"), F.count_if(F.col("source").isNull()).alias("unnamed"))
    failed = rules.reasons((F.col("n") < 20, "few robots"))
    soft = rules.reasons(((F.col("n") >= 500) & (F.col("clear") < 0.6), "hidden robots"), (F.col("unnamed") > 0, F.concat(F.col("unnamed").cast("string"), F.lit(" without source"))))
    return s.select("run", F.array_join(F.concat(failed, soft), "|").alias("warnings"), rules.report_verdict(failed, soft).alias("verdict"))


@query("""select n_name, case when models = 0 or ratio < 0.4 or dom < 0.5 then 'NO-GO' when dom >= 0.9 and ratio >= 0.8 and err < 1.0 and gap <= 0.05 then 'GO' else 'MARGINAL' end as verdict
from (select n_name, count(*) as models, avg((s_acctbal > 0)::int) as ratio, max(s_acctbal) / sum(abs(s_acctbal)) + 0.5 as dom, min(abs(s_acctbal)) / 1000 as err, avg((s_acctbal < -900)::int) as gap from supplier join nation on s_nationkey = n_nationkey group by n_name)""")
def reconstruction_verdicts(spark, d):
    """Reconstruction verdicts from per-group metrics."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = s.groupBy("n_name").agg(F.count(F.lit(1)).alias("models"), F.avg((F.col("s_acctbal") > 0).cast("int")).alias("ratio"), (F.try_divide(F.max("s_acctbal"), F.sum(F.abs("s_acctbal"))) + 0.5).alias("dom"), (F.min(F.abs("s_acctbal")) / 1000).alias("err"), F.avg((F.col("s_acctbal") < -900).cast("int")).alias("gap"))
    return m.select("n_name", rules.reconstruction_verdict(F.col("models"), F.col("ratio"), F.col("dom"), F.col("err"), F.col("gap")).alias("verdict"))


@query("""with u as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings), c as (select label, i, avg(v) as c from u group by label, i),
d as (select u.vec_id, c.label, sqrt(sum((u.v - c.c) * (u.v - c.c))) as dist from u join c using (i) group by u.vec_id, c.label)
select vec_id, label, round(dist, 6) as distance from (select *, row_number() over (partition by vec_id order by dist, label) as k from d) where k = 1""")
def nearest_centre(spark, d):
    """The nearest group centre of each vector."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    each = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c"))
    centres = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    return joins.nearest_centre(e.drop("label"), centres, "v", "vec_id", "label").withColumn("distance", F.round("distance", 6))


@query(f"""with {POINTS}, h as (select f_dc_0, f_dc_1, degrees(atan2(f_dc_1::double, f_dc_0::double)) as a from pts where f_dc_0 is not null and f_dc_1 is not null), m as (select ((a % 360) + 360) % 360 as hue from h)
select (((hue - 345) % 360) + 360) % 360 <= 85 as red, count(*)::bigint as n from m group by 1""")
def hue_range(spark, d):
    """Points in a hue range that passes through zero."""
    p = base.points(spark, d).where("f_dc_0 is not null and f_dc_1 is not null")
    hue = num.hue(F.col("f_dc_0").cast("double"), F.col("f_dc_1").cast("double"))
    return p.groupBy(num.in_hue_range(hue, 345.0, 70.0).alias("red")).agg(F.count(F.lit(1)).alias("n"))


_H = [[0.01, 0.002, -3.0], [0.001, 0.02, -4.0], [0.00001, 0.0004, 1.0]]


@query(f"""with {OUTLINES}, s as (select clip, frame, k, (bbox[1] + bbox[3]) / 2.0::double as x, bbox[4]::double as y from outl where bbox is not null)
select clip, frame, k, round(({_H[0][0]} * x + {_H[0][1]} * y + {_H[0][2]}) / ({_H[2][0]} * x + {_H[2][1]} * y + {_H[2][2]}), 6) as x_m, round(({_H[1][0]} * x + {_H[1][1]} * y + {_H[1][2]}) / ({_H[2][0]} * x + {_H[2][1]} * y + {_H[2][2]}), 6) as y_m from s""")
def floor_positions(spark, d):
    """Where each outline stands on the floor, through a homography."""
    o = base.outlines(spark, d).where("bbox is not null").withColumn("at", g.stand(F.col("bbox")))
    o = o.withColumn("m", g.project(_H, F.col("at.x"), F.col("at.y")))
    return o.select("clip", "frame", "k", F.round("m.x", 6).alias("x_m"), F.round("m.y", 6).alias("y_m"))


@query("""select event_id, 'error' as part from events where event_type = 'error' union all select event_id, 'large' as part from events where value > 90""")
def union_all(spark, d):
    """Two arms with their own filters, duplicates kept."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'error'").select("event_id", F.lit("error").alias("part"))
    return a.unionByName(e.where("value > 90").select("event_id", F.lit("large").alias("part")))


@query("""select event_id, coalesce(value > 50, false) or coalesce(event_type = 'click', false) as either, coalesce(value > 50, false) and coalesce(event_type = 'click', false) as both, coalesce(value > 50, false) and not coalesce(event_type = 'click', false) as only_large from events""")
def mask_ops(spark, d):
    """Union, intersection and difference of row masks."""
    a, b = F.coalesce(F.col("value") > 50, F.lit(False)), F.coalesce(F.col("event_type") == "click", F.lit(False))
    return table(spark, d, "events").select("event_id", (a | b).alias("either"), (a & b).alias("both"), (a & ~b).alias("only_large"))


@query(f"with {IMAGES} select distinct run, plate from img")
def plates_used(spark, d):
    """Distinct plates of each run."""
    return base.images(spark, d, "run", "plate").select("run", "plate").distinct()


@query("""select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n from events group by all""")
def stream_windows(spark, d):
    """Hourly counts from a stream run to its end, compared as plain timestamps."""
    from reelgrain.streaming import tracks

    stream, folder = _stream(spark, table(spark, d, "events").select("ts", "event_type", "event_id"))
    out = tracks.run_complete(tracks.windowed_counts(stream, "ts", "1 hour", "1 hour", ["event_type"]), folder, "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _stream(spark, df):
    """A stream over the rows written as files, and the folder for what it makes."""
    from reelgrain.sources.scratch import Scratch

    scratch = Scratch(spark, "stream")
    return spark.readStream.schema(df.schema).parquet(scratch.path_of(scratch.write(df))), scratch.root


@query("""with s as (select user_id, ts, event_id, case when ts < lag(ts) over w + interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
g as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from s)
select min(ts) as first, max(ts) + interval 6 hour as "end", user_id, count(*)::bigint as n from g group by user_id, g""")
def session_windows(spark, d):
    """Sessions of a user's events less than six hours apart, from a stream run to its end."""
    from reelgrain.streaming import tracks

    stream, folder = _stream(spark, table(spark, d, "events").select("user_id", "ts", "event_id"))
    out = tracks.run_complete(tracks.session_counts(stream, "ts", "1 hour", "6 hours", ["user_id"]), folder, "sessions")
    return out.select(F.col("first").cast("timestamp_ntz").alias("first"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query()
def floor_planes(spark, d):
    """The floor of each scene."""
    return cloud.floor_plane(table(spark, d, "splat_points"), ["scene"], thick=0.3)


_PATH = [(-4.0, -4.0), (4.0, -3.0), (5.0, 3.0), (0.0, 5.0), (-5.0, 2.0), (0.0, 0.0)]
_HULL = [(float(a), float(b)) for a, b in g.hull(np.asarray(_PATH))]
_INSIDE = " + ".join(f"(({y0}::double > cy) != ({y1}::double > cy) and cx < {repr((x1 - x0) / (y1 - y0))}::double * (cy - {y0}::double) + {x0}::double)::int" for (x0, y0), (x1, y1) in zip(_HULL, _HULL[1:] + _HULL[:1]) if y0 != y1)


@query(f"""with {POINTS}, h as (select distinct floor(x::double / 0.25::double)::bigint as gx, floor(y::double / 0.25::double)::bigint as gy from pts where abs(z) < 1),
c as (select gx, gy, (gx + 0.5::double) * 0.25::double as cx, (gy + 0.5::double) * 0.25::double as cy from (select unnest(range(-20, 21)) as gx), (select unnest(range(-16, 21)) as gy)),
i as (select gx, gy from c where ({_INSIDE}) % 2 = 1)
select count(*)::bigint as inside, count(h.gx)::bigint as covered, count(h.gx) / count(*)::double as cover from i left join h using (gx, gy)""")
def floor_cover(spark, d):
    """How much of the floor within a path's hull holds points, over all scenes."""
    p = base.points(spark, d).where("abs(z) < 1").select("x", "y")
    return cloud.floor_cover(p, _PATH, 0.25)


_TURN = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
_W, _X, _Y, _Z = (f"{float(v)!r}::double" for v in splat.matrix_quaternion(_TURN))
_BOX = "bx as (select scene, " + ", ".join(f"quantile_cont({c}::double, 0.01) as {c}l, quantile_cont({c}::double, 0.99) as {c}h" for c in "xyz") + " from pts group by scene)"
_IN = " and ".join(f"{c}::double between ({c}l + {c}h) / 2 - ({c}h - {c}l) / 2 * 1.25 and ({c}l + {c}h) / 2 + ({c}h - {c}l) / 2 * 1.25" for c in "xyz")


@query(f"""with {POINTS}, {_BOX} select row_id, scene, round(-y::double, 6) as x, round(x::double, 6) as y, round(z::double + 0.5, 6) as z,
round({_W} * rot_0 - {_X} * rot_1 - {_Y} * rot_2 - {_Z} * rot_3, 6) as rot_0, round({_W} * rot_1 + {_X} * rot_0 + {_Y} * rot_3 - {_Z} * rot_2, 6) as rot_1,
round({_W} * rot_2 - {_X} * rot_3 + {_Y} * rot_0 + {_Z} * rot_1, 6) as rot_2, round({_W} * rot_3 + {_X} * rot_2 - {_Y} * rot_1 + {_Z} * rot_0, 6) as rot_3 from pts join bx using (scene) where {_IN}""")
def cleaned_points(spark, d):
    """Points without those outside their scene's region, turned by a rotation and raised."""
    p = base.points(spark, d)
    marked = cloud.outside(["scene"], p, cloud.region(p, ["scene"]))
    out = cloud.cleaned(marked, F.col("outside"), _TURN, np.array([0.0, 0.0, 0.5]))
    return out.select("row_id", "scene", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x", "y", "z", "rot_0", "rot_1", "rot_2", "rot_3")])


_CAMS = [(0.0, 0.0, 1.0), (2.0, 1.0, 1.0), (-3.0, 0.5, 2.0), (1.0, -2.0, 1.5)]
_AWAY = "least(" + ", ".join(f"sqrt((x::double - {a}::double) * (x::double - {a}::double) + (y::double - {b}::double) * (y::double - {b}::double) + (z::double - {c}::double) * (z::double - {c}::double))" for a, b, c in _CAMS) + ")"


@query(f"with {POINTS} select row_id, scene, round({_AWAY}, 6) as cam_dist from pts")
def camera_distances(spark, d):
    """Distance of each point to the nearest camera."""
    out = cloud.camera_distance(base.points(spark, d).select("row_id", "scene", "x", "y", "z"), spark.createDataFrame(_CAMS, "cx double, cy double, cz double"))
    return out.select("row_id", "scene", F.round("cam_dist", 6).alias("cam_dist"))


_SIGNS = f"""{POINTS}, {_BOX}, nb as (select a.row_id, a.scene, sqrt((a.x::double-b.x::double)*(a.x::double-b.x::double) + (a.y::double-b.y::double)*(a.y::double-b.y::double) + (a.z::double-b.z::double)*(a.z::double-b.z::double)) as dist, b.row_id as o
 from pts a join pts b on a.scene = b.scene and a.row_id <> b.row_id), rk as (select *, row_number() over (partition by scene, row_id order by dist, o) as k from nb),
kn as (select scene, row_id, avg(dist) as knn from rk where k <= 8 group by scene, row_id), md as (select scene, median(knn) as mid from kn group by scene),
sg as (select pts.*, 1 / (1 + exp(-opacity::double)) as alpha, not ({_IN}) as outside, {_AWAY} as cam_dist, coalesce(knn > 5 * mid, false) as isolated, list_sort([exp(scale_0::double), exp(scale_1::double), exp(scale_2::double)]) as s
 from pts join bx using (scene) left join kn using (scene, row_id) left join md using (scene)),
fl as (select *, coalesce(cam_dist < 0.8 and alpha > 0.5, false) as free, coalesce(alpha * least(pi() * s[2] * s[3] / power(greatest(cam_dist, 0.02), 2), 4 * pi()), 0) as w from sg),
fa as (select *, outside or free or isolated as floater from fl)"""


def _signs(spark, d):
    p = cloud.attributes(base.points(spark, d))
    marked = cloud.outside(["scene"], p, cloud.region(p, ["scene"]))
    near = cloud.isolated(p.select("row_id", "scene", "x", "y", "z"), ["scene"], "row_id", 1.0).select("scene", "row_id", "isolated").distinct()
    away = cloud.camera_distance(marked.join(near, ["scene", "row_id"], "left"), spark.createDataFrame(_CAMS, "cx double, cy double, cz double"))
    return cloud.floaters(away, 0.8)


@query(f"""with {_SIGNS}, e as (select scene, w, unnest(['outside', 'free', 'isolated', 'any']) as sign, unnest([outside, free, isolated, floater]) as hit from fa)
select scene, sign, round(avg(hit::int), 9) as share, round(coalesce(sum(w) filter (where hit), 0) / sum(w), 6) as weight from e group by scene, sign""")
def floater_shares(spark, d):
    """Share of each scene's points with each sign of a floater, by number and by what they hide."""
    s = lambda i: F.get("sizes", F.lit(i))
    w = F.coalesce(splat.visual_weight(F.col("alpha"), s(1), s(2), F.col("cam_dist")), F.lit(0.0))
    signs = F.explode(F.array(*[F.struct(F.lit(n).alias("sign"), F.col(c).alias("hit")) for n, c in (("outside", "outside"), ("free", "free"), ("isolated", "isolated"), ("any", "floater"))]))
    each = _signs(spark, d).select("scene", w.alias("w"), signs.alias("e")).select("scene", "w", "e.sign", F.coalesce("e.hit", F.lit(False)).alias("hit"))
    out = each.groupBy("scene", "sign").agg(F.avg(F.col("hit").cast("double")).alias("share"), (F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("weight"))
    return out.select("scene", "sign", F.round("share", 9).alias("share"), F.round("weight", 6).alias("weight"))


@query(f"with {_SIGNS} select row_id, scene from fa where coalesce(alpha > 0.5, false) and not floater")
def core_points(spark, d):
    """Opaque points without a sign of a floater."""
    return _signs(spark, d).where("core").select("row_id", "scene")


@query(f"""with {POINTS} select scene, round(min(x::double) - 0.05 * greatest(max(x::double) - min(x::double), max(y::double) - min(y::double)), 6) as x0, round(avg(least(greatest(0.5 + 0.28209479177387814 * f_dc_0::double, 0), 1)), 6) as red from pts group by scene""")
def scene_looks(spark, d):
    """Left border of each scene's view from above, and its mean red."""
    p = base.points(spark, d)
    red = p.groupBy("scene").agg(F.avg(splat.colour(F.col("f_dc_0"))).alias("red"))
    wide = F.max(F.col("x").cast("double")) - F.min(F.col("x").cast("double"))
    high = F.max(F.col("y").cast("double")) - F.min(F.col("y").cast("double"))
    left = p.groupBy("scene").agg((F.min(F.col("x").cast("double")) - 0.05 * F.greatest(wide, high)).alias("x0"))
    return left.join(red, "scene").select("scene", F.round("x0", 6).alias("x0"), F.round("red", 6).alias("red"))


@query(f"""with {POINTS}, b as (select min(x::double) as x0, max(x::double) as x1, min(y::double) as y0, max(y::double) as y1 from pts where scene = 'arena_full')
select round(x0 - 0.05 * greatest(x1 - x0, y1 - y0), 6) as x0, round(y0 - 0.05 * greatest(x1 - x0, y1 - y0), 6) as y0, round(900 / (greatest(x1 - x0, y1 - y0) * 1.1), 6) as scale from b""")
def top_view(spark, d):
    """Origin and scale of a scene's view from above."""
    p = base.points(spark, d).where("scene = 'arena_full'").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return aggregates.top_down_extent(p, "x", "y", 900).select(*[F.round(c, 6).alias(c) for c in ("x0", "y0", "scale")])


@query("""select l_linenumber, round(max(case when l_discount > 0 then -10 * log10(l_discount::double) end), 6) as best, count(*) filter (where l_discount = 0)::bigint as exact from lineitem group by l_linenumber""")
def noise_ratios(spark, d):
    """Best signal-to-noise ratio of errors, and how many there are without an error."""
    rows = table(spark, d, "lineitem").select("l_linenumber", F.col("l_discount").cast("double").alias("e"))
    return rows.groupBy("l_linenumber").agg(F.round(F.max(num.psnr(F.col("e"))), 6).alias("best"), F.count_if(F.col("e") == 0).alias("exact"))


@query("""with o as (select l_orderkey as image, l_partkey as point, l_discount::double as error from lineitem), t as (select avg(n) as track_length from (select count(*) as n from o group by point)),
s as (select avg(n) as seen_mean, min(n) as seen_min, max(n) as seen_max from (select count(*) as n from o group by image))
select round((select avg(error) from o), 9) as error, round(track_length, 6) as track_length, round(seen_mean, 6) as seen_mean, seen_min::bigint as seen_min, seen_max::bigint as seen_max from t, s""")
def observation_means(spark, d):
    """Mean error, observations per point and points per image, orders standing for images and parts for points."""
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("point"), F.col("l_discount").cast("double").alias("error"))
    out = aggregates.reconstruction_means(o, o)
    return out.select(F.round("error", 9).alias("error"), F.round("track_length", 6).alias("track_length"), F.round("seen_mean", 6).alias("seen_mean"), "seen_min", "seen_max")


@query(f"""with {IMAGES}, n as (select run, image_id, row_number() over (partition by run order by image_id) - 1 as i, count(*) over (partition by run) as n, ceil(round(count(*) over (partition by run) * 0.9, 9))::bigint as m from img),
k as (select run, case when m = 1 then 0 else (j * (n - 1)) // (m - 1) end as i from (select distinct run, n, m from n), lateral (select unnest(range(m)) as j))
select run, image_id from n anti join k on k.run = n.run and k.i = n.i where n.run is not null""")
def held_out_images(spark, d):
    """Images of a run left out of the nine tenths spread evenly over it."""
    i = base.images(spark, d, "run").where("run is not null").select("run", "image_id")
    return sequences.held_out(i, ["run"], ["image_id"], F.floor(F.col("image_id") / 5000), 0.9)


@query(f"with {IMAGES} select distinct source as name from clips where source is not null union select distinct plate from img where plate is not null")
def file_union(spark, d):
    """Files named by clips or by images, once each."""
    from reelgrain.sources.documents import file_names

    return file_names(table(spark, d, "clips").select("source"), base.images(spark, d, "plate").select("plate"))


@query(f"with {IMAGES} select run, coalesce(bool_and(kind in ('two', 'one', 'empty')), true) as free from img group by run")
def free_runs(spark, d):
    """Runs all of whose images are of the free kinds; images without a kind don't count against one."""
    kind = F.col("kind").isin("two", "one", "empty")
    return base.images(spark, d, "run", "kind").groupBy("run").agg(F.coalesce(F.bool_and(kind), F.lit(True)).alias("free"))


@query(f"""with recursive {PLACED}, tr as (select run, image_id, k, bbox, row_number() over (partition by run, image_id order by k) as rn from placed where bbox is not null),
fo as (select run, image_id, list([v + image_id % 40 for v in bbox] order by k) as f from placed where bbox is not null and visible > 0.3 group by run, image_id),
a as (select tr.*, coalesce(f, []) as f from tr left join fo on fo.image_id = tr.image_id and fo.run is not distinct from tr.run),
t(run, image_id, rn, f, used, hit) as (select run, image_id, 0::bigint, f, []::bigint[], false from a where rn = 1
 union all select a.run, a.image_id, a.rn, a.f, case when y.hit then list_append(t.used, y.best) else t.used end, y.hit
 from t join a on a.image_id = t.image_id and a.run is not distinct from t.run and a.rn = t.rn + 1,
 lateral (select [case when list_contains(t.used, i) then -1.0::double else greatest(least(a.bbox[3], a.f[i][3]) - greatest(a.bbox[1], a.f[i][1]), 0)::double * greatest(least(a.bbox[4], a.f[i][4]) - greatest(a.bbox[2], a.f[i][2]), 0) /
  ((a.bbox[3] - a.bbox[1]) * (a.bbox[4] - a.bbox[2]) + (a.f[i][3] - a.f[i][1]) * (a.f[i][4] - a.f[i][2]) - greatest(least(a.bbox[3], a.f[i][3]) - greatest(a.bbox[1], a.f[i][1]), 0)::double * greatest(least(a.bbox[4], a.f[i][4]) - greatest(a.bbox[2], a.f[i][2]), 0) + 1e-9::double) end for i in range(1, len(a.f) + 1)] as o) x,
 lateral (select list_max([i for i in range(1, len(x.o) + 1) if x.o[i] = list_max(x.o)]) as best, coalesce(list_max(x.o) >= 0.5, false) as hit) y),
s as (select run, image_id, count(*) filter (where hit) as hits, max(rn) as total, len(any_value(f)) as found from t group by run, image_id)
select run, sum(hits)::bigint as hits, sum(total)::bigint as total, sum(found - hits)::bigint as extra, sum(hits) / greatest(sum(total), 1)::double as recall from s group by run""")
def detector_recall(spark, d):
    """Placed robots found again by boxes moved by their position in the image, per run."""
    p = base.placed(spark, d).where("bbox is not null")
    shift = (F.col("image_id") % 40).cast("int")
    found = p.where("visible > 0.3").select("run", "image_id", "k", F.transform("bbox", lambda v: v + shift).alias("box"))
    rows = matching.detections_matched(p.select("run", "image_id", "k", F.col("bbox").alias("box")), found, ["run", "image_id"])
    hits = rows.groupBy("run").agg(F.count_if("hit").alias("hits"), F.count("k").alias("total"), F.sum("extra").alias("extra"))
    return hits.withColumn("recall", F.col("hits") / F.greatest(F.col("total"), F.lit(1)))


def _unit(keys: str, seed: int) -> str:
    """The uniform number of ``numeric.unit`` in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', {keys}, '{seed}')), 1, 13))::bigint / 4503599627370496::double)"


@query(f"""with {PLACED}, m as (select distinct {_ROBOT.format(s='source')} as robot, source from placed where source like 'cutout:%'), mm as (select *, row_number() over (partition by robot order by md5(source), source) - 1 as i from m where robot is not null),
r as (select robot, n, row_number() over (order by md5(robot), robot) - 1 as g, count(*) over () as whole from (select robot, count(*) as n from mm group by robot)),
p as (select image_id, r.robot, floor({_unit('image_id', 4)} * r.n)::bigint as i from img join r on r.g = floor({_unit('image_id', 3)} * r.whole)::bigint)
select image_id, p.robot, source from p join mm on mm.robot = p.robot and mm.i = p.i""")
def two_level_sample(spark, d):
    """For each image a uniform robot, then a uniform cut-out of it."""
    pool = base.placed(spark, d).where("source like 'cutout:%'").select(robot_of(F.col("source")).alias("robot"), "source").where("robot is not null")
    return sampling.two_level(base.images(spark, d, "run"), pool, "image_id", "robot", "source", seed=3)


@query(f"""with {PLACED}, f as (select {_ROBOT.format(s='source')} as robot, coalesce(lower(string_split(arg_min(source, source), ':')[4]), '') as c from placed where source like 'cutout:%' group by 1),
r as (select robot, c, row_number() over (order by c, md5(robot), robot) - 1 as g, count(*) over () as whole from f where robot is not null), s as (select c, min(g) as start, count(*) as gap from r where c <> '' group by c),
p as (select image_id, coalesce(s.start, 9e15) as start, coalesce(s.gap, 0) as gap, (select count(*) from r) - coalesce(s.gap, 0) as rest from img left join s on s.c = lower(img.clip)),
a as (select image_id, start, gap, floor({_unit('image_id', 9)} * rest)::bigint as i from p where rest > 0)
select image_id, robot from a join r on r.g = case when i >= start then i + gap else i end""")
def other_clip_draw(spark, d):
    """For each image a uniform robot whose first cut-out was not filmed in the image's own clip."""
    clip = F.lower(F.get(F.split("source", ":"), F.lit(3)))
    pool = base.placed(spark, d).where("source like 'cutout:%'").select(robot_of(F.col("source")).alias("robot"), "source", clip.alias("clip"))
    images = base.images(spark, d, "clip").select("image_id", F.lower("clip").alias("clip"))
    return sampling.other_group(images, pool, "image_id", "robot", "source", "clip", seed=9)


@query(f"""with {IMAGES}, u as (select {_unit('image_id', 5)} as u from img) select case when u < 0.85 then 'two' when u < 0.85::double + 0.10::double then 'one' else 'empty' end as kind, count(*)::bigint as n from u group by 1""")
def kind_draw(spark, d):
    """Kinds drawn by their shares."""
    i = base.images(spark, d, "run")
    return i.groupBy(sampling.draw_kind("image_id", KINDS[:3], seed=5).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _second(keys: str, x: str, y: str, width: str, seed: int) -> str:
    far = f"({width}::double * case when {_unit(keys, seed)} < 0.5 then 0.7::double + 0.6::double * {_unit(keys, seed + 1)} else 1.5::double + 3.5::double * {_unit(keys, seed + 1)} end)"
    angle = f"({_unit(keys, seed + 2)} * 6.283185307179586::double)"
    return f"{x}::double + {far} * cos({angle}) as x, {y}::double + 0.6::double * {far} * sin({angle}) as y"


@query(f"""with {IMAGES}, t as (select image_id, attempt, {_second('image_id, attempt', '720', '400', '160', 7)} from img, (select unnest(range(200)) as attempt)),
a as (select *, row_number() over (partition by image_id order by attempt) as rn from t where x between 80 and 1440 - 80 and y between 200 and 762)
select image_id, attempt::int as attempt, round(x, 6) as x, round(y, 6) as y from a where rn = 1""")
def reject_sample(spark, d):
    """Second robots placed until one fits into the picture."""
    i = base.images(spark, d, "run").select("image_id")
    x, y = sampling.second_place("image_id", F.lit(720.0), F.lit(400.0), F.lit(160.0), seed=7)
    ok = F.col("x").between(80, WIDTH - 80) & F.col("y").between(200, HEIGHT)
    out = sampling.first_accepted(i, "image_id", 20, {"x": x, "y": y}, ok)
    return out.select("image_id", F.col("attempt").cast("int").alias("attempt"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""with t as (select attempt, {_unit('attempt', 11)} * 1440 as x, {_unit('attempt', 12)} * 762 as y from (select unnest(range(20000)) as attempt))
select (row_number() over (order by attempt) - 1 + 100)::bigint as number, attempt, round(x, 6) as x, round(y, 6) as y from t where x between 80 and 1360 and y between 500 and 762 order by attempt limit 600""")
def accepted_layouts(spark, d):
    """Places drawn until six hundred lie on the near floor, numbered from 100."""
    columns = {"x": num.unit("attempt", seed=11) * 1440, "y": num.unit("attempt", seed=12) * 762}
    out = sampling.accepted_until(spark, 600, columns, F.col("x").between(80, 1360) & F.col("y").between(500, 762), start=100)
    return out.select("number", "attempt", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("with n as (select *, row_number() over (partition by p_brand order by md5('1|' || p_partkey), p_partkey) as rn from part) select * exclude (rn) from n where rn <= 3")
def brand_sample(spark, d):
    """Three parts per brand by hash order."""
    return sampling.stratified(table(spark, d, "part"), ["p_brand"], "p_partkey", 3, seed=1)


@query("""with n as (select doc_type, doc_id, row_number() over (partition by doc_type order by doc_id) as rn from documents) select doc_type, max(rn)::bigint as n from n group by doc_type""")
def numbered_per_type(spark, d):
    """Two-phase numbering reaches the count of each group."""
    out = sequences.pages(table(spark, d, "documents").select("doc_type", "doc_id"), ["doc_type"], ["doc_id"], F.floor(F.col("doc_id") / 700), 1)
    return out.groupBy("doc_type").agg((F.max("page") + 1).cast("bigint").alias("n"))
