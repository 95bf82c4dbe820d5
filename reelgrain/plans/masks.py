"""Queries over pixel rows of invented frames, made alike in Spark and in SQL, and over where outlines stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrain.functions import geometry as g
from reelgrain.operators import aggregates, outlines
from reelgrain.plans import base
from reelgrain.plans.base import OUTLINES, PLACED
from reelgrain.plans.frames import FRAMES, by_frame
from reelgrain.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDTH, HEIGHT, N = 48, 36, 24


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


PIXELS = f"""px as (select f as frame, x, y, plate, x between 2 and 45 and y between 2 and 33 as arena,
 case when k0 or k1 then (x * 31 + y * 17 + f * 5) % 256 else plate * (case when f % 7 = 6 then 40 else 100 + 10 * (f % 5) end) // 100 end as v, k0, k1
 from (select f, x, y, 80 + (x * 7 + y * 3) % 41 as plate, x between 3 + f and 12 + f and y between 6 and 17 as k0, x between 30 - f and 38 - f and y between 12 and 21 as k1
 from (select unnest(range({N})) as f), (select unnest(range({WIDTH})) as x), (select unnest(range({HEIGHT})) as y)))"""
COVER = PIXELS + """,
op as (select frame, k, x, y, v, abs(v - plate) > 28 as fg, (x + y + frame) % 3 > 0 as moved, not arena as outside from
 (select *, 0 as k from px where k0 union all select *, 1 as k from px where k1 union all select *, 2 as k from px where k1 and y < 16))"""


def pixels(spark):
    """``frame, x, y, v, plate, arena, k0, k1``: a few small frames with two moving patches, uneven light and a dark frame."""
    f, x, y = F.col("frame"), F.col("x"), F.col("y")
    n = WIDTH * HEIGHT
    p = spark.range(N * n).select(F.floor(F.col("id") / n).alias("frame"), (F.col("id") % WIDTH).alias("x"), F.floor(F.col("id") % n / WIDTH).alias("y"))
    p = p.withColumns({"plate": 80 + (x * 7 + y * 3) % 41, "arena": x.between(2, 45) & y.between(2, 33), "k0": x.between(3 + f, 12 + f) & y.between(6, 17), "k1": x.between(30 - f, 38 - f) & y.between(12, 21)})
    light = F.when(f % 7 == 6, 40).otherwise(100 + 10 * (f % 5))
    return p.withColumn("v", F.when(F.col("k0") | F.col("k1"), (x * 31 + y * 17 + f * 5) % 256).otherwise(F.floor(F.col("plate") * light / 100)))


def covers(spark):
    """``frame, k, x, y, v, fg, moved, outside``: pixels of three outlines a frame, the last a part of the second."""
    p = pixels(spark)
    one = [p.where(c).withColumn("k", F.lit(k)) for k, c in enumerate(("k0", "k1", "k1 and y < 16"))]
    rows = one[0].unionByName(one[1]).unionByName(one[2])
    return rows.select("frame", "k", "x", "y", "v", (F.abs(F.col("v") - F.col("plate")) > 28).alias("fg"), ((F.col("x") + F.col("y") + F.col("frame")) % 3 > 0).alias("moved"), (~F.col("arena")).alias("outside"))


@query(f"""with {PIXELS}, gain as (select frame, median(plate) / greatest(median(v), 1) as gain from px where arena group by frame) select frame, round(gain, 9) as gain, 1 / gain between 0.7 and 1.4 as kept from gain""")
def frame_gain(spark, d):
    """Brightness of each frame against its plate, and whether it is near enough."""
    gain = outlines.floor_gain(pixels(spark), ["frame"])
    return gain.select("frame", F.round("gain", 9).alias("gain"), outlines.in_band(F.col("gain")).alias("kept"))


@query(f"""with {PIXELS}, gain as (select frame, median(plate) / greatest(median(v), 1) as gain from px where arena group by frame)
select frame from gain where frame >= 2 and (frame - 2) % 2 = 0 and 1 / gain between 0.7 and 1.4 order by frame limit 8""")
def bright_frames(spark, d):
    """Every second frame from the third that is bright enough, the first eight of them."""
    gain = outlines.floor_gain(pixels(spark), ["frame"]).withColumn("clip", F.lit("a"))
    return outlines.kept_frames(gain, ["clip"], "frame", F.lit(2), 2, outlines.in_band(F.col("gain")), by_frame(), 8).select("frame")


@query(f"""with {COVER} select frame, k, count(*)::bigint as area, printf('%.2f', avg(fg::int))::double as on_change, printf('%.2f', avg(moved::int))::double as moving, bool_or(outside) as at_edge,
min(x)::bigint as x0, min(y)::bigint as y0, max(x)::bigint as x1, max(y)::bigint as y1, printf('%.1f', avg(v))::double as mean, trunc(avg(x))::int as cx, trunc(avg(y))::int as cy from op group by frame, k""")
def described_outlines(spark, d):
    """Area, change, edge, box, level and centre of each outline."""
    out = outlines.described(covers(spark), ["frame", "k"])
    box = [F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return out.select("frame", "k", "area", "on_change", "moving", "at_edge", *box, "mean", F.get("centre", F.lit(0)).alias("cx"), F.get("centre", F.lit(1)).alias("cy"))


@query(f"""with {COVER} select frame, k, round(avg(v), 9) as mean, round(stddev_pop(v), 6) as spread, round(avg((v > 180)::int), 9) as bright, round(avg((v < 60)::int), 9) as dark,
round((max(y) - min(y)) / greatest(max(x) - min(x), 1), 9) as tall, round(ln(count(*)) - 2 * ln(greatest(max(y), 60)), 9) as size from op group by frame, k""")
def outline_features(spark, d):
    """Level, spread, bright and dark shares, shape and relative size of each outline."""
    out = outlines.features(covers(spark), ["frame", "k"])
    return out.select("frame", "k", *[F.round(c, 6 if c == "spread" else 9).alias(c) for c in ("mean", "spread", "bright", "dark", "tall", "size")])


@query(f"""with {PIXELS}, r as (select frame, frame % 4 > 0 and x between 2 + frame and 16 + frame and y between 5 and 20 as region, k0 from px)
select frame, coalesce(printf('%.2f', count(*) filter (where region and not k0) / nullif(count(*) filter (where region), 0)::double)::double, 0.0) as unlabelled from r group by frame""")
def unlabelled_share(spark, d):
    """Share of each frame's changed regions no outline covers; frames without a region have none."""
    p, f = pixels(spark), F.col("frame")
    region = (f % 4 > 0) & F.col("x").between(2 + f, 16 + f) & F.col("y").between(5, 20)
    return outlines.unlabelled(p.select("frame", region.alias("region"), F.col("k0").alias("covered")), ["frame"])


@query(f"""with {COVER}, s as (select frame, k, count(*) as n from op group by frame, k),
o as (select a.frame, a.k as j, b.k as k, count(*) as n from op a join op b on a.frame = b.frame and a.x = b.x and a.y = b.y and a.k < b.k group by 1, 2, 3),
k1 as (select s.frame, coalesce(o.n, 0) <= 0.5 * s.n as kept from s left join o on o.frame = s.frame and o.j = 0 and o.k = 1 where s.k = 1),
c2 as (select b.frame, count(distinct (b.x, b.y)) as n from op b join op a on a.frame = b.frame and a.x = b.x and a.y = b.y left join k1 on k1.frame = a.frame where b.k = 2 and (a.k = 0 or (a.k = 1 and k1.kept)) group by b.frame)
select s.frame, s.k from s left join k1 on k1.frame = s.frame left join c2 on c2.frame = s.frame
where s.k = 0 or (s.k = 1 and k1.kept) or (s.k = 2 and coalesce(c2.n, 0) <= 0.5 * s.n)""")
def uncovered_outlines(spark, d):
    """Outlines not mostly covered by those kept before them in their frame."""
    return outlines.uncovered(covers(spark), ["frame"], "k")


@query(f"""with {COVER}, s as (select frame, k, count(*) as n from op group by frame, k),
o as (select a.frame, a.k, b.k as other, count(*)::bigint as shared, avg(a.x) as cx, avg(a.y) as cy from op a join op b on a.frame = b.frame and a.x = b.x and a.y = b.y and a.k < b.k group by 1, 2, 3)
select o.frame, o.k, o.other, shared, round(shared / least(s.n, t.n)::double, 9) as share, round(cx, 9) as cx, round(cy, 9) as cy from o join s on s.frame = o.frame and s.k = o.k join s t on t.frame = o.frame and t.k = o.other""")
def footprint_overlaps(spark, d):
    """Outlines of a frame that share pixels: how many, of the smaller one's, and where."""
    out = outlines.shared_pixels(covers(spark), ["frame"], "k")
    return out.select("frame", "k", "other", "shared", *[F.round(c, 9).alias(c) for c in ("share", "cx", "cy")])


@query(f"""with {COVER}, two as (select * from op where k < 2), c as (select frame, k, avg(x) as cx, avg(y) as cy from two group by frame, k),
r as (select two.frame, x, y, two.k, row_number() over (partition by two.frame, x, y order by power(x - cx, 2) + power(y - cy, 2), two.k) as rn from two join c on c.frame = two.frame and c.k = two.k)
select frame, k, count(*)::bigint as n, sum(x)::bigint as sx, sum(y)::bigint as sy from r where rn = 1 group by frame, k""")
def overlap_split(spark, d):
    """Pixels of two outlines after each shared one went to the nearer centre."""
    own = outlines.split_overlap(covers(spark).where("k < 2"), ["frame"], "k")
    return own.groupBy("frame", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"with {PIXELS} select x, y, trunc(median(v))::int as value from px group by x, y")
def median_plate(spark, d):
    """The empty arena: per-pixel median of the frames."""
    return aggregates.median_image(pixels(spark).select("x", "y", F.col("v").alias("value")))


@query(f"""with {PIXELS}, q as (select frame, case when (x + y) % 3 = 0 then 'rust' else 'teal' end as paint, v as a, plate as b, k0 as mine, x between 3 and 22 and y between 6 and 17 as approved from px)
select frame, round(count(*) filter (where mine and approved) / nullif(count(*) filter (where mine or approved), 0)::double, 9) as paint_iou,
round(case when count(*) filter (where paint = 'rust') > 500 then sqrt(power(median(a) filter (where paint = 'rust') - 120, 2) + power(median(b) filter (where paint = 'rust') - 90, 2)) end, 9) as rust_off,
round(case when count(*) filter (where paint = 'teal') > 500 then sqrt(power(median(a) filter (where paint = 'teal') - 100, 2) + power(median(b) filter (where paint = 'teal') - 100, 2)) end, 9) as teal_off from q group by frame""")
def plate_checks(spark, d):
    """Each frame's paint masks against the approved ones, and its colours against their targets."""
    paint = F.when((F.col("x") + F.col("y")) % 3 == 0, "rust").otherwise("teal")
    q = pixels(spark).select("frame", paint.alias("paint"), F.col("v").alias("a"), F.col("plate").alias("b"), F.col("k0").alias("mine"), (F.col("x").between(3, 22) & F.col("y").between(6, 17)).alias("approved"))
    out = aggregates.plate_check(q, ["frame"], {"rust": (120, 90), "teal": (100, 100)})
    return out.select("frame", *[F.round(c, 9).alias(c) for c in ("paint_iou", "rust_off", "teal_off")])


@query(f"""with {PIXELS} select frame, median(v) as level from px where arena and not k0 and not k1 group by frame""")
def floor_levels(spark, d):
    """Median level of the bare floor."""
    return pixels(spark).where("arena and not k0 and not k1").groupBy("frame").agg(F.median("v").alias("level"))


_STOOD = "stood as (select distinct clip, (bbox[1] + bbox[3]) // 2 as sx, bbox[4] as sy from outl where bbox is not null and on_change >= 0.75 and moving >= 0.15 and not coalesce(at_edge, false))"


@query(f"""with {OUTLINES}, {_STOOD}, c as (select distinct clip from outl), p as (select clip, gx * 40 as x, gy * 40 as y from c, (select unnest(range(2, 35)) as gx), (select unnest(range(2, 18)) as gy))
select clip, x, y from p semi join stood s on s.clip = p.clip and power(p.x - s.sx, 2) + power(p.y - s.sy, 2) <= 8100""")
def placement_floor(spark, d):
    """Places of a grid inside the arena near which a real robot stood, per clip."""
    o = base.outlines(spark, d)
    real = o.where("bbox is not null and on_change >= 0.75 and moving >= 0.15 and not coalesce(at_edge, false)")
    stood = real.select("clip", F.floor((F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2).alias("sx"), F.get("bbox", F.lit(3)).alias("sy"))
    grid = o.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(34).cast("bigint"))).alias("gx"))
    grid = grid.select("clip", "gx", F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(17).cast("bigint"))).alias("gy"))
    return outlines.placement_floor(grid.select("clip", (F.col("gx") * 40).alias("x"), (F.col("gy") * 40).alias("y")), stood, ["clip"]).select("clip", "x", "y")


@query(f"""with {OUTLINES}, q as (select clip, frame, k, (bbox[1] + bbox[3]) / 2.0 / 30 as cx, (bbox[2] + bbox[4]) / 2.0 / 21 as cy from outl where bbox is not null)
select clip, frame, k from q where trunc(cx) between 2 and 45 and trunc(cy) between 2 and 33""")
def on_arena(spark, d):
    """Outlines whose centre, scaled to a small picture, lies on the arena's pixels."""
    b = lambda i: F.get("bbox", F.lit(i))
    q = base.outlines(spark, d).where("bbox is not null").select("clip", "frame", "k", ((b(0) + b(2)) / 2 / 30).alias("cx"), ((b(1) + b(3)) / 2 / 21).alias("cy"))
    arena = pixels(spark).where("arena and frame = 0").select("x", "y")
    return outlines.on_mask(q, "cx", "cy", arena).select("clip", "frame", "k")


@query(f"""with {PLACED} select image_id, array_to_string(list(k order by bbox[4], k), ',') as "order" from placed where bbox[4] is not null group by image_id""")
def draw_order(spark, d):
    """Robots of an image from far to near."""
    out = outlines.draw_order(base.placed(spark, d), ["image_id"], "k", F.get("bbox", F.lit(3)))
    return out.select("image_id", F.array_join(F.transform("order", lambda k: k.cast("string")), ",").alias("order"))


@query(f"""with {PLACED}, s as (select image_id, k, bbox[1] >= 6 and bbox[2] >= 6 and bbox[3] <= 1440 - 7 and bbox[4] <= 762 - 7 as free, visible as fill, (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) / (1440.0 * 762) as size from placed where bbox is not null)
select image_id, k from s where free and fill <= 0.9 and size between 0.006 and 0.12""")
def usable_views(spark, d):
    """Placed robots off the picture's edge, not too full and of a usable size."""
    b = lambda i: F.get("bbox", F.lit(i))
    size = (b(2) - b(0)) * (b(3) - b(1)) / (1440.0 * 762)
    free = (b(0) >= 6) & (b(1) >= 6) & (b(2) <= 1440 - 7) & (b(3) <= 762 - 7)
    return base.placed(spark, d).where(free & (F.col("visible") <= 0.9) & size.between(0.006, 0.12)).select("image_id", "k")


@query("""with v as (select vec_id, embedding::double[] as v from embeddings), m as (select vec_id, v, list_avg(v) as mean from v),
s as (select vec_id, v, mean, sqrt(list_avg([(a - mean) * (a - mean) for a in v])) as spread from m) select vec_id, round((v[1] - mean) / (spread + 1e-9), 6) as first, round(list_max([(a - mean) / (spread + 1e-9) for a in v]), 6) as top from s""")
def signatures(spark, d):
    """Standardised vectors: their first and largest value."""
    from reelgrain.functions.numeric import signature

    e = table(spark, d, "embeddings").select("vec_id", signature(F.col("embedding")).alias("s"))
    return e.select("vec_id", F.round(F.get("s", F.lit(0)), 6).alias("first"), F.round(F.array_max("s"), 6).alias("top"))


@query(f"with {FRAMES} select clip, frame, greatest(1, floor(frame / (300 * 1.5)))::bigint as spacing, least(floor(3 * (frame % 762) / 762), 2)::bigint as bucket, lpad(frame::varchar, 6, '0') as name from held")
def frame_formulas(spark, d):
    """Spacing of kept frames, elevation bucket and padded name of every frame."""
    from reelgrain.functions import numeric, text

    f = base.frames(spark, d, "item_id")
    return f.select("clip", "frame", numeric.spacing(F.col("frame"), F.lit(300), F.lit(1.5)).alias("spacing"), numeric.elevation_bucket(F.col("frame") % 762, F.lit(762)).alias("bucket"), text.padded(F.col("frame"), 6).alias("name"))


@query(f"""with {OUTLINES}, s as (select clip, frame, k, (20 + 0.1::double * 500) / (20 + 0.1::double * bbox[4]) as f, bbox from outl where bbox is not null and bbox[4] > 0)
select clip, frame, k, trunc(700 - (bbox[3] - bbox[1]) * f / 2)::int as x0, trunc(500 - (bbox[4] - bbox[2]) * f)::int as y0, trunc(700 + (bbox[3] - bbox[1]) * f / 2)::int as x1, 500 as y1 from s""")
def slid_outlines(spark, d):
    """Boxes moved to one place and scaled with the width a robot has there."""
    s = base.outlines(spark, d).where("bbox is not null and bbox[3] > 0")
    width = lambda y: 20 + F.lit(0.1) * y
    box = g.moved(F.col("bbox"), F.lit(700.0), F.lit(500.0), width(F.lit(500)) / width(F.get("bbox", F.lit(3))))
    return s.withColumn("b", box).select("clip", "frame", "k", *[F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
