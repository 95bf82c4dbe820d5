"""DuckDB SQL for the pN_ queries that SQL can express."""

LATEST_MANIFEST = """
raw as (select lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip, frame, item_id, robots, written_at from manifest
        where clip is not null and frame is not null),
held as (select * from (select *, row_number() over (partition by clip, frame order by written_at desc nulls last,
         [r.bbox for r in robots] desc nulls last, item_id desc) as rn from raw) where rn = 1)"""

_NEAR = " and ".join(f"abs(a[{{i}}][{c}] - b[{{j}}][{c}]) <= 4" for c in (1, 2, 3, 4))


def _pairing(n: int) -> str:
    from itertools import permutations

    return " or ".join("(" + " and ".join(_NEAR.format(i=i + 1, j=j + 1) for i, j in enumerate(p)) + ")" for p in permutations(range(n)))


P1 = f"""
with {LATEST_MANIFEST},
taken as (select clip, frame, [r.bbox for r in robots] as b from held
          where robots is not null and len([r for r in robots if r.bbox is null]) = 0),
prev as (select *, lag(b) over w as a, lag(frame) over w as before from taken window w as (partition by clip order by frame)),
flagged as (select *, coalesce(frame - before <= 60 and len(a) = len(b) and case len(b) when 0 then false
            when 1 then {_pairing(1)} when 2 then {_pairing(2)} when 3 then {_pairing(3)} when 4 then {_pairing(4)} end, false) as goes_on from prev),
numbered as (select *, sum(case when goes_on then 0 else 1 end) over (partition by clip order by frame) as run from flagged)
select clip, min(frame) as first_frame, max(frame) as last_frame{{extra}} from numbered group by clip, run having count(*) >= 2"""

P1_FOUND = P1.format(extra="")
P1_RUNS = P1.format(extra=", count(*)::bigint as n_frames, (max(frame) - min(frame))::bigint as duration, max(len(b))::int as n_outlines")

P2_FOUND = r"""
with img as (select * from (select *, row_number() over (partition by image_id order by written_at desc nulls last) as rn from composed
             where run is not null and image_id is not null) where rn = 1),
each as (select run, unnest([r.source for r in robots]) as source from img),
ent as (select run, lower(regexp_replace(split_part(source, ':', 2), '[\s_-]+', '', 'g')) as robot from each where source is not null),
size as (select r.run, (coalesce(n, 0) // 5) as size from (select distinct run from composed where run is not null) r
         left join (select run, count(*) as n from ent group by run) using (run)),
got as (select run, robot, count(*) as n from ent group by run, robot)
select s.run, t.robot from size s cross join targets t
left join got g on g.run = s.run and g.robot = lower(regexp_replace(t.robot, '[\s_-]+', '', 'g'))
where coalesce(g.n, 0) < greatest(t.min_rows, t.share_pct * s.size // 100)"""

# a robot is drawn as often as its floor asks, or as there are entries
P2_REPORT = (
    P2_FOUND[: P2_FOUND.index("select s.run, t.robot")]
    + r"""select s.run, t.robot, t.share_pct, coalesce(g.n, 0)::bigint as entries, s.size::bigint as size, greatest(t.min_rows, t.share_pct * s.size // 100)::bigint as needed,
greatest(greatest(t.min_rows, t.share_pct * s.size // 100) - coalesce(g.n, 0), 0)::bigint as gap from size s cross join targets t
left join got g on g.run = s.run and g.robot = lower(regexp_replace(t.robot, '[\s_-]+', '', 'g'))"""
)

# groups are such that alikeness is transitive in them; the first is then the smallest alike outline
P3_FOUND = f"""
with {LATEST_MANIFEST},
each as (select item_id, unnest(robots) as r, generate_subscripts(robots, 1) - 1 as k from held),
o as (select item_id, k::int as k, r.area as area, r.bbox[3] - r.bbox[1] as w, r.bbox[4] - r.bbox[2] as h, r.mean as mean from each
      where r.area >= 1 and r.bbox is not null and r.mean is not null),
f as (select b.item_id, b.k, min((a.item_id, a.k)) as first from o a join o b on abs(a.w - b.w) <= 3 and abs(a.h - b.h) <= 3
      and abs(a.mean - b.mean) <= 2.0 and abs(a.area - b.area) <= 0.04 * greatest(a.area, b.area) group by b.item_id, b.k)
select first[1] as first_item_id, first[2] as first_k, item_id, k from f where first <> (item_id, k)"""

P5_FOUND = """
with p as (select distinct row_id, scene, x::double as x, y::double as y, z::double as z from splat_points
           where isfinite(x) and isfinite(y) and isfinite(z) and row_id is not null and scene is not null),
n as (select a.row_id as a, b.row_id as b, row_number() over (partition by a.row_id order by
      sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.row_id) as rn
      from p a join (select distinct row_id from knn_probes) using (row_id) join p b on a.scene = b.scene and a.row_id <> b.row_id)
select distinct least(a, b) as row_id_a, greatest(a, b) as row_id_b from n where rn <= 8"""

P5_NEIGHBOURS = """
with p as (select distinct row_id, scene, x::double as x, y::double as y, z::double as z from splat_points
           where isfinite(x) and isfinite(y) and isfinite(z) and row_id is not null and scene is not null),
d as (select a.row_id as a, b.row_id as b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as d from p a join p b on a.scene = b.scene and a.row_id <> b.row_id),
n as (select *, row_number() over (partition by a order by d, b) as rn from d)
select p.row_id, coalesce(array_to_string(list(b order by rn) filter (where rn <= 8), ','), '') as near, max(d) filter (where rn <= 8) as farthest from p left join n on n.a = p.row_id group by p.row_id"""

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u2011\u3000"
_THIN = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + "\u2010 "
_WORDS = (
    "regexp_extract_all(replace(lower(translate(regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>\n]*>', '', 'g'), "
    f"'[*`\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]', '', 'g'), '{_WIDE}', '{_THIN}')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
)


def _run(way: int, i: str, j: str) -> str:
    """How many words are alike from places i and j on, at most 24, going up or down."""
    return f"coalesce(list_position([coalesce(iw[{i} + {way} * k] = dw[{j} + {way} * k] and {i} + {way} * k > 0 and {j} + {way} * k > 0, false) for k in range(0, 24)], false) - 1, 24)"


# Twelve words in a row are untouched in any match. Every maximal stretch of them is extended to both sides beyond one
# changed, dropped or added word; an edited word at an end counts where the item has it.
_LEAKS = f"""
iw as (select item_id, lang, {_WORDS} as iw from eval_items where item_id is not null and text is not null),
dw as (select doc_id, {_WORDS} as dw from documents where doc_id is not null and text is not null),
ig as (select item_id, unnest(range(1, len(iw) - 10)) as i, iw from iw where len(iw) >= 12), dg as (select doc_id, unnest(range(1, len(dw) - 10)) as j, dw from dw where len(dw) >= 12),
ik as (select item_id, i, array_to_string(iw[i:i + 11], ' ') as g from ig), dk as (select doc_id, j, array_to_string(dw[j:j + 11], ' ') as g from dg),
hit as (select distinct item_id, doc_id, i, j from ik join dk using (g)),
isle as (select item_id, doc_id, j - i as way, i, i - row_number() over (partition by item_id, doc_id, j - i order by i) as isle from hit),
run as (select item_id, doc_id, min(i) as i, min(i) + way as j, max(i) - min(i) + 12 as n from isle group by item_id, doc_id, way, isle),
ext as (select item_id, doc_id, n, iw, dw, i, j from run join iw using (item_id) join dw using (doc_id)),
best as (select item_id, doc_id, n as span from ext
 {' '.join(f"union all select item_id, doc_id, n + case when {_run(1, f'(i + n + {di})', f'(j + n + {dj})')} > 0 then {di} + {_run(1, f'(i + n + {di})', f'(j + n + {dj})')} else (i + n <= len(iw))::int * {di} end from ext union all select item_id, doc_id, n + case when {_run(-1, f'(i - 1 - {di})', f'(j - 1 - {dj})')} > 0 then {di} + {_run(-1, f'(i - 1 - {di})', f'(j - 1 - {dj})')} else (i > 1)::int * {di} end from ext" for di, dj in ((1, 1), (1, 0), (0, 1)))}),
ic as (select item_id, array_to_string(iw, '') as t from iw where lower(trim(coalesce(lang, '')))[1:2] in ('zh', 'ja')), dc as (select doc_id, array_to_string(dw, '') as t from dw),
ict as (select item_id, t, unnest(range(1, len(t) - 42)) as i from ic where len(t) >= 44), dct as (select doc_id, t, unnest(range(1, len(t) - 42)) as i from dc where len(t) >= 44 and regexp_matches(t, '[぀-ヿ㐀-鿿]')),
chars as (select distinct item_id, doc_id from (select item_id, substr(t, i, 44) as g from ict) join (select doc_id, substr(t, i, 44) as g from dct) using (g)),
leak as (select distinct item_id, doc_id from best where span >= 24 union select item_id, doc_id from chars)"""

P7_FOUND = f"with {_LEAKS} select item_id, doc_id from leak"
P7_CLEAN = f"with {_LEAKS} select * from documents d anti join (select distinct doc_id from leak) l on l.doc_id = d.doc_id"

P6_FOUND = r"""
select doc_id from documents where doc_id is not null and text is not null
and len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+')) > 2048"""

P4_FOUND = r"""
with recursive img as (select * from (select *, row_number() over (partition by image_id order by written_at desc nulls last) as rn from composed
             where image_id is not null) where rn = 1),
src as (select image_id, string_split(source, ':') as p from (select image_id, unnest([r.source for r in robots]) as source from img) where source is not null),
named as (select image_id, lower(regexp_replace(string_split(p[4], '/')[-1], '^\s+|\s+$', '', 'g')) as clip,
          try_cast(nullif(regexp_extract(p[5], '([0-9]+)', 1), '') as bigint) as frame from src where len(p) = 5),
uses as (select distinct image_id, clip, frame from named where clip <> '' and frame is not null),
link as (select image_id as a, min(image_id) over (partition by clip, frame) as b from uses),
near as (select distinct a, b from link where a <> b union select distinct b, a from link where a <> b),
reach(a, b) as (select a, b from near union select r.a, n.b from reach r join near n on r.b = n.a)
select min(b) as first_image_id, a as image_id from reach group by a having min(b) < a"""

_UNIT = "(('0x' || substr(md5(concat_ws('|', {}, '11')), 1, 13))::bigint / 4503599627370496::double)"
# Components of more than a two-hundredth of all images go, largest first, where most is missing; the shares still missing
# are the ranges of the others' hashes.
_SPLIT = (
    P4_FOUND[: P4_FOUND.index("select min(b)")]
    + f""", fi as (select min(b) as first, a from reach group by a having min(b) < a),
member as (select image_id, coalesce(first, image_id) as component from img left join fi on fi.a = img.image_id), sized as (select component, count(*) as size from member group by component),
names as (select list(split_name order by share_pct desc, split_name) as nm, list(share_pct order by share_pct desc, split_name) as sh, (select count(*) from member) as total from splits where split_name is not null),
heavy as (select component, size, row_number() over (order by size desc, component) as rn from sized, names where size > greatest(total / 200.0::double, 1)),
h(rn, component, name, want) as (select 0::bigint, null::bigint, null::varchar, [s * total / 100.0::double for s in sh] from names
 union all select heavy.rn, heavy.component, nm[x.i], [case when k = x.i then h.want[k] - heavy.size else h.want[k] end for k in range(1, len(h.want) + 1)]
 from h join heavy on heavy.rn = h.rn + 1, names, lateral (select list_position(h.want, list_max(h.want)) as i) x),
rest as (select [greatest(0.0::double, w) for w in want] as lf from h order by rn desc limit 1),
bounds as (select nm, lf[1] / list_sum(lf) as p1, lf[1] / list_sum(lf) + lf[2] / list_sum(lf) as p2, sh from rest, names),
placed as (select component, coalesce(h.name, case when {_UNIT.format('sized.component')} < p1 then nm[1] when {_UNIT.format('sized.component')} < p2 then nm[2] else nm[3] end) as split_name from sized left join h using (component), bounds)"""
)

P4_IMAGES = f"{_SPLIT} select image_id, component, split_name from member join placed using (component)"
P4_FRAMES = f"""{_SPLIT}, used as (select clip, frame, min(split_name) as used from uses join member using (image_id) join placed using (component) group by clip, frame),
fr as (select distinct lower(regexp_replace(clip, '^\\s+|\\s+$', '', 'g')) as clip, frame from manifest where clip is not null and frame is not null)
select fr.clip, fr.frame, coalesce(used, case when {_UNIT.format('fr.clip, fr.frame')} < sh[1] / 100.0::double then nm[1] when {_UNIT.format('fr.clip, fr.frame')} < sh[1] / 100.0::double + sh[2] / 100.0::double then nm[2] else nm[3] end) as split_name
from fr left join used on used.clip = fr.clip and used.frame = fr.frame, bounds"""
