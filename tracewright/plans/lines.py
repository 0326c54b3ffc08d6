"""Line queries over the driver's tables: embeddings stand in for lines of two legs and for communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as O
from .tables import POINTS_SQL, points, table

TOLERANCE_M, BEARING, SHARED_M, BUFFER_M, EXTENT_M, SIDE_M = 60.0, 50.0, 20.0, 80.0, 300.0, 200.0


def _lines(spark, sf_dir):
    """Every row of embeddings as a line; odd ids are the other side."""
    offset = table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(F.col("embedding")[i].cast("double") * 1000).alias(f"d{i}") for i in range(2, 6)])
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    spots = [(x, y), (x + F.col("d2"), y + F.col("d3")), (x + F.col("d2") + F.col("d4"), y + F.col("d3") + F.col("d5"))]
    rows = points(spark, sf_dir).join(offset, "vec_id")
    return rows.select(F.col("vec_id").alias("id"), F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in spots]).alias("points"))


LINES_SQL = f"""{POINTS_SQL}, base as (select p.vec_id as id, cast(x as double) as x0, cast(y as double) as y0, x + round(cast(embedding[3] as double) * 1000) as x1, y + round(cast(embedding[4] as double) * 1000) as y1,
        round(cast(embedding[5] as double) * 1000) as d4, round(cast(embedding[6] as double) * 1000) as d5 from pts p join embeddings e on e.vec_id = p.vec_id),
    lines as (select id, x0, y0, x1, y1, x1 + d4 as x2, y1 + d5 as y2 from base),
    legs as (select id, 0 as seq, x0 as ax, y0 as ay, x1 as bx, y1 as by, 0.0::double as from_m from lines union all select id, 1, x1, y1, x2, y2, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) from lines),
    sized as (select *, sqrt(pow(legs.bx - legs.ax, 2) + pow(legs.by - legs.ay, 2)) as size from legs)"""


def _sides(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


def line_match(spark, sf_dir):
    sources, targets = _sides(spark, sf_dir)
    return O.match_lines(sources, targets, TOLERANCE_M, BEARING, SHARED_M, side=SIDE_M)


def _hypot(a: str, b: str) -> str:
    return f"sqrt(pow({a}, 2) + pow({b}, 2))"


def _fraction(px: str, py: str, s: str) -> str:
    """Where on leg ``s`` lies nearest to a point, as a fraction of it."""
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.by - {s}.ay)"
    return f"case when {s}.size > 0 then greatest(0.0, least(1.0, (({px} - {s}.ax) * {dx} + ({py} - {s}.ay) * {dy}) / (pow({dx}, 2) + pow({dy}, 2)))) else 0.0 end"


def _to_leg(px: str, py: str, s: str) -> str:
    t = _fraction(px, py, s)
    return _hypot(f"{px} - ({s}.ax + ({t}) * ({s}.bx - {s}.ax))", f"{py} - ({s}.ay + ({t}) * ({s}.by - {s}.ay))")


def _turn(p: str, q: str, r: str) -> str:
    (px, py), (qx, qy), (rx, ry) = ((f"{s[0]}.{s[1]}x", f"{s[0]}.{s[1]}y") for s in (p, q, r))
    return f"sign(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"


_CROSS = f"({_turn('sa', 'sb', 'ta')} * {_turn('sa', 'sb', 'tb')} < 0 and {_turn('ta', 'tb', 'sa')} * {_turn('ta', 'tb', 'sb')} < 0)"
_GAP = f"case when {_CROSS} then 0.0 else least({_to_leg('s.ax', 's.ay', 't')}, {_to_leg('s.bx', 's.by', 't')}, {_to_leg('t.ax', 't.ay', 's')}, {_to_leg('t.bx', 't.by', 's')}) end"
_MM = "cast(round_even(cast({0} as decimal(30, 6)) * 1000, 0) as bigint)".format

MATCH = f"""with {LINES_SQL},
    gaps as (select s.id as source_id, t.id as target_id, min({_GAP}) as gap from sized s join sized t on s.id % 2 = 0 and t.id % 2 = 1 and s.size > 0 and t.size > 0 group by s.id, t.id),
    spots as (select id, 'start' as which, x0 as px, y0 as py from lines union all select id, 'end', x2, y2 from lines),
    near as (select p.id as source_id, p.which, t.id as target_id, t.seq, {_to_leg('p.px', 'p.py', 't')} as d, t.from_m + ({_fraction('p.px', 'p.py', 't')}) * t.size as m from spots p join sized t on p.id % 2 = 0 and t.id % 2 = 1),
    along as (select source_id, which, target_id, arg_min(m, row(d, seq)) as m from near group by source_id, which, target_id),
    spans as (select a.source_id, a.target_id, abs(b.m - a.m) as span from along a join along b on a.source_id = b.source_id and a.target_id = b.target_id and a.which = 'start' and b.which = 'end'),
    whole as (select id, sum(size) as m, any_value(x2 - x0) as vx, any_value(y2 - y0) as vy from sized join lines using (id) group by id),
    raw as (select g.source_id, g.target_id, gap, least(s.m, span, t.m) as shared, s.m as sm, t.m as tm, s.vx * t.vx + s.vy * t.vy as dot, {_hypot('s.vx', 's.vy')} * {_hypot('t.vx', 't.vy')} as norm
        from gaps g join spans using (source_id, target_id) join whole s on s.id = g.source_id join whole t on t.id = g.target_id),
    measured as (select source_id, target_id, {_MM('gap')} as distance_mm, cast(round_even(case when norm = 0 then 180.0 else degrees(acos(least(1.0, abs(dot) / norm))) end * 1000, 0) as bigint) as bearing_mdeg,
        case when norm = 0 then 'not-applicable' when dot >= 0 then 'same' else 'reversed' end as orientation, {_MM('shared')} as shared_mm, {_MM('sm')} as source_mm, {_MM('tm')} as target_mm from raw),
    tested as (select *, cast(round_even(least(1.0, shared_mm / source_mm) * 1000000, 0) as bigint) as source_millionths, cast(round_even(least(1.0, shared_mm / target_mm) * 1000000, 0) as bigint) as target_millionths,
        case when distance_mm > {TOLERANCE_M * 1000:.0f} then 'distance-outside-tolerance' when bearing_mdeg > {BEARING * 1000:.0f} then 'bearing-outside-tolerance'
            when shared_mm < {SHARED_M * 1000:.0f} then 'shared-length-below-minimum' else 'within-profile' end as reason from measured),
    counted as (select *, count(*) filter (where reason = 'within-profile') over (partition by source_id) as n, row_number() over (partition by source_id order by distance_mm, bearing_mdeg, target_id) as k from tested)
    select source_id, target_id, case when n = 0 then 'unmatched' when n = 1 then 'accepted' else 'ambiguous' end as state, case when n > 1 then 'multiple-targets-within-profile' else reason end as reason,
        distance_mm, bearing_mdeg, orientation, shared_mm, source_mm, target_mm, source_millionths, target_millionths from counted where (n = 0 and k = 1) or (n > 0 and reason = 'within-profile')"""


def _discs(spot: str) -> str:
    a, b = "(pow(s.bx - s.ax, 2) + pow(s.by - s.ay, 2))", f"((s.ax - {spot}x) * (s.bx - s.ax) + (s.ay - {spot}y) * (s.by - s.ay))"
    c = f"(pow(s.ax - {spot}x, 2) + pow(s.ay - {spot}y, 2) - pow({{r}}, 2))"
    return f"case when {b} * {b} - {a} * {c} >= 0 then (-{b} {{sign}} sqrt({b} * {b} - {a} * {c})) / {a} end"


def _corridor(r: float) -> str:
    """Stretches of the even lines within ``r`` of the odd ones, leg by leg, as fractions: in a disc, or in the rectangle of a leg."""
    end = lambda spot, sign: _discs(spot).format(r=r, sign=sign)
    return f"""turned as (select s.id, s.seq, s.from_m, s.size, {end('t.a', '-')} as d0, {end('t.a', '+')} as d1, {end('t.b', '-')} as e0, {end('t.b', '+')} as e1, t.size as w,
            ((s.ax - t.ax) * (t.bx - t.ax) + (s.ay - t.ay) * (t.by - t.ay)) / t.size as u0, ((s.bx - s.ax) * (t.bx - t.ax) + (s.by - s.ay) * (t.by - t.ay)) / t.size as u1,
            ((s.ax - t.ax) * (t.by - t.ay) - (s.ay - t.ay) * (t.bx - t.ax)) / t.size as v0, ((s.bx - s.ax) * (t.by - t.ay) - (s.by - s.ay) * (t.bx - t.ax)) / t.size as v1
        from sized s join sized t on s.id % 2 = 0 and t.id % 2 = 1 and s.size > 0 and t.size > 0),
    bands as (select *, case when u1 <> 0 then least(-u0 / u1, (w - u0) / u1) when u0 between 0 and w then -1e18 else 1e18 end as a0, case when u1 <> 0 then greatest(-u0 / u1, (w - u0) / u1) when u0 between 0 and w then 1e18 else -1e18 end as a1,
            case when v1 <> 0 then least((-{r} - v0) / v1, ({r} - v0) / v1) when abs(v0) <= {r} then -1e18 else 1e18 end as b0, case when v1 <> 0 then greatest((-{r} - v0) / v1, ({r} - v0) / v1) when abs(v0) <= {r} then 1e18 else -1e18 end as b1 from turned),
    hulls as (select *, greatest(a0, b0) as r0, least(a1, b1) as r1 from bands),
    found as (select id, from_m, size, greatest(0.0, least(coalesce(d0, 1e18), coalesce(e0, 1e18), case when r0 <= r1 then r0 else 1e18 end)) as t0, least(1.0, greatest(coalesce(d1, -1e18), coalesce(e1, -1e18), case when r0 <= r1 then r1 else -1e18 end)) as t1 from hulls)"""


_MERGE = """stretches as (select distinct id, from_m + t0 * size as a, from_m + t1 * size as b from found where t0 < t1),
    marked as (select *, case when a > max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding) + 1e-9 then 1 else 0 end as new from stretches),
    numbered as (select *, sum(new) over (partition by id order by a, b rows unbounded preceding) as island from marked),
    merged as (select id, island, min(a) as a, max(b) as b from numbered group by id, island)"""


def corridor_share(spark, sf_dir):
    lines, routes = _sides(spark, sf_dir)
    rows = O.corridor_share(lines, routes, BUFFER_M, SIDE_M)
    return rows.select("id", *[F.round(c, 4).alias(c) for c in ("length_m", "inside_m", "share")])


SHARE = f"""with {LINES_SQL}, {_corridor(BUFFER_M)}, {_MERGE}, inside as (select id, sum(b - a) as m from merged group by id), whole as (select id, sum(size) as m from sized where id % 2 = 0 group by id)
    select w.id, round(w.m, 4) as length_m, round(coalesce(i.m, 0.0), 4) as inside_m, round(least(1.0, coalesce(i.m, 0.0) / w.m), 4) as share from whole w left join inside i on i.id = w.id"""


def ncn_marking(spark, sf_dir):
    edges, routes = _sides(spark, sf_dir)
    return O.mark_edges(edges, routes, 20.0, 0.5, SIDE_M).select("id", F.round("share", 4).alias("share"), "marked")


MARKING = f"""with {LINES_SQL}, {_corridor(20.0)}, {_MERGE}, inside as (select id, sum(b - a) as m from merged group by id), whole as (select id, sum(size) as m from sized where id % 2 = 0 group by id)
    select w.id, round(least(1.0, coalesce(i.m, 0.0) / w.m), 4) as share, coalesce(i.m, 0.0) / w.m >= 0.5 as marked from whole w left join inside i on i.id = w.id"""


def scope_split(spark, sf_dir):
    """All lines, split at the extent of the communities of label 0."""
    places = points(spark, sf_dir).where("label = 0").select(F.col("vec_id").alias("id"), "x", "y")
    rows = O.split_scopes(_lines(spark, sf_dir), places, EXTENT_M, side=SIDE_M)
    ends = [(F.round(F.element_at("points", i)[c], 3) + 0.0).alias(f"{name}_{c}") for i, name in ((1, "from"), (-1, "to")) for c in "xy"]
    return rows.select("id", "scope", F.round("start_m", 3).alias("start_m"), F.round("end_m", 3).alias("end_m"), *ends)


SPLIT = f"""with {LINES_SQL}, c as (select vec_id, cast(x as double) as x, cast(y as double) as y from pts where label = 0),
    raw as (select s.id, s.from_m, s.size, {_discs('c.').format(r=EXTENT_M, sign='-')} as d0, {_discs('c.').format(r=EXTENT_M, sign='+')} as d1 from sized s join c on s.size > 0),
    found as (select id, from_m, size, greatest(0.0, d0) as t0, least(1.0, d1) as t1 from raw where d0 is not null), {_MERGE},
    whole as (select id, sum(size) as m from sized group by id),
    gaps as (select id, coalesce(lag(b) over (partition by id order by a), 0.0) as a, a as b from merged union all select w.id, coalesce(max(m2.b), 0.0), w.m from whole w left join merged m2 on m2.id = w.id group by w.id, w.m),
    parts as (select id, 'urban' as scope, a, b from merged union all select id, 'rural', a, b from gaps),
    kept as (select * from parts where b - a > 1e-6),
    spot as (select k.id, k.scope, k.a, k.b, l.x0, l.y0, l.x1, l.y1, l.x2, l.y2, {_hypot('l.x1 - l.x0', 'l.y1 - l.y0')} as m0, {_hypot('l.x2 - l.x1', 'l.y2 - l.y1')} as m1 from kept k join lines l on l.id = k.id)
    select id, scope, round(a, 3) as start_m, round(b, 3) as end_m,
        round(case when a < m0 then x0 + (x1 - x0) * a / m0 else x1 + (x2 - x1) * (a - m0) / m1 end, 3) + 0.0 as from_x, round(case when a < m0 then y0 + (y1 - y0) * a / m0 else y1 + (y2 - y1) * (a - m0) / m1 end, 3) + 0.0 as from_y,
        round(case when b <= m0 then x0 + (x1 - x0) * b / m0 else x1 + (x2 - x1) * (b - m0) / m1 end, 3) + 0.0 as to_x, round(case when b <= m0 then y0 + (y1 - y0) * b / m0 else y1 + (y2 - y1) * (b - m0) / m1 end, 3) + 0.0 as to_y from spot"""

PLANS = {"line_match": (line_match, MATCH), "corridor_share": (corridor_share, SHARE), "ncn_marking": (ncn_marking, MARKING), "scope_split": (scope_split, SPLIT)}
