"""Blocks of source lines against the target lines near them, pair by pair inside tasks.

A block holds few lines that lie together; every target that comes near goes to it once.  The source rows of a block come first and its targets stream past
them, so that a task holds one block and one batch, and what is decided by source (how many targets pass, which one is best) needs no shuffle of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.geometry import cell

#: Source lines of a block at most, pairs of legs compared at once, tasks for each core.
BLOCK, COMPARED, TASKS = 256, 1 << 19, 8
#: Boxes may lie this much farther apart (metres), so that rounding loses no pair; distances that differ by less may be the same in millimetres.
SLACK_M, SAME_M = 1e-6, 1e-3
STATES = ("accepted", "ambiguous", "unmatched", "open")
REASONS = ("within-profile", "multiple-targets-within-profile", "distance-outside-tolerance", "bearing-outside-tolerance", "orientation-outside-policy", "shared-length-below-minimum")
ORIENTATIONS = ("same", "reversed", "not-applicable")
MEASURES = ("distance_mm", "bearing_mdeg", "shared_mm", "source_mm", "target_mm", "source_millionths", "target_millionths")


class Rule(NamedTuple):
    tolerance_m: float
    bearing_degrees: float
    least_shared_m: float
    same_direction: bool


def _spread(value: Column) -> Column:
    """The lower 32 bits of a number, each followed by a 0."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def in_blocks(lines: DataFrame, side: float) -> DataFrame:
    """id, x, y, m and block of lines (id, points): runs of lines along a Z-shaped curve through cells of ``side``, each within one tile of 16 by 16 cells.

    The blocks are as the rows lie, so the result must be written before it is used twice.
    """
    whole = lambda c: F.least(F.greatest(F.col(c)[0], F.lit(-1e15)), F.lit(1e15))
    rows = with_lengths(lines).withColumn("cx", cell(whole("x"), side)).withColumn("cy", cell(whole("y"), side))
    low = lambda c: F.col(c).bitwiseAND(F.lit(0x7FFFFFFF))
    rows = rows.withColumn("z", _spread(low("cx")).bitwiseOR(F.shiftleft(_spread(low("cy")), 1)))
    rows = rows.repartitionByRange("z", F.xxhash64("id")).sortWithinPartitions("z")
    return rows.select("id", "x", "y", "m", F.xxhash64(F.shiftright("cx", 4), F.shiftright("cy", 4), F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)).alias("block"))


def with_lengths(lines: DataFrame) -> DataFrame:
    """id, x, y (arrays) and m, the length, of lines (id, points)."""
    return lines.select("id", *[F.col("points")[c].cast("array<double>").alias(c) for c in "xy"], L.length(F.col("points")).alias("m"))


def _cells(rows: DataFrame, key: str, side: float, reach: float) -> DataFrame:
    """Cells that the boxes of a key's legs touch, widened by ``reach``, each once."""
    leg = rows.select(key, F.explode(L.legs(F.arrays_zip("x", "y"))).alias("g")).select(key, "g.*")
    over = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - reach, side), cell(F.greatest(a, b) + reach, side)))
    return leg.withColumn("cx", over("ax", "bx")).withColumn("cy", over("ay", "by")).select(key, "cx", "cy").distinct()


def surely_near(sources: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Ids of sources with a corner in the same small cell as a target's corner, so at most ``radius`` away: most of them where lines are dense."""
    corner = lambda df: df.select("id", F.explode(F.arrays_zip("x", "y")).alias("p")).select("id", cell(F.col("p.x"), radius / 1.5).alias("cx"), cell(F.col("p.y"), radius / 1.5).alias("cy")).distinct()
    return corner(sources).join(corner(targets).select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").select("id").distinct()


def _whole_mm(metres: np.ndarray) -> np.ndarray:
    """``geometry.millimetres`` of many values."""
    m = metres * 1000
    out = np.rint(m)
    for i in np.flatnonzero((np.abs(m) >= 1e9) | (np.abs(m - np.floor(m) - 0.5) <= 2e-3)):
        out[i] = float((Decimal(repr(float(metres[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP) * 1000).quantize(Decimal(1), ROUND_HALF_EVEN))
    return out.astype(np.int64)


class _Lines:
    """Lines of a batch with their legs."""

    def __init__(self, batch: pa.RecordBatch, name: str):
        self.id = batch.column(name)
        x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in "xy")
        n = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.cumsum(n) - 1
        first = last - n + 1
        self.n, self.m = n - 1, batch.column("m").to_numpy(zero_copy_only=False)
        self.mm = _whole_mm(self.m)
        self.start, self.end = (x[first], y[first]), (x[last], y[last])
        self.vector = x[last] - x[first], y[last] - y[first]
        keep = np.ones(len(x), bool)
        keep[last] = False
        a = np.flatnonzero(keep)
        self.line = np.repeat(np.arange(len(n)), self.n)
        self.leg = np.stack([x[a], y[a], x[a + 1], y[a + 1]])
        self.size = np.sqrt((self.leg[2] - self.leg[0]) ** 2 + (self.leg[3] - self.leg[1]) ** 2)
        self.first = np.cumsum(self.n) - self.n
        self.from_m = np.zeros(len(a))
        for k in range(1, int(self.n.max(initial=0))):
            at = self.first[self.n > k] + k
            self.from_m[at] = self.from_m[at - 1] + self.size[at - 1]
        self.box = np.minimum(self.leg[0], self.leg[2]), np.minimum(self.leg[1], self.leg[3]), np.maximum(self.leg[0], self.leg[2]), np.maximum(self.leg[1], self.leg[3])

    def along(self, line: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """``lines.along`` of many points, each on the line beside it."""
        n = self.n[line]
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(len(line)), n)
        leg = np.arange(len(row)) - begin[row] + self.first[line][row]
        ax, ay, bx, by = self.leg[:, leg]
        dx, dy, px, py = bx - ax, by - ay, px[row], py[row]
        square = dx * dx + dy * dy
        with np.errstate(all="ignore"):
            t = np.where(square > 0, np.clip(((px - ax) * dx + (py - ay) * dy) / square, 0.0, 1.0), 0.0)
        ex, ey = px - (ax + t * dx), py - (ay + t * dy)
        d = np.sqrt(ex * ex + ey * ey)
        hit = np.flatnonzero(~(d > np.minimum.reduceat(d, begin)[row])) if len(line) else row
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]] if len(hit) else hit
        return self.from_m[leg[hit]] + t[hit] * self.size[leg[hit]]


def _leg_gaps(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``lines.segment_gap`` of many pairs of legs with a length."""

    def square_to(px, py, ax, ay, bx, by, dx, dy, square):
        f = np.clip(((px - ax) * dx + (py - ay) * dy) / square, 0.0, 1.0)
        ex, ey = px - (ax + f * dx), py - (ay + f * dy)
        return ex * ex + ey * ey

    with np.errstate(all="ignore"):
        (sax, say, sbx, sby), (tax, tay, tbx, tby) = s, t
        sdx, sdy, tdx, tdy = sbx - sax, sby - say, tbx - tax, tby - tay
        ss, tt = sdx * sdx + sdy * sdy, tdx * tdx + tdy * tdy
        out = np.minimum(square_to(sax, say, *t, tdx, tdy, tt), square_to(sbx, sby, *t, tdx, tdy, tt))
        out = np.sqrt(np.minimum(out, np.minimum(square_to(tax, tay, *s, sdx, sdy, ss), square_to(tbx, tby, *s, sdx, sdy, ss))))
        a, b = sdx * (tay - say) - sdy * (tax - sax), sdx * (tby - say) - sdy * (tbx - sax)
        c, d = tdx * (say - tay) - tdy * (sax - tax), tdx * (sby - tay) - tdy * (sbx - tax)
    out[((a < 0) & (b > 0) | (a > 0) & (b < 0)) & ((c < 0) & (d > 0) | (c > 0) & (d < 0))] = 0.0
    return out


class _Block:
    """The sources of a block, and what is known of each so far."""

    def __init__(self, rule: Rule, radius: float, probe: bool):
        self.rule, self.radius, self.probe, self.batches, self.s = rule, radius, probe, [], None

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)

    def ready(self) -> None:
        if self.s is None:
            self.s = _Lines(pa.Table.from_batches(self.batches).combine_chunks().to_batches()[0], "s_id")
            n = len(self.s.id)
            self.passed, self.gap, self.held, self.best = np.zeros(n, np.int64), np.full(n, np.inf), {}, {}
            self.legs = np.flatnonzero(self.s.size > 0)

    def meet(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The rows that are settled by some more targets."""
        self.ready()
        t, r = _Lines(batch, "t_id"), self.radius + SAME_M + SLACK_M
        low, high = [b[self.legs].min(initial=np.inf) - r for b in self.s.box[:2]], [b[self.legs].max(initial=-np.inf) + r for b in self.s.box[2:]]
        legs = np.flatnonzero((t.size > 0) & (t.box[0] <= high[0]) & (t.box[1] <= high[1]) & (t.box[2] >= low[0]) & (t.box[3] >= low[1]))
        # Slices of whole lines, of some legs each or of one line that has more.
        line, step = t.line[legs], max(1, COMPARED // max(1, len(self.legs)))
        begin = 0
        while begin < len(legs) and len(self.legs):
            end = begin + step
            end = len(legs) if end >= len(legs) else int(np.searchsorted(line, line[end]))
            if end <= begin:
                end = int(np.searchsorted(line, line[begin], side="right"))
            yield from self._slice(t, legs[begin:end], r)
            begin = end

    def _slice(self, t: _Lines, legs: np.ndarray, r: float) -> Iterator[pa.RecordBatch]:
        base = int(t.line[legs[0]])
        wide = int(t.line[legs[-1]]) - base + 1
        gap = np.full(len(self.s.id) * wide, np.inf)
        tl, tb, th, tt = (t.box[k][legs] for k in range(4))
        step = max(1, COMPARED // len(legs))
        for k in range(0, len(self.legs), step):
            own = self.legs[k : k + step]
            sl, sb, sh, st = (self.s.box[c][own][:, None] for c in range(4))
            i, j = np.nonzero((tl <= sh + r) & (th >= sl - r) & (tb <= st + r) & (tt >= sb - r))
            i, j = own[i], legs[j]
            np.minimum.at(gap, self.s.line[i] * wide + t.line[j] - base, _leg_gaps(self.s.leg[:, i], t.leg[:, j]))
        found = np.flatnonzero(gap <= self.radius + SAME_M)
        i, j, gap = found // wide, found % wide + base, gap[found]
        np.minimum.at(self.gap, i, gap)
        if self.probe:
            self.legs = self.legs[self.gap[self.s.line[self.legs]] > self.radius]
        elif len(i):
            yield from self._settle(t, i, j, gap)

    def _settle(self, t: _Lines, i: np.ndarray, j: np.ndarray, gap: np.ndarray) -> Iterator[pa.RecordBatch]:
        rule, s = self.rule, self.s
        (sx, sy), (tx, ty) = (v[i] for v in s.vector), (v[j] for v in t.vector)
        distance, dot, norm = _whole_mm(gap), sx * tx + sy * ty, np.sqrt(sx * sx + sy * sy) * np.sqrt(tx * tx + ty * ty)
        with np.errstate(all="ignore"):
            bearing = np.rint(np.where(norm == 0, 180.0, np.degrees(np.arccos(np.minimum(1.0, np.abs(dot) / norm)))) * 1000).astype(np.int64)
        turned = np.where(norm == 0, 2, np.where(dot >= 0, 0, 1))
        failed = np.where(distance > round(rule.tolerance_m * 1000), 2, np.where(bearing > round(rule.bearing_degrees * 1000), 3, np.where((turned == 1) & rule.same_direction, 4, 0)))
        shared = np.zeros(len(i), np.int64)

        def share(k: np.ndarray) -> None:
            a, b = (t.along(j[k], *(c[i[k]] for c in spot)) for spot in (s.end, s.start))
            shared[k] = _whole_mm(np.minimum(np.minimum(s.m[i[k]], np.abs(a - b)), t.m[j[k]]))

        share(np.flatnonzero(failed == 0))
        failed[(failed == 0) & (shared < round(rule.least_shared_m * 1000))] = 5
        part = lambda k, mm: np.rint(np.where(mm > 0, np.minimum(1.0, shared[k] / np.maximum(mm, 1)), 1.0) * 1_000_000).astype(np.int64)

        def rows(k: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
            a, b = s.mm[i[k]], t.mm[j[k]]
            return t.id.take(pa.array(j[k])), [i[k], failed[k], turned[k], distance[k], bearing[k], shared[k], a, b, part(k, a), part(k, b)]

        good = np.flatnonzero(failed == 0)
        count = np.bincount(i[good], minlength=len(s.id))
        self.passed += count
        out = good[self.passed[i[good]] > 1]
        if len(out):
            yield self._batch(1, *rows(out))
        earlier = [self.held.pop(x) for x in [x for x in self.held if self.passed[x] > 1]]
        if earlier:
            yield self._batch(1, *self._joined(earlier))
        alone = good[self.passed[i[good]] == 1]
        for x, row in zip(i[alone].tolist(), self._single(*rows(alone))):
            self.held[x] = row
        for x in [x for x in self.best if self.passed[x]]:
            del self.best[x]
        # The best of those that fail, for sources where none has passed.
        k = np.flatnonzero(self.passed[i] == 0)
        rank = np.empty(len(t.id), np.int64)
        rank[pc.sort_indices(t.id).to_numpy()] = np.arange(len(t.id))
        k = k[np.lexsort((rank[j[k]], bearing[k], distance[k], i[k]))]
        k = k[np.r_[True, i[k][1:] != i[k][:-1]]] if len(k) else k
        share(k)
        for row in self._single(*rows(k)):
            key = (row[1][3], row[1][4], row[0])
            if row[1][0] not in self.best or key < self.best[row[1][0]][0]:
                self.best[row[1][0]] = key, row

    @staticmethod
    def _single(ids: pa.Array, columns: list[np.ndarray]) -> list[tuple]:
        return list(zip(ids.to_pylist(), zip(*[c.tolist() for c in columns]))) if len(ids) else []

    def _joined(self, rows: list[tuple]) -> tuple[pa.Array, list[np.ndarray]]:
        return pa.array([r[0] for r in rows], self.kind), list(np.array([r[1] for r in rows], np.int64).T)

    def _batch(self, state: int, ids: pa.Array, columns: list[np.ndarray]) -> pa.RecordBatch:
        i, reason, turned, *measures = columns
        reason = np.where(reason == 0, 1, reason) if state == 1 else reason
        codes = [pa.array(np.asarray(c, np.int32)) for c in (np.full(len(i), state), reason, turned)]
        return pa.RecordBatch.from_arrays([self.s.id.take(pa.array(i)), ids, *codes, *map(pa.array, measures)], names=["source_id", "target_id", "state", "reason", "orientation", *MEASURES])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is known when no more targets come."""
        self.ready()
        if self.held:
            yield self._batch(0, *self._joined(list(self.held.values())))
        near = self.gap <= self.radius
        best = [row for x, (_, row) in self.best.items() if near[x]]
        if best:
            yield self._batch(2, *self._joined(best))
        left = np.flatnonzero(~near)
        if len(left):
            blank = [np.zeros(len(left), np.int64) for _ in MEASURES]
            yield self._batch(3, pa.nulls(len(left), self.kind), [left, blank[0], blank[0], *blank])


def met(sources: DataFrame, targets: DataFrame, rule: Rule, radius: float, side: float, probe: bool = False) -> DataFrame:
    """Sources with the targets at most ``radius`` away: all that pass, or else the best one; sources without any so near have the state ``open``.

    ``sources``: as ``in_blocks`` gives them, with one row for each id; ``targets``: as ``with_lengths`` does.  With ``probe`` only the open ones are told.
    """
    s_kind, t_kind = (df.schema["id"].dataType.simpleString() for df in (sources, targets))
    side = max(side, radius)
    pairs = _cells(targets, "id", side, 0.0).join(_cells(sources, "block", side, radius + SAME_M + SLACK_M), ["cx", "cy"]).select("block", "id").distinct()
    own = sources.select("block", F.lit(0).alias("kind"), F.col("id").alias("s_id"), F.lit(None).cast(t_kind).alias("t_id"), "x", "y", "m")
    other = pairs.join(targets, "id").select("block", F.lit(1), F.lit(None).cast(s_kind), "id", "x", "y", "m")
    tasks = TASKS * sources.sparkSession.sparkContext.defaultParallelism
    rows = own.union(other).repartition(tasks, "block").sortWithinPartitions("block", "kind")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = None, None
        for batch in batches:
            key, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
            cut = (np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
            for low, high in zip([0, *cut], [*cut, len(key)]) if len(key) else ():
                part = batch.slice(low, high - low)
                if block is None or key[low] != name:
                    if block is not None:
                        yield from block.rest()
                    block, name = _Block(rule, radius, probe), key[low]
                    block.kind = part.column("t_id").type
                if kind[low] == 0:
                    block.add(part)
                else:
                    yield from block.meet(part)
        if block is not None:
            yield from block.rest()

    found = rows.mapInArrow(told, f"source_id {s_kind}, target_id {t_kind}, state int, reason int, orientation int, " + ", ".join(f"{c} long" for c in MEASURES))
    words = lambda c, names: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1).alias(c)
    return found.select("source_id", "target_id", words("state", STATES), words("reason", REASONS), *MEASURES[:2], words("orientation", ORIENTATIONS), *MEASURES[2:])
