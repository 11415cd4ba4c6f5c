"""The k most similar vectors of every vector, by collision-counting hashing.

Each vector is projected on ``m`` directions, and per direction the projections form a sorted
array. A query opens a window centred on its own projection in every array; a vector that
lies in at least ``threshold`` of the query's windows collides often enough to be verified by
its exact cosine. Queries whose k-th verified vector is farther than the windows vouch for come
again with windows twice as wide (virtual rehashing), until the windows cover everything.

The directions are the principal axes of a bounded sample: groups are far apart along them,
while near vectors stay near, so few vectors collide by chance. The window widths and the
threshold are those under which nearly all true neighbours of a few hundred probes collide,
and the probes' neighbours are searched among all vectors, so the widths narrow as the
collection becomes denser.

For distribution the arrays are cut into cells of some thousand vectors by planes laid through
gaps: of many directions and places, a plane is taken that few near pairs can straddle. A
vector lives in one cell, and as a query it visits the cells behind every plane that lies
within the span of near pairs, which few do. Where no plane is good (a hot group), the cell's
vectors are dealt over blocks, and each unordered pair of blocks is one task; visitors that are
too many for one task are dealt over blocks too. So each vector moves about as often at any
size of the collection, and no task grows with a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
DIM = 384
SAMPLE = 16_384  # rows the axes and cuts are fitted on
PROBES = 1_024  # of them, whose neighbours among all vectors set widths and threshold
AXES = 32
WITHIN = 0.9  # share of near pairs that one window holds
LOSS = 0.0  # share of the probes' near pairs that may collide less often than the threshold
STRADDLE = 0.001  # share of near pairs farther apart across a plane than the span
VOUCH = 0.98  # share of probes whose k-th neighbour is within the distance that windows vouch for
CELL_ROWS = 8_192
BLOCK_ROWS = 16_384  # of a hot cell; from eight blocks on they grow, up to
BLOCK_MOST = 65_536
COPIES = 8  # of equal vectors, the smallest ids kept as possible neighbours; above k
TILE = 128
TIE = 4e-6  # float32 cosines this near may be equal to 6 places: the rounding and twice the noise


@dataclass
class Leaf:
    """Tasks of one cell: first the pairs i <= j of its data blocks, then, for visitors beyond
    the first ``visitors`` block, each data block once more for each of their blocks."""

    first: int
    blocks: int
    visitors: int

    @property
    def tasks(self) -> int:
        return self.blocks * (self.blocks + 1) // 2 + self.blocks * (self.visitors - 1)

    def pair(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = np.minimum(i, j), np.maximum(i, j)
        return self.first + i * self.blocks - i * (i - 1) // 2 + j - i

    def extra(self, block: np.ndarray, visitor: np.ndarray) -> np.ndarray:
        return self.first + self.blocks * (self.blocks + 1) // 2 + block * (self.visitors - 1) + visitor - 1


@dataclass
class Plan:
    """What is fitted on the sample; its size depends on its parameters only."""

    axes: np.ndarray  # [dim, m]
    width: np.ndarray  # [m] half width of a window at radius 1
    reach: float  # distance that windows of radius 1 vouch for
    threshold: int
    nodes: list[tuple]  # (direction [m], cut, span at radius 1, low side, high side) or (None, number of the leaf)
    leaves: list[Leaf]
    cells: int  # tasks of all leaves

    def route(self, proj: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of each leaf that the row reaches within the spans."""
        out: list[tuple[np.ndarray, int]] = []
        todo = [(0, np.arange(len(proj)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if node[0] is None:
                out.append((rows, node[1]))
                continue
            direction, cut, span, low, high = node
            x = proj[rows] @ direction - cut
            todo.append((low, rows[x - span * radius <= 0]))
            todo.append((high, rows[x + span * radius > 0]))
        rows = np.concatenate([*(r for r, _ in out), np.zeros(0, int)])
        return rows, np.concatenate([*(np.full(len(r), n) for r, n in out), np.zeros(0, int)])

    def tasks(self, proj: np.ndarray, h: np.ndarray, radius: float = 1.0) -> tuple[np.ndarray, ...]:
        """Row, task, block, data, ask: where each row goes as data of which block, and where
        as a query. Its hash ``h`` deals it to its block; equal vectors share all. In the task
        of two blocks these are given as -1 - block, and each asks the other one only."""
        parts: list[tuple] = []

        def put(rows: np.ndarray, task: np.ndarray, block: np.ndarray, data: bool, ask: bool) -> None:
            parts.append((rows, task, block, np.full(len(rows), data), np.full(len(rows), ask)))

        r, home = self.route(proj, 0.0)
        at = np.empty(len(proj), int)
        at[r] = home
        q, seen = self.route(proj, radius)
        away = seen != at[q]
        q, seen = q[away], seen[away]
        for n in np.unique(np.concatenate([home, seen])):
            leaf = self.leaves[n]
            mine, guest = r[home == n], q[seen == n]
            block = h[mine] % leaf.blocks
            visitor = h[guest] // leaf.blocks % leaf.visitors
            for other in range(leaf.blocks):
                put(mine, leaf.pair(block, np.full(len(mine), other)), np.where(block == other, block, -1 - block), True, True)
                o = np.full(len(guest), other)
                put(guest, np.where(visitor == 0, leaf.pair(o, o), leaf.extra(o, visitor)), o, False, True)
            for v in range(1, leaf.visitors):
                put(mine, leaf.extra(block, np.full(len(mine), v)), block, True, False)
        empty = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros(0, bool))
        return tuple(np.concatenate([*c, e]) for c, e in zip(zip(*parts), empty)) if parts else empty


def _blocks(size: float, rows: int) -> int:
    return max(1, int(np.ceil(size / min(max(rows, size / 8), max(rows, BLOCK_MOST)))))


def near_pairs(sample: np.ndarray, k: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probe number, neighbour vectors and cosines of the k nearest of some of the sample
    within the sample itself; for collections that are no larger than the sample."""
    part = np.arange(0, len(sample), max(1, len(sample) // probes))
    near = min(k, len(sample) - 1)
    cos = sample[part] @ sample.T
    cos[np.arange(len(part)), part] = -2
    top = np.argpartition(cos, len(sample) - near, axis=1)[:, len(sample) - near :] if near > 0 else np.zeros((len(part), 0), int)
    return np.repeat(part, near), sample[top.ravel()], np.take_along_axis(cos, top, 1).ravel()


def _gap(z: np.ndarray, apart: np.ndarray) -> tuple[float, np.ndarray, float, float] | None:
    """Share of points within the span of the best plane, its direction, cut and span. Planes
    lie across the main directions of the points and between the means of two halves, at
    any place that leaves a fifth of the points on either side; large halves are preferred."""
    mean = z.mean(0)
    _, vec = np.linalg.eigh((z - mean).T @ (z - mean))
    best = None
    for u in vec.T[::-1][:8]:
        low = z @ u <= np.median(z @ u)
        tried = [u]
        for _ in range(8):
            if low.all() or not low.any():
                break
            a, b = z[low].mean(0), z[~low].mean(0)
            if (length := np.linalg.norm(b - a)) < 1e-9:
                break
            v = (b - a) / length
            moved = z @ v <= (a + b) / 2 @ v
            tried[1:] = [v]
            if (moved == low).all():
                break
            low = moved
        for v in tried:
            span = float(np.quantile(np.abs(apart @ v), 1 - STRADDLE))
            t = np.sort(z @ v)
            i = np.arange(int(0.2 * len(t)), int(0.8 * len(t)))
            i = i[t[i] < t[i + 1]]
            if not len(i):
                continue
            cut = (t[i] + t[i + 1]) / 2
            both = (np.searchsorted(t, cut + span, "right") - np.searchsorted(t, cut - span, "left")) / len(t)
            share = (i + 1) / len(t)
            cost = both / -(share * np.log2(share) + (1 - share) * np.log2(1 - share))
            j = int(np.argmin(cost))
            if best is None or cost[j] < best[0]:
                best = float(cost[j]), float(both[j]), v, float(cut[j]), span
    return best[1:] if best else None


def fit(
    sample: np.ndarray, rows: int, k: int = K, m: int = AXES, threshold: int | None = None, cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS, near: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> Plan:
    """Axes, windows and cuts from the sample of unit vectors; ``rows`` counts all. ``near`` has
    probe numbers in the sample, vectors and cosines of their k nearest among all vectors."""
    n, dim = sample.shape
    m = min(m, dim)
    mean, scatter = sample.mean(0), np.zeros((dim, dim))
    for s in range(0, n, 2048):  # in blocks: the driver's memory stays that of the sample
        centred = (sample[s : s + 2048] - mean).astype(np.float64)
        scatter += centred.T @ centred
    _, vec = np.linalg.eigh(scatter)
    axes = np.ascontiguousarray(vec[:, ::-1][:, :m]).astype(np.float32)
    proj = sample @ axes
    probe, vectors, cos = near if near is not None else near_pairs(sample, k)
    dist = np.sqrt(np.maximum(0, 2 - 2 * cos))
    apart, width, reach = np.zeros((0, m)), np.full(m, 4.0), 2.0
    if len(probe):
        last = np.full(n, -1.0)
        np.maximum.at(last, probe, dist)
        vouched = float(max(1e-3, np.quantile(last[last >= 0], VOUCH)))
        close = (dist <= vouched) & (cos < 0.999)
        if close.sum() > 50:  # otherwise the windows cover everything
            apart, reach = proj[probe[close]] - vectors[close] @ axes, vouched
            width = np.maximum(np.quantile(np.abs(apart), WITHIN, axis=0), 1e-6)
    if threshold is None:
        threshold = int(np.quantile((np.abs(apart) <= width).sum(1), LOSS, method="lower")) if len(apart) else m
    nodes: list[tuple] = []
    sizes: list[float] = []

    def grow(idx: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(())
        size = len(idx) / max(1, n) * rows
        best = _gap(proj[idx].astype(np.float64), apart) if size > cell_rows and len(idx) >= 32 and len(apart) else None
        if best is None or best[0] > 0.5:
            nodes[at] = (None, len(sizes))
            sizes.append(size)
        else:
            _, direction, cut, span = best
            direction = direction.astype(np.float32)
            low = proj[idx] @ direction - cut <= 0
            nodes[at] = (direction, cut, span, grow(idx[low]), grow(idx[~low]))
        return at

    grow(np.arange(n))
    plan = Plan(axes, width.astype(np.float32), reach, min(threshold, m), nodes, [], 0)
    reached = np.bincount(plan.route(proj, 1.0)[1], minlength=len(sizes)) / max(1, n) * rows
    for size, seen in zip(sizes, reached):
        leaf = Leaf(plan.cells, _blocks(size, block_rows), max(1, int(np.ceil((seen - size) / (2 * block_rows)))))
        plan.leaves.append(leaf)
        plan.cells += leaf.tasks
    return plan


def tiles(proj: np.ndarray, size: int = TILE) -> list[np.ndarray]:
    """Row numbers in tiles of at most ``size`` rows that lie close together: halved again and
    again at the median of the axis on which they spread most."""
    done, todo = [], [np.arange(len(proj))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            if len(rows):
                done.append(rows)
            continue
        p = proj[rows]
        j = int(np.argmax(p.max(0) - p.min(0) if len(rows) < 4 * size else p.std(0)))
        half = np.argpartition(p[:, j], len(rows) // 2)
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return done


class Arrays:
    """The sorted arrays of projections of some vectors, one for each axis."""

    def __init__(self, plan: Plan, data: np.ndarray) -> None:
        h = np.ascontiguousarray((data @ plan.axes).T)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, 1)
        self.rank = np.empty(h.shape, np.uint16 if len(data) <= 65_535 else np.uint32)
        np.put_along_axis(self.rank, self.order, np.arange(len(data), dtype=self.rank.dtype)[None, :], 1)

    def collisions(self, centres: np.ndarray, width: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that lie in at least ``threshold`` windows of some of the queries, and which
        of the queries each of these collides with so often: [query, vector].

        A window is a range of ranks in its array, so a vector lies in it if its rank does. The
        ranges of all queries together are counted first; only vectors in enough of those can
        lie in enough windows of one query.
        """
        low, high = centres - width, centres + width
        count = np.zeros(self.rank.shape[1], np.uint8)
        for j, order in enumerate(self.order):
            a, b = np.searchsorted(self.sorted[j], low[:, j].min(), "left"), np.searchsorted(self.sorted[j], high[:, j].max(), "right")
            count[order[a:b]] += 1
        some = np.flatnonzero(count >= threshold)
        hits = np.zeros((len(centres), len(some)), np.uint8)
        if len(some):
            for j in range(len(self.order)):
                a = np.searchsorted(self.sorted[j], low[:, j], "left").astype(self.rank.dtype)
                size = np.searchsorted(self.sorted[j], high[:, j], "right").astype(self.rank.dtype) - a
                hits += self.rank[j, some][None, :] - a[:, None] < size[:, None]  # ranks below the window wrap around
        hits = hits >= threshold
        used = hits.any(0)
        return some[used], hits[:, used]


def search(plan: Plan | None, radius: float, ids: np.ndarray, data: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, data id, cosine of up to k best data rows among those that collide often
    enough with the query. Ties go to the smaller id. An infinite radius verifies every vector.

    Queries are taken in tiles of near ones, whose windows are counted together and whose
    colliding vectors are verified in one matrix product; a vector counts for a query only if
    it collides with this query.
    """
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    everything = plan is None or np.isinf(radius)
    hq = None if everything else q @ plan.axes
    arrays = None if everything else Arrays(plan, data)
    out_q, out_id, out_cos = [], [], []
    for rows in [np.arange(s, min(s + TILE, len(q))) for s in range(0, len(q), TILE)] if everything else tiles(hq):
        qs = q[rows]
        if everything:
            cand, part = np.arange(len(data)), data
            cos = qs @ part.T
        else:
            cand, hits = arrays.collisions(hq[rows], plan.width * radius, plan.threshold)
            part = data[cand]
            cos = np.where(hits, qs @ part.T, np.float32(-2))
        if not len(cand):
            continue
        take = min(k + COPIES + 3, len(cand))
        if take < len(cand):
            top = np.argpartition(cos, len(cand) - take, axis=1)[:, len(cand) - take :]
            edge = np.partition(np.take_along_axis(cos, top, 1), take - min(k, take), axis=1)[:, take - min(k, take)] - np.float32(TIE)
            wide = np.flatnonzero((np.take_along_axis(cos, top, 1).min(1) >= edge) & (edge > -1.5))
        else:
            top = np.broadcast_to(np.arange(take), (len(rows), take))
            wide = np.zeros(0, int)
        exact = np.round(np.einsum("qd,qkd->qk", qs.astype(np.float64), part[top].astype(np.float64)), 6)
        exact = np.where(np.take_along_axis(cos, top, 1) > -1.5, exact, -2.0)
        gid = ids[cand][top]
        rank = np.lexsort((gid, -exact), axis=1)[:, :k]
        near, best = np.take_along_axis(gid, rank, 1), np.take_along_axis(exact, rank, 1)
        if len(wide):  # more than ``take`` may tie at the edge: all that may are compared
            may = np.flatnonzero((cos[wide] >= edge[wide, None]).any(0))
            full = np.rint(qs[wide].astype(np.float64) @ part[may].astype(np.float64).T * 1e6).astype(np.int64)
            full = np.where(cos[wide][:, may] > -1.5, full, -2_000_000)
            place = np.arange(len(may)) - full * len(may)  # by cosine, then by id: ``cand`` is in the order of ids
            first = np.argpartition(place, k - 1, axis=1)[:, :k]
            first = np.take_along_axis(first, np.argsort(np.take_along_axis(place, first, 1), axis=1), 1)
            near[wide], best[wide] = ids[cand[may[first]]], np.take_along_axis(full, first, 1) / 1e6
        met = best.ravel() > -1.5
        out_q.append(np.repeat(rows, rank.shape[1])[met])
        out_id.append(near.ravel()[met])
        out_cos.append(best.ravel()[met])
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_cos)


QUERY_BLOCK = 8_192  # open queries that one blocked pass broadcasts, at most
BROADCAST_DROPS = 500_000  # pairs of an id and a hash: under 32 MB
APPROXIMATION = 1.2  # a k-th neighbour within this times the vouched distance ends a query in the first round; later the distance itself does
FOUND = "vec_id long, near_id long, cos double"


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, encoded_at, h (hash of the embedding), embedding of usable rows: an id and
    ``dim`` finite numbers, not all zero. Other columns are left behind."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == dim) & finite & F.exists(e, lambda x: x != 0)
    at = F.col("encoded_at") if "encoded_at" in vectors.columns else F.lit(None).cast("timestamp")
    return vectors.where(good).select("vec_id", at.alias("encoded_at"), F.xxhash64("embedding").alias("h"), "embedding")


def _unit(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the usable rows in the batch, and their embeddings as unit vectors."""
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    keep, out = np.zeros(len(x), bool), np.empty(x.shape, np.float32)
    for s in range(0, len(x), 2048):
        part = x[s : s + 2048].astype(np.float64)
        keep[s : s + 2048] = good = np.isfinite(part).all(1) & part.any(1)
        part = part[good] / np.abs(part[good]).max(1, keepdims=True)
        out[s : s + 2048][good] = part / np.linalg.norm(part, axis=1, keepdims=True)
    return np.flatnonzero(keep), out[keep]


def _pack(x: np.ndarray) -> pa.Array:
    n, width = x.shape[0], x.shape[1] * 4
    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * width, pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(x))])


def _unpack(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = []
    for c in column.chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.float32)[ends[0] // 4 : ends[-1] // 4])
    return np.concatenate(parts).reshape(-1, dim) if parts else np.zeros((0, dim), np.float32)


def _fetch(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a bounded set of rows, each id once, in the order of ids."""
    t = rows.select("vec_id", "embedding").toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    batch = t.to_batches()[0]
    good, x = _unit(batch, dim)
    ids, first = np.unique(batch.column("vec_id").to_numpy()[good], return_index=True)
    return ids, x[first]


def _route(rows: DataFrame, plan: Plan, dim: int) -> DataFrame:
    """cell, block, data, ask, vec_id, vec: each row where it is data and where it is a query."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            good, x = _unit(b, dim)
            ids = b.column("vec_id").to_numpy()[good]
            h = (b.column("h").to_numpy()[good].astype(np.uint64) >> np.uint64(2)).astype(np.int64)
            take, cell, block, data, ask = plan.tasks(x @ plan.axes, h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(data), pa.array(ask), pa.array(ids[take], pa.int64()), _pack(x[take])],
                ["cell", "block", "data", "ask", "vec_id", "vec"],
            )

    return rows.mapInArrow(run, "cell int, block int, data boolean, ask boolean, vec_id long, vec binary")


def _result(asked: np.ndarray, near: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    other = asked != near
    return pa.RecordBatch.from_arrays([pa.array(asked[other], pa.int64()), pa.array(near[other], pa.int64()), pa.array(cos[other], pa.float64())], ["vec_id", "near_id", "cos"])


def _answers(routed: DataFrame, plan: Plan, k: int, dim: int) -> DataFrame:
    """vec_id, near_id, cos: the k + 1 best of each query in each block it meets."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        ids, blocks, is_data, asks, cells = (table.column(c).to_numpy() for c in ("vec_id", "block", "data", "ask", "cell"))
        x = _unpack(table.column("vec"), dim)
        del table, batches
        for cell in np.unique(cells):
            here = np.flatnonzero(cells == cell)
            here = here[np.argsort(ids[here], kind="stable")]
            here = here[np.r_[True, ids[here][1:] != ids[here][:-1]]]  # a repeated row counts once
            for b in np.unique(blocks[here[is_data[here]]]):
                data = here[is_data[here] & (blocks[here] == b)]
                ask = here[asks[here] & ((b >= 0) | (blocks[here] != b))]
                if len(ask):
                    q, near, cos = search(plan, 1.0, ids[data], x[data], x[ask], k + 1)
                    yield _result(ids[ask[q]], near, cos)

    # one partition a cell: hashing would put several cells into one task and leave others idle
    return routed.repartitionById(plan.cells, F.col("cell")).mapInArrow(run, FOUND)


def _pass(rows: DataFrame, plan: Plan | None, radius: float, ids: np.ndarray, q: np.ndarray, k: int, dim: int) -> DataFrame:
    """The k + 1 best of each partition for a bounded set of queries: a blocked pass over all
    rows, of which those are verified that collide within the radius."""

    def run(batches):
        best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for b in batches:
            if not b.num_rows:
                continue
            good, x = _unit(b, dim)
            new = search(plan, radius, b.column("vec_id").to_numpy()[good], x, q, k + 1)
            a, near, cos = (np.concatenate(p) for p in zip(best, new))
            order = np.lexsort((near, -cos, a))
            a, near, cos = a[order], near[order], cos[order]
            once = np.r_[True, (a[1:] != a[:-1]) | (near[1:] != near[:-1])][: len(a)]
            a, near, cos = a[once], near[once], cos[once]
            place = np.arange(len(a)) - np.searchsorted(a, a, "left")
            best = a[place <= k], near[place <= k], cos[place <= k]
        yield _result(ids[best[0]], best[1], best[2])

    return rows.mapInArrow(run, FOUND).distinct()


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("vec_id").orderBy(F.desc("cos"), "near_id")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def _sampled(base: DataFrame, rows: int, size: int, salt: int) -> DataFrame:
    """About ``size`` rows by a hash of their ids, an eighth more at most."""
    share = int(min(1.0, size / max(1, rows)) * 1_000_000)
    return base.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1_000_000)) < share).limit(size + size // 8)


def most_similar(vectors: DataFrame, k: int = K, dim: int = DIM, sample: int = SAMPLE, approximation: float = APPROXIMATION) -> DataFrame:
    """vec_id, near_id, cos, position: the k most similar other vectors of every usable vector.

    Cosine is rounded to 6 places, ties go to the smaller id. A vec_id counts once: repeated
    rows are one, of different rows the latest by encoded_at counts (then the larger hash). Of
    more than COPIES equal vectors only the smallest ids can be anyone's neighbour; the others
    take the list of the last of these. Null, empty, wrongly sized, non-finite and all-zero
    embeddings are no vectors and come out nowhere. Fewer than k + 1 vectors give shorter
    lists, none give no rows.

    Queries left open by the windows of radius 1 are answered with windows of twice the width,
    and so on, in passes over all vectors by blocks of at most QUERY_BLOCK queries, at any size.
    """
    from spanforge.runtime import broadcast_if_small, cut

    base = usable(vectors, dim)
    seen = cut(base.select("vec_id", "encoded_at", "h").groupBy("vec_id", "h").agg(F.max("encoded_at").alias("at")), "vector-ids")
    won = seen.groupBy("vec_id").agg(F.max(F.struct("at", "h")).alias("w"), F.count("*").alias("n"))
    one = F.col("w.h").alias("h")
    facts = won.agg(F.count("*").alias("ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("lost")).head()
    rows, lost = facts["ids"], facts["lost"]
    winners = won.select("vec_id", one)
    order = Window.partitionBy("h").orderBy("vec_id")
    crowded = winners.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(COPIES, k + 2))
    last = winners.join(crowded.select("h"), "h", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(COPIES, k + 2))
    last = cut(last.groupBy("h").agg(F.max("vec_id").alias("last")), "vector-copies")
    copies = winners.join(last, "h").where("vec_id > last")
    # what is not usable is left out by ``_unit``, without evaluating 384 elements a row in each scan
    base = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim)).select("vec_id", F.xxhash64("embedding").alias("h"), "embedding")
    dropped = copies.select("vec_id", "h")
    if lost:
        dropped = dropped.unionByName(seen.join(winners, ["vec_id", "h"], "left_anti").select("vec_id", "h"))
    drops = dropped.count()
    if drops:
        base = base.join(broadcast_if_small(dropped, drops, BROADCAST_DROPS), ["vec_id", "h"], "left_anti")
    rows -= drops

    sample_ids, picked = _fetch(_sampled(base, rows, sample, 17), dim)
    if not len(picked):
        sample_ids, picked = _fetch(base.limit(sample), dim)
    probes = np.sort(np.random.default_rng(11).permutation(len(picked))[:PROBES])
    near = None
    if len(picked) and rows > 1:
        pairs_ = _best(_pass(base, None, float("inf"), sample_ids[probes], picked[probes], k, dim), k).select("vec_id", "near_id", "cos").toArrow()
        near_ids = pairs_.column("near_id").to_numpy()
        wanted = vectors.sparkSession.createDataFrame(pa.table({"vec_id": np.unique(near_ids)}))  # at most PROBES * k
        ids_, vectors_ = _fetch(base.join(F.broadcast(wanted), "vec_id", "left_semi"), dim)
        near = np.searchsorted(sample_ids, pairs_.column("vec_id").to_numpy()), vectors_[np.searchsorted(ids_, near_ids)], pairs_.column("cos").to_numpy()
    plan = fit(picked if len(picked) else np.eye(dim, dtype=np.float32)[:1], rows, k, near=near)

    full = min(k, max(0, rows - 1))  # length of a list

    def closed(found: DataFrame, radius: float) -> DataFrame:
        far = float(1 - ((approximation if radius == 1 else 1.0) * radius * plan.reach) ** 2 / 2)
        return found.where((F.col("position") == full) & (F.col("cos") >= far)).select("vec_id")

    found = cut(_best(_answers(_route(base, plan, dim), plan, k, dim), k), "neighbours")
    result, radius, widest = found, 1.0, float(np.max(4.0 / plan.width))
    everyone = winners.select("vec_id").join(copies.select("vec_id"), "vec_id", "left_anti")
    open_ids = cut(everyone.join(closed(found, radius), "vec_id", "left_anti"), "open-queries")
    while full and radius <= widest and (count := open_ids.count()):
        radius *= 2.0
        blocks = -(-count * 9 // (8 * QUERY_BLOCK))
        again = None
        for block in range(blocks):
            mine = open_ids.where(F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(blocks)) == block)
            ids_, q = _fetch(base.join(F.broadcast(mine), "vec_id", "left_semi"), dim)
            if len(ids_):
                part = cut(_best(_pass(base, plan, radius if radius <= widest else float("inf"), ids_, q, k, dim), k), "neighbours")
                again = part if again is None else again.unionByName(part)
        if again is None:
            break
        # a later round has all of its queries' neighbours
        result = result.join(again.select("vec_id").distinct(), "vec_id", "left_anti").unionByName(again)
        open_ids = cut(open_ids.join(closed(again, radius), "vec_id", "left_anti"), "open-queries")
    if drops:
        inherited = copies.join(result.withColumnRenamed("vec_id", "last"), "last").select("vec_id", "near_id", "cos", "position")
        result = result.unionByName(inherited)
    return result


def pairs(neighbours: DataFrame) -> DataFrame:
    """vec_id_a < vec_id_b: each unordered pair of which one is in the other's list."""
    return neighbours.select(F.least("vec_id", "near_id").alias("vec_id_a"), F.greatest("vec_id", "near_id").alias("vec_id_b")).distinct()
