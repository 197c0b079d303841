"""The k most similar vectors of every vector, by score-aware quantisation and exact reranking.

Vectors are parted into cells of about CELL rows by k-means. A vector is stored in the cell of its nearest centroid, as its original
numbers and as a four-bit code of its residual: 32 subspaces of 2 dimensions with 16 entries each. Codebooks and codes minimise the
anisotropic loss, which weighs the error parallel to the vector more than the error across it, because that is what changes
the largest inner products. A query visits the cells whose centroids are nearest by angle. There the table scores of all codes
(query times codebook entry, summed over subspaces; numpy sums them as one matrix product with the decoded entries, which
gives the same numbers) rule out what can't be among the k best: a score is off by at most the length of the code's error, as the
query has length one. The rest is ranked by the exact cosine in double precision, rounded to 9 decimals, ties to the smaller id.

Cells. Up to SAMPLE/10 cells are fitted on the driver, on a sample of at most SAMPLE vectors. More are made in two levels: COARSE
cells from that sample, and within each its share of the leaves, fitted on the executors on a sample of at most LEAF_SAMPLE vectors a
coarse cell. So the number of cells stays in proportion to the vectors up to MOST_CELLS (134 million vectors at 512 a cell), which
bounds what is broadcast (256 bytes a cell of 64 dimensions). A crowd of vectors that differ by little gets leaves by its share.

Plan. Rows are exchanged by (cell, block) and every block is one matrix problem of at most about BLOCK stored vectors and BLOCK
queries: a cell that the sample shows to be larger is dealt out over a grid of stored and query blocks, so no task gathers an
unbounded group. Per query at most k rows per visited block are exchanged to find the k best overall. The driver sees the samples
and the centroids only.

Of exact copies only the k+1 smallest ids are stored as candidates: ties go to smaller ids, so others can't be among anyone's
k best. The limit holds before and after the exchange, so a vector that a third of all rows share is no large group. All copies are
queries.

Defined results: only vectors of dim finite numbers, not all zero, take part; of rows with the same id each vector is compared, equal
ones once, and never with one another; a collection of one has no pairs; fewer than k others give fewer rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 40_000
CELL = 512
BLOCK = 8192
COARSE = 512
LEAF_SAMPLE = 65_536
MOST_CELLS = 262_144
#: Coarse cells among whose leaves a vector looks for its cells.
COARSE_PROBES = 12
SUBSPACES = 32
ENTRIES = 16
#: Weight of the error parallel to a vector against the error across it.
PARALLEL = 4.0


def usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        norm = np.linalg.norm(new, axis=1)
        lost = np.flatnonzero(norm < 1e-9)
        new[lost] = x[rng.integers(0, len(x), len(lost))]
        norm[lost] = 1.0
        c = (new / norm[:, None]).astype(x.dtype)
    return c


class Quantiser:
    """Four-bit codes of residuals, fitted and assigned under the anisotropic loss."""

    def __init__(self, dim: int, subspaces: int = SUBSPACES, parallel: float = PARALLEL):
        self.dim, self.m, self.parallel = dim, subspaces, parallel
        self.width = -(-dim // subspaces)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        pad = self.m * self.width - self.dim
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), self.m, self.width)

    def fit(self, r: np.ndarray, x: np.ndarray, rounds: int = 4, seed: int = 3) -> Quantiser:
        """r: residuals, x: the unit vectors they belong to (their directions)."""
        rng = np.random.default_rng(seed)
        parts = self._parts(r)
        self.books = parts[rng.permutation(len(r))[:ENTRIES]].transpose(1, 0, 2).copy() if len(r) >= ENTRIES else np.pad(parts.transpose(1, 0, 2), ((0, 0), (0, ENTRIES - len(r)), (0, 0)))
        for _ in range(6):
            codes = self._nearest(parts)
            for m in range(self.m):
                for e in range(ENTRIES):
                    mine = codes[:, m] == e
                    if mine.any():
                        self.books[m, e] = parts[mine, m].mean(axis=0)
        w = self.parallel - 1.0
        dirs = self._parts(x)
        for _ in range(rounds):
            codes = self.codes(r, x)
            left = parts - self._entries(codes)
            along = np.einsum("nmw,nmw->nm", left, dirs)
            total = along.sum(axis=1)
            for m in range(self.m):
                d, p = dirs[:, m], parts[:, m]
                a = total - along[:, m] + np.einsum("nw,nw->n", p, d)
                for e in range(ENTRIES):
                    mine = codes[:, m] == e
                    if mine.sum() > self.width:
                        dm = d[mine]
                        lhs = mine.sum() * np.eye(self.width) + w * dm.T @ dm
                        rhs = p[mine].sum(axis=0) + w * (a[mine, None] * dm).sum(axis=0)
                        self.books[m, e] = np.linalg.solve(lhs, rhs)
        return self

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        d = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2).astype(np.uint8)

    def _entries(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.m)[None], codes]

    def codes(self, r: np.ndarray, x: np.ndarray, rounds: int = 1) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest entries."""
        parts, dirs, w = self._parts(r), self._parts(x), self.parallel - 1.0
        codes = self._nearest(parts)
        total = np.einsum("nmw,nmw->n", parts - self._entries(codes), dirs)
        for _ in range(rounds):
            for m in range(self.m):
                left = parts[:, m, None, :] - self.books[None, m]
                along = np.einsum("new,nw->ne", left, dirs[:, m])
                other = total - along[np.arange(len(r)), codes[:, m]]
                best = ((left**2).sum(axis=2) + w * (other[:, None] + along) ** 2).argmin(axis=1)
                codes[:, m] = best
                total = other + along[np.arange(len(r)), best]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self._entries(codes).reshape(len(codes), -1)[:, : self.dim]


def pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(column), dim)


def _as_binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _from_binary(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of width numbers from a binary column without nulls."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(dtype).reshape(-1, width) if len(column) else np.zeros((0, width), dtype)


def _top(s: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest of each row, in no order."""
    return np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)


class Cells:
    """Centroids of cells, in one level or as leaves of coarse cells, and over how many blocks each cell is dealt out."""

    def __init__(self, leaves: np.ndarray, coarse: np.ndarray | None = None, first: np.ndarray | None = None):
        self.leaves, self.coarse, self.first = leaves, coarse, first
        self.stored_blocks = self.query_blocks = np.ones(len(leaves), np.int64)

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n cells nearest to each vector, nearest first, with their inner products; -2 where there are fewer."""
        n = min(n, len(self.leaves))
        if self.coarse is None:
            s = x @ self.leaves.T
            at = _top(s, n)
            by = np.take_along_axis(s, at, axis=1)
        else:
            around = _top(x @ self.coarse.T, min(COARSE_PROBES, len(self.coarse)))
            at = np.zeros((len(x), around.shape[1] * n), np.int64)
            by = np.full(at.shape, -2.0, np.float32)
            for j in range(around.shape[1]):
                order = np.argsort(around[:, j], kind="stable")
                edges = np.flatnonzero(np.diff(around[order, j], prepend=-1))
                for a, z in zip(edges, [*edges[1:], len(order)]):
                    rows, c = order[a:z], around[order[a], j]
                    s = x[rows] @ self.leaves[self.first[c] : self.first[c + 1]].T
                    m = min(n, s.shape[1])
                    best = _top(s, m)
                    at[rows, j * n : j * n + m] = best + self.first[c]
                    by[rows, j * n : j * n + m] = np.take_along_axis(s, best, axis=1)
            best = _top(by, n)
            at, by = np.take_along_axis(at, best, axis=1), np.take_along_axis(by, best, axis=1)
        order = np.argsort(-by, axis=1, kind="stable")
        return np.take_along_axis(at, order, axis=1), np.take_along_axis(by, order, axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.nearest(x[i : i + 4096], 1)[0][:, 0] for i in range(0, len(x), 4096)])

    def visited(self, x: np.ndarray, probes: int, max_angle: float) -> tuple[np.ndarray, np.ndarray]:
        """Cells a query visits, nearest first, and which of them are near enough."""
        near, by = self.nearest(x, probes)
        c, s = np.cos(np.radians(max_angle)), np.sin(np.radians(max_angle))
        top = np.clip(by[:, :1], -1, 1)
        return near, by >= np.maximum(top * c - np.sqrt(1 - top**2) * s, -1.5)

    def deal(self, sample: np.ndarray, asks: np.ndarray, rate: float, probes: int, max_angle: float, block: int) -> None:
        """Sets the blocks of cells from a sample of the given rate: equal vectors are stored once."""
        n = len(self.leaves)
        distinct = np.unique(sample, axis=0)
        stored = np.bincount(self.home(distinct), minlength=n) / rate
        asked = np.zeros(n)
        for i in range(0, int(asks.sum()), 4096):
            near, on = self.visited(sample[asks][i : i + 4096], probes, max_angle)
            asked += np.bincount(near[on], minlength=n) / rate
        self.stored_blocks = np.maximum(1, np.ceil(stored / block)).astype(np.int64)
        self.query_blocks = np.maximum(1, np.ceil(asked / block)).astype(np.int64)


def fitted_cells(base: DataFrame, sample: np.ndarray, n: float, dim: int, cell: int, coarse: int, most: int = MOST_CELLS, leaf_sample: int = LEAF_SAMPLE) -> Cells:
    """Cells for about n vectors: on the driver while the sample allows for enough of them, else in two levels."""
    wanted = int(max(1, min(n // cell or 1, most)))
    if wanted <= len(sample) // 10 or wanted <= coarse:
        return Cells(kmeans(sample, max(1, min(wanted, len(sample) // 10 or 1))))
    tops = kmeans(sample, min(coarse, len(sample) // 10))
    share = np.bincount(np.concatenate([np.argmax(sample[i : i + 8192] @ tops.T, axis=1) for i in range(0, len(sample), 8192)]), minlength=len(tops)) / len(sample)
    leaves = np.maximum(1, np.round(share * wanted)).astype(int)
    # rows drawn of each coarse cell: enough for its leaves, and no more than a task holds
    rate = np.minimum(1.0, np.minimum(64.0 * leaves, leaf_sample) / np.maximum(share * n, 1.0))
    sent = base.sparkSession.sparkContext.broadcast((tops, rate))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, r = sent.value
        for b in batches:
            x = _unit(_matrix(b.column(1), dim)).astype(np.float32)
            at = np.argmax(x @ c.T, axis=1)
            draw = ((b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) / 2.0**32
            keep = np.flatnonzero(draw < r[at])
            yield pa.RecordBatch.from_arrays([pa.array(at[keep].astype(np.int64)), _as_binary(x[keep])], names=["coarse", "vec"])

    def trained(key: tuple, t: pa.Table) -> pa.Table:
        c = key[0].as_py()
        x = _from_binary(t.column("vec").combine_chunks(), np.float32, dim)
        k = max(1, min(int(leaves[c]), len(x) // 4 or 1))
        return pa.table({"coarse": pa.array([c] * k, pa.int64()), "vec": _as_binary(kmeans(x, k, rounds=6))})

    found = base.mapInArrow(parted, "coarse long, vec binary").groupBy("coarse").applyInArrow(trained, "coarse long, vec binary").toArrow().combine_chunks()
    at, vec = found.column("coarse").to_numpy(), _from_binary(found.column("vec").combine_chunks() if isinstance(found.column("vec"), pa.ChunkedArray) else found.column("vec"), np.float32, dim)
    # a coarse cell that no drawn row fell into keeps its own centroid
    none = np.setdiff1d(np.arange(len(tops)), at)
    at, vec = np.concatenate([at, none]), np.concatenate([vec, tops[none]])
    order = np.argsort(at, kind="stable")
    return Cells(vec[order], tops, np.searchsorted(at[order], np.arange(len(tops) + 1)))


def exact_best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, approx: np.ndarray, slack: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of x for each q by exact cosine, among those that the table scores don't rule out."""
    low = approx - slack[None]
    n = min(k + 1, x.shape[0])  # one more: a query may meet itself
    kth = np.partition(low, x.shape[0] - n, axis=1)[:, x.shape[0] - n]
    row, col = np.nonzero(approx + slack[None] >= np.maximum(kth, least)[:, None])
    other = q_ids[row] != x_ids[col]
    row, col = row[other], col[other]
    cos = np.empty(len(row))
    for i in range(0, len(row), 20_000):  # bounds the gathered copies
        cos[i : i + 20_000] = np.einsum("ij,ij->i", q[row[i : i + 20_000]], x[col[i : i + 20_000]])
    cos = np.round(cos, 9)
    if least > -1:
        row, col, cos = (v[cos >= least] for v in (row, col, cos))
    order = np.lexsort((x_ids[col], -cos, row))
    row, col, cos = row[order], col[order], cos[order]
    first = np.searchsorted(row, row, side="left")
    kept = np.arange(len(row)) - first < k
    return q_ids[row[kept]], x_ids[col[kept]], cos[kept]


def nearest(
    rows: DataFrame,
    id_col: str = "id",
    vector: str = "embedding",
    dim: int = 64,
    k: int = 10,
    min_cosine: float = -1.0,
    probes: int = 8,
    max_angle: float = 20.0,
    queries: Column | None = None,
    sample: int = SAMPLE,
    cell: int = CELL,
    block: int = BLOCK,
    coarse: int = COARSE,
) -> DataFrame:
    """(id, other, cosine): the k most similar others of each vector (of those where queries holds), of cosine min_cosine at least.

    probes: cells that a query visits at most; max_angle: by how many degrees they may be farther than the nearest cell.
    """
    spark = rows.sparkSession
    total = rows.count()
    base = rows.where(usable(F.col(vector), dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"), F.coalesce(queries if queries is not None else F.lit(True), F.lit(False)).alias("asks"))
    rate = min(1.0, 0.9 * sample / max(total, 1))
    drawn = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20)) if rate < 1 else F.lit(True)).limit(sample).toArrow().combine_chunks()
    if not drawn.num_rows:
        return spark.createDataFrame([], "id long, other long, cosine double")
    column = lambda i: (c := drawn.column(i)).combine_chunks() if isinstance(drawn.column(i), pa.ChunkedArray) else c
    fit, asks = _unit(_matrix(column(1), dim)).astype(np.float32), column(2).to_numpy(zero_copy_only=False).astype(bool)
    cells = fitted_cells(base, fit, drawn.num_rows / rate, dim, cell, coarse)
    cells.deal(fit, asks, rate, probes, max_angle, block)
    part = np.random.default_rng(1).permutation(len(fit))[:8000]
    quantiser = Quantiser(dim).fit((fit[part] - cells.leaves[cells.home(fit[part])]).astype(np.float64), fit[part].astype(np.float64))
    model = spark.sparkContext.broadcast((cells, quantiser))
    placed = "cell long, block long, kind byte, id long, vec binary, code binary"
    names = ["cell", "block", "kind", "id", "vec", "code"]

    def salt(ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its cell with its code, once for each block of the cell's queries."""
        own, quant = model.value
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                ids, raw = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                x = _unit(raw)
                home = own.home(x.astype(np.float32))
                code = pack(quant.codes(x - own.leaves[home], x))
                times = own.query_blocks[home]
                at = np.repeat(np.arange(len(x)), times)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                part = salt(ids) % own.stored_blocks[home]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(home[at]), pa.array(part[at] * times[at] + nth), pa.array(np.zeros(len(at), np.int8)), pa.array(ids[at]), _as_binary(raw).take(take), _as_binary(code).take(take)], names=names)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query in the cells that it visits, once for each block of what is stored there."""
        own, _ = model.value
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                ids, raw = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                near, on = own.visited(_unit(raw).astype(np.float32), probes, max_angle)
                q, j = np.nonzero(on)
                cell_of = near[q, j]
                times = own.stored_blocks[cell_of]
                at = np.repeat(np.arange(len(q)), times)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                q, cell_of = q[at], cell_of[at]
                blocks = nth * own.query_blocks[cell_of] + salt(ids[q]) % own.query_blocks[cell_of]
                yield pa.RecordBatch.from_arrays([pa.array(cell_of), pa.array(blocks), pa.array(np.ones(len(q), np.int8)), pa.array(ids[q]), _as_binary(raw).take(pa.array(q)), pa.nulls(len(q), pa.binary())], names=names)

    # equal vectors meet by two hashes of 64 bits
    copies = Window.partitionBy("h1", "h2").orderBy("id")
    first = base.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")).withColumn("__n", F.dense_rank().over(copies)).where(F.col("__n") <= k + 1).select("id", "vec")
    both = first.mapInArrow(stored, placed).unionByName(base.where("asks").select("id", "vec").mapInArrow(asking, placed))
    both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, quant = model.value
        key, stored_ids, stored_vec, stored_code = None, [], [], []
        ready = None

        def build():
            ids = np.concatenate(stored_ids)
            vec = np.concatenate(stored_vec)
            _, first = np.unique(np.concatenate([ids[:, None], vec.view(np.int32)], axis=1), axis=0, return_index=True)
            first = first[np.argsort(ids[first], kind="stable")]
            x = _unit(vec[first])
            approx = (own.leaves[key[0]] + quant.decode(unpack(np.concatenate(stored_code)[first]))).astype(np.float32)
            slack = (np.linalg.norm(x - approx, axis=1) + 1e-6).astype(np.float32)
            return ids[first], x, approx, slack

        for b in batches:
            cells_, blocks_, kinds = (b.column(i).to_numpy() for i in range(3))
            ids = b.column(3).to_numpy()
            edge = np.flatnonzero((np.diff(cells_) != 0) | (np.diff(blocks_) != 0) | (np.diff(kinds) != 0)) + 1
            found = []
            for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(cells_)]):
                if a == z:
                    continue
                if key != (cells_[a], blocks_[a]):
                    key, stored_ids, stored_vec, stored_code, ready = (cells_[a], blocks_[a]), [], [], [], None
                raw = _from_binary(b.column(4).slice(a, z - a), np.float32, dim)
                if kinds[a] == 0:
                    stored_ids.append(ids[a:z].copy())
                    stored_vec.append(raw.copy())
                    stored_code.append(_from_binary(b.column(5).slice(a, z - a), np.uint8, -(-quant.m // 2)).copy())
                    continue
                if not stored_ids:
                    continue
                if ready is None:
                    ready = build()
                x_ids, x, approx, slack = ready
                q = _unit(raw)
                step = max(16, 1_000_000 // max(1, len(x)))
                for i in range(0, len(q), step):
                    found.append(exact_best(q[i : i + step], ids[a + i : min(z, a + i + step)], x, x_ids, q[i : i + step].astype(np.float32) @ approx.T, slack, k, min_cosine))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[j] for f in found])) for j in range(3)], names=["id", "other", "cosine"])

    pairs = both.mapInArrow(searched, "id long, other long, cosine double")
    by = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    # a query that came twice may give a pair twice
    pairs = pairs.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    return pairs.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= k).drop("__n")


def similar_pairs(rows: DataFrame, min_cosine: float = 0.9, k: int = 10, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of min_cosine at least where one is among the k most similar others of the other."""
    found = nearest(rows, k=k, min_cosine=min_cosine, **options)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
