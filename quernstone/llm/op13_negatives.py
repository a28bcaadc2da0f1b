"""Hard negatives by a pivot table.

Vectors of integers are augmented by one component that brings all of them to the largest norm M, anchors by a zero. The distance of
an anchor q to an augmented vector x then says what their inner product is: 2<q, x> = |q|^2 + M^2 - d(q, x)^2. Distances of all vectors to a few
pivots are stored; by the triangle inequality the differences and sums of two stored distances bracket d, and so the inner
product. A vector whose bracket misses the scores that an anchor can still use is never multiplied; of the others the exact product decides.

Vectors are stored in order of their nearest pivot and the distance to it, in ranges that split a vector of any number of copies by id. So a
batch of them has narrow ranges of distances, which rule out whole batches for an anchor before single vectors are looked at. What an anchor can still use
starts from its best scores among the sample that the pivots are taken from, and rises with each batch.

Anchors go out in chunks of at most about ANCHORS, or fewer of many components, each broadcast to all tasks in turn: the memory of a worker and
of the driver depends on the chunk, not on the number of anchors. A task keeps the few best rows of each anchor and band and returns
these; a window joins them. Results are exact: pivots and sample (documented bounds PIVOTS and SAMPLE) only change what is multiplied.

Defined results: rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part; of rows of one id the one of the smallest (label,
vector) does; a shorter vector counts as if zeros followed, an empty one as zeros; components beyond 2^24 after scaling count as 2^24, so
that sums of up to 16,384 products stay integers of 64 bits; a positive of a negative score has no negatives; an anchor alone in its label has no rows; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm._common import first_by_hash, materialise, scratch_path, tune

PIVOTS, SAMPLE = 16, 2048
#: Anchors of a chunk, and components of all anchors of a chunk (8 bytes each).
ANCHORS, CHUNK_COMPONENTS = 8192, 4 << 20
#: Anchors whose brackets with a batch are held at once.
TOGETHER = 512
#: Largest component after scaling.
MOST = 1 << 24
#: Pairs that wait to be cut to the best of each band.
PENDING = 1 << 15

_NONE = np.int64(1) << np.int64(62)
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(rows: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): the rows that take part, one for each id; v has floor(scale * x) for each component x."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.greatest(F.lit(-MOST).cast("bigint"), F.least(F.lit(MOST).cast("bigint"), F.floor(F.lit(float(scale)) * e.cast("double")))))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~bad)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")


@dataclass
class Pivots:
    """Augmented pivots and the square of the norm that vectors are brought to."""

    at: np.ndarray
    square: float

    @classmethod
    def of(cls, sample: np.ndarray, square: float, most: int = PIVOTS) -> Pivots:
        """Each pivot is the vector of the sample that lies farthest from the pivots before it."""
        long = augmented(sample, square)
        chosen, least = [0], np.full(len(long), np.inf)
        while len(chosen) < min(most, len(long)):
            least = np.minimum(least, ((long - long[chosen[-1]]) ** 2).sum(1))
            if least.max() <= 0:
                break
            chosen.append(int(least.argmax()))
        return cls(long[chosen], square)

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Of augmented vectors to each pivot; all of them have the same norm."""
        return np.sqrt(np.maximum(2 * (self.square - augmented(v, self.square) @ self.at.T), 0))

    def anchor_distances(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.square - 2 * q @ self.at[:, :-1].T, 0))


def augmented(v: np.ndarray, square: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(square - (v * v).sum(1), 0))[:, None]], axis=1)


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of each group with the highest scores, ties by smaller id, group by group."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    first = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - first < k]


@dataclass
class Search:
    """Anchors and, for each, bands of scores from low to high of which the k best rows are wanted; rows of the anchor's label or of others."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    pivots: Pivots
    low: np.ndarray
    high: np.ndarray
    k: int
    same_label: bool
    exact_in_doubles: bool

    def __post_init__(self):
        self.d = self.pivots.anchor_distances(self.q)
        self.square = (self.q * self.q).sum(1) + self.pivots.square
        self.found = [np.zeros(0, np.int64)] * 3
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.multiplied = self.compared = 0

    def bracket(self, near: np.ndarray, far: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products at the least and the greatest, by the greatest and the least distance; with room for rounding."""
        room = 1e-9 * square + 1e-6
        return (square - far * far) / 2 - room, (square - near * near) / 2 + room

    def start(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """Raises the bands' low ends to what a sample of the table has; its rows are found again in the table itself."""
        self.offer(ids, labels, v, self.pivots.distances(v))
        self.settle()
        self.found, self.multiplied, self.compared = [np.zeros(0, np.int64)] * 3, 0, 0

    def offer(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        """Takes a batch of vectors with their distances to the pivots."""
        if not len(ids) or not len(self.ids):
            return
        least, most = d.min(0), d.max(0)
        near = np.maximum(np.maximum(self.d - most, least - self.d), 0).max(1)
        far = (self.d + most).min(1)
        lo, hi = self.bracket(near, far, self.square)
        alive = np.flatnonzero((hi >= self.low.min(1)) & (lo <= self.high.max(1)))
        for i in range(0, len(alive), TOGETHER):
            self._rows(alive[i : i + TOGETHER], ids, labels, v, d)

    def _rows(self, a: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        near, far = np.zeros((len(a), len(ids))), np.full((len(a), len(ids)), np.inf)
        for p in range(d.shape[1]):
            mine, theirs = self.d[a, p][:, None], d[:, p][None, :]
            np.maximum(near, np.abs(mine - theirs), out=near)
            np.minimum(far, mine + theirs, out=far)
        lo, hi = self.bracket(near, far, self.square[a][:, None])
        keep = (hi >= self.low[a].min(1)[:, None]) & (lo <= self.high[a].max(1)[:, None])
        keep &= (self.labels[a][:, None] == labels[None, :]) == self.same_label
        keep &= self.ids[a][:, None] != ids[None, :]
        i, j = np.nonzero(keep)
        self.compared += keep.size
        self.multiplied += len(i)
        score = self.products(a, i, v, j)
        for band in range(self.low.shape[1]):
            fits = (score >= self.low[a[i], band]) & (score <= self.high[a[i], band])
            self.pending.append((a[i[fits]] * self.low.shape[1] + band, score[fits], ids[j[fits]]))
        if sum(len(x[0]) for x in self.pending) >= PENDING:
            self.settle()

    def products(self, a: np.ndarray, i: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact inner products of anchors a[i] and vectors v[j], pair by pair; by one product of matrices where most pairs are wanted."""
        if self.exact_in_doubles and len(i) * 8 >= len(a) * len(v):
            return (self.q[a] @ v.astype(np.float64).T)[i, j].astype(np.int64)
        out = np.zeros(len(i), np.int64)
        step = max(1, (1 << 20) // max(1, v.shape[1]))
        q = self.q[a].astype(np.int64)
        for s in range(0, len(i), step):
            out[s : s + step] = np.einsum("ij,ij->i", q[i[s : s + step]], v[j[s : s + step]])
        return out

    def settle(self) -> None:
        """Cuts what was found to the k best of each band; where there are k, the band's low end rises to the last of them."""
        group, score, ident = (np.concatenate(x) for x in zip(self.found, *self.pending))
        self.pending = []
        at = best(group, score, ident, self.k)
        group, score, ident = self.found = [group[at], score[at], ident[at]]
        last = np.flatnonzero(np.arange(len(group)) - np.searchsorted(group, group, "left") == self.k - 1)
        flat = self.low.reshape(-1)
        flat[group[last]] = np.maximum(flat[group[last]], score[last])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of anchors, bands, scores, ids."""
        self.settle()
        bands = self.low.shape[1]
        return self.found[0] // bands, self.found[0] % bands, self.found[1], self.found[2]


def _matrix(column, n: int, kind) -> np.ndarray:
    flat = np.asarray(column.flatten() if n else [], kind)
    return flat.reshape(n, -1) if len(flat) else np.zeros((n, 0), kind)


def _indexed(shared):
    def run(batches):
        import pyarrow as pa

        pivots = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            d = pivots.distances(_matrix(b.column("v"), b.num_rows, np.int64))
            near = d.argmin(1)
            lists = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(d.min(1)), lists], ["id", "label", "v", "cell", "near", "d"])

    return run


def _searched(shared):
    def run(batches):
        import copy

        import pyarrow as pa

        search, anchors = shared.value
        mine = copy.deepcopy(search)  # a worker that is used again keeps its broadcast values
        for b in batches:
            mine.offer(np.asarray(b.column("id")), np.asarray(b.column("label")), _matrix(b.column("v"), b.num_rows, np.int64), _matrix(b.column("d"), b.num_rows, np.float64))
        at, band, score, ident = mine.result()
        yield pa.RecordBatch.from_arrays([pa.array(anchors[at]), pa.array(band.astype(np.int32)), pa.array(score), pa.array(ident)], ["anchor_id", "band", "score", "id"])

    return run


class Index:
    """Vectors with their distances to the pivots, in the shared folder."""

    def __init__(self, vectors: DataFrame, most_pivots: int = PIVOTS):
        spark = tune(vectors.sparkSession)
        self.spark = spark
        vectors = materialise(vectors, "vectors")
        norm = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, e: s + e * e)
        top = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))
        self.rows, self.width, square, self.top = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm), F.max(top)).first()
        if not self.rows:
            return
        self.width = max(1, self.width)
        vectors = vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(self.width) - F.size("v"))))
        sample = first_by_hash(vectors, "id", SAMPLE).select("id", "label", "v").toArrow()
        self.sample = [np.asarray(sample.column("id").combine_chunks()), np.asarray(sample.column("label").combine_chunks()), np.asarray(sample.column("v").combine_chunks().flatten()).reshape(-1, self.width)]
        self.pivots = Pivots.of(self.sample[2], float(square), most_pivots)
        shared = spark.sparkContext.broadcast(self.pivots)
        table = vectors.mapInArrow(_indexed(shared), "id bigint, label bigint, v array<bigint>, cell int, near double, d array<double>")
        parts = max(spark.sparkContext.defaultParallelism, self.rows * (self.width + len(self.pivots.at)) * 8 // (64 << 20))
        self.table = materialise(table.repartitionByRange(int(parts), "cell", "near", "id").sortWithinPartitions("cell", "near", "id"), "pivot-table")

    def search(self, anchors, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> DataFrame:
        """(anchor_id, band, score, id, rank): the k rows of the highest scores of each anchor's bands, ties by smaller id."""
        ids, labels, q = anchors
        exact = self.width * float(self.top) ** 2 < 2.0**53
        search = Search(ids, labels, q.astype(np.float64), self.pivots, low.copy(), high, k, same_label, exact)
        search.start(*self.sample)
        shared = self.spark.sparkContext.broadcast((search, ids))
        found = self.table.select("id", "label", "v", "d").mapInArrow(_searched(shared), "anchor_id bigint, band int, score bigint, id bigint")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, scale: float = 256, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", chunk: int = ANCHORS, most_pivots: int = PIVOTS) -> DataFrame:
    """RESULT: for each anchor and each of its first `positives` rows of its label, the first `negatives` rows of other labels with a score from
    least to most per cent of the positive's.

    anchors: a condition on the column `id`. Each chunk of anchors reads the pivot table twice: once for positives, once for negatives.
    """
    spark = rows.sparkSession
    index = Index(usable(rows, scale, id_col, vector_col, label_col), most_pivots)
    if not index.rows:
        return spark.createDataFrame([], RESULT)
    asked = index.table.where(anchors).select("id", "label", "v")
    chunk = max(1, min(chunk, CHUNK_COMPONENTS // index.width))
    chunks = max(1, -(-asked.count() // chunk))
    at = scratch_path(spark, "anchors")
    asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).repartition("chunk").write.partitionBy("chunk").parquet(at)
    asked = spark.read.schema("id bigint, label bigint, v array<bigint>, chunk bigint").parquet(at)
    out = scratch_path(spark, "negatives")
    for i in range(chunks):
        some = asked.where(F.col("chunk") == i).orderBy("id").toArrow()
        n = some.num_rows
        own = [np.asarray(some.column("id").combine_chunks()), np.asarray(some.column("label").combine_chunks()), _matrix(some.column("v").combine_chunks(), n, np.int64)]
        found = index.search(own, np.full((n, 1), -_NONE), np.full((n, 1), _NONE), positives, True).toArrow()
        place = np.searchsorted(own[0], np.asarray(found.column("anchor_id").combine_chunks()))
        rank, score = np.asarray(found.column("rank").combine_chunks()) - 1, np.asarray(found.column("score").combine_chunks())
        low, high = np.full((n, positives), _NONE), np.full((n, positives), -_NONE)
        hundreds, units = score // 100, score % 100
        low[place, rank], high[place, rank] = least * hundreds - (-least * units // 100), most * hundreds + most * units // 100
        pairs = spark.createDataFrame(found.select(["anchor_id", "rank", "id", "score"]).rename_columns(["anchor_id", "place", "positive_id", "positive_score"]))
        pairs = pairs.select("anchor_id", (F.col("place") - 1).cast("int").alias("band"), "positive_id", "positive_score")
        best_of = index.search(own, low, high, negatives, False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        rows = best_of.join(F.broadcast(pairs), ["anchor_id", "band"])  # of a chunk: at most `positives` rows an anchor
        rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)


def digest(embeddings: DataFrame) -> DataFrame:
    """The query: labels of ids divisible by 7 move on by one; anchors are the ids divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)
