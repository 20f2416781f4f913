"""Operator 8, nearest neighbours by collision counting over single-projection sorted arrays with virtual rehashing.

Largest inner product is turned to smallest distance: vectors get one more component, the root of (R^2 - squared length), and queries are scaled to length R with 0 there, so that a
product t with the query of length 1 is the squared distance 2 R (R - t). Vectors are dealt to blocks by length, in bands of BANDS to a doubling, so that R is each block's own and an outlying length widens
no window but its band's; a band too short for t is not met. A block works on vectors scaled by a power of two, so squares neither overflow nor vanish.

A block keeps its projections on each direction sorted; directions are random orthonormal bases, whose counts vary less than those of independent ones. A query opens a window around
its point in every array; a vector whose collisions (arrays in whose window it lies) reach the threshold is verified by its exact inner product.
Window ends are places in a sorted array, moved outwards to the next of GRID marks, so a window is the difference of two stored bit sets, and
collisions of all vectors of a block are summed by bit-sliced adders: some machine words for 64 vectors and an array.

Threshold: first the collision count that all but MISS of the vectors at just that distance reach, found once from random directions. Neighbours of a query may all lie in one
direction, and then miss together: so each query lowers its own to MARGIN below the fewest collisions of the k best it has found, and searches the counts again,
until they are found to lie above it. A query with fewer than k lowers it all the way.

Radii. On a bounded sample (SAMPLE vectors, scaled to length 1, broadcast) windows are widened and narrowed until k + EXTRA vectors, or at most twice as many, collide often enough; the k-th best
of those verified is the first t of the query, and they are answers until better ones are found, so no query ends with fewer. Rounds cover GROWTH times as many vectors as the one before and
raise t for the next: the vectors verified in a round stay in proportion to k, however large the table is.

Equal vectors are one class with its least vec_ids, as many as can be answers, limited in each task before the shuffle; a vector that a third of all rows
share is no hot key. All classes are indexed, in blocks of about BLOCK by length and hash of the vector; the stated query set meets every block, in blocks of its own.

Defined cases: null, zero and non-finite vectors, those with null components, null vec_ids and vectors whose number of components isn't the commonest one take no
part; finite vectors of any length do, scores beyond the doubles are infinite and tie, those without a value (infinity less infinity) come last; a vec_id is a query once (by its least vector), and its rows are never its own candidates;
other repeated rows are candidates of their own; ties go to the smaller vec_id; fewer candidates than k give as many rows; an empty table gives no rows; columns besides vec_id and embedding
are ignored; there are no texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.common import materialize

BLOCK, QUERY_BLOCK, PROJECTIONS, GRID, SAMPLE, GROWTH, SEED = 4096, 4096, 128, 64, 4096, 16, 5
WINDOW, WIDENINGS, MISS, EXTRA, MARGIN, BANDS = 1.4, 8, 0.1, 20, 2, 4
WORDS_IN_STEP = 1 << 15
HITS = "query_id long, vec_id long, class long, copy long, score double"


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Columns of whole orthonormal bases, `projections` or a few more (of one basis no more), scaled so that a projection's mean square is the squared length."""
    rng = np.random.default_rng(SEED)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
    return (bases[0][:, :projections] if len(bases) == 1 else np.hstack(bases)) * math.sqrt(dim)


def threshold(bases: np.ndarray, window: float = WINDOW, miss: float = MISS) -> int:
    """Collisions that all but `miss` of the differences of length 1 reach in windows of that half width."""
    v = np.random.default_rng(SEED + 1).standard_normal((4000, len(bases)))
    v /= np.sqrt((v**2).sum(1, keepdims=True))
    return int(np.quantile((np.abs(v @ bases) <= window).sum(1), miss, method="lower"))


class CollisionIndex:
    """Sorted projections of points, and for each array the bit sets of the points before each mark."""

    def __init__(self, points: np.ndarray) -> None:
        squares = (points**2).sum(1)
        self.length = math.sqrt(float(squares.max()))
        bases = directions(points.shape[1] + 1)
        self.bases, self.need = bases[:-1], threshold(bases)
        placed = np.hstack([points, np.sqrt(np.maximum(0.0, squares.max() - squares))[:, None]]) @ bases
        n, m = placed.shape
        self.points = n
        order = np.argsort(placed, axis=0, kind="stable").T
        self.sorted = np.ascontiguousarray(np.take_along_axis(placed.T, order, 1))
        self.step = -(-n // GRID)
        words = -(-n // 64)
        cell = np.arange(n) // self.step + 1
        self.before = np.empty((m, GRID + 1, words), np.uint64)
        flags = np.zeros((GRID + 1, words * 64), np.uint8)
        for j in range(m):
            flags[cell, order[j]] = 1
            bits = np.packbits(flags, axis=1, bitorder="little").view("<u8")
            np.bitwise_or.accumulate(bits, axis=0, out=self.before[j])
            flags[cell, order[j]] = 0

    def counts(self, centers: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
        """Collisions of all points with each query (center, radius), as bit planes (queries x words), lowest first."""
        at, half = centers @ self.bases, WINDOW * radius + 1e-9 * self.length
        levels: list[list[np.ndarray]] = []

        def add(level: int, x: np.ndarray) -> None:
            if level == len(levels):
                levels.append([])
            held = levels[level]
            held.append(x)
            if len(held) == 3:
                a, b, c = held
                both = a & b
                a = a ^ b
                both |= a & c
                a ^= c
                levels[level] = [a]
                add(level + 1, both)

        for s, sets, x in zip(self.sorted, self.before, at.T, strict=True):
            low, high = np.searchsorted(s, x - half, "left") // self.step, -(-np.searchsorted(s, x + half, "right") // self.step)
            add(0, sets[high] ^ sets[low])
        level = 0
        while level < len(levels):
            if len(levels[level]) == 2:
                a, b = levels[level]
                levels[level] = [a ^ b]
                add(level + 1, a & b)
            level += 1
        return [x[0] for x in levels]

    def reaching(self, planes: list[np.ndarray], need: np.ndarray) -> list[np.ndarray]:
        """For each query the points that collide `need` times at least."""
        equal = np.full_like(planes[0], np.uint64(0xFFFFFFFFFFFFFFFF))
        equal[need >> len(planes) > 0] = 0
        over = np.zeros_like(equal)
        for level in range(len(planes) - 1, -1, -1):
            wanted = np.where(need >> level & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
            over |= equal & planes[level] & ~wanted
            equal &= ~(planes[level] ^ wanted)
        bits = np.unpackbits((over | equal).view(np.uint8), axis=1, count=self.points, bitorder="little")
        row, col = np.nonzero(bits)
        return np.split(col, np.searchsorted(row, np.arange(1, len(bits))))

    @staticmethod
    def collisions(planes: list[np.ndarray], query: int, points: np.ndarray) -> np.ndarray:
        return sum((x[query, points >> 6] >> (points & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << level for level, x in enumerate(planes))

    def steps(self, n: int) -> range:
        return range(0, n, max(1, WORDS_IN_STEP // self.before.shape[2]))

    def widen(self, centers: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query the points to verify in the narrowest windows met in which `enough` collide; all where no window holds so many.

        Windows are widened and narrowed in turn, each time by half of what is open of the radius's logarithm, until at most twice as many collide.
        """
        out, left = [np.arange(self.points)] * len(centers), np.arange(len(centers))
        log = np.log(2 * self.length)
        low, high = np.full(len(centers), log - WIDENINGS * math.log(2)), np.full(len(centers), log)
        for _ in range(WIDENINGS):
            middle = (low + high) / 2
            done = np.zeros(len(left), bool)
            for i in (steps := self.steps(len(left))):
                some = left[i : i + steps.step]
                found = self.reaching(self.counts(centers[some], np.exp(middle[some])), np.full(len(some), self.need))
                size = np.array([len(x) for x in found])
                for k in np.flatnonzero(size >= enough).tolist():
                    out[some[k]] = found[k]
                done[i : i + len(some)] = (size >= enough) & (size <= 2 * enough)
                low[some], high[some] = np.where(size < enough, middle[some], low[some]), np.where(size < enough, high[some], middle[some])
            left = left[~done]
        return out


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _usable(df: DataFrame) -> DataFrame:
    e = F.col("embedding")
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))


def _classes(base: DataFrame, once: bool, k: int) -> DataFrame:
    """embedding, ids: the vec_ids of its rows, least first, as many as any query's k answers can take."""
    base = base.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    if not once:
        base = base.withColumn("_n", F.row_number().over(W.Window.partitionBy("embedding", "vec_id").orderBy("vec_id"))).filter(F.col("_n") <= k).drop("_n")
    place = F.dense_rank().over(W.Window.partitionBy("embedding").orderBy("vec_id"))
    return base.withColumn("_n", place).filter(F.col("_n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors by powers of two that bring their largest component to 1/2 to 1, and the exponents."""
    exponent = np.frexp(np.abs(vectors).max(1))[1]
    return np.ldexp(vectors, -exponent[:, None]), exponent


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, and the logarithms (base 2) of their lengths."""
    small, exponent = _scaled(vectors)
    length = np.sqrt((small**2).sum(1))
    return small / length[:, None], np.log2(length) + exponent


class Block:
    """Classes (ids, vectors) of one block with what a search needs of them."""

    def __init__(self, keys: np.ndarray, ids: list[np.ndarray], vectors: np.ndarray, k: int, unit: bool = False) -> None:
        self.keys, self.ids, self.vectors, self.k = keys, ids, vectors, k
        self.exponent = int(np.frexp(np.abs(vectors).max())[1])
        self.points = _units(vectors)[0] if unit else np.ldexp(vectors, -self.exponent)
        self.index = CollisionIndex(self.points)

    def rows(self, classes: np.ndarray, score: np.ndarray, query_id: int) -> tuple[np.ndarray, ...]:
        """vec_id, class, copy (the place among a class's equal vec_ids), score and index of the k best rows of these classes, but for the query's own."""
        ids = [self.ids[c] for c in classes.tolist()]
        sizes = [len(x) for x in ids]
        vec = np.concatenate([*ids, np.empty(0, np.int64)])
        copy = np.concatenate([*(np.arange(len(x)) - np.searchsorted(x, x) for x in ids), np.empty(0, np.int64)]) if len(vec) > len(ids) else np.zeros(len(vec), np.int64)
        score, at = np.repeat(score, sizes), np.repeat(classes, sizes)
        order = np.lexsort((vec, -score))
        order = order[vec[order] != query_id][: self.k]
        return vec[order], self.keys[at[order]], copy[order], score[order], at[order]

    def exact(self, classes: np.ndarray, query: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return (self.vectors[classes] * query).sum(1)

    def best(self, classes: np.ndarray, query: np.ndarray, unit: np.ndarray, query_id: int, floor: float = -np.inf) -> tuple[np.ndarray, ...]:
        """The k best rows of these classes; floor: a product with the unit query that none needs to fall short of."""
        rough = self.points[classes] @ unit
        if len(classes) > self.k + 1:  # a class beside the query's own gives a row at least; all that may tie with the last go on to the exact sum
            floor = max(floor, np.partition(rough, len(classes) - self.k - 1)[len(classes) - self.k - 1])
        some = classes[rough >= floor - 1e-9 * self.index.length]
        score = self.exact(some, query)
        if not np.isfinite(score).all():  # beyond the doubles products that differ may tie
            some = classes
            score = self.exact(some, query)
        return self.rows(some, score, query_id)

    def search(self, q_ids: list[int], queries: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For each query the rows of this block among its k best, if they reach about its bound."""
        units, logs = _units(queries)
        with np.errstate(over="ignore"):
            reach = np.where(bounds > 0, np.exp2(np.log2(np.clip(bounds, 1e-300, 1.7e308)) - logs - self.exponent), -np.inf)
        length, index = self.index.length, self.index
        out = [self.rows(np.empty(0, np.int64), np.empty(0), -1)] * len(queries)
        live = np.flatnonzero(reach <= length * (1 + 1e-9))
        everything = np.arange(index.points)
        for i in (steps := index.steps(len(live))):
            some = live[i : i + steps.step]
            planes = index.counts(units[some] * length, np.sqrt(2 * length * np.maximum(0.0, length - np.maximum(reach[some], -length))))
            need = np.full(len(some), index.need)
            rows = index.reaching(planes, need)
            open_ = np.arange(len(some))
            while len(open_):
                lower = need.copy()
                for x in open_.tolist():
                    r = some[x]
                    if bounds[r] == -np.inf:
                        rows[x] = everything
                    out[r] = self.best(rows[x], queries[r], units[r], q_ids[r], reach[r])
                    if len(rows[x]) < index.points and len(out[r][0]):
                        lower[x] = max(0, min(need[x], int(index.collisions(planes, x, out[r][4]).min()) - MARGIN))
                open_ = np.flatnonzero(lower < need)
                need = lower
                if len(open_):
                    for x, found in zip(open_.tolist(), index.reaching([p[open_] for p in planes], need[open_]), strict=True):
                        rows[x] = found
        return out


def _hits(query_ids: list[int], found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Columns of HITS."""
    sizes = [len(x[0]) for x in found]
    return [np.repeat(np.array(query_ids, np.int64), sizes), *(np.concatenate([*(x[c] for x in found), np.empty(0, kind)]) for c, kind in enumerate((np.int64, np.int64, np.int64, np.float64)))]


def _sampled(asked: DataFrame, classes: DataFrame, n: int, k: int) -> DataFrame:
    """HITS of each query: the k best of those vectors of the sample that collide first."""
    spark = asked.sparkSession
    sample = classes.filter(F.pmod(F.xxhash64("embedding", F.lit(2)), F.lit(max(1, n // SAMPLE))) == 0).toArrow()  # about SAMPLE rows, at most twice as many
    shared = spark.sparkContext.broadcast((sample["class"].to_numpy(), [np.array(x) for x in sample["ids"].to_pylist()], _matrix(sample["embedding"]), k, True))

    def run(batches):
        block = Block(*shared.value) if len(shared.value[0]) else None
        for batch in batches:
            queries, ids = _matrix(batch.column(1)), batch.column(0).to_pylist()
            # lengths differ here, so all that collide are compared by their exact products
            found = [block.rows(c, block.exact(c, q), i) for c, q, i in zip(block.index.widen(_units(queries)[0], k + EXTRA), queries, ids, strict=True)] if block is not None else []
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _hits(ids if found else [], found)], ["query_id", "vec_id", "class", "copy", "score"])

    return asked.mapInArrow(run, HITS)


def _log_length(e: Column) -> Column:
    """Logarithm (base 2) of a vector's length, of any magnitude."""
    most = F.array_max(F.transform(e, F.abs))
    return F.log2(most) + F.log2(F.aggregate(e, F.lit(0.0), lambda s, x: s + (x / most) * (x / most))) / 2


def _meet(asked: DataFrame, classes: DataFrame, share: float, bands: list, query_blocks: int, k: int) -> DataFrame:
    """The k best rows of each block of classes for each query (vec_id, embedding, bound); bands: (band, classes) of the table, of which `classes` holds about this share."""
    sizes = [(b, max(1, -(-int(n * share) // BLOCK))) for b, n in bands]
    spark = asked.sparkSession
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(n).alias("blocks")) for b, n in sizes])).alias("_b")
    reach = F.col("_b.band") + 1 + 1e-6 >= BANDS * (F.log2("bound") - _log_length(F.col("embedding")))
    left = asked.select("*", blocks).filter((F.col("bound") <= 0) | (F.col("bound") == float("inf")) | reach)
    left = left.select("vec_id", "embedding", "bound", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("qb"), F.col("_b.band").alias("band"), F.explode(F.sequence(F.lit(0), F.col("_b.blocks") - 1)).alias("bb"))
    of_band = spark.createDataFrame(sizes, "band int, blocks int")
    right = classes.join(of_band, "band").select("embedding", "ids", "class", "band", F.pmod(F.xxhash64("embedding", F.lit(1)), F.col("blocks")).cast("int").alias("bb"), F.explode(_upto(query_blocks)).alias("qb"))

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        q_ids, found = q["vec_id"].to_pylist(), []
        if q.num_rows and x.num_rows:
            block = Block(x["class"].to_numpy(), [np.array(v) for v in x["ids"].to_pylist()], _matrix(x["embedding"]), k)
            found = block.search(q_ids, _matrix(q["embedding"]), q["bound"].to_numpy())
        return pa.table(dict(zip(("query_id", "vec_id", "class", "copy", "score"), _hits(q_ids if found else [], found), strict=True)))

    return left.groupBy("qb", "band", "bb").cogroup(right.groupBy("qb", "band", "bb")).applyInArrow(run, HITS)


def nearest(table: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) its k nearest rows of table (vec_id, embedding)."""
    spark, base = table.sparkSession, _usable(table)
    sizes = base.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["d"]
    band = F.floor(BANDS * _log_length(F.col("embedding"))).cast("int").alias("band")
    classes = materialize(_classes(base.filter(F.size("embedding") == dim), sizes["n"] == sizes["ids"], k).select("*", band, F.xxhash64("embedding").alias("class")))
    bands = [(r["band"], r["count"]) for r in classes.groupBy("band").count().collect()]  # a double has BANDS * 2100 bands at most
    n = sum(count for _, count in bands)
    asked = _usable(queries).filter(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    query_blocks = -(-asked.count() // QUERY_BLOCK) or 1
    asked = materialize(asked)
    best = _sampled(asked, classes, n, k)
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    place = F.pmod(F.xxhash64("embedding", F.lit(3)), F.lit(1 << 40)) / (1 << 40) * n  # of a class among all, by hash
    done, upto = 0, GROWTH * SAMPLE

    def ranked(hits: DataFrame) -> DataFrame:
        """The k best rows of each query; what several rounds have met counts once."""
        once = hits.groupBy("query_id", "vec_id", "class", "copy").agg(F.max("score").alias("score"))
        return once.withColumn("rank", rank).filter(F.col("rank") <= k)

    best = materialize(ranked(best))
    while True:
        last = upto >= n
        bound = best.filter((F.col("rank") == k) & ~F.isnan("score")).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        now = asked.join(bound, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        some = classes.filter(place >= done) if last else classes.filter((place >= done) & (place < upto))
        hits = _meet(now, some, (min(upto, n) - done) / n, bands, query_blocks, k)
        best = ranked(hits.unionByName(best.drop("rank")))
        if last:
            return best.select("query_id", "rank", "vec_id", "score")
        best = materialize(best)
        done, upto = upto, upto * GROWTH


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.filter("vec_id % 20 = 0"))
