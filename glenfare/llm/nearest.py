"""Approximate nearest neighbours (operator 13): adaptive dimension scan.

Nearness is the inner product.  With one further coordinate, sqrt(M^2 - |x|^2) for
a vector and 0 for a query (M: the largest norm), the squared distance is
|q|^2 + M^2 - 2 <q, x>, so the nearest by distance are the largest by product.

1. Equal vectors form a class, known by one vector and its k + 1 smallest vec_ids:
   more can never be among the k nearest of a query other than themselves.
2. The classes are dealt to inverted lists by their nearest centroid (k-means on a
   bounded sample; every class is indexed), and each list is cut into groups by a hash, so
   that a hot list becomes as many tasks as it needs.  Vectors are turned by a random
   rotation and stored in blocks, dimension by dimension: a column block is a
   contiguous slice.
3. Distinct query vectors visit the lists nearest to them, and meet the blocks of a
   list by an equi-join on (list, group).  A scan adds up the squared distance one column
   block after the other; after each it drops the candidates whose distance over
   the first t dimensions, scaled by d / t, exceeds the query's threshold by a factor of
   (1 + EPSILON / sqrt(t))^2: the hypothesis that they are near enough is rejected.
   What is left gets its exact product, in double precision, from the original vectors.
4. The lists that come first give each query its threshold, the (k + 1)-th best product so
   far; the scan of the other lists starts from it.
5. How many lists a query visits is calibrated: for PROBED random queries, found by hash,
   an exact pass over all classes finds the true neighbours, and the least number of lists
   that holds RECALL of them is taken.  A query visits further lists while those
   chosen hold too few vectors for k results.

Bounds: the sample has at most SAMPLE_PER_LIST vectors a list (the lists grow with the cube root of
the classes), the calibration PROBED queries of k + 1 results; only these and the
size of each list reach the driver.

Edge cases: rows whose vector is null, zero or holds null, NaN or infinite entries take
no part; of vectors of unequal lengths the shorter are filled up with zeros; a
row with a null vec_id is no query, and comes last among ties; rows equal in vec_id and vector count once,
rows that share only the vec_id are rows of their own; with fewer than k other rows a query gets all of
them; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glenfare.llm.common import settings, ship, stored, table

K, EVERY = 20, 20
#: Lists for each cube root of the classes, sample vectors a list, k-means rounds.
LISTS, SAMPLE_PER_LIST, ROUNDS = 1.5, 64, 10
#: Calibration: queries, and the share of true neighbours their lists must hold.
PROBED, RECALL = 256, 0.97
#: Rows of a group, of a block, and queries that a block meets at once.
GROUP, BLOCK, CHUNK = 8192, 2048, 256
#: Dimensions of a column block; strictness of the hypothesis test.
COLUMNS, EPSILON = 16, 2.1
#: Share of the candidates below which the scan goes on with single pairs, and pairs at once.
SPARSE, PAIRS = 0.25, 1 << 18
SEED = 13
#: Null ids come after all others.
LAST = (1 << 63) - 1

FOUND = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("own", pa.bool_()), ("members", pa.list_(pa.int64()))])
FOUND_DDL = "query bigint, score double, own boolean, members array<bigint>"
BLOCKS = pa.schema([("list", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("turned", pa.binary()),
                    ("original", pa.binary()), ("members", pa.list_(pa.list_(pa.int64())))])
BLOCKS_DDL = "list int, part int, n int, turned binary, original binary, members array<array<bigint>>"
CHUNKS = pa.schema([("list", pa.int32()), ("queries", pa.list_(pa.int64())), ("vectors", pa.binary()),
                    ("thresholds", pa.list_(pa.float64()))])
CHUNKS_DDL = "list int, queries array<bigint>, vectors binary, thresholds array<double>"


# --- classes and queries ------------------------------------------------------------------------

def usable(v: Column) -> Column:
    """Vectors that are finite throughout and not zero."""
    return (v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
            & F.exists(v, lambda c: c != 0))


def normal(v: Column) -> Column:
    """One zero for both, so that equal vectors are the same array."""
    return F.transform(v, lambda c: c + F.lit(0.0))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: v, members (its k + 1 smallest vec_ids, null last)."""
    w = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    first = rows.distinct().withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id"))).alias("m")) \
        .select("v", F.col("m.vec_id").alias("members"))


def vectors(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


# --- the index ----------------------------------------------------------------------------------

def k_means(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of ``sample``; an empty one keeps its place."""
    rnd = np.random.default_rng(SEED)
    c = sample[rnd.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(sample, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def affinity(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Larger for a nearer centroid."""
    return x @ c.T - (c * c).sum(1) / 2


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return affinity(x, c).argmax(1)


def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))[0]


def assigned(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """The list of each class."""
    for b in batches:
        near = nearest(vectors(b.column("v"), model["d"]), model["centroids"])
        yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column("v"), b.column("members")],
                                         ["list", "v", "members"])


def blocks(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (list, part) in, blocks of at most BLOCK rows of one list and part out."""
    d, turn, norm = model["d"], model["rotation"], model["norm"]

    def block(rows: pa.Table) -> pa.RecordBatch:
        x = vectors(rows.column("v"), d)
        more = np.sqrt(np.maximum(norm ** 2 - (x * x).sum(1), 0))[:, None]
        turned = (np.hstack([x, more]) @ turn).astype(np.float32)
        return pa.RecordBatch.from_arrays([
            rows.column("list").slice(0, 1).combine_chunks(), rows.column("part").slice(0, 1).combine_chunks(),
            pa.array([len(x)], pa.int32()), pa.array([np.ascontiguousarray(turned.T).tobytes()], pa.binary()),
            pa.array([x.astype(model["type"]).tobytes()], pa.binary()),
            pa.array([rows.column("members").to_pylist()], BLOCKS.field("members").type)], schema=BLOCKS)

    held: pa.Table | None = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        keys = held.column("list").to_numpy().astype(np.int64) << 32 | held.column("part").to_numpy()
        ends = np.flatnonzero(np.diff(keys)) + 1
        lo = 0
        for end in [*ends.tolist(), None]:  # the last run may go on in the next batch
            while (end or len(keys)) - lo >= BLOCK or end and end > lo:
                n = min(BLOCK, (end or len(keys)) - lo)
                yield block(held.slice(lo, n))
                lo += n
        held = held.slice(lo).combine_chunks()
    if held is not None and len(held):
        yield block(held)


# --- calibration --------------------------------------------------------------------------------

def best(scores: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` largest in each row, in no order."""
    n = min(n, scores.shape[1])
    return np.argpartition(-scores, n - 1, axis=1)[:, :n]


def exact_hits(batches: Iterator[pa.RecordBatch], model: dict, probes: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """The ``n`` best classes of a task for each probe: (probe, score, list)."""
    held = [np.zeros((len(probes), 0)), np.zeros((len(probes), 0), np.int64)]
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            x = vectors(b.column("v").slice(lo, BLOCK), model["d"])
            near = nearest(x, model["centroids"])
            scores = np.hstack([held[0], probes @ x.T])
            where = np.hstack([held[1], np.broadcast_to(near, (len(probes), len(x)))])
            top = best(scores, n)
            held = [np.take_along_axis(a, top, 1) for a in (scores, where)]
    row = np.repeat(np.arange(len(probes)), held[0].shape[1])
    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(held[0].ravel()),
                                      pa.array(held[1].ravel(), pa.int32())], ["probe", "score", "list"])


def probes_needed(classes: DataFrame, model: dict, probes: np.ndarray, k: int) -> int:
    """The least number of lists that holds RECALL of the true neighbours of ``probes``."""
    hits = classes.mapInArrow(partial(exact_hits, model=model, probes=probes, n=k + 1), "probe int, score double, list int")
    w = Window.partitionBy("probe").orderBy(F.desc("score"), "list")
    top = hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1).select("probe", "list").toPandas()
    order = np.argsort(-affinity(probes, model["centroids"]), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    ranks = np.sort(rank[top["probe"].to_numpy(), top["list"].to_numpy()])
    return int(ranks[min(int(np.ceil(RECALL * len(ranks))), len(ranks)) - 1]) + 1


# --- the scan -----------------------------------------------------------------------------------

def visits(batches: Iterator[pa.RecordBatch], model: dict, k: int) -> Iterator[pa.RecordBatch]:
    """(query, list, early, vector) of the lists that each query visits, in single precision where it has that."""
    sizes = model["sizes"]
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            x = vectors(part.column("v"), model["d"])
            order = np.argsort(-affinity(x, model["centroids"]), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) <= k).sum(1) + 1  # lists that hold k + 1 classes
            n = np.minimum(np.maximum(model["probes"], enough), len(sizes))
            first = np.minimum(np.maximum(model["early"], enough), n)
            place = np.arange(len(sizes))[None, :]
            q, p = np.nonzero(place < n[:, None])
            data = x.astype(model["type"])
            yield pa.RecordBatch.from_arrays([
                part.column("query").take(pa.array(q)), pa.array(order[q, p], pa.int32()), pa.array(p < first[q]),
                pa.array([data[i].tobytes() for i in q], pa.binary())], ["query", "list", "early", "vector"])


def packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list in, chunks of at most ``size`` queries of one list out."""
    key, held = None, []

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([key], pa.int32()), pa.array([[h[0] for h in held]], pa.list_(pa.int64())),
            pa.array([b"".join(h[1] for h in held)], pa.binary()),
            pa.array([[h[2] for h in held]], pa.list_(pa.float64()))], schema=CHUNKS)

    for b in batches:
        for q, l, v, t in zip(*(b.column(c).to_pylist() for c in ("query", "list", "vector", "threshold"))):
            if held and (l != key or len(held) == size):
                yield chunk()
                held = []
            key = l
            held.append((q, v, t))
    if held:
        yield chunk()


def scan_block(q: np.ndarray, turned_q: np.ndarray, x: np.ndarray, turned_x: np.ndarray, norm: float,
               floor: np.ndarray, first_id: np.ndarray, n: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (query, row) of a block, the ``n`` best of each query (of equal ones those with the smaller
    ``first_id``), with their products, and the number of (pair, dimension) terms added up.

    ``floor``: the product that each query asks for at least.  The rows come in steps, each four times
    the one before; what a step finds raises the floor, by which the next ones are abandoned."""
    d, whole = len(turned_x), (q * q).sum(1) + norm ** 2
    rows, pairs_q, pairs_x, products, terms, none = len(x), [], [], [], 0, np.zeros(0, np.int64)
    steps = [0]
    while steps[-1] < rows:
        steps.append(min(rows, 4 * max(n, steps[-1])))
    for lo, hi in zip(steps, steps[1:]):
        limit = np.where(np.isfinite(floor), (whole - 2 * floor) + 1e-5 * whole, np.inf)[:, None].astype(np.float32)
        part = turned_x[:, lo:hi]
        total, alive = np.zeros((len(q), hi - lo), np.float32), None
        i = j = None  # the pairs that are left, once they are few
        for at in range(0, d, COLUMNS):
            a, b = turned_q[:, at:at + COLUMNS], part[at:at + COLUMNS]
            done = min(at + COLUMNS, d)
            factor = np.float32((1 + epsilon / np.sqrt(done)) ** 2 * done / d) if done < d else np.float32(1)
            if i is None:
                total += (a * a).sum(1)[:, None] + (b * b).sum(0)[None, :] - 2 * (a @ b)
                terms += total.size * (done - at)
                keep = total <= limit * factor
                alive = keep if alive is None else alive & keep
                if alive.mean() < SPARSE or done == d:
                    i, j = np.nonzero(alive)
                    sums = total[i, j]
            else:
                for k in range(0, len(i), PAIRS):
                    s = slice(k, k + PAIRS)
                    diff = a[i[s]] - b[:, j[s]].T
                    sums[s] += (diff * diff).sum(1)
                terms += len(i) * (done - at)
                keep = sums <= limit[i, 0] * factor
                i, j, sums = i[keep], j[keep], sums[keep]
        for k in range(0, len(i), PAIRS):
            s = slice(k, k + PAIRS)
            pairs_q.append(i[s])
            pairs_x.append(j[s] + lo)
            products.append((q[i[s]] * x[j[s] + lo]).sum(1))
        if hi < rows:
            floor = np.maximum(floor, nth_best(np.concatenate([*pairs_q, none]), np.concatenate([*products, none]), len(q), n))
    if not products:  # nothing came near enough
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), terms
    i, j, p = np.concatenate(pairs_q), np.concatenate(pairs_x), np.concatenate(products)
    order = np.lexsort((first_id[j], -p, i))
    i, j, p = i[order], j[order], p[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = (place < n) & (p >= floor[i])
    return i[keep], j[keep], p[keep], terms


def nth_best(query: np.ndarray, product: np.ndarray, queries: int, n: int) -> np.ndarray:
    """The n-th best product of each query; -inf where it has fewer."""
    order = np.lexsort((-product, query))
    starts = np.searchsorted(query[order], np.arange(queries + 1))
    at = starts[:-1] + n - 1
    some = at < starts[1:]
    out = np.full(queries, -np.inf)
    out[some] = product[order][at[some]]
    return out


def scan(batches: Iterator[pa.RecordBatch], model: dict, n: int) -> Iterator[pa.RecordBatch]:
    """Blocks beside the queries that visit their list in, what may be among the ``n`` best out."""
    d, turn, kind = model["d"], model["rotation"], np.dtype(model["type"])
    for b in batches:
        for r in range(b.num_rows):
            get = {c: b.column(c)[r] for c in b.schema.names}
            rows = get["n"].as_py()
            x = np.frombuffer(get["original"].as_buffer(), kind).reshape(rows, d).astype(np.float64)
            turned_x = np.frombuffer(get["turned"].as_buffer(), np.float32).reshape(d + 1, rows)
            q = np.frombuffer(get["vectors"].as_buffer(), kind).reshape(-1, d).astype(np.float64)
            turned_q = (np.hstack([q, np.zeros((len(q), 1))]) @ turn).astype(np.float32)
            floor = np.array(get["thresholds"].values.to_numpy(zero_copy_only=False), np.float64)
            members = get["members"].values
            first_id = pc.fill_null(pc.list_element(members, 0), LAST).to_numpy(zero_copy_only=False)
            i, j, p, _ = scan_block(q, turned_q, x, turned_x, model["norm"], floor, first_id, n)
            names = get["queries"].values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(p), pa.array((q[i] == x[j]).all(1)),
                                              members.take(pa.array(j))], schema=FOUND)


def parts_of(model: dict) -> Column:
    """The number of groups of the list in column ``list``."""
    return F.element_at(F.array(*[F.lit(int(p)) for p in model["parts"]]), F.col("list") + 1)


def chunked(wanted: DataFrame, name: str) -> DataFrame:
    """Queries (query, list, vector, threshold) in stored chunks of one list."""
    rows = wanted.repartition("list").sortWithinPartitions("list")
    return stored(rows.mapInArrow(partial(packed, size=CHUNK), CHUNKS_DDL), name)


def search(index: DataFrame, chunks: DataFrame, model: dict, k: int) -> DataFrame:
    """(query, score, own, members) of the classes near to the queries of ``chunks``."""
    dealt = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of(model) - 1)))
    return index.join(dealt, ["list", "part"]).mapInArrow(partial(scan, model=model, n=k + 1), FOUND_DDL)


def build(rows: DataFrame, d: int, k: int, kind: str) -> tuple[DataFrame, dict]:
    """The stored blocks, and what the searches need of the index."""
    classes = stored(classes_of(rows, k), "nearest-classes")
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(squares)).alias("norm")).first()
    lists = max(1, round(LISTS * facts["n"] ** (1 / 3)))
    wanted = lists * SAMPLE_PER_LIST
    by_hash = F.pmod(F.xxhash64("v"), F.lit(max(1, facts["n"] // wanted))) == 0
    sample = vectors(pa.array(classes.filter(by_hash).select("v").limit(2 * wanted).toPandas()["v"]), d)
    if len(sample) < lists:  # few classes: all of them
        sample = vectors(pa.array(classes.select("v").limit(2 * wanted).toPandas()["v"]), d)
    model = {"d": d, "norm": facts["norm"], "type": kind, "rotation": rotation(d + 1), "centroids": k_means(sample, lists)}
    dealt = classes.mapInArrow(partial(assigned, model=model), "list int, v array<double>, members array<bigint>")
    sizes = np.zeros(len(model["centroids"]), np.int64)
    for r in dealt.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    model |= {"sizes": sizes, "parts": np.maximum(1, -(-sizes // GROUP))}
    keyed = dealt.withColumn("part", F.pmod(F.xxhash64("v"), parts_of(model)).cast("int")).repartition("list", "part")
    index = stored(keyed.sortWithinPartitions("list", "part").mapInArrow(partial(blocks, model=model), BLOCKS_DDL), "nearest-blocks")
    step = max(1, facts["n"] // (4 * PROBED))
    some = classes.filter(F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(step)) == 0).select("v").limit(PROBED).toPandas()["v"]
    probes = vectors(pa.array(some), d) if len(some) else sample[:PROBED]
    model["probes"] = probes_needed(classes, model, probes, k)
    model["early"] = max(1, model["probes"] // 8)
    return index, model


def neighbours(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = K, every: int = EVERY) -> DataFrame:
    """The ``k`` nearest found of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    ship(__name__)
    spark = df.sparkSession
    kind = "float32" if dict(df.dtypes)[vector] == "array<float>" else "float64"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(usable(F.col("v"))).withColumn("v", normal(F.col("v")))
    lengths = rows.agg(F.min(F.size("v")).alias("shortest"), F.max(F.size("v")).alias("d")).first()
    if lengths["d"] is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if lengths["shortest"] < lengths["d"]:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(lengths["d"]) - F.size("v"))))
    many = {"spark__sql__execution__arrow__maxRecordsPerBatch": "2048"}
    few = {"spark__sql__execution__arrow__maxRecordsPerBatch": "4"}  # a row is a block of vectors and a chunk of queries
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("members", 1).asc_nulls_last())
    place = F.row_number().over(best_first)
    with settings(spark, **many):
        index, model = build(rows, lengths["d"], k, kind)
        asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).distinct()
        ids = stored(asked.select("vec_id", "v"), "nearest-queries")
        queries = stored(ids.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "nearest-distinct")
        seen = stored(queries.mapInArrow(partial(visits, model=model, k=k),
                                         "query bigint, list int, early boolean, vector binary"), "nearest-visits")
        nothing = F.lit(float("-inf")).alias("threshold")
        chunks = chunked(seen.filter("early").select("query", "list", "vector", nothing), "nearest-early")
    with settings(spark, **few):
        first = stored(search(index, chunks, model, k), "nearest-first")
    with settings(spark, **many):
        floors = first.withColumn("place", place).filter(F.col("place") == k + 1).select("query", F.col("score").alias("threshold"))
        chunks = chunked(seen.filter("NOT early").join(floors, "query", "left").select(
            "query", "list", "vector", F.coalesce("threshold", F.lit(float("-inf"))).alias("threshold")), "nearest-late")
    with settings(spark, **few):
        more = stored(search(index, chunks, model, k), "nearest-more")
    classes = first.unionByName(more).withColumn("place", place).filter(F.col("place") <= k + 1)
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    hit = F.struct("place", "vec_id", "score", "own")
    hits = classes.select("query", "score", "own", F.explode("members").alias("vec_id")).withColumn("place", F.row_number().over(by_row)) \
        .filter(F.col("place") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    others = F.filter("hits", lambda h: ~(h["own"] & h["vec_id"].eqNullSafe(F.col("query_id"))))
    named = ids.join(queries, "v").select(F.col("vec_id").alias("query_id"), "query")
    return named.join(hits, "query").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit")) \
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                F.col("hit.score").alias("score"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_nearest": op13_nearest}
