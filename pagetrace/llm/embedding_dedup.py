"""Near-duplicate vectors by product quantisation over coarse inverted lists.

The index is fitted on a bounded sample of distinct vectors (``sample`` rows, chosen by hash): coarse
centroids, and one codebook per subspace of the residuals. Every distinct vector is then encoded:
its list, its codes and its quantisation error. A query probes each list whose border with its own
list lies nearer than ``reach`` link radii over the square root of the dimensions: that is as many
standard deviations of what a perturbation of the link radius moves along one direction, so lists
beyond it hold a link with negligible probability (recall is tested against brute force). In a
probed list, asymmetric distances from table lookups drop what cannot be a link: distance less
quantisation error is a bound from below. The rest is reranked by the exact cosine in double
precision, so no link below the threshold is reported.

Lists are cut into tiles and their queries into groups of bounded size, so a list that holds a
third of all vectors is many tasks. Pairs are counted where they are found and never emitted; a
task emits, per vector, a count, and the components of the links it found. Equal vectors are one.

Vectors of each length have an index of their own, as vectors of different lengths have no cosine; so a
table of many lengths takes as many rounds. Vectors that are null, zero, or hold null or non-finite
components link with nothing and are components of their own. So are vectors
without id, whose component is null and who are not kept. Rows with the same id and different
vectors are all compared. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrace.llm.common import ArrowBatches, stored, table
from pagetrace.llm.graph import components

COSINE = 0.95
#: Rows that the index is fitted on, at most, and components of all of them.
SAMPLE = 16384
VALUES = 2**23
LISTS = 1024
SUBSPACE = 8
CODES = 256
REACH = 3.0
#: Index vectors and queries that meet in one task.
TILE = 1024
GROUP = 4096
_STEP = 256


@dataclass
class Index:
    centroids: np.ndarray
    codebooks: list[np.ndarray]
    splits: list[slice]
    reach: float
    between: np.ndarray

    def to_centroids(self, units: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids."""
        return np.maximum((units**2).sum(1)[:, None] - 2 * units @ self.centroids.T + (self.centroids**2).sum(1)[None], 0)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, quantisation error and probed lists (a boolean matrix) of unit vectors."""
        squared = self.to_centroids(units)
        own = squared.argmin(1)
        rest = units - self.centroids[own]
        codes = np.empty((len(units), len(self.splits)), np.uint8)
        error = np.zeros(len(units))
        for m, (part, book) in enumerate(zip(self.splits, self.codebooks, strict=True)):
            apart = np.maximum((rest[:, part] ** 2).sum(1)[:, None] - 2 * rest[:, part] @ book.T + (book**2).sum(1)[None], 0)
            codes[:, m] = apart.argmin(1)
            error += ((rest[:, part] - book[codes[:, m]]) ** 2).sum(1)
        border = (squared - squared[np.arange(len(units)), own][:, None]) / (2 * np.maximum(self.between[own], 1e-12))
        probes = border <= self.reach
        probes[np.arange(len(units)), own] = True
        return own, codes, np.sqrt(error), probes

    def distances(self, queries: np.ndarray, of_list: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to encoded vectors of a list."""
        rest = queries - self.centroids[of_list]
        found = np.zeros((len(queries), len(codes)))
        for m, (part, book) in enumerate(zip(self.splits, self.codebooks, strict=True)):
            lookup = np.maximum((rest[:, part] ** 2).sum(1)[:, None] - 2 * rest[:, part] @ book.T + (book**2).sum(1)[None], 0)
            found += lookup[:, codes[:, m]]
        return np.sqrt(found)


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def fit(units: np.ndarray, lists: int, radius: float, reach: float = REACH, seed: int = 7) -> Index:
    dims = units.shape[1]
    centroids = k_means(units, lists, 8, seed)
    between = np.sqrt(np.maximum(((centroids[:, None] - centroids[None]) ** 2).sum(-1), 0)) if len(centroids) <= 64 else _apart(centroids)
    splits = [slice(at, min(at + SUBSPACE, dims)) for at in range(0, dims, SUBSPACE)]
    index = Index(centroids, [], splits, reach * radius / np.sqrt(dims), between)
    rest = units - centroids[index.to_centroids(units).argmin(1)]
    index.codebooks = [k_means(rest[:, part], CODES, 6, seed + m) for m, part in enumerate(splits)]
    return index


def _apart(points: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * points @ points.T, 0))


def _close(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least query label reachable of queries and members in a boolean link matrix; members without a link get the size."""
    queries, none = np.arange(len(links)), len(links)
    while True:
        members = np.where(links, queries[:, None], none).min(0)
        following = np.minimum(queries, np.where(links, members[None], none).min(1))
        if (following == queries).all():
            return queries, members
        queries = following


def _vectors(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return flat.reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, lists: int = LISTS, reach: float = REACH) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector."""
    given = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = given.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    lengths = sorted(r[0] for r in usable.select(F.size("v")).distinct().collect())
    own = F.col("vec_id").alias("component_id")
    if not lengths:
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), own, F.col("vec_id").isNotNull().alias("kept"))
    known = _of_length(usable, lengths[0], cosine, sample, lists, reach)
    for dims in lengths[1:]:
        known = known.unionByName(_of_length(usable, dims, cosine, sample, lists, reach))
    rows = given.withColumn("_key", F.when(F.col("vec_id").isNotNull() & fine, F.col("v")))
    return rows.join(known, F.col("_key") == F.col("_v"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _of_length(usable: DataFrame, dims: int, cosine: float, sample: int, lists: int, reach: float) -> DataFrame:
    """(_v, n_links, component_id) of the distinct vectors of one length."""
    radius = float(np.sqrt(2 - 2 * cosine))
    usable = usable.where(F.size("v") == dims)
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "pq-classes")

    # Fit on a sample by hash, then encode every distinct vector.
    total = classes.count()
    sample = max(1, min(sample, VALUES // dims))
    share = min(1.0, sample / max(1, total))
    chosen = classes.where(F.xxhash64("v") / F.lit(2.0**64) + 0.5 <= share).orderBy("cid").limit(2 * sample).select("v").toArrow()
    if not chosen.num_rows:
        chosen = classes.select("v").limit(1).toArrow()
    points = _vectors(chosen.column("v").combine_chunks())
    index = fit(_units(points), max(1, min(lists, round(total**0.5), len(points))), radius, reach)

    def encode(batches: ArrowBatches) -> ArrowBatches:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _vectors(batch.column("v"))
            of_list, codes, error, probes = index.encode(_units(raw))
            columns = [
                *(batch.column(n) for n in ("cid", "copies", "v")),
                pa.array(of_list, pa.int32()),
                pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array(error),
                pa.array([np.flatnonzero(p).astype(np.int32) for p in probes], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "copies", "v", "list", "codes", "error", "probes"])

    coded = "cid bigint, copies bigint, v array<double>, list int, codes binary, error double, probes array<int>"
    rows = stored(classes.select("cid", "copies", "v").mapInArrow(encode, coded), "pq-rows")

    # A row per list, at most `lists` of them: tiles of its vectors, groups of its queries.
    held = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("q"))
    plan = held.join(asked, "list").select(
        F.col("list").alias("of_list"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.ceil(F.col("q") / GROUP).cast("int").alias("groups")
    )
    plan = F.broadcast(stored(plan, "pq-lists"))
    salt = F.xxhash64("cid")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    members = rows.join(plan, F.col("list") == F.col("of_list")).withColumn("tile", F.pmod(salt, F.col("tiles")).cast("int"))
    members = members.withColumn("group", F.explode(upto("groups"))).withColumn("query", F.lit(False))
    queries = rows.withColumn("of_list", F.explode("probes")).join(plan, "of_list").withColumn("group", F.pmod(salt, F.col("groups")).cast("int"))
    queries = queries.withColumn("tile", F.explode(upto("tiles"))).withColumn("query", F.lit(True))
    # Of a query only its id, copies, list and vector travel; of a member also codes and probes.
    names = ["of_list", "tile", "group", "query", "cid", "copies", "list", "v"]
    bare = queries.select(*names, F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("array<int>").alias("probes"))
    met = members.select(*names, "codes", "error", "probes").unionByName(bare)

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asking = group.column("query").to_numpy(zero_copy_only=False)
        here, there = group.filter(pa.array(~asking)), group.filter(pa.array(asking))
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not here.num_rows or not there.num_rows:
            return empty
        y, x = (_vectors(t.column("v").combine_chunks()) for t in (here, there))
        y, x = _units(y), _units(x)
        ids_y, ids_x = here.column("cid").to_numpy(), there.column("cid").to_numpy()
        copies_y, copies_x = here.column("copies").to_numpy(), there.column("copies").to_numpy()
        codes = np.stack([np.frombuffer(c, np.uint8) for c in here.column("codes").to_pylist()])
        error, of_list, lists_x = here.column("error").to_numpy(), int(here.column("of_list")[0].as_py()), there.column("list").to_numpy()
        probes = np.zeros((len(y), len(index.centroids)), bool)
        for i, p in enumerate(here.column("probes").to_pylist()):
            probes[i, p] = True
        n_y, n_x, a, b = np.zeros(len(y), np.int64), np.zeros(len(x), np.int64), [], []
        for at in range(0, len(x), _STEP):
            part = slice(at, at + _STEP)
            near = index.distances(x[part], of_list, codes) - error[None] <= radius + 1e-6
            i, j = np.nonzero(near)
            linked = np.zeros(near.shape, bool)
            for k in range(0, len(i), 65536):
                p, q = i[k : k + 65536], j[k : k + 65536]
                linked[p, q] = np.einsum("ij,ij->i", x[part][p], y[q]) >= cosine
            # A pair that both probe is found twice and counted where the smaller id asks.
            both = probes[:, lists_x[part]].T
            linked &= np.where(both, ids_x[part][:, None] < ids_y[None], ids_x[part][:, None] != ids_y[None])
            n_y += linked.T @ copies_x[part]
            n_x[part] = linked @ copies_y
            of_x, of_y = _close(linked)
            moved = np.flatnonzero(of_x != np.arange(len(of_x)))
            held = np.flatnonzero(of_y < len(of_x))
            a += [ids_x[part][moved], ids_y[held]]
            b += [ids_x[part][of_x[moved]], ids_x[part][of_y[held]]]
        a, b = (np.concatenate(s) for s in (a, b))
        counted = [(ids_y[n_y > 0], n_y[n_y > 0]), (ids_x[n_x > 0], n_x[n_x > 0])]
        rows = [(a, b, np.zeros(len(a), np.int64)), *((i, i, n) for i, n in counted)]
        return pa.table({c: pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64)) for k, c in enumerate("abn")})

    found = stored(met.groupBy("of_list", "tile", "group").applyInArrow(compare, "a bigint, b bigint, n bigint"), "pq-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    grouped = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cid")
    known = classes.join(counts, "cid", "left").join(grouped, "cid", "left").select(
        "v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")
    )
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    return known.join(named, "component").select(F.col("v").alias("_v"), "n_links", "component_id")


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square leaves the doubles."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1))[:, None]


def op8_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_embedding_near_dedup": (op8_embedding_near_dedup, None)}
