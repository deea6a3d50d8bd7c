"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of ``words`` 64-bit words over word shingles. Distinct fingerprints are
sorted into cells by population count; cells are cut into tiles of a bounded size, and
only tile pairs whose population counts lie within the radius are compared, each with
numpy exclusive-or and bit counts. A pair of tiles emits a spanning forest of its links,
never the links themselves, so a dense group costs at most one row per member and pair.

Null or empty texts have no word and the fingerprint zero, which links like any other.
Equal texts, equal rows and equal ids share a fingerprint row. A null id takes part
through its fingerprint; the component is named after the smallest non-null id in it
(null if there is none). Extra columns are ignored.

In ``alike`` the fingerprints only find candidates: a link also needs an exact Jaccard between the
two sets of shingles, ``short`` if one has fewer than ``few`` and ``long`` otherwise. Texts of one set
are one; sets that chains of near fingerprints connect meet in tiles of their own, each pair once,
and forests of what passes are closed again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrace.llm.common import WORD_BYTES_RE, ArrowBatches, stored, table
from pagetrace.llm.graph import components

#: ASCII upper case to lower case, nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Fingerprints in one tile: a task holds two tiles.
TILE = 16384
_STEP = 256
_CHUNK = 8192
#: Under ``few`` shingles a fingerprint has fewer voters than a word has bits; see ``alike``.
FLOORS = (64, 0.8, 0.5)
#: Sets of shingles, and hashes in them, in one tile where sets are compared.
SETS = 512
HASHES = 1 << 19


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the shingles, repeats included; none of a text without words."""
    words = WORD_BYTES_RE.findall(text.translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    slices = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[i:j], seed) for i, j in slices), np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes, shingle: int = 3, words: int = 1, strict: bool = True) -> list[int]:
    """A bit is 1 if set in over half of the shingle hashes; word ``k`` uses seed 42 + k.

    Not ``strict``: an even split goes with the first shingle, and a text without words has one
    empty shingle, so that very short texts do not crowd around the fingerprint zero.
    """
    return [_vote(shingle_hashes(text, shingle, SEED + k), SEED + k, strict) for k in range(words)]


def _vote(hashes: np.ndarray, seed: int, strict: bool) -> int:
    if not strict:
        first = hashes[:1] if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)
        hashes = hashes if len(hashes) % 2 else np.concatenate([first, hashes])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def word_columns(words: int) -> list[str]:
    return [f"w{k}" for k in range(words)]


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, key: str = "doc_id", strict: bool = True) -> DataFrame:
    """(key, w0, ...): the fingerprint words as signed longs."""
    names = word_columns(words)
    kind = dict(docs.select(key).dtypes)[key]

    def run(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            rows = [fingerprint((t or "").encode(), shingle, words, strict) for t in batch.column(1).to_pylist()]
            columns = np.array(rows, np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, k]) for k in range(words))], [key, *names])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in names))


def printed_sets(docs: DataFrame, shingle: int, words: int, key: str, strict: bool) -> DataFrame:
    """(key, w0, ..., shingles, size): also a digest of the set of shingle hashes, and how many there are."""
    names = word_columns(words)
    kind = dict(docs.select(key).dtypes)[key]

    def run(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            prints, digests, sizes = np.zeros((batch.num_rows, words), np.int64), [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                text = (text or "").encode()
                hashes = shingle_hashes(text, shingle, SEED)
                prints[row] = [_vote(shingle_hashes(text, shingle, SEED + k) if k else hashes, SEED + k, strict) for k in range(words)]
                hashes = np.unique(hashes)
                digests.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()))
                sizes.append(len(hashes))
            columns = [batch.column(0), *(pa.array(prints[:, k]) for k in range(words)), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [key, *names, "shingles", "size"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", shingles string, size bigint")


def node_of(columns: Sequence[Column]) -> Column:
    """The fingerprint as lower-case hex digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in columns))


def bands(words: int, radius: int) -> tuple[int, int]:
    """Segments per fingerprint and width of a band of population counts.

    A small radius tells many pairs apart, so both halves of each word are counted
    exactly; a large one needs bands of the whole count as wide as the radius.
    """
    return (2 * words, 1) if radius <= 4 and words == 1 else (1, radius + 1)


def cell_of(names: Sequence[str], radius: int) -> Column:
    """Cell number, one digit per segment in base 64 * words + 1."""
    segments, width = bands(len(names), radius)
    if segments == 1:
        count = sum((F.bit_count(n) for n in names[1:]), F.bit_count(names[0]))
        return F.floor(count / width).cast("int")
    low = F.bit_count(F.col(names[0]).bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned(names[0], 32))
    return (high * 33 + low).cast("int")


def cell_pairs(cells: Sequence[tuple[int, int]], words: int, radius: int) -> list[tuple[int, int, int, int]]:
    """(cell, tiles, cell, tiles) of the cells that can hold a link; at most 33 * 33 cells exist."""
    segments, width = bands(words, radius)

    def least(x: int, y: int) -> int:
        gap = lambda i, j: 0 if i == j else (abs(i - j) - 1) * width + 1
        if segments == 1:
            return gap(x, y)
        return gap(x // 33, y // 33) + gap(x % 33, y % 33)

    ordered = sorted(cells)
    return [(a, m, b, n) for i, (a, m) in enumerate(ordered) for b, n in ordered[i:] if least(a, b) <= radius]


def _forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as row numbers, of the links between two tiles of shape (rows, words).

    Rows of one ``label`` (those of ``right`` follow those of ``left``) are joined already; the labels of the
    outcome replace it.
    """
    offset = 0 if same else len(left)
    label = np.arange(len(left) + (0 if same else len(right))) if label is None else label
    # Rows are sorted by the counts of their quarter words and cut into blocks; two blocks whose
    # counts differ by more than the radius, summed over the quarters, hold no link.
    blocks = []
    for tile in (left, right):
        quarters = np.bitwise_count(np.ascontiguousarray(tile).view(np.uint16)).astype(np.int16)
        order = np.lexsort(quarters.T)
        starts = np.arange(0, len(order), _STEP)
        quarters = quarters[order]
        blocks.append((order, starts, np.minimum.reduceat(quarters, starts), np.maximum.reduceat(quarters, starts)))
    (order_a, starts_a, low_a, high_a), (order_b, starts_b, low_b, high_b) = blocks
    keep_a, keep_b = [], []
    for number, at in enumerate(starts_a.tolist()):
        rows = order_a[at : at + _STEP]
        apart = np.maximum(np.maximum(low_a[number] - high_b, low_b - high_a[number]), 0).sum(axis=1)
        for to in starts_b[apart <= radius].tolist():
            if same and to < at:
                continue
            columns = order_b[to : to + _STEP]
            if (label[rows, None] == label[None, offset + columns]).all():
                continue
            distance = np.bitwise_count(left[rows, 0, None] ^ right[None, columns, 0])
            for k in range(1, left.shape[1]):
                distance = distance + np.bitwise_count(left[rows, k, None] ^ right[None, columns, k])
            close = distance <= radius
            # A step for each row that still links different trees, not for each pair.
            for i in np.flatnonzero((close & (label[rows, None] != label[None, offset + columns])).any(axis=1)):
                own, near = label[rows[i]], columns[close[i]]
                others, first = np.unique(label[offset + near], return_index=True)
                new = others != own
                if new.any():
                    keep_a.append(np.full(new.sum(), rows[i]))
                    keep_b.append(near[first[new]])
                    label[np.isin(label, others[new])] = own
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *keep_a]), np.concatenate([none, *keep_b])


def links(distinct: DataFrame, radius: int, words: int = 1, tile: int = TILE) -> DataFrame:
    """(a, b) hex fingerprints: forests of the pairs at ``radius`` or fewer differing bits."""
    spark = distinct.sparkSession
    names = word_columns(words)
    placed = distinct.select(*names, cell_of(names, radius).alias("cell"))
    counts = [(r["cell"], r["n"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]
    # Few cells still spread over the cores.
    spread = max(1, 2 * spark.sparkContext.defaultParallelism // max(1, len(counts)))
    cells = [(c, max(-(-n // tile), min(spread, -(-n // 2048)))) for c, n in counts]
    tiles_of = spark.createDataFrame(cells, "cell int, tiles int")
    tiles = (
        placed.join(F.broadcast(tiles_of), "cell")  # at most 33 * 33 rows
        .groupBy("cell", F.pmod(F.xxhash64(*names), F.col("tiles")).cast("int").alias("tile"))
        .agg(F.collect_list(F.struct(*names)).alias("rows"))
    )
    ends = [f"{s}{k}" for s in "xy" for k in range(words)]

    def words_of(rows: pa.Array) -> np.ndarray:
        return np.stack([rows.field(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names], axis=1)

    def between(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        found = [*(x[a, k] for k in range(words)), *(y[b, k] for k in range(words))]
        return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in found]

    def close(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            labels, inner = [], []
            for rows in batch.column("rows"):
                x = words_of(rows.values)
                labels.append(np.arange(len(x)))
                a, b = _forest(x, x, True, radius, labels[-1])
                inner.append(pa.StructArray.from_arrays(between(x, x, a, b), ends).to_pylist())
            kinds = [pa.list_(pa.int64()), pa.list_(pa.struct([(n, pa.int64()) for n in ends]))]
            added = [pa.array(v, kind) for v, kind in zip((labels, inner), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "labels", "inner"])

    # Each tile is closed by itself first, so that two tiles need a link only where they join what is still apart.
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    link = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ends]))
    closed = T.StructType([*tiles.schema.fields]).add("labels", T.ArrayType(T.LongType())).add("inner", link)
    tiles = stored(tiles.repartition(count, "cell", "tile").mapInArrow(close, closed), "simhash-tiles")
    inner = tiles.select(F.explode("inner").alias("_l")).select("_l.*")
    tiles = tiles.drop("inner")
    # Each tile goes once to every pair it is in; the pairs of cells are as few as the cells.
    pairs = F.broadcast(spark.createDataFrame(cell_pairs(cells, words, radius), "a int, na int, b int, nb int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = tiles.join(pairs, F.col("cell") == F.col("a")).withColumn("i", F.col("tile")).withColumn("j", F.explode(upto("nb")))
    right = tiles.join(pairs, F.col("cell") == F.col("b")).withColumn("j", F.col("tile")).withColumn("i", F.explode(upto("na")))
    # Of two tiles of one cell the lower is on the left.
    left, right = left.where("a < b OR i < j"), right.where("a < b OR i < j")
    keys = ["a", "i", "b", "j"]
    sides = [side.select(*keys, F.lit(n).alias("side"), "rows", "labels") for n, side in enumerate((left, right))]
    # A pair is much work for its bytes, so its partitions are not to be merged by size.
    met = sides[0].unionByName(sides[1]).repartition(count, *keys)

    def compare(pair: pa.Table) -> pa.Table:
        pair = pair.combine_chunks()
        at = {side: n for n, side in enumerate(pair.column("side").to_pylist())}
        x, y = (words_of(pair.column("rows")[at[side]].values) for side in (0, 1))
        own, other = (pair.column("labels")[at[side]].values.to_numpy(zero_copy_only=False) for side in (0, 1))
        a, b = _forest(x, y, False, radius, np.concatenate([own, len(x) + other]))
        return pa.table(between(x, y, a, b), ends)

    found = inner.unionByName(met.groupBy(*keys).applyInArrow(compare, ", ".join(f"{n} bigint" for n in ends)))
    return found.select(
        node_of([F.col(f"x{k}") for k in range(words)]).alias("a"), node_of([F.col(f"y{k}") for k in range(words)]).alias("b")
    )


def near_duplicates(
    docs: DataFrame, radius: int = 2, shingle: int = 3, words: int = 1, tile: int = TILE, key: str = "doc_id", strict: bool = True
) -> DataFrame:
    """(key, fingerprint, component_id): component_id is the smallest key reachable over links."""
    names = word_columns(words)
    prints = stored(fingerprints(docs, shingle, words, key, strict), "simhash")
    distinct = prints.groupBy(*names).agg(F.min(key).alias("least"))
    distinct = stored(distinct, "simhash-distinct")
    found = components(links(distinct, radius, words, tile))
    node = node_of([F.col(n) for n in names])
    # Fingerprints without a link to another are their own component.
    grouped = distinct.select(*names, node.alias("node"), "least").join(found, "node", "left")
    grouped = grouped.select(*names, F.coalesce("component", "node").alias("component"), "least")
    named = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    return prints.join(named.select(*names, "component_id"), names, "left").select(key, node.alias("fingerprint"), "component_id")


def _alike(sets: list[np.ndarray], prints: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, floors: tuple[int, float, float], label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows ``left`` and rows ``right`` (the same rows, or none in common).

    Rows of one ``label`` are joined already; the labels of the outcome replace it.
    """
    sizes = np.array([len(s) for s in sets])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(numbers, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(numbers), bool)
    (few, short, long), same, found = floors, np.array_equal(left, right), []
    for i in left.tolist():
        others = right[right > i] if same else right
        others = others[label[others] != label[i]]
        # No Jaccard is above the sizes' ratio.
        smaller = np.minimum(sizes[others], sizes[i])
        others = others[smaller >= np.where(smaller < few, short, long) * np.maximum(sizes[others], sizes[i]) - 1e-6]
        others = others[np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1, dtype=np.int64) <= radius]
        mark[parts[i]] = True
        for j in others.tolist():
            if label[j] == label[i]:
                continue
            both = int(np.count_nonzero(mark[parts[j]]))
            if both and both / int(sizes[i] + sizes[j] - both) >= (short if min(sizes[i], sizes[j]) < few else long):
                label[label == label[j]] = label[i]
                found.append((i, j))
        mark[parts[i]] = False
    return found


def set_links(docs: DataFrame, contents: DataFrame, radius: int, shingle: int, words: int, key: str, floors: tuple[int, float, float]) -> DataFrame:
    """(a, b) digests of sets of shingles: forests of the links among the ``contents`` of each group.

    contents: (w0, ..., shingles, size, key, group), a row per fingerprint and set, ``key`` a document with both.
    """
    names = word_columns(words)
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / SETS), F.ceil(F.sum("size") / HASHES)).cast("int")
    groups = contents.groupBy("group").agg(F.count(F.lit(1)).alias("n"), tiles.alias("tiles")).where("n > 1").drop("n")
    members = contents.join(groups, "group").withColumn("tile", F.pmod(F.xxhash64("shingles", *names), F.col("tiles")).cast("int"))
    members = members.select("group", "tiles", "tile", "shingles", *names, key).join(docs.select(key, "text"), key)

    def hashed(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            sets = [np.unique(shingle_hashes((t or "").encode(), shingle, SEED)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("group", "tiles", "tile", "shingles", *names)), pa.array(sets, pa.list_(pa.int64()))],
                ["group", "tiles", "tile", "shingles", *names, "hashes"],
            )

    row = "shingles string, " + ", ".join(f"{n} bigint" for n in names) + ", hashes array<bigint>"
    members = members.select("group", "tiles", "tile", "shingles", *names, "text").mapInArrow(hashed, "group string, tiles int, tile int, " + row)
    # A row a tile; one of a group of several meets each of the others once, on the partition of the pair.
    held = members.groupBy("group", "tiles", "tile").agg(F.collect_list(F.struct("shingles", *names, "hashes")).alias("rows"))

    def linked(sides: list[pa.Array], label: np.ndarray) -> list[tuple[str, str]]:
        rows = pa.concat_arrays(sides)
        digests = rows.field("shingles").to_pylist()
        prints = np.stack([rows.field(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names], axis=1)
        lists = rows.field("hashes")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        sets = [flat[at:to] for at, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        every, cut = np.arange(len(sets)), len(sides[0])
        left, right = (every, every) if len(sides) == 1 else (every[:cut], every[cut:])
        return [(digests[i], digests[j]) for i, j in _alike(sets, prints, left, right, radius, floors, label)]

    def close(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            labels, inner = [], []
            for rows in batch.column("rows"):
                labels.append(np.arange(len(rows)))
                inner.append([{"a": a, "b": b} for a, b in linked([rows.values], labels[-1])])
            added = [pa.array(labels, pa.list_(pa.int64())), pa.array(inner, pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "labels", "inner"])

    # Each tile is closed by itself first; two tiles then need a link only where they join what is still apart.
    link = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in "ab"]))
    closed = T.StructType([*held.schema.fields]).add("labels", T.ArrayType(T.LongType())).add("inner", link)
    held = stored(held.mapInArrow(close, closed), "simhash-sets")
    alone = held.select(F.explode("inner").alias("_l")).select("_l.*")
    several = held.where("tiles > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("tile <> other")
    i, j = F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")
    several = several.groupBy("group", i, j).agg(F.collect_list(F.struct("rows", "labels")).alias("sides"))
    # A number without rows has no pairs.
    several = several.where(F.size("sides") == 2).select(*[F.col("sides")[n][c].alias(f"{c}{n}") for n in (0, 1) for c in ("rows", "labels")])

    def compare(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            found = []
            for x, own, y, other in zip(*batch.columns, strict=True):
                label = np.concatenate([own.values.to_numpy(zero_copy_only=False), len(x) + other.values.to_numpy(zero_copy_only=False)])
                found += linked([x.values, y.values], label)
            yield pa.RecordBatch.from_arrays([pa.array([pair[n] for pair in found], pa.string()) for n in (0, 1)], ["a", "b"])

    return alone.unionByName(several.mapInArrow(compare, "a string, b string"))


def alike(
    docs: DataFrame, radius: int, shingle: int, words: int, floors: tuple[int, float, float] = FLOORS, tile: int = TILE, key: str = "doc_id", strict: bool = False
) -> DataFrame:
    """(key, fingerprint, component_id) as of near_duplicates, over links that pass ``floors`` (few, short, long). Keys are distinct."""
    names = word_columns(words)
    prints = stored(printed_sets(docs, shingle, words, key, strict), "simhash")
    contents = stored(prints.groupBy(*names, "shingles", "size").agg(F.min(key).alias(key)), "simhash-contents")
    distinct = stored(contents.select(*names).distinct(), "simhash-distinct")
    near = components(links(distinct, radius, words, tile)).withColumnRenamed("component", "group")
    node = node_of([F.col(n) for n in names])
    grouped = contents.withColumn("node", node).join(near, "node", "left").withColumn("group", F.coalesce("group", "node")).drop("node")
    grouped = stored(grouped, "simhash-groups")
    found = components(set_links(docs, grouped, radius, shingle, words, key, floors)).withColumnRenamed("node", "shingles")
    sets = contents.groupBy("shingles").agg(F.min(key).alias("first")).join(found, "shingles", "left")
    sets = sets.withColumn("component", F.coalesce("component", "shingles"))
    named = sets.join(sets.groupBy("component").agg(F.min("first").alias("component_id")), "component")
    return prints.join(named.select("shingles", "component_id"), "shingles", "left").select(key, node.alias("fingerprint"), "component_id")


def op4_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_near_dedup": (op4_simhash_near_dedup, None)}
