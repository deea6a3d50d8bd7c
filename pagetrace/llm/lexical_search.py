r"""Ranked lexical search by presence masks.

Terms are runs of letters and digits, A-Z lower-cased. One pass over the documents keeps, for each
document, its length and its postings: those of its terms that some item asks for, with their
counts. Document frequencies and lengths are sums over these rows, so they cover every document.

A second pass reads the postings in blocks of ``BLOCK`` documents. For an item, each of its terms
sets one bit in the masks of the documents that hold it, and documents with equal masks form a
group: all of a group hold the same terms, so the sum of the terms' highest contributions in the
block bounds their scores. Groups are evaluated by falling bounds until the k-th score found
is above every bound left; what ties with it is still evaluated. So a block gives its exact k best,
and the k best of all blocks are the answer. No pair of item and document leaves a block otherwise.

Items are asked in parts of ``PART_TERMS`` terms at most, each with passes of its own: what a task
needs to know of the items is bounded. Scores are whole numbers, exact where they fit 63 bits.

Items are rows, also where ids repeat: each has its own ranks. Null and wordless texts have no term,
neither match nor count. Documents without id count and may be found, last among ties; rows with equal
ids are documents of their own. Empty tables give no row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetrace.llm.common import ArrowBatches, stored, table
from pagetrace.llm.words import word_lists

K = 20
#: Documents that meet an item at once, at most.
BLOCK = 8192
#: Terms of items, repeats not counted, that are asked in one pass.
PART_TERMS = 200_000
#: Documents evaluated at least before the bounds are looked at again.
STEP = 64
POSTINGS = "doc_id bigint, n_terms bigint, terms array<int>, counts array<bigint>"


def counted(text: str | None) -> tuple[int, Counter[bytes]]:
    n, found = 0, Counter()
    for words in word_lists(text):
        n += len(words)
        found.update(words)
    return n, found


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, counts): the distinct terms of every item that has any; item numbers the rows."""

    def split(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            found = [sorted(counted(text.as_py())[1].items()) for text in batch.column("text")]
            terms = pa.array([[t.decode() for t, _ in own] for own in found], pa.list_(pa.string()))
            counts = pa.array([[n for _, n in own] for own in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), terms, counts], ["item", "item_id", "terms", "counts"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint").alias("item_id"), "text")
    kind = "item bigint, item_id bigint, terms array<string>, counts array<bigint>"
    return rows.mapInArrow(split, kind).where(F.size("terms") > 0)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """One row per document with terms: its length, and the numbers, ascending, and counts of its terms in ``numbers``."""

    def keep(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            lengths, sizes, terms, counts = [], [], [], []
            for text in batch.column("text"):
                n, found = counted(text.as_py())
                known = sorted((numbers[w], found[w]) for w in found.keys() & numbers.keys())
                lengths.append(n)
                sizes.append(len(known))
                terms += [t for t, _ in known]
                counts += [c for _, c in known]
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n_terms", "terms", "counts"])
            yield out.filter(pa.array(np.array(lengths, np.int64) > 0))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(keep, POSTINGS)


def damping(n_terms: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 25 + (25 * n * N) div L of each length n."""
    if int(n_terms.max(initial=0)) * 25 * documents < 2**63:
        return 75 + 25 * n_terms * documents // total
    return np.array([75 + 25 * n * documents // total for n in n_terms.tolist()], np.int64)


class Block:
    """Postings of some documents by document and by term, with each posting's share of a score."""

    def __init__(self, n_terms: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, total: int) -> None:
        self.size, self.lengths, self.terms = len(lengths), lengths, terms
        self.starts = np.cumsum(lengths) - lengths
        rows = np.repeat(np.arange(self.size), lengths)
        self.share = 10**9 * counts // (1000 * counts + 12 * damping(n_terms, documents, total)[rows])
        order = np.argsort(terms, kind="stable")
        self.rows = rows[order]
        found, starts = np.unique(terms[order], return_index=True)
        ends = np.append(starts, len(order))[1:]
        most = np.maximum.reduceat(self.share[order], starts) if len(found) else np.zeros(0, np.int64)
        #: term -> (first, end) of its rows, highest share
        self.of_term = {t: (a, b, m) for t, a, b, m in zip(found.tolist(), starts.tolist(), ends.tolist(), most.tolist(), strict=True)}

    def masks(self, slots: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, number of each one's mask, the distinct masks as rows of 0 and 1 per slot)."""
        bits = np.zeros((self.size, -(-len(slots) // 64)), np.uint64)
        for j, term in enumerate(slots):
            a, b, _ = self.of_term[term]
            # A term names a document once, so no bit is lost.
            bits[self.rows[a:b], j // 64] |= np.uint64(1 << j % 64)
        held = np.flatnonzero(bits.any(axis=1))
        distinct, number = np.unique(bits[held, 0], return_inverse=True) if bits.shape[1] == 1 else np.unique(bits[held], axis=0, return_inverse=True)
        distinct = distinct.reshape(len(distinct), -1)
        every = np.arange(len(slots))
        return held, number.reshape(-1), distinct[:, every // 64] >> (every % 64).astype(np.uint64) & np.uint64(1)

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold a term each; weights by term number."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + lengths, lengths)
        return np.add.reduceat(weights[self.terms[at]] * self.share[at], ends - lengths)


def block_best(block: Block, ids: np.ndarray, terms: list[int], weights: list[int], scratch: np.ndarray, k: int, step: int = STEP) -> list[tuple[int, int]]:
    """(score, row): the k best of the block by score, then by ``ids`` (whose order is that of ties); scores above 0."""
    asked = [(t, w) for t, w in zip(terms, weights, strict=True) if w > 0 and t in block.of_term]
    if not asked:
        return []
    slots, own = [t for t, _ in asked], np.array([w for _, w in asked], np.int64)
    held, number, masks = block.masks(slots)
    most = own * np.array([block.of_term[t][2] for t in slots], np.int64)
    bounds = masks.astype(np.int64) @ most
    by_bound = np.argsort(-bounds, kind="stable")
    place = np.empty(len(bounds), np.int64)
    place[by_bound] = np.arange(len(bounds))
    # Documents in the order of their groups' bounds, and where each group ends.
    order = np.argsort(place[number], kind="stable")
    ends = np.cumsum(np.bincount(place[number], minlength=len(bounds)))
    scratch[slots] = own
    best: list[tuple[int, int, int]] = []
    group = at = 0
    while group < len(bounds):
        if len(best) == k and -best[-1][0] > bounds[by_bound[group]]:
            break
        group = max(group + 1, int(np.searchsorted(ends, at + step, "left")))
        upto = int(ends[min(group, len(ends)) - 1])
        rows = held[order[at:upto]]
        found = block.scores(rows, scratch)
        best += [(-s, i, r) for s, i, r in zip(found.tolist(), ids[rows].tolist(), rows.tolist(), strict=True) if s > 0]
        best = sorted(best)[:k]
        at = upto
    scratch[slots] = 0
    return [(-s, r) for s, _, r in best]


def _parts(items: DataFrame, most: int) -> Iterator[list]:
    """The items' rows in parts of about ``most`` terms: parts are dealt by a hash of the item's number."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-total // most))
    for part in range(parts):
        if rows := items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect():
            yield rows


def _asked(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best of each block for a bounded list of items."""
    numbers = {t: i for i, t in enumerate(sorted({t for row in asked for t in row["terms"]}))}
    kept = stored(postings(docs, {t.encode(): i for t, i in numbers.items()}), "lexical-postings")
    documents, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # One number for each term asked.
    held = dict(kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = {i: math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1))) for i in numbers.values()}
    plan = []
    for row in asked:
        terms = [numbers[t] for t in row["terms"]]
        plan.append((row["item"], row["item_id"], terms, [weight[t] * n for t, n in zip(terms, row["counts"], strict=True)]))
    n_terms = len(numbers)

    def search(given: ArrowBatches) -> ArrowBatches:
        scratch = np.zeros(n_terms, np.int64)
        for whole in given:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                lengths, terms = _flat(batch.column("terms"))
                block = Block(batch.column("n_terms").to_numpy(), lengths, terms, _flat(batch.column("counts"))[1], documents, total)
                doc_ids = batch.column("doc_id")
                ties = doc_ids.fill_null(2**63 - 1).to_numpy()
                found = []
                for item, item_id, own, weights in plan:
                    found += [(item, item_id, row, score) for score, row in block_best(block, ties, own, weights, scratch, k)]
                if found:
                    item, item_id, rows, score = zip(*found, strict=True)
                    columns = [pa.array(item, pa.int64()), pa.array(item_id, pa.int64()), doc_ids.take(pa.array(rows, pa.int64())), pa.array(score, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return kept.mapInArrow(search, "item bigint, item_id bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, part_terms: int = PART_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    best = None
    for asked in _parts(stored(item_terms(items), "lexical-items"), part_terms):
        found = _asked(docs, asked, k)
        best = found if best is None else best.unionByName(found)
    if best is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranks = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT r, doc_id, term, COUNT(*) AS tf FROM docs GROUP BY ALL),
lengths AS (SELECT r, SUM(tf)::BIGINT AS n FROM counts GROUP BY r),
stats AS (SELECT COUNT(*)::BIGINT AS docs, SUM(n)::BIGINT AS total FROM lengths),
damped AS (SELECT r, 75 + (25 * n * docs) // total AS m FROM lengths, stats),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * COUNT(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, stats GROUP BY term, docs),
asked AS (
  SELECT i, item_id, term, COUNT(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT i, item_id, r, doc_id, SUM(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN damped USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op13_lexical_search": (op13_lexical_search, SQL)}
