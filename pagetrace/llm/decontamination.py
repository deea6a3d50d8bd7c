r"""Benchmark decontamination by a broadcast hash set of n-grams, in DataFrame operations only.

Words are runs of letters and digits (all of ASCII else separates), A-Z lower-cased. A test item
gives its windows of ten consecutive words, an item of fewer words, but not none, itself. The
distinct windows are a broadcast hash set, preceded by one bit a window at the place its hash
names. A document's windows are hashed inside its row, from the hashes of their halves; those
whose bit is set become rows and are looked up in the set by their words, so every hit is
verified. Windows are broadcast in parts of ``PART_BYTES`` of text at most: a larger test set
takes one scan of the documents for each part.

Only hits leave the scan, with one more row for each document that carries what the caller wants
back. Windows that occur in the same items are one class, and classes that documents hit together
are turned into item lists once for each distinct set, not for each document: a passage that
stands in a third of all documents is resolved once.

Null and wordless texts have no words and no hits. Rows are documents of their own, also where
ids repeat or are null. Items are told apart by id: rows of one id are one item, an item
without id marks words but is not listed. Ties do not arise. Empty tables give no row or no
hit. Extra columns of either table, whatever their names, are ignored or carried as they are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.llm.common import stored, table

#: Runs of these part words: all of ASCII but digits and, in the text as it stands, letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
SIZE = 10
#: Text of windows that is broadcast at once, at most.
PART_BYTES = 32 * 2**20
NO_ITEM = ""


def written_words(text: Column) -> Column:
    """Words as they stand. Splitting is several times as fast as matching them by a negated class."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def words_of(text: Column) -> Column:
    """Words with A-Z, and nothing else, lower-cased."""
    return written_words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _window(words: Column, at: Column, size: Column | int) -> Column:
    return F.slice(words, at, F.lit(size) if isinstance(size, int) else size)


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(gram, n, item_id): every window of every item, as words joined by a space."""
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(size))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - n + 1))
    rows = worded.select("item_id", "words", n.alias("n"), at.alias("at"))
    return rows.select(F.array_join(_window(F.col("words"), F.col("at"), F.col("n")), " ").alias("gram"), "n", "item_id").distinct()


def classes_of(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n, class) and (class, item_id): windows that occur in the same items form a class."""
    listed = F.array_sort(F.collect_set("item_id"))
    grams = windows.groupBy("gram", "n").agg(listed.alias("ids"))
    named = stored(grams.withColumn("class", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)), "leak-grams")
    items = named.groupBy("class").agg(F.first("ids").alias("ids")).select("class", F.explode("ids").alias("item_id"))
    return named.drop("ids"), items


def _with_hashes(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds h<n> for each n: an array whose i-th entry hashes the words i .. i + n - 1, from halves; too short at the end."""

    def joined(left: str, right: str, shift: int) -> Column:
        return F.transform(left, lambda h, i: F.xxhash64(h, F.get(F.col(right), i + shift)))

    def add(rows: DataFrame, n: int) -> DataFrame:
        if f"h{n}" in rows.columns:
            return rows
        rows = add(rows, 1 if n == 2 else n - 1 if n % 2 else n // 2)
        left = n - 1 if n % 2 else n // 2
        return rows.select("*", joined(f"h{left}", f"h{n - left}", left).alias(f"h{n}"))

    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    for n in sorted(sizes):
        rows = add(rows, n)
    return rows


def _slot(h: Column, mask: int) -> Column:
    return F.shiftright(h, 6).bitwiseAND(F.lit(mask).cast("bigint"))


def _bits(grams: DataFrame, sizes: list[int]) -> tuple[Column, int]:
    """One bit a window in an array of 64-bit numbers, by hash, and the mask of its slots; 64 bits or more for each window."""
    mask = 2 ** max(10, (max(1, grams.count()) - 1).bit_length()) - 1
    own = F.lit(None).cast("bigint")
    for n in sizes:
        own = F.when(F.col("n") == n, F.get(F.col(f"h{n}"), F.lit(0))).otherwise(own)
    hashed = _with_hashes(grams.select("n", F.split("gram", " ").alias("words")), sizes).select(own.alias("h"))
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    numbers = [0] * (mask + 1)
    for row in hashed.groupBy(_slot(F.col("h"), mask).alias("slot")).agg(F.bit_or(bit).alias("bits")).collect():
        numbers[row["slot"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>"), mask


def _hits(docs: DataFrame, grams: DataFrame, sizes: list[int], with_documents: bool) -> DataFrame:
    """(row, document, hit, class): a row for each hit, and one with the document and the number of its words."""
    bits, mask = _bits(grams, sizes)
    rows = _with_hashes(docs, sizes)
    none = F.array().cast("array<int>")

    def likely(n: int) -> Column:
        def marked(i: Column) -> Column:
            h = F.get(F.col(f"h{n}"), i)
            return F.getbit(F.get(bits, _slot(h, mask).cast("int")), h.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1

        def window(i: Column) -> Column:
            gram = F.array_join(_window(F.col("words"), i + 1, n), " ")
            return F.struct(i.alias("pos"), F.lit(n).alias("n"), gram.alias("gram"), F.lit(None).cast(kind).alias("document"))

        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(none)
        return F.transform(F.filter(starts, marked), window)

    document = F.struct("carried", F.size("words").alias("n_words"))
    kind = docs.select(document.alias("d")).schema["d"].dataType
    own = F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("gram"), document.alias("document"))
    found = F.concat(*(likely(n) for n in sizes), *([F.array(own)] if with_documents else []))
    each = rows.select("row", F.explode(found).alias("f")).select("row", "f.*")
    # What the bits let through counts only if the words themselves are a window.
    met = each.join(F.broadcast(grams), ["gram", "n"], "left").where("class IS NOT NULL OR gram IS NULL")
    return met.select("row", "document", F.when(F.col("class").isNotNull(), F.struct("pos", "n")).alias("hit"), "class")


def scan(docs: DataFrame, items: DataFrame, carry: list[str], size: int = SIZE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``carry`` columns of docs with _n_words, _hit (sorted numbers of the hit words, from 0), _n_items and _items_sha256."""
    grams, members = classes_of(item_windows(items, size))
    stats = grams.agg(F.coalesce(F.sum(F.octet_length("gram") + 128), F.lit(0)), F.sort_array(F.collect_set("n"), asc=False)).first()
    parts, sizes = max(1, -(-stats[0] // part_bytes)), stats[1]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*carry).alias("carried"), "text")
    if parts > 1:
        rows = stored(rows, "leak-rows")
    rows = rows.select("row", "carried", words_of(F.col("text")).alias("words"))
    found = _hits(rows, grams.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == 0), sizes or [size], True)
    for part in range(1, parts):
        found = found.unionByName(_hits(rows, grams.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part), sizes, False))
    of_row = found.groupBy("row").agg(
        F.first("document", ignorenulls=True).alias("document"),
        F.collect_list("hit").alias("hits"), F.array_sort(F.collect_set("class")).alias("classes"),
    )
    covered = F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["n"] - 1)))
    per_row = stored(of_row.select("document.carried", "document.n_words", F.array_sort(F.array_distinct(covered)).alias("hit"), "classes"), "leak-hits")
    sets = per_row.where(F.size("classes") > 0).select("classes").distinct()
    ids = sets.select("classes", F.explode("classes").alias("class")).join(members, "class").select("classes", F.col("item_id").cast("string").alias("item_id"))
    listed = ids.groupBy("classes").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    digests = listed.select(F.col("classes").alias("_classes"), F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("digest"))
    # Documents without a hit, the most of them, have no set to look up.
    none = per_row.where(F.size("classes") == 0).select("*", F.lit(0).cast("bigint").alias("n_items"), F.sha2(F.lit(NO_ITEM), 256).alias("digest"))
    joined = per_row.where(F.size("classes") > 0).join(digests, F.col("classes") == F.col("_classes"), "left").drop("_classes").unionByName(none)
    return joined.select(
        *(F.col(f"carried.`{c}`").alias(c) for c in carry),
        F.col("n_words").cast("bigint").alias("_n_words"),
        F.col("hit").alias("_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("_n_items"),
        F.coalesce("digest", F.sha2(F.lit(NO_ITEM), 256)).alias("_items_sha256"),
    )


def without_words(text: Column, hit: Column) -> Column:
    """``text`` without the words of the numbers in ``hit`` and the separators behind them."""
    words, parts = written_words(text), F.split(text, WORD)
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    rest = F.transform(F.array_except(every, hit), lambda i: F.concat(F.get(words, i), F.get(parts, i + 1)))
    return F.when(F.size(hit) > 0, F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def without_spans(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with the contaminated words cut out of their texts; documents without any stay as they are."""
    found = scan(docs, items, docs.columns, size)
    return found.withColumn("text", without_words(F.col("text"), F.col("_hit"))).select(*docs.columns)


def without_documents(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = 0.0) -> DataFrame:
    """``docs`` without those of whose words more than ``share`` are hit."""
    found = scan(docs, items, docs.columns, size)
    return found.where(F.size("_hit") <= share * F.col("_n_words")).select(*docs.columns)


def op11_benchmark_decontamination(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.size("_hit").cast("bigint")
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_n_items").alias("n_items"),
        F.col("_items_sha256").alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
item_at AS (SELECT item_id, ws, LEAST(len(ws), 10) AS n, unnest(generate_series(1, len(ws) - LEAST(len(ws), 10) + 1)) AS i FROM items WHERE len(ws) > 0),
grams AS (SELECT DISTINCT n, array_to_string(ws[i : i + n - 1], ' ') AS gram, item_id FROM item_at),
sizes AS (SELECT DISTINCT n FROM grams),
doc_at AS (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM docs, sizes WHERE len(ws) >= n),
hits AS (SELECT d.r, d.i, d.n, g.item_id FROM (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM doc_at) d JOIN grams g USING (n, gram)),
hit_words AS (SELECT r, COUNT(DISTINCT w) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS w FROM hits) GROUP BY r),
hit_items AS (SELECT r, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

QUERIES = {"op11_benchmark_decontamination": (op11_benchmark_decontamination, SQL)}
