"""Files, snapshots, upserts, reports and composed plans."""

import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import dialogue as D
from pagetrace.operators.recall import read_snapshot
from pagetrace.operators.review import store_results
from pagetrace.plans.reports import performance_report, recall_audit
from pagetrace.sources.stores import read_database, read_images, write_report
from pagetrace.streaming import jobs as J


def test_recall_of_a_snapshot_file(spark, tmp_path):
    def region(audit_id, found, classification, quality=None):
        return {"audit_id": audit_id, "detected_region_ids": found, "classification": classification, "text_quality": quality}

    page = {
        "filename": "p1.jpg", "reading_order": "WRONG", "important_ocr_blocks": 4, "assigned_important_ocr_blocks": 3, "ignored_meaningful_blocks": 1,
        "expected_regions": [region("a", [1], "DETECTED", "COMPLETE"), region("b", [1, 2], "DETECTED_PARTIAL", "GARBLED"),
                             region("c", [3], "DETECTED", "COMPLETE"), region("d", [], "OCR_MISSING")],
    }
    empty = {**page, "filename": "p2.jpg", "reading_order": "CORRECT", "important_ocr_blocks": 0, "assigned_important_ocr_blocks": 0,
             "ignored_meaningful_blocks": 0, "expected_regions": []}
    path = tmp_path / "audit.json"
    path.write_text(json.dumps({"pages": [page, empty]}))
    pages, regions = read_snapshot(spark, str(path))
    out = recall_audit(regions, pages)
    first = {r.filename: r for r in out["pages"].collect()}
    assert (first["p1.jpg"].detected_expected_regions, first["p1.jpg"].merge_errors, first["p1.jpg"].split_errors) == (3, 1, 1)
    assert (first["p2.jpg"].bubble_recall, first["p2.jpg"].missing_dialogue_rate) == (1.0, 0.0)
    total = out["aggregate"].first()
    assert (total.bubble_recall, total.missing_dialogue_rate, total.ocr_block_coverage, total.reading_order_errors) == (0.75, 0.25, 0.75, 1)
    assert (total.ocr_missing, total.partial_dialogues) == (1, 1)


def test_run_report(spark):
    stages = spark.createDataFrame(
        [(1, 1, "a", "ocr", 1.0, True), (1, 2, "a", "ocr", 2.0, True), (1, 3, "b", "vision_layout", 5.0, False), (1, 4, None, "reliability_total", 99.0, True)],
        "run_id int, ord int, asset_id string, stage string, duration_seconds double, success boolean")
    calls = spark.createDataFrame([(1, 1, "a", "vision_layout", 1, 0.5), (1, 2, "a", "vision_layout", 2, 0.5)],
                                  "run_id int, ord int, asset_id string, stage string, attempt int, duration_seconds double")
    out = performance_report(stages, calls)
    assert {r.stage: r.work_seconds for r in out["stage_work"].collect()} == {"ocr": 3.0, "vision_layout": 5.0}
    slow = out["slowest"].first()
    assert (slow.slowest_stage, slow.slowest_page) == ("vision_layout", "b")
    assert out["call_totals"].first().retry_count == 1
    assert out["page_calls"].first().layout_calls == 2
    outcome = out["outcomes"].first()
    assert (outcome.completed_assets, outcome.failed_assets) == (0, 1)
    assert out["failure"].first().failure_stage == "vision_layout"


def test_images_by_extension(spark, tmp_path):
    for name in ("a.JPG", "b.webp", "c.gif", "d.txt", "e.jPeG"):
        (tmp_path / name).write_bytes(b"x" + name.encode())
    rows = read_images(spark, str(tmp_path)).collect()
    assert sorted(r.filename for r in rows) == ["a.JPG", "b.webp", "e.jPeG"]
    assert all(bytes(r.content) == b"x" + r.filename.encode() for r in rows)


def test_report_is_replaced(spark, tmp_path):
    path = str(tmp_path / "report")
    for value in (1, 2):
        write_report(spark.range(1).select(F.lit(value).alias("v")), path)
    assert [r.v for r in spark.read.json(path).collect()] == [2]


FEED = "id bigint, asset_id bigint, region_id bigint, verified_text string, created_at string"


def feed_files(spark, folder, rows, schema):
    """A file a row, in the given order of arrival."""
    for n, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(str(folder))


def test_late_and_repeated_verifications_reach_the_truth_table(spark, tmp_path):
    days = [10, 11, 12, 1, 11]
    rows = [(n if n < 4 else 1, 1, n % 4, f"t{n % 4}", f"2024-01-{d:02d}T00:00:00") for n, d in enumerate(days)]
    feed = feed_files(spark, tmp_path / "in", [*rows, (9, 1, 0, "  ", "2024-02-01T00:00:00"), (8, 1, 0, "old", "2023-01-01T00:00:00")], FEED)
    path = str(tmp_path / "out")
    J.follow_verifications(feed, path, str(tmp_path / "check"), once=True).awaitTermination()
    got = J.newest(spark, [path], feed.schema, J.REGION, J.VERIFIED)
    want = {(0, "t0"), (1, "t1"), (2, "t2"), (3, "t3")}
    assert {(r.region_id, r.verified_text) for r in got.collect()} == want
    J.fold(got, str(tmp_path / "fold"))
    assert {(r.region_id, r.verified_text) for r in J.newest(spark, [str(tmp_path / "fold"), path], feed.schema, J.REGION, J.VERIFIED).collect()} == want


def test_windows_add_up_whatever_the_order_of_arrival(spark, tmp_path):
    hours = [5, 9, 1, 5, 0, 9, 1]
    rows = [(f"2024-01-01T{h:02d}:30:00", "ocr", float(n), n % 3 != 0) for n, h in enumerate(hours)]
    records = feed_files(spark, tmp_path / "in", rows, "ts string, stage string, duration_seconds double, success boolean")
    path = str(tmp_path / "sums")
    J.follow_windows(records, J.stage_sums(), path, str(tmp_path / "check"), once=True).awaitTermination()
    got = {r.window_start.hour: (r.work_seconds, r.records, r.failures) for r in J.windows(spark, path, list(J.stage_sums())).collect()}
    want = {}
    for n, h in enumerate(hours):
        a, b, c = want.get(h, (0.0, 0, 0))
        want[h] = (a + n, b + 1, c + (n % 3 == 0))
    assert got == want


def test_new_result_voids_an_approval(spark):
    schema = "project_id string, status string, source_revision string, approval_story_fingerprint string"
    stored = spark.createDataFrame([("a", "ready", "r1", "fp"), ("b", "ready", "r1", None)], schema)
    new = spark.createDataFrame([("a", "partial", "r2"), ("c", "ready", "r1")], "project_id string, status string, source_revision string")
    got = {r.project_id: (r.status, r.approval_story_fingerprint) for r in store_results(stored, new).collect()}
    assert got == {"a": ("partial", "invalidated:fp"), "b": ("ready", None), "c": ("ready", None)}


def test_similarity_is_the_matching_block_ratio(spark):
    pairs = [("XIN CHÀO", "xin chào"), ("CÔ GÁl", "CÔ GÁI"), ("", "abc"), ("abcd" * 60, "abdc" * 60)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = [r.v for r in frame.select(T.similarity_arrow("a", "b").alias("v")).collect()]
    assert got == [SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in pairs]


def test_fixed_fields_come_from_the_original(spark):
    original = spark.createDataFrame([(1, 1, 1, "raw")], "asset_id int, region_id int, ord int, raw_text string")
    answer = spark.createDataFrame([(1, 1, 9, "changed", "clean"), (1, 2, 2, "x", "y")], "asset_id int, region_id int, ord int, raw_text string, clean_text string")
    assert [(r.ord, r.raw_text, r.clean_text) for r in D.reattach(original, answer).collect()] == [(1, "raw", "clean")]


def test_answers_do_not_depend_on_partitioning(spark):
    rows = [(1, i, f"text {i}", i % 7 / 10) for i in range(40)]
    blocks = spark.createDataFrame(rows, "asset_id int, block_id int, text string, confidence double")
    cited = blocks.select("asset_id", (F.col("block_id") % 9).alias("region_id"), F.col("block_id").alias("pos"), "block_id")
    one = D.region_evidence(cited, blocks).select("region_id", "raw_text").collect()
    other = D.region_evidence(cited.repartition(7), blocks.orderBy(F.desc("block_id"))).select("region_id", "raw_text").collect()
    assert sorted(one) == sorted(other)


def test_layout_feeds_the_dialogue_flow(spark):
    """Split, recovered and placed: regions tell where they come from, and dialogues are built from what comes back."""
    from pagetrace.plans.page import layout_quality, settle_dialogues

    pages = spark.createDataFrame([(1,)], "asset_id int")
    texts = {0: "Hello there.", 1: "Far away", 2: "Third one"}
    places = {0: (0, 0, 60, 20), 1: (600, 0, 660, 20), 2: (0, 400, 60, 420)}
    blocks = spark.createDataFrame([(1, i, t, 0.9) for i, t in texts.items()], "asset_id int, block_id long, text string, confidence double")
    boxes = spark.createDataFrame([(1, i, *b) for i, b in places.items()], "asset_id int, block_id long, x0 int, y0 int, x1 int, y1 int")
    regions = spark.createDataFrame([(1, 3, "narration"), (1, 5, "speech_bubble")], "asset_id int, region_id long, type string")
    cited = spark.createDataFrame([(1, 3, 0), (1, 3, 1), (1, 5, 2)], "asset_id int, region_id long, block_id long")
    order = spark.createDataFrame([(1, 0, 3), (1, 1, 5)], "asset_id int, pos long, region_id long")
    sides = "x0 int, y0 int, x1 int, y1 int, core_x0 int, core_y0 int, core_x1 int, core_y1 int"
    candidates = spark.createDataFrame(
        [(1, "c1", *[0, 200, 60, 220] * 2, 0.8), (1, "c2", *[0, 800, 60, 820] * 2, 0.8), (1, "c3", *[90, 900, 80, 920] * 2, 0.8)],
        f"asset_id int, candidate_id string, {sides}, confidence double")
    attempts = spark.createDataFrame(
        [(1, "c1", 1, "local_ocr_recovery", "Found it", 0.6, True, False), (1, "c2", 1, "local_ocr_recovery", " ", 0.9, True, False),
         (1, "c3", 1, "local_ocr_recovery", "No area", 0.9, True, False)],
        "asset_id int, candidate_id string, rank int, source string, text string, confidence double, usable boolean, needs_review boolean")
    out = layout_quality(pages, blocks, boxes, regions, cited, order, candidates, attempts)
    got = {r.region_id: r for r in out["regions"].collect()}
    assert {i: (r.type, r.region_source) for i, r in got.items()} == {
        3: ("narration", "geometry_split"), 6: ("narration", "geometry_split"), 5: ("speech_bubble", "original_layout"), 7: ("speech_bubble", "local_ocr_recovery")}
    assert (got[7].candidate_id, got[7].recovery_confidence, got[7].needs_review) == ("c1", 0.6, True) and got[3].candidate_id is None
    new = {r.block_id: r for r in out["blocks"].collect()}[3]
    assert (new.text, new.confidence, new.source, new.candidate_id, new.x0, new.y1) == ("Found it", 0.6, "local_ocr_recovery", "c1", 0, 220)
    built = D.build_dialogues(out["blocks"], out["regions"], out["region_blocks"], out["reading_order"])
    said = [(r.region_id, r.type, r.raw_text) for r in built.orderBy("ord").collect()]
    assert said == [(3, "narration", "Hello there."), (6, "narration", "Far away"), (7, "speech_bubble", "Found it"), (5, "speech_bubble", "Third one")]
    key = "asset_id int, region_id long"
    corrections = built.select("asset_id", "region_id", F.col("raw_text").alias("clean_text"), F.lit(0.95).alias("confidence"), F.lit(False).alias("needs_review"), F.lit("unchanged").alias("reason_code"))
    recoveries = spark.createDataFrame([], f"{key}, recovered_text string, confidence double, reason_code string, still_uncertain boolean")
    settled = settle_dialogues(built, corrections, recoveries, spark.createDataFrame([], f"{key}, verified_text string"), out["regions"])
    assert {r.region_id: r.decision for r in settled.collect()}[7] == "needs_review" and settled.count() == 4


def test_a_measure_sees_unequal_texts_only(spark):
    rows = spark.createDataFrame([("Same", "same", 0.9), ("a", "b", 0.9)], "raw_text string, clean_text string, ocr_average double")
    rows = rows.withColumns({"confidence": F.lit(1.0), "needs_review": F.lit(False)})
    got = D.score(rows, lambda a, b: F.coalesce(F.length(a), F.lit(7)) / 2.0)
    assert {r.raw_text: r.text_similarity for r in got.collect()} == {"Same": 1.0, "a": 0.5}


def test_database_scan_is_split_and_filtered_by_the_database(spark, tmp_path):
    """An embedded database: ranges make the partitions, filters and columns reach its query."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "database.log"))
    url = f"jdbc:derby:{tmp_path}/assets;create=true"
    rows = [(i, i % 3, "none" if i % 4 == 0 else f"page {i}", "completed" if i % 2 else "failed") for i in range(1, 101)]
    assets = spark.createDataFrame(rows, "asset_id int, project_id int, ocr_text string, status string")
    kinds = "ocr_text VARCHAR(100), status VARCHAR(20)"
    assets.coalesce(1).write.format("jdbc").options(url=url, dbtable="assets", createTableColumnTypes=kinds).mode("append").save()
    whole = read_database(spark, url, "assets", "asset_id", (1, 101), 4)
    assert whole.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, whole.collect())) == rows
    # Rows beyond the bounds still come, in the first and last range.
    assert read_database(spark, url, "assets", "asset_id", (40, 60), 3).count() == 100
    done = whole.where("project_id = 1 AND status = 'completed' AND ocr_text LIKE 'page%'").select("asset_id")
    assert sorted(r.asset_id for r in done.collect()) == [i for i, p, t, s in rows if p == 1 and s == "completed" and t != "none"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = done.select("asset_id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("*equalto(project_id,1)", "*equalto(status,completed)", "*stringstartswith(ocr_text,page)"):
        assert part in pushed.lower()
    assert "readschema: struct<asset_id:int>" in pushed.lower()


def test_keyed_state_answers_without_the_feed(spark, tmp_path):
    """Files out of time order, a restart between any two: the state equals the batch answer."""
    schema = "asset_id int, region_id int, id int, created_at int, verified_text string"
    rows = [(i % 7 if i % 11 else None, i % 3, i, (i * 37) % 50, f"text {i}") for i in range(200)]
    feed, checkpoint = str(tmp_path / "feed"), str(tmp_path / "state")
    for start in (150, 0, 100, 50):
        part = spark.createDataFrame(rows[start:start + 50] + rows[:5], schema)
        part.coalesce(1).write.mode("append").parquet(feed)
        job = J.follow_newest(spark.readStream.schema(schema).parquet(feed), J.REGION, J.VERIFIED, checkpoint, once=True)
        job.awaitTermination()
        # A trigger reads what is new, not the feed so far.
        assert sum(p["numInputRows"] for p in job.recentProgress) == 55
        state = J.current_rows(spark, checkpoint)
        assert "FileScan parquet" not in state._jdf.queryExecution().executedPlan().toString()
        batch = J.newest(spark, [feed], spark.read.parquet(feed).schema, J.REGION, J.VERIFIED)
        names = ["asset_id", "region_id", "id", "created_at", "verified_text"]
        assert sorted(state.select(names).collect(), key=repr) == sorted(batch.select(names).collect(), key=repr)
    assert state.count() == len({r[:2] for r in rows})
