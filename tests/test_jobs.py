"""Whole jobs on small invented fixtures."""

import difflib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stacksift.functions.fold import fold_match_literal
from stacksift.operators import classify, jobs as queue, localize, publish, resolve
from stacksift.operators.classify import Rule
from stacksift.plans import build, hooks, refresh, resolve_queue, translate_queue
from stacksift.plans.queries import QUERIES
from stacksift.schemas import CANDIDATE_FIELDS, CATALOG, EVIDENCE_CACHE, JOBS, VERIFIED
from stacksift.sources import catalog as files
from stacksift.sources import snapshots
from stacksift.streaming.queue_state import step

SF = "/root/testdata/sf0.001"
DAY = datetime(2024, 1, 1)
LONG = "The old city and the river are where you walk with your friends to the sea."


def record(id, title, **more):
    base = {
        "id": id, "title": title, "source_url": f"https://site.example/{id}/", "image_url": None, "post_date": "2024-01-02",
        "genres": ["Puzzle"], "size_text": "2 GB", "details": None, "details_version": None, "details_checked_at": None,
        "media": None, "media_version": None, "media_checked_at": None,
    }
    return {**base, **more}


def catalog(spark, *records):
    return spark.createDataFrame(list(records), CATALOG)


def candidate(id, label, **more):
    base = dict(
        source="s", url=f"https://www.example.org/wiki/{id}", id=id, label=label, description="a video game", instance_of=[],
        release_dates=["2020-01-01"], genres=["puzzle"], developers=["Dev"], publishers=[], platforms=[],
    )
    return {**base, **more}


def test_classification_cases(spark):
    rules = [Rule("hard", 1, r"^digest\b", "digest"), Rule("soft", 1, r"\bnews\b", "news"), Rule("standalone", 1, r"texture pack$", "asset")]
    exact = classify.exact_titles(classify.rule_table(spark, [Rule("exact", 1, "Hello,  Crowd!", "audited")]))
    full = dict(details=("Text", [], []), media=[("image", "https://a/b", None)], image_url="https://a/c")
    rows = catalog(
        spark,
        record("1", "Site news", genres=[], size_text="N/A"),
        record("2", "Digest 5", **full),
        record("3", "Big news", **full),
        record("4", "Quiet", genres=[], size_text="", image_url="https://a/c"),
        record("5", "Tale", genres=[], size_text=None, details=("Text", [], []), media=[("image", "https://a/b", None)]),
        record("6", "  "),
        record("7", "HD texture pack", **full),
        record("8", "hello, CROWD!", **full),
    )
    got = {r["id"]: (r["kind"], r["reason"], r["score"]) for r in classify.classify(rows, rules, exact).collect()}
    assert got == {
        "1": ("non_game", "news", 0), "2": ("non_game", "digest", 10), "3": ("game", "game-signals", 10),
        "4": ("review", "insufficient-game-signals", 1), "5": ("game", "game-signals", 3), "6": ("review", "missing-title", 6),
        "7": ("non_game", "asset", 10), "8": ("non_game", "audited", 10),
    }


LISTING = """<html><body><article><h1 class="entry-title"><a href="http://site.example/{id}/">{title}</a></h1>
<time datetime="{date}"></time><div class="entry-content"><p><img src="http://i.example/{id}.jpg">
<strong>Genres/Tags:</strong> <a>Puzzle</a>, <a>Logic</a><br>Company: X<br>Repack Size: from 1,5 GB</p></div></article></body></html>"""


def test_refresh_job(spark, tmp_path):
    root = str(tmp_path)
    rules = [Rule("soft", 1, r"\bnews\b", "news")]

    def pages(*rows):
        return spark.createDataFrame(list(rows), "page int, html string")

    one = LISTING.format(id="a", title="Alpha", date="2024-01-01")
    two = LISTING.format(id="b", title="Beta", date="2024-01-02")
    newer = LISTING.format(id="b", title="Beta again", date="2024-01-03")
    held = '<article><h2 class="entry-title"><a href="https://site.example/n/">Some news</a></h2></article>'
    first = refresh.refresh(spark, pages((1, one + held), (2, two), (3, None)), root, rules, DAY)
    assert first["mode"] == "bootstrap" and first["failed_pages"] == 1 and first["catalog_written"]
    again = refresh.refresh(spark, pages((1, one + held), (2, two)), root, rules, DAY)
    assert again["mode"] == "incremental" and not again["catalog_written"] and not again["quarantine_written"]
    refresh.refresh(spark, pages((1, newer), (2, two)), root, rules, DAY)
    rows = {r["id"]: r for r in snapshots.read_current(spark, f"{root}/catalog", CATALOG).collect()}
    assert {k: v["title"] for k, v in rows.items()} == {"a": "Alpha", "b": "Beta again"}
    assert rows["a"]["genres"] == ["Puzzle", "Logic"] and rows["a"]["size_text"] == "1.5 GB"
    assert rows["a"]["image_url"] == "https://i.example/a.jpg"
    held_rows = spark.read.parquet(snapshots.current(spark, f"{root}/quarantine")[1]).collect()
    assert [(r["id"], r["action"]) for r in held_rows] == [("n", "excluded-new")]
    with pytest.raises(RuntimeError):
        refresh.refresh(spark, pages((1, None)), root, rules, DAY)


def test_resolution_jobs(spark, tmp_path):
    root = str(tmp_path)
    rows = catalog(
        spark, record("1", "Star Forge: Ultimate Edition"), record("2", "Iron Vale – v1.2"), record("3", "Nothing Known"),
        record("4", "Moon Path"),
    )
    known = spark.createDataFrame(
        [
            candidate("Q1", "Star Forge"), candidate("Q2", "Iron Vale"),
            candidate("Q3", "Moon Path", description="a film", instance_of=[]), candidate("Q4", "Moon Path Two"),
        ],
        CANDIDATE_FIELDS,
    )
    times = iter(DAY + timedelta(minutes=i) for i in range(100))
    stats = resolve_queue.sync(spark, rows, root, DAY)
    assert (stats["created"], stats["total"]) == (4, 4)
    titled = resolve.titled_candidates(known)
    log = resolve_queue.drain(spark, root, lambda t: resolve.find_candidates(t, titled), 3, lambda: next(times))
    assert sum(b["done"] for b in log) == 2 and sum(b["review"] for b in log) == 2 and len(log) == 2
    stats = resolve_queue.sync(spark, rows, root, DAY + timedelta(days=1))
    assert (stats["unchanged"], stats["changed"]) == (4, 0)

    def answer(requests):
        return hooks.answer(
            requests.select("id", "request"), "request", "response",
            lambda texts: ['{"candidate_id":"%s","confidence":"95%%"}' % json.loads(t)["candidates"][0]["id"] for t in texts],
        )

    done = resolve_queue.review_round(spark, rows, root, answer, 10, DAY + timedelta(days=2))
    assert (done["resolved"], done["ineligible"], done["error"]) == (1, 1, 0)
    assert resolve_queue.review_round(spark, rows, root, answer, 10, DAY + timedelta(days=3))["resolved"] == 0
    out = resolve_queue.export_public(spark, root, f"{root}/public", DAY, ["www.example.org"], [])
    assert (out["exported"], out["changed"]) == (3, True)
    assert resolve_queue.export_public(spark, root, f"{root}/public", DAY, ["www.example.org"], [])["changed"] is False


def test_match_scores_equal_difflib(spark):
    labels = ["star forge", "star forge two", "forge of stars", "moon"]
    pairs = [("1", i, "Star Forge Too", candidate(f"Q{i}", label, genres=[])) for i, label in enumerate(labels)]
    schema = f"id string, pos int, title string, candidate struct<{CANDIDATE_FIELDS}>"
    got = {r["pos"]: r["score"] for r in resolve.scored_pairs(spark.createDataFrame(pairs, schema)).collect()}
    source = fold_match_literal("Star Forge Too")
    for i, label in enumerate(labels):
        a, b = set(source.split()), set(label.split())
        score = 0.5 * difflib.SequenceMatcher(None, source, label).ratio() + 0.2 * len(a & b) / len(a | b)
        score += 0.08 * (source in label or label in source) + 0.12 + 0.05 + 0.03
        assert got[i] == pytest.approx(min(score, 0.99))


def test_translation_jobs(spark, tmp_path):
    root = str(tmp_path)
    features = ["You can play with your friends in the city", "short", "Carte"]
    rows = catalog(spark, record("1", "Star Forge", details=(LONG + " Star Forge is on the map.", features, [])), record("2", "Iron Vale"))
    verified = spark.createDataFrame([], VERIFIED)
    first = translate_queue.sync(spark, rows, verified, root, DAY)
    assert (first["skipped"], first["queued"]) == (False, 2)
    assert translate_queue.sync(spark, rows, verified, root, DAY)["skipped"]

    def answer(prepared):
        return hooks.answer(prepared, "masked", "translated", lambda texts: ["Traduit: " + t[8:] for t in texts])

    stats = translate_queue.translate(spark, root, answer, 10, DAY)
    assert stats["processed"] == 2
    jobs = {r["field_key"]: r for r in spark.read.parquet(snapshots.current(spark, f"{root}/fields")[1]).collect()}
    assert jobs["game_feature:0000"]["status"] == "done"
    assert jobs["description"]["status"] == "rejected" and jobs["description"]["last_error"] == "placeholder validation failed"
    assert translate_queue.export(spark, root, f"{root}/public", DAY)
    shown = {r["id"]: r for r in translate_queue.localized(spark, rows, f"{root}/public").collect()}
    assert shown["1"]["details"]["features"][0].startswith("Traduit: ") and shown["1"]["details"]["features"][1] == "short"
    assert shown["1"]["translated_fields"] == 1 and shown["2"]["translated_fields"] == 0
    changed = rows.withColumn("details", F.col("details").withField("features", F.array(F.lit("Now you can walk in the city and to the sea"))))
    assert translate_queue.sync(spark, changed, verified, root, DAY)["changed"] == 1
    stale = translate_queue.localized(spark, changed, f"{root}/public").filter("translated_fields > 0")
    assert stale.count() == 0


def test_protect_restore_reports_lost_marks(spark):
    row = spark.range(1).select(localize.restore(F.lit("x ZXQ09QXZ"), F.expr("array(struct('ZXQ01QXZ' as mark, 'T' as term))")).alias("r"))
    got = row.first()["r"]
    assert got["missing"] == ["ZXQ01QXZ"] and got["leftovers"] == ["ZXQ09QXZ"]


def test_build_job(spark, tmp_path):
    rows = catalog(spark, record("1", "Star Forge"), record("2", "Iron Vale", post_date="2024-02-01"), record(" ", "No id"))
    verified = spark.createDataFrame([("1", "Star Forge", "2020-05-01", ["puzzle video game"], 0.95, [], None, "Dev", None, [], "Q1")], VERIFIED)
    site = build.build_site(rows, verified)
    assert [r["id"] for r in site.catalog.orderBy("ordinal").collect()] == ["2", "1"]
    assert build.check_site(site).count() == 0
    assert site.health.first()["total_games"] == 2
    build.write_site(site, rows, verified, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/details").count() == 2
    assert spark.read.parquet(f"{tmp_path}/index").filter("kind = 'p' and key = 'puzzle'").count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "envelope.json").write_text(json.dumps({"games": [{"id": "1", "title": "A", "size": "1 GB"}, {"id": "", "title": "B"}]}))
    (tmp_path / "bare.json").write_text(json.dumps([{"id": "2", "title": "C"}]))
    got = files.read_catalog(spark, str(tmp_path / "envelope.json"), rename={"size_text": "size"})
    assert [(r["id"], r["size_text"]) for r in files.usable(got).collect()] == [("1", "1 GB")]
    assert [r["id"] for r in files.read_catalog(spark, str(tmp_path / "bare.json")).collect()] == ["2"]
    (tmp_path / "broken.json").write_text('{"entries": [')
    assert files.read_tolerant(spark, str(tmp_path / "broken.json"), "id string").count() == 0
    assert files.read_tolerant(spark, str(tmp_path / "missing.json"), "id string").count() == 0
    (tmp_path / "snap.json").write_text(json.dumps({"v": 1, "count": 1, "games": {"7": {"name": "x"}}}))
    assert files.read_snapshot(spark, str(tmp_path / "snap.json"), 1, "v", "name:string").first()["name"] == "x"
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path / "snap.json"), 2, "v", "name:string")
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><link>http://s.example/a</link></item><item><link>https://s.example/feed/</link></item>"
        "<item><link>https://s.example/a/</link></item><item><link>https://s.example/b/</link></item></channel></rss>"
    )
    feed = files.read_feed(spark, str(tmp_path / "feed.xml"), "s.example").orderBy("position").collect()
    assert [r["url"] for r in feed] == ["https://s.example/a/", "https://s.example/b/"]
    (tmp_path / "ann.json").write_text(json.dumps({"version": 2, "favorites": ["1", "1"], "completed": ["2"]}))
    library = files.read_library(spark, str(tmp_path / "ann.json"))
    assert sorted(tuple(r) for r in library.collect()) == [("ann", "completed", "2"), ("ann", "favorites", "1")]
    assert json.loads(files.library_export(library, "now").first()["value"])["favorites"] == ["1"]


def test_publish_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert snapshots.publish(rows, str(tmp_path), DAY) is True
    assert snapshots.publish(rows.orderBy(F.desc("id")), str(tmp_path), DAY) is False
    assert snapshots.publish(rows.filter("id = 1"), str(tmp_path), DAY) is True
    assert snapshots.current(spark, str(tmp_path))[0] == 2
    assert not publish.same_content(rows, rows.unionAll(rows))


def test_stream_equals_replay(spark):
    kinds = {"view": "queued", "click": "claimed", "purchase": "done", "signup": "review", "error": "deferred"}
    states = {}
    for e in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        status, attempts, ignored = states.get(e["user_id"], ("", 0, 0))
        status, attempts, valid = step(status, attempts, kinds[e["event_type"]])
        states[e["user_id"]] = (status, attempts, ignored + (not valid))
    got = QUERIES["stream_job_states"](spark, SF).collect()
    assert {int(r["id"]): (r["status"], r["attempts"], r["ignored"]) for r in got} == states


def test_failing_providers(spark, tmp_path):
    root = str(tmp_path)
    rows = catalog(spark, record("1", "Star Forge"), record("2", "Iron Vale"), record("3", "Moon Path"), record("4", "Sun Road"))
    known = {"star forge": [candidate("Q1", "Star Forge")]}

    def provider(queries):
        answers = {"iron vale": TimeoutError("slow"), "moon path": ValueError("no such thing")}
        return [answers.get(q.lower(), known.get(q.lower(), [])) for q in queries]

    kind = spark.createDataFrame([], CANDIDATE_FIELDS).schema
    resolve_queue.sync(spark, rows, root, DAY)
    stats = resolve_queue.run_batch(spark, root, hooks.entity_lookup(provider, kind), 10, DAY)
    jobs = {r["id"]: r for r in snapshots.read_current(spark, f"{root}/jobs", JOBS).collect()}
    assert {i: r["status"] for i, r in jobs.items()} == {"1": "done", "2": "pending", "3": "failed", "4": "review"}
    assert jobs["2"]["last_error"] == "TimeoutError: slow" and jobs["2"]["attempts"] == 1
    assert (stats["deferred"], stats["failed"]) == (1, 1)
    cached = {r["search_title"] for r in snapshots.read_current(spark, f"{root}/cache", EVIDENCE_CACHE).collect()}
    assert cached == {"star forge", "sun road"}
    again = resolve_queue.run_batch(spark, root, hooks.entity_lookup(lambda qs: [[] for _ in qs], kind), 10, DAY)
    assert again["review"] == 1 and again["deferred"] == 0


def test_failed_translation_is_tried_again(spark):
    def broken(texts):
        raise ConnectionError("away")

    requests = spark.createDataFrame([("a", "description", 0, LONG, LONG, [])], "id string, field_key string, pos int, source string, masked string, marks array<struct<mark:string,term:string>>")
    said = hooks.answer(requests, "masked", "translated", broken)
    done = localize.checked_translations(requests, said.select("id", "field_key", "pos", "translated", "error")).first()
    assert done["outcome"] == "error" and done["error"] == "ConnectionError: away"
    one = hooks.answer(requests, "masked", "translated", lambda texts: [t.upper() for t in texts]).first()
    assert one["translated"] == LONG.upper() and one["error"] is None


def test_a_long_claim_is_not_one_task(spark):
    """Long heads of the queue stay in several ranges, and hold the same rows as a sort with a limit."""
    jobs = spark.range(0, 60_000, 1, 8).select(
        F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(x)), 512) for x in "ab"]).alias("id"),
        F.lit(True).alias("active"), F.when(F.col("id") % 10 == 0, "done").otherwise("pending").alias("status"),
        F.timestamp_seconds(F.pmod(F.col("id"), F.lit(997))).alias("queued_at"))
    got = queue.oldest_pending(jobs, 50_000)
    assert got.columns == jobs.columns and got.rdd.getNumPartitions() > 1
    want = jobs.filter("status = 'pending'").orderBy("queued_at", "id").limit(50_000)
    assert got.count() == 50_000 and got.exceptAll(want).isEmpty()
