"""A review round keeps candidate lists by title, not by job."""

from pyspark.sql import functions as F

from stacksift.functions import decisions
from stacksift.operators import review
from stacksift.plans.tables import NOW
from test_jobs import CANDIDATE_FIELDS, candidate

TEXTS = [
    '{"candidate_id":"q2","confidence":0.95}', '{"candidate":"it is Q3 I think","confidence":"95%"}', "I pick Q1, confidence 0,95",
    "Q1 or Q2, confidence 0.9", '{"id":"\\u00513","confidence":0.95}', '{"id":"dup","confidence":1}', '{"id":"none","confidence":1}',
    '{"id":"Q99","confidence":1}', "Q99 confidence 1", '[{"id":"Q1"}]', "", None, '{"id":"Q7","confidence":0.99}', "dup with confidence 1",
]
IDS = ["Q1", "Q2", "Q3", "dup", "dup", "Q7", "Q7"]


def test_stated_ids_find_what_the_whole_list_finds(spark):
    rows = spark.createDataFrame([(i, t, IDS) for i, t in enumerate(TEXTS)], "n int, text string, allowed array<string>")
    few = F.filter("allowed", lambda a: F.array_contains(decisions.stated_ids("text"), F.upper(a)))
    got = rows.select(decisions.parse_decision("text", F.col("allowed")).alias("a"), decisions.parse_decision("text", few).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_candidates_once_a_title(spark):
    listed = [candidate("Q0", "Star Forge", genres=[])] + [candidate(i, "Star Forge") for i in IDS] + [candidate(f"Q{n}", "x") for n in range(100, 900)]
    cache = spark.createDataFrame([("star forge", listed)], f"search_title string, evidence array<struct<{CANDIDATE_FIELDS}>>")
    jobs = spark.createDataFrame([(str(i), "Star Forge", "f", NOW, None) for i in range(len(TEXTS))], "id string, title string, fingerprint string, updated_at timestamp, review_attempts int")
    catalog = jobs.select("id", F.array(F.lit("Puzzle")).alias("genres"))
    eligible = review.eligibility(jobs, catalog, cache)
    assert not {"candidates", "evidence"} & set(eligible.columns)
    heads, bodies = review.requests(eligible, cache)
    assert (heads.count(), bodies.count()) == (len(TEXTS), 1)
    request = review.whole_requests(heads, bodies).select(F.from_json("request", "candidates array<struct<id:string>>, source_entry struct<title:string>").alias("r")).first()["r"]
    assert [c["id"] for c in request["candidates"]] == [c["id"] for c in listed[1:]] and request["source_entry"]["title"] == "Star Forge"
    responses = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS) if t is not None], "id string, response string")
    got = {int(r["id"]): (r["status"], r["candidate_id"], r["candidate"] and r["candidate"]["id"]) for r in review.outcomes(eligible, responses, cache).collect()}
    resolved = {0: "Q2", 1: "Q3", 2: "Q1", 4: "Q3", 5: "dup", 12: "Q7"}
    assert {i: r[1:] for i, r in got.items() if r[0] == "resolved"} == {i: (c, c) for i, c in resolved.items()}
    assert got[6][0] == "unresolved" and {i for i, r in got.items() if r[0] == "error"} == {3, 7, 8, 9, 10, 11, 13}

