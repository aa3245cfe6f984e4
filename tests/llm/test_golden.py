"""Golden records against a plain version, on clusters of all kinds."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from pagewright.llm import golden

SCHEMA = ("client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, "
          "level int, cluster int, v int, hot boolean, `a.b` int")
START = datetime(2024, 1, 1)
LIMIT = timedelta(hours=1440)


def plain(rows):
    clusters = defaultdict(list)
    for r in rows:
        text = lambda x: None if x is None or not x.strip(" \t\n\v\f\r") else x
        i, m, source, at, name, email, city, nation, segment, balance = r[:10]
        balance = None if balance is None or balance != balance or abs(balance) == float("inf") else balance
        level = list(golden.TRUST).index(text(source)) if text(source) in golden.TRUST else len(golden.TRUST)
        clusters[i if m is None else m].append({"i": i, "at": at, "level": level, "name": text(name), "email": text(email), "city": text(city), "nation": nation, "segment": text(segment), "balance": balance})
    for cluster, own in clusters.items():
        latest = max((x["at"] for x in own if x["at"]), default=None)
        back = lambda at: (1, 0) if at is None else (0, (datetime(2100, 1, 1) - at) // timedelta(microseconds=1))
        last = lambda i: (i is None, i or 0)
        recent = lambda x: (back(x["at"]), x["level"], last(x["i"]))
        stale = lambda x: x["at"] is None or latest - x["at"] > LIMIT
        trusted = lambda x: (stale(x), x["level"], recent(x))
        pick = lambda field, key: min((x for x in own if x[field] is not None), key=key, default={"i": None, field: None})
        name, email, segment = pick("name", lambda x: (-len(x["name"]), trusted(x))), pick("email", trusted), pick("segment", recent)
        balance = pick("balance", lambda x: (x["segment"] != segment["segment"], recent(x)))
        given = lambda x: (x["city"] is not None) + (x["nation"] is not None)
        address = min((x for x in own if given(x)), key=lambda x: (-given(x), trusted(x)), default={"i": None, "city": None, "nation": None})
        yield (cluster, len(own), sum(map(stale, own)), name["name"], email["email"], segment["segment"], address["city"], address["nation"], balance["balance"],
               name["i"], email["i"], segment["i"], balance["i"], address["i"])


def made(seed, n):
    rng = random.Random(seed)
    edges = [START + LIMIT, START + LIMIT + timedelta(microseconds=1), START, START + timedelta(microseconds=1)]
    maybe = lambda *xs: rng.choice([None, "", " \t\r\n\v\f", *xs])
    return [(i, rng.choice([None, 1, 1, 2, 3, 4, 5, rng.randrange(n)]), maybe("crm", "web", "store", "partner", "other", "CRM"), rng.choice([None, *edges, START + timedelta(days=rng.randrange(150))]),
             maybe(" a", "ab", "éé", "😀😀", "abc", " "), maybe("x@", "y@", " "), maybe("A", "B "), rng.choice([None, 1, 2]), maybe("p", "q", "r"),
             rng.choice([None, float("nan"), float("inf"), -0.005, 1.005, 2.5, 1e300]), 9, 9, 9, True, 9) for i in range(n)]


@pytest.mark.parametrize("seed,n", [(0, 12), (1, 60), (2, 400), (3, 4000)])
def test_records_against_plain_ones(spark, seed, n):
    rows = made(seed, n)
    got = golden.golden_records(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows)))


def test_repeated_rows_missing_ids_long_texts_and_no_rows(spark):
    long = "n" * 300_000
    one = (7, None, "web", START, long, "e@", None, None, "p", 1.5, 9, 9, 9, True, 9)
    nobody = (None, None, None, None, None, None, None, None, None, None, 9, 9, 9, True, 9)
    rows = [one, one, nobody, nobody, (None, 7, "crm", None, "short", None, "C", None, None, None, 9, 9, 9, True, 9)]
    got = golden.golden_records(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows)))
    tie = [(1, None, "crm", START, x, x, x, 1, x, None, 9, 9, 9, True, 9) for x in ("a", "b")]
    assert [(r["name"], r["email"], r["city"], r["segment"]) for r in golden.golden_records(spark.createDataFrame(tie, SCHEMA)).collect()] == [("b",) * 4]
    assert golden.golden_records(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_no_cluster_meets_in_one_task(spark):
    """Neither a broadcast nor a task of an exchange takes a part of the rows that grows with them."""
    rows = spark.range(40_000).selectExpr("id AS client_id", "IF(id % 3 = 0, 1L, id) AS master_id", "'crm' AS source", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS updated_at", "'n' AS name", "'e' AS email",
                                          "'c' AS city", "1 AS nation_id", "'s' AS segment", "1.0D AS balance")
    got = golden.golden_records(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    hot = got.where("cluster_id = 1").first()
    assert (hot["n_records"], hot["n_stale"], hot["balance_from"]) == (13_335, 0, 39_999)
