"""Distributed numbering, repeated cases, gram search and ordered streams against plain Python on skewed tables."""

import random

from pyspark.sql import functions as F

from assayer.operators import formulation, lookup, search, xref
from assayer.operators import sessions as T
from assayer.operators.ordering import neighbours, numbered
from assayer.session import shared_folder
from assayer.streaming import jobs as W
from test_screening import A2, P1, RULE, rule


def test_numbers_are_gapless_within_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "b"]), rng.random()) for _ in range(5000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {(r["k"], r["v"]): r["n"] for r in numbered(df, ["k"], ["v"], "n").collect()}
    for k in ("hot", "a", "b", None):
        assert [got[k, v] for v in sorted(v for x, v in rows if x == k)] == list(range(sum(x == k for x, _ in rows)))
    whole = [r["n"] for r in numbered(df, [], ["v"], "n").orderBy("v").collect()]
    assert whole == list(range(len(rows)))
    before = {r["v"]: r["p"] for r in neighbours(df.select("v"), [], "v", "p").collect()}
    ordered = sorted(before)
    assert [before[v] for v in ordered] == [None, *ordered[:-1]]


def test_contexts_are_numbered_in_one_order(spark):
    df = spark.createDataFrame([(c.lower(), c) for c in ("b", "C", "a", "D")], "context_key string, product_context string")
    assert [(r[1], r[2]) for r in sorted(map(tuple, lookup.context_options(df).collect()))] == [("a", 0), ("b", 1), ("C", 2), ("D", 3)]


def test_repeated_cases_are_compared_rule_by_rule(spark):
    rows = [rule("7", n, A2, context=None) for n in ("Same", "Old", "Third")] + [rule("7", n, P1, context=None) for n in ("Same", "New", "Third")]
    rows += [rule("8", n, A2, context=None) for n in ("One", "Two")] + [rule("8", "One", P1, context=None)]
    names = [f.split()[0] for f in RULE.split(",")]
    ids = names.index("rule_id") if "rule_id" in names else 0
    rows = [tuple(f"r{i:03d}" if at == ids else v for at, v in enumerate(r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, RULE)
    found = xref.compare_snapshots(df)
    got = {r["reference_number"]: (r["comparison_status"], r["changed_fields"]) for r in found.collect()}
    assert got == {"7": ("changed", ["substance_name"]), "8": ("ambiguous", [])}
    cases = [(r["case_number"], r["acd"], r["singapore"], r["differs"]) for r in xref.case_differences(df, found).orderBy("case_number").collect()]
    assert cases == [(0, "Same", "Same", False), (1, "Old", "New", True), (2, "Third", "Third", False)]
    text = xref.field_differences(df, found).first()
    assert text["acd"] == "[parent] Same\n---\n[parent] Old\n---\n[parent] Third"


def test_every_candidate_is_a_row(spark):
    rows = [rule("1", "Moved", A2, context=None)] + [rule(str(n), "Moved", P1, context=None) for n in (21, 22, 23)]
    df = spark.createDataFrame(rows, RULE)
    headers = xref.compare_snapshots(df)
    got = {r["candidate"] for r in xref.rename_candidate_rows(headers, df).filter("reference_key = '1'").collect()}
    assert got == {"singapore:21", "singapore:22", "singapore:23"}


def test_search_finds_what_contains_the_query(spark, monkeypatch):
    monkeypatch.setattr(search, "HITS_PER_TASK", 50)
    monkeypatch.setattr(search, "HEAVY", 20)
    rng = random.Random(7)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + rng.choice(["", " sodium", " é"]) for _ in range(900)]
    entries = sorted({(f"e{i:04d}", n.upper(), n) for i, n in enumerate(names)})
    catalogue = spark.createDataFrame(entries, "ingredient_id string, canonical_name string, search_name string")
    asked = ["ab", "abc", "sodium", "um", "c é", "é", "x", "abcabcabcabc", "odi", "zzz", "bb"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    got = {}
    for r in search.ranked_catalogue_search(queries, catalogue, 20).orderBy("position").collect():
        got.setdefault(r["query_key"], []).append((r["rank"], r["search_name"], r["ingredient_id"]))
    for q in asked:
        rank = lambda n: 0 if n == q else 1 if n.startswith(q) else 2
        hits = sorted((rank(n), n, i) for i, _, n in entries if q in n)[:20] if len(q) >= 2 else []
        assert got.get(q, []) == hits, q


def test_an_entry_counts_once_with_its_best_key_and_only_best_hits_are_shuffled(spark):
    a = "id string, place string, key string"
    rows = [("e1", "x", "ab (except c)"), ("e1", "x", "ab"), ("e1", "x", "ab"), ("e2", "y", "cab"), ("e2", "y", "abc"), ("e3", None, "c ab"), ("e3", "z", "zz")]
    keys = spark.createDataFrame([("ab",), ("c a",), ("zz",)], "query_key string")
    hits = search.ranked_hits(keys, spark.createDataFrame(rows, a), ["place", "id"], 20)
    got = sorted((r["query_key"], r["position"], r["rank"], r["id"], r["place"]) for r in hits.collect())
    assert got == [("ab", 1, 0, "e1", "x"), ("ab", 2, 1, "e2", "y"), ("ab", 3, 2, "e3", None), ("c a", 1, 1, "e3", None), ("zz", 1, 0, "e3", "z")]
    many = spark.range(50_000).selectExpr("CAST(id AS STRING) AS id", "CAST(id % 7 AS STRING) AS place", "'ab ' || id AS key")
    top = search.ranked_hits(keys, many, ["place", "id"], 20).filter("query_key = 'ab'")
    assert [r["id"] for r in top.orderBy("position").collect()] == sorted(map(str, range(0, 50_000, 7)))[:20]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("WindowGroupLimit"):].splitlines()
    assert not any("min(rank" in line for line in below), "hits are cut before they are shuffled or grouped"


def follow(rows, ttl):
    """(session, id) -> accepted, one update after the other."""
    state, out = {}, {}
    for key, ident, at, revision in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        current, touched = state.get(key, (0, None))
        if touched is not None and at - touched > ttl:
            current = 0
        out[key, ident] = revision == current
        state[key] = (current + (revision == current), at)
    return out


def deliver(spark, batches, schema, walk, columns):
    folder = shared_folder(spark, "test-stream")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b={i}")
        stream = walk(spark.readStream.schema(schema).parquet(f"{folder}/in/b=*").withColumn("ts", F.timestamp_seconds("s")))
        W.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return [tuple(r[c] for c in columns) for r in spark.read.parquet(f"{folder}/out").collect()]


def test_revisions_do_not_depend_on_the_batches(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randint(0, 20_000), rng.choice([0, 0, 1, 1, 2, 3, None])) for i in range(600)]
    want = follow(rows, 3600)
    schema = "session_key bigint, update_id bigint, s bigint, revision bigint"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["session_key"], r["update_id"]): r["accepted"] for r in T.revision_conflicts(df).collect()}
    assert got == {k: bool(v) for k, v in want.items()} and any(want.values())
    # Four deliveries, each with rows up to 400 seconds behind the last one; a late row far ahead ends the stream.
    arrival = sorted(rows, key=lambda r: r[2] + rng.randint(0, 400))
    batches = [arrival[:150], arrival[150:300], arrival[300:450], arrival[450:], [(9, 9999, 90_000, 0)]]
    streamed = deliver(spark, batches, schema, W.stream_revisions, ("session_key", "update_id", "accepted"))
    assert {s[:2]: s[2] for s in streamed} == got and len(streamed) == len(got)


def test_repeats_do_not_depend_on_the_batches(spark):
    rng = random.Random(9)
    plain = "formulation_id bigint, row_number bigint, name string, cas_number string, value double, s bigint"
    rows = [(rng.choice([1, 2]), i, rng.choice(["Aqua", " AQUA ", "Salt"]), rng.choice([None, "50-00-0"]), rng.choice([None, 1.0]), rng.randint(0, 9000)) for i in range(300)]
    amount = "IF(value IS NULL, NULL, named_struct('value', value, 'unit', 'percent', 'basis', CAST(NULL AS STRING), 'preparation_stage', 'after_mixing')) AS concentration"
    table = lambda df: formulation.signature_rows(df.selectExpr("*", "CAST(NULL AS STRING) AS product_context", amount), "ts")
    kept, want = {}, {}
    for f, i, name, cas, value, s in sorted(rows, key=lambda r: (r[5], r[1])):
        sig = (f, name.strip().lower(), cas, value)
        want[f, i] = sig in kept and s - kept[sig] <= 600
        if not want[f, i]:
            kept[sig] = s
    df = spark.createDataFrame(rows, plain).withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["formulation_id"], r["row_number"]): r["repeated"] for r in formulation.repeats_within(table(df), 600).collect()}
    assert got == want
    arrival = sorted(rows, key=lambda r: r[5] + rng.randint(0, 300))
    batches = [arrival[:100], arrival[100:200], arrival[200:], [(9, 9999, "End", None, None, 90_000)]]
    streamed = deliver(spark, batches, plain, lambda df: W.stream_duplicates(table(df)), ("formulation_id", "row_number", "repeated"))
    assert {s[:2]: s[2] for s in streamed} == want and len(streamed) == len(want)


def test_a_piece_takes_few_state_calls(spark):
    """However many keys and rows a piece has: a call for each row took most of the time of a stream."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.values = []

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name in ("put", "update", "appendValue"):
                    self.values = list(given[0]) if name == "put" else (self.values if name == "appendValue" else []) + [given[0]]
                return bool(self.values) if name == "exists" else self.values[0] if name == "get" and self is state else iter(self.values)

            return call

    class Clock:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    waiting, state = State(), State()
    handle = type("Handle", (), {
        "getListState": lambda *_: waiting, "getValueState": lambda *_: state, "registerTimer": lambda *_: calls.append("timer")
    })()
    step = lambda kept, at, value: ((at,), kept == (None,))
    walk = W._in_event_order("bigint", ("id", "value"), ("kept",), (None,), step, 10_000_000)
    walk.init(handle)
    rows = pd.DataFrame({"key": [i // 2 for i in range(4000)], "at": [i * 1000 for i in range(4000)], "id": range(4000), "value": 1})
    list(walk.handleInputRows((0,), iter([rows[:1000], rows[1000:]]), Clock(0)))
    out = pd.concat(walk.handleExpiredTimer((0,), Clock(4000), None))
    assert len(out) == 4000 and out[3].sum() == 2000
    assert len(calls) < 20


def test_null_sessions_are_a_session_of_their_own(spark):
    rng = random.Random(10)
    rows = [(rng.choice([None, None, 1, 2, 17, 104]), i, rng.randint(0, 9000), rng.choice([0, 0, 1, None])) for i in range(200)]
    state, want = {}, {}
    for key, ident, at, revision in sorted(rows, key=lambda r: r[2:3] + r[1:2]):
        current, touched = state.get(key, (0, at))
        current = 0 if at - touched > 3600 else current
        want[ident] = (key, revision == current)
        state[key] = (current + (revision == current), at)
    schema = "session_key bigint, update_id bigint, s bigint, revision bigint"
    streamed = deliver(spark, [rows, [(9, 9999, 90_000, 0)]], schema, W.stream_revisions, ("update_id", "session_key", "accepted"))
    assert {s[0]: s[1:] for s in streamed} == want and len(streamed) == len(want)
