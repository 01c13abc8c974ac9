"""The library against plain Python: replayed logs, validation, evidence, generated traces, a streamed log."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerfold import catalogue
from ledgerfold.errors import InvalidInput, UnsupportedVersion
from ledgerfold.functions import codec
from ledgerfold.operators import evidence, generations, relational, runs, temporal, transactions
from ledgerfold.operators.index import IndexedTable
from ledgerfold.operators.relational import Predicate as P
from ledgerfold.operators.relational import Schema, Table, table_after
from ledgerfold.sources import workload as W
from ledgerfold.streaming import tail

LOG = "seq long, key long, kind string, val long"
SF = "/root/testdata/sf0.001"


def random_log(seed, n=400, keys=9):
    rng = random.Random(seed)
    return [(k, rng.randrange(keys), "put" if rng.random() < 0.7 else "delete", rng.randrange(100)) for k in range(n)]


@pytest.mark.parametrize("seed", [0, 0x5EED])
def test_versions_are_those_of_a_replay(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    state, previous, history = {}, {}, []
    for seq, key, kind, val in rows:
        previous[seq] = (key in state, state.get(key))
        history.append(dict(state))
        if kind == "put":
            state[key] = val
        else:
            state.pop(key, None)
    assert {r.key: r.val for r in temporal.fold(log).collect()} == state
    for slice_rows in (7, 1 << 20):
        assert {r.seq: (r.present, r.prev_val) for r in temporal.previous_values(log, slice_rows).collect()} == previous
    gets = spark.createDataFrame([(k * 10, k % 12) for k in range(40)], "step long, key long")
    got = {r.step: (r.present, r.val) for r in temporal.get_as_of(log, gets, 16).collect()}
    assert got == {k * 10: (k % 12 in history[k * 10], history[k * 10].get(k % 12)) for k in range(40)}
    ranges = spark.createDataFrame([(k * 13, k % 5, k % 5 + 4, 2) for k in range(30)], "step long, start long, end long, limit int")
    want = {(k * 13, i + 1, key, history[k * 13][key]) for k in range(30) for i, key in enumerate(sorted(x for x in history[k * 13] if k % 5 <= x < k % 5 + 4)[:2])}
    assert {tuple(r) for r in temporal.range_as_of(log, ranges).collect()} == want
    cut = runs.cut(log, 50)
    assert {r.key: r.val for r in runs.visible(cut).collect()} == state
    steps = spark.createDataFrame([(0, "get", 3, None), (1, "put", 3, 7), (2, "get", 3, None), (3, "reopen", None, None), (4, "delete", 3, None), (5, "get", 3, None)], "step long, op string, key long, val long")
    seen = [(r.result, r.present, r.val) for r in temporal.outcomes(log, steps).orderBy("step").collect()]
    held = (3 in state, state.get(3))
    assert seen == [("value", *held), ("previous", *held), ("value", True, 7), ("reopened", False, None), ("previous", True, 7), ("value", False, None)]


def test_ranges_of_all_steps_read_a_hot_key_once(spark):
    rng = random.Random(8)
    rows = [(k, 3 if rng.random() < 0.9 else rng.randrange(20), "put" if rng.random() < 0.8 else "delete", k) for k in range(600)]
    log = spark.createDataFrame(rows, LOG)
    ranges = spark.createDataFrame([(seq, key, key + 6, 3) for seq, key, _, _ in rows], "step long, start long, end long, limit int")
    state, want = {}, set()
    for seq, key, kind, val in rows:
        want |= {(seq, i + 1, k, state[k]) for i, k in enumerate(sorted(k for k in state if key <= k < key + 6)[:3])}
        if kind == "put":
            state[key] = val
        else:
            state.pop(key, None)
    for slice_rows in (50, 1 << 20):
        out = temporal.range_as_of(log, ranges, slice_rows)
        assert {tuple(r) for r in out.collect()} == want
    # Steps meet keys, not versions, of which the hot key has hundreds.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "valid_from" not in plan and "valid_to" not in plan


def test_whole_queries_leave_no_step_out(spark):
    steps = {r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    got = {r.step for r in catalogue.QUERIES["bench_flagship"](spark, SF).collect()}
    assert len(got & steps) > 0.9 * len(steps)  # the first steps find nothing
    rows = sorted((r.event_id // 10, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    touched = {}
    for tx, key in rows:
        touched.setdefault(key, set()).add(tx)
    want = {(tx + 3, key, max(t for t in touched[key] if tx < t < tx + 3)) for tx, key in rows if any(tx < t < tx + 3 for t in touched[key])}
    assert {(r.tx, r.key, r.version) for r in catalogue.QUERIES["occ_conflicts"](spark, SF).collect()} == want


def test_probes_and_reads_grow_with_the_table(spark, tmp_path):
    rows = [(k, k * 7 % 400, "error" if k % 5 == 0 else "view", float(k)) for k in range(1200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    probed = {r.key: r.consults for r in catalogue.QUERIES["run_point_consults"](spark, str(tmp_path)).collect()}
    newest = {user: k // 500 for k, user, _, _ in rows}
    assert probed == {k: 3 - newest[k] if k < 400 else 3 for k in range(800)}
    got = {(r.step, r.key): (r.present, r.val) for r in catalogue.QUERIES["kv_get_asof"](spark, str(tmp_path)).collect()}
    state, want = {}, {}
    for step, user, kind, value in rows:
        key = (user * 31 + 7) % 400
        want[step, key] = (key in state, state.get(key))
        state.pop(user, None) if kind == "error" else state.__setitem__(user, int(value * 100))
    assert got == want and {key for _, key in got} == set(range(400))


def test_run_costs_of_a_known_layout(spark):
    base = [(0, k, k, "put", 1) for k in range(8)]
    over = [(1, 0, 8, "put", 2), (1, 8, 9, "put", 3)]
    held = spark.createDataFrame(base + over, "run_id long, key long, seq long, kind string, val long")
    probes = spark.createDataFrame([(0,), (5,), (99,)], "key long")
    assert {r.key: r.consults for r in runs.point_consults(held, probes).collect()} == {0: 1, 5: 2, 99: 2}  # 5 for 3 reads
    assert runs.range_decoded(held, 0, 100).head() == (10, 9)


def test_runs_are_numbered_in_slices(spark):
    held = spark.createDataFrame([(run, run, run, "put", 1) for run in range(0, 90, 3)], "run_id long, key long, seq long, kind string, val long")
    probes = spark.createDataFrame([(k,) for k in range(90)], "key long")
    for slice_ids in (7, 30, 1 << 20):
        got = {r.key: r.consults for r in runs.point_consults(held, probes, slice_ids).collect()}
        assert got == {k: 30 - k // 3 if k % 3 == 0 else 30 for k in range(90)}


def test_prefix_proofs_tell_logs_apart(spark):
    rows = random_log(3, 50)
    proof = lambda rows, n=40: temporal.prefix_proof(spark.createDataFrame(rows, LOG), n).head()
    assert proof(rows) == proof(rows[::-1]) == proof(rows[:45])
    assert proof(rows) != proof(rows, 39)
    assert proof(rows) != proof([(s, k, kind, v + (s == 7)) for s, k, kind, v in rows])


def test_null_keys_and_open_ranges(spark):
    log = spark.createDataFrame([(0, None, "put", 1), (1, 5, "put", 2), (2, None, "put", 3), (3, None, "delete", 0), (4, 9, "put", 4), (5, -7, "put", 5)], LOG)
    for slice_rows in (2, 100):
        got = {r.seq: (r.key, r.present, r.prev_val) for r in temporal.previous_values(log, slice_rows).collect()}
        assert got == {0: (None, False, None), 1: (5, False, None), 2: (None, True, 1), 3: (None, True, 3), 4: (9, False, None), 5: (-7, False, None)}
    assert len(temporal.versions(log).collect()) == 6
    gets = spark.createDataFrame([(3, None), (9, None), (9, 5)], "step long, key long")
    assert {(r.step, r.key): (r.present, r.val) for r in temporal.get_as_of(log, gets).collect()} == {(3, None): (True, 3), (9, None): (False, None), (9, 5): (True, 2)}
    far = 10**12
    ranges = spark.createDataFrame([(6, 0, None, 9), (7, None, None, 9), (8, 5, far, 1), (2, -far, far, 9), (9, 3, 3, 9), (10, 6, 5, 9), (11, 5, 10, 0), (12, 10, None, 9), (13, -7, -6, 9)], "step long, start long, end long, limit int")
    got = {tuple(r) for r in temporal.range_as_of(log, ranges).collect()}
    assert got == {(6, 1, 5, 2), (6, 2, 9, 4), (7, 1, -7, 5), (7, 2, 5, 2), (7, 3, 9, 4), (8, 1, 5, 2), (2, 1, 5, 2), (13, 1, -7, 5)}
    assert temporal.range_as_of(log.limit(0), ranges).count() == temporal.range_as_of(log, ranges.limit(0)).count() == 0


def test_trace_files_and_their_validation(spark, tmp_path):
    config = W.TraceConfig(0x517EED, "mixed", 40, 64, 24, 8, 7)
    steps = W.trace(spark, config)
    (tmp_path / "t.json").write_text(W.trace_json(config, steps))
    back = W.read_traces(spark, str(tmp_path))
    assert back.select(*W.NAMES).exceptAll(steps.select(*W.NAMES)).count() == steps.select(*W.NAMES).exceptAll(back.select(*W.NAMES)).count() == 0
    assert back.select("generator.operations", "generator.reopen_every").head() == (40, 7)
    assert W.trace_violations(config, back.select(*W.NAMES)).count() == 0
    assert W.requires_range(back).head()[0] and not W.requires_range(back.limit(0)).head()[0]
    (tmp_path / "t.json").write_text(W.trace_json(config, steps).replace('"seed":5340909,"generator"', '"seed":1,"generator"'))
    with pytest.raises(InvalidInput):
        W.read_traces(spark, str(tmp_path))
    (tmp_path / "t.json").write_text(W.trace_json(config, steps).replace('"format_version":1', '"format_version":2'))
    with pytest.raises(UnsupportedVersion):
        W.read_traces(spark, str(tmp_path))


def test_contracts_name_the_engine():
    from ledgerfold.operators import contract

    contract.require_range(contract.LEDGERFOLD)
    with pytest.raises(InvalidInput, match="plain"):
        contract.require_range(contract.LEDGERFOLD | {"name": "plain", "ordered_range": "false"})


def test_batches_commit_as_a_whole(spark):
    rows = [(1, 1, "upsert", 1, "t", "a"), (1, 2, "delete", 1, None, None), (2, 3, "upsert", 2, "t", "b"), (2, 4, "upsert", None, "t", "c"), (4, 6, "upsert", 3, "t", "d"), (5, 7, "drop", 1, "t", "e"), (5, 8, "upsert", 4, None, "f")]
    rows += [(7, 100 + k, "delete", k, None, None) for k in range(1025)] + [(8, 2000 + k, "upsert", k, "t", "g") for k in range(10, 10 + 1024)]
    ops = spark.createDataFrame(rows, "batch long, seq long, op string, id long, team string, name string")
    batches = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 7, 8)], "batch long")
    found = relational.commit_outcomes(batches, ops, USERS)
    assert {r.batch: (r.tx_id, r.reason) for r in found.collect()} == {1: (1, None), 2: (None, "no key"), 3: (None, "no operations"), 4: (2, None), 5: (None, "unknown operation"), 7: (None, "too many operations"), 8: (3, None)}
    assert {r.id for r in relational.committed(ops, found, USERS).collect()} == {3, *range(10, 1034)}
    assert {r.id: r.ord for r in relational.in_order(relational.committed(ops, found, USERS), "id").collect()} == {k: i for i, k in enumerate([3, *range(10, 1034)])}


def test_distributions_by_slices(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, 1]), rng.randrange(-50, 1000)) for _ in range(700)] + [("c", None, 5), ("d", 2, None)]
    samples = spark.createDataFrame(rows, "g string, h int, duration long")
    for width in (1, 64, 1 << 16):
        got = {(r.g, r.h): tuple(r)[2:] for r in evidence.distribution(samples, ["g", "h"], slice_values=width).collect()}
        for group in {(g, h) for g, h, v in rows if v is not None}:
            own = sorted(v for g, h, v in rows if (g, h) == group and v is not None)
            rank = lambda p: own[-(-len(own) * p // 100) - 1]
            assert got[group] == (len(own), own[0], rank(50), rank(95), own[-1])
        assert ("d", 2) not in got


def test_range_bounds():
    with pytest.raises(InvalidInput):
        temporal.check_range(5, 4, 1)
    with pytest.raises(InvalidInput):
        temporal.check_range(0, 4, -1)


USERS = Schema((("id", "int64"), ("team", "text"), ("name", "text")), "id")
ROWS = [(3, "systems", "Edsger"), (1, "languages", "Ada"), (2, "systems", "Grace"), (4, "theory", "Donald")]


@pytest.fixture
def users(spark):
    return Table("users", USERS, spark.createDataFrame(ROWS, "id long, team string, name string")).checked()


def test_queries_come_in_key_order(users, tmp_path):
    names = lambda df: [tuple(r) for r in df.collect()]
    assert names(users.query(["name"], [P("id", "ge", 2)])) == [("Grace",), ("Edsger",), ("Donald",)]
    assert names(users.disjunctive([P("team", "eq", "systems"), P("id", "ge", 3)], ["id", "name"])) == [(2, "Grace"), (3, "Edsger"), (4, "Donald")]
    where = [P("team", "ge", "systems"), P("id", "le", 3)]
    assert names(users.conjunctive(where, ["id", "name"])) == [(2, "Grace"), (3, "Edsger")]
    indexed = IndexedTable(users, str(tmp_path)).add("team")
    assert indexed.access_path(where) == "index team" and indexed.access_path([P("id", "eq", 1)]) == "scan"
    for op in ("eq", "lt", "le", "gt", "ge"):
        for p in (P("team", op, "systems"), P("id", op, 2)):
            assert names(indexed.conjunctive([p])) == names(users.conjunctive([p]))
            assert names(indexed.disjunctive([p, P("id", "eq", 1)])) == names(users.union_by_key([p, P("id", "eq", 1)])) == names(users.disjunctive([p, P("id", "eq", 1)]))
    with pytest.raises(InvalidInput):
        indexed.add("team")


@pytest.mark.parametrize("columns, where", [([], []), (["id", "id"], []), (["ID"], []), (None, [P("id", "eq", "3")]), (None, [P("id", "eq", True)]), (None, [P("team", "eq", 3)]), (None, [P("x", "eq", 3)]), (None, [P("id", "ne", 3)]), (None, [P("id", "eq", 1 << 63)])])
def test_requests_are_checked_first(users, columns, where):
    with pytest.raises(InvalidInput):
        users.query(columns, where)


def test_empty_predicates_and_bad_tables(spark, users):
    for query in (users.conjunctive, users.disjunctive, users.union_by_key):
        with pytest.raises(InvalidInput):
            query([])
    for rows in ([(1, None, "a")], [(1, "a", "b"), (1, "c", "d")], [(1, "x" * 70_000, "b")], [(None, "a", "b")]):
        with pytest.raises(InvalidInput):
            Table("t", USERS, spark.createDataFrame(rows, "id long, team string, name string")).checked()
    for columns, key in (((), "id"), ((("a b", "text"),), "a b"), ((("a", "float"),), "a"), ((("a", "text"), ("a", "text")), "a"), ((("a", "text"),), "b")):
        with pytest.raises(InvalidInput):
            Schema(columns, key)


def test_ordered_mutations(spark):
    ops = spark.createDataFrame([(1, "upsert", 4, "t", "Donald"), (2, "upsert", 1, "t", "Ada"), (3, "upsert", 4, "t", "Barbara"), (4, "delete", 1, None, None), (5, "delete", 9, None, None)], "seq long, op string, id long, team string, name string")
    assert [tuple(r) for r in table_after(ops, USERS).collect()] == [(4, "t", "Barbara")]


def test_transactions(spark):
    log = spark.createDataFrame([(0, 1, "put", 5, 0), (1, 1, "delete", 0, 0), (2, 1, "put", 6, 2), (3, 2, "put", 1, 3)], LOG + ", tx long")
    assert {r.seq: (r.present, r.prev_val) for r in transactions.batch_previous(log).collect()} == {0: (False, None), 1: (True, 5), 2: (False, None), 3: (False, None)}
    reads = spark.createDataFrame([(3, 1, 0), (5, 2, 3), (4, 2, 1)], "tx long, key long, snapshot long")
    assert sorted(map(tuple, transactions.conflicts(log, reads).collect())) == [(3, 1, 2), (4, 2, 3)]
    assert [tuple(r) for r in transactions.oversized(log, 1).collect()] == [(0, 2)]


def test_evidence(spark):
    samples = spark.createDataFrame([(v, "g") for v in (40, 10, 30, 20)], "duration long, g string")
    assert evidence.distribution(samples, ["g"]).head() == ("g", 4, 10, 20, 40, 40)
    for n in (1, 2, 19, 20, 21, 100, 101):
        values = list(range(n))
        got = evidence.distribution(spark.createDataFrame([(v, "g") for v in values], "duration long, g string"), ["g"]).head()
        assert (got.p50, got.p95) == (values[(n * 50 + 99) // 100 - 1], values[(n * 95 + 99) // 100 - 1])
    timings = spark.createDataFrame([(1, [1, 2], [(1,), (3,)]), (2, [1], [(1,), (2,)]), (3, [5], [(5,)])], "id long, durations array<long>, samples array<struct<duration long>>")
    assert sorted(map(tuple, evidence.projection_mismatches(timings).collect())) == [(1, 1), (2, 1)]


def test_ledgers_with_holes_or_without_fields(spark):
    order = lambda k: 1 ^ (k & 1)
    fine = [(k, order(k), "included", 1, 2) for k in range(6)]
    wrong = lambda rows, n=None: sorted(map(tuple, evidence.ledger_violations(spark.createDataFrame(rows, "pair_index long, pair_order long, disposition string, first long, second long"), 5, n).collect()), key=str)
    assert wrong(fine) == wrong(fine, 6) == []
    assert wrong(fine[:2] + fine[4:]) == [(4, "hole before")] and wrong(fine[1:]) == [(1, "hole before")]
    assert wrong(fine, 7) == wrong(fine, 5) == [(None, "count")]
    assert wrong([*fine, (6, order(6), "included", 1, None), (7, order(7), "failed", None, None)]) == [(6, "fields")]


def test_generations(spark):
    listing = spark.createDataFrame([(1, "log"), (1, "marker"), (3, "log"), (3, "marker"), (2, "staging"), (5, "log"), (5, "reserved"), (4, "log")], "id long, kind string")
    assert generations.authority(listing).head() == (3, True)
    assert generations.authority(listing.filter("id <> 3 OR kind <> 'log'")).head() == (3, False)
    assert sorted(r.id for r in generations.uncommitted(listing).collect()) == [4, 5]
    assert [r.id for r in generations.orphans(listing).collect()] == [5]
    assert sorted(map(tuple, generations.obsolete(listing).collect())) == [(1, "log"), (1, "marker"), (2, "staging")]
    assert generations.next_id(listing).head()[0] == 6


#: Fingerprints of one trace of each profile.
FINGERPRINTS = {
    "point_read": "8b62b67ed7863c9c",
    "range_scan": "11fd7c642dbe424d",
    "sequential_write": "39f590db5df5a879",
    "random_write": "5f9024298838cc33",
    "mixed": "f9ed608bf9073e37",
}


@pytest.mark.parametrize("profile", FINGERPRINTS)
def test_traces_are_reproducible(spark, profile):
    config = W.TraceConfig(0x517EED, profile, 32, 64, 24, 8, 7)
    assert W.fingerprint(W.trace_json(config, W.trace(spark, config))) == FINGERPRINTS[profile]


def test_trace_checks(spark):
    assert Counter((r.phase, r.op) for r in W.trace(spark, W.TraceConfig(7, "point_read", 10, 4, 8, 1, 5)).collect()) == {("setup", "put"): 4, ("measured", "get"): 10, ("measured", "reopen"): 2}
    for config in (W.TraceConfig(7, "sequential_write", 5, 4, 8, 1), W.TraceConfig(7, "point_read", 5, 65, 1 << 20, 1), W.TraceConfig(7, "mixed", 5, 5, 8, 6), W.TraceConfig(7, "x", 5, 5, 8, 1), W.TraceConfig(7, "mixed", 5, 5, 8, 1, 0)):
        with pytest.raises(InvalidInput):
            W.trace(spark, config)
    assert W.workload(spark, 0x5EED, 100, 8, 32, 7).count() == 114


def test_workload_files(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"format_version": 1, "seed": null, "steps": [{"op": "put", "key": "", "value": ""}, {"op": "get", "key": "00FF80"}, {"op": "reopen"}]}')
    rows = [tuple(r)[1:] for r in W.read_workload(spark, str(good)).orderBy("step").collect()]
    assert rows == [(0, "put", b"", b""), (1, "get", bytes.fromhex("00ff80"), None), (2, "reopen", None, None)]
    for text, error in (('{"format_version": 2, "steps": []}', UnsupportedVersion), ('{"format_version": 1, "steps": [{"op": "drop", "key": ""}]}', InvalidInput), ('{"format_version": 1, "steps": [{"op": "put", "key": "00"}]}', InvalidInput), ('{"format_version": 1, "steps": [{"op": "get", "key": "0"}]}', Exception)):
        bad = tmp_path / "bad.json"
        bad.write_text(text)
        with pytest.raises(error):
            W.read_workload(spark, str(bad)).collect()


def test_codecs(spark):
    row = spark.createDataFrame([(258, "123456789")], "n long, t string").select(codec.hex_lower(codec.big_endian(F.col("n"))).alias("be"), codec.hex_lower(codec.little_endian(F.col("n"))).alias("le"), codec.fnv1a64(F.col("t").cast("binary")).alias("h")).head()
    assert (row.be, row.le, row.h) == ("0000000000000102", "02010000", W.fingerprint("123456789"))


def test_streamed_log(spark, tmp_path):
    rows, folder, state = random_log(5), str(tmp_path / "in"), str(tmp_path / "state")
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : (part + 1) * 100], LOG).coalesce(1).write.mode("append").parquet(folder)
        query = tail.live_state(spark, folder, state, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        want = temporal.fold(spark.createDataFrame(rows[: (part + 1) * 100], LOG))
        assert sorted(map(tuple, tail.read_state(spark, state).collect())) == sorted((r.key, r.seq, r.val) for r in want.collect())
    assert len(tail.state_batches(spark, state)) == 2


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_every_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    out = catalogue.QUERIES[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(out.columns)) for r in out.collect()), key=str)
    if name not in catalogue.SQL:
        assert got
        return
    base = duckdb.connect()
    for table in ("customer", "orders", "events", "part"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = base.execute(catalogue.SQL[name])
    names = [c[0] for c in result.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(out.columns)) for r in result.fetchall()), key=str)
    assert sorted(names) == sorted(out.columns) and got == want
