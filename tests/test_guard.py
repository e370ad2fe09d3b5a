"""The read guard with more windows than a session remembers: batch, stream and a plain loop."""

import random

from tessera.operators import guard
from tessera.streaming import guard as stream

SCHEMA = "session string, win string, stat string, n long, reset boolean, ok boolean"


def plain(rows, most):
    sessions, out = {}, {}
    for session, win, stat, n, reset, ok in sorted(rows, key=lambda r: r[3]):
        known = sessions.setdefault(session, {})
        if reset:
            known.clear()
            out[n] = False
            continue
        out[n] = stat is not None and known.get(win) == stat
        if ok:
            known.pop(win, None)
            known[win] = stat
            if len(known) > most:
                del known[next(iter(known))]
    return out


def events(seed, n, windows, resets):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        session = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        win = None if rng.random() < 0.01 else f"w{int(rng.expovariate(1 / windows))}"
        stat = None if rng.random() < 0.05 else f"s{rng.randint(0, 1)}"
        rows.append((session, win, stat, i, rng.random() < resets, rng.random() < 0.9))
    return rows


def test_batch_equals_a_loop(spark):
    for seed, n, windows, resets, most in ((1, 4000, 300, 0.001, 256), (2, 1500, 10, 0.02, 4), (3, 300, 5, 0.0, 1)):
        rows = events(seed, n, windows, resets)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        found = {r.n: r.duplicate for r in guard.repeated_reads(df, "session", ["win"], "stat", ["n"], "reset", "ok", most).collect()}
        assert found == plain(rows, most)
    assert len({r[1] for r in events(1, 4000, 300, 0.001) if r[0] == "hot"}) > 256


def test_batch_equals_the_stream(spark):
    rows = [r for r in events(4, 1200, 40, 0.005) if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    batch = {r.n: r.duplicate for r in guard.repeated_reads(df, "session", ["win"], "stat", ["n"], "reset", "ok", 16).collect()}
    state, got = None, {}
    for part in range(3):
        now = df.where(f"n div 400 = {part}").selectExpr("session", "n as event", "win as window", "stat", "reset", "ok", "n")
        state = stream.repeated_reads(now, state, ["n"], 16).cache()
        got |= {r.event: r.duplicate for r in state.where("kind = 1").collect()}
    assert got == batch


def test_several_columns_empty_tables_and_names(spark):
    rows = [("s", "f", 1, "x", 1, False), ("s", "f", 1, "x", 2, False), ("s", "f", 2, "x", 3, False), ("s", "f", 1, "y", 4, False)]
    df = spark.createDataFrame(rows, "session string, path string, part int, stat string, at long, reset boolean").withColumnRenamed("stat", "a_stat")
    found = guard.repeated_reads(df, "session", ["path", "part"], "a_stat", ["at"], "reset")
    assert {r["at"]: r.duplicate for r in found.collect()} == {1: False, 2: True, 3: False, 4: False}
    assert found.columns == [*df.columns, "duplicate"]
    assert guard.repeated_reads(df.limit(0), "session", ["path"], "a_stat", ["at"], "reset").collect() == []


def test_keyed_state_goes_on_after_a_stop_and_expires(spark, tmp_path):
    import time

    from tessera.streaming import keyed_guard

    rows = [r for r in events(5, 900, 12, 0.01) if r[0] is not None]
    want = plain(rows, 8)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("session", "n as event", "win as window", "stat", "reset", "ok", "n")
    at = {name: str(tmp_path / name) for name in ("in", "state", "out")}
    for part in range(3):  # each run stops, the next one goes on
        df.where(f"n div 300 = {part}").coalesce(1).write.mode("append").parquet(at["in"])
        stream_ = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at["in"])
        keyed_guard.run(stream_, ["n"], at["state"], at["out"], most=8)
    found = spark.read.parquet(at["out"]).collect()
    assert len(found) == len(rows) and {r.event: r.duplicate for r in found} == want

    again = spark.createDataFrame([("x", 1, "w", "s", False, True, 1)], df.schema)
    again.coalesce(1).write.parquet(str(tmp_path / "in2"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in2"))
    keyed_guard.run(source(), ["n"], str(tmp_path / "state2"), str(tmp_path / "out2"), idle_ms=2000)
    time.sleep(3)
    again.selectExpr("session", "2L as event", "window", "stat", "reset", "ok", "2L as n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
    keyed_guard.run(source(), ["n"], str(tmp_path / "state2"), str(tmp_path / "out2"), idle_ms=2000)
    assert {r.event: r.duplicate for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == {1: False, 2: False}
