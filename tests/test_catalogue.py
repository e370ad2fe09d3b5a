"""Registered queries against DuckDB on the smallest tables, and the memory files."""

import random

import duckdb
import pyarrow as pa
import pytest

from tessera.plans import catalogue
from tessera.sources import memory
from tessera.operators import bugs, guard
from tessera.streaming import guard as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert found == want


def test_journal(spark, tmp_path):
    path = tmp_path / "notes"
    path.mkdir()
    (path / "a.jsonl").write_text('{"at":"2024-01-01","kind":"note","text":"one"}\n{"at":"2024-01-02","kind":"note","text":"two"}\n{"at": torn')
    notes = memory.read_notes(spark, str(path))
    assert [n.text for n in memory.latest(notes, 5).collect()] == ["two", "one"]
    new = spark.createDataFrame([("2024-01-03", "s", "decision", "x" * 400)], "at string, session string, kind string, text string")
    memory.append_notes(new, str(path))
    assert memory.read_notes(spark, str(path)).count() == 3
    with pytest.raises(ValueError):
        memory.append_notes(new.withColumn("kind", memory.F.lit("note")), str(path))


def test_status_page(spark):
    text = "intro\n\n## Now\nold\n\n## Next\nkeep\n"
    page = spark.createDataFrame([("p", text)], "path string, text string")
    found = memory.sections(page)
    patched = memory.patch(found, {"Now": "new", "Avoid": "this", "Next": "  "})
    assert memory.render(patched).first().text == "intro\n\n## Now\nnew\n\n## Next\nkeep\n\n## Avoid\nthis\n"


def test_bug_log(spark, tmp_path):
    schema = "error_message string, root_cause string, fix string, file string, line int, tags array<string>, at string, seq long"
    rows = [
        ("Crash in Render", "cause", "", None, 3, ["ui"], "2024-01-01", 1), ("crash  in\nrender", "", "fix it", "a.py", None, ["ui", "gl"], "2024-01-02", 2),
        ("Other", None, None, None, None, None, "2024-01-03", 3),
    ]
    found = bugs.upsert(spark.createDataFrame(rows, schema))
    first, second = found.orderBy("id").collect()
    assert (first.id, first.occurrences, first.root_cause, first.fix, first.line, first.tags) == ("bug-001", 2, "cause", "fix it", 3, ["gl", "ui"])
    assert (second.id, second.first_seen) == ("bug-002", "2024-01-03")
    hits = bugs.search(found, "crash in render").collect()
    assert [(h.id, h.score) for h in hits] == [("bug-001", 20 + 8 + 9 + 2)]
    assert bugs.search(found, "gl").first().id == "bug-001" and bugs.search(found, " ").count() == 0
    merged = bugs.merge(found, spark.createDataFrame([("OTHER", "why", None, None, None, ["x"], "2024-02-01", 1), ("Third", "", None, None, None, None, "2024-02-02", 2)], schema))
    told = {r.id: (r.occurrences, r.root_cause, r.first_seen, r.last_seen) for r in merged.collect()}
    assert told["bug-002"] == (2, "why", "2024-01-03", "2024-02-01") and told["bug-003"][0] == 1 and told["bug-001"][0] == 2
    log = tmp_path / "bugs.json"
    log.write_text('{"version": 1, "bugs": [{"id": "bug-001", "error_message": "x", "occurrences": 2}]}')
    assert memory.read_bugs(spark, str(log)).first().occurrences == 2
    log.write_text('[{"id": "bug-007", "error_message": "y"}]')
    assert memory.read_bugs(spark, str(log)).first().id == "bug-007"


def test_bug_log_gathers_no_repeated_tags_and_numbers_by_ranges(spark):
    reports = spark.range(4000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('symptom ', id % 50) end AS error_message", "'' AS root_cause", "'' AS fix", "'' AS file", "1 AS line",
        "case when id % 7 > 0 then array(concat('t', id % 5), 't0') end AS tags", "lpad(id, 6, '0') AS at", "id AS seq",
    )
    found = bugs.upsert(reports)
    rows = found.orderBy("first_seen").collect()
    assert [r.id for r in rows] == [f"bug-{i:03d}" for i in range(1, len(rows) + 1)] and len(rows) == 51
    assert rows[0].symptom == "hot" and rows[0].tags == ["t0", "t1", "t2", "t3", "t4"] and sum(r.occurrences for r in rows) == 4000
    bare = bugs.upsert(reports.withColumn("tags", memory.F.lit(None).cast("array<string>")))
    assert bare.where("size(tags) = 0").count() == 51
    # what is gathered for the hot symptom is its distinct tags, not a list a report; numbering has no window over all rows
    gathered = bugs.tags_of(reports.withColumn("symptom", memory.F.col("error_message")))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in gathered and "flatten" not in gathered
    assert "windowspecdefinition(first" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_guard_remembers_successes_only(spark):
    rows = [
        (1, "s", "w", "a", False, True), (2, "s", "w", "a", False, True), (3, "s", "w", "b", False, False), (4, "s", "w", "b", False, True),
        (5, "s", "w", "b", False, True), (6, "s", None, None, True, True), (7, "s", "w", "b", False, True), (8, "s", "w", None, False, True), (9, "s", "w", None, False, True),
    ]
    events = spark.createDataFrame(rows, "n long, session string, win string, stat string, reset boolean, ok boolean")
    found = guard.repeated_reads(events, "session", ["win"], "stat", ["n"], "reset", "ok").orderBy("n")
    assert [r.duplicate for r in found.collect()] == [False, True, False, False, True, False, False, False, False]


def test_streamed_guard_keeps_its_state_between_batches(spark):
    rng = random.Random(4)
    rows = [
        (i, rng.choice(["a", "b", None]), f"w{rng.randrange(5)}", rng.choice(["x", "y", None]), rng.random() < 0.03, rng.random() < 0.8)
        for i in range(600)
    ]
    want, known = {}, {}
    for event, session, window, stat, reset, ok in rows:
        mine = known.setdefault(session, {})
        want[event] = not reset and stat is not None and mine.get(window) == stat
        if reset:
            mine.clear()
        elif ok:
            mine.pop(window, None)
            mine[window] = stat
            if len(mine) > 3:
                del mine[next(iter(mine))]
    events = spark.createDataFrame(rows, "event long, session string, window string, stat string, reset boolean, ok boolean")
    found, state = {}, None
    for low in (0, 200, 400):
        state = stream.repeated_reads(events.where(f"event >= {low} and event < {low + 200}"), state, ["event"], most=3)
        found |= {r.event: r.duplicate for r in state.where("kind = 1").collect()}
    assert found == want


def test_streamed_guard_does_not_hold_a_session():
    taken = 0

    def batches():
        nonlocal taken
        for i in range(50):
            taken += 1
            n = list(range(100 * i, 100 * i + 100))
            yield pa.RecordBatch.from_pydict(
                {"kind": pa.array([1] * 100, pa.int32()), "session": ["hot"] * 100, "event": n, "window": [f"w{x % 2}" for x in n], "stat": ["s"] * 100, "reset": [False] * 100, "ok": [True] * 100}
            )

    first = next(iter(stream._processor(256)(batches())))
    assert taken == 1 and first.num_rows == 100
