"""Errors of the memory files as rows, and a bug log with two writers."""

import datetime as dt
import json

import pytest

from tessera.operators import bugs
from tessera.sources import bug_store, memory

REPORT = "error_message string, root_cause string, fix string, file string, line int, tags array<string>, at timestamp, seq long"


def report(message, seq, cause="", tags=()):
    return (message, cause, None, None, None, list(tags), dt.datetime(2024, 1, 1, 0, 0, seq), seq)


def test_lines_that_are_no_notes_say_why(spark, tmp_path):
    good = {"at": "2024-01-01", "session": "s", "kind": "note", "text": "fine"}
    lines = [json.dumps(good), '{"at": "2024', "", "[1]", json.dumps({"at": "x"}), json.dumps({**good, "text": 5}), json.dumps({"text": "t"}), json.dumps({**good, "kind": None})]
    (tmp_path / "journal").write_text("\n".join(lines))
    found = memory.checked_notes(spark, str(tmp_path / "journal")).orderBy("seq").collect()
    assert [r.problem for r in found] == [None, "not a JSON object", "not a JSON object", "no text", "text is no text", "no at", None]
    assert found[1].line == '{"at": "2024' and found[0].line is None and found[0].text == "fine"
    assert memory.read_notes(spark, str(tmp_path / "journal")).count() == 2


def test_logs_that_are_broken_do_not_pass_for_empty_ones(spark, tmp_path):
    entry = {"id": "bug-001", "error_message": "boom", "occurrences": 2, "tags": ["a"]}
    files = {"bare": json.dumps([entry]), "held": json.dumps({"version": 1, "bugs": [entry, {"id": "bug-002"}]}), "torn": '{"bugs": [', "odd": '{"x": 1}', "large": json.dumps([entry]) + " " * 5000, "none": '{"version": 1, "bugs": []}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = {}
    for r in memory.checked_bugs(spark, str(tmp_path), most=4000).collect():
        found.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.id, r.problem))
    assert found == {
        "bare": [("bug-001", None)], "held": [("bug-001", None), ("bug-002", "no error message")], "torn": [(None, "not JSON")],
        "odd": [(None, "no list of bugs")], "large": [(None, f"{len(files['large']):,} bytes, more than 4,000")],
    }
    assert [r.id for r in memory.read_bugs(spark, str(tmp_path / "held")).collect()] == ["bug-001"]
    assert memory.read_bugs(spark, str(tmp_path / "none")).collect() == []
    for name in ("torn", "odd"):
        with pytest.raises(memory.BrokenLog):
            memory.read_bugs(spark, str(tmp_path / name))


def test_two_writers_of_the_log_lose_nothing(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(r, REPORT)
    assert bug_store.add(spark, at, rows(report("Boom  now", 1, "old", ["a"]), report("other", 2))) == 1
    merged, stepped = bugs.merge, []

    def slow(known, reports):
        found = merged(known, reports)
        if not stepped:  # another writer is faster
            stepped.append(True)
            assert bug_store.add(spark, at, rows(report("boom NOW", 5, "new", ["b"]), report("third", 6))) == 2
        return found

    monkeypatch.setattr(bugs, "merge", slow)
    assert bug_store.add(spark, at, rows(report("boom now", 7, "", ["c"]), report("fourth", 8), report("fifth", 7))) == 3
    log, number = bug_store.read(spark, at)
    found = {r.symptom: r for r in log.collect()}
    assert number == 3 and {s: r.id for s, r in found.items()} == {"boom now": "bug-001", "other": "bug-002", "third": "bug-003", "fifth": "bug-004", "fourth": "bug-005"}
    boom = found["boom now"]
    assert (boom.occurrences, boom.root_cause, sorted(boom.tags), boom.error_message) == (3, "new", ["a", "b", "c"], "Boom  now")
    assert (boom.first_seen.second, boom.last_seen.second) == (1, 7)
    plan = merged(log, rows(report("x", 9)))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(first_seen" not in plan


def test_status_is_one_answer(spark, tmp_path):
    from tessera.project import Project

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("def f():\n    pass\n")
    (tmp_path / "tree" / "b.txt").write_text("x")
    (tmp_path / "page").write_text("intro\n## Now\nbusy\n\n## Next\nrest\n")
    (tmp_path / "journal").write_text("".join(json.dumps({"at": f"2024-01-0{i}", "session": "s", "kind": "note", "text": f"n{i}"}) + "\n" for i in range(1, 9)) + "torn{\n")
    (tmp_path / "bugs").write_text("[broken")
    project = Project(spark, str(tmp_path / "index"))
    at = {k: str(tmp_path / k) for k in ("page", "journal")}
    rows = project.status(**at, bug_log=str(tmp_path / "bugs"), notes=2).collect()
    assert [(r.part, r.title, r.text) for r in rows] == [
        ("section", "Now", "busy"), ("section", "Next", "rest"), ("note", "2024-01-08 note", "n8"), ("note", "2024-01-07 note", "n7"),
        ("journal", None, "1 lines are no notes"), ("bugs", None, "0 bugs; not JSON"), ("index", None, "there is no index"),
    ]
    project.scan(str(tmp_path / "tree"))
    assert [r.text for r in project.status().collect()] == ["1 files, 1 symbols, 5 tokens", "1 of 2 files indexed, 0 failed, 1 of other kinds"]
