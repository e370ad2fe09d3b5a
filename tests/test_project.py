"""Extraction, resolution and the index on small source trees."""

import os

import pytest

from tessera.functions import bpe
from tessera.operators import calls, extract, resolve
from tessera.project import Project, build_index
from tessera.sources import files

TREE = {
    "src/auth.ts": '// Token validation for the auth service.\nimport { x } from "./util";\n// from "./nope"\n/* import "./no" */\n\n'
    "export function validateToken(t: string) {\n  return check(t);\n}\n\nexport class Session {\n  constructor() {\n    this.go();\n  }\n\n  refresh() {\n    return 1;\n  }\n}\n",
    "src/server.ts": 'import { validateToken } from "./auth";\nimport { x } from "./util";\n\nfunction serve() {\n  const s = new Session();\n  s.refresh();\n  validateToken("retry()");\n}\n',
    "src/util.ts": "export const x = 1;\nexport function check(t) {\n  return t;\n}\n",
    "pkg/a.py": 'import os, pkg.b as b\nfrom . import c\nfrom .b import thing\n\ndef outer():\n    """calls fake()"""\n    thing()  # other()\n\n\nclass K:\n    def m(self):\n        self.m()\n',
    "pkg/b.py": "def thing():\n    pass\n",
    "game/player.gd": 'class_name Player\nextends Node\n\nsignal hit\nconst MAX := 3\nvar hp = 1\n\nfunc take_damage(n):\n\thp -= n\n\temit()\n\nfunc _ready():\n\ttake_damage(1)\n',
    "game/enemy.gd": 'extends Player\nvar p: Player\n\nfunc _ready():\n\tp.take_damage(2)\n\tvar s = preload("res://game/player.gd")\n',
    "game/main.tscn": '[gd_scene]\n\n[ext_resource type="Script" path="res://game/player.gd" id="1"]\n\n[sub_resource type="Shape" id="S1"]\nradius = 1\n\n'
    '[node name="Player" type="Node"]\nscript = 1\n\n[node name="Sprite" type="S" parent="."]\n\n[node name="Box" parent="Player/Hit"]\n',
    "data/items.json": '{\n  "turnip": {\n    "price": 1,\n    "days": 2\n  },\n  "a.b": 3\n}\n',
    "node_modules/junk.js": "function junk() {}\n",
    "README.md": "# hello\n",
    "go/main.go": 'package main\n\nimport "example.com/x/store"\n\nfunc main() {\n\tstore.Open()\n}\n',
    "store/open.go": "package store\n\nfunc Open() {\n}\n",
    "rust/src/lib.rs": "use crate::a::thing;\npub fn go() {\n  thing();\n}\n",
    "src/a.rs": "pub fn thing() {}\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    listing = files.from_map(spark, TREE)
    found = build_index(listing, ignore="*.min.js\nlib/\n!keep\n/anchored/\n")
    return {k: v.collect() for k, v in found.items()}


def symbols_of(tables, path):
    return sorted((s.line, s.name, s.kind, s.end_line) for s in tables["symbols"] if s.path == path)


def test_declarations(tables):
    assert symbols_of(tables, "src/auth.ts") == [
        (6, "validateToken", "function", 8), (10, "Session", "class", 18), (11, "Session.constructor", "method", 13), (15, "Session.refresh", "method", 17),
    ]
    assert symbols_of(tables, "pkg/a.py") == [(5, "outer", "function", 7), (10, "K", "class", 12), (11, "m", "function", 12)]
    assert symbols_of(tables, "game/player.gd") == [
        (1, "Player", "class", 1), (4, "hit", "signal", 4), (5, "MAX", "const", 5), (6, "hp", "var", 6), (8, "take_damage", "function", 10), (12, "_ready", "function", 13),
    ]
    assert symbols_of(tables, "game/main.tscn") == [
        (5, "S1", "sub_resource", 6), (8, "Player", "node", 9), (11, "Sprite", "node", 11), (13, "Player/Hit/Box", "node", 13),
    ]
    assert symbols_of(tables, "data/items.json") == [(2, "turnip", "key", 2), (3, "price", "key", 3), (4, "days", "key", 4), (6, "a.b", "key", 6)]


def test_imports_and_edges(spark, tables):
    specs = {(i.path, i.spec) for i in tables["imports"]}
    assert {s for p, s in specs if p == "src/auth.ts"} == {"./util"}
    assert {s for p, s in specs if p == "pkg/a.py"} == {"os", "pkg.b", ".", ".b"}
    rows = spark.createDataFrame([tuple(f) for f in tables["files"]], "path string, bytes long, lines long, tokens long, mtime_ms double, language string, description string, sym_source string, class_name string, importance double")
    found = resolve.edges(spark.createDataFrame(list(specs), "path string, spec string"), rows).collect()
    edges = {(e.src, e.dst) for e in found}
    assert {("src/auth.ts", "src/util.ts"), ("src/server.ts", "src/auth.ts"), ("pkg/a.py", "pkg/b.py"), ("game/enemy.gd", "game/player.gd")} <= edges
    assert {("game/main.tscn", "game/player.gd"), ("go/main.go", "store/open.go"), ("rust/src/lib.rs", "src/a.rs")} <= edges
    assert not any(d == "README.md" or "junk" in d for _, d in edges)


@pytest.mark.parametrize(("language", "text", "specs"), [
    ("js", 'import a from "./a";\nexport {\n x\n} from \'b\';\nconst c = require("c"), d = import(\'d\');\nimport "side";\nlet s = "from";', ["./a", "b", "c", "d", "side"]),
    ("py", "import os, pkg.b as b\nfrom . import c\n  from .x.y import (z,\n w)\nx = 'import no'\nimportant = 1", ["os", "pkg.b", ".", ".x.y"]),
    ("go", 'import "fmt"\nimport (\n\tst "example.com/store"\n\t_ "db/driver"\n\t. "dot"\n)\nvar x = "no"\nf("no")', ["fmt", "example.com/store", "db/driver", "dot"]),
    ("rs", "use crate::a::thing;\nuse std::{fmt,\n io};\nlet use_it = 1;", ["crate::a::thing", "std::{fmt", "io}"]),
    ("gd", 'extends Node\nvar s = preload("res://a.gd")\nvar t = load( "res://b.gd" )\nvar n = load("user://c")', ["Node", "res://a.gd", "res://b.gd"]),
    ("gdres", '[ext_resource type="Script" path="res://p.gd" id="1"]\n[node path="res://no"]', ["res://p.gd"]),
    ("js", "", []),
])
def test_import_grammars(language, text, specs):
    assert extract.import_specs(text, language) == specs


@pytest.mark.parametrize(("language", "line", "want"), [
    ("gd", "var p: Player", ("p", "Player")), ("gd", "func f(a: int, q: Enemy):", ("q", "Enemy")), ("gd", "var b := Box.new()", ("b", "Box")), ("gd", "var b = Box.make()", None),
    ("py", "x: Thing = y", ("x", "Thing")), ("py", "s = Session(1)", ("s", "Session")), ("py", "s: a.b = Session()", ("s", "Session")), ("py", "s = session()", None),
    ("js", "const a: Map = b", ("a", "Map")), ("js", "let s = new Session()", ("s", "Session")), ("js", "s = new Session()", None),
    ("go", "var s *Store", ("s", "Store")), ("go", "s := &Store{}", ("s", "Store")), ("go", "s := Open()", None),
    ("rs", "let mut s: &mut Store = x", ("s", "Store")), ("rs", "let s = Store::open()", ("s", "Store")), ("rs", "s = Store::open()", None),
])
def test_stated_types(language, line, want):
    assert extract.stated_types(line, language) == ([want] if want else [])


def test_declaring_lines(spark):
    text = {
        "a.ts": "export default async function* run() {}\nexport abstract class No {}\nexport interface Shape {}\ntype Id = string\ntype\nexport enum E {}\nconst f = async (x) => x\nlet g = function () {}\nexport const K = 1\nconst local = 1\n// function no() {}",
        "b.go": "func (s *Store) Open() {\n}\nfunc main() {\n}\ntype S struct {\n}\ntype N int",
        "c.rs": "pub async fn go() {}\npub struct P;\ntrait T {}\nfn inner() {}",
        "d.gd": '@export_range(0, 10) var hp = 1\n@onready static var q\nclass Inner extends Node:\n\tpass\nclass Odd\nstatic func make():\n\tpass',
        "e.py": "async def later():\n    pass\nclass K(Base):\n    pass\ndefinitely = 1",
    }
    found = extract.symbols(files.from_map(spark, text).transform(files.candidates).select("path", "language", "content")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.path, r.line)):
        got.setdefault(r.path, []).append((r.name, r.kind))
    assert got == {
        "a.ts": [("run", "function"), ("Shape", "interface"), ("Id", "type"), ("E", "enum"), ("f", "function"), ("g", "function"), ("K", "const")],
        "b.go": [("Open", "method"), ("main", "function"), ("S", "type")],
        "c.rs": [("go", "function"), ("P", "type"), ("T", "type"), ("inner", "function")],
        "d.gd": [("hp", "var"), ("q", "var"), ("Inner", "class"), ("make", "function")],
        "e.py": [("later", "function"), ("K", "class")],
    }


def test_importance_and_description(tables):
    rank = {f.path: f.importance for f in tables["files"]}
    assert rank["game/player.gd"] == max(rank.values()) and rank["src/util.ts"] > 1 > rank["src/server.ts"]
    assert abs(sum(rank.values()) / len(rank) - 1) < 1e-3
    assert {f.path: f.description for f in tables["files"]}["src/auth.ts"] == "Token validation for the auth service."
    assert len(rank) == len(TREE) - 2


def test_calls(tables):
    found = {(c.path, c.name, c.receiver, c.receiver_type, c.line, c.caller) for c in tables["calls"]}
    assert ("src/auth.ts", "check", None, None, 7, "validateToken") in found
    assert ("src/server.ts", "Session", None, None, 5, "serve") in found
    assert ("src/server.ts", "refresh", "s", "Session", 6, "serve") in found
    assert ("game/enemy.gd", "take_damage", "p", "Player", 5, "_ready") in found
    assert ("pkg/a.py", "m", "self", "self", 12, "m") in found
    assert not any(c[1] in ("retry", "fake", "other", "if") for c in found)


def test_attribution(spark):
    s = [("player.gd", "hit", "function"), ("player.gd", "reset", "function"), ("enemy.gd", "reset", "function"), ("c.gd", "only", "function"), ("k.gd", "Box", "class"), ("k.gd", "reset", "function")]
    symbols = spark.createDataFrame([(*r, 1, 2) for r in s], "path string, name string, kind string, line int, end_line int")
    rows = spark.createDataFrame([("player.gd", "Player"), ("enemy.gd", None), ("c.gd", None), ("k.gd", None)], "path string, class_name string")
    sites = [
        ("x.gd", "hit", "p", "Player", 1), ("x.gd", "only", None, None, 2), ("enemy.gd", "reset", None, None, 3), ("enemy.gd", "reset", "self", "self", 4),
        ("x.gd", "reset", "q", None, 5), ("y.gd", "reset", "q", None, 6), ("x.gd", "reset", "Box", None, 7), ("x.gd", "unknown", None, None, 8),
    ]
    edges = spark.createDataFrame([("x.gd", "enemy.gd"), ("y.gd", "enemy.gd"), ("y.gd", "k.gd")], "src string, dst string")
    found = calls.attribute(spark.createDataFrame(sites, "path string, name string, receiver string, receiver_type string, line int"), symbols, rows, edges)
    assert {r.line: (r.via, r.target) for r in found.collect()} == {
        1: ("type", "player.gd"), 2: ("only", "c.gd"), 3: ("self", "enemy.gd"), 4: ("self", "enemy.gd"), 5: ("import", "enemy.gd"), 6: ("ambiguous", None), 7: ("type", "k.gd"),
    }


def test_ignore_rules_and_coverage(spark):
    assert files.ignored_names("lib/\n*.min.js\n!keep\n/anchored/\n# no\na*b\n") == ({"lib"}, {".min.js"})
    tree = {p: "x" for p in ("src/app.js", "lib/a.js", "b.min.js", "anchored/deep.js", ".x.js", ".hid/y.js", "a.txt", "b.txt", "c.sh", "Makefile", "bin.js")}
    listing = files.from_map(spark, tree).withColumn("readable", files.F.col("path") != "bin.js")
    kept = {r.path for r in files.candidates(listing, ignore="lib/\n*.min.js").collect()}
    assert kept == {"src/app.js", "anchored/deep.js", ".x.js"}
    row = files.coverage(listing, ignore="lib/\n*.min.js").first()
    assert (row.seen, row.candidates, row.failed, row.skipped) == (8, 3, 1, 4)
    assert [(s.suffix, s.n) for s in row.suffixes] == [(".txt", 2), ("", 1), (".sh", 1)]
    assert files.inside("/a/b", "../c") is None and files.inside("/a/b", "c/../d") == "/a/b/d"


def test_scan_refresh_and_find(spark, tmp_path):
    root = tmp_path / "tree"
    for path, text in TREE.items():
        os.makedirs((root / path).parent, exist_ok=True)
        (root / path).write_text(text)
    project = Project(spark, str(tmp_path / "index"))
    project.scan(str(root))
    assert project.summary().first().files == len(TREE) - 2
    top = project.find("validateToken").first()
    assert (top.path, top.tier, top.source) == ("src/auth.ts", 100, "symbol")
    assert project.map("token").first().path in ("src/auth.ts", "src/server.ts")
    assert project.map().count() > 1
    assert project.file("auth.ts").first().path == "src/auth.ts"
    report, callers = project.callers("take_damage", "game/player.gd")
    assert report.first().total == 2 and report.first().via_type == 1 and report.first().via_self == 1
    assert [c.path for c in callers.collect()][0] == "game/player.gd"
    (root / "src/util.ts").unlink()
    (root / "src/new.ts").write_text("export function fresh() {\n}\n")
    os.utime(root / "src/auth.ts", (1, 1))
    diff = {r.path: r.status for r in project.refresh(str(root)).collect()}
    assert diff["src/util.ts"] == "removed" and diff["src/new.ts"] == "added" and diff["src/auth.ts"] == "updated" and diff["pkg/b.py"] == "reused"
    again = Project(spark, str(tmp_path / "index2"))
    again.scan(str(root))
    for query in ("fresh", "validateToken", "token"):
        assert project.find(query).collect() == again.find(query).collect()


def test_bpe():
    spec = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "Ġ": 3, "Ġa": 4}, "merges": ["a b", "Ġ a"]}, "pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": [{"content": "<x>", "id": 9}]}
    model = bpe.Bpe(spec)
    assert model.encode("ab a<x>b") == [2, 4, 9, 1]
    with pytest.raises(ValueError):
        model.encode("A")
    for bad in ({"model": {"type": "WordPiece"}}, {**spec, "pre_tokenizer": {"type": "Whitespace"}}, {**spec, "pre_tokenizer": {}}):
        with pytest.raises(ValueError):
            bpe.Bpe(bad)
    assert len(set(bpe.byte_letters().values())) == 256
