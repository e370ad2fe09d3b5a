"""The model's tables as Spark types. A format version is stored with every index."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

INDEX_VERSION = 2


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_s, _l, _i, _d, _b = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType()

FILES = _table(
    path=_s, bytes=_l, lines=_l, tokens=_l, mtime_ms=_d, language=_s, description=_s, sym_source=_s, importance=_d, class_name=_s
)
SYMBOLS = _table(path=_s, name=_s, kind=_s, line=_i, end_line=_i)
IMPORTS = _table(path=_s, spec=_s)
CALLS = _table(path=_s, name=_s, receiver=_s, receiver_type=_s, line=_i, caller=_s)
DOCS = _table(path=_s, description=_s, body=_s)
META = _table(key=_s, value=_s)
COVERAGE = _table(
    seen=_l, candidates=_l, failed=_l, skipped=_l, suffixes=ArrayType(_table(suffix=_s, n=_l))
)
NOTES = _table(at=_s, session=_s, kind=_s, text=_s)
BUGS = _table(
    id=_s, error_message=_s, root_cause=_s, fix=_s, file=_s, line=_i, tags=ArrayType(_s), occurrences=_l, first_seen=_s, last_seen=_s
)
READS = _table(session=_s, path=_s, offset=_l, limit=_l, mtime_ms=_d, size=_l, is_error=_b, at=_s)
SOURCES = _table(path=_s, content=_s, bytes=_l, mtime_ms=_d)
POSTINGS = _table(bucket=_i, term=_s, path=_s, places=ArrayType(_i))
STATS = _table(path=_s, bytes=_l, mtime_ms=_d, language=_s, readable=_b)
TABLES = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "calls": CALLS, "docs": DOCS, "meta": META, "coverage": COVERAGE}
#: What is written: importance apart from the rest of a file, as it moves with every edge; and what layers need.
STORED = {
    **TABLES,
    "files": StructType([f for f in FILES if f.name != "importance"]),
    "ranks": _table(path=_s, importance=_d),
    "postings": POSTINGS,
    "stats": STATS,
    "gone": _table(path=_s),
}
