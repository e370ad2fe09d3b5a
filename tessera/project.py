"""A project's index as one object: scan, refresh, find, map, callers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answer, text_index
from tessera.operators import calls as call_ops
from tessera.operators import extract, graph, refresh, resolve, search
from tessera.sources import files as source
from tessera.sources import index_store, memory
from tessera.sources.staging import together, written


def _rows(chosen: DataFrame, hooks: dict) -> dict[str, DataFrame]:
    """What each file (path, bytes, mtime_ms, language, content) adds to the tables, importance aside.

    symbols, files and imports are written, as others are made of them.
    """
    analyzer = hooks.get("analyzer")
    symbols, files, imports = together(
        chosen.sparkSession,
        lambda: written(extract.symbols(chosen, analyzer)),
        lambda: written(extract.file_rows(chosen, hooks.get("count_tokens", T.estimate_tokens), analyzer)),
        lambda: written(extract.imports(chosen)),
    )
    docs = chosen.select("path", extract.describe("content", "language").alias("description"), F.col("content").alias("body"))
    return {
        "files": files,
        "symbols": symbols,
        "imports": imports,
        "calls": extract.calls(chosen, symbols),
        "docs": docs,
        "postings": text_index.postings(docs),
    }


def _ranks(files: DataFrame, imports: DataFrame) -> DataFrame:
    rank = graph.pagerank(files.select(F.col("path").alias("node")), written(resolve.edges(imports, files)))
    return rank.withColumnRenamed("node", "path")


def build_index(listing: DataFrame, excludes=source.EXCLUDES, ignore: str = "", **hooks) -> dict[str, DataFrame]:
    """All tables of the index of a listing (see sources.files), whose contents are read once."""
    tables = _made(listing, excludes, ignore, hooks)
    return tables | {"files": tables["files"].join(tables.pop("ranks")(), "path")}


def _made(listing: DataFrame, excludes, ignore: str, hooks: dict) -> dict[str, DataFrame | Callable[[], DataFrame]]:
    """As build_index, with what makes ranks (path, importance) instead of importance."""
    indexed = written(source.known(listing, excludes, ignore).where("language is not null"))
    chosen = indexed.where("readable")
    tables = _rows(chosen, hooks)
    tables["ranks"] = partial(_ranks, tables["files"], tables["imports"])
    others = source.known(listing.select("path"), excludes, ignore).where("language is null").select("path", F.lit(False).alias("readable"))
    tables["coverage"] = source.coverage(others.unionByName(indexed.select("path", "readable")), excludes, ignore)
    tables["stats"] = indexed.select("path", "bytes", "mtime_ms", "language", "readable")
    return tables


@dataclass
class Project:
    """An index at a path. Queries return DataFrames.

    hooks: count_tokens (text column to token count) and analyzer (language and content to declarations), as
    extract.file_rows and extract.symbols take them.
    """

    spark: SparkSession
    index: str
    hooks: dict = field(default_factory=dict)

    def scan(self, root: str, excludes=source.EXCLUDES, ignore: str = "") -> str:
        listing = source.scan(self.spark, root)
        return index_store.write(self.spark, self.index, _made(listing, excludes, ignore, self.hooks), {"root": root})

    def refresh(self, root: str, excludes=source.EXCLUDES, ignore: str = "") -> DataFrame:
        """Brings the index up to the tree; returns what changed by path: added, updated, removed or reused.

        The tree is listed without opening a file, and the listing compared with the stored one; if nothing
        differs, that is all. Else only added and updated files are opened, and one layer with their rows is written.
        Importance is found anew where files came or went or imports changed. Another writer in between makes the
        refresh begin again.
        """
        while True:
            old, meta = index_store.read(self.spark, self.index)
            listing = source.stat(self.spark, root)
            now = source.known(listing, excludes, ignore).where("language is not null")
            diff = written(refresh.snapshot_diff(old["stats"], now))
            if not diff.where("status <> 'reused'").limit(1).count():
                return diff
            came = diff.where("status in ('added', 'updated')").select("path")
            gone = diff.where("status in ('removed', 'updated')").select("path")
            opened = source.contents(self.spark, root, came).join(came, "path", "left_semi")
            opened = written(opened.withColumn("language", source.language(F.col("path"))))
            tables = _rows(opened.where("readable"), self.hooks)
            mine = old["imports"].join(came, "path", "left_semi").select("path", "spec")
            fresh = tables["imports"].select("path", "spec")
            moved = diff.where("status in ('added', 'removed')").limit(1).count() or mine.exceptAll(fresh).unionByName(fresh.exceptAll(mine)).limit(1).count()
            if moved:
                merged = {t: refresh.sync(old[t].select(*new.columns), new, diff) for t, new in (("imports", fresh), ("files", tables["files"]))}
                tables["ranks"] = lambda found=merged: _ranks(*together(self.spark, *[partial(written, found[t]) for t in ("files", "imports")]))
            stats = opened.select("path", "bytes", "mtime_ms", "language", "readable")
            seen = refresh.sync(old["stats"], stats, diff).select("path", "readable")
            others = source.known(listing.select("path"), excludes, ignore).where("language is null").select("path", F.lit(False).alias("readable"))
            tables["coverage"], tables["stats"] = source.coverage(others.unionByName(seen), excludes, ignore), stats
            try:
                index_store.append(self.spark, self.index, meta["number"], tables, gone, {"root": root})
                return diff
            except index_store.IndexMoved:
                continue

    def _tables(self) -> dict[str, DataFrame]:
        return index_store.read(self.spark, self.index)[0]

    def summary(self) -> DataFrame:
        """One row: files, symbols, tokens, symbol_source (`regex`, or `ts (N files)` where an analyzer took N), and the totals as text."""
        t = self._tables()
        found = search.index_summary(t["files"], t["symbols"])
        parsed = t["files"].agg(F.count_if(F.col("sym_source") == "ts").alias("parsed"))
        source_ = F.when(F.col("parsed") > 0, F.concat(F.lit("ts ("), F.col("parsed").cast("string"), F.lit(" files)"))).otherwise("regex")
        said = F.format_string("%s files, %s symbols, %s tokens", *[answer.number(F.col(c)) for c in ("files", "symbols", "tokens")])
        return found.crossJoin(parsed).select(*found.columns, source_.alias("symbol_source"), said.alias("said"))  # one row each

    def find(self, query: str, limit: int = search.SYMBOL_LIMIT, text_limit: int = search.TEXT_LIMIT, per_file: int = 1) -> DataFrame:
        t = self._tables()
        return search.find(t["symbols"], t["files"], t["docs"], query, limit, text_limit, per_file, t.get("postings"))

    def other_names(self, query: str) -> DataFrame:
        """The other matching names of the file that find puts first."""
        return search.other_names(self._tables()["symbols"], self.find(query), query)

    def find_within(self, query: str, budget: int = search.FIND_BUDGET) -> DataFrame:
        """find, cut to what a token budget holds."""
        cost = T.hit_cost(F.col("path"), F.coalesce("name", F.lit("")))
        order = [F.desc("tier"), F.desc("weight"), F.desc("importance"), F.asc("path")]
        return search.within_budget(self.find(query), order, cost, budget)

    def answer(self, query: str, budget: int = search.FIND_BUDGET, bodies: int = 1, callers: int = 5, per_file: int = 1, full: bool = False) -> DataFrame:
        """find as a reader takes it, within a token budget: headings with descriptions, the callers of the first hit,
        other names of its file, bodies of the first hits that are symbols and excerpts of those in texts (see
        operators.answer). full: whole bodies. One row a piece: hit, place, nth, kind, text, cost, spent, truncated."""
        t = self._tables()
        bodies, callers, per_file = max(0, min(8, bodies)), max(0, min(50, callers)), max(1, min(50, per_file))
        found = self.find(query, per_file=1)
        named = t["symbols"].select("path", "name", "kind", F.col("line").cast("long").alias("line"), "end_line").dropDuplicates(["path", "name", "line"])
        order = Window.orderBy(F.desc("tier"), F.desc("weight"), F.desc("importance"), "path")
        # as many rows as find's limits allow
        hits = found.withColumn("hit", F.row_number().over(order)).join(named, ["path", "name", "line"], "left")
        hits = written(hits.join(t["files"].select("path", "description"), "path", "left"))
        pieces = answer.headings(hits)
        first = hits.where("hit = 1 and source = 'symbol'").first()
        shown = hits.where((F.col("source") == "symbol") & (F.col("hit") <= bodies))
        if bodies:
            most = (1 << 31) - 1 if full else answer.BODY_LINES
            docs = text_index.bodies_of(t["docs"], shown)
            told = search.symbol_bodies(shown.select("hit", "path", F.col("line").cast("int").alias("line"), "end_line"), docs, most)
            pieces = pieces.unionByName(answer.bodies(hits, told.select("hit", "shown", "omitted")))
            texts = search.text_matches(t["docs"], t["files"], query, postings=t.get("postings")).select("path", "excerpt")
            pieces = pieces.unionByName(answer.excerpts(hits.where("source = 'text'").join(texts, "path")))
        if first and callers and bodies:
            report, sites = self.callers(first.name, first.path, callers)
            by = Window.orderBy(F.desc("importance"), "path", "line")
            sites = written(sites.withColumn("nth", F.row_number().over(by)))  # at most 50 rows
            pieces = pieces.unionByName(answer.callers(report, sites))
        if first and per_file > 1:
            others = search.other_names(t["symbols"], found, query).where(F.col("name") != first.name)
            others = others.orderBy(F.desc("tier"), "line", "name").limit(per_file - 1)
            others = others.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("tier"), "line", "name")))
            pieces = pieces.unionByName(answer.other_names(others.withColumn("hit", F.lit(1))))
        return answer.fold(pieces, budget)

    def file(self, rel: str) -> DataFrame:
        """The file of a path (or of its end) with its symbols and imports, which are read for that path only."""
        t = self._tables()
        found = search.file_detail(t["files"], rel).select("path").first()
        mine = F.col("path") == (found.path if found else "")
        return search.nested_entries(*[t[name].where(mine) for name in ("files", "symbols", "imports")])

    def status(self, page: str | None = None, journal: str | None = None, bug_log: str | None = None, notes: int = 5) -> DataFrame:
        """What is known of the project as one answer, in order: part, place, title, text.

        The sections of the status page, the newest notes of the journal and how many of its lines are none, how many
        bugs the log has or why it cannot be read, and what the index covers. A path that is not said is left out.
        """
        line = lambda part, place, title, text: [F.lit(part).alias("part"), place.cast("long").alias("place"), title.cast("string").alias("title"), text.cast("string").alias("text")]
        none, one, parts = F.lit(None), F.lit(1), []
        if page:
            text = self.spark.read.option("wholetext", True).text(page).select(F.lit(page).alias("path"), F.col("value").alias("text"))
            parts.append(memory.sections(text).where("title is not null").select(*line("section", F.col("section"), F.col("title"), F.col("body"))))
        if journal:
            lines = memory.checked_notes(self.spark, journal)
            newest = Window.orderBy(F.desc("at"), F.desc("seq"))  # over the newest few
            latest = memory.latest(lines.where("problem is null"), max(1, min(50, notes))).withColumn("nth", F.row_number().over(newest))
            parts.append(latest.select(*line("note", F.col("nth"), F.concat_ws(" ", "at", "kind"), F.col("text"))))
            torn = lines.agg(F.count_if(F.col("problem").isNotNull()).alias("n")).where("n > 0")
            parts.append(torn.select(*line("journal", one, none, F.concat(answer.number(F.col("n")), F.lit(" lines are no notes")))))
        if bug_log:
            found = memory.checked_bugs(self.spark, bug_log).agg(
                F.count_if(F.col("problem").isNull()).alias("n"), F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("problems")
            )
            said = F.concat(answer.number(F.col("n")), F.lit(" bugs"), F.when(F.col("problems") != "", F.concat(F.lit("; "), "problems")).otherwise(""))
            parts.append(found.select(*line("bugs", one, none, said)))
        try:
            parts.append(self.summary().select(*line("index", one, F.col("symbol_source"), F.col("said"))))
            seen = self._tables()["coverage"]
            said = F.format_string("%s of %s files indexed, %s failed, %s of other kinds", *[answer.number(F.col(c)) for c in ("candidates", "seen", "failed", "skipped")])
            parts.append(seen.select(*line("index", F.lit(2), none, said)))
        except index_store.IndexMissing:
            parts.append(self.spark.range(1).select(*line("index", one, none, F.lit("there is no index"))))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        order = F.array_position(F.array(*[F.lit(p) for p in ("section", "note", "journal", "bugs", "index")]), F.col("part"))
        return found.orderBy(order, "place")

    def map(self, focus: str = "", budget: int = search.MAP_BUDGET) -> DataFrame:
        t = self._tables()
        if not search.focus_terms(focus):
            return search.within_budget(search.directory_rollup(t["files"]), [F.desc("tokens"), F.asc("dir")], T.hit_cost(F.col("dir")), budget)
        found = search.focused_map(t["files"], t["symbols"], focus)
        order = [F.desc("exact"), F.desc("named"), F.desc("score"), F.asc("path")]
        return search.within_budget(found, order, T.hit_cost(F.col("path"), extra=8), budget)

    def attributed_calls(self) -> DataFrame:
        t = self._tables()
        return call_ops.attribute(call_ops.prune(t["calls"], t["symbols"]), t["symbols"], t["files"], resolve.edges(t["imports"], t["files"]))

    def callers(self, name: str, path: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """The report on a declaration's callers, and the most important of them."""
        found = self.attributed_calls()
        return call_ops.report(found, name, path), call_ops.top_callers(found, self._tables()["files"], name, path, limit)
