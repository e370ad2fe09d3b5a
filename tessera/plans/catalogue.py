"""Registered queries over the driver's tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import bpe
from tessera.functions import text as T
from tessera.operators import answer, bugs, calls, extract, graph, guard, refresh, resolve, search, sweep, text_index
from tessera.plans import model
from tessera.plans.model import SNAPSHOTS_SQL, SQL, table
from tessera.session import bounded_batches
from tessera.sources.staging import written

#: A byte-level BPE vocabulary, for exact counts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds the decorated (spark, sf_dir) -> DataFrame function under the name, with its SQL if any."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tier(name: str, q: str) -> str:
    low = _FOLD.format(name)
    return f"CASE WHEN {low} = '{q}' THEN 100 WHEN starts_with({low}, '{q}') THEN 70 WHEN contains({low}, '{q}') THEN 45 END"


def _line(at: str) -> str:
    head = f"left(body, {at} - 1)"
    return f"(1 + length({head}) - length(replace({head}, chr(10), '')))::BIGINT"


def _weight(q: str) -> str:
    return f"(length(body) - length(replace(lower(body), '{q}', '')))::BIGINT"


_EXCERPT = r"""array_to_string(list_transform(
    list_slice(string_split(body, chr(10)), greatest(1, line - 2), least(len(string_split(body, chr(10))), line + 2)),
    lambda x, i: (i + greatest(1, line - 2) - 1)::VARCHAR || ': ' || regexp_replace(x, '\s+$', '')), chr(10))"""


_FORM = r"(' ' || trim(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"


def _texts(q: str, words: list[str], limit: int) -> str:
    held = " AND ".join(f"contains(lower(body), '{w}') AND contains({_FORM.format('body')}, ' {w} ')" for w in words)
    return f"""
    SELECT path, {_weight(q)} AS weight, importance, {_line(f"instr(lower(body), '{words[0]}')")} AS line, body
    FROM docs JOIN files USING (path) WHERE {held} ORDER BY weight DESC, importance DESC, path LIMIT {limit}"""


@register("text_search_weighted", f"{SQL} SELECT path, weight, importance, line, {_EXCERPT} AS excerpt FROM ({_texts('the', ['the'], 20)})")
def text_search_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_matches(model.docs(spark, sf_dir), model.files(spark, sf_dir), "the", limit=20)


@register(
    "text_search_excerpt", f"{SQL} SELECT path, weight, importance, line, {_EXCERPT} AS excerpt FROM ({_texts('of the', ['of', 'the'], 200)})"
)
def text_search_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_matches(model.docs(spark, sf_dir), model.files(spark, sf_dir), "of the", limit=200)


@register(
    "phrase_search_accent_fold",
    f"{SQL} SELECT path, length(body)::BIGINT AS n FROM docs WHERE contains({_FORM.format('body')}, ' etion ') AND contains({_FORM.format('body')}, ' que ')",
)
def phrase_search_accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.phrase_matches(model.docs(spark, sf_dir), "ÉTION que")
    return found.select("path", F.length("body").cast("long").alias("n"))


@register(
    "identifier_boundary",
    f"{SQL} SELECT path, regexp_matches(body, '(?i)(^|[^A-Za-z0-9_$])the([^A-Za-z0-9_$]|$)') AS found FROM docs",
)
def identifier_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.docs(spark, sf_dir).select("path", T.has_identifier(F.col("body"), "the").alias("found"))


@register(
    "match_tier_ladder",
    f"""SELECT p_partkey, p_name, coalesce({_tier('p_name', 'red')}, CASE WHEN contains({_FOLD.format('p_type')}, 'red') THEN 30
        WHEN contains({_FOLD.format('p_brand')}, '#2') THEN 12 END) AS tier FROM part""",
)
def match_tier_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.coalesce(
        T.match_tier(F.col("p_name"), "Red"),
        F.when(T.contains_ci(F.col("p_type"), "Red"), T.PATH),
        F.when(T.contains_ci(F.col("p_brand"), "#2"), T.DESCRIPTION),
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", tier.alias("tier"))


def _named(q: str, per_file: int, limit: int) -> str:
    return f"""
    SELECT path, name, kind, line, end_line, tier, importance FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier DESC, line, name) AS nth
      FROM (SELECT *, {_tier('name', q)} AS tier FROM symbols) WHERE tier IS NOT NULL) JOIN files USING (path)
    WHERE nth <= {per_file} ORDER BY tier DESC, importance DESC, path, line, name LIMIT {limit}"""


@register("per_file_topk", f"{SQL} {_named('th', 3, 500)}")
def per_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.symbol_matches(model.symbols(spark, sf_dir), model.files(spark, sf_dir), "th", per_file=3, limit=500)


def _paths(q: str, limit: int) -> str:
    return f"""
    SELECT path, importance, CASE WHEN contains({_FOLD.format('path')}, '{q}') THEN 30 WHEN contains({_FOLD.format('description')}, '{q}') THEN 12 END AS tier
    FROM files WHERE tier IS NOT NULL ORDER BY tier DESC, importance DESC, path LIMIT {limit}"""


@register("path_description_search", f"{SQL} {_paths('en', 300)}")
def path_description_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.path_matches(model.files(spark, sf_dir), "EN", limit=300)


@register(
    "merged_find",
    f"""{SQL}, found AS (
      SELECT path, name, tier, 0::BIGINT AS weight, importance, line::BIGINT AS line, 'symbol' AS source, 0 AS ord FROM ({_named('on', 1, 60)})
      UNION ALL SELECT path, NULL, tier, 0, importance, 0, 'path', 1 FROM ({_paths('on', 60)})
      UNION ALL SELECT path, NULL, 20, weight, importance, line, 'text', 2 FROM ({_texts('on', ['on'], 6)})
    ) SELECT path, name, tier, weight, importance, line, source FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier DESC, weight DESC, importance DESC, ord, line, name) AS nth FROM found
    ) WHERE nth = 1""",
)
def merged_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(model.symbols(spark, sf_dir), model.files(spark, sf_dir), model.docs(spark, sf_dir), "on")


@register(
    "blended_ranker",
    f"""{SQL}, named AS (SELECT path, max(tier) AS named FROM (SELECT path, {_tier('name', 'es')} AS tier FROM symbols) WHERE tier IS NOT NULL GROUP BY path)
    SELECT path, score FROM (
      SELECT path, coalesce(named, CASE WHEN contains({_FOLD.format('path')}, 'es') THEN 30 END,
                            CASE WHEN contains({_FOLD.format('description')}, 'es') THEN 12 END) + importance * 10 AS score
      FROM files LEFT JOIN named USING (path)) WHERE score IS NOT NULL""",
)
def blended_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.blended(model.symbols(spark, sf_dir), model.files(spark, sf_dir), "es")


@register(
    "file_detail_suffix",
    f"{SQL} SELECT path, tokens, lines FROM files WHERE ends_with({_FOLD.format('path')}, '/7') ORDER BY path <> '/7', path LIMIT 1",
)
def file_detail_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_detail(model.files(spark, sf_dir), ".//7").select("path", "tokens", "lines")


@register(
    "dir_rollup",
    f"""{SQL} SELECT split_part(path, '/', 1) AS dir, count(*) AS files, sum(tokens)::BIGINT AS tokens,
        (list(path ORDER BY importance DESC, path))[1] AS top_path FROM files GROUP BY 1""",
)
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.directory_rollup(model.files(spark, sf_dir))


@register(
    "focused_map",
    f"""{SQL}, terms AS (SELECT unnest(['the', 'src1']) AS term), points AS (
      SELECT path, sum(CASE WHEN name = term THEN 40 WHEN contains(name, term) THEN 15 ELSE 0 END) AS points, bool_or(name = term) AS exact
      FROM symbols, terms WHERE contains(name, term) GROUP BY path
    ), own AS (
      SELECT path, sum(CASE WHEN contains(lower(path), term) THEN 20 ELSE 0 END + CASE WHEN contains(lower(description), term) THEN 8 ELSE 0 END) AS own
      FROM files, terms GROUP BY path
    ) SELECT path, own + coalesce(points, 0) + importance * 12 AS score, points IS NOT NULL AS named, coalesce(exact, false) AS exact, tokens
    FROM files JOIN own USING (path) LEFT JOIN points USING (path) WHERE own + coalesce(points, 0) > 0""",
)
def focused_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.focused_map(model.files(spark, sf_dir), model.symbols(spark, sf_dir), "the, src1 x")


@register(
    "budget_prefix",
    f"""{SQL}, ranked AS (
      SELECT path, importance, (ceil(length(path) / 4.0) + 6)::BIGINT AS cost, row_number() OVER (ORDER BY importance DESC, path) AS nth FROM files
    ), run AS (SELECT *, sum(cost) OVER (ORDER BY nth)::BIGINT AS running FROM ranked)
    SELECT path, importance, cost, running FROM run WHERE running <= 1200 OR nth = 1""",
)
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.files(spark, sf_dir).select("path", "importance")
    return search.within_budget(rows, [F.desc("importance"), F.asc("path")], T.hit_cost(F.col("path")), search.MAP_BUDGET)


@register(
    "coverage_histogram",
    r"""
    SELECT suffix, n FROM (
      SELECT regexp_extract(regexp_extract(url, '^[^?#]*'), '(\.[A-Za-z0-9]+)$', 1) AS suffix, count(*) AS n FROM pages GROUP BY 1)
    ORDER BY n DESC, suffix LIMIT 24""",
)
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_extract("url", r"^[^?#]*", 0)
    return (
        table(spark, sf_dir, "pages")
        .groupBy(F.regexp_extract(bare, r"(\.[A-Za-z0-9]+)$", 1).alias("suffix"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "suffix")
        .limit(24)
    )


@register(
    "index_summary",
    f"{SQL} SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(tokens)::BIGINT FROM files) AS tokens, (SELECT count(*) FROM symbols) AS symbols",
)
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_summary(model.files(spark, sf_dir), model.symbols(spark, sf_dir))


@register(
    "nested_index",
    f"""{SQL} SELECT path, n, first, last, imports FROM (
      SELECT path, count(*) AS n, arg_min(name, (line, name)) AS first, arg_max(name, (line, name)) AS last FROM symbols GROUP BY path)
      LEFT JOIN (SELECT src AS path, string_agg(dst, ',' ORDER BY dst) AS imports FROM edges GROUP BY src) USING (path)""",
)
def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = model.edges(spark, sf_dir).select(F.col("src").alias("path"), F.col("dst").alias("spec"))
    nested = search.nested_entries(model.files(spark, sf_dir), model.symbols(spark, sf_dir), imports)
    inner = F.col("symbols")
    return nested.where("symbols is not null").select(
        "path",
        F.size(inner).cast("long").alias("n"),
        F.element_at(inner, 1)["name"].alias("first"),
        F.element_at(inner, -1)["name"].alias("last"),
        F.array_join("imports", ",").alias("imports"),
    )


@register(
    "href_imports",
    """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS spec FROM pages""",
)
def href_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(specs)).alias("spec")).distinct()


@register(
    "import_resolution",
    f"""{SQL}, wanted AS (
      SELECT path, source || '/' || unnest(['en', 'fr', 'de', 'es']) || '/' || (doc_id * 7 + 20) % (SELECT max(doc_id) + 1 FROM base) AS candidate, unnest([0, 1, 2, 3]) AS rank FROM base
    ) SELECT wanted.path, arg_min(candidate, rank) AS target FROM wanted JOIN files ON candidate = files.path GROUP BY wanted.path""",
)
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = model.files(spark, sf_dir)
    n = ((F.col("doc_id") * 7 + 20) % F.col("ids")).cast("string")
    source = F.split_part("path", F.lit("/"), F.lit(1))
    ids = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("ids"))
    specs = files.crossJoin(F.broadcast(ids)).select(  # one row
        "path", F.array(*[F.concat_ws("/", source, F.lit(lang), n) for lang in ("en", "fr", "de", "es")]).alias("candidates"))
    return graph.first_candidate(specs, files, ["path"])


def _pagerank_sql() -> str:
    steps = []
    for i in range(graph.ITERATIONS):
        steps.append(f"""r{i + 1} AS MATERIALIZED (
      SELECT node, 0.15 / n + 0.85 * coalesce(inflow, 0) + 0.85 * lost / n AS rank FROM total, nodes
      LEFT JOIN (SELECT dst AS node, sum(rank * share) AS inflow FROM shares JOIN r{i} ON src = r{i}.node GROUP BY dst) USING (node),
      (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM shares)))""")
    return f"""
    WITH nodes AS (SELECT n_nationkey AS node FROM nation), total AS (SELECT count(*) AS n FROM nation), links AS (
      SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    ), shares AS MATERIALIZED (
      SELECT src, dst, count(*) / any_value(degree) AS share FROM links JOIN (SELECT src, count(*) AS degree FROM links GROUP BY src) USING (src) GROUP BY src, dst
    ), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, total), {', '.join(steps)}
    SELECT node, round(rank * n, 4) AS importance FROM r{graph.ITERATIONS}, total"""


@register("pagerank_nations", _pagerank_sql())
def pagerank_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(*model.nation_graph(spark, sf_dir))


_ATTRIBUTED = f"""{SQL}, declared AS (SELECT DISTINCT name, path FROM symbols
), spread AS (SELECT name, count(*) AS n_declaring, min(path) AS one FROM declared GROUP BY name
), owners AS (
  SELECT type, arg_min(path, (rank, path)) AS owner FROM (
    SELECT class_name AS type, path, 0 AS rank FROM files WHERE class_name IS NOT NULL
    UNION ALL SELECT name, path, 1 FROM symbols WHERE kind = 'class') GROUP BY type
), reach AS (
  SELECT c.path, c.name, count(DISTINCT e.dst) AS n_reached, min(e.dst) AS reached
  FROM (SELECT DISTINCT path, name FROM calls) c JOIN edges e ON e.src = c.path JOIN declared d ON d.name = c.name AND d.path = e.dst GROUP BY c.path, c.name
), sites AS (
  SELECT c.*, s.n_declaring, s.one, h.path IS NOT NULL AS here, r.n_reached, r.reached,
         CASE WHEN c.receiver_type IS NOT NULL THEN t.owner ELSE o.owner END AS owner
  FROM calls c JOIN spread s USING (name) LEFT JOIN declared h ON h.name = c.name AND h.path = c.path
  LEFT JOIN reach r ON r.path = c.path AND r.name = c.name LEFT JOIN owners t ON t.type = c.receiver_type LEFT JOIN owners o ON o.type = c.receiver
), decided AS (
  SELECT s.*, CASE WHEN receiver_type IS NOT DISTINCT FROM 'self' AND here THEN 'self'
    WHEN receiver_type IS DISTINCT FROM 'self' AND d.path IS NOT NULL THEN 'type'
    WHEN (receiver IS NULL OR receiver_type IS NOT DISTINCT FROM 'self') AND here THEN 'self'
    WHEN n_declaring = 1 THEN 'only' WHEN n_reached = 1 THEN 'import' ELSE 'ambiguous' END AS via
  FROM sites s LEFT JOIN declared d ON d.name = s.name AND d.path = s.owner
), attributed AS (
  SELECT path, name, receiver, receiver_type, line, n_declaring, via,
    CASE via WHEN 'self' THEN path WHEN 'type' THEN owner WHEN 'only' THEN one WHEN 'import' THEN reached END AS target FROM decided
)"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (model.calls, model.symbols, model.files, model.edges)
    return calls.attribute(*[f(spark, sf_dir) for f in m])


@register("call_attribution", f"{_ATTRIBUTED} SELECT * FROM attributed")
def call_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir)


_TARGETED = f"{_ATTRIBUTED}, goal AS (SELECT name, target FROM attributed WHERE target IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, name, target LIMIT 1)"


@register(
    "caller_report",
    f"""{_TARGETED} SELECT count(*) AS total, count(*) FILTER (a.target = goal.target AND via = 'self') AS via_self,
      count(*) FILTER (a.target = goal.target AND via = 'type') AS via_type, count(*) FILTER (a.target = goal.target AND via = 'only') AS via_only,
      count(*) FILTER (a.target = goal.target AND via = 'import') AS via_import,
      count(*) FILTER (a.target IS NOT NULL AND a.target <> goal.target) AS elsewhere, count(*) FILTER (via = 'ambiguous') AS ambiguous
    FROM attributed a JOIN goal ON a.name = goal.name""",
)
def caller_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(_attributed(spark, sf_dir).select("path", "name", "receiver", "receiver_type", "line", "n_declaring", "via", "target"))
    goal = found.where("target is not null").groupBy("name", "target").agg(F.count(F.lit(1)).alias("n"))
    top = goal.orderBy(F.desc("n"), "name", "target").limit(1).first()
    return calls.report(found, top.name if top else "", top.target if top else "")


@register(
    "top_callers",
    f"""{_TARGETED} SELECT a.path, a.name, receiver, receiver_type, line, n_declaring, via, a.target, importance
    FROM attributed a JOIN goal ON a.name = goal.name AND a.target = goal.target JOIN files ON files.path = a.path
    ORDER BY importance DESC, a.path, line LIMIT 20""",
)
def top_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(_attributed(spark, sf_dir).select("path", "name", "receiver", "receiver_type", "line", "n_declaring", "via", "target"))
    goal = found.where("target is not null").groupBy("name", "target").agg(F.count(F.lit(1)).alias("n"))
    top = goal.orderBy(F.desc("n"), "name", "target").limit(1).first()
    return calls.top_callers(found, model.files(spark, sf_dir), top.name if top else "", top.target if top else "")


@register("semi_prune", f"{SQL} SELECT path, name, line FROM calls WHERE name IN (SELECT name FROM symbols)")
def semi_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.prune(model.calls(spark, sf_dir), model.symbols(spark, sf_dir)).select("path", "name", "line")


@register(
    "enclosing_interval",
    f"""{SQL} SELECT c.path, c.name, c.line, (
      SELECT s.name FROM symbols s WHERE s.path = c.path AND s.kind = 'function' AND c.line BETWEEN s.line AND s.end_line ORDER BY s.line DESC, s.name DESC LIMIT 1
    ) AS caller FROM calls c""",
)
def enclosing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = model.calls(spark, sf_dir).select("path", "name", "line")
    spans = model.symbols(spark, sf_dir).where("kind = 'function'")
    return sweep.enclosing(points, spans, "path", "line", "line", "end_line", "name")


_DIFF = """diff AS (
  SELECT path, CASE WHEN o.mtime_ms IS NULL THEN 'added' WHEN n.mtime_ms IS NULL THEN 'removed'
    WHEN o.mtime_ms IS DISTINCT FROM n.mtime_ms OR o.bytes IS DISTINCT FROM n.bytes THEN 'updated' ELSE 'reused' END AS status
  FROM old o FULL JOIN new n USING (path))"""


@register("snapshot_diff", f"{SNAPSHOTS_SQL}, {_DIFF} SELECT path, status FROM diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.snapshot_diff(*model.snapshots(spark, sf_dir))


@register(
    "stale_files",
    f"""{SNAPSHOTS_SQL} SELECT path, state FROM (
      SELECT o.path, CASE WHEN n.path IS NULL THEN 'missing' WHEN n.mtime_ms IS DISTINCT FROM o.mtime_ms THEN 'changed' END AS state
      FROM old o LEFT JOIN new n ON o.path = n.path) WHERE state IS NOT NULL""",
)
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.stale(*model.snapshots(spark, sf_dir))


@register("incremental_sync", f"{SNAPSHOTS_SQL} SELECT path, mtime_ms, bytes FROM new")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = model.snapshots(spark, sf_dir)
    return refresh.sync(old, new, refresh.snapshot_diff(old, new))


_REPORTS_SQL = r"""
WITH reports AS (
  SELECT trim(regexp_replace(lower(event_type || '  ' || props), '\s+', ' ', 'g')) AS symptom, event_type || '  ' || props AS error_message,
         CASE WHEN user_id % 3 = 0 THEN 'cause ' || user_id ELSE '' END AS root_cause, 'user' || user_id % 5 AS tag, ts, event_id
  FROM events WHERE event_type = 'error'
), bugs AS (
  SELECT symptom, arg_min(error_message, (ts, event_id)) AS error_message,
         arg_max(root_cause, (ts, event_id)) FILTER (root_cause <> '') AS root_cause,
         array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, count(*) AS occurrences,
         strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS first_seen, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_seen, min((ts, event_id)) AS head
  FROM reports GROUP BY symptom
), numbered AS (SELECT *, printf('bug-%03d', row_number() OVER (ORDER BY head)) AS id FROM bugs)"""


def _bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.concat("event_type", F.lit("  "), "props").alias("error_message"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("cause "), "user_id")).otherwise("").alias("root_cause"),
        F.lit(None).cast("string").alias("fix"),
        F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.array(F.concat(F.lit("user"), F.col("user_id") % 5)).alias("tags"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )
    found = bugs.upsert(reports)
    return found.withColumn("first_seen", T.iso_stamp(F.col("first_seen"))).withColumn("last_seen", T.iso_stamp(F.col("last_seen")))


_BUG_COLUMNS = ["id", "symptom", "error_message", "root_cause", "tags", "occurrences", "first_seen", "last_seen"]


@register("bug_upsert", f"{_REPORTS_SQL} SELECT {', '.join(_BUG_COLUMNS)} FROM numbered")
def bug_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bugs(spark, sf_dir).withColumn("tags", F.array_join("tags", ",")).select(*_BUG_COLUMNS)


@register(
    "bug_search",
    rf"""{_REPORTS_SQL}, fields AS (SELECT *, lower(concat_ws(chr(10), error_message, root_cause, replace(tags, ',', chr(10)))) AS every FROM numbered
    ), scored AS (SELECT *, CASE WHEN contains(symptom, 'error {{"k": 1') THEN 20 ELSE 0 END + CASE WHEN contains(every, 'error {{"k": 1') THEN 8 ELSE 0 END
      + 3 * CASE WHEN contains(every, 'error') THEN 1 ELSE 0 END AS points FROM fields)
    SELECT id, symptom, (points + least(occurrences, 5))::BIGINT AS score FROM scored WHERE points > 0 ORDER BY score DESC, last_seen DESC, id LIMIT 25""",
)
def bug_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bugs.search(_bugs(spark, sf_dir), 'Error {"k": 1', limit=25).select("id", "symptom", "score")


@register(
    "journal_latest",
    "SELECT conv_id AS session, turn AS at, role AS kind, text FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 50",
)
def journal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources import memory

    said = table(spark, sf_dir, "conversations")
    notes = said.select(F.col("conv_id").alias("at"), F.col("turn").alias("seq"), F.col("role").alias("kind"), "text")
    found = memory.latest(notes, 50)
    return found.select(F.col("at").alias("session"), F.col("seq").alias("at"), "kind", "text")


@register(
    "section_split",
    f"""{SQL}, marked AS (
      SELECT path, line, all_lines[line] AS text, starts_with(all_lines[line], 'T') AS heading FROM split
    ), numbered AS (SELECT *, sum(heading::INTEGER) OVER (PARTITION BY path ORDER BY line) AS section FROM marked)
    SELECT path, section::BIGINT AS section, max(text) FILTER (heading) AS title, count(*) FILTER (NOT heading) AS body_lines FROM numbered GROUP BY path, section""",
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources import memory

    lines = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text")
    )
    return (
        memory.number_sections(lines, ["path"], "at", F.startswith("text", F.lit("T")))
        .groupBy("path", "section")
        .agg(F.max(F.when(F.col("heading"), F.col("text"))).alias("title"), F.count_if(~F.col("heading")).alias("body_lines"))
    )


_GUARD = """
WITH e AS (SELECT *, event_type = 'signup' AS reset FROM events
), n AS (SELECT *, sum(reset::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM e)
SELECT event_id, NOT reset AND coalesce(lag(props) OVER (PARTITION BY user_id, epoch, reset, event_type ORDER BY ts, event_id) = props, false) AS duplicate FROM n"""


@register("read_guard_batch", _GUARD)
def read_guard_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("reset", F.col("event_type") == "signup")
    return guard.repeated_reads(events, "user_id", ["event_type"], "props", ["ts", "event_id"], "reset").select("event_id", "duplicate")


@register("read_guard_stream", _GUARD)
def read_guard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.streaming import guard as stream

    return stream.over_parquet(spark, f"{sf_dir}/events.parquet", "user_id", "event_type", "props", ["ts", "event_id"], "event_type = 'signup'", "event_id")


@register("token_estimate", f"{SQL} SELECT path, bytes, lines, tokens FROM files")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.files(spark, sf_dir).select("path", "bytes", "lines", "tokens")


@register(
    "pad_cjk",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(text, 'eoa', '日ほ한'), '([日ほ한])', ' \1 ', 'g'), '\s+', ' ', 'g')) AS padded FROM documents""",
)
def pad_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the texts with three of their vowels as characters of three scripts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.pad_cjk(F.translate("text", "eoa", "日ほ한")).alias("padded"))


@register("extracted_symbols", f"{SQL} SELECT path, d AS name, 'function' AS kind, (3 * k - 1)::INTEGER AS line, (3 * k)::INTEGER AS end_line FROM blocks")
def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.symbols(model.code_files(spark, sf_dir))


@register("extracted_imports", f"{SQL} SELECT DISTINCT path, '.' || c AS spec FROM blocks")
def extracted_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.imports(model.code_files(spark, sf_dir))


@register("extracted_calls", f"{SQL} SELECT path, c AS name, (3 * k)::INTEGER AS line, d AS caller FROM blocks")
def extracted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = written(model.code_files(spark, sf_dir))
    return extract.calls(code, written(extract.symbols(code))).select("path", "name", "line", "caller")


@register("language_symbols", f"{model.CODE_SQL} SELECT * FROM declared")
def language_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, members, types and functions, with their ends, of files in four languages made of every line."""
    return extract.symbols(model.code_in_languages(spark, sf_dir))


@register(
    "language_imports",
    model.CODE_SQL
    + r""" SELECT DISTINCT path, coalesce(nullif(regexp_extract(raw, '^import (?:.* from )?"([^"]+)"', 1), ''), nullif(regexp_extract(raw, '^from (\S+) import', 1), ''),
      regexp_extract(raw, '^use ([^;]+);', 1)) AS spec FROM code WHERE regexp_matches(raw, '^(import|from|use) ')""",
)
def language_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.imports(model.code_in_languages(spark, sf_dir))


@register(
    "language_calls",
    f"""{model.CODE_SQL} SELECT s.path, s.name, s.receiver, CASE WHEN s.receiver IN ('self', 'this') THEN 'self' ELSE t.kind END AS receiver_type, s.line,
      (SELECT arg_max(d.name, d.line) FROM declared d WHERE d.path = s.path AND d.kind IN ('function', 'method') AND s.line BETWEEN d.line AND d.end_line) AS caller
      FROM sites s LEFT JOIN typed t ON t.path = s.path AND t.receiver = s.receiver""",
)
def language_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with receivers, stated types and callers of the same files."""
    code = written(model.code_in_languages(spark, sf_dir))
    return extract.calls(code, written(extract.symbols(code))).select("path", "name", "receiver", "receiver_type", "line", "caller")


@register(
    "symbol_bodies",
    f"""{SQL} SELECT s.path, s.name, s.line, array_to_string(list_slice(string_split(body, chr(10)), s.line, least(s.end_line, s.line + 1)), chr(10)) AS shown,
      greatest(0, least(s.end_line, len(string_split(body, chr(10)))) - s.line + 1 - 2)::INTEGER AS omitted FROM symbols s JOIN docs USING (path)""",
)
def symbol_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.symbol_bodies(model.symbols(spark, sf_dir), model.docs(spark, sf_dir), most=2)
    return found.select("path", "name", "line", "shown", "omitted")


@register("important_files", f"{SQL} SELECT path, importance FROM files ORDER BY importance DESC, path LIMIT 5")
def important_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.files(spark, sf_dir).select("path", "importance").orderBy(F.desc("importance"), "path").limit(5)


@register(
    "text_index_postings",
    f"""{SQL}, terms AS (SELECT path, string_split(trim({_FORM.format('body')}), ' ') AS t FROM docs
    ), placed AS (SELECT path, t[i] AS term, i - 1 AS place FROM (SELECT path, t, unnest(range(1, len(t) + 1)) AS i FROM terms) WHERE t[i] <> '')
    SELECT path, term, count(*) AS n, min(place)::INTEGER AS first, sum(place)::BIGINT AS places FROM placed GROUP BY path, term""",
)
def text_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting of the index of all documents: how often a word is in a body, its first place, the sum of all."""
    found = text_index.postings(model.docs(spark, sf_dir).select("path", "body"))
    total = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("path", "term", F.size("places").cast("long").alias("n"), F.get("places", F.lit(0)).alias("first"), total.alias("places"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents, written as the index store writes it."""
    return written(text_index.postings(model.docs(spark, sf_dir).select("path", "body")), partition_by="bucket")


_INDEXED = {"the": ["the"], "of the": ["of", "the"], "que ainsi": ["que", "ainsi"], "nowhere-to-be": ["nowhere-to-be"]}


@register(
    "indexed_text_search",
    SQL + " " + " UNION ALL ".join(
        f"SELECT '{q}' AS query, path, weight, importance, line, {_EXCERPT} AS excerpt FROM ({_texts(q, words, 50)})" for q, words in _INDEXED.items()
    ),
)
def indexed_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_matches by the positional index, for a common word, two words, words of another language and one that is nowhere."""
    docs, files, index = model.docs(spark, sf_dir).select("path", "body"), model.files(spark, sf_dir), _indexed(spark, sf_dir)
    found = None
    for q in _INDEXED:
        rows = search.text_matches(docs, files, q, 50, index).select(F.lit(q).alias("query"), "path", "weight", "importance", "line", "excerpt")
        found = rows if found is None else found.unionByName(rows)
    return found


@register("indexed_phrases", f"{SQL} SELECT path, contains({_FORM.format('body')}, ' the of ') AS adjacent FROM docs WHERE contains({_FORM.format('body')}, ' the of ') OR contains({_FORM.format('body')}, ' of the ')")
def indexed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with two words next to each other in either order, by joining their places."""
    index = _indexed(spark, sf_dir)
    found = [text_index.matching(index, text_index.wanted(spark, q)).withColumn("adjacent", F.lit(k)) for k, q in ((True, "the-of"), (False, "of-the"))]
    return found[0].unionByName(found[1]).groupBy("path").agg(F.bool_or("adjacent").alias("adjacent"))


_ANSWER_BUDGET = 400


@register(
    "answer_packing",
    f"""WITH RECURSIVE {SQL.strip().removeprefix("WITH ")}, hits AS (
      SELECT *, row_number() OVER (ORDER BY tier DESC, importance DESC, path, line, name)::INTEGER AS hit FROM ({_named('th', 1, 60)})
    ), told AS (
      SELECT hit, path || ':' || line || '-' || end_line || '  ' || kind || ' ' || name || '  [' || printf('%.2f', h.importance) || ']' AS heading,
             CASE WHEN f.description <> '' THEN '    ' || f.description END AS description,
             array_to_string(list_slice(string_split(body, chr(10)), line, least(end_line, line + 79)), chr(10)) AS body
      FROM hits h JOIN files f USING (path) JOIN docs USING (path)
    ), pieces AS (
      SELECT hit, 0 AS place, 'heading' AS kind, heading AS text, ceil(length(heading) / 4.0)::BIGINT + 2 AS cost FROM told
      UNION ALL SELECT hit, 1, 'description', description, ceil(length(description) / 4.0)::BIGINT + 1 FROM told WHERE description IS NOT NULL
      UNION ALL SELECT hit, 8, 'body', body, ceil(length(body) / 4.0)::BIGINT + 2 FROM told WHERE hit <= 8
    ), ordered AS (SELECT *, row_number() OVER (ORDER BY hit, place) AS k FROM pieces
    ), fold AS (
      SELECT 0::BIGINT AS k, 40::BIGINT AS spent, false AS ended, false AS taken, false AS cut
      UNION ALL
      SELECT o.k, f.spent + CASE WHEN NOT f.ended AND (f.spent + o.cost <= {_ANSWER_BUDGET} OR o.kind = 'description' OR o.k = 1) THEN o.cost ELSE 0 END,
             f.ended OR (o.kind = 'heading' AND o.k > 1 AND f.spent + o.cost > {_ANSWER_BUDGET}),
             NOT f.ended AND (f.spent + o.cost <= {_ANSWER_BUDGET} OR o.kind = 'description' OR o.k = 1),
             f.cut OR (NOT f.ended AND o.kind <> 'description' AND o.k > 1 AND f.spent + o.cost > {_ANSWER_BUDGET})
      FROM fold f JOIN ordered o ON o.k = f.k + 1
    )
    SELECT hit, kind, text, cost, (SELECT max(spent) FROM fold) AS spent, (SELECT bool_or(cut) FROM fold) AS truncated
    FROM fold JOIN ordered USING (k) WHERE taken""",
)
def answer_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a search of all symbols within a budget: headings, descriptions and eight bodies."""
    files, docs = model.files(spark, sf_dir), model.docs(spark, sf_dir).select("path", "body")
    found = search.symbol_matches(model.symbols(spark, sf_dir), files, "th", per_file=1, limit=60)
    order = Window.orderBy(F.desc("tier"), F.desc("importance"), "path", "line", "name")
    hits = written(found.withColumn("hit", F.row_number().over(order)).withColumn("source", F.lit("symbol")).join(files.select("path", "description"), "path"))
    shown = search.symbol_bodies(hits.where("hit <= 8").select("hit", "path", "line", "end_line"), text_index.bodies_of(docs, hits))
    pieces = answer.headings(hits).unionByName(answer.bodies(hits, shown.select("hit", "shown", "omitted")))
    return answer.fold(pieces, _ANSWER_BUDGET).select("hit", "kind", "text", "cost", "spent", "truncated")


_REMEMBERED = 16


@register(
    "read_guard_evicting",
    f"""WITH e AS (
      SELECT event_id, event_type AS session, user_id AS win, props AS stat, event_id % 97 = 0 AS reset, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events
    ), r AS (SELECT *, sum(reset::INTEGER) OVER (PARTITION BY session ORDER BY n) AS epoch FROM e
    ), p AS (
      SELECT *, lag(n) OVER w AS before, lag(stat) OVER w AS held FROM r WHERE NOT reset WINDOW w AS (PARTITION BY session, epoch, win ORDER BY n)
    ), between_ AS (
      SELECT p.event_id, count(DISTINCT q.win) AS others FROM p JOIN p q ON q.session = p.session AND q.n > p.before AND q.n < p.n WHERE p.held = p.stat GROUP BY p.event_id
    )
    SELECT r.event_id, coalesce(NOT r.reset AND p.held = p.stat AND coalesce(others, 0) < {_REMEMBERED}, false) AS duplicate
    FROM r LEFT JOIN p USING (event_id) LEFT JOIN between_ USING (event_id)""",
)
def read_guard_evicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few sessions of thousands of windows each, of which they remember the last 16."""
    events = table(spark, sf_dir, "events").withColumn("reset", F.col("event_id") % 97 == 0)
    found = guard.repeated_reads(events, "event_type", ["user_id"], "props", ["ts", "event_id"], "reset", most=_REMEMBERED)
    return found.select("event_id", "duplicate")


@register(
    "resolved_imports",
    f"""{SQL}, words AS (
      SELECT split_part(path, '/', 2) AS lang, w[1] AS a, w[2] AS b FROM lined
      WHERE len(w) >= 2 AND regexp_full_match(w[1], '[a-z]+') AND regexp_full_match(w[2], '[a-z]+')
    ), modules AS (SELECT DISTINCT lang, a FROM words)
    SELECT DISTINCT w.lang || '/' || w.a || '.py' AS src, w.lang || '/' || w.b || '.py' AS dst FROM words w JOIN modules m ON m.lang = w.lang AND m.a = w.b""",
)
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of all lines as modules of their language, which import the second ones from their own folder."""
    words = model.word_pairs(spark, sf_dir)
    files = words.select(F.format_string("%s/%s.py", "lang", "a").alias("path"), F.lit("py").alias("language"), F.lit(None).cast("string").alias("class_name")).distinct()
    specs = words.select(F.format_string("%s/%s.py", "lang", "a").alias("path"), F.concat(F.lit("."), "b").alias("spec")).distinct()
    return resolve.edges(specs, files).select("src", "dst").distinct()


@register("exact_tokens")
def exact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level BPE count of every document by a public vocabulary (tested against its library)."""
    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    bounded_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", bpe.count_tokens(F.coalesce("text", F.lit("")), spec).alias("tokens"))
