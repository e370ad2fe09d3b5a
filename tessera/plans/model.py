"""The model's tables (files, docs, symbols, calls, edges) as derived from the driver's tables, and the same in SQL.

A document stands in for a file: its path is source/lang/doc_id, its description the first line, its
importance the size of its source against the mean. The first word of a line is a declaration, the second
a call (on the third, for some), and document n imports document n div 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extract


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path():
    return F.concat_ws("/", "source", "lang", "doc_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # one row per source, one row for the mean
    weights = sizes.crossJoin(F.broadcast(sizes.agg(F.avg("n").alias("mean")))).select(
        "source", F.round(F.col("n") / F.col("mean"), 4).alias("importance")
    )
    return docs.join(weights, "source").select(
        "doc_id",
        _path().alias("path"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("lines"),
        T.estimate_tokens(F.col("text")).alias("tokens"),
        F.col("lang").alias("language"),
        F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(200)).alias("description"),
        "importance",
        F.get(T.words(F.col("text")), F.lit(0)).alias("class_name"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), F.col("text").alias("body"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(_path().alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return rows.select("path", (F.col("at") + 1).alias("line"), T.words(F.col("text")).alias("w")).where(F.size("w") >= 1)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        "path",
        F.get("w", F.lit(0)).alias("name"),
        F.when(F.col("line") % 3 == 0, "class").otherwise("function").alias("kind"),
        "line",
        (F.col("line") + 2).alias("end_line"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.when((F.size("w") >= 3) & (F.length(F.get("w", F.lit(2))) % 2 == 0), F.get("w", F.lit(2)))
    return _lines(spark, sf_dir).where(F.size("w") >= 2).select(
        "path",
        F.get("w", F.lit(1)).alias("name"),
        third.alias("receiver"),
        F.when(F.startswith(third, F.lit("th")), "self").alias("receiver_type"),
        "line",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"))
    return ids.select(F.col("path").alias("src"), F.floor(F.col("doc_id") / 2).cast("long").alias("doc_id")).join(
        ids.select("doc_id", F.col("path").alias("dst")), "doc_id"
    ).select("src", "dst")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of orders: the newer lost those finished, gained those in part, and touched those of high priority."""
    orders = table(spark, sf_dir, "orders")
    at = F.unix_timestamp("o_orderdate").cast("double")
    touched = F.when(F.col("o_orderpriority") == "2-HIGH", at + 1).otherwise(at)
    lost, gained = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_orderstatus") == "P"

    def listing(rows, mtime):
        return rows.select(F.col("o_orderkey").alias("path"), mtime.alias("mtime_ms"), F.col("o_custkey").alias("bytes"))

    return listing(orders.where(~gained), at), listing(orders.where(~lost), touched)


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as nodes; an edge from a customer's nation to each nation that supplies it."""
    line, orders, customer, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    edges = (
        line.select("l_orderkey", "l_suppkey")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    )
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), edges


#: Words that code_files leaves out, as they would be read as code.
NO_NAMES = sorted({*extract.KEYWORDS, *extract.DECLARING, *extract.SELF_RECEIVERS, "as"})


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Python file (path, language, content): of each line whose first two words are plain, an
    import of a module of the second, and a function of the first that calls the second."""
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    plain = [F.rlike(c, F.lit("^[a-z]+$")) & ~c.isin(*NO_NAMES) for c in (first, second)]
    block = F.format_string("from .%2$s import %1$s\ndef %1$s():\n    %2$s(1)", first, second)
    lines = _lines(spark, sf_dir).where(plain[0] & plain[1]).select("path", F.struct("line", block.alias("block")).alias("b"))
    text = F.array_join(F.array_sort(F.collect_list("b")).getField("block"), "\n")
    return lines.groupBy("path").agg(text.alias("content")).select("path", F.lit("py").alias("language"), "content")


#: What code_in_languages writes for a line: @x is its words, @a and @b names made of the first and the last, @k its number.
#: Calls, braces and comment signs within comments and strings are none.
TEMPLATES = {
    "py": """# @x(
from .@b import @a
class K@k(Base):
    def @a(self, o@k: T@k):
        said = "@x({#"
        o@k.@b(said)
        self.@b(1)
@b(2)""",
    "js": """// @x(
import { @a } from "./@b";
export class K@k extends Base {
  @a(n) {
    const said = "@x({//";
    const o@k = new T@k(said);
    o@k.@b(said);
    this.@b(1);
  }
}
@b(2);""",
    "go": """// @x(
import "@b"
type K@k struct {
\tf int
}
func (o *K@k) @a(n int) {
\tsaid := "@x({//"
\to@k := T@k{said}
\to@k.@b(said)
}
func z@k() {
\t@b(2)
}""",
    "rs": """// @x(
use crate::@b;
pub struct K@k {
    n: u32,
}
pub fn @a(n: u32) {
    let said = "@x({//";
    let o@k: T@k = said.into();
    o@k.@b(said);
}""",
}


def code_in_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source file (path, language, content) of one of four languages: each line with a word
    becomes the declarations, imports, bindings and calls of its language's template."""
    template = F.get(F.array(*map(F.lit, TEMPLATES.values())), F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int"))
    language = F.get(F.array(*map(F.lit, TEMPLATES)), F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int"))

    def block(line, at):
        w = T.words(line)
        named = lambda prefix, i: F.concat(F.lit(prefix), F.regexp_replace(F.element_at(w, i), "[^a-z0-9]", "_"))
        filled = F.replace(F.col("template"), F.lit("@x"), F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " ")))
        filled = F.replace(F.replace(filled, F.lit("@a"), named("a_", 1)), F.lit("@b"), named("b_", -1))
        return F.when(F.size(w) >= 1, F.replace(filled, F.lit("@k"), (at + 1).cast("string")))

    rows = table(spark, sf_dir, "documents").select(_path().alias("path"), language.alias("language"), template.alias("template"), "text")
    blocks = F.filter(F.transform(F.split("text", "\n", -1), block), lambda b: b.isNotNull())
    return rows.select("path", "language", F.array_join(blocks, "\n").alias("content"))


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, a, b): the first two words of every line where both are plain."""
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    lines = _lines(spark, sf_dir).where(F.rlike(a, F.lit("^[a-z]+$")) & F.rlike(b, F.lit("^[a-z]+$")))
    return lines.select(F.split_part("path", F.lit("/"), F.lit(2)).alias("lang"), a.alias("a"), b.alias("b"))


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2)"



def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: Common table expressions of the same tables, to be followed by a query.
SQL = f"""
WITH base AS (
  SELECT doc_id, source, lang, text, source || '/' || lang || '/' || doc_id AS path FROM documents
), weights AS (
  SELECT source, round(n / avg(n) OVER (), 4) AS importance FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
), files AS (
  SELECT doc_id, path, strlen(text)::BIGINT AS bytes, len(string_split(text, chr(10)))::BIGINT AS lines,
         ceil(length(text) / 4.0)::BIGINT AS tokens, lang AS language, left(string_split(text, chr(10))[1], 200) AS description,
         importance, ({_WORDS.format('text')})[1] AS class_name
  FROM base JOIN weights USING (source)
), docs AS (SELECT doc_id, path, text AS body FROM base
), split AS (
  SELECT path, string_split(text, chr(10)) AS all_lines, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line FROM base
), lined AS (SELECT path, line, {_WORDS.format('all_lines[line]')} AS w FROM split
), symbols AS (
  SELECT path, w[1] AS name, CASE WHEN line % 3 = 0 THEN 'class' ELSE 'function' END AS kind, line, line + 2 AS end_line
  FROM lined WHERE len(w) >= 1
), calls0 AS (
  SELECT path, w[2] AS name, CASE WHEN len(w) >= 3 AND length(w[3]) % 2 = 0 THEN w[3] END AS receiver, line FROM lined WHERE len(w) >= 2
), calls AS (SELECT *, CASE WHEN starts_with(receiver, 'th') THEN 'self' END AS receiver_type FROM calls0
), blocks AS (
  SELECT path, w[1] AS d, w[2] AS c, row_number() OVER (PARTITION BY path ORDER BY line) AS k FROM lined
  WHERE len(w) >= 2 AND regexp_full_match(w[1], '[a-z]+') AND regexp_full_match(w[2], '[a-z]+')
    AND w[1] NOT IN ({_quoted(NO_NAMES)}) AND w[2] NOT IN ({_quoted(NO_NAMES)})
), edges AS (SELECT a.path AS src, b.path AS dst FROM base a JOIN base b ON b.doc_id = a.doc_id // 2
)"""

_TEMPLATE = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES.values())) + " END"
_BLOCK = (
    "replace(replace(replace(replace(template, '@x', trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))), "
    "'@a', 'a_' || regexp_replace(w[1], '[^a-z0-9]', '_', 'g')), '@b', 'b_' || regexp_replace(w[-1], '[^a-z0-9]', '_', 'g')), '@k', line::VARCHAR)"
)
#: code_in_languages read by patterns over lines: raw and code (without strings and comments) of each line, what it
#: declares, and where that ends by running sums of braces, or by indentation.
CODE_SQL = (
    SQL
    + f""", filled AS (
  SELECT path, doc_id % 4 AS lang, line, {_BLOCK} AS block
  FROM (SELECT path, line, all_lines[line] AS text, w FROM lined JOIN split USING (path, line)) JOIN (SELECT path, doc_id, {_TEMPLATE} AS template FROM base) USING (path)
  WHERE len(w) >= 1
), code0 AS (SELECT path, lang, string_agg(block, chr(10) ORDER BY line) AS content FROM filled GROUP BY path, lang
), code1 AS (SELECT path, lang, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS n FROM code0"""
    + r"""
), code2 AS (SELECT *, regexp_replace(regexp_replace(raw, '"[^"]*"', '""', 'g'), CASE WHEN lang = 0 THEN '#.*$' ELSE '//.*$' END, '') AS code FROM code1
), code AS (
  SELECT *, length(raw) - length(ltrim(raw)) AS indent, sum(step) OVER (PARTITION BY path ORDER BY n) AS depth,
         max(n) OVER (PARTITION BY path) AS ends,
         last_value(CASE WHEN lang = 1 THEN nullif(regexp_extract(code, 'class (\w+)', 1), '') END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n) AS owner
  FROM (SELECT *, length(replace(code, '}', '')) - length(replace(code, '{', '')) AS step FROM code2)
), heads AS (
  SELECT *, CASE
      WHEN lang = 1 AND regexp_matches(code, '^ +\w+\(\w*\) \{$') THEN owner || '.' || regexp_extract(code, '(\w+)\(', 1)
      WHEN lang = 2 AND starts_with(code, 'func (') THEN regexp_extract(code, '\) (\w+)\(', 1)
      ELSE nullif(regexp_extract(code, '^\s*(?:export |pub )?(?:class|def|type|func|struct|fn) (\w+)', 1), '') END AS name,
    CASE WHEN regexp_matches(code, '\bclass ') THEN 'class' WHEN regexp_matches(code, '\bstruct\b') THEN 'type'
      WHEN lang = 1 OR starts_with(code, 'func (') THEN 'method' ELSE 'function' END AS kind FROM code
), declared AS (
  SELECT h.path, h.name, h.kind, h.n AS line,
    CASE WHEN h.lang = 0 THEN coalesce(min(c.n) FILTER (c.n > h.n AND c.indent <= h.indent) - 1, h.ends) ELSE min(c.n) FILTER (c.depth <= h.depth - h.step) END::INTEGER AS end_line
  FROM heads h JOIN code c ON c.path = h.path AND c.n >= h.n WHERE h.name IS NOT NULL
  GROUP BY h.path, h.name, h.kind, h.n, h.lang, h.ends, h.depth, h.step, h.indent
), sites AS (
  SELECT DISTINCT path, n AS line, nullif(c.receiver, '') AS receiver, c.name AS name
  FROM (SELECT path, n, unnest(list_zip(regexp_extract_all(code, '(?:(\w+) )?(?:(\w+)\.)?(\w+)\(', 1), regexp_extract_all(code, '(?:(\w+) )?(?:(\w+)\.)?(\w+)\(', 2),
                                        regexp_extract_all(code, '(?:(\w+) )?(?:(\w+)\.)?(\w+)\(', 3))) AS z FROM code),
       LATERAL (SELECT {'word': z[1], 'receiver': z[2], 'name': z[3]} AS c)
  WHERE coalesce(c.word, '') NOT IN ('class', 'def', 'func', 'fn')
), typed AS (
  SELECT DISTINCT path, regexp_extract(code, '\b(o\d+)(?:: | := | = new )(T\d+)', 1) AS receiver, regexp_extract(code, '\b(o\d+)(?:: | := | = new )(T\d+)', 2) AS kind
  FROM code WHERE regexp_matches(code, '\b(o\d+)(?:: | := | = new )(T\d+)')
)"""
)

SNAPSHOTS_SQL = """
WITH listing AS (
  SELECT o_orderkey AS path, epoch(o_orderdate)::DOUBLE AS mtime_ms, o_custkey AS bytes, o_orderstatus AS s, o_orderpriority AS p FROM orders
), old AS (SELECT path, mtime_ms, bytes FROM listing WHERE s <> 'P'
), new AS (
  SELECT path, CASE WHEN p = '2-HIGH' THEN mtime_ms + 1 ELSE mtime_ms END AS mtime_ms, bytes FROM listing WHERE NOT (s = 'F' AND p = '1-URGENT')
)"""
