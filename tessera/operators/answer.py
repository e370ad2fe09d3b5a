"""An answer within a token budget: the pieces that hits offer, and the ordered fold that chooses among them.

A hit offers a heading, its description, its callers, other names of its file, an excerpt or a body, in this order. What
happens to a piece that does not fit is its rule: a heading ends the answer (but the first is always said), a
description and a summary are said whatever they cost, a line of a list ends its list, anything else is left out and
later pieces are tried. What follows from a piece (how many lines a body has left out) needs it to be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Tokens that every answer keeps for its two lines of totals.
RESERVED = 40
#: Lines of a body, unless all are asked for.
BODY_LINES = 80
STOP, ALWAYS, LIST, FITS, FOLLOWS = "stop", "always", "list", "fits", "follows"
#: The order of pieces within a hit.
HEADING, DESCRIPTION, CALLERS, CALLER, MORE_CALLERS, NOTE, NAME, EXCERPT, BODY, MORE_LINES = range(10)
PIECES = "hit int, place int, nth int, kind string, text string, cost long, rule string"
_KEPT = "array<struct<hit:int,place:int,nth:int,kind:string,text:string,cost:bigint>>"


def number(c: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(c, 0)


def piece(place: int, nth: Column, kind: str, text: Column, extra: int, rule: str) -> list[Column]:
    """The columns of a piece; extra is what its line costs beyond its words. A null text offers nothing."""
    cost = (T.estimate_tokens(text) + extra).cast("long")
    return [F.lit(place).alias("place"), nth.cast("int").alias("nth"), F.lit(kind).alias("kind"), text.alias("text"), cost.alias("cost"), F.lit(rule).alias("rule")]


def headings(hits: DataFrame) -> DataFrame:
    """Headings and descriptions of hits (hit, path, name, kind, line, end_line, source, importance, description)."""
    symbol, text = F.col("source") == "symbol", F.col("source") == "text"
    where = F.when(symbol, F.format_string("%s:%d-%d", "path", "line", "end_line")).when(text & (F.col("line") > 0), F.format_string("%s:%d", "path", "line")).otherwise(F.col("path"))
    what = F.when(symbol, F.concat_ws(" ", "kind", "name")).when(text, "in text").otherwise(F.coalesce("kind", F.lit("file")))
    line = F.concat(where, F.lit("  "), what, F.lit("  ["), F.format_string("%.2f", F.coalesce("importance", F.lit(0.0))), F.lit("]"))
    told = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("    "), "description"))
    one = F.lit(0)
    return hits.select("hit", *piece(HEADING, one, "heading", line, 2, STOP)).unionByName(
        hits.select("hit", *piece(DESCRIPTION, one, "description", told, 1, ALWAYS))
    )


def bodies(hits: DataFrame, shown: DataFrame) -> DataFrame:
    """Bodies (hit, shown, omitted) of hits, and how many lines they leave out."""
    rows = hits.select("hit", "path").join(shown, "hit")
    more = F.when(F.col("omitted") > 0, F.concat(F.lit("    ... "), number(F.col("omitted")), F.lit(" more lines of "), "path"))
    one = F.lit(0)
    return rows.select("hit", *piece(BODY, one, "body", F.col("shown"), 2, FITS)).unionByName(
        rows.select("hit", *piece(MORE_LINES, one, "more", more, 1, FOLLOWS))
    )


def excerpts(found: DataFrame) -> DataFrame:
    """Excerpts (hit, excerpt), indented."""
    return found.select("hit", *piece(EXCERPT, F.lit(0), "excerpt", F.regexp_replace("excerpt", "(?m)^", "    "), 1, FITS))


def other_names(found: DataFrame) -> DataFrame:
    """The other names of a hit's file (hit, nth, name, line, end_line)."""
    return found.select("hit", *piece(NAME, F.col("nth"), "name", F.format_string("    %d-%d  %s", "line", "end_line", "name"), 1, LIST))


def callers(report: DataFrame, sites: DataFrame, hit: int = 1) -> DataFrame:
    """Who calls the first hit: of calls.report its counts, of calls.top_callers the sites (path, line, caller)."""
    ways = {"self": "its own file", "type": "the receiver's type", "only": "the only one of that name", "import": "an import"}
    counted = [F.when(F.col(f"via_{v}") > 0, F.concat(F.lit(f"{label} "), number(F.col(f"via_{v}")))) for v, label in ways.items()]
    resolved = sum((F.col(f"via_{v}") for v in ways), F.lit(0))
    head = F.concat(F.lit("called from "), number(resolved), F.lit(" places ("), F.concat_ws(", ", *counted), F.lit(")"))
    rows = report.where("total > 0").crossJoin(sites.agg(F.count(F.lit(1)).alias("listed")))  # one row each
    rest = F.when(resolved > F.col("listed"), F.concat(F.lit("    ... "), number(resolved - F.col("listed")), F.lit(" more")))
    apart = F.when(F.col("elsewhere") > 0, F.concat(number(F.col("elsewhere")), F.lit(" calls of the name mean other files")))
    open_ = F.when(F.col("ambiguous") > 0, F.concat(number(F.col("ambiguous")), F.lit(" are undecided")))
    note = F.when((F.col("elsewhere") > 0) | (F.col("ambiguous") > 0), F.concat(F.lit("    "), F.concat_ws("; ", apart, open_)))
    line = F.format_string("  %s:%d  %s", "path", "line", F.coalesce("caller", F.lit("(file)")))
    at, one = F.lit(hit).alias("hit"), F.lit(0)
    found = rows.select(at, *piece(CALLERS, one, "callers", head, 2, ALWAYS))
    found = found.unionByName(sites.select(at, *piece(CALLER, F.col("nth"), "caller", line, 1, LIST)))
    found = found.unionByName(rows.select(at, *piece(MORE_CALLERS, one, "more", rest, 1, FITS)))
    return found.unionByName(rows.select(at, *piece(NOTE, one, "note", note, 0, ALWAYS)).withColumn("cost", F.lit(0).cast("long")))


def _fold(budget: int) -> Column:
    """The fold over the sorted pieces `p`: state is what is spent, whether all has ended, the list that ended, and what is kept."""
    start = F.struct(
        F.lit(RESERVED).cast("long").alias("spent"), F.lit(False).alias("ended"), F.lit(-1).alias("closed"), F.lit(False).alias("last"),
        F.lit(False).alias("cut"), F.array().cast(_KEPT).alias("kept"),
    )

    def step(a, p):
        fits = a["spent"] + p["cost"] <= budget
        # a list is known by its hit and place
        mine = p["hit"] * 16 + p["place"]
        offered = ~a["ended"] & ~((p["rule"] == LIST) & (a["closed"] == mine)) & ~((p["rule"] == FOLLOWS) & ~a["last"])
        first = (p["rule"] == STOP) & (F.size(a["kept"]) == 0)
        take = offered & (fits | (p["rule"] == ALWAYS) | first)
        missed = offered & ~take
        said = F.struct(*[p[c].alias(c) for c in ("hit", "place", "nth", "kind", "text", "cost")])
        return F.struct(
            (a["spent"] + F.when(take, p["cost"]).otherwise(0)).alias("spent"),
            (a["ended"] | (missed & (p["rule"] == STOP))).alias("ended"),
            F.when(missed & (p["rule"] == LIST), mine).otherwise(a["closed"]).alias("closed"),
            take.alias("last"),
            (a["cut"] | missed).alias("cut"),
            F.when(take, F.concat(a["kept"], F.array(said))).otherwise(a["kept"]).alias("kept"),
        )

    return F.aggregate("pieces", start, step)


def fold(pieces: DataFrame, budget: int, least: int = 3) -> DataFrame:
    """The pieces that an answer within the budget holds, in order: hit, place, nth, kind, text, cost, and in every row
    alike spent (with what is reserved) and truncated (whether anything was left out).

    A heading costs `least` tokens or more, so that no more hits than budget / least can come, and the fold sees the
    pieces of these alone, which the limits on callers and names bound.
    """
    held = pieces.where(F.col("text").isNotNull() & (F.col("hit") <= budget // least + 1))
    order = F.array_sort(F.collect_list(F.struct("hit", "place", "nth", "kind", "text", "cost", "rule")))
    folded = held.agg(order.alias("pieces")).select(_fold(budget).alias("a"))
    return folded.select(F.explode("a.kept").alias("k"), F.col("a.spent").alias("spent"), F.col("a.cut").alias("truncated")).select("k.*", "spent", "truncated")


def totals(answer: DataFrame, hits: int) -> DataFrame:
    """One row: hits, listed, bodies, excerpts, spent, truncated."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return answer.agg(
        F.lit(hits).cast("long").alias("hits"),
        count("heading").alias("listed"),
        count("body").alias("bodies"),
        count("excerpt").alias("excerpts"),
        F.coalesce(F.max("spent"), F.lit(RESERVED)).alias("spent"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
    )
