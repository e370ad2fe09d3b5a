"""A Merkle manifest of a dataset: node rows linked to their parents, and proofs by a recursive query.

Every row of a table becomes a leaf digest. The leaves of a group (a language, say) stand in order of their id and
are hashed in pairs, level by level, to a subroot; the subroots of all groups, in order, are hashed to the root in the
same way. H is SHA-256, lower-case hexadecimal, of its inputs put together; a node without a partner is hashed alone.

The built levels are stored as rows linked to their parent row. A row holds LEVELS levels below one node, for a row a
level would make the query climb (and Spark shuffle all leaves) four times as often; levels=1 stores it so. A
recursive query starts at each leaf with the digest that is claimed for it, joins it with its row, takes the siblings
of that row's levels, folds the digest with them and goes on at the parent row until none is left.

Rows high up are above very many leaves: each is stored once for every BLOCK leaves below it, and joined by block too,
so that no row of the join meets more than BLOCK leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, number_ranges, shared_dir, stage

LEVELS = 4
BLOCK = 1024
#: Spark's bound on the rows of a recursive query, which is lifted while the climb runs.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
#: The tree over the subroots.
TOP = -1


def field(value: Column) -> Column:
    """What a field adds to a leaf: `-` for null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def digest_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _steps(m: Column, levels: int) -> Column:
    """How many of the next levels the m nodes of a tree's level need until one remains."""
    return sum((F.when(m > (1 << k), 1).otherwise(0) for k in range(levels)), F.lit(0))


#: Of the digests `nodes` of one row: its levels, lowest first, and the digest above them.
_LEVELS_SQL = """
aggregate(sequence(1, steps), named_struct('top', nodes, 'levels', cast(array() as array<array<binary>>)), (a, k) -> named_struct(
  'top', transform(sequence(0, (size(a.top) - 1) div 2), i -> unhex(sha2(concat(
    lower(hex(get(a.top, cast(2 * i as int)))), coalesce(lower(hex(get(a.top, cast(2 * i + 1 as int)))), '')), 256))),
  'levels', concat(a.levels, array(a.top))))
"""

#: One step up for every leaf: its digest folded with the siblings that its row `p` holds, and these siblings.
_CLIMB_SQL = """
WITH RECURSIVE climb(tree, pos, block, at_tree, at_row, at_index, slot, step, digest, siblings, id, leaf) AS (
  SELECT tree, pos, block, at_tree, at_row, at_index, slot, 0, claim, X'', id, leaf FROM {starts}
  UNION ALL
  SELECT tree, pos, block, up_tree, up_row, up_index, up_slot, step + 1, folded.digest, folded.siblings,
         cast(NULL AS {id_type}), cast(NULL AS binary)
  FROM (
    SELECT c.tree, c.pos, c.block, p.up_tree, p.up_row, p.up_index, p.up_slot, c.step,
      aggregate(sequence(0, p.steps - 1), named_struct('digest', c.digest, 'siblings', X''), (a, k) -> named_struct(
        'digest', unhex(sha2(concat(
          if(shiftright(c.slot, k) % 2 = 1, lower(hex(get(p.levels[k], shiftright(c.slot, k) - 1))), ''),
          lower(hex(a.digest)),
          if(shiftright(c.slot, k) % 2 = 0, coalesce(lower(hex(get(p.levels[k], shiftright(c.slot, k) + 1))), ''), '')), 256)),
        'siblings', concat(a.siblings, coalesce(get(p.levels[k], shiftright(c.slot, k) ^ 1), X'')))) AS folded
    FROM climb c JOIN {rows} p ON c.at_tree = p.at_tree AND c.at_row = p.at_row AND c.at_index = p.at_index
      AND c.tree = p.of_tree AND c.block = p.of_block
  )
)
SELECT tree, pos, step, digest, siblings, id, leaf FROM climb
"""


@dataclass
class Manifest:
    """leaves: id, group, tree, pos, m (leaves of the tree), digest and the columns that were kept;
    rows: the stored node rows; subroots: group, tree, m, digest; root: its hexadecimal text, None of no rows."""

    leaves: DataFrame
    rows: DataFrame
    subroots: DataFrame
    root: str | None
    levels: int


def _build(nodes: DataFrame, rounds: int, levels: int, name: str) -> tuple[DataFrame | None, DataFrame]:
    """The rows above nodes (tree, pos, m, digest), and each tree's last digest (tree, digest)."""
    found, tops, width = None, nodes.where("m = 1").select("tree", "digest"), 1 << levels
    for r in range(rounds):
        # at most `width` nodes a row
        grouped = (
            nodes.where("m > 1")
            .groupBy("tree", F.shiftright("pos", levels).alias("index"))
            .agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("held"))
            .select("tree", "index", "m", F.col("held.digest").alias("nodes"), _steps(F.col("m"), levels).alias("steps"))
            .withColumn("made", F.expr(_LEVELS_SQL))
        )
        made = stage(
            grouped.select(
                "tree", F.lit(r).alias("row"), "index", "m", "steps", "made.levels", F.get("made.top", F.lit(0)).alias("digest")
            ),
            f"{name}-{r}",
        )
        above = F.ceil(F.col("m") / width).cast("long")
        found = made if found is None else found.unionByName(made)
        tops = tops.unionByName(made.where(above == 1).select("tree", "digest"))
        nodes = made.select("tree", F.col("index").alias("pos"), above.alias("m"), "digest")
    return found, tops


def _rounds(most: int | None, levels: int) -> int:
    """Rows from a leaf to the root of a tree of `most` leaves."""
    n, rounds = most or 0, 0
    while n > 1:
        n, rounds = -(-n >> levels), rounds + 1
    return rounds


def _blocks(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK)))


def build(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", keep: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of docs: a leaf a row of the named fields, a tree a group, and the tree over the subroots.

    Leaves of a group ascend by id (null first), repeated ids by digest; groups ascend bytewise, null first. Null
    fields count as `-`, so that null and the empty text differ; a text of any length is hashed as one value.
    Repeated rows are leaves of their own. An empty table has no root. Columns of docs are only read, whatever
    their names; keep: more columns of the leaves.
    """
    spark, kept = docs.sparkSession, keep or {}
    light = docs.select(
        F.col(id_col).alias("id"),
        F.col(group_col).cast("string").alias("group"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"),
        *[c.alias(k) for k, c in kept.items()],
    )
    ranged, counts = number_ranges(light, ["group"], ["id", "digest"], "leaves")
    sizes = counts.groupBy("group").agg(F.sum("rows").alias("m"))
    known, groups = number_ranges(sizes, [], ["group"], "groups")
    trees = known.join(groups, "range").select("group", "m", (F.col("before") + F.col("nth")).alias("tree"))
    trees = stage(trees, "trees")
    start = counts.withColumnRenamed("group", "group_").join(trees, F.col("group_").eqNullSafe(F.col("group")))
    start = start.select(F.col("range").alias("range_"), "group_", "before", "tree", "m")
    leaves = ranged.join(start, (F.col("range") == F.col("range_")) & F.col("group").eqNullSafe(F.col("group_"))).select(
        "id", "group", "tree", (F.col("before") + F.col("nth")).alias("pos"), "m", "digest", *kept
    )
    leaves = stage(leaves, "leaves")

    found = trees.agg(F.max("m").alias("most"), F.count(F.lit(1)).alias("n")).first()
    lower, tops = _build(leaves.select("tree", "pos", "m", "digest"), _rounds(found.most, levels), levels, "rows")
    subroots = stage(trees.join(tops, "tree").select("group", "tree", "m", "digest"), "subroots")
    over = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(found.n).cast("long").alias("m"), "digest")
    upper, top = _build(over, _rounds(found.n, levels), levels, "top")
    last = top.first()

    width, several = 1 << levels, F.lit(found.n > 1)
    stored = []
    if lower is not None:
        final = F.col("m") <= width
        sized = lower.join(trees.select("tree", F.col("m").alias("all")), "tree")
        reach = F.pow(F.lit(float(width)), F.col("row") + 1).cast("long")
        stored.append(
            sized.select(
                F.col("tree").alias("at_tree"), F.col("row").alias("at_row"), F.col("index").alias("at_index"), F.col("tree").alias("of_tree"),
                _blocks(F.col("index") * reach, F.least(F.col("all"), (F.col("index") + 1) * reach) - 1).alias("of_block"),
                "steps", "levels",
                F.when(~final, F.col("tree")).when(several, F.lit(TOP)).cast("long").alias("up_tree"),
                F.when(~final, F.col("row") + 1).otherwise(0).alias("up_row"),
                F.when(~final, F.shiftright("index", levels)).otherwise(F.shiftright("tree", levels)).alias("up_index"),
                F.when(~final, F.col("index")).otherwise(F.col("tree")).alias("up_slot"),
            )
        )
    if upper is not None:
        for r in range(_rounds(found.n, levels)):
            below = trees.select("tree", "m", F.floor(F.col("tree") / (width ** (r + 1))).alias("index"))
            rows = upper.where(F.col("row") == r).drop("tree", "m").join(below, "index")
            stored.append(
                rows.select(
                    F.lit(TOP).cast("long").alias("at_tree"), F.col("row").alias("at_row"), F.col("index").alias("at_index"), F.col("tree").alias("of_tree"),
                    _blocks(F.lit(0), F.col("m") - 1).alias("of_block"),
                    "steps", "levels",
                    F.lit(TOP if r + 1 < _rounds(found.n, levels) else None).cast("long").alias("up_tree"),
                    (F.col("row") + 1).alias("up_row"),
                    F.shiftright("index", levels).alias("up_index"),
                    F.col("index").alias("up_slot"),
                )
            )
    rows = None
    for part in stored:
        part = part.withColumn("up_slot", (F.col("up_slot") % width).cast("int"))
        rows = part if rows is None else rows.unionByName(part)
    rows = _no_rows(spark) if rows is None else stage(rows, "node-rows")
    return Manifest(leaves, rows, subroots, bytes(last.digest).hex() if last else None, levels)


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "at_tree long, at_row int, at_index long, of_tree long, of_block long, steps int, levels array<array<binary>>, "
        "up_tree long, up_row int, up_index long, up_slot int",
    )


def prove(manifest: Manifest, claim: Column | None = None) -> DataFrame:
    """For each leaf the siblings up to the root, and the root that its claimed digest gives with them.

    id, group, leaf, subroot (text), siblings (binary: the digests one after another, from the leaf's level up),
    folded (binary). claim: what is folded, of the leaves' columns (their own digests, if not said). A leaf without siblings folds to its
    own hash, or to itself where it is the only one. No rows, no proofs.
    """
    spark, levels = manifest.leaves.sparkSession, manifest.levels
    mask, several = (1 << levels) - 1, F.col("tree").isNotNull() & F.lit(manifest.subroots.limit(2).count() > 1)
    own = F.col("m") > 1
    starts = manifest.leaves.select(
        "tree", "pos", F.floor(F.col("pos") / BLOCK).alias("block"),
        F.when(own, F.col("tree")).when(several, F.lit(TOP)).cast("long").alias("at_tree"),
        F.lit(0).alias("at_row"),
        F.when(own, F.shiftright("pos", levels)).otherwise(F.shiftright("tree", levels)).alias("at_index"),
        F.when(own, F.col("pos")).otherwise(F.col("tree")).bitwiseAND(mask).cast("int").alias("slot"),
        (F.col("digest") if claim is None else claim).alias("claim"), "id", F.col("digest").alias("leaf"),
    )
    views = fresh([t.name for t in spark.catalog.listTables()], "merkle_starts", "merkle_rows")
    before = spark.conf.get(ROW_LIMIT)
    starts.createOrReplaceTempView(views[0])
    manifest.rows.createOrReplaceTempView(views[1])
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        kind = manifest.leaves.schema["id"].dataType.simpleString()
        climbed = stage(spark.sql(_CLIMB_SQL.format(starts=views[0], rows=views[1], id_type=kind)), "climb")
    finally:
        spark.conf.set(ROW_LIMIT, before)
        for view in views:
            spark.catalog.dropTempView(view)
    # as many rows a leaf as it has stored rows above it
    steps = F.transform(F.array_sort(F.collect_list(F.struct("step", "siblings"))), lambda s: s.siblings)
    whole = climbed.groupBy("tree", "pos").agg(
        F.max("id").alias("id"), F.max("leaf").alias("leaf"), F.max_by("digest", "step").alias("folded"), steps.alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda a, s: F.concat(a, s))
    subroots = manifest.subroots.select("group", "tree", digest_text(F.col("digest")).alias("subroot"))
    return whole.join(subroots, "tree").select("id", "group", "leaf", "subroot", joined.alias("siblings"), "folded")
