"""Near-duplicate groups by bottom-k sketches from one hash function.

Documents with the same shingle set fall into one class first, so that copies are never paired. The INDEX
smallest hashes of a class's set go into inverted lists, split by set size since sets of similar documents
are of similar size. Two documents at the threshold share one of them but for a chance of about 1e-12.
Pairs pass if the union of their sketches of SKETCH values does not rule them out, and are links if the
Jaccard index of the full sets is high enough. Only the components of the links are wanted, so that a list
is not expanded into all its pairs:

1. Every member is paired with the list's smallest member and with its most central one, the one that
   shares most with others; in a large group of near copies that is the original or what comes next to it.
2. With the components found so far, what is left are pairs across components: in each list the members
   outside its largest component with all others. Long lists (a passage that many documents share) are
   first replaced by lists of the rarest values of a large sketch (CROWD values, for most texts the whole
   set), one for each pair of narrow size classes. Of these values similar documents must share one, too:
   documents of n and m values must share percent / (100 + percent) * (n + m), and each list holds no more
   of a document's values than that leaves free (prefix filter), so that documents that share a passage but
   differ in more than the threshold allows do not meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, join_lists, map_arrow, map_pandas, stage
from tessera.llm.components import components
from tessera.llm.shingles import mix, sets

INDEX = 16
SKETCH = 64
#: Lists of more members go through the prefix filter, with sketches of so many values.
LONG = 32
CROWD = 512
#: Pairs across components that one task forms of one list, about.
BLOCK = 1 << 18
#: Size classes within the threshold's ratio of sizes.
FINE = 4
#: 64-bit words of a parity sketch: every value of a set flips one bit, so that the sketches of two sets differ
#: in no more bits than the sets do in values.
PARITY = 8
#: Bits of the filter that keeps most texts out of the shuffle when a few are wanted. It only saves work.
FILTER_BITS = 1 << 22
#: The chance of losing a link at the threshold that a sketch test may have.
LOSS = 1e-9
PAD = np.iinfo(np.int64).max


def least_shared(k: int, percent: int) -> int:
    """The most that k values of a union's sketch, each shared with the threshold's chance, reach but for LOSS."""
    p, total = percent / 100, 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if total > LOSS:
            return t
    return k


def _describe(words: int):
    def run(batches):
        for batch in batches:
            sizes, first, second, sketches = [], [], [], []
            for found in sets(batch.column(1), words):
                sizes.append(len(found))
                u = found.view(np.uint64)
                first.append(int(u.sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(u ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)))
                sketches.append(found[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["node", "n", "s1", "s2", "sketch"],
            )

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets(batch.column(1), words)], pa.binary())],
                names=["node", "members"],
            )

    return run


def may_match(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of two arrays of padded sketches the union's sketch does not rule out."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != PAD
    new = np.ones(both.shape, dtype=bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new & real, axis=1)
    inside = real & (rank <= SKETCH)
    union = (new & inside).sum(axis=1)
    shared = (~new & inside).sum(axis=1)
    # sets of fewer values than a sketch are known in full
    full = (a[:, -1] == PAD) & (b[:, -1] == PAD) & (rank[:, -1] <= SKETCH)
    return np.where(full, 100 * shared >= percent * union, shared >= least_shared(SKETCH, percent))


def _padded(column) -> np.ndarray:
    out = np.full((len(column), SKETCH), PAD, dtype=np.int64)
    for i, s in enumerate(column):
        s = np.frombuffer(s, np.int64) if isinstance(s, bytes) else s
        out[i, : len(s)] = s
    return out


def _sift(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that their sketches (node, sketch) do not rule out."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[may_match(_padded(pdf["sa"]), _padded(pdf["sb"]), percent), ["a", "b"]]

    return stage(
        pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        .transform(map_pandas, run, "a long, b long"),
        "sifted",
    )


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, members) of the wanted nodes. A bit filter of fixed size drops most other texts before the join."""
    nodes = stage(nodes, "wanted")
    bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    word, place = F.floor(bit / 64).cast("int"), (bit % 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    table = nodes.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
    # at most FILTER_BITS / 64 rows
    kept = docs.select("node", "text", word.alias("word"), one.alias("one")).join(F.broadcast(table), "word")
    kept = kept.where(F.col("bits").bitwiseAND(F.col("one")) != 0).select("node", "text")
    return stage(kept.join(nodes, "node", "left_semi").transform(map_arrow, _sets(words), "node long, members binary"), "sets")


def _verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs those that the full sets confirm."""

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["ma"], pdf["mb"], strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return stage(
        pairs.join(full.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
        .join(full.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
        .transform(map_pandas, run, "a long, b long"),
        "links",
    )


def _lists(entries: DataFrame, percent: int) -> DataFrame:
    """entries (value, node, n) under the key of their value and size class, and of the next size class.

    Sets of the threshold's similarity lie in one size class or in neighbouring ones.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    return entries.withColumn("own", size).withColumn("size_class", F.explode(F.array(size, size + 1)))


def _fits(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _across(lists: DataFrame, percent: int, key: list[str], once) -> DataFrame:
    """Pairs of a list's members outside its largest component with its members of other components.

    once(x, y) tells whether this list is the one that emits the pair of the columns prefixed so.
    """
    parts = lists.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = (
        parts.groupBy(*key)
        .agg(
            F.max_by("component", F.struct("size", "component")).alias("major"),
            (F.sum("size") - F.max("size")).alias("minors"),
            F.sum("size").alias("members"),
            F.count(F.lit(1)).alias("parts"),
        )
        .where("parts > 1")
        .withColumn("blocks", F.ceil(F.col("minors") * F.col("members") / BLOCK).cast("int"))
        .drop("parts", "minors")
    )
    mixed = join_lists(lists, stage(mixed, "mixed"), key, "node", "members")
    rest = [c for c in lists.columns if c not in key]

    def named(rows, side, block):
        return rows.select(*key, block.alias("block"), *[F.col(c).alias(f"{side}_{c}") for c in rest])

    # the pairs of a list are dealt out in blocks: some of the members outside with all
    minor = named(mixed.where("component <> major"), "x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = named(mixed, "y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = minor.join(every, [*key, "block"]).where((F.col("x_component") != F.col("y_component")) & _fits("x_n", "y_n", percent))
    return found.where(once("x", "y")).select(*_ordered("x_node", "y_node")).distinct()


def _tokens(batches):
    """The CROWD smallest values of each set, and its parity sketch."""
    for batch in batches:
        sets_ = [np.frombuffer(m.as_py(), np.int64) for m in batch.column(2)]
        parts = [m[:CROWD] for m in sets_]
        rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        parity = np.zeros((len(sets_), PARITY * 64), dtype=np.uint8)
        for i, m in enumerate(sets_):
            parity[i] = np.bincount((m >> 7) & (PARITY * 64 - 1), minlength=PARITY * 64) & 1
        words = np.packbits(parity, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows)),
                batch.column(1).take(pa.array(rows)),
                pa.array(np.array([len(m) for m in sets_], dtype=np.int64)[rows]),
                pa.array(np.concatenate([np.zeros(0, np.int64), *parts])),
                pa.array(list(words[rows]), pa.list_(pa.int64())),
            ],
            names=["node", "component", "n", "value", "parity"],
        )


def _class(n, percent: int):
    return F.floor(F.log(n.cast("double")) / (math.log(100 / percent) / FINE) + 1e-9).cast("int")


def _crossing(crowded: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs across components among crowded (node, component), by the prefix filter."""
    tokens = stage(
        crowded.join(full, "node").select("node", "component", "members").transform(
            map_arrow,
            _tokens, "node long, component long, n long, value long, parity array<long>"
        ),
        "tokens",
    )
    often = tokens.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    common = (
        join_lists(tokens, stage(often, "often"), ["value"], "node", "often")
        .groupBy("node", "component", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("common"), F.first("parity").alias("parity"))
    )
    n, k = F.col("n"), F.least(F.col("n"), F.lit(CROWD))
    own = _class(n, percent)
    partner = F.explode(F.sequence(own - FINE - 1, own + FINE + 1)).alias("partner")
    width = math.log(100 / percent) / FINE
    least = F.greatest(F.floor(F.exp(F.col("partner") * width) * (1 - 1e-6)), F.ceil(n * percent / 100))
    exact = F.ceil((n + least) * percent / (100 + percent) - 1e-9)
    whole = F.exp((F.col("partner") + 1) * width) * (1 + 1e-6) <= CROWD
    needs = F.when(whole & (n <= CROWD), exact).otherwise(F.least(exact, F.lit(least_shared(CROWD, percent))))
    # values of one document only come first in the order of rarity
    free = (k - needs + 1) - (k - F.size("common"))
    lists = (
        common.select("node", "component", "n", "common", "parity", own.alias("own"), partner)
        .withColumn("free", F.least(free, F.size("common")).cast("int"))
        .where("free > 0")
        .select(
            "node",
            "component",
            "n",
            "own",
            "parity",
            F.least("own", "partner").alias("low"),
            F.greatest("own", "partner").alias("high"),
            F.posexplode(F.slice("common", F.lit(1), F.col("free"))["value"]).alias("at", "value"),
            F.slice("common", F.lit(1), F.col("free"))["value"].alias("rare"),
        )
        .withColumn("before", F.slice("rare", F.lit(1), F.col("at")))
        .drop("at", "rare")
    )
    lists = stage(lists, "rare-lists")

    def once(x, y):
        """In the list of their two classes and of the first value that both hold."""
        mixed = (F.col("low") == F.col("high")) | (F.col(f"{x}_own") != F.col(f"{y}_own"))
        differ = sum(
            (F.bit_count(F.get(f"{x}_parity", F.lit(i)).bitwiseXOR(F.get(f"{y}_parity", F.lit(i)))) for i in range(PARITY)), F.lit(0)
        )
        near = differ * (100 + percent) <= (F.col(f"{x}_n") + F.col(f"{y}_n")) * (100 - percent)
        return mixed & near & ~F.arrays_overlap(F.col(f"{x}_before"), F.col(f"{y}_before"))

    # lists for two classes are of use only if both are there
    key = ["value", "low", "high"]
    both = lists.groupBy(*key).agg(F.min("own").alias("o0"), F.max("own").alias("o1"), F.count(F.lit(1)).alias("m"))
    both = stage(both.where("m > 1 and (low = high or o0 <> o1)").select(*key, "m"), "rare-keys")
    return _across(stage(join_lists(lists, both, key, "node").drop("m"), "rare-shared"), percent, key, once)


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both. component_id is the
    smallest doc_id that links lead to, itself included; kept tells whether that is the row's own. Null and
    wordless texts have no shingles and no links. A null doc_id counts as smaller than all others; rows
    that repeat an id are one document with several texts. An empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("node"), F.col(text_col).alias("text"))
    described = stage(
        rows.transform(map_arrow, _describe(words), "node long, n long, s1 long, s2 long, sketch array<long>"), "sketches"
    )
    same = ["n", "s1", "s2"]
    classes = stage(
        described.where("n > 0").groupBy(*same).agg(F.min("node").alias("node"), F.first("sketch").alias("sketch")),
        "classes",
    )
    lists = stage(
        _lists(classes.select("node", "n", F.explode(F.slice("sketch", 1, INDEX)).alias("value")), percent), "lists"
    )
    key = ["value", "size_class"]
    sizes = stage(lists.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    shared = stage(join_lists(lists, sizes, key, "node"), "shared")
    central = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    ends = (
        shared.join(central, "node")
        .groupBy(*key)
        .agg(
            F.min(F.struct("node", "n")).alias("low"),
            F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("centre"),
            F.count(F.lit(1)).alias("m"),
        )
    )
    first = (
        join_lists(shared.drop("m"), stage(ends, "ends"), key, "node")
        .select("node", "n", F.explode(F.array("low", "centre")).alias("end"))
        .where("node <> end.node")
        .select("node", F.col("n").alias("na"), F.col("end.node").alias("other"), F.col("end.n").alias("nb"))
        .where(_fits("na", "nb", percent))
        .select(*_ordered("node", "other"))
        .distinct()
    )
    first = stage(first, "first-pairs")
    sketches = classes.select("node", "sketch")
    sifted = _sift(first, sketches, percent)
    full = _full_sets(rows, _nodes(sifted), words)
    links = _verify(sifted, full, percent)
    found = components(links)

    here = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    here = stage(here, "labelled")

    def once(x, y):
        return F.col("size_class") == F.greatest(f"{x}_own", f"{y}_own")

    short = _across(here.where(F.col("m") <= LONG), percent, key, once).join(first, ["a", "b"], "left_anti")
    short = _sift(short, sketches, percent)
    # members of long lists that hold more than one component
    long = here.where(F.col("m") > LONG)
    open_lists = long.groupBy(*key).agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("m").alias("m"))
    open_lists = stage(open_lists.where("c0 <> c1").select(*key, "m"), "open-lists")
    # a pair that meets in no short list shares so many values of long ones
    many = F.least(F.lit(least_shared(INDEX, percent)), F.ceil(F.col("n") * percent / 100))
    often_in = long.groupBy("node", "n").agg(F.countDistinct("value").alias("v")).where(F.col("v") >= many).select("node")
    crowded = join_lists(long.drop("m"), open_lists, key, "node").select("node", "component").distinct()
    crowded = stage(crowded.join(often_in, "node", "left_semi"), "crowded")
    wanted = _nodes(short).unionByName(crowded.select("node")).distinct().join(full.select("node"), "node", "left_anti")
    full = full.unionByName(_full_sets(rows, wanted, words))
    crossing = _crossing(crowded, full, percent).join(first, ["a", "b"], "left_anti").join(short, ["a", "b"], "left_anti")
    crossing = _sift(crossing, full.select("node", F.substring("members", 1, 8 * SKETCH).alias("sketch")), percent)
    more = _verify(short.unionByName(crossing), full, percent)
    final = components(links.unionByName(more)) if more.limit(1).count() else found

    node = F.when(F.col("node") != NULL_ID, F.col("node"))
    component = F.coalesce("component", "rep", "node")
    return (
        described.drop("sketch")
        .join(classes.select(*same, F.col("node").alias("rep")), same, "left")
        .join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            node.alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(component != NULL_ID, component).alias("component_id"),
            (F.col("node") == component).alias("kept"),
        )
    )
