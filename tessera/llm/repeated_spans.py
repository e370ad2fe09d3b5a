"""Removal of repeated byte spans: depth-limited radix sorting of suffixes.

A suffix matters only through its first DEPTH bytes. Documents that equal an earlier one in full are settled
by their SHA-256. For the others:

1. The first pass deals suffixes out by an anchor. Of every DEPTH bytes the anchor is the run of GRAM bytes in
   them with the smallest hash: equal windows have equal anchors at equal places, and about one byte in 35
   starts an anchor. Anchors that occur once end here, and with them every suffix under them.
2. The surviving anchors' surroundings are fetched. Within a group what follows the anchor and, backwards, what
   precedes it are put in order by most-significant-digit passes over digits of eight bytes; a pass touches
   only what the digits before have left tied. A suffix that begins some bytes before the anchor is as far to
   the left and the rest of DEPTH to the right of it, so that two neighbours in the order agree in it if they
   share that many bytes: equal groups are exactly the repeated windows. All but the first member of each are
   marked. Bytes decide; hashes only deal out.

An anchor with very many places (a passage that a large share of all documents holds) would make a group too
large for one task. Its suffixes are dealt out by all their digits at once instead, in an aggregation that
combines before it shuffles and keeps the first place of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, map_arrow, stage, text_keys, text_sha
from tessera.llm.shingles import _BASE, _BYTE, SLICE_BYTES, Powers, mix, text_slices

DEPTH = 100
GRAM = 32
#: The suffixes of a group of more places are dealt out by all their digits.
LARGE = 4096
#: So many contexts are settled at a time, or one group.
FLUSH = 8000
#: So many places of an anchor in one batch make it a large group at once, dealt over SALTS keys.
LOCAL = 256
SALTS = 64
#: Bytes of a digit.
DIGIT = 8
#: Rows of one batch of contexts or windows.
PACK = 20_000
_ZERO = np.uint64(0)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width], for every i that has so many."""
    size = 1
    while size * 2 <= width:
        x = op(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, depth: int, memory: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that lie one after another; windows stay within a text."""
    gram = min(GRAM, depth)
    width = depth - gram + 1
    n = len(data)
    if n < depth:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    memory.to(n + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * memory.up[:n], dtype=np.uint64)])
    grams = mix((total[gram:] - total[:-gram]) * memory.down[: n - gram + 1]) | np.uint64(1)
    least = _sliding(grams, width, np.minimum)
    # a window from j on lies within one text if no other text starts in it
    crossing = np.zeros(n + 1, dtype=np.int32)
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    np.add.at(crossing, np.maximum(0, inner - depth + 1), 1)
    np.add.at(crossing, inner, -1)
    least[np.cumsum(crossing[: len(least)]) > 0] = _ZERO
    edge = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
    return chosen, grams[chosen]


def text_anchors(data: np.ndarray, depth: int, memory: Powers, most: int = SLICE_BYTES):
    """anchors of one text of any length, a bounded part at a time: whether a place is one depends on DEPTH bytes around."""
    margin = 2 * depth
    for start in range(0, max(1, len(data)), most):
        low = max(0, start - margin)
        part = data[low : start + most + margin]
        at, h = anchors(part, np.array([0, len(part)]), depth, memory)
        at = at + low
        inside = (at >= start) & (at < start + most)
        yield at[inside], h[inside]


def _anchors(depth: int, local: int):
    def run(batches):
        memory = Powers()
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            hashes, owners, places = [], [], []
            for start, offsets, data in text_slices(batch.column(1)):
                if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
                    for at, h in text_anchors(data, depth, memory):
                        hashes.append(h.view(np.int64))
                        owners.append(np.full(len(at), nodes[start]))
                        places.append(at.astype(np.int32))
                    continue
                at, h = anchors(data, offsets, depth, memory)
                row = np.searchsorted(offsets, at, side="right") - 1
                hashes.append(h.view(np.int64))
                owners.append(nodes[start + row])
                places.append((at - offsets[row]).astype(np.int32))
            if not hashes:
                continue
            h, node, pos = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)
            values, back, n = np.unique(h, return_inverse=True, return_counts=True)
            large = n[back] >= local
            salt = np.where(large, 1 + (mix(node.astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0).astype(np.int32)
            told = values[n >= local]  # a row without a place tells salt 0 that the group is large
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h, told])),
                    pa.array(np.concatenate([salt, np.zeros(len(told), dtype=np.int32)])),
                    pa.array(np.concatenate([node, np.zeros(len(told), dtype=np.int64)])),
                    pa.array(np.concatenate([pos, np.full(len(told), -1, dtype=np.int32)])),
                ],
                names=["h", "salt", "node", "pos"],
            )

    return run


def _repeated(most: int):
    """Of rows sorted by (h, salt, pos) those of groups of two or more, and whether the group is large."""

    def run(batches):
        held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)]
        open_large = None  # (h, salt) of a large group that goes on

        def emit(h, salt, node, pos, last):
            """All groups but the last, unless it is the end; what is held back comes second."""
            nonlocal open_large
            if not len(h):
                return None, [h, salt, node, pos]
            edge = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
            start = np.concatenate([[0], edge])
            count = np.diff(np.concatenate([start, [len(h)]]))
            large = (count > most) | (salt[start] > 0) | (pos[start] < 0)
            if open_large == (h[0], salt[0]):
                large[0] = True
            stop = len(start)
            if not last:
                if large[-1]:
                    open_large = (h[-1], salt[-1])
                else:
                    stop -= 1
            cut = int(start[stop]) if stop < len(start) else len(h)
            group = np.repeat(np.arange(len(start)), count)[:cut]
            keep = ((count[group] > 1) | large[group]) & (pos[:cut] >= 0)
            out = pa.RecordBatch.from_arrays(
                [pa.array(x[:cut][keep]) for x in (h, node, pos)] + [pa.array(large[group][keep])], names=["h", "node", "pos", "large"]
            )
            return out, [x[cut:] for x in (h, salt, node, pos)]

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            out, held = emit(*[np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)], last=False)
            if out is not None and out.num_rows:
                yield out
        out, _ = emit(*held, last=True)
        if out is not None and out.num_rows:
            yield out

    return run


def _contexts(depth: int):
    """What surrounds each anchor, padded to one length; of large groups the windows around it, each with its start."""
    left = depth - min(GRAM, depth)

    def run(batches):
        for batch in batches:
            out, rows = [], 0
            for node, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                held = found.values
                pos, h, large = (held.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                for part in _around(node, data, pos, h, large, left, depth):
                    out.append(part)
                    rows += len(part[3])
                    if rows > PACK:
                        yield _packed(out)
                        out, rows = [], 0
            if out:
                yield _packed(out)

    return run


def _around(node, data, pos, h, large, left: int, depth: int):
    """Parts (large, node, key, places, before, after, bytes of each) of one text, bounded each."""
    at, key = pos[~large].astype(np.int64), h[~large]
    by = np.argsort(at, kind="stable")
    at, key = at[by], key[by]
    for i in range(0, len(at), PACK):
        p = at[i : i + PACK]
        low, high = max(0, int(p[0]) - left), int(p[-1]) + depth
        near = np.concatenate([np.zeros(left, np.uint8), data[low:high], np.zeros(left + depth, np.uint8)])
        before, after = np.minimum(p, left), np.minimum(len(data) - p, depth)
        block = near[(p - low)[:, None] + np.arange(left + depth)[None, :]]
        yield False, node, key[i : i + PACK], p, before, after, block
    for starts in _window_starts(pos[large], len(data), depth):
        none = np.zeros(len(starts), dtype=np.int64)
        yield True, node, none, starts, none, none, data[starts[:, None] + np.arange(depth)[None, :]]


def _window_starts(pos: np.ndarray, n: int, depth: int):
    """The starts of all windows around the places, within n bytes, in parts."""
    left = depth - min(GRAM, depth)
    step = max(1, PACK // (left + 1))
    pos, done = np.sort(pos.astype(np.int64)), -1
    for i in range(0, len(pos), step):
        starts = np.unique((pos[i : i + step, None] - np.arange(left + 1)[None, :]).ravel())
        starts = starts[(starts > done) & (starts >= 0) & (starts + depth <= n)]
        if len(starts):
            done = int(starts[-1])
            yield starts


def _packed(parts):
    rows = [len(p[3]) for p in parts]
    lengths = np.repeat([p[6].shape[1] for p in parts], rows)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    data = np.concatenate([p[6].ravel() for p in parts])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat([p[0] for p in parts], rows)),
            pa.array(np.repeat(np.array([p[1] for p in parts], dtype=np.int64), rows)),
            pa.array(np.concatenate([p[2] for p in parts])),
            *[pa.array(np.concatenate([p[i] for p in parts]).astype(np.int32)) for i in (3, 4, 5)],
            pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
        ],
        names=["large", "node", "key", "pos", "before", "after", "context"],
    )


def digits(block: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of numbers of DIGIT bytes that compare as the bytes do; zeros fill the last."""
    rows, width = block.shape
    full = np.zeros((rows, -(-width // DIGIT) * DIGIT), dtype=np.uint8)
    full[:, :width] = block
    return full.view(">u8").astype(np.uint64)


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of numbers other than 0, taken as DIGIT bytes, are 0."""
    out = np.zeros(len(x), dtype=np.int64)
    for b in range(1, DIGIT):
        out += x < np.uint64(1 << (8 * (DIGIT - b)))
    return out


def radix_order(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their digits within their groups, and how many bytes each shares with the row before.

    group is sorted. Most significant digit first: a pass sorts the classes that its digit splits and drops the
    members that are alone from then on. A group's first row shares nothing.
    """
    n, k = words.shape
    order, shared = np.arange(n), np.zeros(n, dtype=np.int64)
    live, held = np.arange(n), group.astype(np.int64)
    for d in range(k + 1):
        tied = held[1:] == held[:-1]
        keep = np.zeros(len(live), dtype=bool)
        keep[1:] |= tied
        keep[:-1] |= tied
        live, held = live[keep], held[keep]
        tied = held[1:] == held[:-1]
        if d == k or not len(live):
            shared[live[1:][tied]] = k * DIGIT
            break
        digit = words[order[live], d]
        differ = tied & (digit[1:] != digit[:-1])
        if not differ.any():
            continue
        mixed = np.isin(held, held[1:][differ])
        rows = order[live[mixed]]
        sub = np.lexsort((digit[mixed], held[mixed]))
        order[live[mixed]] = rows[sub]
        digit[mixed] = digit[mixed][sub]
        split = tied & (digit[1:] != digit[:-1])
        shared[live[1:][split]] = d * DIGIT + _same_bytes(digit[1:][split] ^ digit[:-1][split])
        held = np.cumsum(np.concatenate([[True], ~tied | split]))
    return order, shared


def later_windows(group, order, before, after, context, depth: int) -> np.ndarray:
    """For each row and window around its anchor, whether a row of the group of a smaller order has the same window.

    Rows come sorted by group and order. A window that begins a bytes before the anchor is equal in two rows if
    they agree in a bytes to the left of the anchor and in depth - a bytes to the right.
    """
    left = depth - min(GRAM, depth)
    rows = len(group)
    column = np.arange(left + 1)
    valid = (column[None, :] >= left - before[:, None]) & (column[None, :] + depth <= left + after[:, None])
    later = np.zeros((rows, left + 1), dtype=bool)
    # rows that equal one before in all bytes have all its windows
    whole = digits(context)
    spread = np.arange(1, 2 * whole.shape[1], 2, dtype=np.uint64) * np.uint64(_BASE)
    h = mix((mix(whole) * spread[None, :]).sum(axis=1, dtype=np.uint64) + before.astype(np.uint64) * np.uint64(257) + after.astype(np.uint64))
    by = np.lexsort((h, group))
    same = (group[by[1:]] == group[by[:-1]]) & (h[by[1:]] == h[by[:-1]])
    at = np.flatnonzero(same)
    x, y = by[at + 1], by[at]
    same[at] = (whole[x] == whole[y]).all(axis=1) & (before[x] == before[y]) & (after[x] == after[y])
    run = np.concatenate([[0], np.cumsum(~same)])
    head = by[np.flatnonzero(np.concatenate([[True], ~same]))][run]  # lexsort is stable: the first of equals leads
    copy = np.zeros(rows, dtype=bool)
    copy[by] = by != head
    leader = np.empty(rows, dtype=np.int64)
    leader[by] = head
    c = np.flatnonzero(copy)
    later[c] = valid[c] & (order[c] > order[leader[c]])[:, None]

    own = np.flatnonzero(~copy)
    if len(own):
        _, start, size = np.unique(group[own], return_index=True, return_counts=True)
        first = own[start[size == 2]]
        second = own[start[size == 2] + 1]
        later[second] |= _pairs(context, valid, first, second, left, depth) & (order[first] < order[second])[:, None]
        many = np.repeat(size > 2, size)
        own = own[many]
        if len(own):
            later[own] |= _classes(group[own], order[own], valid[own], context[own], left, depth)
    return later


def _pairs(context, valid, x, y, left: int, depth: int) -> np.ndarray:
    """Which windows of the rows x and y agree, pair by pair."""
    differ = context[x] != context[y]
    before = np.where(differ[:, :left].any(axis=1), np.argmax(differ[:, left - 1 :: -1][:, :left], axis=1), left) if left else np.zeros(len(x), int)
    right = differ[:, left:]
    after = np.where(right.any(axis=1), np.argmax(right, axis=1), depth)
    column = np.arange(left + 1)[None, :]
    return (left - column <= before[:, None]) & (depth - left + column <= after[:, None]) & valid[x] & valid[y]


def _classes(group, order, valid, context, left: int, depth: int) -> np.ndarray:
    """later_windows for groups of any number of rows, by the order of both sides of the anchor."""
    n = len(group)
    after, shared_after = radix_order(group, digits(context[:, left:]))
    before, shared_before = radix_order(group, digits(context[:, :left][:, ::-1])) if left else (np.arange(n), np.zeros(n, dtype=np.int64))
    head = np.concatenate([[True], group[1:] != group[:-1]])
    later = np.zeros((n, left + 1), dtype=bool)
    of_after, of_before = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for c in range(left + 1):
        of_after[after] = np.cumsum(shared_after < depth - left + c)
        of_before[before] = np.cumsum(head | (shared_before < left - c))
        rows = np.flatnonzero(valid[:, c])
        member = of_after[rows] * (n + 1) + of_before[rows]
        by = np.argsort(member, kind="stable")
        tied = np.concatenate([[False], member[by[1:]] == member[by[:-1]]])
        if not tied.any():
            continue
        lead = np.maximum.accumulate(np.where(tied, 0, np.arange(len(by))))
        later[rows[by], c] = tied & (order[rows[by]] > order[rows[by[lead]]])
    return later


def _marks(depth: int, most: int):
    """Of contexts sorted by (key, node, pos) the windows that repeat an earlier one, as a bit mask a row."""
    left = depth - min(GRAM, depth)

    def settle(held):
        key, node, pos, before, after, context = held
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        place = np.concatenate([[True], new[1:] | (node[1:] != node[:-1]) | (pos[1:] != pos[:-1])])
        later = later_windows(group, np.cumsum(place), before, after, context.reshape(len(key), -1), depth)
        hit = later.any(axis=1)
        bits = np.packbits(later[hit], axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[hit]), pa.array(pos[hit]), pa.array([b.tobytes() for b in bits], pa.binary())], names=["node", "pos", "mask"]
        )

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            table.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, left + depth))
            held = table if held is None else [np.concatenate([a, b]) for a, b in zip(held, table, strict=True)]
            edges = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(held[0]) > min(FLUSH, most) and len(edges):
                cut = int(edges[-1]) + 1
                yield settle([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield settle(held)

    return run


def _cut(depth: int):
    """Removed bytes, spans and the hash of what is left, of each text with its marks."""
    left = depth - min(GRAM, depth)

    def removed(n: int, marks) -> np.ndarray:
        """Which of n bytes a marked window covers."""
        begins = np.zeros(n + 1, dtype=bool)
        kind, pos = marks.field(0).to_numpy(zero_copy_only=False), marks.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        masks, at = marks.field(2).filter(pa.array(kind == 0)), pos[kind == 0]
        for i in range(0, len(at), PACK):
            raw = np.frombuffer(b"".join(masks[i : i + PACK].to_pylist()), dtype=np.uint8)
            r, c = np.nonzero(np.unpackbits(raw.reshape(len(at[i : i + PACK]), -1), axis=1)[:, : left + 1])
            begins[at[i : i + PACK][r] - left + c] = True
        if (kind == 1).any():
            around = np.zeros(n + 1, dtype=bool)
            for starts in _window_starts(pos[kind == 1], n, depth):
                around[starts] = True
            around[pos[kind == 2]] = False
            begins |= around
        at = np.flatnonzero(begins)
        gone = np.zeros(n + 1, dtype=np.int8)
        if len(at):  # runs of windows that overlap or touch
            new = np.concatenate([[True], at[1:] - at[:-1] > depth])
            gone[at[new]] = 1
            gone[at[np.concatenate([new[1:], [True]])] + depth] -= 1
        return np.cumsum(gone[:n], dtype=np.int8).view(bool)

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, copy, marks in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, dtype=np.uint8)
                gone = None
                if copy:
                    gone = np.ones(len(data), dtype=bool)
                elif marks.is_valid and len(marks.values):
                    gone = removed(len(data), marks.values)
                n_bytes.append(len(raw))
                n_removed.append(0 if gone is None else int(gone.sum()))
                n_spans.append(0 if gone is None or not len(gone) else int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(hashlib.sha256(raw if gone is None else data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept)],
                names=["node", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    depth: int = DEPTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    large: int = LARGE,
    local: int = LOCAL,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is every byte covered by a string of depth bytes that also starts earlier: in a document of
    smaller id, or earlier in the same. Null texts are empty. A null id is smaller than all others. Rows
    that repeat id and text are one document and get the same result each; different texts of one id are
    documents in the order of their SHA-256. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = stage(rows.select("doc", F.octet_length("text").alias("n"), text_sha(F.col("text")).alias("sha")), "digests")
    keys = text_keys(whole)
    if keys is None:
        searched, whole = rows.withColumnRenamed("doc", "node"), whole.withColumnRenamed("doc", "node")
    else:
        searched = stage(rows.withColumn("sha", text_sha(F.col("text"))).join(keys, ["doc", "sha"]).select("node", "text"), "keyed")
        whole = whole.join(keys, ["doc", "sha"]).select("node", "n", "sha")
    own = whole.groupBy("node").agg(F.min("sha").alias("sha"), F.min("n").alias("n"))
    firsts = own.where(F.col("n") >= depth).groupBy("sha").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    copies = stage(own.join(firsts, "sha").where("node <> first").select("node", F.lit(True).alias("copy")), "copies")

    found = (
        searched.where(F.octet_length("text") >= depth)
        .transform(map_arrow, _anchors(depth, local), "h long, salt int, node long, pos int")
        .repartition("h", "salt")
        .sortWithinPartitions("h", "salt", "pos")
        .transform(map_arrow, _repeated(large), "h long, node long, pos int, large boolean")
    )
    repeated = stage(found, "repeated").join(copies.select("node"), "node", "left_anti")
    by_text = repeated.groupBy("node").agg(F.collect_list(F.struct("pos", "h", "large")).alias("found"))
    contexts = stage(
        searched.join(by_text, "node")
        .select("node", "text", "found")
        .transform(
            map_arrow,
            _contexts(depth), "large boolean, node long, key long, pos int, before int, after int, context binary"
        ),
        "contexts",
    )
    marks = (
        contexts.where("not large")
        .select("key", "node", "pos", "before", "after", "context")
        .repartition("key")
        .sortWithinPartitions("key", "node", "pos")
        .transform(map_arrow, _marks(depth, large), "node long, pos int, mask binary")
    )
    none = F.lit(None).cast("binary").alias("mask")
    first_places = (
        contexts.where("large")
        .groupBy("context")
        .agg(F.min(F.struct("node", "pos")).alias("first"))
        .select("first.node", F.lit(2).alias("kind"), "first.pos", none)
    )
    large_places = repeated.where("large").select("node", F.lit(1).alias("kind"), "pos", none)
    told = marks.select("node", F.lit(0).alias("kind"), "pos", "mask").unionByName(large_places).unionByName(first_places)
    by_text = stage(told.groupBy("node").agg(F.collect_list(F.struct("kind", "pos", "mask")).alias("marks")), "marks")

    light = by_text.join(copies, "node", "full_outer")
    cut = searched.join(light, "node", "left").select("node", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "marks")
    result = cut.transform(map_arrow, _cut(depth), "node long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    result = result.withColumnRenamed("node", "doc") if keys is None else result.join(keys.select("node", "doc"), "node")
    return result.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
