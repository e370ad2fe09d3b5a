"""SentencePiece encoding and decoding at any text length, by a max-plus parallel scan.

A text of up to CHUNK characters is searched in one go. A longer one is cut into chunks. The boundary state
is how far a piece reaches over the cut (0 to longest - 1 characters); each chunk yields its transfer matrix
from the state at its start to the state at its end, in the (max, +) algebra. Matrices combine
associatively into the exact score of every boundary state; with those, every chunk repeats its search and
traces back on its own, for each state it may end in. Following the states from the last chunk then picks
one of these traces per chunk. The result is that of one search over the whole text, ties included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, map_pandas, stage
from tessera.llm.unigram import NONE, SPACE, Decoder, Units, Vocabulary, marked, shared_units, trace

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
#: So many chunks are passed on at a time.
CHUNKS_AT_ONCE = 64
#: How many matrices are combined in one step of the scan.
FAN_IN = 256


def first_cut(text: str, start: int, stop: int) -> int:
    """The first place from start, before stop, that no piece spans; -1 if there is none."""
    at = text.find(SPACE, max(1, start))
    while 0 <= at < stop:
        if text[at - 1] != SPACE:
            return at
        at = text.find(SPACE, at + 1)
    return -1


def _forced_last(text: str, start: int, stop: int) -> int:
    """The last such place."""
    at = text.rfind(SPACE, max(1, start), stop)
    while at >= 0:
        if text[at - 1] != SPACE:
            return at
        at = text.rfind(SPACE, max(1, start), at)
    return -1


def _forward(text: str, init: list[float], stop: int, units: Units) -> tuple[list[float], list[int]]:
    best, back = init + [NONE] * (len(text) + 1 - len(init)), [-1] * (len(text) + 1)
    units.relax(text, best, back, stop)
    return best, back


def transfer(text: str, length: int, units: Units) -> np.ndarray:
    """Entry (a, b): the best score of a path that enters the chunk at a and leaves it b behind its end.

    text: the chunk's length characters and up to longest - 1 more. Unreachable states are -inf.
    """
    v = units.v
    states = v.longest
    first, last = first_cut(text, states - 1, length), _forced_last(text, states - 1, length)
    out = np.full((states, states), NONE)
    if first < 0:
        for a in range(min(states, length)):
            best, _ = _forward(text, [NONE] * a + [0.0], length, units)
            ends = best[length : length + states]
            out[a, : len(ends)] = ends
        return out
    middle = units.score(units.cut(text[first:last]))
    best, _ = _forward(text[last:], [0.0], length - last, units)
    tail = best[length - last : length - last + states]
    for a in range(min(states, first + 1)):
        head, _ = _forward(text[:first], [NONE] * a + [0.0], first, units)
        out[a, : len(tail)] = head[first] + middle + np.array(tail)
    return out


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def traces(text: str, length: int, scores: list[float], units: Units):
    """(ids of the part that all paths share, for each state at the end the ids after it, for each the entry state).

    scores: of every state at the chunk's start, from the scan.
    """
    v = units.v
    states = v.longest
    first, last = first_cut(text, states - 1, length), _forced_last(text, states - 1, length)
    shared: list[int] = []
    entry = None
    if first < 0:
        start, init = 0, list(scores[: len(text) + 1])
    else:
        best, back = _forward(text[:first], list(scores[: first + 1]), first, units)
        entry, shared = trace(text, back, first, v)
        shared.extend(units.encode(text[first:last]))
        start, init = last, [0.0]
    best, back = _forward(text[start:], init, length - start, units)
    ends, entries = [], []
    for b in range(states):
        at = length - start + b
        if at >= len(best) or best[at] == NONE:
            ends.append(None)
            entries.append(None)
            continue
        came, ids = trace(text[start:], back, at, v)
        ends.append(ids)
        entries.append(came if entry is None else entry)
    return shared, ends, entries


def _chunks(long: DataFrame, longest: int, chunk: int) -> DataFrame:
    """One row per chunk: row, chunk, length, text with longest - 1 characters of the next. Each text is cut in one pass."""

    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                searched = marked(text.as_py())
                starts = range(0, len(searched), chunk)
                for some in (starts[i : i + CHUNKS_AT_ONCE] for i in range(0, len(starts), CHUNKS_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row.as_py()] * len(some), pa.int64()),
                            pa.array([s // chunk for s in some], pa.int32()),
                            pa.array([min(chunk, len(searched) - s) for s in some], pa.int32()),
                            pa.array([searched[s : s + chunk + longest - 1] for s in some], pa.string()),
                        ],
                        names=["row", "chunk", "length", "text"],
                    )

    return long.select("row", "text").transform(map_arrow, run, "row long, chunk int, length int, text string")


def _encode_long(long: DataFrame, shared_vocabulary, longest: int, chunk: int) -> DataFrame:
    """(row, ids) of texts of chunk characters or more."""
    chunks = stage(_chunks(long, longest, chunk).repartition(F.col("row"), F.col("chunk")), "chunks")

    def matrices(batches):
        units = shared_units(shared_vocabulary.value)
        for pdf in batches:
            found = [transfer(t, n, units).ravel().tolist() for t, n in zip(pdf["text"], pdf["length"], strict=True)]
            yield pdf[["row", "chunk"]].assign(matrix=found)

    def blocks(pdf):
        """The product of up to FAN_IN neighbouring matrices."""
        pdf = pdf.sort_values("chunk")
        total = None
        for m in pdf["matrix"]:
            m = np.array(m).reshape(longest, longest)
            total = m if total is None else combine(total, m)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "block": pdf["block"].iloc[:1], "matrix": [total.ravel().tolist()]})

    def starts(pdf):
        """The scores of the states at the start of every block of a text."""
        pdf = pdf.sort_values("block")
        scores, out = np.array([0.0] + [NONE] * (longest - 1)), []
        for m in pdf["matrix"]:
            out.append(scores.tolist())
            scores = (scores[:, None] + np.array(m).reshape(longest, longest)).max(axis=0)
        return pd.DataFrame({"row": pdf["row"], "block": pdf["block"], "scores": out})

    def within(pdf):
        """The scores of the states at the start of every chunk of a block."""
        pdf = pdf.sort_values("chunk")
        scores, out = np.array(pdf["scores"].iloc[0]), []
        for m in pdf["matrix"]:
            out.append(scores.tolist())
            scores = (scores[:, None] + np.array(m).reshape(longest, longest)).max(axis=0)
        return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "scores": out})

    transfers = stage(
        chunks.transform(map_pandas, matrices, "row long, chunk int, matrix array<double>").withColumn(
            "block", F.floor(F.col("chunk") / FAN_IN).cast("int")
        ),
        "transfers",
    )
    block_starts = (
        transfers.groupBy("row", "block")
        .applyInPandas(blocks, "row long, block int, matrix array<double>")
        .groupBy("row")
        .applyInPandas(starts, "row long, block int, scores array<double>")
    )
    chunk_starts = (
        transfers.join(block_starts, ["row", "block"])
        .groupBy("row", "block")
        .applyInPandas(within, "row long, chunk int, scores array<double>")
    )

    def back(batches):
        units = shared_units(shared_vocabulary.value)
        for pdf in batches:
            found = [
                traces(t, n, list(s), units) for t, n, s in zip(pdf["text"], pdf["length"], pdf["scores"], strict=True)
            ]
            yield pdf[["row", "chunk"]].assign(
                shared=[f[0] for f in found],
                ends=[[e or [] for e in f[1]] for f in found],
                entries=[[-1 if e is None else e for e in f[2]] for f in found],
            )

    def follow(pdf):
        """From the last chunk to the first, the state that the next one entered in."""
        pdf = pdf.sort_values("chunk", ascending=False)
        state, states = 0, []
        for entries in pdf["entries"]:
            states.append(state)
            state = int(entries[state])
        return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "state": states})

    traced = stage(
        chunks.join(chunk_starts, ["row", "chunk"]).transform(
            map_pandas, back, "row long, chunk int, shared array<int>, ends array<array<int>>, entries array<int>"
        ),
        "traced",
    )
    # one number for each state of a chunk is all that one task holds of a text here
    states = traced.select("row", "chunk", "entries").groupBy("row").applyInPandas(follow, "row long, chunk int, state int")
    parts = traced.join(states, ["row", "chunk"]).select(
        "row", "chunk", F.concat("shared", F.get(F.col("ends"), F.col("state"))).alias("ids")
    )
    return parts.groupBy("row").agg(F.flatten(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).getField("ids")).alias("ids"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and text_md5, the hash of what decoding gives back: the text with space marks as spaces."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.md5(F.translate(text, SPACE, " ")).alias("text_md5")
    )


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, chunk: int):
    """Texts that are searched whole, rows (doc_id, text_md5, ids) of the longer ones, and the vocabulary."""
    v = Vocabulary.load(path)
    if chunk < 4 * v.longest:
        raise ValueError("chunk is too small for the longest piece")
    vocabulary = docs.sparkSession.sparkContext.broadcast(v)  # bounded by the vocabulary file
    rows = _rows(docs, id_col, text_col)
    long = stage(
        rows.where(F.char_length("text") >= chunk).withColumn("row", F.monotonically_increasing_id()), "long-texts"
    )
    encoded = _encode_long(long, vocabulary, v.longest, chunk)
    return (
        rows.where(F.char_length("text") < chunk),
        long.select("doc_id", "text_md5", "row").join(encoded, "row").drop("row"),
        vocabulary,
    )


def encode(
    docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """Per row: doc_id, text_md5 (of the text with space marks as spaces), ids (array of int).

    Null and empty texts have no ids; repeated rows are each encoded; an empty table gives an empty result;
    other columns are not read. path names a SentencePiece model file; it is read by the driver only.
    """
    short, long, vocabulary = _encoded(docs, path, id_col, text_col, chunk)
    kind = short.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        units = shared_units(vocabulary.value)
        for batch in batches:
            ids = [np.frombuffer(i, dtype="<i4") for i in units.encode_all(marked(t.as_py()) for t in batch.column(1))]
            ends = np.cumsum([0, *map(len, ids)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), listed], names=["doc_id", "text_md5", "ids"])

    return short.transform(map_arrow, whole, f"doc_id {kind}, text_md5 string, ids array<int>").unionByName(long)


def decode_ids(encoded: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, text. Null and empty ids give an empty text; repeated rows are each decoded; an empty
    table gives an empty result; other columns are not read."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        decoder = Decoder(vocabulary.value)
        for pdf in batches:
            texts = [decoder.decode(i.tolist()) if i is not None else "" for i in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).transform(
        map_pandas,
        run, f"doc_id {kind}, text string"
    )


def round_trip(
    docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the ids as 4-byte little-endian numbers), decoded (whether
    decoding the ids gives the text back, space marks as spaces).

    Nulls, empty texts, repeated rows and empty tables go as in encode; other columns are not read.
    """
    short, long, vocabulary = _encoded(docs, path, id_col, text_col, chunk)
    kind = short.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded boolean"

    def told(decoder, ids, md5):
        """ids: 4-byte little-endian numbers."""
        text = decoder.decode(np.frombuffer(ids, dtype="<i4").tolist())
        same = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() == md5
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), same

    def batch_of(ids, rows):
        n, sha, same = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded"],
        )

    def whole(batches):
        units, decoder = shared_units(vocabulary.value), Decoder(vocabulary.value)
        for batch in batches:
            found = units.encode_all(marked(t.as_py()) for t in batch.column(1))
            rows = [told(decoder, ids, m.as_py()) for ids, m in zip(found, batch.column(2), strict=True)]
            yield batch_of(batch.column(0), rows)

    def joined(batches):
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            rows = [
                told(decoder, i.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes(), m.as_py())
                for m, i in zip(batch.column(1), batch.column(2), strict=True)
            ]
            yield batch_of(batch.column(0), rows)

    return short.transform(map_arrow, whole, schema).unionByName(long.transform(map_arrow, joined, schema))
