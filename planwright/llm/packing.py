"""Packing: shortest-pack-first over the length histogram.

Documents longer than a sequence are cut at every ``max_length`` ids.  The histogram of piece lengths
(at most ``max_length`` entries, whatever the corpus) is packed on the driver: lengths longest first,
each into the pack with the most room left, as counts of patterns.  Patterns go back to pieces by a
piece's rank among those of its length; ranks come from a sort by ranges and one offset a range, so a
length that a third of all pieces share is spread like any other.

Ids are those of plain text: a special token's string inside a text is spelled out (see ``encoding``).

Nulls: a null text is empty, its end id alone makes a piece of length 1.  Repeated rows are packed each.
Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encoding

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
RANKED = PIECES + ", range int, nth long"
PACKED = PIECES + ", sequence_id long, offset long"


def shortest_pack_first(histogram: dict[int, int], max_length: int) -> list[tuple[int, list[int]]]:
    """[(how many sequences, the lengths in each)] that use up the histogram."""
    open_packs: dict[int, list[tuple[int, list[int]]]] = {}
    done: list[tuple[int, list[int]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in range(max_length, length - 1, -1):
            while left and open_packs.get(room):
                count, pack = open_packs[room].pop()
                used = min(count, left)
                if count > used:
                    open_packs[room].append((count - used, pack))
                left -= used
                grown = [*pack, length]
                if room == length:
                    done.append((used, grown))
                else:
                    open_packs.setdefault(room - length, []).append((used, grown))
            if not left:
                break
        if left and length == max_length:
            done.append((left, [length]))
        elif left:
            open_packs.setdefault(max_length - length, []).append((left, [length]))
    return done + [p for room in sorted(open_packs) for p in open_packs[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """A row for each place in each pattern: ranks [lo, hi) of ``length`` go to sequences from ``first``."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for count, pack in patterns:
        offset = 0
        for length in pack:
            lo = used.get(length, 0)
            rows.append((length, lo, first, offset))
            used[length] = lo + count
            offset += length
        first += count
    return pd.DataFrame(rows, columns=["length", "lo", "first", "offset"]).sort_values(["length", "lo"])


def cut(docs: DataFrame, tokenizer_path: str, max_length: int, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``max_length`` ids, with the checksum of each."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(encoding.definition(tokenizer_path))
    end = np.array([end_id], "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding.encoder(shared.value)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in encoding.slices(texts, 2_000_000):
                rows = []
                for d, ids in zip(doc_ids[a:b], encode(texts.slice(a, b - a)), strict=True):
                    ids = np.append(ids, end)
                    for s in range(0, len(ids), max_length):
                        piece = ids[s : s + max_length]
                        rows.append((d, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                columns = list(zip(*rows, strict=True))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).mapInArrow(common.tidied(pieces, encoding.STORE), PIECES)


def rank_by_length(pieces: DataFrame) -> DataFrame:
    """Adds the range a piece was dealt to and its place among those of its length there."""

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for frame in frames:
            nth = frame.groupby("length").cumcount() + frame["length"].map(seen).fillna(0).astype("int64")
            for length, n in frame["length"].value_counts().items():
                seen[length] = seen.get(length, 0) + int(n)
            yield frame.assign(range=np.int32(part), nth=nth)

    keys = ["length", "doc_id", "start", "ids_crc32"]
    return pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(common.tidied(number), RANKED)


def pack_pieces(pieces: DataFrame, max_length: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (see PIECES)."""
    spark = pieces.sparkSession
    ranked = common.staged(rank_by_length(pieces), "ranked-pieces")
    # A range holds neighbouring lengths: at most one row a range and one a length come here.
    counts = ranked.groupBy("length", "range").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "range"])
    counts["before"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    histogram = counts.groupby("length")["n"].sum()
    table = slots(shortest_pack_first({int(k): int(v) for k, v in histogram.items()}, max_length))
    key = lambda length, rank: (length << 44) + rank
    by_range = pd.MultiIndex.from_frame(counts[["length", "range"]])
    before = pd.Series(counts["before"].to_numpy(), index=by_range)
    shared = spark.sparkContext.broadcast((before, table))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, table = shared.value
        length = table["length"].to_numpy(np.int64)
        keys = key(length, table["lo"].to_numpy(np.int64))
        for frame in frames:
            if frame.empty:
                continue
            at = pd.MultiIndex.from_frame(frame[["length", "range"]])
            rank = frame["nth"].to_numpy() + before.reindex(at).to_numpy()
            hit = np.searchsorted(keys, key(frame["length"].to_numpy(), rank), side="right") - 1
            sequence = table["first"].to_numpy()[hit] + rank - table["lo"].to_numpy()[hit]
            yield frame.drop(columns=["range", "nth"]).assign(sequence_id=sequence, offset=table["offset"].to_numpy()[hit])

    return ranked.mapInPandas(common.tidied(place), PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_length: int = 1024) -> DataFrame:
    """Cut, then pack: one row a piece, with its sequence and its offset there."""
    return pack_pieces(common.staged(cut(docs, tokenizer_path, max_length), "pieces"), max_length)


def sequence_ids(pieces: DataFrame, docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (documents' ids in offset order, unpadded)."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(encoding.definition(tokenizer_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoding.encoder(shared.value)
        for batch in batches:
            ids = [np.append(x.astype(np.int32), np.int32(end_id)) for x in run(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    whole = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).distinct()
    whole = whole.mapInArrow(common.tidied(encode, encoding.STORE), "doc_id long, ids array<int>")
    parts = pieces.join(whole, "doc_id").select(
        "sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("piece")
    )
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))
