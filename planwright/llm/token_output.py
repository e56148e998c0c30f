"""Token-ID output: Simple-8b segments of whole, ordered documents, and their reader.

Texts are dealt by ranges of doc_id and sorted, so file order is doc_id order; each task encodes its
documents and writes segments (one row of a Parquet container each: part, seq, ids before it in its
part, payload), which any file system Spark can write to takes.  A payload holds the documents' ids and
lengths, the block offsets and the Simple-8b words.

Ids are those of plain text: a special token's string inside a text is spelled out (see ``encoding``).

Nulls: a null text is empty (its end id alone); a null doc_id sorts first and stays null.  Repeated
rows are written each, ordered by text.  Other columns are ignored.  An empty table gives no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, encoding, simple8b

SEGMENT_SCHEMA = "part int, seq int, before long, n_docs int, n_ids long, payload binary"
ROW_SCHEMA = "part int, doc_id long, before long, n_tokens long, ids_crc32 long"
MAGIC = b"PWS8"
HEAD = struct.Struct("<4sIQII")
#: Ids a segment holds at least before it is closed (the last document may exceed it).
SEGMENT_IDS = 1 << 20


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment's bytes."""
    lengths = np.array([len(x) for x in ids], "<u4")
    words, offsets = simple8b.encode(np.concatenate(ids).astype(np.uint64) if ids else np.empty(0, np.uint64))
    return b"".join((
        HEAD.pack(MAGIC, len(ids), int(lengths.sum(dtype=np.int64)), len(offsets), len(words)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        lengths.tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ))


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, all ids) of a segment."""
    magic, n, total, n_offsets, n_words = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size
    parts = []
    for kind, count in (("<i8", n), ("u1", n), ("<u4", n), ("<u4", n_offsets), ("<u8", n_words)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    docs, null, lengths, offsets, words = parts
    ids = simple8b.decode(words.astype(np.uint64), offsets, total).astype("<u4")
    return [None if x else int(d) for d, x in zip(docs, null, strict=True)], lengths, ids


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode every document, in ascending doc_id order, into segments under ``path``."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(encoding.definition(tokenizer_path))
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoding.encoder(shared.value)
        kept_docs: list = []
        kept: list[np.ndarray] = []
        seq = before = size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, before, size
            row = [[part], [seq], [before], [len(kept)], [size], [pack_segment(kept_docs, kept)]]
            out = pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                ["part", "seq", "before", "n_docs", "n_ids", "payload"],
            )
            seq, before, size = seq + 1, before + size, 0
            kept.clear()
            kept_docs.clear()
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in encoding.slices(texts):
                for d, ids in zip(doc_ids[a:b], encode(texts.slice(a, b - a)), strict=True):
                    kept_docs.append(d)
                    kept.append(np.append(ids, end))
                    size += len(ids) + 1
                    if size >= SEGMENT_IDS:
                        yield close()
        if kept:
            yield close()

    ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # Simple-8b words leave a compressor little to do.
    ordered.mapInArrow(common.tidied(write, encoding.STORE), SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    common.prepare(spark)
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs, lengths, ids = unpack_segment(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts + before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    found = segments.select("part", "before", "payload").mapInArrow(common.tidied(rows), ROW_SCHEMA)
    # One row a written file: as many as there were tasks, whatever the rows.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for p in parts:
        offsets.append((p["part"], total))
        total += p["n"]
    at = spark.createDataFrame(offsets, "part int, part_start long")
    return found.join(F.broadcast(at), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_id_output(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write, then read back."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{common.shared_dir(spark)}/planwright/token-ids-{uuid.uuid4().hex[:12]}"
    write_token_ids(docs, path, tokenizer_path)
    return read_token_ids(spark, path)
