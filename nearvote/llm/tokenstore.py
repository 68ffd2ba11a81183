"""Token-id files: documents' ids in ascending doc_id order, Simple-8b coded.

write() sorts the documents by a range partitioning on doc_id, encodes each
partition's texts and writes shard files to a folder; read() gets the ids back.

A shard file (little-endian): 8 bytes magic, then int64: version, block, ids,
documents, words, ids in the same partition's earlier shards; then doc_id and id count per document (int64; a null doc_id is
the smallest int64, with a flag byte per document after them), the word offset
per block and one more at the end (int64), and the Simple-8b words (uint64).

Scale: the order is one range shuffle of the texts. A shard holds about
``shard_ids`` ids, so memory doesn't grow with the input. A shard
knows the ids before it in its partition; the partitions' totals, as many as
shuffle partitions, are summed on the driver. Files are written under a task's own name
and then renamed, so a task that runs twice leaves one whole file; the content
is the same, as ties of doc_id are ordered by text.

Defined results: null text is empty and has its end id alone; rows without
doc_id come first; rows repeated under one doc_id are in order of their texts;
an empty table makes no shard and reads back as no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import materialise
from .tokens import GROUP_CHARS, give_back, groups, piece_encoder, texts_of

MAGIC, VERSION = b"NVS8IDS\n", 1
SHARD_IDS = 3_000_000
NO_ID = np.iinfo(np.int64).min


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, skip: int = 0, block: int = simple8b.BLOCK) -> bytes:
    words, offsets = simple8b.encode(ids, block)
    keys = np.array([NO_ID if k is None else k for k in doc_ids], "<i8")
    null = np.array([k is None for k in doc_ids], np.uint8)
    head = np.array([VERSION, block, len(ids), len(doc_ids), len(words), skip], "<i8")
    parts = [head, keys, counts.astype("<i8"), null, offsets.astype("<i8"), words.astype("<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(doc_ids, counts, ids, skip) of a shard file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    at = len(MAGIC)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    version, block, total, docs, words, skip = take("<i8", 6).tolist()
    if version != VERSION:
        raise ValueError(f"version {version} of the token-id file is not known")
    keys, counts, null = take("<i8", docs), take("<i8", docs), take("u1", docs)
    offsets, coded = take("<i8", -(-total // block) + 1), take("<u8", words)
    names = [None if gone else k for k, gone in zip(keys.tolist(), null.tolist(), strict=True)]
    return names, counts, simple8b.decode(coded, offsets, total, block), skip


def _folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:") :])
    return pa.fs.LocalFileSystem(), uri


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, block: int = simple8b.BLOCK) -> DataFrame:
    """Write shard files into the shared ``folder``; returns their manifest (part, shard, file, docs, ids)."""
    schema = "part int, shard int, file string, docs long, ids long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), piece_encoder(tokenizer)
        fs, path = _folder(folder)
        fs.create_dir(path, recursive=True)
        keys: list[int | None] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = shard = skip = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, shard, skip
            name = f"part-{context.partitionId():06d}-{shard:06d}.s8b"
            trial = f"{path}/_{name}.{context.taskAttemptId()}-{uuid.uuid4().hex}"
            with fs.open_output_stream(trial) as out:
                out.write(to_bytes(keys, np.concatenate(counts), np.concatenate(parts), skip, block))
            if fs.get_file_info(f"{path}/{name}").type != pa.fs.FileType.NotFound:  # of an attempt that was lost; it holds the same
                fs.delete_file(f"{path}/{name}")
            fs.move(trial, f"{path}/{name}")
            row = {"part": [context.partitionId()], "shard": [shard], "file": [name], "docs": [len(keys)], "ids": [held]}
            keys.clear(), counts.clear(), parts.clear()
            held, shard, skip = 0, shard + 1, skip + held
            give_back()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            texts, names = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in groups(texts, min(GROUP_CHARS, 2 * shard_ids)):
                flat, n = encode(texts[a:b])
                ends = np.cumsum(n)
                parts.append(np.insert(flat, ends, end_id))
                counts.append(n + 1)
                keys += names[a:b]
                held += int(ends[-1]) + len(n)
                if held >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = lean.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    return materialise(ordered.mapInArrow(run, schema), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the shard files: doc_id, start (ids before it), n_tokens, ids_crc32; with_ids adds the ids."""
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    before, base = 0, {}
    for part in sorted(totals):
        base[part] = before
        before += totals[part]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder) if totals else None
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if files is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, part in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                names, counts, ids, skip = from_bytes(data.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": pa.array(names, pa.int64()), "start": pa.array(base[part] + skip + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in np.split(ids, ends[:-1])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)
                del out, names, counts, ids, raw, crc, ends
                give_back()

    part = F.regexp_extract("path", r"part-(\d+)-\d+\.s8b$", 1).cast("int").alias("part")
    return files.select("content", part).mapInArrow(run, schema)
