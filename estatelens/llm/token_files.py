"""Token ids in flat binary files, with 64-bit document offsets.

A folder holds, for each shard, ``shard-N.ids`` (the ids one after the other, unsigned 16-bit where the
vocabulary allows it, else 32-bit, little-endian), ``shard-N.offsets`` (unsigned 64-bit, one more than
documents: where each document starts in the shard) and ``shard-N.docs`` (signed 64-bit document ids).
``manifest.json`` names the id type and, for each shard in order, its documents, tokens and *base*: the
tokens of all shards before it. Shards are ranges of document ids, so base plus offset is a document's
place in the whole corpus. Files are read by memory map, so the folder has to be one that all executors
mount; a folder only Spark's readers reach is refused.

Each task writes its shard under a name of its own attempt and renames it when complete: a task that
runs again leaves the same files. Only one row per shard passes the driver, for the prefix sums.
"""

from __future__ import annotations

import json
import os
import uuid
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.byte_bpe import Encoder, crc32_of
from estatelens.llm.workers import kept, slices, strings
from estatelens.session import durable, ensure_checkpoint_dir

#: Stands for a null document id in a ``.docs`` file.
NO_ID = -(1 << 63)
_ID_TYPE = {"H": "<u2", "I": "<u4"}


def mounted(folder: str) -> str:
    """The path of a folder that every executor can open."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {folder}")
    return parts.path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder."""
    return f"{mounted(ensure_checkpoint_dir(spark))}/{name}-{uuid.uuid4().hex}"


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> dict:
    """Write all documents in ascending id order; returns the manifest.

    ``end_id`` closes every document. A null text is an empty one (its end id alone), null ids come
    first, rows that repeat an id stand next to each other in the order of a hash of their texts, and an
    empty table gives a manifest without shards. Other columns are not read.
    """
    folder = mounted(folder)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("tie"),
    )
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def write(batches):
        encoder = kept(("byte_bpe", tokenizer), lambda: Encoder(tokenizer))
        task = TaskContext.get()
        shard = task.partitionId()
        os.makedirs(folder, exist_ok=True)
        stem = f"{folder}/shard-{shard:06d}"
        own = f"{stem}.{task.taskAttemptId()}"
        ids, starts, tokens = [], [0], 0
        end = np.array([end_id], dtype=_ID_TYPE[encoder.typecode]).tobytes()
        with open(f"{own}.ids", "wb") as file:
            for batch in slices(batches, 1):
                parts = []
                for text in strings(batch.column(1)):
                    parts += [encoder.packed(text), end]
                    tokens += (len(parts[-2]) + len(end)) // encoder.width
                    starts.append(tokens)
                file.write(b"".join(parts))
                ids.append(batch.column(0).fill_null(NO_ID).to_numpy())
        if ids:
            np.array(starts, dtype="<u8").tofile(f"{own}.offsets")
            np.concatenate(ids).astype("<i8").tofile(f"{own}.docs")
            for part in ("ids", "offsets", "docs"):
                os.replace(f"{own}.{part}", f"{stem}.{part}")
            found = [[shard], [len(starts) - 1], [tokens], [_ID_TYPE[encoder.typecode]]]
        else:
            os.remove(f"{own}.ids")
            found = [[], [], [], []]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=k) for c, k in zip(found, kinds)],
            names=["shard", "n_docs", "n_tokens", "id_type"],
        )

    written = durable(
        ordered.select("id", "text").mapInArrow(
            write, "shard int, n_docs long, n_tokens long, id_type string"
        )
    )
    shards = [r.asDict() for r in written.orderBy("shard").collect()]
    bases = accumulate((s["n_tokens"] for s in shards), initial=0)
    for shard, base in zip(shards, bases):
        shard["base"] = base
    manifest = {"folder": folder, "shards": shards}
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/manifest.new", "w", encoding="utf-8") as file:
        json.dump(manifest, file)
    os.replace(f"{folder}/manifest.new", f"{folder}/manifest.json")
    return manifest


class Shard:
    """One shard, memory-mapped."""

    def __init__(self, folder: str, shard: int, id_type: str, n_docs: int, n_tokens: int):
        stem = f"{folder}/shard-{shard:06d}"
        self.ids = np.memmap(f"{stem}.ids", dtype=id_type, mode="r")
        self.offsets = np.memmap(f"{stem}.offsets", dtype="<u8", mode="r")
        self.docs = np.memmap(f"{stem}.docs", dtype="<i8", mode="r")
        if len(self.ids) != n_tokens or len(self.offsets) != n_docs + 1:
            raise ValueError(f"{stem} does not have the size its manifest names")

    def document(self, at: int) -> np.ndarray:
        return self.ids[int(self.offsets[at]) : int(self.offsets[at + 1])]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a folder: doc_id, start, n_tokens, ids_crc32, and its ids if wanted."""
    folder = mounted(folder)
    with open(f"{folder}/manifest.json", encoding="utf-8") as file:
        shards = json.load(file)["shards"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                base = row.pop("base")
                shard = Shard(folder, **row)
                for start in range(0, row["n_docs"], 4096):
                    part = range(start, min(start + 4096, row["n_docs"]))
                    found = [shard.document(at) for at in part]
                    doc_ids = np.asarray(shard.docs[part.start : part.stop])
                    columns = [
                        pa.array(doc_ids, mask=doc_ids == NO_ID),
                        pa.array(base + shard.offsets[part.start : part.stop].astype(np.int64)),
                        pa.array([len(x) for x in found], type=pa.int64()),
                        pa.array([crc32_of(x) for x in found], type=pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.tolist() for x in found], type=kinds[-1]))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted = "shard int, n_docs long, n_tokens long, id_type string, base long"
    table = spark.createDataFrame(
        [tuple(s[c.split()[0]] for c in wanted.split(", ")) for s in shards], wanted
    )
    if len(shards) > 1:
        table = table.repartition(len(shards), "shard")
    types = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return table.mapInArrow(read, types)
