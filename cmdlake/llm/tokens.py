"""Operator 5: token ids in flat binary files, memory-mapped when read.

Documents are dealt into ranges of doc_id and sorted; a task encodes its range and
writes two files: part-N.ids, little-endian unsigned integers (16 bits where the
vocabulary allows, else 32), and part-N.docs, per document its id, a flag for a null
id, and the 64-bit place of its first id within the part. The ids before each part
(its base) are prefix sums over the parts, one row a part, kept in manifest.json.
Files are moved into place whole, so a task that runs again leaves the same file.

Defined cases: null or empty text is the end id alone; null doc_ids come first; rows
with one id follow each other in the order of their texts' hashes; further columns are
ignored; an empty table gives a manifest without parts and an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path
from .encoding import encoder

#: Fixed values of the contract.
TOKENIZER, END = "byte_bpe_50k.json", 0
DOCS = np.dtype([("doc_id", "<i8"), ("null", "<u8"), ("start", "<u8")])


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, chunks) -> None:
    """Writes chunks to a file under a name of the attempt's own, then moves it into place."""
    where, path = _fs(uri)
    where.create_dir(path, recursive=True)
    task = TaskContext.get()
    mine = f"{path}/.{name}.{task.taskAttemptId() if task else 'driver'}"
    with where.open_output_stream(mine) as f:
        for x in chunks:
            f.write(x)
    where.move(mine, f"{path}/{name}")


def _slices(uri: str, name: str, dtype):
    """A file's number of elements, and a function that gives those from a to b: of a memory map where the file is
    local, else of a read of just that stretch."""
    where, path = _fs(f"{uri}/{name}")
    size = np.dtype(dtype).itemsize
    n = where.get_file_info(path).size // size
    if n and where.type_name == "local":
        held = np.memmap(path, dtype, "r")
        return n, lambda a, b: held[a:b]
    f = where.open_input_file(path)
    return n, lambda a, b: np.frombuffer(f.read_at((b - a) * size, a * size), dtype)


def _writer(uri: str, tokenizer: str, cut: str, end: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, cut)
        width, docs = np.dtype("<u4" if encode.wide else "<u2"), []
        total = 0

        def chunks():
            nonlocal total
            for b in batches:
                texts = b["text"].tolist()
                for lo in range(0, len(texts), 512):
                    ids = encode.encode([x if isinstance(x, str) else None for x in texts[lo : lo + 512]], end)
                    for doc, x in zip(b["doc_id"].iloc[lo : lo + 512], ids):
                        docs.append((0 if pd.isna(doc) else int(doc), int(pd.isna(doc)), total))
                        total += len(x)
                    yield np.concatenate(ids).astype(width).tobytes()

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        _put(uri, f"part-{part:06d}.ids", (x for y in ([first], stream) for x in y))
        _put(uri, f"part-{part:06d}.docs", [np.array(docs, DOCS).tobytes()])
        yield pd.DataFrame({"part": [part], "docs": [len(docs)], "tokens": [total], "width": [width.itemsize]})

    return write


def write_tokens(docs: DataFrame, uri: str, *, tokenizer: str, cut: str = "prefix", end: int = END) -> dict:
    """Writes docs (doc_id, text) as token files below uri; returns the manifest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    parts = rows.mapInPandas(_writer(uri, tokenizer, cut, end), "part int, docs long, tokens long, width int").collect()  # a row a file; sorting in Spark would encode all texts twice
    base, listed = 0, []
    for p in sorted(parts, key=lambda p: p["part"]):
        listed.append({"part": p["part"], "docs": p["docs"], "tokens": p["tokens"], "width": p["width"], "base": base})
        base += p["tokens"]
    manifest = {"parts": listed, "tokens": base, "end": end}
    _put(uri, "manifest.json", [json.dumps(manifest).encode()])
    return manifest


def _reader(uri: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b.itertuples(index=False):
                n, docs = _slices(uri, f"part-{p.part:06d}.docs", DOCS)
                end, ids = _slices(uri, f"part-{p.part:06d}.ids", np.dtype(f"<u{p.width}"))
                for lo in range(0, n, 2048):
                    some = docs(lo, min(n, lo + 2048))
                    after = docs(lo + len(some), lo + len(some) + 1)["start"][0] if lo + len(some) < n else end
                    edges = np.append(some["start"], after).astype(np.int64)
                    each = [ids(a, b) for a, b in zip(edges, edges[1:])]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(np.where(some["null"] == 1, None, some["doc_id"]), dtype="Int64"), "start": p.base + some["start"].astype(np.int64),
                            "n_tokens": np.array([len(x) for x in each], np.int64), "ids": [x.astype("<u4").tobytes() for x in each],
                        }
                    )

    return read


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (32-bit little-endian) from the files."""
    where, path = _fs(f"{uri}/manifest.json")
    with where.open_input_file(path) as f:
        parts = json.loads(f.read())["parts"]
    rows = spark.createDataFrame([(p["part"], p["width"], p["base"]) for p in parts], "part int, width int, base long")
    return rows.repartition(max(1, len(parts)), "part").mapInPandas(_reader(uri), "doc_id long, start long, n_tokens long, ids binary")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    uri = new_path(spark, "tokens")
    write_tokens(docs, uri, tokenizer=tokenizer_path(TOKENIZER))
    return read_tokens(spark, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
