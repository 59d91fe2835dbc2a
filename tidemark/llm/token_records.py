"""Token ids in length-delimited binary records with an offset index.

A shard is a data file and an index file. The data file starts with 8 bytes, ``TOKREC``, a format
number and the bytes per id (2 where the vocabulary allows, else 4). Then a frame per document:

    length of the payload          8 bytes
    masked crc32 of the length     4 bytes
    payload: 1 if there is an id, the id (8 bytes), token ids
    masked crc32 of the payload    4 bytes

All numbers are little-endian. The index has 16 bytes per document, the offset of its frame and the
number of tokens before it in the shard, and an entry for the end, so that any document or block can
be read by itself, in any order. Documents are in ascending order of their ids, over all shards.

A shard is written under a passing name and renamed when it is whole, so a task that is run again
after an executor was lost leaves the same file. Rules for odd rows: a null text is empty and has the
end id only; rows without an id come first; equal ids are ordered by their texts' hashes; an empty
table has no shards.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import slices
from tidemark.session import store

HEAD = b"TOKREC\x01"
KNOWN = 600_000
SPAN = 1 << 20
#: Documents of a block that a reading task takes at once.
BLOCK = 2048
MANIFEST = "shard int, docs long, tokens long"


def masked(data: bytes) -> int:
    """A crc32, rotated and shifted, as checksums of data that hold checksums are weak."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder:
    """Texts to ids by the library, piece by piece between white space; pieces are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known, self.older, self.cores = {}, {}, {}
        # texts are lower-cased before they are cut, and letters are cut from what follows them
        spec = json.loads(self.library.to_str())
        rules = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
        self.plain_words = rules == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+" in cut.split("|") and r"[^\s\p{L}\p{N}]+" in cut.split("|")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        parts = [list(self.pieces(t)) for t in texts]
        known, older = self.known, self.older
        new = set().union(*(p for own in parts for p in own)).difference(known)
        known.update({p: older[p] for p in new if p in older})
        missing = [(p, *self.halves(p)) for p in new if p not in known]
        cores = self.cores
        fresh = list({x: None for _, a, b in missing for x in (a, b) if x not in cores})
        done = self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in fresh], add_special_tokens=False)
        cores.update((x, np.array(e.ids, dtype=self.kind).tobytes()) for x, e in zip(fresh, done, strict=True))
        known.update((p, cores[a] + cores[b]) for p, a, b in missing)
        if len(cores) > KNOWN:
            self.cores = {}
        get = known.__getitem__
        out = [b"".join([b"".join(map(get, p)) for p in own]) for own in parts]
        if len(known) > KNOWN:
            self.older, self.known = known, {}
        return out

    def halves(self, piece: bytes) -> tuple[bytes, bytes]:
        """A piece as a lower-case word and the full stops or commas behind it, if its ids are those of the two."""
        core = piece.rstrip(b".,")
        if self.plain_words and core.isalpha():
            return core.lower(), piece[len(core):]
        return piece, b""

    @staticmethod
    def pieces(text: bytes) -> Iterator[list[bytes]]:
        start = 0
        while start < len(text):
            end = text.find(b" ", start + SPAN)
            end = len(text) if end < 0 else end
            yield text[start:end].split()
            start = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def shard_files(path: str, shard: int) -> tuple[fs.FileSystem, str, str]:
    where, folder = fs.FileSystem.from_uri(path)
    return where, f"{folder}/part-{shard:06d}.rec", f"{folder}/part-{shard:06d}.idx"


def write_records(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``documents(doc_id, text)`` to shards in ``path``; returns the manifest, a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(tokenizer), TaskContext.get().partitionId()
        where, data, index = shard_files(path, shard)
        where.create_dir(os.path.dirname(data), recursive=True)
        passing, end = f"{data}.{uuid.uuid4().hex}", end_id.to_bytes(coder.width, "little")
        entries, at, before = [], len(HEAD) + 1, 0
        with where.open_output_stream(passing) as f:
            f.write(HEAD + bytes([coder.width]))
            for b in slices(batches):
                frames = []
                ids = coder.encode([t or b"" for t in b.column(1).to_pylist()])
                for doc_id, packed in zip(b.column(0).to_pylist(), ids, strict=True):
                    payload = struct.pack("<Bq", doc_id is not None, doc_id or 0) + packed + end
                    length = struct.pack("<Q", len(payload))
                    frames += [length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))]
                    entries.append(struct.pack("<QQ", at, before))
                    at, before = at + 16 + len(payload), before + len(packed) // coder.width + 1
                f.write(b"".join(frames))
        if not entries:
            where.delete_file(passing)
            return
        with where.open_output_stream(f"{passing}.idx") as f:
            f.write(b"".join(entries) + struct.pack("<QQ", at, before))
        where.move(f"{passing}.idx", index)
        where.move(passing, data)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(entries)], pa.int64()), pa.array([before], pa.int64())], names=["shard", "docs", "tokens"])

    order = F.col("doc_id").asc_nulls_first()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionByRange(order).sortWithinPartitions(order, F.xxhash64("text"))
    return store(rows.mapInArrow(run, MANIFEST), f"{path}/manifest")


def read_records(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every record; ``ids`` are packed little-endian 32-bit integers.

    Blocks of documents are read by offset, on any executor. With a ``seed`` they are dealt out and
    read in a random order, the documents of a block too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, last, base in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                where, data, index = shard_files(path, shard)
                with where.open_input_file(index) as f:
                    f.seek(16 * first)
                    entries = np.frombuffer(f.read(16 * (last - first + 1)), dtype="<u8").reshape(-1, 2)
                order = np.arange(last - first)
                if seed is not None:
                    np.random.default_rng([seed, shard, first]).shuffle(order)
                with where.open_input_file(data) as f:
                    head = f.read(len(HEAD) + 1)
                    if head[:-1] != HEAD:
                        raise ValueError(f"{data} is no file of token records")
                    for part in np.array_split(order, -(-len(order) // 128)):
                        rows = [frame(f, int(entries[k, 0])) for k in part]
                        ids = [np.frombuffer(p[9:], dtype=f"<u{head[-1]}").astype("<u4") for p in rows]
                        docs = [struct.unpack_from("<Bq", p) for p in rows]
                        made = [pa.array([i if has else None for has, i in docs], pa.int64()), pa.array(base + entries[part, 1].astype(np.int64)),
                                pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())]
                        yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # a row per shard: the window is as long as the list of files
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    blocks = shards.select("shard", "base", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(BLOCK).cast("long"))).alias("first"))
    blocks = blocks.select("shard", "first", F.least(F.col("first") + BLOCK, "docs").alias("last"), "base")
    tasks = max(1, manifest.agg(F.sum(F.ceil(F.col("docs") / BLOCK))).first()[0] or 0)
    if seed is None:
        blocks = blocks.repartition(tasks, "shard", "first")
    else:
        place = F.xxhash64("shard", "first", F.lit(seed))
        blocks = blocks.repartitionByRange(tasks, place).sortWithinPartitions(place)
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def frame(f, offset: int) -> bytes:
    """The payload of the frame at an offset, with both checksums verified."""
    f.seek(offset)
    head = f.read(12)
    length, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("the length of a record is damaged")
    payload = f.read(length + 4)
    if len(payload) < length + 4 or masked(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("a record is damaged")
    return payload[:-4]
