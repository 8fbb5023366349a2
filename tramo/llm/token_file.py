"""Token ids in files of byte or bit planes.

A file: MAGIC; chunks; footer; its length (8 bytes); MAGIC. A chunk holds up to BLOCK ids of whatever documents; its ids,
as little-endian unsigned 32-bit numbers, are transposed into 4 byte planes (or 32 bit planes), each compressed by itself
with zstandard; a plane of zeros has no bytes. The footer (zlib-compressed JSON) has the chunk index (ids, place, length of
each plane) and the documents' ids and numbers of tokens.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramo.llm.staging import new_folder, stage
from tramo.llm.units import Lists, UnitEncoder, lists, pieces

MAGIC, BLOCK = b"TRPLANE1", 1 << 18


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of a block, compressed; empty for a plane of zeros."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(rows.T)
    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    bits = len(planes) == 32
    size = (n + 7) // 8 if bits else n
    expand = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(expand.decompress(p, max_output_size=size), np.uint8) if p else np.zeros(size, np.uint8) for p in planes])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class Writer:
    def __init__(self, out, bits: bool = False):
        self.out, self.bits, self.chunks, self.docs, self.sizes = out, bits, [], [], []
        self.wait: list[np.ndarray] = []
        self.waiting = 0
        out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.sizes.append(sizes)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        full = len(ids) if rest else len(ids) - len(ids) % BLOCK
        for k in range(0, full, BLOCK):
            block = ids[k : min(k + BLOCK, full)]
            planes = to_planes(block, self.bits)
            self.chunks.append([len(block), self.at, [len(p) for p in planes]])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.wait, self.waiting = [ids[full:]], len(ids) - full

    def close(self) -> int:
        """Ids in the file."""
        self._flush(True)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        footer = {"chunks": self.chunks, "docs": self.docs, "sizes": base64.b64encode(sizes.astype("<i8").tobytes()).decode()}
        data = zlib.compress(json.dumps(footer).encode(), 1)
        self.out.write(data + len(data).to_bytes(8, "little") + MAGIC)
        return int(sizes.sum())


def read(source, size: int) -> Iterator[tuple[object, np.ndarray]]:
    """(document, its ids), in the file's order; a chunk is in memory at a time, and what of a document is unfinished."""
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of planes")
    n = int.from_bytes(tail[:8], "little")
    source.seek(size - 16 - n)
    footer = json.loads(zlib.decompress(source.read(n)))
    sizes = np.frombuffer(base64.b64decode(footer["sizes"]), "<i8")
    chunks, have = iter(footer["chunks"]), np.zeros(0, np.uint32)
    for doc, want in zip(footer["docs"], sizes.tolist(), strict=True):
        if len(have) < want:
            parts, got = [have], len(have)
            while got < want:
                count, at, lengths = next(chunks)
                source.seek(at)
                parts.append(from_planes([source.read(x) for x in lengths], count))
                got += count
            have = np.concatenate(parts)
        yield doc, have[:want]
        have = have[want:]


_workers: dict[int, UnitEncoder] = {}


def _encoder(tokenizer_json: str, plain: bool) -> UnitEncoder:
    """One for each Python worker, tokenizer and way to take added tokens."""
    key = 2 * zlib.crc32(tokenizer_json.encode()) + plain
    if key not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.encode_special_tokens = plain
        names = tokenizer.get_vocab(with_added_tokens=True)
        spaced = np.zeros(1 + max(names.values(), default=0), bool)
        spaced[[i for name, i in names.items() if name.startswith("Ġ")]] = True  # byte-level vocabularies write a space so

        def alone(texts: list[str]) -> Lists:
            return lists([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

        def after_space(units: list[str]) -> Lists:
            # encoded together: a unit holds no space, so each id that starts with one starts the next unit
            joined = [" " + " ".join(units[k : k + 2048]) for k in range(0, len(units), 2048)]
            ids, _ = alone(joined)
            at = np.flatnonzero(spaced[ids])
            if len(at) != len(units):
                raise ValueError("the tokenizer's pre-tokens don't start at spaces")
            return ids, np.diff(np.append(at, len(ids)))

        _workers[key] = UnitEncoder(after_space, alone, 600_000, 300_000)
    return _workers[key]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, bits: bool = False, id_col: str = "doc_id", text_col: str = "text", plain: bool = True) -> DataFrame:
    """Encode whole texts and write them in ascending order of their ids, a file for each range of ids.

    tokenizer: the path of a tokenizers library file with a byte-level pre-tokenizer and no normalizer, read by the driver.
    Each document ends with end_id. A null text is empty; null ids come first; rows with the same id are in the order of
    their texts. Returns the manifest, a row for each file: nr, path, n_docs, n_tokens. A task that runs again writes the
    same file again; a file has its name only when it is whole. plain: the names of special tokens in a text are text like
    other text; False, as the library has it by default: each is its token.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base)
        path = f"{base}/part-{task.partitionId():06d}"
        encoder, n_docs = _encoder(spec, plain), 0
        with target.open_output_stream(own := f"{path}.{task.taskAttemptId()}.tmp") as out:
            writer = Writer(out, bits)
            for batch in pieces(batches, most=4_000_000):
                ids, sizes = encoder(batch.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                writer.add(batch.column("id").to_pylist(), sizes, ids.astype(np.uint32))
                n_docs += batch.num_rows
            n = writer.close()
        encoder.trim(True)
        if not n_docs:
            target.delete_file(own)
            return
        target.move(own, f"{path}.planes")
        yield pa.RecordBatch.from_pydict({"nr": pa.array([task.partitionId()], pa.int64()), "path": [f"{folder}/part-{task.partitionId():06d}.planes"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    return stage(rows.mapInArrow(encode, "nr long, path string, n_docs long, n_tokens long"), "manifest")


def read_index(manifest: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """What the files hold, a row for each document: id, start, n_tokens, ids_crc32; the files are read anew."""
    first = F.sum("n_tokens").over(Window.orderBy("nr")) - F.col("n_tokens")  # a row for each file

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as f:
                    docs, starts, sizes, sums = [], [], [], []
                    for doc, ids in read(f, f.size()):
                        docs.append(doc)
                        starts.append(at)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(np.ascontiguousarray(ids).data))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(docs).cast(pa_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    pa_type = pa.string() if id_type == "string" else pa.int64()
    files = manifest.select("path", first.alias("first"))
    n = max(1, manifest.count())
    return files.repartition(n, "path").mapInArrow(index, f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long")


def tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with their ids, read from the files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as f:
                    for doc, ids in read(f, f.size()):
                        yield pa.RecordBatch.from_pydict({id_col: pa.array([doc], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    return manifest.select("path").mapInArrow(load, f"{id_col} long, ids array<long>")


def encode_to_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """The index of the files, with ids as the tokenizers library gives them by default."""
    return read_index(write(docs, tokenizer, folder or new_folder(spark, "tokens"), end_id, plain=False))
