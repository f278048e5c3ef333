"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout of an output folder::

    shard-00000.tok   ids of the shard's documents, end to end (u2 or u4, little-endian)
    shard-00000.off   n_docs + 1 u8 offsets into .tok, in ids
    shard-00000.doc   n_docs i8 document ids
    manifest.json     width, end id, and for each shard its counts and bases

Documents are dealt to range shards whose bounds follow from the ids alone, so
shard order is document order, a repeated run writes equal files, and a
document's place in the whole collection is its shard's base (a prefix sum over
the shards' counts) plus its own offset.  The width is two bytes where the
vocabulary allows it.  Files are written under temporary names and renamed; a
repeated task replaces its own shard with equal bytes, and the manifest, written
last, is what makes a folder complete.

Defined cases: a null or empty text has the end id alone; a null document id is
kept as the smallest 64-bit integer and read back as null; repeated rows and
repeated ids each get their own entry, ordered by id and then by text (an id that
fills shards of its own is dealt to them by a hash of the text, and ordered within
each); a very long text is encoded by one task, whole; an empty
table gives a manifest without shards; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import id_and_text
from weftline.llm.ranges import SHARD, range_sharded
from weftline.llm.textkit import crc32_u32
from weftline.llm.tokenize import encoder, encoding_runs

NULL_ID = -(1 << 63)
READ_DOCS = 8192
SHARDS = "shard int, n_docs long, n_tokens long"
INDEX = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _commit(store: pafs.FileSystem, temporary: str, final: str) -> None:
    if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(final).type != pafs.FileType.NotFound:
        store.delete_file(final)
    store.move(temporary, final)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list]]:
    """(shard, keys, texts) of bounded runs of rows; the rows of a shard stand together."""
    for batch in batches:
        shards = batch.column(0).to_numpy()
        keys = batch.column(1).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(shards, append=-1)) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            for lo, hi in encoding_runs(batch.column(2)[a:b]):
                yield int(shards[a]), keys[a + lo : a + hi], batch.column(2)[a + lo : a + hi].to_pylist()


class _ShardFile:
    def __init__(self, store: pafs.FileSystem, root: str, shard: int):
        self.store, self.root, self.shard, self.tail = store, root, shard, uuid.uuid4().hex
        self.out = store.open_output_stream(f"{root}/.{self.tail}.tok")
        self.counts, self.ids = [np.zeros(1, np.uint64)], []

    def add(self, keys: np.ndarray, got: list[np.ndarray], end: bytes) -> None:
        self.out.write(b"".join(x for g in got for x in (g.tobytes(), end)))
        self.counts.append(np.array([len(g) + 1 for g in got], np.uint64))
        self.ids.append(keys)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        offsets = np.cumsum(np.concatenate(self.counts)).astype("<u8")
        for kind, values in (("off", offsets), ("doc", np.concatenate(self.ids).astype("<i8"))):
            with self.store.open_output_stream(f"{self.root}/.{self.tail}.{kind}") as f:
                f.write(values.tobytes())
        for kind in ("tok", "off", "doc"):
            _commit(self.store, f"{self.root}/.{self.tail}.{kind}", f"{self.root}/shard-{self.shard:05d}.{kind}")
        return pa.RecordBatch.from_pydict({"shard": pa.array([self.shard], pa.int32()), "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})


def _shard_writer(uri: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        store, root = _open(uri)
        end, file = np.array([end_id], enc.dtype).tobytes(), None
        for shard, keys, texts in _runs(batches):
            if file is not None and file.shard != shard:
                yield file.close()
                file = None
            if file is None:
                file = _ShardFile(store, root, shard)
            file.add(keys, enc.encode_many(texts), end)
        if file is not None:
            yield file.close()

    return write


def write_token_files(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 8192) -> dict:
    """Encode every whole text into the folder ``uri`` and return the manifest."""
    store, root = _open(uri)
    store.create_dir(root, recursive=True)
    rows = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = range_sharded(rows, "doc_id", F.col("h"), shard_docs).sortWithinPartitions(SHARD, "doc_id", "text").select(SHARD, "doc_id", "text")
    # one row for each shard comes to the driver
    shards = sorted(tuple(r) for r in rows.mapInArrow(_shard_writer(uri, tokenizer_path, end_id), SHARDS).collect())
    n_docs, n_tokens = np.array([s[1] for s in shards], np.int64), np.array([s[2] for s in shards], np.int64)
    bases = zip(np.cumsum(n_docs) - n_docs, np.cumsum(n_tokens) - n_tokens, strict=True)
    manifest = {
        "width": encoder(tokenizer_path).dtype.itemsize,
        "end_id": end_id,
        "n_docs": int(n_docs.sum()),
        "n_tokens": int(n_tokens.sum()),
        "shards": [
            {"name": f"shard-{s:05d}", "n_docs": d, "n_tokens": t, "doc_base": int(db), "token_base": int(tb)}
            for (s, d, t), (db, tb) in zip(shards, bases, strict=True)
        ],
    }
    with store.open_output_stream(f"{root}/.manifest") as f:
        f.write(json.dumps(manifest).encode())
    _commit(store, f"{root}/.manifest", f"{root}/manifest.json")
    return manifest


def read_manifest(uri: str) -> dict:
    store, root = _open(uri)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """One shard, memory-mapped where the store is a local or mounted file system."""

    def __init__(self, uri: str, name: str, width: int):
        self.store, root = _open(uri)
        self.path, self.dtype = f"{root}/{name}", np.dtype(f"<u{width}")
        self.mapped = isinstance(self.store, pafs.LocalFileSystem)
        self.offsets, self.doc_ids = self._all("off", "<u8"), self._all("doc", "<i8")
        self.tokens = np.memmap(f"{self.path}.tok", self.dtype, "r") if self.mapped else None

    def _all(self, kind: str, dtype: str) -> np.ndarray:
        if self.mapped:
            return np.memmap(f"{self.path}.{kind}", dtype, "r")
        with self.store.open_input_stream(f"{self.path}.{kind}") as f:
            return np.frombuffer(f.read(), dtype)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids from ``lo`` to ``hi`` of the shard."""
        if self.mapped:
            return self.tokens[lo:hi]
        with self.store.open_input_file(f"{self.path}.tok") as f:
            return np.frombuffer(f.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)


def _shard_reader(uri: str, width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri, name, width)
                for lo in range(0, len(shard.doc_ids), READ_DOCS):
                    ids = np.asarray(shard.doc_ids[lo : lo + READ_DOCS])
                    off = np.asarray(shard.offsets[lo : lo + len(ids) + 1]).astype(np.int64)
                    tokens = shard.ids(int(off[0]), int(off[-1])).astype("<u4")
                    rel = off - off[0]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(ids, mask=ids == NULL_ID),
                            "start": pa.array(off[:-1] + base),
                            "n_tokens": pa.array(np.diff(off)),
                            "ids_crc32": pa.array([crc32_u32(tokens[a:b]) for a, b in zip(rel[:-1], rel[1:], strict=True)], pa.int64()),
                        }
                    )

    return read


def read_token_index(spark: SparkSession, uri: str) -> DataFrame:
    """Per document, from the files: its place, its length and a checksum of its ids."""
    manifest = read_manifest(uri)
    shards = [(s["name"], s["token_base"]) for s in manifest["shards"]]
    if not shards:
        return spark.createDataFrame([], INDEX)
    rows = spark.sparkContext.parallelize(shards, len(shards)).toDF("name string, token_base long")
    return rows.mapInArrow(_shard_reader(uri, manifest["width"]), INDEX)
