"""Token-ID output: equal-length sequences and masks in Arrow IPC files.

Layout of a folder: `shard-NNNNN.arrow` holds record batches of `tokens`, a fixed-size list of `length` unsigned integers
(16 bit when the vocabulary allows it), and `mask`, a fixed-size list of booleans that is false behind the last token of the
shard. `shard-NNNNN.index.arrow` holds doc_id, start and n_tokens of each document, start counted inside the shard. Shards
hold ascending ranges of doc_id; the manifest table has the tokens of each. Every batch but the last holds ROWS sequences, so
sequence i of a shard is row i % ROWS of batch i // ROWS, a view into the mapped file.

Null, repeated and odd input: a null or empty text is the end id alone; a null doc_id sorts first; rows with equal doc_id
stay apart, in the order of their ids; other columns are ignored; an empty table gives a manifest without rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import chunk_encoder, file_system, parts_for, range_bounds, range_of, slices
from tidewatch.session import materialise

#: Sequences in a record batch.
ROWS = 256
ENCODED = "shard int, doc_id long, n_tokens long, ids binary"
MANIFEST = "shard int, n_docs long, n_tokens long, n_sequences long, length int"


def _encode(tokenizer: str, end_id: int, width: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer, False)
        for b in slices(batches, "text"):
            end = np.array([end_id], width).tobytes()
            ids = [np.frombuffer(x, "<u4").astype(width).tobytes() + end for x in encoder.encode(b.column("text"))]
            n = pa.array([len(x) // np.dtype(width).itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), n, pa.array(ids, pa.binary())],
                                             ["shard", "doc_id", "n_tokens", "ids"])

    return run


class _ShardWriter:
    """Writes one shard under a name of its own attempt and moves it into place when it is whole."""

    def __init__(self, folder: str, shard: int, length: int, width: str):
        self.store, root = file_system(folder)
        self.place, self.shard, self.length = f"{root}/shard-{shard:05d}", shard, length
        self.tmp = f"{root}/.{shard:05d}-{uuid.uuid4().hex}"
        kind = pa.from_numpy_dtype(np.dtype(width))
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out, self.index_out = self.store.open_output_stream(self.tmp), self.store.open_output_stream(self.tmp + "i")
        self.file, self.index = pa.ipc.new_file(self.out, self.schema), pa.ipc.new_file(self.index_out, self.index_schema)
        self.rest, self.docs, self.tokens, self.sequences = np.empty(0, width), 0, 0, 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.file.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))
        self.sequences += len(ids) // self.length

    def add(self, doc_id: pa.Array, n: np.ndarray, ids: np.ndarray) -> None:
        start = self.tokens + np.cumsum(n) - n
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_id, pa.array(start), pa.array(n)], schema=self.index_schema))
        self.docs, self.tokens = self.docs + len(n), self.tokens + int(n.sum())
        ids, block = np.concatenate([self.rest, ids]), ROWS * self.length
        whole = len(ids) // block * block
        for at in range(0, whole, block):
            self._put(ids[at:at + block], block)
        self.rest = ids[whole:]

    def close(self) -> tuple[int, int, int, int, int]:
        if real := len(self.rest):
            self._put(np.pad(self.rest, (0, -real % self.length)), real)
        for x in (self.file, self.index, self.out, self.index_out):
            x.close()
        self.store.move(self.tmp, self.place + ".arrow")
        self.store.move(self.tmp + "i", self.place + ".index.arrow")
        return self.shard, self.docs, self.tokens, self.sequences, self.length


def _write(folder: str, length: int, width: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for b in batches:
            shards = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if writer is None or writer.shard != shards[lo]:
                    if writer is not None:
                        done.append(writer.close())
                    writer = _ShardWriter(folder, int(shards[lo]), length, width)
                part = b.slice(lo, hi - lo)
                writer.add(part.column("doc_id"), part.column("n_tokens").to_numpy(),
                           np.frombuffer(b"".join(part.column("ids").to_pylist()), width))
        if writer is not None:
            done.append(writer.close())
        if done:
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return run


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = 1024,
                    vocabulary: int = 50_257) -> DataFrame:
    """Encode all texts and write them to `folder` in ascending doc_id order; the manifest, one row per shard.

    The ranges come from a sketch of doc_id alone, so texts are encoded once and only their ids (2 bytes each) are shuffled.
    """
    spark, width = docs.sparkSession, "<u2" if vocabulary <= 1 << 16 else "<u4"
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    wanted = parts_for(spark, docs.count(), 50_000)
    bounds = range_bounds(docs, wanted)
    placed = docs.select(range_of(F.col("doc_id"), bounds).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    encoded = placed.mapInArrow(_encode(tokenizer, end_id, width), ENCODED)
    shards = encoded.repartitionById(max(1, len(bounds)), "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return materialise(shards.mapInArrow(_write(folder, length, width), MANIFEST))


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    """A local file is mapped, so that batches are views into it."""
    store, place = file_system(path)
    local = store.type_name == "local"
    return pa.ipc.open_file(pa.memory_map(place) if local else store.open_input_file(place))


def sequence_at(folder: str, shard: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mask of sequence i of a shard; the tokens are a view into the mapped file."""
    batch = _open(f"{folder}/shard-{shard:05d}.arrow").get_batch(i // ROWS)
    tokens, mask = batch.column("tokens"), batch.column("mask")
    at, length = i % ROWS, tokens.type.list_size
    return (tokens.values.slice(at * length, length).to_numpy(),
            mask.values.slice(at * length, length).to_numpy(zero_copy_only=False))


def _read(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist(), strict=True):
                data = _open(f"{folder}/shard-{shard:05d}.arrow")
                index = _open(f"{folder}/shard-{shard:05d}.index.arrow")
                batch_no, tokens, first = -1, np.empty(0, "<u2"), 0
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    sums = []
                    for at, end in zip(starts.tolist(), (starts + counts).tolist(), strict=True):
                        crc = 0
                        while at < end:
                            if at >= first + len(tokens):
                                batch_no, first = batch_no + 1, first + len(tokens)
                                tokens = data.get_batch(batch_no).column("tokens").values.to_numpy()
                            upto = min(end, first + len(tokens))
                            crc = zlib.crc32(tokens[at - first:upto - first].astype("<u4"), crc)
                            at = upto
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(base + starts), part.column("n_tokens"), pa.array(sums, pa.int64()),
                         pa.array([shard] * len(sums), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return run


def read_index(manifest: DataFrame, folder: str) -> DataFrame:
    """Each document's place in the whole stream and the checksum of its ids, both read back from the files.

    The manifest has a row per shard; shards grow with the input only as files do.
    """
    spark, rows, base = manifest.sparkSession, [], 0
    for m in manifest.orderBy("shard").toLocalIterator():
        rows.append((m.shard, base))
        base += m.n_tokens
    table = spark.createDataFrame(rows, "shard int, base long").repartition(max(1, len(rows)))
    return table.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewatch.llm.common import documents
    from tidewatch.session import shared_dir

    folder = shared_dir(spark, "sequences")
    manifest = write_sequences(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(manifest, folder)
