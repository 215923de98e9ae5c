"""Token-ID output with a shared zstandard dictionary.

Every document becomes one zstandard frame of its serialized ids, compressed alone with a dictionary that was
trained on serialized id arrays of a bounded sample. A file holds the frames of one range of doc_ids, an Arrow
table with the offset of every frame, and the hash of the dictionary, which lies beside the files once. A reader
checks the hash and can fetch a single short document by its offset.

Layout of ``part-NNNNN.tmz``: frames, index (Arrow stream: doc_id, offset, length, n_tokens), then 4 + 8 + 32 bytes:
magic ``TMZ1``, length of the index (unsigned, little endian), SHA-256 of the dictionary.
"""

from __future__ import annotations

import hashlib
import io
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_memo import PieceMemo, spaced_pieces
from .common import only, shared_dir, slices, table, text_bytes

MAGIC = b"TMZ1"
SAMPLE_DOCS = 600  # documents whose ids train the dictionary
PIECE_BYTES = 16 * 1024  # longer id arrays are cut, and twice as many pieces as documents are taken at most
DICT_BYTES = 64 * 1024
SLICE = 4_000_000  # bytes of text that one step encodes; one longer text makes a step alone
_MEMO: dict[str, PieceMemo] = {}


def encode_all(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""
    memo = _MEMO.get(path) or _MEMO.setdefault(path, PieceMemo(path, " ", most=1_000_000))
    out = []
    for lo in range(0, len(texts), 500):
        cut = [spaced_pieces(t) for t in texts[lo : lo + 500]]
        memo.learn(set().union(*[rest for _, rest in cut]))
        heads = memo.tok.encode_batch_fast([first for first, _ in cut], add_special_tokens=False)
        get = memo.ids.__getitem__
        out += [struct.pack(f"<{len(h.ids)}I", *h.ids) + b"".join(map(get, rest)) for h, (_, rest) in zip(heads, cut, strict=True)]
    return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample: int = SAMPLE_DOCS, size: int = DICT_BYTES):
    """A dictionary from the ids of at most ``sample`` doc_ids, those of smallest hash; empty where there is too little to
    learn. At most 2 * sample pieces of PIECE_BYTES reach the driver, however long the texts are."""
    import zstandard

    # Ids of rows are ordered, not texts; texts are encoded where they lie, and pieces of bounded size go to the driver.
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def pieces(batches):
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets, SLICE):
                for ids in encode_all(b.column(1).slice(lo, hi - lo).fill_null("").to_pylist(), path):
                    ids += end
                    cut = [ids[i : i + PIECE_BYTES] for i in range(0, len(ids), PIECE_BYTES)]
                    yield pa.record_batch([pa.array(cut, pa.binary())], ["ids"])

    got = rows.mapInArrow(pieces, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(2 * sample).collect()
    arrays = [bytes(r["ids"]) for r in got]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, dictionary: bytes | None = None, level: int = 3) -> DataFrame:
    """Encode, append ``end_id``, compress and write ``docs`` (doc_id, text) in ascending doc_id order.

    Returns one row a file: part, path, n_docs, n_tokens. Null texts are empty, a null doc_id comes first, rows with
    equal doc_ids follow each other by text. Very long texts are encoded one at a time, an empty table gives no file,
    and other columns are left out. A file is written under another name and then renamed, so a task that
    runs twice leaves one whole file.
    """
    docs = only(docs, "doc_id", "text")
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer, end_id)
    digest, end = hashlib.sha256(dictionary).digest(), struct.pack("<I", end_id)
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        to, base = _filesystem(folder)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        name, draft, out, place = f"part-{task.partitionId():05d}.tmz", f"{base}/.{task.partitionId()}-{task.taskAttemptId()}", None, 0
        index = []
        for b in batches:
            out = out or to.open_output_stream(draft)
            lengths, counts = [], []
            _, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets, SLICE):
                for ids in encode_all(b.column(1).slice(lo, hi - lo).fill_null("").to_pylist(), tokenizer):
                    frame = packer.compress(ids + end)
                    out.write(frame)
                    lengths.append(len(frame))
                    counts.append(len(ids) // 4 + 1)
            stops = place + np.cumsum(np.array(lengths, np.int64))
            index.append(pa.record_batch([b.column(0), pa.array(stops - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "offset", "length", "n_tokens"]))
            place = int(stops[-1]) if len(stops) else place
        if not index:
            return
        whole, sink = pa.Table.from_batches(index), io.BytesIO()
        with pa.ipc.new_stream(sink, whole.schema) as w:
            w.write_table(whole)
        out.write(sink.getvalue() + MAGIC + struct.pack("<Q", sink.tell()) + digest)
        out.close()
        to.move(draft, f"{base}/{name}")
        yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([f"{base}/{name}"]), pa.array([whole.num_rows], pa.int64()), pa.array([pa.compute.sum(whole["n_tokens"]).as_py()], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "part int, path string, n_docs long, n_tokens long")


def read_index(f) -> tuple[pa.Table, bytes]:
    """The index of an open file and the hash of its dictionary."""
    size = f.size()
    f.seek(size - 44)
    magic, length, digest = f.read(4), struct.unpack("<Q", f.read(8))[0], f.read(32)
    if magic != MAGIC:
        raise ValueError("not a token file")
    f.seek(size - 44 - length)
    return pa.ipc.open_stream(f.read(length)).read_all(), digest


def read_files(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """Documents of the files, each with ``start``, the number of ids before it: doc_id, start, ids (binary)."""

    def read(batches):
        import zstandard

        system, root = _filesystem(folder)
        with system.open_input_file(f"{root}/dictionary") as f:
            dictionary = f.read()
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as f:
                    index, digest = read_index(f)
                    if digest != hashlib.sha256(dictionary).digest():
                        raise ValueError(f"{path} was written with another dictionary")
                    counts = index["n_tokens"].to_numpy()
                    starts = start + np.cumsum(counts) - counts
                    offsets, lengths = index["offset"].to_numpy(), index["length"].to_numpy()
                    for lo in range(0, len(counts), 1000):
                        hi = min(lo + 1000, len(counts))
                        f.seek(int(offsets[lo]))
                        data = f.read(int(offsets[hi - 1] + lengths[hi - 1] - offsets[lo]))
                        at = offsets[lo:hi] - offsets[lo]
                        ids = [unpacker.decompress(data[o : o + n], max_output_size=4 * c) for o, n, c in zip(at.tolist(), lengths[lo:hi].tolist(), counts[lo:hi].tolist(), strict=True)]
                        yield pa.record_batch([index["doc_id"].slice(lo, hi - lo).combine_chunks(), pa.array(starts[lo:hi]), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    if not files:
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    listed = spark.createDataFrame(files, "path string, start long").repartition(len(files), "path")
    return listed.mapInArrow(read, "doc_id long, start long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document as the files give it back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = shared_dir(spark)
    # One row a file comes to the driver, as a commit of files does; never rows of documents.
    made = sorted(write_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json")).collect())
    starts, files = 0, []
    for r in made:
        files.append((r["path"], starts))
        starts += r["n_tokens"]

    rows = read_files(spark, folder, files)
    return rows.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
