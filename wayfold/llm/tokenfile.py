"""Token ids in binary files of independent zstandard frames with a seek table.

A file is a series of frames of whole documents (little-endian unsigned 32-bit ids), then a frame with the document index,
then a skippable frame with the seek table of the public seekable format: compressed size, size and checksum (low half of
XXH64) of each frame. A reader decompresses the index and the frames that hold the documents it wants, nothing else.

Files go through Spark's own text sink, one row a file: the row is the file without its last four bytes, and these, the
format's closing number, are the sink's line separator. So commits, retries and any file system are Spark's business.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.arrays import once, text_blocks
from wayfold.llm.bpe import encode_block

#: Ids in a frame and in a file; one longer document makes a longer frame or file.
FRAME_IDS = 1 << 16
FILE_IDS = 1 << 24
LEVEL = 3
#: Bytes of text encoded at once, and of ids read at once.
BLOCK = 4 << 20
#: Pieces whose ids a Python worker remembers.
MEMO = 1 << 17

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

CLOSING = struct.pack("<I", SEEKABLE_MAGIC)
ENTRY = "<III"
INDEX = "<IQQ"


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FileWriter:
    """Collects documents and yields finished files, each without its closing number."""

    def __init__(self, part: int, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS):
        self.part, self.frame_ids, self.file_ids, self.base = part, frame_ids, file_ids, 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self._new_file()

    def _new_file(self) -> None:
        self.frames, self.entries, self.open, self.open_ids = [], [], [], 0
        self.docs, self.sizes, self.frame_of, self.at = [], [], [], []
        self.total = 0

    def _close_frame(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.frames.append(packed)
        self.entries.append((len(packed), len(raw), checksum(raw)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> bytes | None:
        """Take one document's ids; a finished file, if this one completes it."""
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.frame_of.append(len(self.frames))
        self.at.append(self.open_ids)
        self.open.append(ids.astype("<u4").tobytes())
        self.open_ids += len(ids)
        self.total += len(ids)
        if self.open_ids >= self.frame_ids:
            self._close_frame(b"".join(self.open))
            self.open, self.open_ids = [], 0
        return self.finish() if self.total >= self.file_ids else None

    def finish(self) -> bytes | None:
        if not self.docs:
            return None
        if self.open:
            self._close_frame(b"".join(self.open))
        known = np.array([d is not None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        numbers = [np.array(x, "<i8").tobytes() for x in (self.sizes, self.frame_of, self.at)]
        self._close_frame(b"".join([struct.pack(INDEX, self.part, len(docs), self.base), docs.tobytes(), known.tobytes(), *numbers]))
        table = b"".join(struct.pack(ENTRY, *e) for e in self.entries) + struct.pack("<IB", len(self.entries), CHECKSUM_FLAG)
        out = b"".join([*self.frames, struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(CLOSING)), table])
        base = self.base + self.total
        self._new_file()
        self.base = base
        return out


class FileReader:
    """Random access to the documents of one file's bytes."""

    def __init__(self, content: bytes):
        count, flag = struct.unpack_from("<IB", content, len(content) - 9)
        if content[-4:] != CLOSING or flag != CHECKSUM_FLAG:
            raise ValueError("not a token file, or cut off")
        first = len(content) - 9 - count * struct.calcsize(ENTRY)
        self.content, self.entries = content, [struct.unpack_from(ENTRY, content, first + k * struct.calcsize(ENTRY)) for k in range(count)]
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries])]).tolist()
        self.decompressor, self.opened = zstandard.ZstdDecompressor(), 0
        raw = self.frame(count - 1)
        self.part, n, self.base = struct.unpack_from(INDEX, raw)
        at = struct.calcsize(INDEX)
        docs = np.frombuffer(raw, "<i8", n, at)
        known = np.frombuffer(raw, np.uint8, n, at + 8 * n)
        self.docs = [d if k else None for d, k in zip(docs.tolist(), known.tolist())]
        self.sizes, self.frame_of, self.at = (np.frombuffer(raw, "<i8", n, at + 9 * n + 8 * n * k) for k in range(3))

    def frame(self, number: int) -> bytes:
        size, raw_size, expected = self.entries[number]
        raw = self.decompressor.decompress(self.content[self.starts[number] : self.starts[number] + size], max_output_size=max(raw_size, 1))
        self.opened += 1
        if len(raw) != raw_size or checksum(raw) != expected:
            raise ValueError(f"frame {number} is damaged")
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in its part, ids as bytes) of the wanted documents, or of all."""
        before = self.base + np.concatenate([[0], np.cumsum(self.sizes)])
        held, raw = -1, b""
        for k, doc in enumerate(self.docs):
            if wanted is not None and doc not in wanted:
                continue
            if self.frame_of[k] != held:
                held = int(self.frame_of[k])
                raw = self.frame(held)
            yield doc, int(before[k]), raw[4 * self.at[k] : 4 * (self.at[k] + self.sizes[k])]


def library_encoder(spec: str):
    """Encoders of a tokenizers file: of joined pieces as encode_block wants it, and of one text; its special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = once(f"tokenizer {hash(spec)}", lambda: Tokenizer.from_str(spec))
    memo: dict[bytes, np.ndarray] = once(f"library pieces {hash(spec)}", dict)

    def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        found = [memo.get(t) for t in texts]
        new = [k for k, x in enumerate(found) if x is None]
        for k, e in zip(new, tokenizer.encode_batch_fast([texts[k].decode() for k in new], add_special_tokens=False)):
            found[k] = e.ids
            if len(memo) < MEMO and len(texts[k]) <= 64:
                memo[texts[k]] = e.ids
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(ends[-1])), ends

    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    return pieces, lambda text: tokenizer.encode(text, add_special_tokens=False).ids, special


def encode_texts(column: pa.Array, encoder, end_id: int) -> Iterator[np.ndarray]:
    """Each text's ids and the end id, as the tokenizers library gives them; special strings in a text are special."""
    pieces, whole, special = encoder
    for _, _, data, offsets in text_blocks(column, BLOCK):
        ids, bounds = encode_block(data, offsets, pieces)
        raw = data.tobytes() if special else b""
        odd = any(s in raw for s in special)
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            text = raw[offsets[k] : offsets[k + 1]] if odd else b""
            yield np.append(whole(text.decode()) if odd and any(s in text for s in special) else ids[a:b], end_id).astype(np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS) -> None:
    """Encode every text with the tokenizers file's content and write the ids to a new folder in ascending id order.

    Null texts are empty; null ids come first; rows of one id are ordered by text. An empty table writes no documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(shared.value)
        writer = FileWriter(TaskContext.get().partitionId(), frame_ids, file_ids)
        row = lambda f: pa.RecordBatch.from_arrays([pa.array([f], pa.binary())], names=["file"])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1), encoder, end_id)):
                if (done := writer.add(doc, ids)) is not None:
                    yield row(done)
        if (done := writer.finish()) is not None:
            yield row(done)

    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", CLOSING.decode("latin1")).text(folder)


def read_token_files(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(part, before, doc_id, n_tokens, ids) of all documents or the wanted ones; before: ids ahead of it in its part."""
    chosen = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part: int, found: list) -> pa.RecordBatch:
            doc, before, ids = zip(*found)
            sizes = [len(x) // 4 for x in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(doc), pa.int32()), pa.array(before, pa.int64()), pa.array(doc, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "before", "doc_id", "n_tokens", "ids"],
            )

        for batch in batches:
            for content in batch.column(0):
                if not len(content.as_py()):
                    continue
                reader = FileReader(content.as_py())
                found, held = [], 0
                for row in reader.documents(chosen):
                    found.append(row)
                    held += len(row[2])
                    if held > BLOCK:
                        yield rows(reader.part, found)
                        found, held = [], 0
                if found:
                    yield rows(reader.part, found)

    kind = "part int, before long, doc_id long, n_tokens long, ids binary"
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return content.mapInArrow(run, kind)


def with_starts(documents: DataFrame) -> DataFrame:
    """Adds start, the number of ids of all documents before each; there is one total for each part."""
    totals = documents.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("part", F.coalesce(F.sum("_ids").over(order), F.lit(0)).alias("_ahead"))
    return documents.join(ahead, "part").withColumn("start", F.col("_ahead") + F.col("before")).drop("_ahead")
