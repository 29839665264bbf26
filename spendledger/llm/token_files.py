"""Token ids in Arrow files of equal-length sequences (operator 1).

A file of the format is an Arrow IPC file.  Each record batch holds two
fixed-size-list columns of the same length L: ``ids`` and ``mask``.  The documents'
ids, each followed by the end id, form one stream that is cut every L ids; the last
sequence of a file is padded with the end id, and ``mask`` is false there.  Since all
sequences of a file have one size, sequence k is found by arithmetic and read without
a copy from a memory map.  An index file of the same name plus ``.index`` lists
``doc_id, start, n_tokens`` of each document in the file.
"""
from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendledger.llm.common import documents, materialise
from spendledger.session import scratch_path

SEQUENCE = 2048
BATCH = 256
#: Entries of a worker's word table; it is emptied when full.
WORDS_KEPT = 1_000_000

_OTHER_SPACE = re.compile(r"[^\S \n]")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class WordEncoder:
    """``tokenizers`` with a table of words already encoded.

    A byte-level vocabulary splits a text before every single space between two
    non-space characters, whatever stands around it, so the parts between such spaces
    can be encoded one by one.  A text that holds a special token's string is given to
    the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        # Bytes of text that each id stands for: a byte-level piece has one character for each byte.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(piece)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian integers of ``dtype``."""
        if any(s in text for s in self.special):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = self._parts(text)
        head = self._pack(self.tokenizer.encode(first, add_special_tokens=False).ids) if first else b""
        known = self.known
        got = list(map(known.get, rest))
        if None in got:
            if len(known) > WORDS_KEPT:
                known.clear()
            fresh = self._words(list({w for w, g in zip(rest, got, strict=True) if g is None}))
            known.update(fresh)
            got = [fresh[w] if g is None else g for w, g in zip(rest, got, strict=True)]
        return head + b"".join(got)

    @staticmethod
    def _parts(text: str) -> list[str]:
        """The text cut at every space between two characters that are not white space."""
        odd = text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text
        return _LONE_SPACE.split(text) if odd or _OTHER_SPACE.search(text) else text.split(" ")

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that each follow a space: the library encodes them in one text, which is cut by the pieces' bytes."""
        ends = [w for w in words if w[-1].isspace()]  # would run into the next word's space
        words = [w for w in words if not w[-1].isspace()]
        out = {w: self._pack(self.tokenizer.encode(" " + w, add_special_tokens=False).ids) for w in ends}
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
            stop = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
            reach = np.cumsum(self.width[ids])
            cut = np.searchsorted(reach, stop) + 1
            if not np.array_equal(reach[cut - 1], stop):
                raise ValueError("the vocabulary is not byte-level: pieces do not end where words do")
            data, size = ids.tobytes(), self.dtype.itemsize
            cut *= size
            out.update(zip(words, (data[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)), strict=True))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def schema(dtype: np.dtype, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([
        pa.field("ids", pa.list_(kind, length), nullable=False),
        pa.field("mask", pa.list_(pa.bool_(), length), nullable=False),
    ])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, path string, n_docs long, n_tokens long"


class SequenceWriter:
    """Write documents' ids to one file of the format and its index; memory is bounded by a batch and a document."""

    def __init__(self, path: str, dtype: np.dtype, length: int = SEQUENCE):
        fs, at = filesystem(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.schema, self.dtype, self.length = schema(dtype, length), dtype, length
        self.sinks = [fs.open_output_stream(at), fs.open_output_stream(at + ".index")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], INDEX)
        self.held, self.rows, self.n_docs, self.n_tokens = bytearray(), [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids`` ends with the end id."""
        n = len(ids) // self.dtype.itemsize
        self.rows.append((doc_id, self.n_tokens, n))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        self.held += ids
        block = self.length * BATCH * self.dtype.itemsize
        while len(self.held) >= block:
            self._write(bytes(self.held[:block]), self.length * BATCH)
            del self.held[:block]
        if len(self.rows) >= 4096:
            self._write_index()

    def _write(self, data: bytes, real: int) -> None:
        flat = np.frombuffer(data, self.dtype)
        kind = self.schema.field("ids").type
        mask = np.arange(len(flat)) < real
        self.ids.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(flat, kind.value_type), type=kind),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field("mask").type),
        ], schema=self.schema))

    def _write_index(self) -> None:
        columns = list(zip(*self.rows, strict=True)) or [(), (), ()]
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        self.rows = []

    def close(self) -> None:
        if self.held:
            real = len(self.held) // self.dtype.itemsize
            pad = -real % self.length
            self._write(bytes(self.held) + bytes(pad * self.dtype.itemsize), real)
        self._write_index()
        self.ids.close()
        self.index.close()
        for s in self.sinks:
            s.close()


class SequenceFile:
    """Random access to a file of the format; on a local disk the arrays are views of a memory map."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.reader, self.index = (
            pa.ipc.open_file(pa.memory_map(x) if local else fs.open_input_file(x)) for x in (at, at + ".index"))
        self.length = self.reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        last = self.reader.num_record_batches - 1
        return last * BATCH + self.reader.get_batch(last).num_rows if last >= 0 else 0

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``k``."""
        batch = self.reader.get_batch(k // BATCH)
        ids, mask = batch.column(0), batch.column(1)
        return ids[k % BATCH].values.to_numpy(zero_copy_only=True), mask[k % BATCH].values

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Each document's id, start and ids, the latter in pieces as the batches cut them."""
        at, flat, begin = -1, np.zeros(0, np.uint16), 0
        for k in range(self.index.num_record_batches):
            for row in self.index.get_batch(k).to_pylist():
                pieces, start, end = [], row["start"], row["start"] + row["n_tokens"]
                while start < end:
                    if start >= begin + len(flat):
                        begin, at = begin + len(flat), at + 1
                        flat = self.reader.get_batch(at).column(0).flatten().to_numpy(zero_copy_only=True)
                    stop = min(end, begin + len(flat))
                    pieces.append(flat[start - begin:stop - begin])
                    start = stop
                yield row["doc_id"], row["start"], iter(pieces)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = SEQUENCE,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write the ids in ascending ``doc_id`` order; the files' manifest is returned.

    Null text is empty: it has the end id alone.  A null id sorts first, and repeated
    rows are kept.  An empty table gives no file.  Each attempt of a task writes a file
    of its own name and only a task that ended well gets into the manifest (``part,
    path, n_docs, n_tokens``), so retried tasks leave no doubles.
    """
    folder = scratch_path(docs.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer = encoder(vocabulary), None
        end = np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or SequenceWriter(path, enc.dtype, length)
                writer.add(doc_id, enc.encode(text.as_py()) + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": path, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = documents(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files.

    ``start`` counts the ids of all documents before, over all files.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, start, pieces in SequenceFile(path).documents():
                    n = crc = 0
                    for p in pieces:
                        n, crc = n + len(p), zlib.crc32(p.astype("<u4").tobytes(), crc)
                    rows.append((doc_id, base + start, n, crc))
                    if len(rows) == 4096:
                        yield _record(rows)
                        rows = []
                if rows:
                    yield _record(rows)

    files = max(1, manifest.count())
    return (
        placed.select("path", "base", "part").repartitionByRange(files, "part").select("path", "base")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def _record(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
