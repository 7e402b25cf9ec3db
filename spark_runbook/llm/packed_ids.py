"""Token ids in fixed-width bit-packed files.

A file holds the ids of a range of documents, each id in the fewest bits that the vocabulary needs, little-endian bit order, in
byte-aligned blocks of ``BLOCK`` ids. Behind the blocks stand the documents' table (id, first id) and the blocks' byte offsets, so a
reader can seek to any run of ids and unpack it with numpy:

    packed blocks | doc ids i64 | doc id known u8 | starts u64 (n_docs + 1) | block offsets u64 (n_blocks + 1) | footer

Documents are range-partitioned by id, so files and the documents in them ascend. A task writes under a name of its own and moves the
file into place when it is whole: a lost executor or a second attempt leaves no half files. Files are read back with Spark's
binaryFile reader.

Defined results: null text counts as empty (the end id alone); null ids come first; repeated rows are written one by one; an
empty table gives no files.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import cut, give_back, shared_dir, small_batches, text_or_empty, utf8_bytes

BLOCK = 4096
MAGIC = b"PKIDS\x01"
FOOTER = struct.Struct("<6sBxIQQ")  # magic, bits, ids a block, ids, documents
FILE_TEXT_BYTES = 16 << 20
CACHE_WORDS, CACHE_CHARS = 1_000_000, 48
ENDS = ".,!?;:|"


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same layout
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


class PackedFile:
    """Random access to the bytes of one file (bytes, memory map or memoryview)."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block, self.n_ids, self.n_docs = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        blocks = -(-self.n_ids // self.block)
        end = len(self.data) - FOOTER.size
        at = end - 8 * (blocks + 1)
        self.offsets = np.frombuffer(self.data[at:end], "<u8")
        at, end = at - 8 * (self.n_docs + 1), at
        self.starts = np.frombuffer(self.data[at:end], "<u8")
        at, end = at - self.n_docs, at
        self.known = np.frombuffer(self.data[at:end], np.uint8).astype(bool)
        self.doc_ids = np.frombuffer(self.data[at - 8 * self.n_docs : at], "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of this file; touches the blocks they lie in only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        out = [unpack(self.data[self.offsets[i] : self.offsets[i + 1]], min(self.block, self.n_ids - i * self.block), self.bits) for i in range(a, b)]
        return np.concatenate(out)[start - a * self.block : stop - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class PackedWriter:
    """Streams ids to a file object; holds one block and the tables."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.rest, self.at, self.n = np.zeros(0, np.uint32), 0, 0
        self.docs, self.starts, self.offsets = [], [0], [0]

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: list, ids: list[np.ndarray]) -> None:
        self.docs += docs
        self.starts += (self.starts[-1] + np.cumsum([len(x) for x in ids])).tolist()
        flat = np.concatenate([self.rest, *ids])
        whole = len(flat) // self.block * self.block
        for i in range(0, whole, self.block):
            self._block(flat[i : i + self.block])
        self.rest = flat[whole:]

    def _block(self, ids: np.ndarray) -> None:
        self._write(pack(ids, self.bits))
        self.offsets.append(self.at)
        self.n += len(ids)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        for data in (
            np.array([d or 0 for d in self.docs], "<i8"), np.array([d is not None for d in self.docs], np.uint8), np.array(self.starts, "<u8"), np.array(self.offsets, "<u8"),
        ):
            self._write(data.tobytes())
        self._write(FOOTER.pack(MAGIC, self.bits, self.block, self.n, len(self.docs)))


class WordEncoder:
    """A tokenizers file applied to whole texts by way of a bounded cache of words.

    Allowed where no pre-token crosses a space, tab or line end (checked on pairs of words of all kinds): the ids of a text are then the
    ids of its words. Unknown words of letters alone are encoded many at a time; where one word ends is told by the pieces that end a
    word, and if their number isn't that of the words, each word is encoded alone. Closing punctuation is cut off only where the word is of
    letters alone after normalising too (lower-casing can make marks that join what follows). The cache is emptied when full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.vocab = max(vocab.values()) + 1
        self.final = np.zeros(self.vocab, bool)
        self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        probes = ["a", "Ab", "7", "'s", "it's", ".", "...", "é", "\u0301", "\u0345", "中", "😀", "İ", "<", "|>", "_", "-1"]
        pairs = [(a, b, s) for a in probes for b in probes for s in " \n\t\r"]
        if any(self.tok.encode(a + s + b, add_special_tokens=False).ids != [*self.tok.encode(a, add_special_tokens=False).ids, *self.tok.encode(b, add_special_tokens=False).ids] for a, b, s in pairs):
            raise ValueError("words of this file can't be encoded apart")

    def _letters(self, w: str) -> bool:
        """Whether w is of letters alone, as it is and normalised."""
        return w.isalpha() and (w.isascii() or self.tok.normalizer is None or self.tok.normalizer.normalize_str(w).isalpha())

    def _alone(self, words: list[str]) -> dict[str, bytes]:
        return {w: struct.pack(f"<{len(e.ids)}I", *e.ids) for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False), strict=True)}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        plain, ended, rest = [], [], []
        for w in words:
            if self._letters(w):
                plain.append(w)
            elif (stem := w.rstrip(ENDS)) != w and self._letters(stem):
                ended.append((w, stem))
            else:
                rest.append(w)
        stems = {s for _, s in ended}.difference(self.known, plain)
        rest += {w[len(s) :] for w, s in ended}.difference(self.known, rest)
        plain += stems
        out = {}
        runs = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        for part, e in zip(runs, self.tok.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(self.final[ids]) + 1) * 4
            if len(ends) == len(part):
                data = ids.tobytes()
                out.update(zip(part, [data[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True))
            else:
                out.update(self._alone(part))
        out.update(self._alone(rest))
        for w, s in ended:
            out[w] = (out.get(s) or self.known[s]) + (out.get(w[len(s) :]) or self.known[w[len(s) :]])
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        fresh = set().union(*split).difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known = {"": b""}
            fresh = set().union(*split).difference(self.known)
        if fresh:
            self.known.update(self._learn(fresh))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_many([text])[0], "<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def id_bits(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _parts(texts: list[str], chars: int = 1 << 20):
    """Runs of texts of about so many letters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def write_packed(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Writes the ids of all documents below ``out`` and returns the manifest: part, n_docs, n_ids."""
    small_batches(docs.sparkSession)
    files = files or max(1, -(-(docs.agg(F.sum(utf8_bytes(text_col))).first()[0] or 0) // FILE_TEXT_BYTES))

    def write(batches):
        store, base = _store(out)
        store.create_dir(base, recursive=True)
        part, tok, writer = TaskContext.get().partitionId(), encoder(tokenizer_path), None
        own = f"{base}/_{part:05d}-{uuid.uuid4().hex}"
        stream = None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                stream = store.open_output_stream(own)
                writer = PackedWriter(stream, id_bits(max(tok.vocab, end_id + 1)))
            end, docs_of, at = struct.pack("<I", end_id), b.column(0).to_pylist(), 0
            for texts in _parts(b.column(1).to_pylist()):
                writer.add(docs_of[at : at + len(texts)], [np.frombuffer(ids + end, "<u4") for ids in tok.encode_many(texts)])
                at += len(texts)
        if writer is not None:
            writer.close()
            stream.close()
            store.move(own, f"{base}/part-{part:05d}.ids")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.n], pa.int64())], names=["part", "n_docs", "n_ids"])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return cut(ordered.mapInArrow(give_back(write), "part int, n_docs long, n_ids long"))


def read_packed(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = PackedFile(content.as_buffer())
                part, n = int(path.rsplit("-", 1)[1].split(".")[0]), f.n_docs
                for a in range(0, n, 5000):
                    z = min(n, a + 5000)
                    flat, first = f.ids(int(f.starts[a]), int(f.starts[z])).astype("<u4"), int(f.starts[a])
                    cuts = [(int(x) - first) for x in f.starts[a : z + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * (z - a), pa.int32()),
                            pa.array(f.doc_ids[a:z], pa.int64(), mask=~f.known[a:z]),
                            pa.array(f.starts[a:z].astype(np.int64)),
                            pa.array(np.diff(f.starts[a : z + 1]).astype(np.int64)),
                            pa.array([zlib.crc32(flat[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                        ],
                        names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(out).select("path", "content")
    docs = files.mapInArrow(give_back(read), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    base = manifest.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return docs.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


END_ID = 1


def op9_packed_ids(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    return read_packed(spark, out, write_packed(docs, out, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), END_ID))
