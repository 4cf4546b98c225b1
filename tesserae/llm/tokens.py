"""Token files: every document's ids as one zstandard frame with a shared dictionary, an offset index and the dictionary's hash.

A folder holds `dictionary` and `shard-<n>.tok`; shards follow each other in ascending doc_id (nulls first, equal ids in the
order they were read in, so that any number of them is dealt over shards). A shard is: MAGIC, the dictionary's SHA-256, the frames one after the other, the index (for each document: doc_id
int64, null uint8, offset uint64, frame bytes uint32, ids uint32, array after array), then the index's offset and the number
of documents as uint64. Ids are little-endian uint16 where the vocabulary fits, else uint32; the width stands after the hash.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.files import locate, read_whole, write_whole
from tesserae.llm.kernels import chunks, utf8
from tesserae.llm.units import Units, flat
from tesserae.session import bound_batches, cut, new_path

MAGIC = b"TESSTOK1"
HEAD = len(MAGIC) + 32 + 1
#: Bounds of the dictionary: its bytes, and the documents that it is trained on and their characters. Documents are taken whole,
#: in the order of their hashes; one that would exceed the characters isn't taken.
DICTIONARY_BYTES, SAMPLE_DOCUMENTS, SAMPLE_CHARS = 1 << 16, 2000, 16 << 20
INDEX = (("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4"))
#: Unicode white space. Byte-level BPE starts a new word at each run of it, so what lies between two starts is encoded alone.
WHITE = [chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
SOLID = np.ones(256, bool)
SOLID[[ord(c) for c in WHITE if c.isascii()]] = False
#: The other ones in UTF-8, and which bytes begin one.
WIDE_WHITE = np.array([[*c.encode(), 0][:3] for c in WHITE if not c.isascii()], np.uint8)
LEADS = np.isin(np.arange(256), WIDE_WHITE[:, 0])


def byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: printable ones as they are, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


#: ASCII marks: neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder(Units):
    """Byte-level BPE of whole texts by the tokenizers library.

    Most units are letters, after one space or line end at most and before marks of punctuation or none. The library's
    pre-tokenizer cuts those into the line end, the letters with their space, and the marks, so the letters go straight to the
    library's model and the rest is looked up; all other units go through the whole library. So do whole texts that hold one of
    the tokenizer's added tokens (<|endoftext|>), at which the library cuts before anything else.
    """

    most_units, most_bytes = 1_000_000, 16_000_000

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_buffer(model)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.known: dict[str, list[int]] = {}
        self.letters = str.maketrans(dict(enumerate(byte_letters())))

    def solid(self, raw: np.ndarray) -> np.ndarray:
        out = SOLID[raw]
        at = np.flatnonzero(LEADS[raw])
        second, third = raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
        for a, b, c in WIDE_WHITE:
            own = at[(raw[at] == a) & (second == b) & ((third == c) | (c == 0))]
            for k in range(2 + bool(c)):
                out[own + k] = False
        return out

    def encode_bytes(self, raw: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds by text) of texts in UTF-8."""
        whole, data = {}, raw.tobytes()
        for token in self.added:
            at = data.find(token)
            while at >= 0:  # a find across two texts sends the first through the library, with the same result
                d = int(np.searchsorted(offsets, at, "right")) - 1
                whole[d] = self.tokenizer.encode(data[offsets[d] : offsets[d + 1]].decode(), add_special_tokens=False).ids
                at = data.find(token, int(offsets[d + 1]))
        if not whole:
            return self.ids(*self.numbers(raw, offsets), end)
        texts = [b"" if d in whole else data[offsets[d] : offsets[d + 1]] for d in range(len(offsets) - 1)]
        ids, bounds = self.ids(*self.numbers(*flat(texts)), end)
        parts = [np.concatenate([np.array(whole.get(i, []), ids.dtype), ids[a:b]]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(bounds.dtype)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_bytes(*flat([t.encode() for t in texts]), end)

    def learn(self, units: list[str]) -> list:
        tokenize, letters, new, rest = self.tokenizer.model.tokenize, self.letters, [], []
        space = letters[32]
        for i, unit in enumerate(units):
            head = unit[0]
            if unit.isalpha() or head == " " and unit[1:].isalpha():
                if unit.isascii():  # only the space is written by another letter
                    shown = space + unit[1:] if head == " " else unit
                else:
                    shown = unit.encode().decode("latin-1").translate(letters)
                new.append([t.id for t in tokenize(shown)])
                continue
            core = unit.rstrip(MARKS)
            if core.isalpha() or (head == " " or head == "\n") and core[1:].isalpha():
                ids = [] if head != "\n" else [*self.short("\n")]
                ids += [t.id for t in tokenize((core[1:] if ids else core).encode().decode("latin-1").translate(letters))]
                new.append(ids + self.short(unit[len(core) :]) if len(core) < len(unit) else ids)
            else:
                new.append(None)
                rest.append(i)
        for at in range(0, len(rest), 500):
            block = rest[at : at + 500]
            for i, e in zip(block, self.tokenizer.encode_batch([units[i] for i in block], add_special_tokens=False), strict=True):
                new[i] = e.ids
        return new

    def short(self, text: str) -> list[int]:
        """The ids of a line end or a run of marks, remembered."""
        if text not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.known[text]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of DICTIONARY_BYTES at most; too few samples to train on are taken as its content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


LEVEL = 1


def codec(dictionary: bytes) -> dict:
    """Arguments of a compressor or decompressor; the dictionary is digested once for all frames."""
    if not dictionary:
        return {}
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return {"dict_data": shared}


def sample_texts(docs: DataFrame) -> list[str]:
    """Whole texts of SAMPLE_DOCUMENTS documents and SAMPLE_CHARS characters at most, the least hashes of doc_id and text first."""
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.length("text").alias("n")).distinct()
    least = hashed.orderBy("h").limit(SAMPLE_DOCUMENTS).collect()
    chosen, room = [], SAMPLE_CHARS
    for r in least:
        if r.n <= room:
            chosen.append((r.h,))
            room -= r.n
    picked = docs.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long")), "h", "left_semi")
    return [r.text for r in picked.dropDuplicates(["h"]).orderBy("h").select("text").collect()]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, shards: int | None = None) -> tuple[str, list[tuple[str, int, int, int]]]:
    """Encode docs(doc_id, text) and write token files; (folder, [(shard's URI, documents, ids, ids before it)] in order).

    A null text counts as empty and has the end id alone. Repeated rows are written as often as they occur; a null doc_id stands
    first. An empty table gives a folder with the dictionary and no shard. Other columns are ignored. A text of any length is
    encoded whole, as one frame; a worker holds it with its ids.
    """
    spark = bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    model = spark.sparkContext.broadcast({"model": raw})
    own = Encoder(raw)
    width = 2 if own.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    kind = f"<u{width}"
    trained = train_dictionary([own.encode([t], end_id)[0].astype(kind).tobytes() for t in sample_texts(docs)])
    folder = new_path(spark, "tokens")
    write_whole(f"{folder}/dictionary", trained)
    shared = spark.sparkContext.broadcast(trained)

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        known = model.value
        if "encoder" not in known:  # the worker keeps what it has learnt for its next tasks
            known["encoder"] = Encoder(known["model"])
        encoder, packer, row = known["encoder"], zstandard.ZstdCompressor(level=LEVEL, **codec(shared.value)), TaskContext.get().partitionId() << 33
        for batch in batches:
            raw_text, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                ids, bounds = encoder.encode_bytes(raw_text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                ids = ids.astype(kind)
                frames = [packer.compress(ids[x:y].tobytes()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(row + np.arange(b - a), pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "row", "n", "frame"])
                row += b - a

    frames = cut(docs.mapInArrow(encode, "doc_id long, row long, n long, frame binary"), "frames")
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The row's number splits documents of one id over shards, however many there are.
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    ordered = frames.repartitionByRange(count, *order).sortWithinPartitions(*order)
    digest = hashlib.sha256(trained).digest()

    def write(batches):
        number, index, at, system = TaskContext.get().partitionId(), [], HEAD, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if system is None:
                uri = f"{folder}/shard-{number:06d}.tok"
                system, path = locate(uri)
                own_path = f"{path}.{uuid.uuid4().hex}"
                out = system.open_output_stream(own_path)
                out.write(MAGIC + digest + bytes([width]))
            ids = batch.column("doc_id")
            sizes = np.fromiter((len(x.as_buffer()) for x in batch.column("frame")), np.int64, batch.num_rows)
            index.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), at + np.cumsum(sizes) - sizes, sizes, batch.column("n").to_numpy()))
            for x in batch.column("frame"):
                out.write(x.as_buffer())
            at += int(sizes.sum())
        if system is not None:
            parts = [np.concatenate(x).astype(d) for x, (_, d) in zip(zip(*index, strict=True), INDEX, strict=True)]
            for x in parts:
                out.write(x.tobytes())
            out.write(np.array([at, len(parts[0])], "<u8").tobytes())
            out.close()
            system.move(own_path, path)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "docs": [len(parts[0])], "ids": [int(parts[4].sum(dtype=np.int64))]})

    done = sorted(tuple(r) for r in ordered.select("doc_id", "n", "frame").mapInArrow(write, "uri string, docs long, ids long").collect())  # one row a shard
    before = np.concatenate([[0], np.cumsum([r[2] for r in done])]).astype(np.int64)
    return folder, [(*r, int(b)) for r, b in zip(done, before, strict=False)]


def _open(uri: str, dictionary: bytes):
    """(open file, index, id type) of a shard; a dictionary with another hash is refused."""
    system, path = locate(uri)
    f = system.open_input_file(path)
    head = f.read_at(HEAD, 0)
    if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) : -1] != hashlib.sha256(dictionary).digest():
        raise ValueError(f"{uri} isn't a token file of this dictionary")
    at, n = map(int, np.frombuffer(f.read_at(16, f.size() - 16), "<u8"))
    index = {}
    for name, d in INDEX:
        size = n * np.dtype(d).itemsize
        index[name] = np.frombuffer(f.read_at(size, at), d)
        at += size
    return f, index, f"<u{head[-1]}"


def read_document(folder: str, uri: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document of a shard: reads its index and one frame only. None if it isn't there."""
    dictionary = read_whole(f"{folder}/dictionary")
    f, index, kind = _open(uri, dictionary)
    with f:
        found = np.flatnonzero((index["doc_id"] == doc_id) & (index["null"] == 0))
        if not len(found):
            return None
        frame = f.read_at(int(index["bytes"][found[0]]), int(index["offset"][found[0]]))
    return np.frombuffer(zstandard.ZstdDecompressor(**codec(dictionary)).decompress(frame), kind).astype(np.uint32)


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[str, int, int, int]], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the files in parallel by shard.

    start: ids of all documents before it. ids_crc32: of the ids as little-endian uint32.
    """
    rows = spark.createDataFrame([(u, b) for u, _, _, b in shards], "uri string, before long")

    def read(batches):
        dictionary = read_whole(f"{folder}/dictionary")
        unpack = zstandard.ZstdDecompressor(**codec(dictionary))
        for batch in batches:
            for uri, before in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist(), strict=True):
                f, index, kind = _open(uri, dictionary)
                start = before + np.cumsum(index["ids"], dtype=np.int64) - index["ids"]
                with f:
                    for a in range(0, len(start), 1000):
                        b = min(a + 1000, len(start))
                        block = f.read_at(int(index["offset"][b - 1] + index["bytes"][b - 1] - index["offset"][a]), int(index["offset"][a]))
                        at = (index["offset"][a:b] - index["offset"][a]).astype(np.int64)
                        ids = [np.frombuffer(unpack.decompress(block[x : x + int(n)]), kind).astype("<u4") for x, n in zip(at, index["bytes"][a:b], strict=True)]
                        out = {"doc_id": pa.array(index["doc_id"][a:b], pa.int64(), mask=index["null"][a:b].astype(bool)), "start": pa.array(start[a:b], pa.int64()), "n_tokens": pa.array(list(map(len, ids)), pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())}
                        yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.repartition(max(1, min(len(shards), 4096))).mapInArrow(read, schema)
