"""Token ids in seekable binary files.

File format (all numbers little-endian):

* frames: independent zstandard frames, each the ids of whole documents as unsigned 32-bit integers, about FRAME_IDS of them;
* a skippable frame (magic 0x184D2A50) with the document index: for each document its id (signed 64 bits), its frame and its
  number of ids (unsigned 32 bits each); compressed with zstandard;
* a skippable frame (magic 0x184D2A5E) with the seek table: for each frame its compressed size, its size and a checksum (the
  low 32 bits of XXH64 over the ids), then the number of frames, a descriptor byte (0x80: checksums) and 0x8F92EAB1.

A reader finds both tables from the end of the file and decompresses only the frames of the documents it wants.  Any
zstandard tool can decompress the whole file.

Writing: a range partition by id puts ascending ids into ascending parts, each sorted and streamed into one file, so a task
holds one frame and the index.  A file has a name of its own for each attempt and counts only once the task has returned its
row of the manifest, which is checkpointed; a lost executor costs only its unfinished files.  Files are opened through
pyarrow's file systems, so the folder can be any address that those know.

Encoding: no token of a byte-level tokenizer goes across a single space between two other characters, so texts are encoded
in pieces cut before such spaces, each distinct piece once a worker, which remembers the pieces met last.  A piece of letters
goes straight to the tokenizer's model; closing punctuation and lines, which no token goes across either, are cut off and put
together from what is known; all other pieces go through the whole chain.

Defined cases: a null text is an empty one, which has the end id alone; a null id sorts first and is read as null; equal ids
follow each other in the order of their texts; no documents make no files or empty ones.
"""

from __future__ import annotations

import io
import os
import re
import string
import struct
import uuid
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, partitions, shared_dir
from .line_dedup import NO_ID

FRAME_IDS = 65_536
CHARS_PER_FILE = 64_000_000
END_ID = 0
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
SPACE_PAIR = re.compile(r" (?:(?=\s)|(?<=\s ))")
LONE_LINE = re.compile(r"(?<=\S)\n(?=\S)")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces that a worker remembers in each of two generations.
PIECES = 400_000


def byte_chars() -> dict[int, int]:
    """The printable character by which a byte-level vocabulary writes each byte: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


BYTE_CHARS = byte_chars()
SPACE_CHAR = chr(BYTE_CHARS[32])


class Encoder(dict):
    """Piece of text -> its ids as bytes, by the tokenizers library.

    When PIECES are held, they become the former generation, from which those that are met again come back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.model = t.model
        self.former: dict[str, bytes] = {}
        chain = repr(t.pre_tokenizer).replace(" ", "")
        # letters stay together under this pre-tokenizer alone, and where no added token can lie within them
        self.direct = chain.startswith("ByteLevel(") and "use_regex=True" in chain and "add_prefix_space=False" in chain and t.normalizer is None and not any(x.content.strip().isalpha() for x in t.get_added_tokens_decoder().values())
        self.lines = self.direct and not any("\n" in x.content or x.lstrip or x.rstrip for x in t.get_added_tokens_decoder().values())

    def _chain(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.former.get(piece)
        if ids is None:
            if self.lines and "\n" in piece and len(lines := LONE_LINE.split(piece)) > 1:
                return self["\n"].join([self[x] for x in lines])  # seldom met twice
            ids = self._encoded(piece)
        if len(self) >= PIECES:
            self.former = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _encoded(self, piece: str) -> bytes:
        word = piece.rstrip(string.punctuation)
        if not self.direct or not word.removeprefix(" ").isalpha():
            return array("I", self._chain(piece)).tobytes()
        if len(word) < len(piece):
            return self[word] + self[piece[len(word) :]]
        shown = word.replace(" ", SPACE_CHAR) if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "\0" in text or SPACE_PAIR.search(text):
            first, *rest = LONE_SPACE.split(text)
            return self[first] + b"".join([self[" " + x] for x in rest])
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class TokenFileWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3)
        self.frames, self.index, self.waiting, self.held = [], [], [], 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.index.append((doc_id, len(self.frames), len(ids) // 4))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        raw = b"".join(self.waiting)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        index = self.zstd.compress(np.array(self.index, [("id", "<i8"), ("frame", "<u4"), ("n", "<u4")]).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, FOOT_MAGIC)
        self.out.write(struct.pack("<III", SEEK_MAGIC, len(table) + 4, len(index)) + table)


class TokenFileReader:
    """Reads a file (anything with seek and read) of the format above."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        file.seek(0, io.SEEK_END)
        end = file.tell()
        file.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOT_MAGIC or descriptor != 0x80:
            raise ValueError("not a token file")
        file.seek(end - 9 - 12 * n - 12)
        magic, _, index = struct.unpack("<III", file.read(12))
        if magic != SEEK_MAGIC:
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(file.read(12 * n), "<u4").reshape(-1, 3)
        file.seek(end - 9 - 12 * n - 12 - index)
        self.index = np.frombuffer(self.zstd.decompress(file.read(index)), [("id", "<i8"), ("frame", "<u4"), ("n", "<u4")])
        self.offsets = np.r_[0, np.cumsum(self.frames[:, 0], dtype=np.int64)]

    def frame(self, k: int) -> bytes:
        import xxhash

        self.file.seek(int(self.offsets[k]))
        raw = self.zstd.decompress(self.file.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted=None):
        """(id, start, ids) in order, of all documents or of the wanted ids; start counts the ids before it in the file."""
        starts = np.r_[0, np.cumsum(self.index["n"], dtype=np.int64)]
        base = np.r_[0, np.cumsum(self.frames[:, 1], dtype=np.int64)] // 4
        rows = np.arange(len(self.index)) if wanted is None else np.flatnonzero(np.isin(self.index["id"], np.asarray(wanted)))
        at, raw = -1, b""
        for i in rows:
            own = int(self.index["frame"][i])
            if own != at:
                at, raw = own, self.frame(own)
            a = 4 * int(starts[i] - base[own])
            yield int(self.index["id"][i]), int(starts[i]), raw[a : a + 4 * int(self.index["n"][i])]


def _open(path: str, write: bool = False):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if write:
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner, compression=None)  # else the name would have it compressed once more
    return system.open_input_file(inner)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes and writes all documents; the checkpointed manifest (part, path, n_docs, n_tokens, start) in order of parts."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    chars = slim.agg(F.sum(F.length("_text"))).first()[0] or 0
    parts = max(partitions(spark), chars // CHARS_PER_FILE)
    end = struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.ids.zst"
        out = writer = None
        total = 0
        for pdf in batches:
            for i, text in zip(pdf["_id"], pdf["_text"]):
                if writer is None:
                    out = _open(path, write=True)
                    writer = TokenFileWriter(out)
                ids = encoder(tokenizer).encode(text) + end
                writer.add(int(i), ids)
                total += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"part": [part], "path": [path], "n_docs": [len(writer.index)], "n_tokens": [total]})

    sorted_docs = slim.repartitionByRange(parts, "_id").sortWithinPartitions("_id", "_text")
    manifest = cut(sorted_docs.mapInPandas(run, "part int, path string, n_docs long, n_tokens long"))
    return manifest.withColumn("start", F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens"))  # one row a file


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids): every document in the files, ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"]):
                with _open(path) as file:
                    rows, held = [], 0
                    for i, at, ids in TokenFileReader(file).documents():
                        rows.append((i, start + at, ids))
                        held += len(ids)
                        if held > 16_000_000:
                            yield pd.DataFrame(rows, columns=["_id", "start", "ids"])
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=["_id", "start", "ids"])

    spread = manifest.repartition(max(partitions(manifest.sparkSession), 1), "part")
    out = spread.select("path", "start").mapInPandas(run, "_id long, start long, ids binary")
    return out.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col), "start", "ids")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op7_token_files": op7_token_files}
ORACLE_SQL: dict[str, str] = {}
