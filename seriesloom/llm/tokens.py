"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file holds the documents of one id range, ascending.  Its frames hold the ids
of whole documents as little-endian unsigned 32-bit numbers.  After them comes
a skippable frame with one entry per document, then the seek table of the
public zstandard seekable format: compressed size, plain size and checksum (low
32 bits of XXH64) of each frame, their number and a magic number.  A reader
goes from the file's end to the seek table, to the document index and to the
frames it needs, and decompresses only those.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.tables import in_ranges, open_fs, save, shuffle_partitions
from seriesloom.llm.text import raw_texts
from seriesloom.session import new_table_path

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
DOC = struct.Struct("<qBIIQ")  # id, 1 if the id is null, frame, first token in the frame, tokens
DOC_TAIL = struct.Struct("<I")

FRAME_TOKENS = 1 << 16
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
CACHE = 150_000  # pieces in a table; there are two tables of each kind
FILES = "bucket int, path string, docs bigint, tokens bigint"


def byte_letters() -> list[str]:
    """The character a byte-level vocabulary writes for each byte: itself if it is visible Latin-1, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


# White space other than single spaces and line ends; U+20xx is looked at again, it holds quotes too.
ODD = (
    b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85",
    b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80",
)
MARKS = ".,;:!?|#$%&*"


class Encoder:
    """Ids of UTF-8 texts as packed 32-bit numbers, with the library's result.

    A byte-level tokenizer of this kind never joins a word to the single space
    after it, so a text falls into pieces at single spaces between other
    characters, and at single line ends.  The library encodes each distinct
    piece once; a bounded table keeps the results.  A piece of letters and marks
    behind them is a word and a run of marks to the tokenizer, so these are
    looked up by themselves, and a word goes straight to the library's model.

    A text that holds the text of an added token goes to the library whole,
    which makes it that token; with ``special_as_text`` it is text like other.
    """

    def __init__(self, path: str, end_id: int | None = 0, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [] if special_as_text else [t.content.encode() for t in added]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.first = Pieces(self, "")  # pieces at a line's start
        self.later = Pieces(self, " ")  # pieces after a space, without it
        self.marks: dict[str, bytes] = {}
        self.newline = self._encode(["\n"])[0]
        self.cut = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The library takes the pieces as one sequence and names the piece of each id."""
        done = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(done.ids, "<u4").tobytes()
        cuts = np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(texts) + 1)).tolist()
        return [ids[4 * a : 4 * z] for a, z in zip(cuts, cuts[1:])]

    def piece(self, raw: bytes, space: str) -> bytes:
        """Ids of a piece with what stands before it."""
        text = raw.decode()
        if text.isalpha():
            return self._word(raw, space)
        core = text.rstrip(MARKS)
        if not core.isalpha():
            return self._encode([space + text])[0]
        tail = text[len(core) :]
        if tail not in self.marks:
            if len(self.marks) >= CACHE:
                self.marks.clear()
            self.marks[tail] = self._encode([tail])[0]
        return self._word(core.encode(), space) + self.marks[tail]

    def _word(self, raw: bytes, space: str) -> bytes:
        """Ids of letters only, with one space before them or none: one word to the tokenizer."""
        word = raw.decode("latin-1")
        word = ("\u0120" if space else "") + (word if word.isascii() else word.translate(self.letters))
        ids = [t.id for t in self.model.tokenize(word)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()

    def _odd(self, raw: bytes) -> bool:
        """Whether there is white space other than single spaces and line ends between other characters."""
        if raw[0] in b" \n" or raw[-1] in b" \n":
            return True
        if not any(c in raw for c in ODD):
            return False
        text = raw.decode()
        return [p for line in text.split("\n") for p in line.split(" ")] != text.split()

    def __call__(self, raw: bytes) -> bytes:
        if not raw:
            return self.end
        if any(a in raw for a in self.added):
            ids = self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes() + self.end
        if self._odd(raw):
            pieces = [p.encode() for p in self.cut.split(raw.decode())]
            return b"".join(map(self.first.__getitem__, pieces)) + self.end
        first, later, out = self.first, self.later.__getitem__, []
        for line in raw.split(b"\n"):
            words = line.split(b" ")
            out.append(self.newline)
            out.append(first[words[0]])
            out += map(later, words[1:])
        return b"".join(out[1:]) + self.end


class Pieces(dict):
    """Ids by piece, filled as pieces are asked for.

    A full table becomes the older one and is filled anew; what is asked for
    again comes over from the older, so rare pieces go and frequent ones stay.
    """

    def __init__(self, encoder: Encoder, space: str) -> None:
        super().__init__()
        self.encode, self.space, self.older, self.room = encoder.piece, space, {}, CACHE

    def __missing__(self, raw: bytes) -> bytes:
        ids = self[raw] = self.older.get(raw) or self.encode(raw, self.space)
        self.room -= 1
        if not self.room:
            self.older, self.room = dict(self), CACHE
            self.clear()
        return ids


@lru_cache(maxsize=2)
def encoder_of(path: str, end_id: int | None, special_as_text: bool = False) -> Encoder:
    """One encoder for all tasks of a worker process, so that its table of pieces stays warm."""
    return Encoder(path, end_id, special_as_text)


class FileWriter:
    """Writes one token file; keeps a frame and the tables in memory."""

    def __init__(self, out, level: int = 3) -> None:
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.docs: list[bytes] = []
        self.held: list[bytes] = []
        self.in_frame = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append(DOC.pack(doc_id or 0, doc_id is None, len(self.frames), self.in_frame, n))
        self.held.append(ids)
        self.in_frame += n
        self.tokens += n
        if self.in_frame >= FRAME_TOKENS:
            self._flush()

    def _flush(self) -> None:
        plain = b"".join(self.held)
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.frames.append(ENTRY.pack(len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.in_frame = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = b"".join(self.docs) + DOC_TAIL.pack(len(self.docs))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = b"".join(self.frames) + FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()


class FileReader:
    """Opens a token file from its end; decompresses a frame when a document in it is asked for."""

    def __init__(self, file, size: int) -> None:
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()

        def part(end: int, length: int) -> bytes:
            file.seek(end - length)
            return file.read(length)

        count, flags, magic = FOOTER.unpack(part(size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the file's end")
        end = size - FOOTER.size
        self.frames = list(ENTRY.iter_unpack(part(end, count * ENTRY.size)))
        self.offsets = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)]).tolist()
        end -= count * ENTRY.size + 8
        docs = DOC_TAIL.unpack(part(end, DOC_TAIL.size))[0]
        self.docs = list(DOC.iter_unpack(part(end - DOC_TAIL.size, docs * DOC.size)))
        self.at, self.plain = -1, b""

    def frame(self, k: int) -> bytes:
        if k != self.at:
            packed, size, check = self.frames[k]
            self.file.seek(self.offsets[k])
            plain = self.unpacker.decompress(self.file.read(packed), max_output_size=size)
            if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} differs from its checksum")
            self.at, self.plain = k, plain
        return self.plain

    def documents(self, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, tokens before it in the file, packed ids) of all or the wanted documents."""
        before = 0
        for doc_id, null, k, first, n in self.docs:
            doc_id = None if null else doc_id
            if wanted is None or doc_id in wanted:
                yield doc_id, before, self.frame(k)[4 * first : 4 * (first + n)]
            before += n


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int | None = 0, level: int = 3,
) -> DataFrame:
    """Table of files (bucket, path, docs, tokens); buckets ascend with the id.

    ``tokenizer`` is the path of a tokenizer file that every node has.  Null
    texts are empty; null ids come first; rows of one id follow each other in
    the order of their texts.  Other columns are ignored.  An empty table gives
    no file.  A repeated task writes a file of another name; the table names
    those that count.
    """
    folder = folder or new_table_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        encoder = encoder_of(tokenizer, end_id)
        writer, bucket, name = None, None, ""

        def close() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.docs)]),
                 pa.array([writer.tokens])], ["bucket", "path", "docs", "tokens"],
            )

        for batch in batches:
            for b, ident, text in zip(*(batch.column(k).to_pylist() for k in (0, 2)), raw_texts(batch.column(3))):
                if b != bucket:
                    if writer is not None:
                        yield close()
                    bucket, name = b, f"{b:06d}-{uuid.uuid4().hex}.tokens"
                    writer = FileWriter(fs.open_output_stream(f"{base}/{name}", compression=None), level)
                writer.add(ident, encoder(text))
        if writer is not None:
            yield close()

    rows, _ = in_ranges(docs, id_col, text_col)
    return save(rows.mapInArrow(run, FILES), "token-files")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(files: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """One row per document: id, ids before it in all files, its ids' number and CRC-32; with the ids if wanted."""
    # One row per file, so one task orders file names and counts only.
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("bucket", "path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as file:
                    out = []
                    for ident, before, ids in FileReader(file, file.size()).documents():
                        row = (ident, base + before, len(ids) // 4, zlib.crc32(ids))
                        out.append(row + ((np.frombuffer(ids, "<u4").astype(np.int64),) if with_ids else ()))
                        if len(out) >= (200 if with_ids else 10_000):
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    spread = placed.repartition(shuffle_partitions(files.sparkSession), "path")
    return spread.mapInArrow(run, READ + (", ids array<bigint>" if with_ids else ""))
