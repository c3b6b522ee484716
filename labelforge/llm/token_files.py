"""Token ids in files of their own binary format: canonical Huffman codes of
limited length, in blocks that are decoded on their own.

``write_corpus`` makes three passes.  It range-partitions the documents by
``doc_id`` and encodes them once (the ids are stored by partition, in order);
it counts every id of the corpus and derives the code by package-merge, no code
longer than ``MAX_BITS``; it packs the ids into files.  A document's first id is
its partition's offset plus the ids before it in that partition, so no window
runs over the whole table.

A file (little-endian) holds consecutive ids of consecutive documents:

    header   magic, number of the first id in the corpus (u64), crc32 of the code (u32)
    blocks   ids (u32), payload bytes (u32), the bit offset of each
             ``CHECKPOINT``-th id (u32 each), payload: codes, highest bit first
    footer   zlib: place of each block (u64), doc_id (i64), null flag (u8), ids (u64) of each document
    trailer  place of the footer (u64), blocks (u32), documents (u32), magic

``code.huf`` beside the files holds the code lengths; canonical codes follow
from them.  A block needs nothing but the code, and inside a block each
checkpoint is a place to start, so decoding runs through all checkpoints of
some blocks in step, one table look-up per id.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import documents, ship, small_batches, stored
from labelforge.session import scratch_path

MAGIC = b"LFIDS001"
END_ID = 0
#: Longest code.  The decoding table has 2 to the power of it entries (4 MB).
MAX_BITS = 20
BLOCK_IDS = 1 << 16
CHECKPOINT = 1 << 9
#: A file is closed after so many ids or documents; a document is never cut.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20
#: Tasks that read the files at most.
READ_TASKS = 1 << 14
#: Blocks that are packed or decoded at a time.
HELD_BLOCKS = 16
#: Pieces whose ids a Python worker remembers, the ids of them all, and the longest such piece in bytes.
HELD_PIECES, HELD_IDS, PIECE_BYTES = 1 << 20, 1 << 24, 64
#: New pieces that the library encodes as one text, where they may stand in a row.
ROW_PIECES = 1 << 8

HEADER, BLOCK, TRAILER = struct.Struct("<8sQI"), struct.Struct("<II"), struct.Struct("<QII8s")
#: Kinds of bytes: white space, letter, mark that ends a word, first byte of a character that may be white space.
WHITE, LETTER, MARK, WIDE = 1, 2, 4, 8
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(9, 14), *range(28, 33)]] |= WHITE
KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] |= LETTER
KINDS[[*b".,;:!?\n"]] |= MARK
KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] |= WIDE
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]



# the code -------------------------------------------------------------------

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each id (0 where its count is 0), by package-merge: the least
    total bits among prefix codes with no code above ``max_bits`` (or above what
    the number of ids needs at least).  Equal counts: the smaller id first."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        merged = np.argsort(both, kind="stable")
        level = both[merged]
        is_leaf.append(merged < len(leaves))
    take = 2 * len(leaves) - 2
    of_leaf = np.zeros(len(leaves) + 1, np.int64)
    for row in reversed(is_leaf):
        n = int(row[:take].sum())
        of_leaf[0] += 1
        of_leaf[n] -= 1
        take = 2 * (take - n)
    lengths[order] = np.cumsum(of_leaf)[:-1]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: shorter codes first, then the smaller id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        top = int(lengths.max())
        spans = np.left_shift(np.int64(1), top - lengths[order].astype(np.int64))
        codes[order] = (np.cumsum(spans) - spans) >> (top - lengths[order].astype(np.int64))
    return codes


class Decoder:
    """Decoding table: the next ``bits`` bits give the id and its code length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.bits = int(lengths.max()) if len(used) else 1
        self.table = np.zeros(1 << self.bits, np.int32 if len(lengths) <= 1 << 25 else np.int64)
        codes = canonical(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        shift = self.bits - lengths[order].astype(np.int64)
        filled = np.repeat(order << 6 | lengths[order], np.left_shift(1, shift))
        if len(order):
            first = int(codes[order[0]]) << int(shift[0])
            self.table[first:first + len(filled)] = filled

    def run(self, payload: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
        """``steps`` ids from each bit offset in ``starts``, a row for each; what lies
        beyond a run's own ids is for the caller to cut off."""
        padded = np.concatenate([payload, np.zeros(steps * self.bits // 8 + 16, np.uint8)]).astype(np.int64)
        n = len(padded) - 4
        window = padded[:n] << 32
        for k in range(1, 5):
            window |= padded[k:n + k] << (32 - 8 * k)
        at, spare, cut = starts.astype(np.int64), 40 - self.bits, (1 << self.bits) - 1
        out = np.empty((steps, len(starts)), self.table.dtype)
        for row in out:
            shift = np.bitwise_and(at, 7)
            np.subtract(spare, shift, out=shift)
            place = window.take(at >> 3)
            np.right_shift(place, shift, out=place)
            np.bitwise_and(place, cut, out=place)
            self.table.take(place, out=row, mode="clip")
            np.add(at, row & 63, out=at)
        return (out >> 6).T


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bit offset of each checkpoint, payload) of one block."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, off = at >> 5, at & 31
    window = codes[ids] << (64 - off - size).astype(np.uint64)
    n = int(ends[-1] + 31 >> 5) + 1
    # codes in one word have no bit in common: float sums below 2^53 are exact
    words = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n)
    words += np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    payload = words.astype(np.uint64).astype(">u4").tobytes()[:int(ends[-1] + 7 >> 3)]
    return at[::CHECKPOINT].astype("<u4"), payload


# files ----------------------------------------------------------------------

def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that all executors share."""
    found, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))
    return found, path.rstrip("/")


def write_code(folder: str, lengths: np.ndarray) -> None:
    """``code.huf``: magic, number of ids (u32), their code lengths (zlib)."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/code.huf") as out:
        out.write(MAGIC + struct.pack("<I", len(lengths)) + zlib.compress(lengths.tobytes()))


def read_code(folder: str) -> np.ndarray:
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/code.huf") as source:
        data = source.read()
    lengths = np.frombuffer(zlib.decompress(data[12:]), np.uint8)
    if data[:8] != MAGIC or struct.unpack_from("<I", data, 8)[0] != len(lengths):
        raise ValueError(f"{folder}/code.huf is no code table")
    return lengths


class Writer:
    """Writes one file; ids stay in memory for ``HELD_BLOCKS`` blocks at most,
    besides the document being added.  The file gets its name when it is whole,
    so a retried task replaces it by the same bytes."""

    def __init__(self, folder: str, first: int, lengths: np.ndarray, codes: np.ndarray):
        self.system, base = file_system(folder)
        self.path, self.temp = f"{base}/ids-{first:020d}.huf", f"{base}/.{uuid.uuid4().hex}"
        self.first, self.lengths, self.codes = first, lengths, codes
        self.out = self.system.open_output_stream(self.temp)
        self.out.write(HEADER.pack(MAGIC, first, zlib.crc32(lengths.tobytes())))
        self.blocks, self.docs, self.held, self.n_held, self.n_ids = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= HELD_BLOCKS * BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_ids: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.int64)
        whole = len(ids) if all_ids else len(ids) // BLOCK_IDS * BLOCK_IDS
        for k in range(0, whole, BLOCK_IDS):
            block = ids[k:min(k + BLOCK_IDS, whole)]
            points, payload = pack(block, self.lengths, self.codes)
            self.blocks.append(self.out.tell())
            self.out.write(BLOCK.pack(len(block), len(payload)))
            self.out.write(points.tobytes())
            self.out.write(payload)
        self.held = [ids[whole:].copy()]
        self.n_held = len(ids) - whole

    def close(self) -> dict:
        self._flush(True)
        at = self.out.tell()
        self.out.write(zlib.compress(b"".join([
            np.array(self.blocks, "<u8").tobytes(), np.array([d or 0 for d, _ in self.docs], "<i8").tobytes(),
            np.array([d is None for d, _ in self.docs], "u1").tobytes(), np.array([n for _, n in self.docs], "<u8").tobytes()])))
        self.out.write(TRAILER.pack(at, len(self.blocks), len(self.docs), MAGIC))
        size = self.out.tell()
        self.out.close()
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)  # of a lost attempt: the same bytes
        self.system.move(self.temp, self.path)
        return {"file": os.path.basename(self.path), "first": self.first, "ids": self.n_ids, "docs": len(self.docs), "bytes": size}


class Reader:
    """Reads one file; ``decoder`` may be shared by the files of a folder."""

    def __init__(self, folder: str, name: str, decoder: Decoder | None = None, code_crc: int | None = None):
        system, base = file_system(folder)
        if decoder is None:
            lengths = read_code(folder)
            decoder, code_crc = Decoder(lengths), zlib.crc32(lengths.tobytes())
        self.decoder, self.file = decoder, system.open_input_file(f"{base}/{name}")
        magic, self.first, crc = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        size = self.file.size()
        at, n_blocks, n_docs, end = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or end != MAGIC or crc != code_crc:
            raise ValueError(f"{name} is no file of this folder's code")
        footer = zlib.decompress(self.file.read_at(size - TRAILER.size - at, at))
        self.blocks = np.append(np.frombuffer(footer, "<u8", n_blocks), [at]).astype(np.int64)
        doc_ids = np.frombuffer(footer, "<i8", n_docs, 8 * n_blocks)
        nulls = np.frombuffer(footer, "u1", n_docs, 8 * (n_blocks + n_docs)).astype(bool)
        self.doc_ids = pa.array(doc_ids, pa.int64(), mask=nulls)
        self.sizes = np.frombuffer(footer, "<u8", n_docs, 8 * n_blocks + 9 * n_docs).astype(np.int64)

    def _decode(self, first: int, last: int, skip: int = 0) -> np.ndarray:
        """The ids of blocks ``first`` to ``last`` (not included), without the first
        ``skip`` checkpoints of the first block."""
        data = self.file.read_at(int(self.blocks[last] - self.blocks[first]), int(self.blocks[first]))
        base, payloads, starts, counts = 0, [], [], []
        for k in range(first, last):
            at = int(self.blocks[k] - self.blocks[first])
            n, size = BLOCK.unpack_from(data, at)
            points = np.frombuffer(data, "<u4", -(-n // CHECKPOINT), at + BLOCK.size).astype(np.int64)
            payloads.append(np.frombuffer(data, np.uint8, size, at + BLOCK.size + 4 * len(points)))
            runs = np.full(len(points), CHECKPOINT)
            runs[-1] = n - CHECKPOINT * (len(points) - 1)
            cut = skip if k == first else 0
            starts.append(points[cut:] + 8 * base)
            counts.append(runs[cut:])
            base += size
        if not starts:
            return np.zeros(0, np.int64)
        runs = np.concatenate(counts)
        out = self.decoder.run(np.concatenate(payloads), np.concatenate(starts), int(runs.max()))
        return out[np.arange(out.shape[1]) < runs[:, None]]

    def stream(self) -> Iterator[np.ndarray]:
        """All ids of the file, some blocks at a time."""
        for k in range(0, len(self.blocks) - 1, HELD_BLOCKS):
            yield self._decode(k, min(k + HELD_BLOCKS, len(self.blocks) - 1))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (not included, counted over the corpus) of this
        file: only the blocks they lie in are read, from the nearest checkpoint on."""
        start, stop = max(start, self.first) - self.first, min(stop - self.first, int(self.sizes.sum()))
        if start >= stop:
            return np.zeros(0, np.int64)
        first, skip = start // BLOCK_IDS, start % BLOCK_IDS // CHECKPOINT
        found = self._decode(first, -(-stop // BLOCK_IDS), skip)
        at = start - first * BLOCK_IDS - skip * CHECKPOINT
        return found[at:at + stop - start]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(place in the file, start, ids, crc32 of the ids as unsigned 32-bit integers) of each document."""
        ends = np.cumsum(self.sizes)
        doc, crc, done = 0, 0, 0
        for ids in self.stream():
            raw = memoryview(ids.astype("<u4").tobytes())
            upto = done + len(ids)
            while doc < len(ends):
                to = min(int(ends[doc]), upto)
                crc = zlib.crc32(raw[4 * (done - upto + len(ids)):4 * (to - upto + len(ids))], crc)
                done = to
                if to < ends[doc]:
                    break
                yield doc, self.first + int(ends[doc] - self.sizes[doc]), int(self.sizes[doc]), crc
                doc, crc = doc + 1, 0


# Spark ----------------------------------------------------------------------

def pieces_stand_alone(path: str) -> bool:
    """True for a byte-level BPE with the usual pattern and no normalizer: then the
    ids of a text are the ids of its pieces (cut before single spaces) in a row."""
    with open(path, encoding="utf-8") as source:
        made = json.load(source)
    pre = made.get("pre_tokenizer") or {}
    plain = [t for t in made.get("added_tokens", []) if " " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    return (made["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not made.get("normalizer") and not plain)


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of some UTF-8 texts in a row, each of one byte or
    more, that begin at ``starts``.  No token of a byte-level BPE with the usual
    pattern reaches over such a place: before a single space between two other
    characters, between a letter (A-Z, a-z, \u00C0 to \u00FF) and one of ``.,;:!?`` or
    a line break, and after a line break between two other characters."""
    kinds = KINDS[data]
    wide = np.flatnonzero(kinds & WIDE)
    if len(wide):
        padded = np.append(data, np.zeros(2, np.uint8))
        triple = padded[wide].astype(np.int64) << 16 | padded[wide + 1].astype(np.int64) << 8 | padded[wide + 2]
        for space in WIDE_SPACES:
            cut = 24 - 8 * len(space)
            at = wide[triple >> cut == int.from_bytes(space)]
            for k in range(len(space)):
                kinds[at + k] |= WHITE
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1
    kinds[accent[(data[accent] != 0x97) & (data[accent] != 0xB7)]] |= LETTER
    solid = kinds & WHITE == 0
    cut = np.zeros(len(data), bool)
    cut[1:] = (kinds[:-1] & LETTER != 0) & (kinds[1:] & MARK != 0)
    cut[1:-1] |= solid[:-2] & (data[1:-1] == ord(" ")) & solid[2:]
    cut[2:] |= solid[:-2] & (data[1:-1] == ord("\n")) & solid[2:]
    # what is at the edge of a text has no neighbour in the next one: at most a cut less
    cut[starts] = True
    edge = starts[1:]
    cut[edge[edge + 1 < np.append(starts[2:], len(data))] + 1] = False
    cut[edge[edge - 1 > starts[:-1]] - 1] = False
    return np.flatnonzero(cut)


def stands_in_row(piece: str) -> bool:
    """True for a space before something that neither begins nor ends with white space."""
    return len(piece) > 1 and piece[0] == " " and not piece[1].isspace() and not piece[-1].isspace()


class PieceEncoder:
    """Ids of texts from the ids of their pieces, each encoded once by the library
    and remembered by the Python worker.

    ``encode`` gives the ids of some texts; ``widths`` the bytes that an id stands
    for, by which the ids of pieces encoded in a row are told apart."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], widths: np.ndarray, dtype: str):
        self.encode, self.widths, self.dtype = encode, widths, dtype
        self._forget()

    def _forget(self) -> None:
        self.held: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64)  # piece k: ids ends[k] to ends[k + 1]
        self.n = 0

    def _counts(self, pieces: list[bytes], ids: np.ndarray) -> np.ndarray | None:
        """Number of ids of each of some pieces encoded as one text."""
        ends, wanted = np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in pieces])
        at = np.searchsorted(ends, wanted)
        return np.diff(at, prepend=-1) if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[at], wanted) else None

    def _add(self, pieces: list[bytes]) -> None:
        """Encodes and appends new pieces.  Those of a space and a word stand in rows,
        as each begins at a place that ``piece_starts`` cuts at."""
        words, others = [], []
        for p in pieces:
            (words if stands_in_row(p.decode()) else others).append(p)
        rows = [words[k:k + ROW_PIECES] for k in range(0, len(words), ROW_PIECES)]
        names, blobs, counts = [], [], []
        for row, blob in zip(rows, self.encode([b"".join(r).decode() for r in rows]), strict=True):
            n = self._counts(row, np.frombuffer(blob, self.dtype))
            if n is None:
                others.extend(row)
            else:
                names.extend(row), blobs.append(blob), counts.extend(n.tolist())
        for p, blob in zip(others, self.encode([p.decode() for p in others]), strict=True):
            names.append(p), blobs.append(blob), counts.append(len(blob) // self.ids.itemsize)
        at, ends = int(self.ends[self.n]), int(self.ends[self.n]) + np.cumsum(counts)
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) <= self.n + len(ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[at:ends[-1]] = np.frombuffer(b"".join(blobs), self.dtype)
        self.ends[self.n + 1:self.n + 1 + len(ends)] = ends
        self.held.update(zip(names, range(self.n, self.n + len(names)), strict=True))
        self.n += len(names)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Runs without garbage collection: nothing here is cyclic, and the
        collector would visit all remembered strings over and over."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.held) > HELD_PIECES or self.ends[self.n] > HELD_IDS:
            self._forget()
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        joined = b"".join(raw)
        if not joined:
            return [b""] * len(texts)
        data = np.frombuffer(joined, np.uint8)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        starts = piece_starts(data, first)
        offsets = pa.py_buffer(np.append(starts, len(data)))
        named = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(joined)]).dictionary_encode()
        names = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.held.get, names))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            self._add([names[k] for k in new])
            for k in new:
                found[k] = self.held[names[k]]
                if len(names[k]) > PIECE_BYTES:
                    del self.held[names[k]]
        place = np.array(found, np.int64)
        place = place[named.indices.to_numpy()]
        begin, counts = self.ends[place], self.ends[place + 1] - self.ends[place]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends + counts, counts)].tobytes()
        bounds = np.append(0, np.append(0, ends)[np.searchsorted(starts, np.cumsum(sizes))]) * self.ids.itemsize
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_ENCODERS: dict[tuple[str, str], Callable[[list[str]], list[bytes]]] = {}


def text_encoder(path: str, dtype: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids (raw integers of ``dtype``) by the
    tokenizers library; a Python worker keeps it for its next tasks.  Where pieces
    do not stand alone, whole texts are encoded."""
    if (path, dtype) in _ENCODERS:
        return _ENCODERS[path, dtype]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not pieces_stand_alone(path):
        return _ENCODERS.setdefault((path, dtype), whole)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    widths[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one character for each byte
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)  # no piece comes twice
    return _ENCODERS.setdefault((path, dtype), PieceEncoder(whole, widths, dtype))


def stored_ids(spark: SparkSession, docs: DataFrame, path: str, dtype: str) -> DataFrame:
    """``part, before, doc_id, n, ids``: the documents in ascending order of doc_id
    (NULL first; equal ones by text hash), encoded and closed by ``END_ID``.
    ``part`` ascends with the order and ``before`` counts the ids before the
    document in its part.  The order key holds the row, so that no id or text,
    however often repeated, makes one large part."""
    ordered = documents(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash"), "row")
    order = ("doc_id", "hash", "row")
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, before = text_encoder(path, dtype), TaskContext.get().partitionId(), 0
        end, width = np.array([END_ID], dtype).tobytes(), np.dtype(dtype).itemsize
        for batch in small_batches(batches, max_bytes=4 << 20):
            ids = [b + end for b in encode(batch.column("text").to_pylist())]
            sizes = np.array([len(b) // width for b in ids], np.int64)
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(ends - sizes), batch.column("doc_id"), pa.array(sizes), pa.array(ids, pa.binary())],
                names=["part", "before", "doc_id", "n", "ids"])
            before = int(ends[-1])

    return stored(spark, ordered.mapInArrow(run, "part int, before bigint, doc_id bigint, n bigint, ids binary"), "ids", compression="zstd")


def id_counts(ids: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs in the corpus; at most ``size`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in small_batches(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    found = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


def write_corpus(spark: SparkSession, docs: DataFrame, path: str, folder: str | None = None, max_bits: int = MAX_BITS) -> tuple[str, DataFrame]:
    """Encodes every whole text of ``docs`` with the tokenizer file at ``path`` (it
    lies at the same place on every executor) and writes the ids to ``folder`` (a
    fresh shared folder by default).  Returns the folder and its stored list of
    files: ``file, first, ids, docs, bytes``.

    NULL text is empty; a document always has the id ``END_ID`` at its end.  Rows
    with equal or NULL doc_id are documents of their own.  An empty table has a
    code without ids and no file.  Other columns are left behind."""
    ship(spark)
    folder = folder or scratch_path(spark, "token-files")
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), END_ID + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    ids = stored_ids(spark, docs, path, dtype)
    # one row per partition
    totals = ids.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("part").toArrow()
    sums = np.cumsum(totals.column("n").to_numpy())
    offsets = dict(zip(totals.column("part").to_pylist(), (sums - totals.column("n").to_numpy()).tolist(), strict=True))
    lengths = code_lengths(id_counts(ids, size, dtype), max_bits)
    write_code(folder, lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, writer, done = canonical(lengths), None, []
        for batch in small_batches(batches, "ids"):
            for part, before, doc_id, blob in zip(*(batch.column(c) for c in ("part", "before", "doc_id", "ids")), strict=True):
                first = offsets[part.as_py()] + before.as_py()
                if writer and (writer.first + writer.n_ids != first or writer.n_ids >= FILE_IDS or len(writer.docs) >= FILE_DOCS):
                    done.append(writer.close())
                    writer = None
                writer = writer or Writer(folder, first, lengths, codes)
                writer.add(doc_id.as_py(), np.frombuffer(blob.as_buffer(), dtype))
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, schema=LIST)

    return folder, stored(spark, ids.mapInArrow(run, "file string, first bigint, ids bigint, docs bigint, bytes bigint"), "token-file-list")


LIST = pa.schema([("file", pa.string()), ("first", pa.int64()), ("ids", pa.int64()), ("docs", pa.int64()), ("bytes", pa.int64())])


def read_documents(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    ship(spark)
    wanted = files.select("file").repartition(max(1, min(files.count(), READ_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = crc = None
        for batch in batches:
            for name in batch.column("file").to_pylist():
                if decoder is None:
                    lengths = read_code(folder)
                    decoder, crc = Decoder(lengths), zlib.crc32(lengths.tobytes())
                reader, rows = Reader(folder, name, decoder, crc), []
                for row in reader.documents():
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield _rows(reader, rows)
                        rows = []
                yield _rows(reader, rows)

    return wanted.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(reader: Reader, rows: list) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays([reader.doc_ids.take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])
