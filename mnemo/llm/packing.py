"""Packing by power-of-two decomposition.

Each document's token ids, with an end id, are cut into pieces whose lengths are powers of two: as many of the longest
as fit, then the binary digits of the rest, longest first. A piece is a sequence of its own, so no sequence crosses
documents and none needs padding; training batches draw from one bucket (one length) at a time.

Token ids come from the tokenizer's own model. Splitting text into the units that its rules never cross is done on
whole batches of bytes, so that each distinct unit is encoded once per worker and looked up afterwards: by a hash, and
then byte by byte, so that two units of one hash never get each other's ids.

Defined cases: a null or empty text is one piece, the end id alone; a null doc_id stays null; repeated rows are packed
once each; very long texts are cut into many pieces of the longest length; an empty table gives no rows; other columns
of the input are not read. Nothing is shuffled: the work is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch, tokens

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Distinct units that a worker remembers before it begins anew.
CACHE_UNITS = 1_000_000
#: Bytes of text encoded at a time.
SLICE = 1 << 20

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
for _b in range(0x21, 0x7F):
    _CLASS[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _OTHER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[ord("'"), ord("<")]] = _ODD  # contractions and special tokens: left to the tokenizer


class UnitEncoder:
    """Ids of texts by a lower-casing word BPE file, for whole batches.

    A unit is a run of letters, one digit or a run of other signs, within a word of ASCII and Latin-1 letters; any
    other word (apostrophes, special tokens, other scripts) is one unit and goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.clear()

    def clear(self) -> None:
        self.reserve(1 << 18)
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)
        self.raw, self.at, self.odd = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)

    def reserve(self, cells: int) -> None:
        self.mask = np.uint64(cells - 1)
        self.keys = np.zeros(cells, np.uint64)
        self.slots = np.zeros(cells, np.int64)

    def encode_unit(self, raw: bytes, odd: bool) -> list[int]:
        if odd:
            return self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids
        return [x.id for x in self.model.tokenize(raw.decode("latin1").translate(self.letters))]

    def units(self, data: np.ndarray, offs: np.ndarray):
        """Bytes (folded but in odd units), start, end and oddness of each unit, and the units' first index for each text."""
        n = len(data)
        b = tokens.FOLD[data]
        cls = _CLASS[data]
        latin = np.zeros(n, bool)  # second bytes of Latin-1 letters
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cls[latin] = _LETTER
        cls[:-1][latin[1:]] = _LETTER
        upper = latin & (data < 0x9F)
        b[upper] += 0x20
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        inside = cls != _SPACE
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        word_start = inside & (~before | edge[:n])
        at = np.flatnonzero(word_start)
        if not len(at):
            return b, at, at, np.zeros(0, bool), np.zeros(len(offs), np.int64)
        word_of = np.cumsum(word_start) - 1
        odd_word = np.zeros(len(at), bool)
        odd_word[word_of[np.flatnonzero(cls == _ODD)]] = True
        b = np.where(odd_word[np.maximum(word_of, 0)], data, b)  # as written: case and script are the tokenizer's business
        changed = np.zeros(n, bool)
        changed[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT)
        start = np.flatnonzero(word_start | (inside & changed & ~odd_word[np.maximum(word_of, 0)]))
        gap = ~inside | edge[:n]
        stops = np.append(np.flatnonzero(gap), n)
        end = np.minimum(np.append(start[1:], n), stops[np.searchsorted(stops, start, "right")])
        return b, start, end, odd_word[word_of[start]], np.searchsorted(start, offs)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[offs[i]:offs[i+1]], and where each text's begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        b, start, end, odd, first = self.units(data, offs)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        keys = tokens.runs_hash(b, start, end) ^ np.where(odd, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        slot = self.lookup(keys, b, start, end, odd)
        sizes = self.begin[slot + 1] - self.begin[slot]
        at = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(at[-1]) - np.repeat(at[:-1] - self.begin[slot], sizes)
        return self.ids[take], at[first]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if it is new: linear probing, all keys at a time."""
        pos = (keys & self.mask).astype(np.int64)
        held = self.keys[pos]
        slot = np.where(held == keys, self.slots[pos], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            pos[left] = (pos[left] + 1) & int(self.mask)
            held = self.keys[pos[left]]
            slot[left] = np.where(held == keys[left], self.slots[pos[left]], -1)
            left = left[(held != keys[left]) & (held != 0)]
        return slot

    def insert(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Put distinct new keys into free cells."""
        pos = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[pos[left]] == 0
            at, one = np.unique(pos[left[free]], return_index=True)
            put = left[free][one]
            self.keys[at], self.slots[at] = keys[put], slots[put]
            left = left[self.keys[pos[left]] != keys[left]]
            pos[left] = (pos[left] + 1) & int(self.mask)

    def add(self, b: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Encode units and remember them; their slots."""
        raw = [b[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        found = [self.encode_unit(r, o) for r, o in zip(raw, odd.tolist(), strict=True)]
        slots = np.arange(len(found)) + len(self.begin) - 1
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array([x for ids in found for x in ids], np.uint32)])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(raw), np.uint8)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(end - start)])
        self.odd = np.concatenate([self.odd, odd])
        return slots

    def same(self, slot: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Which units are, byte by byte, those of their slots."""
        size, held = end - start, self.at[slot]
        ok = (size == self.at[slot + 1] - held) & (odd == self.odd[slot])
        at, here, there = np.flatnonzero(ok), tokens.eights(b), tokens.eights(self.raw)
        for k in range(0, tokens.LONG, 8):
            at = at[size[at] > k]
            if not len(at):
                break
            keep = tokens.KEEP[np.minimum(size[at] - k, 8)]
            ok[at] = (here[start[at] + k] & keep) == (there[held[at] + k] & keep)
            at = at[ok[at]]
        for i in at[size[at] > tokens.LONG].tolist():
            ok[i] = np.array_equal(b[start[i] : end[i]], self.raw[held[i] : held[i] + size[i]])
        return ok

    def lookup(self, keys: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> np.ndarray:
        keys = np.maximum(keys, np.uint64(1))
        slot = self.find(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self.begin) > CACHE_UNITS:
                self.clear()
                new = np.arange(len(keys))
            uniq, where = np.unique(keys[new], return_index=True)
            one = new[where]
            slots = self.add(b, start[one], end[one], odd[one])
            while 2 * len(self.begin) > len(self.keys):
                full = self.keys != 0
                old = self.keys[full], self.slots[full]
                self.reserve(4 * len(self.keys))
                self.insert(*old)
            self.insert(uniq, slots)
            slot[new] = self.find(keys[new])
        other = np.flatnonzero(~self.same(slot, b, start, end, odd))
        if len(other):  # their hash is another unit's: encoded here, found by nobody else
            slot[other] = self.add(b, start[other], end[other], odd[other])
        return slot


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as powers of two: the longest as often as it fits, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def decompose(batches: Iterator[pa.RecordBatch], path: str, longest: int, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        data, offs = tokens.text_arrays(batch.column("text"))
        doc_ids = batch.column("doc_id")
        for i, j in tokens.slices(offs, SLICE):
            ids, at = enc.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            ids = np.insert(ids, at[1:], end_id)  # after each text's last id
            counts = np.diff(at) + 1
            pieces = [piece_lengths(n, longest) for n in counts.tolist()]
            per_doc = np.fromiter(map(len, pieces), np.int64, len(pieces))
            length = np.array([x for p in pieces for x in p], np.int64)
            stop = np.cumsum(length)
            begin = stop - length
            start = begin - np.repeat(np.cumsum(counts) - counts, per_doc)
            offsets = (np.concatenate([[0], stop]) * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), per_doc))),
                    pa.array(start),
                    pa.array(length),
                    pa.Array.from_buffers(
                        pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4").tobytes())]
                    ),
                    pa.array(np.repeat(counts, per_doc)),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )
        del batch, data, offs, doc_ids
        tokens.release()


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids (little-endian uint32), doc_tokens, bucket, sequence_id, offset.

    sequence_id numbers the pieces, each of which is a sequence; bucket is the base-2 logarithm of its length.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    scratch.ship_code(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: decompose(batches, tokenizer_path, longest, end_id), SCHEMA
    )
    return pieces.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet, one folder for each length: what a length-homogeneous data loader reads."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
