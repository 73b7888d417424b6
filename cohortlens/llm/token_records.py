"""Token ids as length-delimited binary records (operator 8).

Texts are range-partitioned and sorted by doc_id, encoded, and each partition
is written as one record file and one index file in a folder that all
executors share.  A record is

    uint64  payload length           uint32  masked CRC-32 of these 8 bytes
    payload                          uint32  masked CRC-32 of the payload

(little endian), its payload one flag byte (1: the doc_id is NULL; 2: ids are
4 bytes wide, else 2), the int64 doc_id and the ids with the end id.  The
index holds one int64 triple a record: byte offset, doc_id, number of ids, so
that records can be read in any order.  Files have a fresh name per task
attempt and count only when the manifest lists them: a task that runs again
after a lost executor leaves at most an unlisted file.

Encoding is that of the ``tokenizers`` library.  The tokenizer drops white
space and never joins across it, so texts are cut at ASCII white space, each
distinct piece of a segment is encoded once, and the ids are put together
piece by piece; a worker remembers pieces in flat arrays up to a bound in
bytes.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .words import mix, power_tables

END_ID = 1
#: Bytes of text encoded at once, and bytes of the arrays in which a worker
#: remembers pieces and ids (two generations, so that common pieces stay known).
SEGMENT = 1 << 19
REMEMBERED = 48 << 20
#: Pieces encoded in one call, and what stands between them.
TOGETHER = 1000
MARK = "\u2605"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
MANIFEST = "shard long, file string, index string, records long, tokens long"


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated and offset, so that a checksum of data that holds
    checksums stays sound."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans ``starts[k]:starts[k] + sizes[k]``."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if ends.size else 0)


def _appended(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``store`` with ``more`` at ``used``; it grows by a quarter."""
    if used + more.size > store.size:
        store, old = np.empty(used + more.size + store.size // 4, store.dtype), store
        store[:used] = old[:used]
    store[used:used + more.size] = more
    return store


class Pieces:
    """Pieces and their ids in flat arrays.  A piece is found through an open
    addressing table of hashes and then compared byte by byte; of pieces that
    share a hash only the first is found again."""

    def __init__(self, dtype: np.dtype):
        self.count, self.text_used, self.ids_used = 0, 0, 0
        self.text, self.ids = np.empty(0, np.uint8), np.empty(0, dtype)
        self.hashes = np.empty(0, np.uint64)
        self.at, self.size, self.ids_at, self.ids_size = (np.empty(0, np.uint32) for _ in range(4))
        self.table = np.full(64, -1, np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.text, self.ids, self.hashes, self.at, self.size,
                                      self.ids_at, self.ids_size, self.table))

    def find(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece of ``raw``; -1 where it is not known."""
        out = np.full(hashes.size, -1, np.int64)
        mask = np.uint64(self.table.size - 1)
        left, place = np.arange(hashes.size), (hashes & mask).astype(np.int64)
        while left.size:
            entry = self.table[place]
            some = entry >= 0
            left, place, entry = left[some], place[some], entry[some]
            same = self.hashes[entry] == hashes[left]
            out[left[same]] = entry[same]
            left, place = left[~same], (place[~same] + 1) & int(mask)
        found = np.flatnonzero(out >= 0)
        fits = self.size[out[found]] == sizes[found]
        out[found[~fits]] = -1
        found = found[fits]
        own = raw[_spans(starts[found], sizes[found])]
        differ = own != self.text[_spans(self.at[out[found]].astype(np.int64), sizes[found])]
        if differ.any():
            out[np.repeat(found, sizes[found])[differ]] = -1
        return out

    def add(self, text: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, ids: np.ndarray, ids_sizes: np.ndarray) -> np.ndarray:
        """Remembers pieces, given one after the other in ``text`` and their
        ids in ``ids``, and returns their numbers."""
        n, new = self.count, sizes.size
        for name, more in (("hashes", hashes), ("at", self.text_used + np.cumsum(sizes) - sizes), ("size", sizes),
                           ("ids_at", self.ids_used + np.cumsum(ids_sizes) - ids_sizes), ("ids_size", ids_sizes)):
            setattr(self, name, _appended(getattr(self, name), n, more))
        self.text = _appended(self.text, self.text_used, text)
        self.ids = _appended(self.ids, self.ids_used, ids)
        self.count, self.text_used, self.ids_used = n + new, self.text_used + text.size, self.ids_used + ids.size
        indexed = n + np.unique(hashes, return_index=True)[1]
        if 2 * self.count > self.table.size:
            indexed = np.concatenate((self.table[self.table >= 0], indexed))
            self.table = np.full(1 << (3 * self.count).bit_length(), -1, np.int32)
        self._index(indexed)
        return np.arange(n, n + new)

    def _index(self, entries: np.ndarray) -> None:
        mask = np.uint64(self.table.size - 1)
        place = (self.hashes[entries] & mask).astype(np.int64)
        while entries.size:
            there = self.table[place]
            free = there < 0
            self.table[place[free]] = entries[free]
            there = self.table[place]
            rest = self.hashes[there] != self.hashes[entries]
            entries, place = entries[rest], (place[rest] + 1) & int(mask)


class PieceEncoder:
    """Encodes whole texts by their white-space separated pieces, of which it
    remembers at most ``REMEMBERED`` bytes and those of one segment."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.known, self.before = Pieces(self.dtype), Pieces(self.dtype)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _encode(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of pieces, and the number of each one's ids.  Pieces are
        encoded many at a time, with a mark of one id after each, which costs
        less than a call a piece; where one holds the mark itself, they are
        encoded one by one."""
        end = f" {MARK} ".encode()
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at:at + TOGETHER]
            if self.mark is not None:
                joined = (end.join(some) + end).decode("utf-8")
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
                ends = np.flatnonzero(ids == self.mark)
                if ends.size == len(some) == joined.count(MARK):
                    yield np.delete(ids, ends).astype(self.dtype), np.diff(ends, prepend=-1) - 1
                    continue
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in some], add_special_tokens=False)]
            yield np.array([i for ids in found for i in ids], self.dtype), np.array([len(ids) for ids in found])

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers that distinct pieces of ``raw`` have in ``known``."""
        if 2 * self.known.nbytes > REMEMBERED:
            self.before, self.known = self.known, Pieces(self.dtype)
        known, before = self.known, self.before
        out = known.find(raw, starts, sizes, hashes)
        rest = np.flatnonzero(out < 0)
        old = before.find(raw, starts[rest], sizes[rest], hashes[rest])
        again, old, new = rest[old >= 0], old[old >= 0], rest[old < 0]
        text = raw[_spans(starts[new], sizes[new])]
        data, cuts = text.tobytes(), np.cumsum(sizes[new]).tolist()
        found = list(self._encode([data[a:b] for a, b in zip([0, *cuts], cuts)]))
        if new.size:
            out[new] = known.add(text, sizes[new], hashes[new], *(np.concatenate(x) for x in zip(*found)))
        if again.size:
            many = before.ids_size[old].astype(np.int64)
            ids = before.ids[_spans(before.ids_at[old].astype(np.int64), many)]
            out[again] = known.add(raw[_spans(starts[again], sizes[again])], sizes[again], hashes[again], ids, many)
        return out

    def segment(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, number of ids of each text)`` of the texts that end at
        ``cuts`` in ``raw``."""
        inside = np.zeros(raw.size + 2, np.int8)
        inside[1:-1] = ~_SPACE[raw]
        edges = np.diff(inside)
        begins, ends = edges == 1, edges == -1
        inner = cuts[(cuts > 0) & (cuts < raw.size)]
        inner = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]  # two texts meet without white space
        begins[inner], ends[inner] = True, True
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
        if not starts.size:
            return np.zeros(0, self.dtype), np.zeros(cuts.size, np.int64)
        first, place, hashes = _distinct(raw, starts, stops)
        number = self._numbers(raw, starts[first], (stops - starts)[first], hashes)[place]
        each = self.known.ids_size[number].astype(np.int64)
        out = self.known.ids[_spans(self.known.ids_at[number].astype(np.int64), each)]
        text = np.searchsorted(cuts, starts, side="right")
        return out, np.bincount(text, each, cuts.size).astype(np.int64)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column (NULL: none)."""
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, side="right")) - 1)
            if offsets[j] - offsets[i] <= SEGMENT:
                ids, n = self.segment(raw[offsets[i]:offsets[j]], offsets[i + 1:j + 1] - offsets[i])
                yield from np.split(ids, np.cumsum(n)[:-1])
            else:  # one text longer than a segment: in parts that end before white space
                parts, at, end = [], int(offsets[i]), int(offsets[i + 1])
                while at < end:
                    to = min(end, at + SEGMENT)
                    gaps = np.flatnonzero(_SPACE[raw[at:to]]) if to < end else np.zeros(0)
                    if to < end:
                        if gaps.size and gaps[-1] > 0:
                            to = at + int(gaps[-1])
                        else:
                            rest = np.flatnonzero(_SPACE[raw[to:end]])
                            to = to + int(rest[0]) if rest.size else end
                    parts.append(self.segment(raw[at:to], np.array([to - at]))[0])
                    at = to
                yield np.concatenate(parts)
            i = j


def _distinct(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, place, hashes)``: a piece of each distinct kind, the kind of
    each piece ``raw[starts:stops]`` and the hash of each kind.  Kinds are
    found by the hash and then compared byte by byte; where it fails, the
    pieces themselves decide."""
    power, inverse = power_tables(raw.size)
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * inverse[starts])
    del sums
    kinds, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    same = first[place]
    rest = np.flatnonzero(same != np.arange(starts.size))
    size = (stops - starts)[rest]
    if (size == (stops - starts)[same[rest]]).all():
        within = np.arange(int(size.sum()), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        own = raw[np.repeat(starts[rest].astype(np.int32), size) + within]
        if (own == raw[np.repeat(starts[same[rest]].astype(np.int32), size) + within]).all():
            return first, place, kinds
    data = raw.tobytes()
    known: dict[bytes, int] = {}
    place = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), stops.tolist())])
    first = np.unique(place, return_index=True)[1]
    return first, place, hashes[first]


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str) -> PieceEncoder:
    """The encoder of this Python worker: its tokenizer, and the pieces that
    stay known from task to task."""
    return PieceEncoder(tokenizer_path)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` (``doc_id, text``) under ``path`` and returns the
    manifest: ``shard, file, index, records, tokens``, shards in doc_id order.
    A NULL text has only the end id; repeated rows are written each, in the
    order of their texts; NULL doc_ids come first."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_path)
        store, folder = _filesystem(path)
        name = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}"
        places, offset, tokens, out = [], 0, 0, None
        for batch in batches:
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(name + ".rec")
            end = np.array([end_id], encoder.dtype)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text"))):
                body = np.concatenate((ids, end)).tobytes()
                flags = (doc_id is None) + 2 * encoder.wide
                payload = struct.pack("<Bq", flags, doc_id or 0) + body
                head = struct.pack("<Q", len(payload))
                out.write(b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload)))))
                places.append((offset, doc_id or 0, ids.size + 1))
                offset += len(payload) + 16
                tokens += ids.size + 1
        if out is not None:
            out.close()
            with store.open_output_stream(name + ".idx") as index:
                index.write(np.array(places, "<i8").reshape(-1, 3).tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [os.path.basename(name) + ".rec"],
                                              "index": [os.path.basename(name) + ".idx"],
                                              "records": [len(places)], "tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # one row a shard, kept by the driver: the tasks write no file besides the records
    return docs.sparkSession.createDataFrame(ordered.mapInArrow(write, MANIFEST).collect(), MANIFEST)


def parse_record(data: bytes) -> tuple[int | None, np.ndarray]:
    """The doc_id and ids of a framed record; fails on a bad checksum."""
    head, size = data[:8], struct.unpack_from("<Q", data)[0]
    payload = data[12:12 + size]
    if struct.unpack_from("<I", data, 8)[0] != masked_crc(head) or len(payload) != size \
            or struct.unpack_from("<I", data, 12 + size)[0] != masked_crc(payload):
        raise ValueError("damaged record")
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def _stream(store: fs.FileSystem, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    with store.open_input_stream(name, buffer_size=1 << 20) as data:
        while head := data.read(8):
            yield parse_record(head + data.read(struct.unpack("<Q", head)[0] + 8))


def read_records(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read from the
    files in order; ``start`` counts the ids of all records before it.  Only
    one manifest row a shard comes to the driver."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                rows: list[tuple] = []
                for doc_id, ids in _stream(store, f"{folder}/{name}"):
                    rows.append((doc_id, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += ids.size
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    shards, start = [], 0
    for row in manifest.orderBy("shard").collect():
        shards.append((row["file"], start))
        start += row["tokens"]
    files = spark.createDataFrame(shards, "file string, start long").repartition(max(1, len(shards)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=names)


def read_at(path: str, index: str, places: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of one shard at the given places of its index, in that
    order: what a shuffled reader calls."""
    store, folder = _filesystem(path)
    with store.open_input_file(f"{folder}/{index}") as data:
        offsets = np.frombuffer(data.read(), "<i8").reshape(-1, 3)[:, 0]
    with store.open_input_file(f"{folder}/{index[:-4]}.rec") as data:
        for k in places:
            data.seek(int(offsets[k]))
            head = data.read(8)
            yield parse_record(head + data.read(struct.unpack("<Q", head)[0] + 8))


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the records of ``docs`` to a new folder of the shared one and
    reads them back."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    return read_records(spark, write_records(docs, path, tokenizer_path, end_id), path)
