"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

1. *Pieces.* A document is its ids and the end id; it is cut into blocks of the full length and a rest. Where the
   tokenizer's normaliser and splitting never look across white space, which its file says, ids come word by word
   through a bounded cache, and new words of plain bytes are split and merged side by side (``merges.py``); any other
   tokenizer reads whole texts.
2. *Histogram.* Pieces are counted by length; there are at most as many lengths as a sequence has tokens, so the
   counts, and all that follows from them on the driver, have a fixed bound whatever the number of documents.
3. *Patterns.* Lengths are placed longest first, each into the packs with the most room, all packs of one pattern at
   once; a pattern keeps its count of packs, and new packs open where none has room.
4. *Ranks.* A pattern's places of one length are a range of ranks among the pieces of that length. A piece's rank is
   its number within its input partition plus the pieces of its length in earlier partitions. Pieces look their ranges
   up; the texts are not shuffled, and a length that a third of all pieces share is as cheap as any.

Most packs are full, as short pieces come last and fill what longer ones leave: at 10,000 documents padding is 0.03 %.

Defined cases: a null or empty text is the end id alone; repeated rows are pieces of their own, and so are rows of null
ids, which stay null; of a very long text a worker holds its ids and some bytes a word; pieces of one length are alike
and rank by partition and order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import merges, scratch, wordhash

LENGTH = 4096
END = 2
#: Bytes of texts that pass between the JVM and a worker at once.
BATCH = 4 << 20
#: Bounds of a worker's cache, which no result rests on: with a chunk's new words, arrays of 2**19 words stay enough.
MOST_WORDS = 420_000
MOST_PARTS = 60_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"
_MADE: dict[str, Encoder] = {}
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: The normaliser and the splitting of a file that never looks across white space.
_SPLITTING = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Words of these signs are split here just as the tokenizer's own expression splits them, after its lower-casing.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_LETTER, _DIGIT, _SIGN, _ODD = range(4)


def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Each byte's kind and lower case, by itself and behind 0xC3, which starts the letters of Latin-1. Words of odd
    bytes, and of apostrophes, whose meaning hangs on what stands around them, are not split by bytes."""
    kind, low = np.full((2, 256), _ODD, np.uint8), np.tile(np.arange(256, dtype=np.uint8), (2, 1))
    kind[0, 0x21:0x7F] = _SIGN
    kind[0, ord("0") : ord("9") + 1] = _DIGIT
    for letters in (slice(ord("a"), ord("z") + 1), slice(ord("A"), ord("Z") + 1), 0xC3):
        kind[0, letters] = _LETTER
    kind[0, ord("'")] = _ODD
    kind[1, 0x80:0xC0] = _LETTER
    kind[1, [0x97, 0xB7]] = _ODD  # × and ÷
    low[0, ord("A") : ord("Z") + 1] += 32
    low[1, 0x80:0x9F] += 32
    return kind, low


_KIND, _LOW = _bytes()


class Table:
    """Numbers of 64-bit keys, in open addressing; keys are not 0."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0

    def _step(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.keys) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The keys' numbers, or -1."""
        at = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.numbers[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] != 0))
        while len(open_):
            at[open_] = self._step(at[open_])
            own = self.keys[at[open_]]
            hit = own == h[open_]
            out[open_[hit]] = self.numbers[at[open_[hit]]]
            open_ = open_[~hit & (own != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Give distinct new keys the next numbers, in their order."""
        numbers = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        if 2 * self.size > len(self.keys):
            old = self.keys != 0
            h, numbers = np.concatenate([self.keys[old], h]), np.concatenate([self.numbers[old], numbers])
            size = 1 << (2 * self.size).bit_length()
            self.keys, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        at = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[at[todo]] == 0
            self.keys[at[todo[free]]] = h[todo[free]]
            won = self.keys[at[todo]] == h[todo]
            self.numbers[at[todo[won]]] = numbers[todo[won]]
            todo = todo[~won]
            at[todo] = self._step(at[todo])


class Encoder:
    """Ids of texts. Where the file splits as ``_SPLITTING`` says, words are looked up in a cache by hash, and then
    compared: by their length and first and last eight bytes, which is all of most words, and a longer one whole. New
    words of plain bytes get their ids from the file's merges, others from the tokenizer itself. Any other tokenizer gets
    whole texts. A word's ids are ``flat[first[number] : first[number + 1]]``."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        own = made.get("normalizer"), made.get("pre_tokenizer")
        plain = all(re.fullmatch(r"<\|[a-z]+\|>", t["content"]) for t in made.get("added_tokens") or [])
        self.by_word = own == _SPLITTING and plain and not made.get("truncation") and not made.get("padding")
        self.merges = merges.Merges.of(made["model"]) if self.by_word else None
        del made
        self.table, self.parts = Table(), {}
        most = self.merges.none - 1 if self.merges else max(self.tokenizer.get_vocab().values(), default=0)
        self.kind = np.uint16 if most < 1 << 16 else np.uint32
        self._forget()

    @cached_property
    def tokenizer(self):
        """Read when a text first needs it: beside the merges, few words do."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.table.clear()
        self.flat, self.first, self.used = np.empty(1 << 16, self.kind), np.zeros(1 << 15, np.int64), 0
        self.looks = tuple(np.zeros(1 << 15, np.uint64) for _ in range(3))  # size, first and last eight bytes
        self.long: dict[int, bytes] = {}

    def _split(self, word: bytes) -> list[str]:
        """Parts that the tokenizer splits a word of plain letters, digits and signs into; any other word whole."""
        text = word.decode()
        return _PARTS.findall(text.lower()) if _PLAIN.fullmatch(text) and "<|" not in text else [text]

    def _ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Each word's ids. Words of plain bytes are split and merged here, all at once."""
        if not self.merges:
            return self._by_tokenizer(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        behind = np.zeros(len(data), np.intp)
        behind[1:] = data[:-1] == 0xC3
        kind, low = _KIND[behind, data], _LOW[behind, data]
        bad = kind == _ODD
        bad[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        odd = np.logical_or.reduceat(bad, np.cumsum(size) - size) | (size > merges.LONGEST)
        if odd.any():
            keep = np.repeat(~odd, size)
            kind, low, size = kind[keep], low[keep], np.where(odd, 0, size)
        ends = np.cumsum(size)
        begins = kind == _DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins[(ends - size)[~odd]] = True
        begins = np.flatnonzero(begins)
        ids, count = self.merges.ids(low, np.append(begins, len(low)))
        upto = np.append(0, np.cumsum(count))[np.searchsorted(begins, np.append(0, ends))]
        out = [ids[a:b] for a, b in pairwise(upto.tolist())]
        odd = np.flatnonzero(odd)
        for i, own in zip(odd, self._by_tokenizer([words[i] for i in odd]), strict=True):
            out[i] = own
        return out

    def _by_tokenizer(self, words: list[bytes]) -> list[np.ndarray]:
        split = [self._split(w) for w in words]
        if len(self.parts) > MOST_PARTS:
            self.parts.clear()
        known = self.parts
        fresh = list({p for parts in split for p in parts if p not in known})
        for a in range(0, len(fresh), 4096):
            found = self.tokenizer.encode_batch_fast(fresh[a : a + 4096], add_special_tokens=False)
            known.update(zip(fresh[a : a + 4096], (tuple(e.ids) for e in found), strict=True))
        return [np.array([i for p in parts for i in known[p]], np.uint32) for parts in split]

    def _learn(self, words: list[bytes], looks: tuple[np.ndarray, ...]) -> None:
        own = self._ids(words)
        counts = np.fromiter(map(len, own), np.int64, len(own))
        ids = np.concatenate(own)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), self.kind)])
        n = self.table.size
        if n + len(own) + 1 > len(self.first):
            more = max(len(self.first), len(own) + 1)
            self.first = np.concatenate([self.first, np.zeros(more, np.int64)])
            self.looks = tuple(np.concatenate([x, np.zeros(more, np.uint64)]) for x in self.looks)
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n + 1 : n + len(own) + 1] = self.used + np.cumsum(counts)
        for kept, x in zip(self.looks, looks, strict=True):
            kept[n : n + len(own)] = x
        self.long.update((n + i, w) for i, w in enumerate(words) if len(w) > 16)
        self.used += len(ids)

    def _slice(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words between these positions, and how many each has."""
        if self.table.size > MOST_WORDS:
            self._forget()
        first = int(starts[0])
        raw = data[first : ends[-1]].tobytes() + bytes(8)
        at, size = starts - first, ends - starts
        eights = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw, strides=(1,))
        last = np.zeros(len(h), np.uint64)
        longer = np.flatnonzero(size > 8)
        last[longer] = eights[(at + size - 8)[longer]]
        looks = size.astype(np.uint64), eights[at] & _MASKS[np.minimum(size, 8)], last
        number = self.table.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            keys, where = np.unique(h[new], return_index=True)
            new_at = new[where]
            self._learn([raw[at[i] : at[i] + size[i]] for i in new_at], tuple(x[new_at] for x in looks))
            self.table.add(keys)
            number[new] = self.table.find(h[new])
        other = np.zeros(len(h), bool)
        for kept, x in zip(self.looks, looks, strict=True):
            other |= kept[number] != x
        for i in longer[size[longer] > 16]:
            other[i] |= self.long.get(int(number[i])) != raw[at[i] : at[i] + size[i]]
        begin = self.first[number]
        count = self.first[number + 1] - begin
        if not other.any():
            upto = np.cumsum(count) - count
            return self.flat[np.repeat(begin - upto, count) + np.arange(count.sum())], count
        ids = [self.flat[b : b + n] for b, n in zip(begin, count, strict=True)]  # two words of one hash
        for i in np.flatnonzero(other):
            ids[i] = self._ids([raw[at[i] : at[i] + size[i]]])[0]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Each text's row and its ids with the end id."""
        end = np.array([END], "<u4")
        if not self.by_word:
            for a in range(0, len(texts), 256):
                found = self.tokenizer.encode_batch_fast([t or "" for t in texts[a : a + 256].to_pylist()], add_special_tokens=False)
                for i, e in enumerate(found, a):
                    yield i, np.append(np.array(e.ids, "<u4"), end)
            return
        for a, b, data, offsets in wordhash.chunks(texts):
            h, first, starts, ends = wordhash.words(data, offsets, lower=False)
            h = np.maximum(h, np.uint64(1))
            step = wordhash.SLICE
            parts = [self._slice(data, h[w : w + step], starts[w : w + step], ends[w : w + step]) for w in range(0, len(h), step)]
            ids, count = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint32) for k in (0, 1))
            upto = np.zeros(len(h) + 1, np.int64)
            np.cumsum(count, out=upto[1:])
            for i in range(b - a):
                yield a + i, np.append(ids[upto[first[i]] : upto[first[i + 1]]], end).astype("<u4", copy=False)


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


def cuts(tokens: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces."""
    return [(s, min(length, tokens - s)) for s in range(0, tokens, length)]


def _pieces(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        part = TaskContext.get().partitionId()
        count = np.zeros(length + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            out = []
            for i, ids in own.encode(batch.column(1)):
                for s, n in cuts(len(ids), length):
                    out.append((doc_ids[i], s, n, zlib.crc32(ids[s : s + n]), len(ids), part, int(count[n])))
                    count[n] += 1
            names, kinds = [x.split()[0] for x in _PIECES.split(", ")], [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            del batch  # before the next one is read
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names)

    return run


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns, each a row of lengths, and the number of packs of each. Longest first; into the packs with most room."""
    rooms: list[tuple[int, int]] = []  # (-room, number of the pattern)
    patterns: list[list] = []  # room, packs, last link of the row of lengths

    def put(room: int, packs: int, row) -> None:
        patterns.append([room, packs, row])
        heapq.heappush(rooms, (-room, len(patterns) - 1))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            if rooms and -rooms[0][0] >= size:
                room, packs, row = patterns[heapq.heappop(rooms)[1]]
                filled = min(packs, left)
                if packs > filled:
                    put(room, packs - filled, row)
                put(room - size, filled, (row, size))
                left -= filled
                continue
            each = length // size  # what fits into new packs, opened one after the other
            row = None
            for n in range(1, each + 1):
                row = (row, size)
                if n == left % each and left < each:
                    put(length - n * size, 1, row)
            if left >= each:
                put(length - each * size, left // each, row)
                left -= left // each * each
            else:
                left = 0
    out: dict[tuple[int, ...], int] = {}
    for _, i in rooms:
        _, packs, row = patterns[i]
        sizes = []
        while row:
            row, size = row
            sizes.append(size)
        key = tuple(reversed(sizes))
        out[key] = out.get(key, 0) + packs
    return sorted(out.items(), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of places, sorted by length and first rank: length, rank (the range's first), sequence (that of this
    rank; the next rank has the next sequence) and offset."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for sizes, packs in patterns:
        offset = 0
        for size in sizes:
            rank = next_rank.get(size, 0)
            rows.append((size, rank, sequence, offset))
            next_rank[size] = rank + packs
            offset += size
        sequence += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = (t["length"] << 48) + t["rank"]
        for batch in batches:
            size, rank = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (size << 48) + rank, "right") - 1
            columns = [batch.column(i) for i in range(5)] + [pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``tokenizer`` is the path of
    a tokenizers file that every executor can read."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with scratch.batches(docs.sparkSession, BATCH):
        pieces = scratch.table(rows.mapInArrow(_pieces(tokenizer, length), _PIECES), "pieces")
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    parts = parts.withColumn("before", before).drop("n")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(pack_histogram(counts, length)))
    ranked = pieces.join(parts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # No more files than the pieces have: a join over many shuffle partitions would make each a task, a file and the
    # processes that Hadoop's local file system forks for it.
    ranked = ranked.select(*columns, "rank").coalesce(max(1, pieces.rdd.getNumPartitions()))
    return ranked.mapInArrow(_place(shared), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
