"""Packing tokenised documents into fixed windows by the sum-of-squares rule.

Each document enters, online, the fill level whose choice leaves the smallest sum of
squared counts of partially filled windows; the counts live in an array indexed by
level.  Documents above the window length first give off full windows.  The rule alone
places documents; none is cut to place it.  A run of the rule ends with its task, or when
as many windows are open as there are levels (documents of which no two share a window
would else pile up): then the open windows are laid end to end and cut at the window
length, and what is left goes on as the next run's first window, or at the task's end into
powers of two.  So a task holds at most window - 1 windows and nothing is padding.  Tasks
pack on their own: there is no shuffle, and sequence ids carry the task's partition, so a
task run again after a lost executor gives the same rows.

Defined results: a null or empty text is only the end id; repeated rows are packed as
rows of their own; a null doc_id stays null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keeping, leave, one_thread, table
from .shingles import _powers, flat, mix64

WINDOW = 4096
END_ID = 2
WORDS_KEPT = 1_000_000
LONG = 64
PART = 1 << 17  # bytes of text encoded together

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# What the word tokenizer's file says of normalisation and words.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER  # U+00C0 to U+023F
_CLASS[range(48, 58)] = DIGIT
_CLASS[[0xC0, 0xC1, 0xC2, *range(0xC9, 0x100)]] = ODD
_NOT_LETTERS = (0x97, 0xB7, 0x1B0)  # two signs among the letters, and one whose lower case is two characters
_BYTE = np.random.default_rng(20250211).integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # the file lower-cases
_LENGTH = np.uint64(0x9FB21C651E98DF25)


class WordTokenizer:
    """The ids of a tokenizer file, each distinct word encoded once.

    The file's words never cross ASCII white space, and neither does its normalisation, so
    a text's ids are its words' ids laid end to end.  Words of ASCII and of Latin letters
    up to U+023F are found here, for all bytes of some texts at once; a stretch between
    white space with any other character is one word to us, and a text that holds a special
    token's string is one as a whole.  The tokenizer itself encodes every distinct word.
    A file with another normalisation or other words encodes whole texts.
    """

    _loaded: dict[str, WordTokenizer] = keeping()

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            leave()
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        one_thread()
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        splits = [r for r in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = (
            (rules.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and len(splits) == 2
            and splits[0].get("pattern") == {"Regex": WORDS}
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and (splits[1]["type"], splits[1]["add_prefix_space"], splits[1]["use_regex"]) == ("ByteLevel", False, False)
        )
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in special)) if special else None
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # of known words, by hash
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _learn(self, words: list[str]) -> int:
        """Keeps the ids of words; the slot of the first, the others follow."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        total, first = int(sizes.sum()), self.known
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while first + len(found) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.lengths[first : first + len(found)] = sizes
        self.starts[first : first + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.known = self.used + total, first + len(found)
        return first

    def _words(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and whether it is to be encoded without being kept."""
        kind = _CLASS[raw]
        odd = kind == ODD
        lead = np.flatnonzero((raw[:-1] == 0xC3) | (raw[:-1] == 0xC4))
        pair = raw[lead + 1] + np.where(raw[lead] == 0xC4, 0x100, 0)
        odd[lead[np.isin(pair, _NOT_LETTERS)]] = True
        inside = kind != SPACE
        edge = np.zeros(len(raw) + 1, bool)  # a text begins here
        edge[ends] = True
        begins = inside & edge[:-1]
        begins[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        # an apostrophe alone before letters may begin a word that ends inside them
        quote = np.flatnonzero((raw[:-1] == 0x27) & begins[:-1] & (kind[1:] == LETTER) & ~edge[1:-1])
        begins[quote + 1] = False
        at = np.flatnonzero(odd)
        if len(at):
            outer = np.ones(len(raw) + 1, bool)  # white space or a text's beginning
            outer[:-1] = ~inside | edge[:-1]
            outer = np.flatnonzero(outer)
            before = outer[np.searchsorted(outer, at, "right") - 1]
            lo = np.where(inside[before], before, before + 1)
            hi = outer[np.searchsorted(outer, at, "right")]
            self._join(begins, lo, hi)
        direct = np.zeros(len(raw), bool)
        if self.special and self.special.search(memoryview(raw)):
            texts = [k for k in range(len(ends) - 1) if self.special.search(memoryview(raw[ends[k] : ends[k + 1]]))]
            lo, hi = ends[:-1][texts], ends[1:][texts]
            self._join(begins, lo, hi)
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                inside[a:b] = True
            direct[lo] = True
        stops = inside & edge[1:]
        stops[:-1] |= inside[:-1] & (~inside[1:] | begins[1:])
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return s, e, direct[s] | (e - s > LONG)

    @staticmethod
    def _join(begins: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Makes each stretch lo to hi one word."""
        depth = np.zeros(len(begins) + 1, np.int32)
        lo, at = np.unique(lo, return_index=True)
        np.add.at(depth, lo, 1)
        np.add.at(depth, hi[at], -1)
        begins[np.cumsum(depth[:-1]) > 0] = False
        begins[lo] = True

    def encode_long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one text, encoded in pieces of about PART bytes that end at white space."""
        out, at = [], 0
        while at < len(raw):
            to = at + PART
            while self.by_word and to < len(raw) and _CLASS[raw[to]] != SPACE:
                to += 1
            to = min(to, len(raw)) if self.by_word else len(raw)
            out.append(self.encode(raw[at:to], np.array([0, to - at]))[0])
            at = to
        return np.concatenate(out)

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as UTF-8 bytes laid end to end, and the texts' limits in them."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        if not self.by_word:
            texts = [raw[a:b].tobytes().decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.cumsum([0, *map(len, found)])
        import pyarrow as pa

        if self.known > WORDS_KEPT:
            self._forget()
        s, e, direct = self._words(raw, ends)
        up, down = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        h = mix64((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64) * _LENGTH)

        def words(k: np.ndarray) -> list[str]:
            data = raw.tobytes()
            return [data[a:b].decode() for a, b in zip(s[k].tolist(), e[k].tolist(), strict=True)]

        coded = pa.array(h).dictionary_encode()
        index, values = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        by_hash = np.argsort(values)
        at = np.searchsorted(self.hashes, values[by_hash])
        near = np.minimum(at, max(len(self.hashes) - 1, 0))
        slot = np.full(len(values), -1, np.int64)
        if len(self.hashes):
            slot[by_hash] = np.where(self.hashes[near] == values[by_hash], self.slots[near], -1)
        once = np.zeros(len(values), np.int64)
        once[index[::-1]] = np.arange(len(index))[::-1]  # a value's first word
        fresh = (slot < 0) & ~direct[once]
        new = np.flatnonzero(fresh)
        if len(new):
            slot[new] = self._learn(words(once[new])) + np.arange(len(new))
            some = fresh[by_hash]
            at, new = at[some], by_hash[some]
            self.hashes, self.slots = np.insert(self.hashes, at, values[new]), np.insert(self.slots, at, slot[new].astype(np.int32))
        slot = slot[index]
        alone = np.flatnonzero(direct)
        if len(alone):
            slot[alone] = self._learn(words(alone)) + np.arange(len(alone))
        n = self.lengths[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.starts[slot] - upto[:-1], n)]
        return ids, upto[np.searchsorted(s, ends)]


class SumOfSquares:
    """Online packing into windows of ``window`` tokens.

    ``add`` and ``flush`` return finished pieces: (document, start, ids, doc_tokens,
    sequence, offset), with ids as an array.
    """

    def __init__(self, window: int = WINDOW, first: int = 0) -> None:
        self.window, self.next = window, first
        self.level = np.zeros(window + 1, np.int64)  # open windows by fill level
        self.held = 0
        self.open: dict[int, list[list]] = {}  # the same windows: level -> lists of pieces

    def choose(self, size: int) -> int:
        """The level to place ``size`` at, 0 for a new window; ties go to the fuller."""
        n, none = self.level, np.iinfo(np.int64).max
        here, there = n[1 : self.window - size + 1], n[1 + size : self.window + 1]
        cost = 2 * (there - here) + 2
        cost[-1:] -= 1  # a window that fills up leaves the array
        cost[here == 0] = none
        if not len(cost):
            return 0
        at = len(cost) - 1 - int(cost[::-1].argmin())
        return at + 1 if cost[at] <= 2 * int(n[size]) + 1 else 0

    def add(self, document, ids: np.ndarray) -> Iterator[tuple]:
        total, start = len(ids), 0
        while total - start >= self.window:
            yield document, start, ids[start : start + self.window], total, self._sequence(), 0
            start += self.window
        if start == total:
            return
        level, pieces = self.choose(total - start), []
        if level:
            self.level[level] -= 1
            self.held -= 1
            pieces = self.open[level].pop()
        pieces.append((document, start, ids[start:], total))
        level += total - start
        if level == self.window:
            yield from self._emit(pieces)
        else:
            self._hold(level, pieces)
            if self.held >= self.window - 1:
                yield from self.flush(last=False)

    def _hold(self, level: int, pieces: list) -> None:
        self.level[level] += 1
        self.held += 1
        self.open.setdefault(level, []).append(pieces)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        """Dissolves the open windows: full ones first, the rest in powers of two, or where
        this is not the ``last`` run as an open window."""
        rest = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        self.open, self.level, self.held = {}, np.zeros(self.window + 1, np.int64), 0
        left = sum(len(p[2]) for p in rest)
        room, pieces = 0, []
        for document, start, ids, total in rest:
            while len(ids):
                if not room:
                    room = self.window if left >= self.window or not last else 1 << (left.bit_length() - 1)
                take = min(room, len(ids))
                pieces.append((document, start, ids[:take], total))
                ids, start, room, left = ids[take:], start + take, room - take, left - take
                if not room:
                    yield from self._emit(pieces)
                    pieces = []
        if pieces:
            self._hold(self.window - room, pieces)

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, pieces: list) -> Iterator[tuple]:
        sequence, offset = self._sequence(), 0
        for document, start, ids, total in pieces:
            yield document, start, ids, total, sequence, offset
            offset += len(ids)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece, as the contract says; ``with_ids`` adds ids (array of int)."""

    def run(batches):
        import pyarrow as pa
        tokenizer = WordTokenizer.get(tokenizer_path)
        packer = SumOfSquares(window)
        rows: list[tuple] = []

        def made():
            cols = list(zip(*rows, strict=True))
            arrays = [
                pa.array(cols[0], pa.int64()),
                pa.array(cols[1], pa.int64()),
                pa.array([len(x) for x in cols[2]], pa.int64()),
                pa.array([zlib.crc32(x) for x in cols[2]], pa.int64()),
                *(pa.array(c, pa.int64()) for c in cols[3:6]),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.cumsum([0, *(len(x) for x in cols[2])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[2]).astype(np.int32))))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            if batch.num_rows:  # the rows' partition, whatever task takes it
                packer.next = max(packer.next, batch.column(2)[0].as_py() << 36)
            raw, ends = flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, "right")) - 1)
                some = raw[ends[at] : ends[to]]
                if len(some) > PART:
                    tokens = tokenizer.encode_long(some)
                    limits = np.array([0, len(tokens)])
                else:
                    tokens, limits = tokenizer.encode(some, ends[at : to + 1] - ends[at])
                for k, doc in enumerate(ids[at:to]):
                    own = np.append(tokens[limits[k] : limits[k + 1]], np.uint32(end_id))
                    rows.extend(packer.add(doc, own))
                if rows:
                    yield made()
                at = to
        rows.extend(packer.flush())
        if rows:
            yield made()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("partition"))
    return rows.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
