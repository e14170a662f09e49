"""Cross-tokenizer alignment by byte-owner arrays.

1. A text with a space before it is encoded by A (a byte-level ``tokenizer.json``) and, without
   that space, by B (a piece model that adds it).  Each token is repeated over its bytes
   (``np.repeat`` of token indices): two arrays say which A and which B token owns a byte.
   Where both owners change at once is a cut, which parts the tokens into groups; consecutive
   distinct owner pairs are the overlaps; the two tokens that end at a cut are linked.
2. Both files part a text before a space that follows anything but white space, so texts are
   taken apart there, and each distinct unit is encoded and aligned once for as long as a
   task keeps it.  A unit that a tokenizer does not give back byte for byte is looked at with its
   whole text again.
3. The links of the corpus are counted by id pair (combined before the shuffle).  The counts,
   which the two vocabularies bound and not the corpus, meet the texts' links in blocks of PAIRS
   pairs that are broadcast; more than one block are as many passes over the links.

Defined results: a null or empty text, and one that either tokenizer does not give back, has
no tokens: zeros, an empty digest, and no part in the counts; the strings of special tokens
are plain text; rows that share a doc_id and repeated rows are texts of their own and all
count; a null doc_id stays null; an empty table gives no rows; further columns are ignored.
A stretch without any such space is encoded at once, whatever its length.
"""

from __future__ import annotations

import hashlib
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, one_thread, saved, table
from .shingles import _powers, flat, mix64

PART = 1 << 17  # bytes of text taken together
UNITS_KEPT = 200_000
BYTES_KEPT = 64 << 20
LONG = 64  # bytes of a unit that is not kept
PAIRS = 1 << 22  # of 17 bytes each, broadcast together

_BYTE = np.random.default_rng(20250711).integers(0, 2**64, 256, np.uint64)
_LENGTH = np.uint64(0xA24BAED4963EE407)
#: Last bytes of characters that are surely no white space.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0x80, 0xC0)]] = True
_SOLID[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False  # ends of the others in UTF-8


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of ranges of these sizes, laid end to end."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def limits_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Ragged:
    """Rows of numbers that are appended, and gathered by row."""

    def __init__(self, kind: type) -> None:
        self.flat, self.used = np.zeros(1 << 12, kind), 0
        self.starts, self.sizes, self.rows = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def clear(self) -> None:
        """Drops the rows; the memory is kept for the next ones, but for that of very long rows."""
        if self.flat.nbytes > BYTES_KEPT:
            self.flat = np.zeros(1 << 12, self.flat.dtype)
        self.used = self.rows = 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(values)] = values
        here = slice(self.rows, self.rows + len(sizes))
        self.sizes[here] = sizes
        self.starts[here] = self.used + np.cumsum(sizes) - sizes
        self.used, self.rows = self.used + len(values), self.rows + len(sizes)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' numbers end to end, and their limits."""
        sizes = self.sizes[rows]
        return self.flat[ranges(self.starts[rows], sizes)], limits_of(sizes)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level files write bytes: themselves where they can be seen,
    else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """The bytes of every token."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.start[ids], self.size[ids])]


class Groups:
    """Tokens of units whose bytes both tokenizers give back, with their cuts and overlaps."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_bytes: np.ndarray, b_bytes: np.ndarray) -> None:
        owner_a, owner_b = np.repeat(np.arange(len(a)), a_bytes), np.repeat(np.arange(len(b)), b_bytes)
        turn_a, turn_b = np.ones(len(owner_a), bool), np.ones(len(owner_b), bool)  # does a token end here?
        turn_a[:-1], turn_b[:-1] = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        cut, over = np.flatnonzero(turn_a & turn_b), np.flatnonzero(turn_a | turn_b)
        self.cut_a, self.cut_b = owner_a[cut], owner_b[cut]  # the linked tokens; groups end with them
        self.over_a, self.over_b = owner_a[over], owner_b[over]


class Aligner:
    """Units to tokens, groups and links; each distinct unit is done once."""

    _loaded: dict[tuple[str, str, bool], Aligner] = {}

    @classmethod
    def get(cls, a: str, b: str, full: bool = True) -> Aligner:
        if (a, b, full) not in cls._loaded:
            cls._loaded[a, b, full] = cls(a, b, full)
        return cls._loaded[a, b, full]

    @classmethod
    def leave(cls) -> None:
        """Frees what this process keeps, for stages that follow in it."""
        cls._loaded.clear()

    def __init__(self, a: str, b: str, full: bool = True) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        one_thread()
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.in_a = Vocabulary([bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.in_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # may a text be taken apart before a space?
        self.by_unit = not any("▁" in p.lstrip("▁") for p in pieces) and self._parts_words()
        self.full = full  # are cuts and overlaps kept?
        self.ids_a, self.ids_b, self.cut_a, self.cut_b, self.over_a, self.over_b = (Ragged(np.int32) for _ in range(6))
        self.link = Ragged(np.int64)
        self.text = Ragged(np.uint8)  # a unit's groups, written out, with a semicolon behind
        self._forget()

    def _parts_words(self) -> bool:
        import json

        rules = json.loads(self.a.to_str())
        pre = rules.get("pre_tokenizer") or {}
        return rules.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        for held in (self.ids_a, self.ids_b, self.cut_a, self.cut_b, self.over_a, self.over_b, self.link, self.text):
            held.clear()
        self.good = np.zeros(1 << 10, bool)

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both tokenizers' ids of units (which follow a space), and the units' limits in them."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        out = []
        for ids in (a, b):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            out += [np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), limits_of(sizes)]
        return tuple(out)

    def _given_back(self, a, at_a, b, at_b, raw, at) -> np.ndarray:
        """Of each unit: are its bytes (``raw`` between the limits ``at``) those of its tokens?"""
        sizes = np.diff(at)
        same = np.ones(len(sizes), bool)
        for vocabulary, ids, ends in ((self.in_a, a, at_a), (self.in_b, b, at_b)):
            own = np.diff(limits_of(vocabulary.size[ids])[ends])
            same &= own == sizes
        for vocabulary, ids, ends in ((self.in_a, a, at_a), (self.in_b, b, at_b)):
            some = np.repeat(same, np.diff(ends))
            there = np.repeat(same, sizes)
            wrong = np.flatnonzero(vocabulary.joined(ids[some]) != raw[there])
            if len(wrong):
                unit = np.repeat(np.flatnonzero(same), sizes[same])
                same[np.unique(unit[wrong])] = False
        return same

    def _learn(self, units: list[bytes]) -> int:
        """Encodes and aligns units; the slot of the first, the others follow."""
        first = self.ids_a.rows
        a, at_a, b, at_b = self._encoded([u.decode() for u in units])
        raw = np.frombuffer(b"".join(chain.from_iterable(zip(repeat(b" "), units))), np.uint8)
        at = limits_of(np.fromiter((len(u) + 1 for u in units), np.int64, len(units)))
        good = self._given_back(a, at_a, b, at_b, raw, at)
        self.ids_a.extend(a, np.diff(at_a))
        self.ids_b.extend(b, np.diff(at_b))
        in_a, in_b = np.repeat(good, np.diff(at_a)), np.repeat(good, np.diff(at_b))
        a, b = a[in_a], b[in_b]
        at_a, at_b = limits_of(np.diff(at_a) * good), limits_of(np.diff(at_b) * good)
        g = Groups(a, b, self.in_a.size[a], self.in_b.size[b])
        for held, values, ends in ((self.cut_a, g.cut_a, at_a), (self.cut_b, g.cut_b, at_b), (self.over_a, g.over_a, at_a), (self.over_b, g.over_b, at_b)) if self.full else ():
            where = np.searchsorted(values, ends)
            held.extend(values - np.repeat(ends[:-1], np.diff(where)), np.diff(where))
        cuts = np.searchsorted(g.cut_a, at_a)
        self.link.extend((a[g.cut_a].astype(np.int64) << 32) | b[g.cut_b], np.diff(cuts))
        groups = written(a, b, g.cut_a, g.cut_b, cuts)
        self.text.extend(np.frombuffer(b"".join(chain.from_iterable(zip(groups, repeat(b";")))), np.uint8), np.fromiter((len(x) + 1 for x in groups), np.int64, len(groups)))
        while first + len(units) > len(self.good):
            self.good = np.concatenate([self.good, np.zeros_like(self.good)])
        self.good[first : first + len(units)] = good
        return first

    def units(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each unit of texts laid end to end, and the texts' limits in them.

        A unit follows a space, the text's own or the one before the text."""
        begin, end = (x[np.diff(ends) > 0] for x in (ends[:-1], ends[1:]))
        starts = np.zeros(len(raw), bool)
        if self.by_unit:
            starts[1:] = (raw[1:] == 0x20) & _SOLID[raw[:-1]]
            starts[begin] = starts[end - 1] = False
        spaces = np.flatnonzero(starts)
        s, e = np.sort(np.concatenate([begin, spaces + 1])), np.sort(np.concatenate([spaces, end]))
        return s, e, np.searchsorted(s, ends)

    def slots(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The slot of each unit."""
        data = raw.tobytes()
        if len(raw) > 2 * PART:  # a piece without spaces
            return self._learn([data[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]) + np.arange(len(s))
        up, down = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        h = mix64((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64) * _LENGTH)
        found = np.zeros(len(s), np.int64)
        short = e - s <= LONG
        at = np.flatnonzero(short)
        values, once, of = np.unique(h[at], return_index=True, return_inverse=True)
        known = np.fromiter(map(self.slot.get, values.tolist(), repeat(-1)), np.int64, len(values))
        new = np.flatnonzero(known < 0)
        if len(new):
            k = at[once[new]]
            known[new] = self._learn([data[x:y] for x, y in zip(s[k].tolist(), e[k].tolist(), strict=True)]) + np.arange(len(new))
            self.slot.update(zip(values[new].tolist(), known[new].tolist(), strict=True))
        found[at] = known[of]
        at = np.flatnonzero(~short)
        if len(at):
            found[at] = self._learn([data[x:y] for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)]) + np.arange(len(at))
        return found

    def rest(self) -> None:
        """Between texts: drops what is kept once it is too much."""
        if self.ids_a.rows > UNITS_KEPT or 8 * (self.link.used + self.ids_a.used + self.ids_b.used) + self.text.used > BYTES_KEPT:
            self._forget()


def written(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Each unit's groups as ``a1,a2|b1;a3|b2,b3``; cuts: the units' limits among the cuts."""
    a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups, i, j = [], 0, 0
    for x, y in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
        groups.append(f"{a[i] if x == i else ','.join(a[i : x + 1])}|{b[j] if y == j else ','.join(b[j : y + 1])}")
        i, j = x + 1, y + 1
    cuts = cuts.tolist()
    return [";".join(groups[x:y]).encode() for x, y in zip(cuts, cuts[1:], strict=False)]


def pieces(aligner: Aligner, raw: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of pieces of about PART bytes of one text, parted by a space between units."""
    out, at = [], 0
    while len(raw) - at > PART:
        to = at + PART
        while to < len(raw) and not (aligner.by_unit and to + 1 < len(raw) and raw[to] == 0x20 and _SOLID[raw[to - 1]]):
            to += 1
        out.append((at, to))
        at = to + 1
    return [*out, (at, len(raw))] if at < len(raw) else out


FULL = ("a_ids", "b_ids", "cut_a", "cut_b", "over_a", "over_b")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"
FULL_SCHEMA = SCHEMA + "".join(f", {k} array<int>" for k in FULL)


NOTHING = {"n_a": 0, "n_b": 0, "n_groups": 0, "digest": "", "links": np.zeros(0, np.int64)} | {k: np.zeros(0, np.int32) for k in FULL}


def texts(aligner: Aligner, raw: np.ndarray, ends: np.ndarray, full: bool) -> list[dict]:
    """What ``aligned`` returns of each of some texts laid end to end; one above PART bytes
    comes alone."""
    long = len(raw) > PART
    cuts = pieces(aligner, raw) if long else list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    slots, per = [], []
    for group in [[c] for c in cuts] if long else [cuts]:
        lo, hi = group[0][0], group[-1][1]
        s, e, at = aligner.units(raw[lo:hi], np.array([group[0][0], *(c[1] for c in group)]) - lo)
        slots.append(aligner.slots(raw[lo:hi], s, e))
        per += np.diff(at).tolist()
    slots = np.concatenate(slots)
    at = np.array([0, len(slots)]) if long else limits_of(np.array(per, np.int64))
    odd = np.diff(limits_of(~aligner.good[slots])[at]) > 0
    fine = (np.diff(at) > 0) & ~odd
    links, link_ends = aligner.link.gather(slots)
    groups, group_ends = aligner.text.gather(slots)
    groups = memoryview(groups)
    held = {"n_a": limits_of(aligner.ids_a.sizes[slots]), "n_b": limits_of(aligner.ids_b.sizes[slots]), "n_groups": limits_of(aligner.link.sizes[slots])}  # a link each
    arrays = {}
    if full:
        for k, ragged in zip(FULL, (aligner.ids_a, aligner.ids_b, aligner.cut_a, aligner.cut_b, aligner.over_a, aligner.over_b), strict=True):
            values, limits = ragged.gather(slots)
            if not k.endswith("ids"):  # indices into the text's ids instead of the unit's
                tokens = held["n_" + k[-1]]
                values = values + np.repeat(tokens[:-1] - np.repeat(tokens[at[:-1]], np.diff(at)), np.diff(limits))
            arrays[k] = values, limits[at]
    out = []
    for k in range(len(at) - 1):
        i, j = at[k], at[k + 1]
        if fine[k]:
            digest = hashlib.sha256(groups[group_ends[i] : group_ends[j] - 1]).hexdigest()
            row = {n: int(v[j] - v[i]) for n, v in held.items()} | {"digest": digest, "links": links[link_ends[i] : link_ends[j]]}
            out.append(row | {n: v[limits[k] : limits[k + 1]] for n, (v, limits) in arrays.items()})
        else:
            out.append(odd_text(aligner, raw[ends[k] : ends[k + 1]], slots[i:j]) if odd[k] else NOTHING)
    return out


def odd_text(aligner: Aligner, raw: np.ndarray, slots: np.ndarray) -> dict:
    """The same of a text with units that are not given back: perhaps the whole is."""
    (a, at_a), (b, at_b) = aligner.ids_a.gather(slots), aligner.ids_b.gather(slots)
    whole = np.concatenate([np.array([0x20], np.uint8), raw])
    if not aligner._given_back(a, at_a[[0, -1]], b, at_b[[0, -1]], whole, np.array([0, len(whole)]))[0]:
        return NOTHING
    g = Groups(a, b, aligner.in_a.size[a], aligner.in_b.size[b])
    digest = hashlib.sha256(written(a, b, g.cut_a, g.cut_b, np.array([0, len(g.cut_a)]))[0]).hexdigest()
    found = {"a_ids": a, "b_ids": b, "cut_a": g.cut_a, "cut_b": g.cut_b, "over_a": g.over_a, "over_b": g.over_b}
    return {"n_a": len(a), "n_b": len(b), "n_groups": len(g.cut_a), "digest": digest, "links": (a[g.cut_a].astype(np.int64) << 32) | b[g.cut_b]} | found


def aligned(docs: DataFrame, a: str, b: str, full: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links (A id << 32 | B id) of each text.

    ``full`` adds the ids, each group's last token on either side (cut_a, cut_b) and the
    overlaps (over_a, over_b), as indices into the ids.
    """

    def run(batches):
        import pyarrow as pa

        aligner = Aligner.get(a, b, full)
        lists = ("links", *(FULL if full else ()))

        def rows_of(ids: list, done: list[dict]):
            columns = [pa.array(ids, pa.int64()), *(pa.array([d[k] for d in done], pa.int64()) for k in ("n_a", "n_b", "n_groups")), pa.array([d["digest"] for d in done], pa.string())]
            for k in lists:
                values = np.concatenate([d[k] for d in done])
                ends = limits_of(np.array([len(d[k]) for d in done], np.int64)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64 if k == "links" else np.int32))))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *lists])

        for batch in batches:
            raw, ends = flat(batch.column(1))
            ids, at = batch.column(0).to_pylist(), 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, "right")) - 1)
                yield rows_of(ids[at:to], texts(aligner, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at], full))
                aligner.rest()
                at = to

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, FULL_SCHEMA if full else SCHEMA)


def link_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (has no A id more with this B id?)."""
    counts = rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = saved(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]


def counted(rows: DataFrame) -> DataFrame:
    """The rows (KEPT and links) with n_links, n_best and count_sum, by the counts of all of them."""
    counts = saved(link_counts(rows))
    blocks = max(1, -(-counts.count() // PAIRS))
    rows = rows.select(*KEPT, "links")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    parts = []
    for k in range(blocks):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k).toArrow()  # about PAIRS rows
        pair, n, best = (own.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        held = rows.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order]))
        del own, pair, n, best

        def run(batches, held=held):
            import pyarrow as pa

            Aligner.leave()
            pair, n, best = held.value
            for batch in batches:
                column = batch.column(len(KEPT))
                links, ends = column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64)
                ends -= ends[0]
                at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
                here = pair[at] == links if len(pair) else np.zeros(len(links), bool)
                sums = [limits_of(np.where(here, v[at], 0) if len(pair) else here) for v in (best, n)]
                new = [np.diff(ends), *(v[ends[1:]] - v[ends[:-1]] for v in sums)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(KEPT))), *map(pa.array, new)], [*KEPT, "n_links", "n_best", "count_sum"])

        part = rows.mapInArrow(run, schema)
        parts.append(part if blocks == 1 else saved(part, spread=True))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    if blocks == 1:
        return whole
    same = [F.first(c).alias(c) for c in (*KEPT[1:], "n_links")]
    return whole.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    # a row's number is fixed by being written
    rows = saved(aligned(docs, a, b).withColumn("row", F.monotonically_increasing_id()), spread=True)
    return counted(rows).drop("row")


def op11_align(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
