"""Near-duplicate lines by an exact set-similarity join.

A line is its set of lower-cased words. Equal sets form a class, represented by its first line in
(doc_id, line) order; later lines of a class go. Classes are then joined at Jaccard >= threshold: the
words of a class are ordered by rarity, its prefix (the words of which a similar set must share one)
is posted to the shard of each word, and shards pair postings under the length filter, the positional
filter and a bound from 128-bit parity sketches, which is a true bound: each differing word flips one
bit. A class goes if an earlier class is similar. Partners under a word are looked at in widening rings of like
size, further ones only for a class without a clearly similar candidate. Of each word it keeps its
`nearest` candidates where the nearest is similar by a wide margin, else up to `most`; they are verified
on the full words of both lines, nearest first. A class none of whose kept candidates is similar, and
that may have more, is compared with the classes of all batches: such classes are a query set, met in
blocks of bounded size. So nothing is lost to the bound on candidates.

Rarity is the count of all documents' words in a table of fixed size (its slots shared by words of
equal hash), so the order is the same everywhere and the table that each task gets doesn't grow (one byte for each of 2**20 slots).

Defined cases: lines without words are kept and never matched; a null or empty text is kept as it is;
a document whose every line with words is removed has an empty kept text if nothing else is left;
lines of repeated rows (same doc_id and place) don't remove each other; a null doc_id sorts after all
others; extra columns are not read; an empty table gives an empty result. Words compare by 64-bit
hashes, classes by 96 bits over whole words. A batch's memory is a multiple of 3 MB or of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import rolling as R
from .storage import arrow_schema, from_ipc, in_order, materialise, releasing, stage, with_text
from .substring_dedup import LAST, SENT_SQL, SENT, _answer, _gathered

U = np.uint64
SLOTS = 20
SLOT_RANGES = 64
OUT_SQL = "doc_id long, n_lines long, n_removed long, kept_text string, removed_lines array<int>"
OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_lines", pa.list_(pa.int32()))])
PAIR_SQL = "x_batch long, x_line int, y_batch long, y_line int, distance int, more boolean"
PAIR = pa.schema([("x_batch", pa.int64()), ("x_line", pa.int32()), ("y_batch", pa.int64()), ("y_line", pa.int32()), ("distance", pa.int32()), ("more", pa.bool_())])
LINE_SQL = "batch long, line int, text string"
LINE = pa.schema([("batch", pa.int64()), ("line", pa.int32()), ("text", pa.string())])


def _ids(t: pa.Table) -> np.ndarray:
    return np.array([LAST if x is None else x for x in t["doc_id"].to_pylist()], np.int64)


FOUND = pa.schema([("x_batch", pa.int64()), ("x_line", pa.int32()), ("doc_id", pa.int64()), ("number", pa.int32())])


class Lines:
    """Lines of a batch: byte ranges and documents; split() finds the words of all or of some lines."""

    def __init__(self, t: pa.Table):
        self.data, self.off = R.column_bytes(t["text"])
        breaks = np.flatnonzero(self.data == 10)
        # the k-th line of a document runs from behind the edge before it
        doc_of_break = np.searchsorted(self.off, breaks, side="right") - 1
        lines_per_doc = np.bincount(doc_of_break, minlength=len(self.off) - 1) + 1 if len(self.off) > 1 else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(lines_per_doc)]).astype(np.int64)
        n = int(self.first[-1])
        self.begin, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.begin[self.first[:-1]] = self.off[:-1]
        self.end[self.first[1:] - 1] = self.off[1:]
        inner = np.ones(n, bool)
        inner[self.first[1:] - 1] = False
        self.end[inner] = breaks
        self.begin[np.flatnonzero(inner) + 1] = breaks + 1
        self.doc = np.repeat(np.arange(len(self.off) - 1), lines_per_doc)
        self.number = np.arange(n) - np.repeat(self.first[:-1], lines_per_doc)

    def split(self, chosen: np.ndarray | None = None) -> None:
        """Hashes of the words, and the line of each."""
        low = R.translated(self.data, R.LOWER)
        starts, ends, _ = R.words(low, self.off)
        # an empty line that ends a document shares its begin with the next line, which has the words
        n = np.diff(np.append(np.searchsorted(starts, self.begin), len(starts)))
        self.line = np.repeat(np.arange(len(n)), n)
        if chosen is not None:
            own = chosen[self.line]
            starts, ends, self.line = starts[own], ends[own], self.line[own]
        self.words = R.word_hashes(low, starts, ends)

    def texts(self, index: np.ndarray) -> pa.Array:
        """The texts of lines as they stand."""
        size = self.end[index] - self.begin[index]
        return R.strings(self.data[R.spans(self.begin[index], size)], np.concatenate([[0], np.cumsum(size)]))

    def classes(self, wide_from: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of the word set of each line and its size; 0 for a line without words."""
        n = len(self.begin)
        again = np.zeros(len(self.line), bool)  # words that their line holds already
        order, wide = np.zeros(0, np.int64), n >= wide_from
        if not wide:
            key = (self.line.astype(U) << U(42)) | (self.words >> U(22))
            order = np.argsort(key)
            key, word = key[order], self.words[order]
            same = key[1:] == key[:-1]
            wide = bool((word[1:][same] != word[:-1][same]).any())
        if wide:
            order = np.lexsort((self.words, self.line))
            line, word = self.line[order], self.words[order]
            same = (line[1:] == line[:-1]) & (word[1:] == word[:-1])
        again[order[1:][same] if len(order) else order] = True
        cuts = np.searchsorted(self.line, np.arange(n + 1))
        kept = np.concatenate([[0], np.cumsum(~again)])
        size = kept[cuts[1:]] - kept[cuts[:-1]]
        out = []
        for h in (R.mix(self.words), R.mix(self.words ^ U(0x5555555555555555))):
            h[again] = U(0)
            total = np.concatenate([[U(0)], np.cumsum(h, dtype=U)])
            x = R.mix(total[cuts[1:]] - total[cuts[:-1]] + size.astype(U)) | U(1)
            out.append(np.where(size > 0, x, U(0)))
        return out[0], out[1] >> U(32), size


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> U(64 - SLOTS)).astype(np.int64)


def _by_rarity(line: np.ndarray, words: np.ndarray, levels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, word) of the distinct words of each line, rarest first, ties by hash; by one sort of 64-bit keys where 34 bits of hash tell a line's words apart."""
    level = levels[_slots(words)].astype(U)
    if n < 1 << 22:
        key = (line.astype(U) << U(42)) | (level << U(34)) | (words >> U(30))
        order = np.argsort(key)
        key, line, words = key[order], line[order], words[order]
        same = key[1:] == key[:-1]
        if (words[1:][same] == words[:-1][same]).all():
            new = np.concatenate([[True], ~same])[: len(line)]
            return line[new], words[new]
        level = levels[_slots(words)].astype(U)
    order = np.lexsort((words, level, line))
    line, words = line[order], words[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
    return line[new], words[new]


class _Classes:
    """The different word sets of a batch, in the order of their first hash, as they are kept with it.

    k1, k2: both hashes; first: the line of least (doc_id, number); size: words; of: class of each line (-1: none).
    """

    def __init__(self, t: pa.Table):
        """t: (doc_id, extra) rows of a batch in order."""
        k1, k2, first, size, of, per_doc, *_ = X.unpack(next(x for x in t["extra"].to_pylist() if x is not None))
        self.k1, self.k2 = X.sums(k1), k2
        self.first, self.size, self.of = first.astype(np.int64), size.astype(np.int64), of.astype(np.int64) - 1
        self.doc, self.number = _places(_ids(t), per_doc.astype(np.int64))


def _places(ids: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and number of each line."""
    return np.repeat(ids, per_doc), np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)


def _summary(t: pa.Table) -> bytes:
    """What _Classes holds, and counts of the words by slot."""
    lines, ids = Lines(t), _ids(t)
    lines.split()
    c1, c2, size = lines.classes()
    per_doc = np.diff(lines.first)
    doc, number = _places(ids, per_doc)
    rank = np.arange(len(doc))
    if (ids[1:] <= ids[:-1]).any():
        rank[np.lexsort((number, doc))] = np.arange(len(doc))
    at = np.flatnonzero(c1)
    at = at[np.argsort(c1[at])]
    new = np.ones(len(at), bool)
    new[1:] = c1[at][1:] != c1[at][:-1]
    if (c2[at][1:] != c2[at][:-1])[~new[1:]].any():
        at = at[np.lexsort((c2[at], c1[at]))]
        new[1:] = (c1[at][1:] != c1[at][:-1]) | (c2[at][1:] != c2[at][:-1])
    of = np.zeros(len(c1), np.uint32)
    of[at] = np.cumsum(new)
    line_of = np.empty_like(rank)
    line_of[rank] = np.arange(len(rank))
    first = line_of[np.minimum.reduceat(rank[at], np.flatnonzero(new))] if len(at) else at
    counts = np.bincount(_slots(lines.words), minlength=1 << SLOTS)
    slots = np.flatnonzero(counts)
    counts = counts[slots]
    return X.pack(X.differences(c1[first]), c2[first].astype(np.uint32), first.astype(np.uint32), size[first].astype(np.uint32), of, per_doc.astype(np.uint32), X.differences(slots.astype(U)).astype(np.uint32), counts.astype(np.uint32))


def _need(a: np.ndarray, b: np.ndarray, up: int, down: int) -> np.ndarray:
    """The least overlap at which sets of sizes a and b reach up/down."""
    return -(-(up * (a + b)) // (up + down))


class _Postings:
    """Postings of a shard's words, and the candidates that they give.

    They stand by word, then by size, so the partners of a line are one stretch around it. Partners
    are looked at in widening rings: near neighbours first, and further ones only for lines that have
    no clearly similar candidate yet. So a group of m similar lines costs about m looks and not m * m / 2,
    and no more than a bounded number of candidates a line is ever held.
    """

    RINGS = (16, 256)
    LOOKS = 2_000_000
    HELD = 4_000_000

    def __init__(self, word, line, size, position, s0, s1, doc, number, batch, up: int, down: int):
        order = np.argsort((word << U(16)) | np.minimum(size, 65535).astype(U))
        if size.max(initial=0) >= 65535:
            order = np.lexsort((size, word))
        word, self.line, self.batch = word[order], line[order], batch[order]
        self.size, self.position, self.number = (v[order].astype(np.int64) for v in (size, position, number))
        self.s0, self.s1, self.doc, self.up, self.down = s0[order], s1[order], doc[order], up, down
        joint = (np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])).astype(U) << U(32)) if len(word) else word
        key = joint | self.size.astype(U)
        # partners have sizes from size * up / down to size * down / up
        self.start = np.searchsorted(key, joint | (-(-self.size * up // down)).astype(U))
        self.stop = np.searchsorted(key, joint | np.minimum(self.size * down // up, 0xFFFFFFFF).astype(U), side="right")

    def _clear(self, x: np.ndarray, y: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Whether a pair is likely similar by a wide margin, from the words that differ for so many flipped bits."""
        differing = -64 * np.log1p(-np.minimum(distance, 63) / 64)
        return self.size[x] + self.size[y] - 1.3 * differing - 8 >= 2 * _need(self.size[x], self.size[y], self.up, self.down)

    def _looked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, distance, whether a is the later line) of the pairs that the filters leave."""
        need = _need(self.size[a], self.size[b], self.up, self.down)
        ok = np.minimum(self.size[a] - self.position[a], self.size[b] - self.position[b]) >= need
        a, b, need = a[ok], b[ok], need[ok]
        distance = np.bitwise_count(self.s0[a] ^ self.s0[b]).astype(np.int64) + np.bitwise_count(self.s1[a] ^ self.s1[b])
        ok = (self.size[a] + self.size[b] - distance >= 2 * need) & ((self.doc[a] != self.doc[b]) | (self.number[a] != self.number[b]))
        a, b, distance = a[ok], b[ok], distance[ok]
        return a, b, distance, (self.doc[a] > self.doc[b]) | ((self.doc[a] == self.doc[b]) & (self.number[a] > self.number[b]))

    def _nearest(self, parts: list, nearest: int, most: int) -> tuple:
        """The nearest candidates of each line, at most as many as it has room for."""
        x, y, distance = (np.concatenate(v) for v in zip(*parts, strict=True))
        order = np.lexsort((y, distance, x))
        x, y, distance = x[order], y[order], distance[order]
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else x
        room = np.where(self._clear(x[head], y[head], distance[head]), nearest, most)
        keep = np.arange(len(x)) - head < room
        return x[keep], y[keep], distance[keep]

    def _pairs(self, own: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """What _looked() leaves of the pairs of each place and its range, so many looks at a time."""
        size = np.maximum(0, end - begin)
        own, begin, size = own[size > 0], begin[size > 0], size[size > 0]
        total, at = np.cumsum(size), 0
        while at < len(own):
            base = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + self.LOOKS, side="right")))
            yield self._looked(np.repeat(own[at:to], size[at:to]), R.spans(begin[at:to], size[at:to]))
            at = to

    def candidates(self, nearest: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, distance, whether x may have more than these), x the later line."""
        n = len(self.size)
        place, counts, unseen = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
        held, n_held = [(place[:0],) * 3], 0

        def hold(x: np.ndarray, y: np.ndarray, distance: np.ndarray) -> None:
            nonlocal held, n_held
            np.add.at(counts, x, 1)
            held.append((x, y, distance))
            n_held += len(x)
            if n_held > self.HELD:
                held = [self._nearest(held, nearest, most)]
                n_held = len(held[0][0])

        inner, ring = 0, self.RINGS[0]
        for a, b, distance, later in self._pairs(place, place + 1, np.minimum(self.stop, place + ring + 1)):
            hold(np.where(later, a, b), np.where(later, b, a), distance)
        open_ = np.ones(n, bool)
        for further in (*self.RINGS[1:], n):
            held = [self._nearest(held, nearest, most)]
            x, y, distance = held[0]
            n_held = len(x)
            open_ &= (self.stop > place + ring + 1) | (self.start < place - ring)
            clear = np.zeros(n, bool)
            clear[x[self._clear(x, y, distance)]] = True
            unseen |= open_ & clear
            open_ &= ~clear
            inner, ring = ring, max(further, ring)
            own = np.flatnonzero(open_)
            # both sides of each open line, as the later line of a pair
            for begin, end in ((own + inner + 1, np.minimum(self.stop[own], own + ring + 1)), (np.maximum(self.start[own], own - ring), own - inner)):
                for a, b, distance, later in self._pairs(own, begin, end):
                    hold(a[later], b[later], distance[later])
        x, y, distance = self._nearest(held, nearest, most)
        return x, y, distance, unseen[x] | (counts[x] > np.bincount(x, minlength=n)[x])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (80, 100), nearest: int = 3, most: int = 64, block_words: int = 2_000_000, batch_bytes: int = 3 << 20, carry: bool = False) -> DataFrame:
    """Remove each line that a line before it, in (doc_id, line) order, matches at Jaccard >= threshold of word sets.

    Matches are judged on the input. Returns doc_id, n_lines, n_removed, kept_text and removed_lines;
    with carry instead the input rows, their texts without the removed lines, but for documents all of
    whose lines with words went.
    """
    up, down = threshold
    spark = docs.sparkSession
    staged = stage(docs, id_col, text_col, batch_bytes, _summary, carry)
    schema = arrow_schema(docs) if carry else OUT
    n, table = staged.n_shards, staged.table

    def slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS, np.int64)
        for b in batches:
            for extra in b.column(0).to_pylist():
                *_, deltas, counts = X.unpack(extra)
                total[np.cumsum(deltas, dtype=np.int64)] += counts
        width = (1 << SLOTS) // SLOT_RANGES
        short = total.astype(np.uint32)
        held = [(r, X.pack(short[r * width : (r + 1) * width])) for r in range(SLOT_RANGES)] if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in held], pa.int32()), pa.array([p for _, p in held], pa.binary())], ["range", "payload"])

    def summed(t: pa.Table) -> pa.Table:
        total = sum(X.unpack(p)[0].astype(np.int64) for p in t["payload"].to_pylist())
        level = np.minimum(255, np.floor(8 * np.log2(total + 1))).astype(np.uint8)
        return pa.table({"range": pa.array([t["range"][0].as_py()], pa.int32()), "payload": pa.array([X.pack(level)], pa.binary())})

    summaries = table.select("batch", "extra", "doc_id", "seq")
    counted = table.select("extra").filter("extra IS NOT NULL").mapInArrow(slot_counts, "range int, payload binary").groupBy("range").applyInArrow(releasing(summed), "range int, payload binary")
    levels = np.zeros(1 << SLOTS, np.uint8)  # a table of fixed size: 1 MB
    for r in counted.collect():
        width = (1 << SLOTS) // SLOT_RANGES
        levels[r["range"] * width : (r["range"] + 1) * width] = X.unpack(r["payload"])[0]
    shared = spark.sparkContext.broadcast(levels)

    def send_classes(t: pa.Table) -> pa.Table:
        t = in_order(t)
        c = _Classes(t)
        low, no = c.doc.min() if len(c.doc) else 0, t["batch"][0].as_py()
        return X.rows(SENT, [(no, s, X.pack(X.differences(c.k1[r]), c.k2[r], (c.doc[c.first[r]] - low).astype(U), c.number[c.first[r]].astype(np.uint32), np.array([low], np.int64))) for s, r in X.by_shard(X.shard_of(c.k1, 64, n))])

    def first_of_class(t: pa.Table) -> pa.Table:
        parts = [X.unpack(p) for p in t["payload"].to_pylist()]
        c1, c2 = np.concatenate([X.sums(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
        doc, number = np.concatenate([p[2].astype(np.int64) + p[4][0] for p in parts]), np.concatenate([p[3] for p in parts])
        order = np.lexsort((number, doc, c2, c1))
        new = np.ones(len(order), bool)
        new[1:] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        out = np.empty(len(order), bool)
        out[order] = (doc[order] == doc[head]) & (number[order] == number[head])
        return _answer(t, out, [len(p[0]) for p in parts])

    owners = materialise(summaries.groupBy("batch").applyInArrow(releasing(send_classes), SENT_SQL).groupBy("shard").applyInArrow(releasing(first_of_class), SENT_SQL), "owners")

    def postings(a: pa.Table, t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return SENT.empty_table()
        t = in_order(t)
        c = _Classes(t)
        doc, number, chosen = c.doc, c.number, np.zeros(len(c.doc), bool)
        chosen[c.first[_gathered(a, len(c.first))]] = True
        lines = Lines(t)
        lines.split(chosen)
        line, word = _by_rarity(lines.line, lines.words, shared.value, len(lines.begin))
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        own = np.diff(np.append(starts, len(line)))
        prefix = own - -(-(up * own) // down) + 1
        # sets of up to four words match equal sets alone, at 0.8; those are classes already
        prefix[(_need(own, own + 1, up, down) > own) & (own * up > (own - 1) * down)] = 0
        bit = R.mix(word) >> U(57)
        flips, upper = U(1) << (bit & U(63)), bit >= U(64)
        sketch = [np.bitwise_xor.reduceat(np.where(upper == half, flips, U(0)), starts) if len(starts) else flips for half in (False, True)]
        of, use = np.repeat(np.arange(len(own)), prefix), R.spans(starts, prefix)
        order = np.argsort(word[use])
        of, use = of[order], use[order]
        low, no = doc.min() if len(doc) else 0, t["batch"][0].as_py()
        at, key, base = line[use], word[use], np.array([low], np.int64)
        held = [at.astype(np.uint32), own[of].astype(np.uint32), (use - starts[of]).astype(np.uint32), sketch[0][of], sketch[1][of], (doc[at] - low).astype(U), number[at].astype(np.uint32)]
        cut = key >> U(16)
        return X.rows(SENT, [(no, s, X.pack(X.differences(cut[r]), *[v[r] for v in held], base)) for s, r in X.by_shard(X.shard_of(key, 64, n))])

    def pair(t: pa.Table) -> pa.Table:
        parts = [X.unpack(p) for p in t["payload"].to_pylist()]
        word = np.concatenate([X.sums(p[0]) for p in parts])
        line, size, position, s0, s1 = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
        doc, number = np.concatenate([p[6].astype(np.int64) + p[8][0] for p in parts]), np.concatenate([p[7] for p in parts])
        batch = np.repeat(t["batch"].to_numpy(), [len(p[0]) for p in parts])
        table = _Postings(word, line, size, position, s0, s1, doc, number, batch, up, down)
        x, y, distance, more = table.candidates(nearest, most)
        line, batch = table.line, table.batch
        return pa.Table.from_arrays([pa.array(batch[x]), pa.array(line[x].astype(np.int32)), pa.array(batch[y]), pa.array(line[y].astype(np.int32)), pa.array(distance.astype(np.int32)), pa.array(more)], schema=PAIR)

    sent = owners.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(releasing(postings), SENT_SQL)
    pairs = materialise(sent.groupBy("shard").applyInArrow(releasing(pair), PAIR_SQL), "pairs")
    mine, its = ["x_batch", "x_line"], ["y_batch", "y_line"]

    def fetch(a: pa.Table, t: pa.Table) -> pa.Table:
        if not a.num_rows or not t.num_rows:
            return LINE.empty_table()
        own = a["line"].to_numpy()
        return pa.Table.from_arrays([pa.array(a["batch"].to_numpy()), pa.array(own.astype(np.int32)), Lines(in_order(t)).texts(own)], schema=LINE)

    def texts_of(wanted: DataFrame) -> DataFrame:
        return materialise(wanted.groupBy("batch").cogroup(table.select("batch", "seq", "doc_id", "text").groupBy("batch")).applyInArrow(releasing(fetch), LINE_SQL), "lines")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_word_sets(b.column(c)) for c in ("x_text", "y_text"))
            ok = []
            for p, q in zip(x, y, strict=True):
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(down * both >= up * (len(p) + len(q) - both))
            yield b.select(mine).filter(pa.array(ok, pa.bool_()))

    best = materialise(pairs.groupBy(*mine).agg(F.min(F.struct("distance", *its)).alias("y"), F.max("more").alias("more")).select(*mine, *[f"y.{c}" for c in its], "more"), "best")
    ends = best.select(F.col("x_batch").alias("batch"), F.col("x_line").alias("line")).unionAll(pairs.select(F.col("y_batch"), F.col("y_line"))).distinct()
    texts = texts_of(ends)

    def similar(candidates: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("batch").alias(f"{s}_batch"), F.col("line").alias(f"{s}_line"), F.col("text").alias(f"{s}_text")) for s in "xy")
        return candidates.join(y.hint("merge"), its).join(x.hint("merge"), mine).select(*mine, "x_text", "y_text").mapInArrow(verify, "x_batch long, x_line int").distinct()

    near = materialise(similar(best), "similar")
    rest = pairs.join(near.hint("merge"), mine, "left_anti").join(best.drop("more").hint("merge"), [*mine, *its], "left_anti")
    again = materialise(similar(rest.select(*mine, *its).distinct()), "similar")
    gone = near.unionAll(again)
    open_ = materialise(best.filter("more").select(*mine).join(gone.hint("merge"), mine, "left_anti"), "open")
    queries = open_.join(texts.select(F.col("batch").alias("x_batch"), F.col("line").alias("x_line"), F.col("text")).hint("merge"), mine)
    found = _against_all(table, queries, levels, up, down, block_words)
    if found is not None:
        gone = gone.unionAll(found)

    marks = gone.groupBy("x_batch").agg(F.collect_list("x_line").alias("lines")).select(F.lit(1).alias("kind"), F.col("x_batch").alias("batch"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("payload"), "lines")
    answers = owners.select(F.lit(0).alias("kind"), "batch", "shard", "payload", F.lit(None).cast("array<int>").alias("lines")).unionAll(marks)

    def remove(a: pa.Table, t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        t = in_order(t)
        c = _Classes(t)
        first, of, doc, number = c.first, c.of, c.doc, c.number
        kind = np.asarray(a["kind"])
        head = first[_gathered(a.filter(pa.array(kind == 0)), len(first))]
        lines = Lines(t)
        removed = of >= 0
        removed[head] = False
        # lines of repeated rows at a head's place are its equals, not later ones
        same = np.flatnonzero(removed)
        removed[same] = (doc[same] != doc[first[of[same]]]) | (number[same] != number[first[of[same]]]) | ~np.isin(first[of[same]], head)
        for own in a.filter(pa.array(kind == 1))["lines"].to_pylist():
            removed[np.array(own, np.int64)] = True
        out = _without(t, lines, removed)
        if not carry:
            return out
        lost = np.bincount(lines.doc[removed], minlength=len(t))
        left = np.bincount(lines.doc[(of >= 0) & ~removed], minlength=len(t))
        carried = from_ipc(next(x for x in t["carried"].to_pylist() if x is not None))
        return with_text(carried, out["kept_text"].combine_chunks(), text_col, schema).filter(pa.array((left > 0) | (lost == 0)))

    return answers.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(releasing(remove), docs.schema if carry else OUT_SQL)


def _without(t: pa.Table, lines: Lines, removed: np.ndarray) -> pa.Table:
    """Documents without the removed lines; the kept ones are joined by one line break."""
    n = len(lines.data)
    index = np.flatnonzero(~removed)
    size = lines.end[index] - lines.begin[index]
    some = index[size > 0]
    edge = np.zeros(n + 1, np.int8)
    edge[lines.begin[some]] += 1
    edge[lines.end[some]] -= 1
    take = np.cumsum(edge[:n], dtype=np.int8).view(bool)
    more = index[:-1][lines.doc[index[:-1]] == lines.doc[index[1:]]] if len(index) > 1 else index[:0]
    take[lines.end[more]] = True
    sizes = np.bincount(lines.doc[index], weights=size, minlength=len(t)) + np.bincount(lines.doc[more], minlength=len(t))
    kept = R.strings(lines.data[take], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    of = np.concatenate([[0], np.cumsum(removed)])[lines.first].astype(np.int32)
    return pa.Table.from_arrays([t["doc_id"].combine_chunks(), pa.array(np.diff(lines.first)), pa.array(np.diff(of).astype(np.int64)), kept, pa.ListArray.from_arrays(pa.array(of), pa.array(lines.number[removed].astype(np.int32)))], schema=OUT)


def _word_sets(col) -> list[np.ndarray]:
    data, off = R.column_bytes(col)
    data = R.translated(data, R.LOWER)
    starts, ends, first = R.words(data, off)
    values = R.word_hashes(data, starts, ends)
    return [np.unique(values[a:b]) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]


def _against_all(table: DataFrame, queries: DataFrame, levels: np.ndarray, up: int, down: int, block_words: int) -> DataFrame | None:
    """Of the query lines (x_batch, x_line, text) those with an earlier similar line, by looking at the classes of all batches.

    Queries are met in blocks of about `block_words` words, so what a block broadcasts is bounded whatever
    the lines' lengths; a batch looks into the lines of fitting sizes that hold one of the rarest words of a
    query alone: a similar line shares up/down of a query's words, so one at least of so many rarest ones.
    """
    spark, out = table.sparkSession, None

    def block(names: list, sets: list[np.ndarray]) -> DataFrame:
        word = np.concatenate(sets)
        order = np.argsort(word)
        sizes = np.array([len(s) for s in sets])
        known = np.zeros(1 << SLOTS, bool)
        for s in sets:
            known[_slots(s[np.argsort(levels[_slots(s)], kind="stable")[: len(s) - -(-(up * len(s)) // down) + 1]])] = True
        shared = spark.sparkContext.broadcast((names, sizes, word[order], np.repeat(np.arange(len(sets)), sizes)[order], known))

        def scan(t: pa.Table) -> pa.Table:
            names, sizes, word, owner, known = shared.value
            t = in_order(t)
            c = _Classes(t)
            fits = np.unique(sizes)
            # the least query size from which a line's size is not too large, and whether it is not too small for it
            at = np.searchsorted(fits, -(-c.size * up // down))
            ok = (at < len(fits)) & (fits[np.minimum(at, len(fits) - 1)] * up <= c.size * down)
            if not ok.any():
                return FOUND.empty_table()
            lines = Lines(t)
            size = np.zeros(len(lines.begin), np.int64)
            size[c.first[ok]] = c.size[ok]
            lines.split(size > 0)
            near = np.zeros(len(size), bool)
            near[lines.line[known[_slots(lines.words)]]] = True
            near = near[lines.line]
            values, line = lines.words[near], lines.line[near]
            order = np.lexsort((values, line))
            values, line = values[order], line[order]
            new = np.ones(len(line), bool)
            new[1:] = (line[1:] != line[:-1]) | (values[1:] != values[:-1])
            values, line = values[new], line[new]
            lo, hi = np.searchsorted(word, values, side="left"), np.searchsorted(word, values, side="right")
            q = owner[R.spans(lo, hi - lo)]
            pair, overlap = np.unique(np.repeat(line, hi - lo) * len(sizes) + q, return_counts=True)
            line, q = pair // len(sizes), pair % len(sizes)
            ok = down * overlap >= up * (size[line] + sizes[q] - overlap)
            at, q = line[ok], q[ok]
            return pa.Table.from_arrays([pa.array([names[k][0] for k in q], pa.int64()), pa.array([names[k][1] for k in q], pa.int32()), pa.array(c.doc[at]), pa.array(c.number[at].astype(np.int32))], schema=FOUND)

        hits = table.groupBy("batch").applyInArrow(releasing(scan), "x_batch long, x_line int, doc_id long, number int").groupBy("x_batch", "x_line").agg(F.min(F.struct("doc_id", "number")).alias("least"))
        out = materialise(hits, "all")
        shared.destroy()
        return out

    found, names, sets, n_words = [], [], [], 0
    for r in queries.toLocalIterator():
        names.append((r["x_batch"], r["x_line"]))
        sets += _word_sets(pa.array([r["text"]], pa.string()))
        n_words += len(sets[-1])
        if n_words >= block_words:
            found.append(block(names, sets))
            names, sets, n_words = [], [], 0
    if names:
        found.append(block(names, sets))
    for f in found:
        out = f if out is None else out.unionAll(f)
    if out is None:
        return None
    # a line is its own match at its own place: it goes if the least match stands before it

    def places(a: pa.Table, t: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"x_batch": pa.array([], pa.int64()), "x_line": pa.array([], pa.int32())})
        c = _Classes(in_order(t))
        own = a["x_line"].to_numpy()
        least = a["least"].to_pylist()
        ok = [(m["doc_id"], m["number"]) < (int(c.doc[x]), int(c.number[x])) for x, m in zip(own, least, strict=True)]
        return pa.table({"x_batch": a["x_batch"], "x_line": a["x_line"]}).filter(pa.array(ok, pa.bool_()))

    return materialise(out.withColumn("batch", F.col("x_batch")).groupBy("batch").cogroup(table.select("batch", "seq", "doc_id", "extra").groupBy("batch")).applyInArrow(releasing(places), "x_batch long, x_line int"), "all")
