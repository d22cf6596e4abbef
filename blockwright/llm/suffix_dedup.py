"""Exact substring deduplication on bytes with per-shard suffix arrays.

A repeat of 50 bytes has the same least 24-byte k-mer (its anchor) wherever it is, so stretches whose
anchors occur once in the whole corpus hold no repeat and are left alone. For the stretches whose anchors
occur more than once in a shard of documents a suffix array is built by Larsson-Sadakane refinement:
suffixes are ordered by eight bytes, then only groups that are still equal are refined by the rank of the
suffix one depth further on, until a group shares 50 bytes. Neighbours that share 50 bytes are one class,
decided within the shard by its least document; stretches whose anchors recur in other shards alone can
repeat there alone. What
each shard keeps of a repeated anchor, one context per different surrounding, is cut by binary search
at the borders of key ranges, and the ranges of all shards are merged: a window is looked up in the
sorted windows of all shards for its least document. A shard sends a context once however many
copies it holds and gets one bit per window back. Ranges are of mixed anchors, which spread evenly
where the anchors themselves, being least values, crowd. An anchor that occurs `hot` times or more is
split: its windows go to the ranges of their own hashes, so no task gets all surroundings of a string
that stands everywhere.

Defined cases: a null or empty text has no bytes; matches never cross documents; rows that repeat a
doc_id are no smaller than each other; a null doc_id sorts after all others; extra columns are not
read; an empty table gives an empty result. Across shards windows compare by 64-bit hashes within
one 64-bit anchor, those of hot anchors by 96 bits. A batch's memory is a multiple of 3 MB or of its
longest text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import rolling as R
from .storage import materialise, releasing, stage
from .substring_dedup import LAST, SENT, SENT_SQL, _answer, _gathered

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,stop:int>>"
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
MIXED_SQL = "kind int, " + SENT_SQL
MIXED = pa.schema([("kind", pa.int32()), *SENT])


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op, a minimum or maximum, over x[i : i + w] for each whole window, by windows of twice the width each time."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * span <= w:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[:n], x[w - span : w - span + n])


def big_endian_words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, zeros behind the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    out = np.zeros(len(t), U)
    for k in range(8):
        out = (out << U(8)) | padded[k : k + len(t)].astype(U)
    return out


def suffix_array(t: np.ndarray, words: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of bytes, refined until all suffixes differ or, if given, groups share `most` bytes."""
    n = len(t)
    words = big_endian_words(t) if words is None else words
    sa = np.argsort(words).astype(np.int64)
    head = np.ones(n, bool)
    head[1:] = words[sa][1:] != words[sa][:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 8
    open_ = ~head | ~np.append(head[1:], True)
    at = np.flatnonzero(open_)
    while len(at) and (most is None or depth < most):
        own = sa[at]
        further = own + depth
        # a suffix that ends within the depth is shorter than what it is equal to so far, and comes first
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + n + 1, n - own)
        key = (rank[own].astype(U) << U(32)) | second.astype(U)
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        still = ~new | ~np.append(new[1:], True)
        at = at[still]
        depth *= 2
    return sa, rank


def kasai(t: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int, words: np.ndarray | None = None, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to `most`.

    The common prefix shrinks by one byte at most from a place to the next, so each lane carries it
    along its stretch of consecutive places and only ever extends it.
    """
    n = len(t)
    out = np.zeros(n, np.int32)
    if not n:
        return out
    words = big_endian_words(t) if words is None else words
    stretch = -(-n // lanes)
    place = np.arange(0, n, stretch)
    h = np.zeros(len(place), np.int64)
    for _ in range(stretch):
        place, h = place[place < n], h[place < n]
        r = rank[place]
        other = sa[np.maximum(r - 1, 0)]
        h = np.where(r > 0, np.maximum(h - 1, 0), 0)
        live = np.flatnonzero(r > 0)
        while len(live):
            a, b = place[live] + h[live], other[live] + h[live]
            inside = (a < n) & (b < n)
            x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            same = np.full(len(live), 8)
            for k in range(8):
                same -= x >= U(1 << (8 * k))
            same = np.where(inside, np.minimum(same, n - np.maximum(a, b)), 0)
            h[live] += same
            live = live[(same == 8) & (h[live] < most)]
        out[r] = np.minimum(h, most)
        place = place + 1
    return out


def alike(words: np.ndarray, sa: np.ndarray, size: int) -> np.ndarray:
    """Which suffixes share `size` bytes, 8 at least, with the one before them in order."""
    out = np.zeros(len(sa), bool)
    at = np.flatnonzero(np.maximum(sa[1:], sa[:-1]) + size <= len(sa)) + 1
    for o in (*range(0, size - 8, 8), size - 8):
        at = at[words[sa[at] + o] == words[sa[at - 1] + o]]
    out[at] = True
    return out


class _Shard:
    """The bytes of a shard and its anchors."""

    def __init__(self, t: pa.Table, size: int, k: int):
        t = t.sort_by("seq")
        self.ids = np.array([LAST if x is None else x for x in t["doc_id"].to_pylist()], np.int64)
        self.data, self.off = R.column_bytes(t["text"])
        self.size, self.k, self.w = size, k, size - k + 1
        n = len(self.data)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.off))
        self.valid = self.doc[: max(0, n - size + 1)] == self.doc[size - 1 :] if n >= size else np.zeros(0, bool)
        self.prefix = R.prefix(self.data)
        self.mers = R.byte_windows(self.data, k, self.prefix) | U(1)
        if not len(self.valid):
            self.least, self.at = np.zeros(0, U), np.zeros(0, np.int64)
        else:
            self.least = np.where(self.valid, sliding(self.mers, self.w, np.minimum), U(0))
            around = np.concatenate([np.zeros(self.w - 1, U), self.least, np.zeros(self.w - 1, U)])
            self.at = np.flatnonzero(sliding(around, self.w, np.maximum)[: len(self.mers)] == self.mers)
        self.keys, self.inverse, self.counts = np.unique(R.mix(self.mers[self.at]), return_inverse=True, return_counts=True)

    def suspicious(self, shared: np.ndarray) -> np.ndarray:
        """Windows whose anchor is one of the shared keys."""
        seen = np.full(len(self.mers), TOP)
        own = self.at[shared[self.inverse]]
        seen[own] = self.mers[own]
        return self.valid & (sliding(seen, self.w, np.minimum) == self.least)

    def repeated(self, windows: np.ndarray) -> np.ndarray:
        """Which of the windows have a smaller document in this shard, by suffix array and equal neighbours."""
        gone = np.zeros(len(self.data), bool)
        take = R.cover(windows, self.size, len(self.data))
        places = np.flatnonzero(take)
        if not len(places):
            return gone
        text = self.data[places]
        words = big_endian_words(text)
        sa, _ = suffix_array(text, words, self.size)
        group = np.cumsum(~alike(words, sa, self.size)) - 1
        at = places[sa]
        own = np.flatnonzero(windows[np.minimum(at, len(windows) - 1)] & (at < len(windows)))
        at, group, docs = at[own], group[own], self.ids[self.doc[at[own]]]
        if len(at):
            new = np.ones(len(group), bool)
            new[1:] = group[1:] != group[:-1]
            least = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
            gone[at[least < docs]] = True
        return gone

    def contexts(self, shared: np.ndarray):
        """The different surroundings of shared anchors: keys, bytes, windows, least documents, and the places of each."""
        chosen = shared[self.inverse]
        at, key, dealt = self.at[chosen], self.mers[self.at[chosen]], self.keys[self.inverse[chosen]]
        doc = self.doc[at] if len(at) else np.zeros(0, np.int32)
        begin, end = np.maximum(at - self.w + 1, self.off[doc]), np.minimum(at + self.size, self.off[doc + 1])
        mask = np.zeros(len(at), np.uint32)
        for o in range(self.w):
            x = at - o
            inside = (x >= 0) & (x < len(self.least))
            mask |= (inside & (self.least[np.clip(x, 0, max(0, len(self.least) - 1))] == key)).astype(np.uint32) << np.uint32(o) if len(self.least) else np.uint32(0)
        name = R.span_hashes(self.data, begin, end, self.prefix) + (at - begin).astype(U)
        # by key, then by surrounding: equal contexts are neighbours
        order = np.argsort(name)
        order = order[np.argsort(dealt[order], kind="stable")]
        at, key, begin, end, mask, name, doc = (v[order] for v in (at, dealt, begin, end, mask, name, doc))
        new = np.ones(len(at), bool)
        new[1:] = (name[1:] != name[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[doc], first) if len(first) else np.zeros(0, np.int64)
        width = self.w - 1 + self.size
        index = (at[first] - self.w + 1)[:, None] + np.arange(width)
        good = (index >= begin[first][:, None]) & (index < end[first][:, None])
        held = np.where(good, self.data[np.clip(index, 0, max(0, len(self.data) - 1))], 0).astype(np.uint8) if len(first) else np.zeros((0, width), np.uint8)
        return key[first], held, mask[first], least, at, np.diff(np.append(first, len(at)))


    def hot_windows(self, hot: np.ndarray):
        """The different windows of hot anchors: two hashes, least documents, and the places of each."""
        at = np.flatnonzero(self.suspicious(hot)) if hot.any() else np.zeros(0, np.int64)
        h1, h2 = R.span_hashes(self.data, at, at + self.size, self.prefix), R.mix(self.least[at]) >> U(32)
        order = np.argsort(h1)
        if (h2[order][1:] != h2[order][:-1])[h1[order][1:] == h1[order][:-1]].any():
            order = np.lexsort((h2, h1))
        at, h1, h2 = at[order], h1[order], h2[order]
        new = np.ones(len(at), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[self.doc[at]], first) if len(first) else np.zeros(0, np.int64)
        return h1[first], h2[first].astype(np.uint32), least, at, np.diff(np.append(first, len(at)))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, k: int = 24, batch_bytes: int = 3 << 20, hot: int = 8192) -> DataFrame:
    """Remove every byte that a string of `size` bytes covers which also starts in a document of smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, the kept bytes and the removed spans [start, stop).
    """
    if not 8 <= k <= size or size - k >= 32:
        raise ValueError("an anchor has at least 8 bytes and a window under 33 of them")
    staged = stage(docs, id_col, text_col, batch_bytes)
    n, w, width = staged.n_shards, size - k + 1, 2 * size - k
    bits = min(60, max(32, math.ceil(math.log2(staged.n_bytes + 2)) + 7))

    def short(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys at the width that goes to the merge, and which short key each has."""
        cut = keys >> U(64 - bits)
        new = np.ones(len(cut), bool)
        new[1:] = cut[1:] != cut[:-1]
        return cut[new], np.cumsum(new) - 1

    borders = np.array([(s << bits) // n for s in range(1, n)], U)

    def ranges(sorted_keys: np.ndarray):
        """(range, slice) by binary search of the borders."""
        cuts = np.concatenate([[0], np.searchsorted(sorted_keys, borders), [len(sorted_keys)]])
        return ((s, slice(cuts[s], cuts[s + 1])) for s in np.flatnonzero(np.diff(cuts)).tolist())

    def anchors(t: pa.Table) -> pa.Table:
        shard = _Shard(t, size, k)
        keys, which = short(shard.keys)
        times = np.minimum(hot, np.bincount(which, weights=shard.counts, minlength=len(keys))).astype(np.uint32)
        no = t["batch"][0].as_py()
        return X.rows(SENT, [(no, s, X.pack(X.differences(keys[r]), times[r])) for s, r in ranges(keys)])

    def meet(t: pa.Table) -> pa.Table:
        """Which anchors occur in more than one shard, and which of those are hot."""
        parts = [X.unpack(p) for p in t["payload"].to_pylist()]
        keys, times = np.concatenate([X.sums(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        twice = np.diff(np.append(first, len(keys))) > 1
        many = twice & (np.add.reduceat(times[order], first) >= hot)
        flags = np.empty((2, len(keys)), bool)
        flags[:, order] = np.stack([twice, many])[:, group]
        cuts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        return X.rows(SENT, [(b, s, X.pack(flags[0, x:y], flags[1, x:y])) for b, s, x, y in zip(t["batch"].to_pylist(), t["shard"].to_pylist(), cuts, cuts[1:], strict=False)])

    def sort_and_send(a: pa.Table, t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return MIXED.empty_table()
        s, no = _Shard(t, size, k), t["batch"][0].as_py()
        keys, which = short(s.keys)
        across, many = (f[which] for f in _two_flags(a, len(keys)))
        gone = s.repeated(s.suspicious(s.counts > 1)) if len(s.valid) else np.zeros(len(s.data), bool)
        key, held, mask, least, places, counts = s.contexts(across & ~many)
        h1, h2, its_least, its_places, its_counts = s.hot_windows(many)
        low = min((int(x.min()) for x in (least, its_least) if len(x)), default=0)
        out = [(0, no, no % n, X.pack(gone, places.astype(np.uint32), counts.astype(np.uint32), its_places.astype(np.uint32), its_counts.astype(np.uint32)))]
        for r, own in ranges(key >> U(64 - bits)):
            out.append((1, no, r, X.pack(X.differences(key[own]), mask[own], (least[own] - low).astype(U), np.array([low], np.int64), held[own].ravel())))
        for r, own in X.by_shard(X.shard_of(h1, 64, n)):
            out.append((2, no, r, X.pack(X.differences(h1[own]), h2[own], (its_least[own] - low).astype(U), np.array([low], np.int64))))
        return X.rows(MIXED, out)

    def merge(t: pa.Table) -> pa.Table:
        """Which windows of each shard's contexts have a smaller document in another shard."""
        kind = np.asarray(t["kind"])
        passed, sent, split = (t.filter(pa.array(kind == c)) for c in range(3))
        if split.num_rows:
            passed = pa.concat_tables([passed, _least_of_windows(split)])
        if not sent.num_rows:
            return passed
        parts = [X.unpack(p) for p in sent["payload"].to_pylist()]
        key, mask = np.concatenate([X.sums(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
        least = np.concatenate([p[2].astype(np.int64) + p[3][0] for p in parts])
        smaller = np.zeros(len(key), np.uint32)
        # contexts of one key in blocks of bounded bytes: a key's windows meet only each other
        order = np.argsort(key, kind="stable")
        text = np.concatenate([p[4] for p in parts]).reshape(-1, width)
        starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + 20_000, side="right")) - 1)
            own = order[starts[at] : starts[to] if to < len(starts) else len(order)]
            smaller[own] = _smaller(key[own], mask[own], least[own], text[own], size, w)
            at = to
        cuts = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])])
        rows = [(1, b, s, X.pack(smaller[x:y])) for b, s, x, y in zip(sent["batch"].to_pylist(), sent["shard"].to_pylist(), cuts, cuts[1:], strict=False)]
        return pa.concat_tables([passed, X.rows(MIXED, rows)])

    def remove(a: pa.Table, t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return OUT.empty_table()
        t = t.sort_by("seq")
        data, off = R.column_bytes(t["text"])
        kind = np.asarray(a["kind"])
        gone, places, counts, its_places, its_counts = X.unpack(a.filter(pa.array(kind == 0))["payload"][0].as_py())
        got = a.filter(pa.array(kind == 1))
        masks = [X.unpack(p)[0] for _, p in sorted(zip(got["shard"].to_pylist(), got["payload"].to_pylist(), strict=True))]
        mask = np.repeat(np.concatenate(masks) if masks else np.zeros(0, np.uint32), counts)
        for o in range(w):
            gone[places[(mask >> np.uint32(o)) & np.uint32(1) == 1].astype(np.int64) - o] = True
        hit = np.repeat(_gathered(a.filter(pa.array(kind == 2)), len(its_counts)), its_counts)
        gone[its_places[hit]] = True
        gone = R.cover(gone, size, len(gone))
        begin, end = R.runs(gone, off)
        of = np.searchsorted(begin, off).astype(np.int32)
        base = np.repeat(off[:-1], np.diff(of))
        spans = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "stop"]))
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[off[1:]] - total[off[:-1]]
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off - total[off]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        return pa.Table.from_arrays([t["doc_id"].combine_chunks(), pa.array(np.diff(off)), pa.array(removed), pa.array(np.diff(of).astype(np.int64)), kept, spans], schema=OUT)

    table = staged.table
    hits = materialise(table.groupBy("batch").applyInArrow(releasing(anchors), SENT_SQL).groupBy("shard").applyInArrow(releasing(meet), SENT_SQL), "anchors")
    sent = hits.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(releasing(sort_and_send), MIXED_SQL)
    answers = materialise(sent.groupBy("shard").applyInArrow(releasing(merge), MIXED_SQL), "merged")
    return answers.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(releasing(remove), OUT_SQL)


def _two_flags(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both answers of all shards, in the order of the keys."""
    got = [X.unpack(p) for _, p in sorted(zip(t["shard"].to_pylist(), t["payload"].to_pylist(), strict=True))]
    out = tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0, bool) for k in range(2))
    if len(out[0]) != size:
        raise ValueError(f"{len(out[0])} answers for {size} keys")
    return out


def _least_of_windows(t: pa.Table) -> pa.Table:
    """Which windows of hot anchors have a smaller document in another shard."""
    parts = [X.unpack(p) for p in t["payload"].to_pylist()]
    h1, h2 = np.concatenate([X.sums(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    docs = np.concatenate([p[2].astype(np.int64) + p[3][0] for p in parts])
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    out = np.empty(len(order), bool)
    out[order] = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1] < docs[order]
    answered = _answer(t, out, [len(p[0]) for p in parts])
    return pa.Table.from_arrays([t["kind"], *answered.columns], schema=MIXED)


def _smaller(key: np.ndarray, mask: np.ndarray, least: np.ndarray, text: np.ndarray, size: int, w: int) -> np.ndarray:
    """For each context the windows that a context of the same key has too, with a smaller document."""
    rows, offsets = np.nonzero((mask[:, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1))
    begin = rows * text.shape[1] + (w - 1) - offsets
    flat = text.ravel()
    window = R.span_hashes(flat, begin, begin + size)
    home = key[rows] + offsets.astype(U) * U(0x9E3779B97F4A7C15)
    order = np.argsort(window)
    same, kin = window[order][1:] == window[order][:-1], home[order][1:] == home[order][:-1]
    if (same & ~kin).any():
        order = np.lexsort((home, window))
        same, kin = window[order][1:] == window[order][:-1], home[order][1:] == home[order][:-1]
    new = np.concatenate([[True], ~(same & kin)])
    docs = least[rows][order]
    first = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[first < docs]
    out = np.zeros(len(key), np.uint32)
    np.bitwise_or.at(out, rows[hit], np.uint32(1) << offsets[hit].astype(np.uint32))
    return out
