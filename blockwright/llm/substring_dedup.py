"""Substring deduplication by fixed-block anchors.

A window of 13 words holds at least one of its document's aligned 7-word blocks whole. So the index
holds non-overlapping blocks only, every rolling 7-word window probes it, and only windows around a
hit are looked at further. Hits are extended to all 13-word windows that hold them; the least
document of each such window decides, and covering windows merge into maximal repeated spans. No
pair of documents is ever formed: each batch sends a window once with its least document and gets
back one bit, so a group of any number of copies costs each batch the same.

Defined cases: a null or empty text has no words and is returned with an empty kept text; fewer than
13 words are kept whole; rows that repeat a doc_id are no smaller than each other, so neither removes
the other; a null doc_id sorts after all others; extra columns are not read; an empty table gives an
empty result. Windows compare by 96 bits of hash across batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import rolling as R
from .storage import materialise, releasing, stage

U = np.uint64
LAST = np.iinfo(np.int64).max
SENT = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])
SENT_SQL = "batch long, shard int, payload binary"
OUT_SQL = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,stop:int>>"


class _Batch:
    """The words of a batch, its 7-word probes and which of them are index blocks."""

    def __init__(self, t: pa.Table, window: int, bits: int):
        self.ids = t["doc_id"].to_numpy()
        if t["doc_id"].null_count:
            self.ids = np.array([LAST if x is None else x for x in t["doc_id"].to_pylist()], np.int64)
        self.null = np.asarray(t["doc_id"].combine_chunks().is_null()) if t["doc_id"].null_count else None
        self.window, self.block = window, (window + 1) // 2
        self.data, self.off = R.column_bytes(t["text"])
        self.starts, self.ends, self.first = R.words(self.data, self.off)
        self.values = R.word_hashes(self.data, self.starts, self.ends)
        long = np.repeat(np.diff(self.first) >= window, np.diff(self.first))
        probe = R.word_windows(self.values, self.block)
        self.at = np.flatnonzero(R.whole_windows(self.first, self.block) & long[: len(probe)])
        self.keys, self.inverse = np.unique(probe[self.at] >> U(64 - bits), return_inverse=True)
        place = np.arange(len(self.values)) - np.repeat(self.first[:-1], np.diff(self.first))
        self.indexed = np.zeros(len(self.keys), bool)
        self.indexed[self.inverse[place[self.at] % self.block == 0]] = True

    def windows(self, answers: np.ndarray):
        """Windows of the batch by class: sorted keys, least document, places, which hold a shared block."""
        whole = R.whole_windows(self.first, self.window)
        at = np.flatnonzero(whole)
        if not len(at):
            return (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        h1, h2 = R.word_windows(self.values, self.window)[at], R.word_windows(self.values, self.window, True)[at] >> U(32)
        order = np.argsort(h1)
        new = np.ones(len(order), bool)
        new[1:] = h1[order][1:] != h1[order][:-1]
        group = np.cumsum(new) - 1
        docs = self.ids[R.doc_of(self.first)[at]]
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
        hit = np.zeros(len(self.values) + 1, np.int64)
        hit[self.at] = answers[self.inverse]
        total = np.concatenate([[0], np.cumsum(hit)])
        shared = total[at + self.window - self.block + 1] > total[at]
        some = np.logical_or.reduceat(shared[order], np.flatnonzero(new))
        return h1[order][new], h2[order][new], least, at[order], group, some


def _gathered(t: pa.Table, size: int) -> np.ndarray:
    """The answers of all shards, in the order of the keys."""
    got = sorted(zip(t["shard"].to_pylist(), t["payload"].to_pylist(), strict=True))
    flags = [X.unpack(p)[0] for _, p in got]
    out = np.concatenate(flags) if flags else np.zeros(0, bool)
    if len(out) != size:
        raise ValueError(f"{len(out)} answers for {size} keys")
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, batch_bytes: int = 3 << 20) -> DataFrame:
    """Remove every word that a window of `window` words covers whose words also start in a document of smaller id.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and spans, the
    maximal removed runs as word places [start, stop).
    """
    staged = stage(docs, id_col, text_col, batch_bytes)
    n = staged.n_shards
    bits = min(60, max(32, math.ceil(math.log2(staged.n_bytes + 2)) + 7))

    def probes(t: pa.Table) -> pa.Table:
        no, b = t["batch"][0].as_py(), _Batch(t, window, bits)
        return X.rows(SENT, [(no, s, X.pack(X.differences(b.keys[k]), b.indexed[k])) for s, k in X.by_shard(X.shard_of(b.keys, bits, n))])

    def meet(t: pa.Table) -> pa.Table:
        """Which probes are an index block's and occur in more than one batch."""
        parts = [X.unpack(p) for p in t["payload"].to_pylist()]
        keys, indexed = np.concatenate([X.sums(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        cuts = np.flatnonzero(new)
        shared = np.logical_or.reduceat(indexed[order], cuts) & (np.diff(np.append(cuts, len(keys))) > 1)
        out = np.empty(len(keys), bool)
        out[order] = shared[np.cumsum(new) - 1]
        return _answer(t, out, [len(p[0]) for p in parts])

    def candidates(a: pa.Table, t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return SENT.empty_table()
        b = _Batch(t, window, bits)
        h1, h2, least, _, _, some = b.windows(_gathered(a, len(b.keys)))
        h1, h2, least = h1[some], h2[some], least[some]
        low = least.min() if len(least) else 0
        away, no = (least - low).astype(U), t["batch"][0].as_py()
        return X.rows(SENT, [(no, s, X.pack(X.differences(h1[k]), h2[k].astype(np.uint32), away[k], np.array([low], np.int64))) for s, k in X.by_shard(X.shard_of(h1, 64, n))])

    def least_documents(t: pa.Table) -> pa.Table:
        """Which windows have a smaller document in another batch."""
        parts = [X.unpack(p) for p in t["payload"].to_pylist()]
        h1, h2 = np.concatenate([X.sums(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
        docs = np.concatenate([p[2].astype(np.int64) + p[3][0] for p in parts])
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out = np.empty(len(order), bool)
        out[order] = least < docs[order]
        return _answer(t, out, [len(p[0]) for p in parts])

    def remove(a: pa.Table, t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return OUT.empty_table()
        b = _Batch(t, window, bits)
        kind = np.asarray(a["kind"])
        h1, _, least, at, group, some = b.windows(_gathered(a.filter(pa.array(kind == 0)), len(b.keys)))
        smaller = np.zeros(len(h1), bool)
        smaller[some] = _gathered(a.filter(pa.array(kind == 1)), int(some.sum()))
        gone = np.zeros(len(b.values), bool)
        gone[at] = (smaller[group]) | (least[group] < b.ids[R.doc_of(b.first)[at]])
        gone = R.cover(gone, window, len(gone))
        sums = np.concatenate([[0], np.cumsum(gone)])
        begin, end = R.runs(gone, b.first)
        doc = R.doc_of(b.first)[begin]
        of = np.searchsorted(begin, b.first).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays([pa.array((begin - b.first[doc]).astype(np.int32)), pa.array((end - b.first[doc]).astype(np.int32))], ["start", "stop"]))
        kept = R.keep_words(b.data, b.off, b.starts, b.ends, b.first, ~gone)
        return pa.Table.from_arrays([pa.array(b.ids, mask=b.null), pa.array(np.diff(b.first).astype(np.int64)), pa.array((sums[b.first[1:]] - sums[b.first[:-1]]).astype(np.int64)), kept, spans], schema=OUT)

    table = staged.table
    hits = materialise(table.groupBy("batch").applyInArrow(releasing(probes), SENT_SQL).groupBy("shard").applyInArrow(releasing(meet), SENT_SQL), "anchors")
    sent = hits.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(releasing(candidates), SENT_SQL)
    smaller = materialise(sent.groupBy("shard").applyInArrow(releasing(least_documents), SENT_SQL), "windows")
    answers = hits.selectExpr("0 kind", "*").unionAll(smaller.selectExpr("1 kind", "*"))
    return answers.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(releasing(remove), OUT_SQL)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _answer(t: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return X.rows(SENT, [(b, s, X.pack(flags[x:y])) for b, s, x, y in zip(t["batch"].to_pylist(), t["shard"].to_pylist(), cuts, cuts[1:], strict=False)])
