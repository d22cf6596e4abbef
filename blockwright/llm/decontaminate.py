"""Benchmark decontamination over a distributed positional inverted index.

The index is dealt out by documents: each shard stores, for about three megabytes of text, the sorted
terms of its documents and every term's positions. Test windows go to all shards in blocks of bounded
size (a stated query set, not a join); inside a shard a window starts from its locally rarest term,
and the offset-adjusted lists of the other terms, rarest first, are intersected with what is left.
All terms are looked at, so a phrase match is exact in 64-bit term hashes. Nothing is shuffled.

Defined cases: null or empty texts have no words (a document of none is clean, an item of none matches
nothing); an item shorter than the window is one window of all its words; a null item_id counts as
the name "null"; repeated items count once; extra columns are not read; empty tables give empty
results or clean documents.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import rolling as R
from .storage import arrow_schema, clean, from_ipc, materialise, release, small_arrow_batches, to_ipc, with_text

U = np.uint64
INDEX_SQL = "shard long, payload binary"
SPAN = pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
FOUND = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(SPAN))])
FOUND_SQL = "shard long, place int, doc_id long, n_words long, spans array<struct<item:string,start:int,stop:int>>"
REPORT_SQL = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<item:string,start:int,stop:int>>"
MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
MATCH_SQL = "doc_id long, item_id string, kind string, start int, stop int"


def _terms(col) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, first word of each text)."""
    data, off = R.column_bytes(col)
    data = R.translated(data, R.LOWER)
    starts, ends, first = R.words(data, off, R.NON_ALNUM)
    return R.word_hashes(data, starts, ends), first


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 3 << 20, carry: bool = False) -> DataFrame:
    """Store the postings of all training tokens; one row per shard of documents. carry: with the documents themselves."""
    small_arrow_batches(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                piece = b.slice(at, 64)
                held.append(piece)
                size += int(R.column_bytes(piece.column(1))[1][-1])
                if size >= shard_bytes:
                    yield _shard((part << 32) + no, pa.Table.from_batches(held))
                    no, held, size = no + 1, [], 0
        if held:
            yield _shard((part << 32) + no, pa.Table.from_batches(held))
        held = []
        release()

    return materialise(clean(docs, id_col, text_col, carry).mapInArrow(shards, INDEX_SQL + ", rows binary" * carry), "postings", "uncompressed")


def _shard(no: int, t: pa.Table) -> pa.RecordBatch:
    values, first = _terms(t["text"])
    order = np.argsort(values)
    new = np.ones(len(order), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    group = (np.cumsum(new) - 1).astype(U)
    places = np.sort((group << U(32)) | order.astype(U)) & U(0xFFFFFFFF)
    ids, known = t["doc_id"].fill_null(0).to_numpy(), np.asarray(t["doc_id"].is_valid())
    # positions as differences from the one before; where a new list begins, the wrapped difference still adds up
    payload = X.pack(ids, known, np.diff(first).astype(np.uint32), X.differences(values[order][new]), np.diff(np.append(np.flatnonzero(new), len(order))).astype(np.uint32), np.diff(places.astype(np.uint32), prepend=np.uint32(0)))
    rows = [pa.array([to_ipc(t)], pa.binary())] if "row" in t.column_names else []
    return pa.RecordBatch.from_arrays([pa.array([no]), pa.array([payload], pa.binary()), *rows], ["shard", "payload", "rows"][: 2 + len(rows)])


class _Postings:
    def __init__(self, payload: bytes):
        self.ids, self.known, sizes, deltas, counts, places = X.unpack(payload)
        self.terms, self.counts = X.sums(deltas), counts.astype(np.int64)
        self.places = np.cumsum(places, dtype=np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        self.lists = np.concatenate([[0], np.cumsum(self.counts)])
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts).astype(U) << U(32)) | self.places.astype(U)

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """The list number of each term, or -1."""
        at = np.searchsorted(self.terms, terms)
        if not len(self.terms):
            return np.full(len(terms), -1)
        return np.where(self.terms[np.minimum(at, len(self.terms) - 1)] == terms, at, -1)

    def open(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, places): all postings of each list."""
        n = self.counts[lists]
        which = np.repeat(np.arange(len(lists)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which, self.places[self.lists[lists][which] + inner]

    def has(self, lists: np.ndarray, places: np.ndarray) -> np.ndarray:
        key = (lists.astype(U) << U(32)) | places.astype(U)
        at = np.searchsorted(self.keys, key)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == key

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence of the rows of term hashes."""
        size = windows.shape[1]
        lists = self.lookup(windows.ravel()).reshape(windows.shape)
        alive = np.flatnonzero((lists >= 0).all(1))
        if not len(alive):
            return alive, alive
        lists = lists[alive]
        rank = np.argsort(self.counts[lists], axis=1, kind="stable")
        rows = np.arange(len(alive))
        which, places = self.open(lists[rows, rank[:, 0]])
        starts = places - rank[which, 0]
        for k in range(size):
            if k == 0:
                ok = starts >= 0
            else:
                ok = self.has(lists[which, rank[which, k]], starts + rank[which, k])
            which, starts = which[ok], starts[ok]
        doc = np.searchsorted(self.first, starts, side="right") - 1
        ok = starts + size <= self.first[doc + 1]
        return alive[which[ok]], starts[ok]

    def near(self, windows: np.ndarray, span: int) -> list[tuple[int, int, int]]:
        """(window, start, stop): the shortest stretches of at most span words around the rarest term with all terms in any order."""
        lists = self.lookup(windows.ravel()).reshape(windows.shape)
        out = []
        for w in np.flatnonzero((lists >= 0).all(1)):
            own = np.unique(lists[w])
            own = own[np.argsort(self.counts[own], kind="stable")]
            places = self.places[self.lists[own[0]] : self.lists[own[0] + 1]]
            doc = np.searchsorted(self.first, places, side="right") - 1
            low, high = np.maximum(places - span + 1, self.first[doc]), np.minimum(places + span, self.first[doc + 1])
            ok = np.ones(len(places), bool)
            for x in own[1:]:
                held = self.places[self.lists[x] : self.lists[x + 1]]
                ok &= np.searchsorted(held, high) > np.searchsorted(held, low)
            for p, a, b in zip(places[ok], low[ok], high[ok], strict=True):
                if best := self._shortest(own, int(p), int(a), int(b), span):
                    out.append((int(w), *best))
        return out

    def _shortest(self, own: np.ndarray, p: int, low: int, high: int, span: int) -> tuple[int, int] | None:
        held = []
        for x in own:
            h = self.places[self.lists[x] : self.lists[x + 1]]
            held.append(h[np.searchsorted(h, low) : np.searchsorted(h, high)])
        best = None
        for a in sorted({int(v) for h in held for v in h if v <= p}):
            nexts = [h[np.searchsorted(h, a)] if np.searchsorted(h, a) < len(h) else None for h in held]
            if any(v is None for v in nexts):
                break
            b = max(p, int(max(nexts)))
            if b - a < span and (best is None or b - a + 1 < best[1] - best[0]):
                best = (a, b + 1)
        return best


class Tests:
    """A block of items as windows of term hashes, by window length, and who owns each."""

    def __init__(self, names: list[str], texts: list[str], window: int):
        values, first = _terms(pa.array(texts, pa.string()))
        owners: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, a, b in zip(names, first, first[1:], strict=False):
            size = min(window, int(b - a))
            for at in range(a, b - size + 1) if size else ():
                owners[size][values[at : at + size].tobytes()].add(name)
        self.groups = [(size, np.frombuffer(b"".join(own), U).reshape(len(own), size), [sorted(x) for x in own.values()]) for size, own in sorted(owners.items())]


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Tests]:
    """Items in blocks of at most block_bytes of text (a longer item is a block), streamed through the driver."""
    names, texts, size = [], [], 0
    for r in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("n"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).toLocalIterator():
        names.append(r["n"])
        texts.append(r["t"])
        size += len(r["t"])
        if size >= block_bytes:
            yield Tests(names, texts, window)
            names, texts, size = [], [], 0
    yield Tests(names, texts, window)


def _spans(p: _Postings, tests: Tests) -> list[tuple[int, str, int, int]]:
    """(document, item, start, stop) with overlapping windows of an item merged; places within the document."""
    found: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
    for size, windows, owners in tests.groups:
        which, starts = p.phrases(windows)
        doc = np.searchsorted(p.first, starts, side="right") - 1
        for w, s, d in zip(which.tolist(), (starts - p.first[doc]).tolist(), doc.tolist(), strict=True):
            for name in owners[w]:
                found[d, name].append((s, s + size))
    out = []
    for (d, name), spans in found.items():
        out += [(d, name, a, b) for a, b in _merged(spans)]
    return sorted(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _found(index: DataFrame, tests: Tests) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(tests)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = _Postings(payload)
                spans = [[] for _ in p.ids]
                for d, name, x, y in _spans(p, shared.value):
                    spans[d].append({"item": name, "start": x, "stop": y})
                n = len(p.ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, no)), pa.array(np.arange(n, dtype=np.int32)), pa.array(p.ids, mask=~p.known), pa.array(np.diff(p.first)), pa.array(spans, pa.list_(SPAN))], schema=FOUND)
        release()

    return index.mapInArrow(scan, FOUND_SQL)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """A report per document: its words, hit words, items found (with their digest) and the hit spans of each item.

    Items beyond block_bytes of text are looked up block by block in the stored index, and the spans
    of a document are then brought together by its place in the index.
    """
    index = build_index(docs, id_col, text_col)
    parts = [_found(index, tests) for tests in _blocks(items, item_col, item_text, window, block_bytes)]
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionAll(p)
        found = found.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, items = [], []
            for spans in b.column("spans").to_pylist():
                hits.append(sum(y - x for x, y in _merged([(s["start"], s["stop"]) for s in spans])))
                items.append(sorted({s["item"] for s in spans}))
            names = ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_()), b.column("spans")], names)

    return found.mapInArrow(report, REPORT_SQL)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The input rows that hold no window of any item."""
    schema = arrow_schema(docs)
    left = build_index(docs, id_col, text_col, carry=True).select("payload", "rows", F.lit(None).cast("binary").alias("hit"))
    for tests in _blocks(items, item_col, item_text, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = []
                for payload, before in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    p = _Postings(payload)
                    hit = np.zeros(len(p.ids), bool) if before is None else X.unpack(before)[0]
                    for size, windows, _ in shared.value.groups:
                        hit[np.searchsorted(p.first, p.phrases(windows)[1], side="right") - 1] = True
                    hits.append(X.pack(hit))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.binary())], ["payload", "rows", "hit"])
            release()

        left = left.mapInArrow(mark, "payload binary, rows binary, hit binary")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, hit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = from_ipc(rows)
                yield from with_text(t, t["text"].combine_chunks(), text_col, schema).filter(pa.array(~X.unpack(hit)[0])).to_batches()
        release()

    return left.select("rows", "hit").mapInArrow(kept, docs.schema)


def matches(index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = 10, slop: int | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """All phrase matches, and with slop also proximity matches: all terms of a window, in any order, within its length plus slop words."""
    out = None
    for tests in _blocks(items, item_col, item_text, window, block_bytes):
        shared = index.sparkSession.sparkContext.broadcast(tests)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for payload in b.column(1).to_pylist():
                    p, got = _Postings(payload), []
                    ids = [i if k else None for i, k in zip(p.ids.tolist(), p.known.tolist(), strict=True)]
                    for size, windows, owners in shared.value.groups:
                        for w, s in zip(*(x.tolist() for x in p.phrases(windows)), strict=True):
                            got += [(s, s + size, name, "phrase") for name in owners[w]]
                        for w, s, e in p.near(windows, size + slop) if slop is not None else ():
                            got += [(s, e, name, "proximity") for name in owners[w]]
                    got = sorted(set(got))
                    doc = np.searchsorted(p.first, [g[0] for g in got], side="right") - 1
                    rows = [(ids[d], name, kind, int(s - p.first[d]), int(e - p.first[d])) for d, (s, e, name, kind) in zip(doc, got, strict=True)]
                    yield from X.rows(MATCH, rows).to_batches()

        part = index.mapInArrow(scan, MATCH_SQL)
        out = part if out is None else out.unionAll(part)
    return out
