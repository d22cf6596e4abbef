"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A document's shingle set is hashed into [D]; a first permutation breaks the set's structure and a
second one, circularly shifted by k, gives coordinate k of the signature. Equal sets collapse into a
class before banding, so a group of copies of any size costs one signature's buckets. Buckets never
emit their pairs: each round takes a few members of each bucket as centres, compares them with the
members not yet in their component, and joins what an exact comparison of the full sets confirms.
A bucket is done when its members are in one component or every member outside the largest has been
a centre, so no link between members of one bucket that would join two components is left out.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with
nothing; a text of fewer words than a shingle has one shingle, its whole sequence; a null doc_id is
linked with nothing, its component_id is null and it is kept; repeated rows are one document with
one component; rows of one doc_id with different texts are placed each by its own text; extra columns are not read; an empty table gives an empty result. Shingles compare
by 64-bit hashes, equal sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .storage import clean, materialise, release, shuffle_partitions, small_arrow_batches

U = np.uint64
BITS = 22
COORDINATES = 252
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
CELLS = 256
#: Sets beyond this size aren't pruned by sketch, whose counts end at 255.
SKETCHED = 20_000
CHUNK = 1024
SIGNED_SQL = "doc_id long, n_shingles long, name long, check long, bands array<long>, sketch binary"


def shingle_sets(col, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = R.column_bytes(col)
    data = R.translated(data, R.LOWER)
    starts, ends, first = R.words(data, off)
    values = R.word_hashes(data, starts, ends)
    hashes = R.word_windows(values, k)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        else:
            out.append(R.word_windows(values[a:b], b - a) + U(b - a) if b > a else hashes[:0])
    return out


def class_of(s: np.ndarray, name_bits: int = 64) -> tuple[int, int]:
    """A name of a set and a check, 64 bits each."""
    total = np.array([R.mix(s).sum(dtype=U), R.mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U), U(len(s))], U)
    name, check = R.word_windows(total, 3)[0], R.word_windows(total, 3, True)[0]
    return int((name >> U(64 - name_bits)).astype(np.int64)), int(check.astype(np.int64))


def tables(bits: int = BITS, coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(first permutation, all circular shifts of the second as rows of a view)."""
    if bits not in _TABLES:
        rng = np.random.default_rng(bits)
        one, two = (rng.permutation(1 << bits).astype(np.uint32) for _ in range(2))
        ring = np.concatenate([two, two[: coordinates - 1]])
        _TABLES[bits] = one, np.lib.stride_tricks.sliding_window_view(ring, coordinates)
    return _TABLES[bits]


def done_signing() -> None:
    """Free the tables in this process; a module function, so that no closure carries them along."""
    _TABLES.clear()
    release()


def signature(s: np.ndarray) -> np.ndarray:
    one, shifts = tables()
    at = one[(s & U((1 << BITS) - 1)).astype(np.int64)]
    out = shifts[at[:256]].min(0)
    for k in range(256, len(at), 256):
        np.minimum(out, shifts[at[k : k + 256]].min(0), out=out)
    return out


def band_rows(threshold: float, miss: float = 1e-5) -> int:
    """The longest band with which a pair at the threshold shares no bucket with probability `miss` at most."""
    return max(r for r in range(1, 13) if r == 1 or (1 - threshold**r) ** (COORDINATES // r) <= miss)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    n, b = len(signatures), COORDINATES // rows
    cut = signatures[:, : b * rows].reshape(n, b, rows).astype(U)
    h = np.broadcast_to(np.arange(b, dtype=U), (n, b)).copy()
    for k in range(rows):
        h = h * U(0xD6E8FEB86659FD93) + cut[:, :, k] + U(1)
    return R.mix(h).astype(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each of CELLS cells; the sum of two sets' lesser counts bounds their overlap."""
    return np.minimum(np.bincount((s >> U(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _named(names: list[tuple[int, int] | None]) -> list[pa.Array]:
    return [pa.array([None if n is None else n[k] for n in names], pa.int64()) for k in range(2)]


def _identified(df: DataFrame, mixed: DataFrame | None) -> DataFrame:
    """name and check as class_id: the name, but where different sets share a name one of both."""
    if mixed is None:
        return df.withColumnRenamed("name", "class_id").drop("check")
    both = df.join(mixed.select("name", F.lit(True).alias("is_mixed")), "name", "left")
    return both.withColumn("class_id", F.when(F.col("is_mixed"), F.xxhash64("name", "check")).otherwise(F.col("name"))).drop("name", "check", "is_mixed")


def _sign(docs: DataFrame, k: int, rows: int, name_bits: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, known = shingle_sets(b.column(1), k), {}
            names, bands, sketches = [], [], []
            for s in sets:
                name = class_of(s, name_bits) if len(s) else None
                if name is not None and name not in known:
                    known[name] = len(known)
                    bands.append(signature(s))
                    sketches.append(sketch(s))
                names.append(name)
            keys = band_keys(np.array(bands), rows).tolist() if bands else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *_named(names), pa.array([None if n is None else keys[known[n]] for n in names], pa.list_(pa.int64())), pa.array([None if n is None else sketches[known[n]] for n in names], pa.binary())], ["doc_id", "n_shingles", "name", "check", "bands", "sketch"])
        done_signing()

    return docs.mapInArrow(sign, SIGNED_SQL)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    up, down = threshold

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, dict[int, np.ndarray]] = {}
            for side in ("a", "b"):
                names = np.asarray(batch.column(side))
                some, first = np.unique(names, return_index=True)
                held[side] = dict(zip(some.tolist(), shingle_sets(batch.column(f"text_{side}").take(pa.array(first)), k), strict=True))
            ok = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = held["a"][a], held["b"][b]
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(down * both >= up * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    left = pairs.join(texts.select(F.col("class_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(verify, "a long, b long").distinct()


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of edges, by least labels and pointer jumping; a root is its component's least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b]):
            np.minimum.at(new, side, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame, in_task: int = 2_000_000) -> DataFrame:
    """(node, root) of linked nodes; roots are least nodes.

    Up to `in_task` links are joined in one task, which that number bounds. More go through alternating
    large-star and small-star steps.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            nodes, roots = connected(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    if links.count() <= in_task:
        return links.select("a", "b").coalesce(1).mapInArrow(local, "node long, root long")
    return stars(links)


def stars(links: DataFrame) -> DataFrame:
    edges, before = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges"), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def _close_pairs(state: DataFrame, centres: DataFrame, sketches: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of a centre and a member of its bucket, in other components, whose sketches allow the threshold.

    A bucket's members are cut into chunks of about CHUNK, and so are its centres; each chunk of the one
    meets each of the other, so no task gets a whole hot bucket. A meeting's pairs are looked at in arrays
    and only those that the bound leaves come out.
    """
    up, down = threshold
    n = shuffle_partitions(state.sparkSession)
    counted = centres.groupBy("key").agg(F.count("*").alias("c"))
    across, down_ = F.ceil(F.col("m") / CHUNK), F.ceil(F.col("c") / CHUNK)

    def chunk(own, its, own_no) -> list:
        mine = F.pmod(F.xxhash64("class_id", "key"), own)
        other = F.explode(F.sequence(F.lit(0).cast("long"), its - 1))
        return [mine, other] if own_no == 0 else [other, mine]

    def cut(df: DataFrame, kind: int) -> DataFrame:
        row, column = chunk(across, down_, 0) if kind == 0 else chunk(down_, across, 1)
        both = df.join(counted, "key").select("key", "class_id", "root", "n", row.alias("row"), column.alias("col"))
        return both.select("key", F.concat_ws("/", "row", "col").alias("chunk"), F.lit(kind).alias("centre"), "class_id", "root", "n")

    member, centre = cut(state, 0), cut(centres, 1)
    rows = member.unionAll(centre).join(sketches, "class_id").select("key", "chunk", "centre", "class_id", "root", "n", "sketch")

    def compare(held: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = held["centre"].to_numpy()
        name, root, size = (held[c].to_numpy() for c in ("class_id", "root", "n"))
        cells = np.frombuffer(b"".join(held["sketch"].to_pylist()), np.uint8).reshape(-1, CELLS)
        members = np.flatnonzero(kind == 0)
        out = []
        for c in np.flatnonzero(kind == 1):
            m = members[root[members] != root[c]]
            m = m[np.minimum(size[m], size[c]) * down >= np.maximum(size[m], size[c]) * up]
            most = np.minimum(cells[m], cells[c]).sum(1, dtype=np.int64)
            m = m[(down * most >= up * (size[m] + size[c] - most)) | (np.maximum(size[m], size[c]) > SKETCHED)]
            out.append(np.stack([np.minimum(name[m], name[c]), np.maximum(name[m], name[c])]))
        if out and sum(o.shape[1] for o in out):
            a, b = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            key, chunk = b.column(0).to_numpy(), np.asarray(b.column(1).to_pylist(), object)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y == x:
                    continue
                if rest and (rest[-1].column(0)[0].as_py(), rest[-1].column(1)[0].as_py()) != (int(key[x]), chunk[x]):
                    yield from compare(pa.Table.from_batches(rest))
                    rest = []
                rest.append(b.slice(x, y - x))
        if rest:
            yield from compare(pa.Table.from_batches(rest))

    return rows.repartition(n, "key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(walk, "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100), centres: int = 2, enough: float = 0.7, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document row; threshold is a fraction.

    A round takes up to `centres` members of each bucket. When a round leaves more than `enough` of the
    members outside their bucket's main component there, the last round takes all of those as centres.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark, 256)
    source, rows = clean(docs, id_col, text_col), band_rows(threshold[0] / threshold[1])
    signed = materialise(_sign(source, shingle, rows, name_bits), "signatures")
    known = signed.filter("name IS NOT NULL AND doc_id IS NOT NULL")
    # sets are told apart by 128 bits: where two share a name, both go by a name of their own
    mixed = materialise(known.groupBy("name").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a != b").select("name"), "mixed")
    mixed = None if mixed.isEmpty() else mixed
    classes = materialise(_identified(known, mixed).groupBy("class_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    entries = classes.select("class_id", "rep", "n", F.explode("bands").alias("key"))
    full = entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = materialise(entries.join(full.select("key"), "key"), "members")
    involved = members.select("rep").distinct()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [class_of(s, name_bits) if len(s) else None for s in shingle_sets(b.column(0), shingle)]
            yield pa.RecordBatch.from_arrays([*_named(names), b.column(0)], ["name", "check", "text"])
        release()

    texts = materialise(_identified(source.join(involved, source.doc_id == involved.rep, "left_semi").select("text").mapInArrow(named, "name long, check long, text string"), mixed), "texts")
    sketches = classes.select("class_id", "sketch")
    rooted, links, tested, done, outside_before = None, None, None, None, None
    left, turn = members.select("key", "class_id", "n"), 0
    while True:
        last = False
        if rooted is None:
            # all components still are single documents; the same order in all buckets, so a group meets around few centres
            state = left.withColumn("root", F.col("class_id"))
            chosen = state.join(_least(state, F.xxhash64("class_id"), 1), ["key", "class_id"], "left_semi")
        else:
            state = left.join(rooted.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
            sizes = state.groupBy("key", "root").agg(F.count("*").alias("c"))
            split = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("roots")).filter("roots > 1").select("key", "main", "m")
            state = materialise(state.join(split, "key"), "state")
            outside = materialise(state.filter("root != main").join(done, ["key", "class_id"], "left_anti"), "outside")
            now = outside.count()
            if not now:
                break
            last = outside_before is not None and now > enough * outside_before
            outside_before = now
            chosen = outside if last else outside.join(_least(outside, F.xxhash64("class_id", "key", F.lit(turn)), centres), ["key", "class_id"], "left_semi")
        if last:
            pairs = _close_pairs(state, chosen, sketches, threshold)
        else:
            chosen = materialise(chosen.select("key", F.col("class_id").alias("c"), F.col("root").alias("c_root"), F.col("n").alias("c_n")), "centres")
            pairs = chosen.join(state, "key").filter((F.col("root") != F.col("c_root")) & (F.least("n", "c_n") * threshold[1] >= F.greatest("n", "c_n") * threshold[0]))
            pairs = pairs.select(F.least("c", "class_id").alias("a"), F.greatest("c", "class_id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        found = materialise(_verified(pairs, texts, shingle, threshold), "links")
        tested = pairs if tested is None else tested.unionAll(pairs)
        links = found if links is None else links.unionAll(found)
        rooted = materialise(components(links), "roots")
        if last:
            break
        own = chosen.select("key", F.col("c").alias("class_id"))
        done = own if done is None else done.unionAll(own)
        left, turn = state.select("key", "class_id", "n"), turn + 1
    named_roots = classes.select("class_id", "rep")
    if rooted is not None:
        at = named_roots.join(rooted.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
        named_roots = at.join(at.groupBy("root").agg(F.min("rep").alias("least")), "root").select("class_id", F.col("least").alias("rep"))
    placed = _identified(signed.select("doc_id", "n_shingles", "name", "check"), mixed).withColumn("class_id", F.expr("if(doc_id IS NULL, NULL, class_id)")).join(named_roots, "class_id", "left")
    component = F.coalesce("rep", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _least(outside: DataFrame, order, n: int) -> DataFrame:
    """Up to n members of each bucket with the least order, by partial aggregation."""
    out, rest = None, outside.select("key", "class_id", order.alias("o"))
    for _ in range(n):
        one = rest.groupBy("key").agg(F.min_by("class_id", "o").alias("class_id"))
        out = one if out is None else out.unionAll(one)
        rest = rest.join(one, ["key", "class_id"], "left_anti")
    return out
