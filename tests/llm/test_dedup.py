import os
import sys
from urllib.parse import unquote, urlparse

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pyarrow as pa
import pytest
from fixtures import components, hostile, order, repeats, shingles, table, words
from hypothesis import given, settings
from hypothesis import strategies as st

from blockwright.llm import line_dedup as LD
from blockwright.llm import near_dedup as ND
from blockwright.llm import rolling as R
from blockwright.llm.line_dedup import line_dedup
from blockwright.llm.near_dedup import near_dedup
from blockwright.llm.storage import in_order, materialise, own_memory, stage
from blockwright.llm.substring_dedup import substring_dedup
from blockwright.llm.suffix_dedup import alike, big_endian_words, kasai, suffix_array, suffix_dedup


def by_text(rows):
    return sorted(rows, key=repr)


def checksum_files(df):
    """Names of such files in the folders of df's files; each costs its writer a process more."""
    folders = {os.path.dirname(unquote(urlparse(f).path)) for f in df.inputFiles()}
    assert folders and all(map(os.path.isdir, folders))
    return [f for d in folders for f in os.listdir(d) if f.endswith(".crc")]


def test_staged_batches_have_no_checksum_files(spark):
    rows = [(d, f"text {d}") for d in range(200)]
    staged = stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch_bytes=100)
    assert checksum_files(staged.table) == [] and len(staged.table.inputFiles()) > 3
    assert sorted(map(tuple, staged.table.select("doc_id", "text").collect())) == rows
    assert staged.n_bytes == sum(len(t) for _, t in rows)


def test_materialised_tables_have_no_checksum_files(spark):
    df = spark.range(1000).selectExpr("id", "cast(id AS string) AS s").repartition(4, "id")
    for codec in ("zstd", "uncompressed"):
        got = materialise(df, "sidecars", codec)
        assert checksum_files(got) == [] and len(got.inputFiles()) == 4
        assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == [(k, str(k)) for k in range(1000)]


def test_substring_dedup_on_a_hostile_table(spark):
    rows = [(r[0], r[1]) for r in hostile()]
    units = [words(t) for _, t in rows]
    want = [(d, len(u), int(g.sum()), " ".join(w for w, x in zip(u, g, strict=True) if not x)) for (d, _), u, g in zip(rows, units, repeats([d for d, _ in rows], units, 13), strict=True)]
    got = substring_dedup(table(spark).repartition(3), batch_bytes=2000).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert by_text(map(tuple, got)) == by_text(want)
    spans = substring_dedup(table(spark)).filter("doc_id = 2").first()["spans"]
    assert [(s["start"], s["stop"]) for s in spans] == [(0, 26)]
    assert substring_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_on_random_repeats(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [[f"v{k}" for k in rng.integers(0, 40, 60)] for _ in range(5)]
    rows = []
    for d in rng.permutation(60):
        parts = []
        for _ in range(rng.integers(1, 5)):
            p = pool[rng.integers(0, 5)]
            a = rng.integers(0, 40)
            parts += p[a : a + rng.integers(3, 30)]
        rows.append((int(d), " ".join(parts)))
    units = [words(t) for _, t in rows]
    want = {d: int(g.sum()) for (d, _), g in zip(rows, repeats([d for d, _ in rows], units, 13), strict=True)}
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=600).collect()}
    assert got == want and sum(want.values()) > 0


def test_suffix_dedup_on_a_hostile_table(spark):
    rows = [(r[0], r[1]) for r in hostile() if r[0] not in (9, 10)] + [(9, "lead " + "mid " * 30 + "tail"), (10, "é" * 55)]
    units = [(t or "").encode() for _, t in rows]
    gone = repeats([d for d, _ in rows], units, 50)
    want = [(d, len(u), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), np.frombuffer(u, np.uint8)[~g].tobytes()) for (d, _), u, g in zip(rows, units, gone, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup(df, batch_bytes=700).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()]
    assert by_text(got) == by_text(want)
    split = suffix_dedup(df, batch_bytes=700, hot=2).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert by_text((r[0], r[1], r[2], r[3], bytes(r[4])) for r in split) == by_text(want)
    assert suffix_dedup(table(spark, [])).count() == 0 and suffix_dedup(table(spark)).count() == len(hostile())


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=300), st.integers(1, 4))
def test_suffix_array_and_common_prefixes(data, lanes):
    t = np.frombuffer(bytes(b % 3 for b in data) + data[:40] * 2, np.uint8)
    b = t.tobytes()
    sa, rank = suffix_array(t)
    assert sa.tolist() == sorted(range(len(b)), key=lambda k: b[k:]) and (rank[sa] == np.arange(len(b))).all()
    common = kasai(t, sa, rank, 50, lanes=lanes)
    for k in range(1, len(b)):
        x, y, n = b[sa[k] :], b[sa[k - 1] :], 0
        while n < min(len(x), len(y), 50) and x[n] == y[n]:
            n += 1
        assert common[k] == n


@pytest.mark.parametrize("size", [8, 13, 50])
def test_a_suffix_array_of_bounded_depth_has_equal_windows_side_by_side(size):
    rng = np.random.default_rng(size)
    part = rng.integers(97, 100, 70, np.uint8)
    t = np.concatenate([rng.integers(97, 99, 300, np.uint8), part, rng.integers(97, 99, 40, np.uint8), part, part[:55], part])
    words = big_endian_words(t)
    sa, _ = suffix_array(t, words, size)
    assert sorted(sa.tolist()) == list(range(len(t)))
    group = np.cumsum(~alike(words, sa, size))
    got, want = {}, {}
    for g, a in zip(group.tolist(), sa.tolist(), strict=True):
        if a + size <= len(t):
            got.setdefault(g, set()).add(a)
            want.setdefault(t[a : a + size].tobytes(), set()).add(a)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(t) - size


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("ab \t\né", max_size=12), max_size=6))
def test_words_of_a_batch(texts):
    data, off = R.column_bytes(pa.array(texts, pa.string()))
    starts, ends, first = R.words(data, off)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(first, first[1:], strict=False)]
    assert got == [words(t) for t in texts]


def lines_by_hand(rows, up=80, down=100):
    """Kept text of each row: a line goes if an earlier line in (id, number) order is similar."""
    flat = sorted(((order(d), k, n, frozenset(words(line, True)), line) for n, (d, t) in enumerate(rows) for k, line in enumerate((t or "").split("\n"))), key=lambda x: x[:3])
    gone = set()
    for i, (d, k, n, s, _) in enumerate(flat):
        for e, j, _, t, _ in flat[:i]:
            if s and t and (e, j) < (d, k) and down * len(s & t) >= up * len(s | t):
                gone.add((n, k))
                break
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if (n, k) not in gone) for n, (_, t) in enumerate(rows)], gone


def test_line_dedup_on_a_hostile_table(spark):
    rows = [(r[0], r[1]) for r in hostile()]
    kept, gone = lines_by_hand(rows)
    got = line_dedup(table(spark).repartition(3), batch_bytes=1500).collect()
    assert by_text((r["doc_id"], r["n_removed"], r["kept_text"]) for r in got) == by_text((d, sum(n == m for m, _ in gone), k) for n, ((d, _), k) in enumerate(zip(rows, kept, strict=True)))
    assert line_dedup(table(spark, [])).count() == 0
    df = table(spark)
    carried = line_dedup(df, carry=True, batch_bytes=1500)
    assert carried.schema == df.schema and carried.filter("doc_id = 0").first()["row"] == "r"
    assert carried.filter("doc_id = 3").count() == 0 and carried.filter("doc_id = 5").count() == 1


@pytest.mark.parametrize(("nearest", "n_words"), [(64, 12), (1, 12), (1, 300)])
def test_line_dedup_variants_with_and_without_room_for_candidates(spark, nearest, n_words):
    rng = np.random.default_rng(nearest)
    base = [f"b{k}" for k in range(n_words)]
    rows = []
    for d in range(60):
        w = list(base)
        for k in rng.choice(n_words, max(1, n_words // rng.integers(8, 30)), replace=False):
            w[k] = f"r{d}x{k}"
        rows.append((d, " ".join(w) + "\n" + " ".join(rng.choice(w, 4, replace=False))))
    _, gone = lines_by_hand(rows)
    got = {(r["doc_id"], k) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), nearest=nearest, most=nearest, block_words=40, batch_bytes=3000).collect() for k in r["removed_lines"]}
    assert got == gone and 0 < len(gone) < 120


def test_rarity_order_is_the_same_with_and_without_wide_keys():
    rng = np.random.default_rng(0)
    line, word, levels = np.sort(rng.integers(0, 50, 3000)), rng.integers(0, 2**63, 400).astype(np.uint64)[rng.integers(0, 400, 3000)], rng.integers(0, 200, 1 << LD.SLOTS).astype(np.uint8)
    a, b = LD._by_rarity(line, word, levels, 50), LD._by_rarity(line, word, levels, 1 << 22)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_classes_are_the_same_with_and_without_wide_keys():
    t = pa.table({"text": ["one\ntwo one\n\n" + "a b c d e f\n" * 3 + "b a", None, "", "one two\nx"]})
    a, b = LD.Lines(t), LD.Lines(t)
    for x in (a, b):
        x.split()
        x.words[2] = x.words[1] ^ np.uint64(1)  # told apart by the low bits alone
    for x, y in zip(a.classes(), b.classes(wide_from=0), strict=True):
        assert (x == y).all()
    c1, _, size = a.classes()
    assert size.tolist() == [1, 2, 0, 6, 6, 6, 2, 0, 0, 2, 1] and len(set(c1[size > 0].tolist())) == 6


def test_queries_meet_all_batches_by_their_rarest_words(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(40)]
    rows = [(d, " ".join(base[k] for k in np.sort(rng.choice(40, 36 + d % 5, replace=False))) + f"\nown{d} line{d}") for d in range(24)]
    staged = stage(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text", 600, LD._summary)
    first = staged.table.groupBy("batch").agg({"seq": "count"}).orderBy("batch").collect()
    assert len(first) > 3
    by = {r["doc_id"]: (r["batch"], r["seq"]) for r in staged.table.collect()}
    wanted = [(by[d][0], 2 * (by[d][1] - min(s for b, s in by.values() if b == by[d][0])), rows[d][1].split("\n")[0]) for d in range(24)]
    _, gone = lines_by_hand(rows)
    levels = np.random.default_rng(6).integers(0, 255, 1 << 20).astype(np.uint8)
    for block_words in (50, 10_000):
        found = LD._against_all(staged.table, spark.createDataFrame(wanted, "x_batch long, x_line int, text string"), levels, 80, 100, block_words)
        got = {(r["x_batch"], r["x_line"]) for r in found.collect()}
        assert got == {wanted[n][:2] for n, k in gone if k == 0} and 0 < len(got) < 24
    assert own_memory() > 0 and in_order(pa.table({"seq": [2, 0, 1]}))["seq"].to_pylist() == [0, 1, 2]


def test_a_document_of_millions_of_lines_meets_the_others(spark):
    rows = [(1, "p q r"), (2, "p q r"), (3, "p q r" + "\n" * (1 << 22) + "p q r s t u")]
    got = {r["doc_id"]: (r["n_removed"], r["n_lines"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", "n_lines").collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (1, (1 << 22) + 1)}


@pytest.mark.parametrize("seed", range(3))
def test_rings_find_what_all_pairs_find(seed):
    rng = np.random.default_rng(seed)
    n = 400
    size = rng.integers(5, 30, n).astype(np.uint32)
    sketches = rng.integers(0, 2**63, (2, 8)).astype(np.uint64)[:, rng.integers(0, 8, n)]
    args = (rng.integers(0, 3, n).astype(np.uint64), np.arange(n), size, np.zeros(n, np.uint32), *sketches, rng.permutation(n), np.zeros(n, np.uint32), np.zeros(n, np.int64), 80, 100)
    full, few = LD._Postings(*args), LD._Postings(*args)
    full.RINGS, few.RINGS, few.HELD, few.LOOKS = (n,), (2, 7), 50, 100

    def named(p, nearest, most):
        x, y, _, more = p.candidates(nearest, most)
        return {(int(p.line[a]), int(p.line[b])) for a, b in zip(x, y, strict=True)}, {int(p.line[a]) for a in x[more]}

    want, none = named(full, n, n)
    assert not none and len(want) > 300
    got, more = named(few, 2, 5)
    assert got <= want and {x for x, _ in want} == {x for x, _ in got}
    assert all(x in more for x, _ in want - got) and all(sum(a == x for a, _ in got) <= 5 for x, _ in want)


@pytest.mark.parametrize(("k", "up"), [(3, 85), (5, 80)])
def test_near_dedup_on_a_hostile_table(spark, k, up):
    rows = [(r[0], r[1]) for r in hostile()]
    want = components(rows, k, up, 100)
    got = near_dedup(table(spark).repartition(3), shingle=k, threshold=(up, 100)).collect()
    assert by_text(map(tuple, got)) == by_text((d, len(shingles(t, k)), want.get(d), d is None or want[d] == d) for d, t in rows)
    assert near_dedup(table(spark, []), shingle=k).count() == 0


def test_near_dedup_chains_and_borders(spark):
    rng = np.random.default_rng(5)
    rows, base = [], [f"b{k}" for k in range(120)]
    for d in range(150):
        w = list(base) if d % 3 else [f"c{d // 30}x{k}" for k in range(60)]
        for at in rng.choice(len(w), rng.integers(0, 5), replace=False):
            w[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((int(1000 - d), " ".join(w)))
    want = components(rows, 3, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=(85, 100)).collect()}
    assert got == want and 1 < len(set(want.values())) < 150


def test_near_dedup_with_colliding_names(spark):
    rows = [(r[0], r[1]) for r in hostile()]
    want = components(rows, 3, 85, 100)
    got = near_dedup(table(spark), shingle=3, threshold=(85, 100), name_bits=2).collect()
    assert by_text(map(tuple, got)) == by_text((d, len(shingles(t, 3)), want.get(d), d is None or want[d] == d) for d, t in rows)


def test_near_dedup_with_buckets_of_unlike_members(spark, monkeypatch):
    monkeypatch.setattr(ND, "CHUNK", 40)
    rng = np.random.default_rng(9)
    rows, base = [], [f"b{k}" for k in range(100)]
    for d in range(400):
        cut = rng.integers(0, 25)
        w = base[: 100 - cut] + [f"n{d}x{k}" for k in range(cut)] if d % 8 else base[:80] + [f"m{d // 80}x{k}" for k in range(20 + d % 3)]
        rows.append((int(d), " ".join(w)))
    want = components(rows, 3, 85, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for enough in (0.7, 0.0):  # 0.0: the last round comes as soon as it can
        got = {r["doc_id"]: r["component_id"] for r in near_dedup(df, shingle=3, threshold=(85, 100), centres=1, enough=enough).collect()}
        assert got == want
    assert len(set(want.values())) > 2


def test_components_both_ways(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2)) if a != b] + [(k, k + 1) for k in range(300, 340)]
    links = spark.createDataFrame(pairs, "a long, b long")
    plain = {r["node"]: r["root"] for r in ND.components(links).collect()}
    assert plain == {r["node"]: r["root"] for r in ND.components(links, 0).collect()}
    assert all(plain[a] == plain[b] for a, b in pairs) and plain[340] == 300


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    t = np.unique(np.concatenate([s[:850], rng.integers(0, 2**63, 150).astype(np.uint64)]))
    both = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
    assert abs((ND.signature(s) == ND.signature(t)).mean() - both) < 0.08
    assert ND.band_rows(0.85) == 7 and (1 - 0.8 ** ND.band_rows(0.8)) ** (ND.COORDINATES // ND.band_rows(0.8)) <= 1e-5
    most = np.minimum(np.frombuffer(ND.sketch(s), np.uint8), np.frombuffer(ND.sketch(t), np.uint8)).sum()
    assert most >= len(np.intersect1d(s, t))
