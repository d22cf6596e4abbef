import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwright.functions import bytes as B
from blockwright.functions import scalars as S
from blockwright.operators import candidates as C
from blockwright.operators import features as FE
from blockwright.operators import pixels as P
from blockwright.operators import rdcurve as RD
from blockwright.operators import residual as R
from blockwright.operators import rollout as RO
from blockwright.operators import tiling as T
from blockwright.operators.codec import block_features


def plane(spark, a, image=0):
    return spark.createDataFrame([(image, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id int, y int, x int, v double")


def leaves_by_hand(y, lo, hi, tv, tg):
    """Depth-first leaves of a quadtree, with unconditional halving of a long side."""
    out = []

    def visit(a, b, w, h):
        if w <= lo and h <= lo:
            return out.append((a, b, w, h))
        if (w >= 2 * lo) != (h >= 2 * lo):
            parts = [(a, b, w // 2, h), (a + w // 2, b, w - w // 2, h)] if w >= 2 * lo else [(a, b, w, h // 2), (a, b + h // 2, w, h - h // 2)]
            return [visit(*p) for p in parts]
        s = y[b : b + h, a : a + w]
        busy = s.var() >= tv or (np.abs(np.diff(s, axis=1))[:-1] + np.abs(np.diff(s, axis=0))[:, :-1]).mean() >= tg if min(w, h) > 1 else False
        if w <= lo or h <= lo or not busy:
            return out.append((a, b, w, h))
        for j, hh in ((0, h // 2), (h // 2, h - h // 2)):
            for i, ww in ((0, w // 2), (w // 2, w - w // 2)):
                visit(a + i, b + j, ww, hh)

    for b in range(0, y.shape[0], hi):
        for a in range(0, y.shape[1], hi):
            visit(a, b, min(hi, y.shape[1] - a), min(hi, y.shape[0] - b))
    return out


@pytest.mark.parametrize(("h", "w"), [(32, 32), (40, 23), (9, 50)])
def test_quadtree_on_ragged_images(spark, h, w):
    rng = np.random.default_rng(h)
    a = rng.random((h, w)) * np.kron(rng.random((-(-h // 8), -(-w // 8))) < 0.5, np.ones((8, 8)))[:h, :w]
    got = [tuple(r) for r in T.quadtree(plane(spark, a), 4, 16, 0.02, 0.3).orderBy("leaf_no").select("x", "y", "w", "h").collect()]
    assert got == leaves_by_hand(a, 4, 16, 0.02, 0.3)
    seen = np.zeros((h, w), int)
    for x, y, bw, bh in got:
        seen[y : y + bh, x : x + bw] += 1
    assert (seen == 1).all()


def test_features_equal_array_form(spark):
    rng = np.random.default_rng(5)
    a = rng.random((16, 24)) * 1.2 - 0.1
    b = plane(spark, a).withColumn("leaf", T.leaf_of(F.col("y"), F.col("x"), 8, 24))
    for r in FE.feature_table(b).collect():
        y, x = r["leaf"] // 3 * 8, r["leaf"] % 3 * 8
        assert np.allclose([r[n] for n in FE.NAMES], block_features(a[y : y + 8, x : x + 8]), atol=1e-5)
    thin = plane(spark, a[:1, :3]).withColumn("leaf", F.lit(0))
    row = FE.feature_table(thin).first()
    assert row["grad_mean"] == 0 and row["e_ll"] == 0 and row["e_hl"] > 0 or row["e_hl"] >= 0
    assert len(FE.as_vector(FE.feature_table(thin), 20).first()["f"]) == 20


def test_augmentations_undo_each_other(spark):
    a = np.random.default_rng(2).random((3, 5))
    p = plane(spark, a).select("image_id", "y", "x", F.lit(0).alias("c"), "v")
    by = {}
    for r in P.augment(p).collect():
        by.setdefault(r["kind"], {})[r["y"], r["x"]] = r["v"]
    want = {"hflip": a[:, ::-1], "vflip": a[::-1], "rot90": np.rot90(a), "rot180": np.rot90(a, 2), "rot270": np.rot90(a, 3)}
    for kind, b in want.items():
        assert all(by[kind][y, x] == b[y, x] for y in range(b.shape[0]) for x in range(b.shape[1])), kind
    assert P.augment(p, 2).select("kind").distinct().count() == 2


def test_chunk_rules(spark):
    assert [T.chunk_size(n, 2) for n in (10, 800, 10**6)] == [32, 100, 2048] and T.chunk_size(1000, 2, 999) == 250
    r = spark.createDataFrame([(0, k, 10 + k) for k in range(5)], "image_id int, leaf_no int, n_bytes long")
    assert [tuple(x) for x in T.chunk_offsets(r, 2, 7).orderBy("chunk_no").collect()] == [(0, 0, 7, 28, 2), (0, 1, 28, 53, 2), (0, 2, 53, 67, 1)]


@pytest.mark.parametrize(("n", "g"), [(8, 3), (7, 4), (9, 2), (5, 5)])
def test_cells(spark, n, g):
    sizes = [n // g + (i < n % g) for i in range(g)]
    want = [i for i, s in enumerate(sizes) for _ in range(s)]
    got = [r[0] for r in spark.range(n).orderBy("id").select(T.cell_of(F.col("id"), F.lit(n), F.lit(g))).collect()]
    assert got == want


def test_margin_and_choice(spark):
    one = spark.createDataFrame([(0, 0, 0, "same", 0.0)], "image_id int, leaf int, bank_no int, kind string, score double")
    assert C.margin_policy(one).first()["h_bits"] == 0
    cand = spark.createDataFrame([(0, 0, k, h, 8, 5, 1) for k, h in enumerate((5, 1, 5))] + [(0, 1, k, h, 8, 9, None) for k, h in enumerate((5, 1))] + [(0, 2, 0, 3, 0, 3, None)], "image_id int, leaf int, rank int, hp int, h_bits int, want_hp int, refine_idx int")
    assert {r["leaf"]: r["rank"] for r in C.decoder_choice(cand).collect()} == {0: 2, 1: 0, 2: 0}
    t = spark.createDataFrame([(0, 0, 0, 7, False), (0, 0, 1, 7, True), (0, 1, 0, 3, True), (0, 1, 1, 4, False)], "image_id int, leaf int, rank int, hp int, target boolean")
    assert {r["leaf"]: (r["refine_flag"], r["refine_idx"]) for r in C.survivors(t).collect()} == {0: (1, 1), 1: (0, None)}


def test_residual_bytes(spark):
    rows = [(0, 0, y, x, c, 0.1 * (y < 2) - 0.3 * (x == 3) * (c == 1), 0.0) for y in range(4) for x in range(4) for c in range(3)]
    b = spark.createDataFrame(rows, "image_id int, leaf int, y int, x int, c int, t double, b double")
    celled = R.with_cells(b, 4)
    levels = R.residual_levels(celled, "t", "b")
    data = bytes(R.residual_bytes(levels).first()["payload"])
    assert data[0] == 2 and np.frombuffer(data[1:], np.int8).tolist() == [4, 4, 4, 4, -2, 4, 0, 0, 0, 0, -4, 0]
    zero = R.residual_levels(R.with_cells(b.withColumn("t", F.lit(0.0))), "t", "b")
    assert zero.count() == 0
    assert R.apply_residual(celled, levels, "b").agg(F.min("refined")).first()[0] == 0


def test_varint_columns(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 127, 128, 16384, 2**31, 2**62)], "v long")
    for r in df.select("v", B.varint(F.col("v")).alias("b"), B.varint_length(F.col("v")).alias("n"), B.varint_value(B.varint(F.col("v"))).alias("back")).collect():
        assert len(r["b"]) == r["n"] == r["back"]["length"] and r["back"]["value"] == r["v"]
    cut = spark.sql("SELECT unhex('80') AS b, unhex('') AS e")
    assert cut.select(B.varint_value(F.col("b")), B.varint_value(F.col("e"))).first()[:] == (None, None)
    with pytest.raises(Exception, match="negative"):
        spark.sql("SELECT -1L AS v").select(B.varint(F.col("v"))).collect()
    assert spark.range(1).select(F.hex(B.big_endian(F.lit(258), 4)), B.hash_prefix(F.lit(b"x"), 0)).first()[:] == ("00000102", 0)


def test_scalars(spark):
    df = spark.createDataFrame([("5ms",), ("12.3s",), ("1h2m3s",), ("xms",), ("2m",)], "t string")
    assert [r[0] for r in df.select(S.duration_seconds(F.col("t")).alias("s")).collect()][:3] == [0.005, 12.3, 3723.0]
    assert [str(r[0]) for r in df.select(S.duration_seconds(F.col("t"))).collect()][3:] == ["nan", "120.0"]
    got = spark.range(1).select(*[S.duration_text(F.lit(x).cast("double")) for x in (0.5, 1.5, 61.0, 3661.0, None)]).first()
    assert got[:] == ("0s", "2s", "1m1s", "1h1m1s", "nan")
    five = spark.range(1).select(S.five_numbers(F.lit("20 dB, 25.5, x"))).first()[0]
    assert five[:2] == [20, 25.5] and all(np.isnan(five[2:]))
    assert spark.range(1).select(S.relative(F.lit(3.0), F.lit(0.0)), S.relative(F.lit(-1.0), F.lit(-2.0)), S.psnr_unit(F.lit(0.0)), S.psnr_255(F.lit(0.0)), S.to_bool(F.lit("True")), S.fixed_text(F.lit(1.25), 1), S.row_class(F.lit(2.0), F.lit(1.0), 0.5, True), S.row_class(F.lit(0.0), F.lit(1.0))).first()[:] == (0, 0.5, 120, 120, True, f"{1.25:.1f}", "BLUE", "RED")
    assert spark.createDataFrame([], "v double").agg(S.five_number_summary(F.col("v"))).first()[0] == [0] * 5


def test_interpolation(spark):
    p = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 4.0, 0.0), ("b", 1.0, 5.0), ("c", 3.0, 1.0), ("c", 9.0, 2.0), ("a", float("nan"), 1.0), (None, 1.0, 2.0), (None, 3.0, 2.0)], "k string, x double, y double")
    at = lambda x: {r["k"]: r["value"] for r in RD.interpolate(p, "x", "y", x, "k").collect()}
    assert at(2.0) == {"a": 20, "b": None, "c": None} and at(3.0)["a"] == 10 and at(4.5)["a"] is None and at(3.0)["c"] == 1
    t = spark.createDataFrame([(f"i{k}", 0.1 + 0.3 * j, 30.0 + 5 * j + k) for k in range(3) for j in range(3)], "image string, jpeg_bpp double, PSNR double")
    s = RD.median_summary(t, "t.csv").first()
    assert s["key_col"] == "image" and s["psnr@0.4_n"] == 3 and s["psnr@0.4_median"] == pytest.approx(36) and s["bpp@34db_n"] == 3
    assert RD.pick_column(["Foo", "my_bpp_x"], ["bpp"]) == "my_bpp_x" and RD.pick_column(["BPP", "bpp"], ["bpp"]) == "bpp" and RD.pick_column(["a"], ["b"]) is None
    assert RD.seeded_sample(t, "image", 2, 1).count() == 2
    assert RD.normalised(spark.createDataFrame([(1.0,), (1.0,)], "y double"), "y").first()["norm"] == 0.5


def gae_by_hand(rows, gamma, lam):
    out, a = {}, 0.0
    for n in range(len(rows) - 1, -1, -1):
        env, t, rew, val, done = rows[n]
        live = 0.0 if done else 1.0
        nxt = rows[n + 1][3] if n + 1 < len(rows) else 0.0
        a = rew + gamma * nxt * live - val + gamma * lam * live * a
        out[env, t] = a
    return out


@pytest.mark.parametrize("order", ["env", "interleaved"])
def test_gae_orders(spark, order):
    rng = np.random.default_rng(4)
    rows = [(e, t, float(rng.random()), float(rng.random()), bool(rng.random() < 0.2)) for t in range(20) for e in range(3)]
    df = spark.createDataFrame(rows, "env_id int, t long, rew double, val double, done boolean")
    groups = [rows] if order == "interleaved" else [[r for r in rows if r[0] == e] for e in range(3)]
    want = {k: v for g in groups for k, v in gae_by_hand(g, 0.99, 0.95).items()}
    got = {(r["env_id"], r["t"]): r["advantage"] for r in RO.gae(df, order=order).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("order,lam", [("env", 0.95), ("env", 0.0), ("interleaved", 0.95)])
def test_gae_across_blocks(spark, monkeypatch, order, lam):
    monkeypatch.setattr(RO, "BLOCK_BITS", 4)
    rng = np.random.default_rng(5)
    steps = [t for t in range(150) if not 40 <= t < 80]
    rows = [(e, t, float(rng.random()), float(rng.random()), bool(rng.random() < 0.02)) for t in steps for e in range(4)]
    df = spark.createDataFrame(rows, "env_id int, t long, rew double, val double, done boolean").repartition(5)
    groups = [rows] if order == "interleaved" else [[r for r in rows if r[0] == e] for e in range(4)]
    want = {k: v for g in groups for k, v in gae_by_hand(g, 0.99, lam).items()}
    got = {(r["env_id"], r["t"]): (r["advantage"], r["ret"]) for r in RO.gae(df, lam=lam, order=order).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k]) < 1e-9 for k in want)
    assert all(abs(got[r[0], r[1]][1] - want[r[0], r[1]] - r[3]) < 1e-9 for r in rows)
    assert RO.gae(df.limit(0), order=order).collect() == []


def test_five_numbers_of_ranges(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(round(v, 1))) for v in rng.normal(size=3000)] + [("few", 1.0), ("few", 2.0), ("one", 4.0), ("none", None), (None, 3.0), (None, 5.0), ("few", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: (r["a"], r["b"]) for r in RD.five_number_table(df, ["k"], {"a": F.col("v"), "b": -F.col("v")}).collect()}
    assert got.keys() == {"hot", "few", "one", "none", None}
    for k in got:
        v = np.array([x for n, x in rows if n == k and x is not None])
        for x, sign in zip(got[k], (1, -1), strict=True):
            assert np.allclose(x, np.quantile(sign * v, (0, 0.25, 0.5, 0.75, 1)) if len(v) else [0] * 5)
    assert RD.five_number_table(df.limit(0), ["k"], {"a": F.col("v")}).collect() == []
    odd = spark.createDataFrame([("x", float("nan")), ("x", 1.0), ("x", 2.0)], "k string, v double")
    assert RD.five_number_table(odd, ["k"], {"a": F.col("v")}).first()["a"][:3] == [1.0, 1.5, 2.0]


def test_early_stop_off_and_soft_weights(spark):
    df = spark.createDataFrame([(0, e, 1.0, 30.0) for e in range(6)], "run int, epoch int, bpp double, db double")
    assert not any(r["stop"] for r in RO.early_stop(df, "run", 2, enabled=False).collect())
    on = RO.early_stop(df, "run", 2, 0.1, 0.1).orderBy("epoch").collect()
    assert [r["wait"] for r in on] == [0, 1, 2, 3, 4, 5] and [r["stop"] for r in on][:3] == [False, False, True]
    w = spark.range(1).select(*RO.soft_weights(F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(2.0))).first()
    assert w[:] == (0.5, 0.5, 0.0)


def test_ordered_batches(spark):
    df = spark.createDataFrame([(k, 10 * k) for k in range(100)], "i long, b long").repartition(7)
    got = sorted(tuple(r) for r in RO.batches(df, "i", "b", 16).collect())
    assert got == [(k, k // 16, sum(10 * j for j in range(k + 1))) for k in range(100)]


def test_early_stop_reads_all_events(spark, tmp_path):
    from blockwright.plans.queries import q_early_stop

    rng = np.random.default_rng(6)
    rows = [(k, round(float(v), 3)) for k, v in enumerate(rng.random(3000) * 50)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for run in range(100):
        bpp, db, wait = float("inf"), float("-inf"), 0
        for epoch in range(30):
            v = rows[100 * epoch + run][1]
            x, y = v / 100, 30 + v / 50
            warm = epoch < 2
            a, b = (x < bpp, y > db) if warm else (bpp - x >= 0.01, y - db >= 0.05)
            bpp, db, wait = x if a else bpp, y if b else db, 0 if warm or a or b else wait + 1
            want[run, epoch] = (round(bpp, 6), round(db, 6), wait, not warm and wait >= 3)
    got = {(r["run"], r["epoch"]): (r["best_bpp"], r["best_db"], r["wait"], r["stop"]) for r in q_early_stop(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(g[0] - w[0]) + abs(g[1] - w[1]) < 3e-6 and g[2:] == w[2:] for g, w in ((got[k], want[k]) for k in want))


def test_fixed_text_rounds_exact_values_like_python(spark):
    rng = np.random.default_rng(4)
    values = [0.0, 0.125, 0.375, -0.125, 1.005, 1.115, 2.675, 9.25, -0.001, 0.5, 1.5, 2.5, 1e15, 123456789.5, float("inf"), *(rng.normal(size=300) * 100).tolist(), *(rng.integers(-4000, 4000, 200) / 16).tolist(), *(rng.integers(0, 99999, 300) / 1000).tolist()]
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (None,)], "x double")
    for d in (0, 1, 2, 3):
        got = [r["t"] for r in df.select(S.fixed_text(F.col("x"), d).alias("t")).collect()]
        assert got == [f"{v:.{d}f}" for v in values] + ["nan", "nan"]
