import numpy as np

from blockwright.__main__ import bench_files, decode_pixels, encode_files
from blockwright.operators import environment as E
from blockwright.operators import loading as L
from blockwright.operators import trainlog as T
from blockwright.plans.fixtures import tlog
from blockwright.sources.images import png_bytes


def test_batches_and_environments(spark):
    df = spark.createDataFrame([(k, 10 * (k % 4)) for k in range(40)], "i long, b long")
    for rows in _groups(L.memory_batches(df, "i", "b", 50).collect()):
        assert sum(r["b"] for r in rows) <= 50
    assert L.memory_batches(spark.createDataFrame([(1, 99), (2, 1)], "i long, b long").coalesce(1), "i", "b", 50).select("batch").distinct().count() == 2
    rng = np.random.default_rng(2)
    for budget in (50, 100, 7):
        sizes = rng.choice([0, 1, 10, 30, 60, 120], 100).tolist()
        want, held, no = [], 0, 0
        for n in sizes:
            if held and held + n > budget:
                held, no = 0, no + 1
            held += n
            want.append(no)
        for parts in (1, 3, 10):
            with_parts = spark.createDataFrame(list(enumerate(sizes)), "i long, b long").repartition(parts)
            got = {r["i"]: r["batch"] for r in L.memory_batches(with_parts, "i", "b", budget).collect()}
            assert [got[k] for k in range(100)] == want
    ten = spark.createDataFrame([(k, 10) for k in range(100)], "i long, b long")
    for parts in (1, 10):
        assert L.memory_batches(ten.repartition(parts), "i", "b", 300).select("batch").distinct().count() == 4
    assert L.estimated_batches(df, "b", 30, 40) == 20
    env = sorted(map(tuple, L.environments(df, "i", 3).collect()))
    assert env == [(0, 0), (1, 1), (2, 2)] and sorted(map(tuple, L.environments(df.limit(2), "i", 5).collect())) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
    one, two = ([r["i"] for r in L.shuffled(df, "i", s).collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) and one != two
    t = spark.createDataFrame([(0, k, b) for k, b in enumerate((5, 9, 4, 1))], "run int, k int, bits long")
    assert [(r["k"], r["left"]) for r in L.within_budget(t, "run", "k", "bits", 10).orderBy("k").collect()] == [(0, 5), (2, 1), (3, 0)]
    p = spark.createDataFrame([(7,)], "total int")
    assert [(r["pct"], r["done"]) for r in L.progress_ticks(p, "total", 25).collect()] == [(25, 2), (50, 4), (75, 6), (100, 7)]


def test_batches_run_on_from_range_to_range(spark):
    rng = np.random.default_rng(3)
    key, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")  # else such small ranges are one
    try:
        for sizes, budget in ((rng.choice([0, 1, 10, 30, 60, 120], 60), 50), (rng.integers(0, 40, 60), 100), (rng.choice([0, 5], 60), 7)):
            held, no, want = 0, 0, []
            for n in sizes.tolist():
                if held and held + n > budget:
                    held, no = 0, no + 1
                held += n
                want.append(no)
            got = {r["i"]: r["batch"] for r in L.memory_batches(spark.createDataFrame([(k if k < 59 else None, b) for k, b in enumerate(sizes.tolist())], "i long, b long"), "i", "b", budget).collect()}
            assert [got[k] for k in (*range(59), None)] == want
    finally:
        spark.conf.set(key, before)


def _groups(rows):
    by = {}
    for r in rows:
        by.setdefault(r["batch"], []).append(r)
    return by.values()


def test_episode_covers_the_image_in_depth_first_order(spark):
    px = np.random.default_rng(0).random((20, 24, 3)).astype(np.float32)
    df = spark.createDataFrame([(1, 24, 20, px.ravel().tolist())], "image_id int, w int, h int, px array<float>")
    rows = E.episodes(df, lambda f, w, h: (w > 8, 12, 2, 8), 16, 4).orderBy("t").collect()
    seen = np.zeros((20, 24), int)
    for r in rows:
        if not r["split"]:
            seen[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] += 1
    assert (seen == 1).all() and rows[0]["split"] == 1 and (rows[1]["x"], rows[1]["y"], rows[1]["w"]) == (0, 0, 8)
    assert all(r["psnr_req"] is None for r in rows if r["split"])


def test_formatted_cells(spark, sf):
    rows = T.formatted(T.per_batch(tlog(spark, sf))).filter("epoch = 1 AND phase = 'train'").collect()
    assert len({len(r["bpp_cell"]) for r in rows}) == 1 and all(r["psnr_cell"].startswith("[20.00, ") and r["r_cell"][0] in "+-" and r["dt_cell"].endswith("s") for r in rows)


def test_files_through_the_command_line_path(spark, tmp_path):
    px = np.kron(np.random.default_rng(1).random((6, 5, 3)), np.ones((8, 8, 1)))
    (tmp_path / "a.png").write_bytes(png_bytes(px))
    for settings in ({"encoder": {"block_size": 16}}, {"encoder": {"min_block": 8, "max_block": 32}, "format": {"version": 3}}):
        rgb, files = encode_files(spark, str(tmp_path), settings)
        back = decode_pixels(files.select("image_id", "content"))
        assert back.count() == rgb.count() == 48 * 40 * 3
        row = bench_files(spark, str(tmp_path), settings).first()
        assert row["psnr"] > 25 and 0.9 < row["ssim"] <= 1 and row["bpp"] > 0
