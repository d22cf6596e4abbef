import numpy as np
from pyspark.sql import functions as F

from blockwright.functions import blockmath as M
from blockwright.operators import codec as CO
from blockwright.operators import environment as E
from blockwright.operators import ppo
from blockwright.operators import pixels as P
from blockwright.plans.fixtures import tlog
from blockwright.sources import config, container, images
from blockwright.streaming import logtail


def test_png_goes_through_the_image_source(spark, tmp_path):
    a = np.random.default_rng(0).random((5, 7, 3)).astype(np.float32)
    df = spark.createDataFrame([("one", 7, 5, a.ravel().tolist())], "path string, w int, h int, px array<float>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.png").write_bytes(images.to_png(df).first()["content"])
    (tmp_path / "note.txt").write_text("x")
    assert images.list_images(spark, str(tmp_path)).count() == 1
    back = images.load_images(spark, str(tmp_path))
    got = np.array(back.first()["px"]).reshape(5, 7, 3)
    assert np.array_equal(np.round(got * 255), np.clip(a * 255 + 0.5, 0, 255).astype(np.uint8))
    assert images.image_pixels(back).count() == 105


def test_csv_and_logs(spark, tmp_path):
    images.write_csv(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), str(tmp_path / "o"), ["b", "a", "gone"])
    got = images.read_csv(spark, str(tmp_path / "o"), {"a": "double", "b": "int"})
    assert got.columns == ["b", "a", "gone"] and sorted(r["a"] for r in got.collect()) == [1, 2] and got.filter("b IS NOT NULL").count() == 0
    assert images.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    (tmp_path / "l.log").write_text("a\nb\n")
    assert [(r["file"], r["line_no"], r["line"]) for r in images.log_lines(spark, [str(tmp_path / "l.log")]).collect()][:2] == [("l.log", 0, "a"), ("l.log", 1, "b")]


def blocks(spark, n=6, size=8):
    rng = np.random.default_rng(9)
    rows = [(0, k, size * k, 0, size, size, rng.random(size * size * 3).astype(np.float32).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "image_id int, leaf_no int, x int, y int, w int, h int, px array<float>")


def test_block_layouts_are_inverse(spark):
    b = blocks(spark)
    back = CO.to_blocks(CO.to_pixels(b))
    assert sorted(map(tuple, back.select("leaf_no", "x", "w", "px").collect())) == sorted(map(tuple, b.select("leaf_no", "x", "w", "px").collect()))


def test_data_source_reads_chunks(spark, tmp_path):
    conf = CO.CodecConfig(chunk=4)
    records = CO.encode(blocks(spark), conf)
    data = CO.containers(records, conf).first()["content"]
    (tmp_path / "a.bin").write_bytes(data)
    container.register(spark)
    got = spark.read.format("blockfile").load(str(tmp_path / "a.bin"))
    assert got.rdd.getNumPartitions() == 2
    rows = sorted(got.collect(), key=lambda r: r["leaf_no"])
    assert [bytes(r["payload"]) for r in rows] == [bytes(r["payload"]) for r in records.orderBy("leaf_no").collect()]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert CO.decode(container.read_containers(files), "name").count() == 6


def test_rewards(spark):
    b = blocks(spark, 2)
    s = E.steps(b, [(8, 5, 0), (32, 5, 0)], E.RewardConfig(min_psnr_db=60.0, with_gmsd=True)).collect()
    for r in s:
        loss = r["bpp"] + max(0, 60 - r["psnr"]) + max(0, 0.95 - r["msssim"])
        assert abs(r["reward"] + loss) < 1e-9 and r["score"] == -r["reward"]
    best = E.best_actions(spark.createDataFrame(s)).collect()
    assert {r["q"] for r in best} == {8}
    free = E.steps(b, [(12, 5, 8)], E.RewardConfig(scale=0.5)).first()
    assert free["psnr_req"] < free["psnr"]
    assert len(E.action_grid()) == 156 and E.split_steps(b).first()["psnr"] == 120


def test_policy_gradient_is_right_and_training_runs(spark):
    rng = np.random.default_rng(0)
    net = ppo.PolicyNet(18, 8, 1)
    t = ppo.Trainer(net, ppo.PPOConfig(hidden=8, clip=10.0))
    obs, act = rng.normal(size=(12, 18)), np.stack([rng.integers(0, n, 12) for n in (13, 6, 2)], 1)
    logp, adv, ret = rng.normal(-5, 0.1, 12), rng.normal(size=12), rng.normal(size=12)
    _, g = t.loss_and_grads(obs, act, logp, adv, ret)
    for name in ("a_w", "q_w", "v_b", "k_b"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = t.loss_and_grads(obs, act, logp, adv, ret)[0]
        net.p[name][at] = old - 1e-5
        down = t.loss_and_grads(obs, act, logp, adv, ret)[0]
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name
    back = ppo.PolicyNet.from_bytes(net.to_bytes())
    assert back.act(obs) == net.act(obs)
    trainer, history = ppo.train(blocks(spark, 12), 2, ppo.PPOConfig(hidden=8))
    assert len(history) == 2 and trainer.step > 0 and np.isfinite(history[-1]["loss"])


def test_advantages():
    got = ppo.advantages(np.array([1.0, 2, 3]), np.zeros(3), np.zeros(3), 0.99, 0.95)
    assert np.allclose(got, [5.53462075, 4.8215, 3.0])


def test_sampled_steps_keep_the_advantages_of_all(spark):
    conf, net = ppo.PPOConfig(hidden=8), ppo.PolicyNet(18, 8, 1)
    steps = ppo.rollout(blocks(spark, 24).coalesce(2), net, conf, E.RewardConfig()).persist()
    every = steps.toPandas().sort_values(["env_id", "t"])
    want = {}
    for env, g in every.groupby("env_id"):
        a = ppo.advantages(g.rew.to_numpy(), g.val.to_numpy(), np.zeros(len(g)), conf.gamma, conf.lam)
        want |= {(env, t): x for t, x in zip(g.t, a, strict=True)}
    got = ppo.sampled_steps(steps, conf, 0, 7)
    assert len(got) == 7 and all(abs(want[e, t] - a) < 1e-9 and abs(a + v - r) < 1e-9 for e, t, a, v, r in zip(got.env_id, got.t, got.advantage, got.val, got.ret, strict=True))
    few, all_steps = (ppo.train(blocks(spark, 24), 1, conf, sample=n)[1][0] for n in (5, 100))
    assert all(abs(few[k] - all_steps[k]) < 1e-9 for k in ("reward", "bpp", "psnr"))
    assert abs(ppo.validate(blocks(spark, 24), ppo.PolicyNet(18, 8, conf.seed), conf)["reward"] - few["reward"]) < 1e-9


def test_checkpoints_carry_on(spark):
    rng = np.random.default_rng(2)
    t = ppo.Trainer(ppo.PolicyNet(18, 8, 1), ppo.PPOConfig(hidden=8))
    data = rng.normal(size=(12, 18)), np.stack([rng.integers(0, n, 12) for n in (13, 6, 2)], 1), rng.normal(-5, 0.1, 12), rng.normal(size=12), rng.normal(size=12)
    t.update(*data)
    back = ppo.Trainer.load(*t.save())
    assert back.config == t.config and back.step == t.step and t.update(*data) == back.update(*data)
    assert all(np.array_equal(t.net.p[k], back.net.p[k]) for k in t.net.p)


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("encoder: {default_q: 9, block_size: 16, max_block: 64, compression: {type: none}, split: {var_thresh: 0.1}}\nformat: {version: 3}\npolicy: {algorithm: budget, q_bounds: [8, 12]}\nextra: 1\n")
    tree = config.load_yaml(str(tmp_path / "c.yaml"))
    c = config.codec_config(tree)
    assert (c.q, c.policy, c.q_bounds, c.version, c.compress) == (9, "budget", (8, 12), 3, False)
    assert config.split_settings(tree) == {"min_block": 16, "max_block": 64, "var_threshold": 0.1, "grad_threshold": 0.02}
    assert config.codec_config({}).policy == "fixed_margin" and config.reward_config({"rl": {"alpha_bpp": 2.0, "x": 1}}).alpha_bpp == 2


def test_encode_policies(spark):
    b = blocks(spark, 3)
    assert {r["h_bits"] for r in CO.encode(b, CO.CodecConfig(policy="constant")).collect()} == {8}
    r = CO.encode(b, CO.CodecConfig(policy="budget", version=1)).first()
    assert 10 <= r["q"] <= 20 and r["comp_id"] == M.COMP_NONE and r["bpp"] == 8 * len(r["record"]) / 64


def test_streamed_progress_equals_batch(spark, sf, tmp_path):
    from blockwright.operators.trainlog import progress

    t = tlog(spark, sf).filter("line_no < 300")
    rows = t.orderBy("line_no").collect()
    import json

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r.asDict()) for r in rows[100 * k : 100 * k + 100]))
    q = logtail.live_progress(logtail.read_lines(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = progress(t).select("line_no", "epoch", "phase", "batch", "pct")
    assert sorted(map(tuple, spark.table("live").select("line_no", "epoch", "phase", "batch", "pct").collect())) == sorted(map(tuple, want.collect()))
    c = logtail.kind_counts(logtail.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("kinds").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    c.processAllAvailable()
    c.stop()
    assert spark.table("kinds").agg(F.sum("n")).first()[0] == 300


def test_save_rounding(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.5,), (1.2,)], "v double")
    assert [r[0] for r in df.select(P.to_bytes(F.col("v"))).collect()] == [0, 0, 128, 255]


def test_save_rounds_in_the_precision_of_the_pixels(spark):
    near = [float(x) for k in range(255) for x in (np.float32((k + 0.5) / 255), np.nextafter(np.float32((k + 0.5) / 255), np.float32(0)))]
    df = spark.createDataFrame(list(enumerate(near)), "n int, v double").select("n", F.col("v").cast("float").alias("v"))
    want = np.clip(np.array(near, np.float32) * 255 + 0.5, 0, 255).astype(np.uint8).tolist()
    assert [r[0] for r in df.orderBy("n").select(P.to_bytes(F.col("v"))).collect()] == want


def test_container_roundtrip_broadcasts_no_pixels(spark, sf):
    from blockwright.plans import queries as Q

    df = Q.q_container_roundtrip(spark, sf)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["n"], r["mse"] < 0.01) for r in df.collect()} == {(32 * 32 * 3, True)}


def test_grid_query_searches_all_actions(spark, sf):
    from blockwright.plans import queries as Q

    best = {(r["image_id"], r["leaf_no"]): r for r in Q.q_rd_grid_best(spark, sf).collect()}
    rows = CO.to_blocks(Q._ycc_pixels(spark, sf)).select("image_id", "leaf_no", "x", "y", "w", "h", "px").orderBy("image_id", "leaf_no").limit(4).collect()
    conf = E.RewardConfig(min_psnr_db=38.0)
    for r in rows:
        px = np.array(r["px"], np.float32).reshape(r["h"], r["w"], 3)
        s = [E.block_step(px, r["x"], r["y"], q, k, h, conf) for q in range(8, 33, 2) for k in range(1, 7) for h in (0, 8)]
        want = min(s, key=lambda a: (a["score"], a["q"], a["k"], a["h_bits"]))
        got = best[r["image_id"], r["leaf_no"]]
        assert len(s) == 156 and (got["q"], got["k"], got["h_bits"]) == (want["q"], want["k"], want["h_bits"]) and abs(got["reward"] - want["reward"]) < 1e-6
