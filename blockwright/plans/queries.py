"""Registered queries of the block and rate-distortion operators, over the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import bytes as B
from blockwright.functions import blockmath as M
from blockwright.functions import scalars as S
from blockwright.operators import candidates as C
from blockwright.operators import codec as CO
from blockwright.operators import environment as E
from blockwright.operators import features as FE
from blockwright.operators import metrics as ME
from blockwright.operators import pixels as P
from blockwright.operators import rdcurve as RD
from blockwright.operators import residual as R
from blockwright.operators import rollout as RO
from blockwright.operators import tiling as T
from blockwright.operators import trainlog as L
from blockwright.sources import container as CT
from blockwright.plans import more
from blockwright.plans.fixtures import rdpts, table, tlog, vpix

BLOCK = 8
WIDTH = 32


def r6(c: str | Column) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(c) if isinstance(c, str) else out


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c) if c in names else F.col(c) for c in df.columns])


def _leaf(df: DataFrame, block: int = BLOCK) -> DataFrame:
    return df.withColumn("leaf", T.leaf_of(F.col("y"), F.col("x"), block, WIDTH))


def _luma_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return FE.clipped(_leaf(P.luma(vpix(spark, sf))))


def _coarse_blocks(spark: SparkSession, sf: str, step: int = 12) -> DataFrame:
    return P.coarse(_leaf(vpix(spark, sf)), step)


def q_rgb_to_ycc(spark, sf):
    return P.ycc_planes(vpix(spark, sf)).select("image_id", "y", "x", r6("luma"), r6("cb"), r6("cr"))


def q_ycc_roundtrip(spark, sf):
    p = P.planes(vpix(spark, sf))
    back = P.to_rgb(*P.to_ycc(F.col("r"), F.col("g"), F.col("b")))
    return p.groupBy("image_id").agg(*[r6(F.max(F.abs(b - F.col(n)))).alias(f"err_{n}") for b, n in zip(back, "rgb", strict=True)], r6(F.avg(back[0])).alias("mean_r"))


def q_save_bytes(spark, sf):
    return vpix(spark, sf).groupBy("image_id", "c").agg(F.sum(P.to_bytes(F.col("v"))).alias("total"), F.min(P.to_bytes(F.col("v"))).alias("low"), F.max(P.to_bytes(F.col("v"))).alias("high"))


def q_quantize_hist(spark, sf):
    return P.coarse(vpix(spark, sf), 12).groupBy("image_id", "c", F.col("level").cast("int").alias("level")).agg(F.count("*").alias("n"))


def q_quant_psnr(spark, sf):
    return P.psnr_by_image(vpix(spark, sf), 12).select("image_id", F.round("mse", 9).alias("mse"), r6("psnr"))


def q_fixed_leaves(spark, sf):
    return T.fixed_leaves(T.image_sizes(vpix(spark, sf)), 12)


def q_leaf_size_hist(spark, sf):
    return T.size_histogram(q_fixed_leaves(spark, sf))


def q_chunks(spark, sf):
    leaves = T.fixed_leaves(T.image_sizes(vpix(spark, sf)), 4)
    return T.chunks(leaves, T.chunk_size(64, 1))


def q_chunk_offsets(spark, sf):
    leaves = T.fixed_leaves(T.image_sizes(vpix(spark, sf)), 4)
    n_bytes = sum((B.varint_length(F.col(c).cast("long")) for c in ("x", "y", "w", "h")), F.lit(0)) + 6 * F.col("w") * F.col("h")
    return T.chunk_offsets(leaves.select("image_id", "leaf_no", n_bytes.cast("long").alias("n_bytes")), 32, 16)


def q_block_moments(spark, sf):
    return _rounded(FE.moments(_luma_blocks(spark, sf)), "mean", "var")


def q_block_entropy(spark, sf):
    return _rounded(FE.entropy(_luma_blocks(spark, sf)), "entropy")


def q_block_gradient(spark, sf):
    return _rounded(FE.gradient(_luma_blocks(spark, sf)), "grad_mean", "grad_var")


def q_block_laplacian(spark, sf):
    return _rounded(FE.laplacian(_luma_blocks(spark, sf)), "lap_var")


def q_quadrant_energy(spark, sf):
    return _rounded(FE.quadrants(_luma_blocks(spark, sf)), "e_ll", "e_lh", "e_hl", "e_hh")


def q_feature_vector(spark, sf):
    return _rounded(FE.feature_table(_leaf(P.luma(vpix(spark, sf)))), *FE.NAMES)


def q_split_predicate(spark, sf):
    return _rounded(T.split_activity(P.luma(vpix(spark, sf)), 16, 0.0052, 0.16, 8), "var", "grad")


def q_quadtree_leaves(spark, sf):
    return T.quadtree(P.luma(vpix(spark, sf)), 8, 32, 0.0052, 0.16)


def q_augment(spark, sf):
    a = P.augment(vpix(spark, sf))
    v = F.col("v").cast("double")
    return a.groupBy("image_id", "kind").agg(r6(F.sum(v * (F.col("x") + 1))).alias("mx"), r6(F.sum(v * (F.col("y") + 1) * (F.col("c") + 1))).alias("my"), F.count("*").alias("n"))


def q_downsample2(spark, sf):
    return _rounded(P.downsample2(P.luma(vpix(spark, sf))), "v")


def q_blur(spark, sf):
    b = _leaf(vpix(spark, sf)).withColumn("d", F.col("v").cast("double")).withColumn("b", C.blur("d"))
    return b.groupBy("image_id", "leaf", "c").agg(r6(F.avg(F.col("b") * F.col("b"))).alias("energy"), r6(F.max("b")).alias("high"))


def q_contrast(spark, sf):
    b = C.bank(_leaf(vpix(spark, sf)), "v")
    return b.groupBy("image_id", "leaf", "c").agg(r6(F.var_pop("contrast_up")).alias("up"), r6(F.var_pop("contrast_down")).alias("down"), r6(F.avg("sharpen")).alias("sharp"), r6(F.avg("edge_boost")).alias("edge"))


def q_candidate_rank(spark, sf):
    return C.ranked(C.candidate_scores(_coarse_blocks(spark, sf))).select("image_id", "leaf", "kind", "rank", F.round("score", 9).alias("score"))


def q_best_candidate(spark, sf):
    return C.best(C.candidate_scores(_coarse_blocks(spark, sf, 48), 6, truth="v")).select("image_id", "leaf", "kind", "rank", F.round("mse", 9).alias("mse"))


def q_margin_policy(spark, sf):
    return C.margin_policy(C.candidate_scores(_coarse_blocks(spark, sf), 5), tau=0.00003).select("image_id", "leaf", F.round("margin", 9).alias("margin"), "h_bits")


def q_budget_policy(spark, sf):
    return _rounded(C.budget_policy(FE.feature_table(_leaf(P.luma(vpix(spark, sf))))), "complexity")


def _residual(spark, sf):
    celled = R.with_cells(_coarse_blocks(spark, sf, 64), 3)
    return celled, R.residual_levels(celled, "v", "coarse")


def q_residual_grid(spark, sf):
    return _residual(spark, sf)[1]


def q_residual_apply(spark, sf):
    celled, levels = _residual(spark, sf)
    out = R.apply_residual(celled, levels, "coarse")
    return out.groupBy("image_id").agg(F.round(P.error(F.col("coarse"), F.col("v")), 9).alias("before"), F.round(P.error(F.col("refined"), F.col("v")), 9).alias("after"))


def q_varint(spark, sf):
    o = table(spark, sf, "orders")
    k, v = F.col("o_orderkey"), F.col("o_orderkey") * F.col("o_custkey")
    return o.select("o_orderkey", B.varint_length(v).alias("n_bytes"), F.hex(B.varint(k)).alias("key_hex"), F.hex(B.varint(v)).alias("product_hex"), B.varint_value(B.varint(v))["value"].alias("back"))


def q_hash_prefix(spark, sf):
    d = table(spark, sf, "documents")
    b = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return d.select("doc_id", B.hash_prefix(b, 8).alias("h8"), B.hash_prefix(b, 13).alias("h13"))


def q_log_kinds(spark, sf):
    return L.with_kind(tlog(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def q_log_progress(spark, sf):
    return L.progress(tlog(spark, sf)).drop("file", "file_no")


def q_log_progress_latest(spark, sf):
    return L.latest_progress(L.progress(tlog(spark, sf)))


def q_log_per_batch(spark, sf):
    return L.per_batch(tlog(spark, sf)).drop("file_no", "line_no")


def q_log_per_epoch(spark, sf):
    return L.per_epoch(tlog(spark, sf))


def q_log_totals(spark, sf):
    t = L.totals(L.per_batch(tlog(spark, sf)))
    return _rounded(t, *[c for c in t.columns if c not in ("epoch", "phase", "n")])


def q_log_rrel_class(spark, sf):
    return _rounded(L.reward_classes(L.per_batch(tlog(spark, sf)), blue_above=0.5), "r_rel")


def q_log_report(spark, sf):
    return _rounded(L.report(tlog(spark, sf)), "value")


def q_duration_parse(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat(k % 900, F.lit("ms"))).when(k % 4 == 1, F.concat(k % 60, F.lit(".25s"))).when(k % 4 == 2, F.concat(k % 50, F.lit("m"), k % 60, F.lit("s"))).otherwise(F.concat(k % 9, F.lit("h"), k % 60, F.lit("m"), k % 59, F.lit(".5s")))
    return table(spark, sf, "events").select("event_id", text.alias("text"), r6(S.duration_seconds(text)).alias("seconds"))


def q_duration_format(spark, sf):
    return table(spark, sf, "events").select("event_id", S.duration_text((F.col("event_id") * 37 % 100000).cast("double") / 4).alias("text"))


def q_interp_psnr_at_bpp(spark, sf):
    return _rounded(RD.interpolate(rdpts(spark, sf), "x", "y", 0.41, "k", "psnr"), "psnr")


def q_interp_bpp_at_psnr(spark, sf):
    return _rounded(RD.interpolate(rdpts(spark, sf), "y", "x", 27.3, "k", "bpp"), "bpp")


def q_interp_summary(spark, sf):
    return _rounded(RD.summarize(RD.interpolate(rdpts(spark, sf), "x", "y", 0.41, "k", "psnr"), "psnr", "psnr"), "psnr_median", "psnr_std")


def q_quality_sweep(spark, sf):
    s = RD.quality_sweep(rdpts(spark, sf).withColumn("quality", (F.col("k") % 13).cast("int")), "quality", "x", "y")
    return _rounded(s, *s.columns[1:])


def q_axis_limits(spark, sf):
    p = rdpts(spark, sf)
    each = F.array(F.struct(F.lit("bpp").alias("series"), F.col("x").alias("v")), F.struct(F.lit("log2_bpp").alias("series"), S.rate_axis(F.col("x"), True).alias("v")), F.struct(F.lit("psnr").alias("series"), F.col("y").alias("v")))
    return _rounded(RD.axis_limits(p.select(F.inline(each)), ["series"], "v"), "low", "high")


def q_minmax_norm(spark, sf):
    n = RD.normalised(rdpts(spark, sf), "y")
    return n.select("k", r6("x"), r6("norm"), r6(S.rate_axis(F.col("x"), True)).alias("log2_x"))


def q_five_number(spark, sf):
    g = RD.five_number_table(table(spark, sf, "lineitem"), ["l_returnflag"], {"p": F.col("l_extendedprice"), "q": F.col("l_quantity")})
    return g.select("l_returnflag", *[r6(F.col(c)[i]).alias(f"{n}_{q}") for c, n in (("p", "price"), ("q", "qty")) for i, q in enumerate(("min", "q1", "med", "q3", "max"))])


def q_means(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("total"), r6(F.avg("l_quantity")).alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


def _rollout(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 7).cast("int").alias("env_id"), F.col("event_id").alias("t"), (F.col("value").cast("double") / 3).alias("rew"), (F.col("value").cast("double") / 7).alias("val"), (F.col("event_id") % 50 == 49).alias("done"))


def q_gae(spark, sf):
    return _rounded(RO.gae(_rollout(spark, sf)), "advantage", "ret")


def q_adv_norm(spark, sf):
    return RO.normalised_advantage(_rollout(spark, sf), "rew").select("env_id", "t", r6("norm"))


def q_early_stop(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 100).cast("int").alias("run"), F.floor(F.col("event_id") / 100).cast("int").alias("epoch"), (F.col("value") / 100).alias("bpp"), (30 + F.col("value") / 50).alias("db"))
    return RO.early_stop(e, "run", 3, 0.01, 0.05, 2).select("run", "epoch", F.round("best_bpp", 6).alias("best_bpp"), F.round("best_db", 6).alias("best_db"), "wait", "stop")


def q_batch_reward(spark, sf):
    b = _coarse_blocks(spark, sf)
    steps = b.groupBy("image_id", "leaf").agg(P.error(F.col("coarse"), F.col("v")).alias("e"), (F.count("*") * 2 * 8.0 / 64).alias("bpp"))
    steps = steps.select("image_id", "bpp", S.psnr_unit(F.col("e")).alias("psnr"), (1 - F.col("e")).alias("msssim"))
    return _rounded(RO.batch_reward(steps, ["image_id"], 0.5, 0.25, 1.0, None, 0.5, 0.99), "reward")


def q_image_batches(spark, sf):
    return RO.batches(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16)


def _ycc_pixels(spark, sf):
    """Offset-chroma pixels in the long layout, by leaf."""
    p = P.ycc_planes(vpix(spark, sf))
    each = F.array(*[F.struct(F.lit(k).alias("c"), F.col(n).cast("float").alias("v")) for k, n in enumerate(("luma", "cb", "cr"))])
    return _leaf(p.select("image_id", "y", "x", F.inline(each)))


def q_ssim(spark, sf):
    return _rounded(ME.quality(P.coarse(vpix(spark, sf), 32)).select("image_id", "psnr", "ssim"), "psnr", "ssim")


def q_ms_ssim(spark, sf):
    return _rounded(ME.quality(P.coarse(vpix(spark, sf), 32)).select("image_id", "ms_ssim"), "ms_ssim")


def q_gmsd(spark, sf):
    return ME.quality(P.coarse(vpix(spark, sf), 32)).select("image_id", F.round(F.col("gmsd") * 1e6, 4).alias("gmsd_ppm"))


def q_crc32(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"))


def q_zlib_gain(spark, sf):
    import pyarrow as pa

    def gain(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            found = [M.deflate(r) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw]), pa.array([c for c, _ in found], pa.int32()), pa.array([len(p) for _, p in found])], ["doc_id", "raw_len", "comp_id", "stored_len"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(gain, "doc_id long, raw_len long, comp_id int, stored_len long")


def q_encode_records(spark, sf):
    r = CO.encode(CO.to_blocks(_ycc_pixels(spark, sf)))
    return r.select("image_id", "leaf_no", "q", "k", "h_bits", "refine_flag", "comp_id", F.length("record").alias("n_bytes"), r6("bpp"), F.round("mse", 9).alias("mse"))


def q_container_roundtrip(spark, sf):
    blocks = CO.to_blocks(_ycc_pixels(spark, sf))
    files = CO.containers(CO.encode(blocks, CO.CodecConfig(chunk=5)), CO.CodecConfig(chunk=5))
    back = CO.decode(CT.read_containers(files.withColumn("image_id", F.col("image_id").cast("string")), "image_id"), "name").withColumn("image_id", F.col("name").cast("int")).drop("name")
    # blocks grow with the images, which a plan's guess of their size doesn't see: no broadcast
    both = blocks.withColumnRenamed("px", "t").join(back.hint("merge"), ["image_id", "leaf_no", "x", "y", "w", "h"])
    pixels = both.select("image_id", F.inline(F.arrays_zip(F.col("px").alias("v"), "t")))
    return pixels.groupBy("image_id").agg(F.count("*").alias("n"), F.round(P.error(F.col("v"), F.col("t")), 9).alias("mse"))


def q_reward(spark, sf):
    s = E.steps(CO.to_blocks(_ycc_pixels(spark, sf)), [(12, 5, 8), (24, 3, 0)], E.RewardConfig(min_psnr_db=40.0))
    return s.select("image_id", "leaf_no", "q", "k", "h_bits", r6("bpp"), r6("psnr"), r6("msssim"), r6("reward"))


def q_split_reward(spark, sf):
    return _rounded(E.split_steps(CO.to_blocks(_ycc_pixels(spark, sf)).select("image_id", "leaf_no", "w", "h")), "bpp", "reward", "score").select("image_id", "leaf_no", "split", "bpp", "psnr", "reward")


def q_rd_grid_best(spark, sf):
    s = E.steps(CO.to_blocks(_ycc_pixels(spark, sf)), E.action_grid(), E.RewardConfig(min_psnr_db=38.0))
    return _rounded(E.best_actions(s), "bpp", "psnr", "msssim", "reward")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k.startswith("q_")} | more.QUERIES
