"""python -m blockwright encode|decode|bench|log ...: files through the operators."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.functions.scalars import bits_per_pixel
from blockwright.operators import codec, metrics, pixels, rollout, tiling, trainlog
from blockwright.session import session
from blockwright.sources import config, container, images


def encode_files(spark, root: str, settings: dict) -> tuple[DataFrame, DataFrame]:
    """(pixels, containers) of the images under a path."""
    conf, split = config.codec_config(settings), config.split_settings(settings)
    found = images.load_images(spark, root)
    # images are numbered by path; the listing and the decoder write local paths with different slashes
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    listed = images.list_images(spark, root).select(plain.alias("name"), "length")
    ids = rollout.batches(listed, "name", "length", 1).select("name", F.col("batch_no").alias("image_id"))
    numbered = found.withColumn("name", plain).join(ids, "name").drop("name")
    rgb = images.image_pixels(numbered, "image_id")
    planes = pixels.ycc_planes(rgb)
    each = F.array(*[F.struct(F.lit(k).alias("c"), F.col(n).cast("float").alias("v")) for k, n in enumerate(("luma", "cb", "cr"))])
    ycc = planes.select("image_id", "y", "x", F.inline(each))
    if split["max_block"] > split["min_block"]:
        leaves = tiling.quadtree(planes.select("image_id", "y", "x", F.col("luma").alias("v")), **split)
    else:
        leaves = tiling.fixed_leaves(tiling.image_sizes(planes), split["min_block"])
    own = leaves.select(F.col("image_id").alias("i"), F.col("leaf_no").alias("leaf"), F.col("x").alias("lx"), F.col("y").alias("ly"), "w", "h")
    # a pixel finds its leaf through the largest tile both lie in, then by the leaf's sides
    tile = split["max_block"]
    a = ycc.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    b = own.withColumns({"ty": F.floor(F.col("ly") / tile), "tx": F.floor(F.col("lx") / tile)})
    inside = (F.col("x") >= F.col("lx")) & (F.col("x") < F.col("lx") + F.col("w")) & (F.col("y") >= F.col("ly")) & (F.col("y") < F.col("ly") + F.col("h"))
    leafed = a.join(b, (a.image_id == b.i) & (a.ty == b.ty) & (a.tx == b.tx) & inside).select("image_id", "leaf", "y", "x", "c", "v")
    files = codec.containers(codec.encode(codec.to_blocks(leafed), conf), conf, split["min_block"])
    return rgb, files.join(numbered.select("image_id", "path", "w", "h"), "image_id")


def decode_pixels(files: DataFrame, name: str = "image_id") -> DataFrame:
    """RGB pixels (name, y, x, c, v) of containers in a column of bytes."""
    blocks = codec.decode(container.read_containers(files, name), "name")
    p = codec.to_pixels(blocks.withColumnRenamed("name", "image_id")).drop("leaf")
    w = pixels.planes(p, "abc")
    rgb = pixels.to_rgb(F.col("a"), F.col("b"), F.col("c"))
    return w.select(F.col("image_id").alias(name), "y", "x", F.inline(F.array(*[F.struct(F.lit(k).alias("c"), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).cast("float").alias("v")) for k, v in enumerate(rgb)])))


def bench_files(spark, root: str, settings: dict) -> DataFrame:
    """Size and quality of each image through encoder and decoder."""
    rgb, files = encode_files(spark, root, settings)
    sizes = files.select("image_id", "path", bits_per_pixel(F.length("content"), F.col("w"), F.col("h")).alias("bpp"))
    back = decode_pixels(files.select("image_id", "content")).withColumn("image_id", F.col("image_id").cast("int"))
    both = rgb.join(back.withColumnRenamed("v", "decoded"), ["image_id", "y", "x", "c"])
    return sizes.join(metrics.quality(both, "v", "decoded"), "image_id")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("what", choices=["encode", "decode", "bench", "log"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--config")
    a = p.parse_args()
    spark, settings = session(app=f"blockwright {a.what}"), config.load_yaml(a.config) if a.config else {}
    if a.what == "encode":
        encode_files(spark, a.input, settings)[1].write.mode("overwrite").parquet(a.output)
    elif a.what == "decode":
        decode_pixels(spark.read.parquet(a.input).select("path", "content"), "path").write.mode("overwrite").parquet(a.output)
    elif a.what == "bench":
        bench_files(spark, a.input, settings).write.mode("overwrite").parquet(a.output)
    else:
        lines = images.log_lines(spark, [a.input])
        trainlog.per_batch(lines).drop("file_no", "line_no").write.mode("overwrite").option("header", True).csv(f"{a.output}/per_batch")
        trainlog.per_epoch(lines).orderBy("epoch").write.mode("overwrite").option("header", True).csv(f"{a.output}/per_epoch")
        trainlog.latest_progress(trainlog.progress(lines)).write.mode("overwrite").option("header", True).csv(f"{a.output}/per_progress")


if __name__ == "__main__":
    main()
