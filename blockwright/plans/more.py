"""Registered queries of the smaller operators, each beside its DuckDB twin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import blockmath as M
from blockwright.functions import scalars as S
from blockwright.operators import candidates as C
from blockwright.operators import environment as E
from blockwright.operators import features as FE
from blockwright.operators import loading as LD
from blockwright.operators import metrics as ME
from blockwright.operators import pixels as P
from blockwright.operators import rdcurve as RD
from blockwright.operators import rollout as RO
from blockwright.operators import tiling as T
from blockwright.operators import trainlog as L
from blockwright.plans import oracle as O
from blockwright.plans.fixtures import RDPTS, rdpts, table, tlog, vpix
from blockwright.session import work_dir
from blockwright.sources import container as CT
from blockwright.sources import images as IM

SQL: dict[str, str] = {}


def r6(c: str) -> F.Column:
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(c)


def q_number_text(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value").cast("double") / 7
    return table(spark, sf, "events").select("event_id", S.fixed_text(v, 3).alias("three"), S.fixed_text(F.when(F.col("event_id") % 10 > 0, v), 1).alias("one"))


SQL["q_number_text"] = "SELECT event_id, printf('%.3f', CAST(value AS DOUBLE)/7) AS three, CASE WHEN event_id%10 > 0 THEN printf('%.1f', CAST(value AS DOUBLE)/7) ELSE 'nan' END AS one FROM events"


def q_bits_per_pixel(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.bits_per_pixel(F.col("o_orderkey") % 5000, F.col("o_custkey") % 64 + 1, F.col("o_orderkey") % 48 + 1).alias("bpp")).withColumn("bpp", r6("bpp"))


SQL["q_bits_per_pixel"] = "SELECT o_orderkey, round((o_orderkey%5000)*8.0::DOUBLE/((o_custkey%64 + 1)*(o_orderkey%48 + 1)), 6) + 0.0 AS bpp FROM orders"


def q_extension_filter(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("png", "JPG", "txt", "Tiff", "gif", "webp", "png.bak", "")))
    path = F.concat(F.lit("some.dir/img"), "doc_id", F.lit("."), F.get(kinds, (F.col("doc_id") % 8).cast("int")))
    return table(spark, sf, "documents").select("doc_id", path.alias("path")).filter(IM.is_image(F.col("path")))


SQL["q_extension_filter"] = "WITH p AS (SELECT doc_id, concat('some.dir/img', doc_id, '.', ['png','JPG','txt','Tiff','gif','webp','png.bak',''][doc_id%8 + 1]) AS path FROM documents) SELECT * FROM p WHERE doc_id%8 IN (0, 1, 3, 5)"


def q_plot_feed(spark: SparkSession, sf: str) -> DataFrame:
    b = L.per_batch(tlog(spark, sf)).withColumn("phase", F.concat(F.lit(" "), F.upper("phase")))
    f = RD.plot_feed(b, 2, ["train"], log2=True)
    return f.select("epoch", "phase", "batch", "label", r6("rate"), "psnr_med")


SQL["q_plot_feed"] = f"WITH {O._BATCH} SELECT epoch, ' TRAIN' AS phase, batch, concat(epoch, ':', batch) AS label, round(log2(greatest(bpp_med, 1e-9)), 6) + 0.0 AS rate, psnr_med FROM pb WHERE epoch = 2 AND phase = 'train'"


def q_overlay_norm(spark: SparkSession, sf: str) -> DataFrame:
    return RD.overlay_norm(rdpts(spark, sf), ["k"], "y").select("k", r6("x"), r6("norm"))


SQL["q_overlay_norm"] = f"WITH rd AS ({RDPTS}), m AS (SELECT k, min(y) l, max(y) h FROM rd GROUP BY k) SELECT k, round(x, 6) + 0.0 AS x, round(CASE WHEN h = l THEN 0.5 ELSE (y - l)/(h - l) END, 6) + 0.0 AS norm FROM rd JOIN m USING (k)"


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.lit(0).alias("leaf"), (n - 1).cast("int").alias("rank"), (F.col("l_suppkey") % 3).alias("hp"), (n == 2).alias("target"))


def q_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return C.survivors(_hashed(spark, sf))


_HASHED = "c AS (SELECT l_orderkey image_id, 0 leaf, CAST(l_linenumber - 1 AS INT) rank, l_suppkey%3 hp, l_linenumber = 2 target FROM lineitem), t AS (SELECT image_id, max(hp) t FROM c WHERE target GROUP BY image_id)"
SQL["q_survivors"] = f"""WITH {_HASHED}, s AS (SELECT c.*, count(*) OVER (PARTITION BY image_id) n, row_number() OVER (PARTITION BY image_id ORDER BY rank) - 1 p FROM c JOIN t USING (image_id) WHERE hp = t.t)
SELECT image_id, leaf, CAST(n > 1 AS INT) AS refine_flag, CASE WHEN n > 1 THEN CAST(p AS INT) END AS refine_idx FROM s WHERE target"""


def q_decoder_choice(spark: SparkSession, sf: str) -> DataFrame:
    c = _hashed(spark, sf)
    want = (F.col("image_id") % 3).alias("want_hp")
    return C.decoder_choice(c.select("image_id", "leaf", "rank", "hp", F.when(F.col("image_id") % 5 > 0, 8).otherwise(0).alias("h_bits"), want, F.when(F.col("image_id") % 2 == 0, 1).alias("refine_idx")))


SQL["q_decoder_choice"] = f"""WITH {_HASHED}, g AS (SELECT image_id, leaf, list(rank ORDER BY rank) FILTER (hp = image_id%3 AND image_id%5 > 0) s FROM c GROUP BY ALL)
SELECT image_id, leaf, CAST(CASE WHEN s IS NULL OR len(s) = 0 THEN 0 WHEN len(s) = 1 THEN s[1] WHEN image_id%2 = 0 THEN s[2] ELSE s[1] END AS INT) AS rank FROM g"""


def q_obs_vector(spark: SparkSession, sf: str) -> DataFrame:
    t = FE.feature_table(P.luma(vpix(spark, sf)).withColumn("leaf", T.leaf_of(F.col("y"), F.col("x"), 8, 32)))
    both = FE.as_vector(t, 20).join(FE.as_vector(t, 2).withColumnRenamed("f", "g"), ["image_id", "leaf"])
    return both.select("image_id", "leaf", *[(F.round(F.col("f")[k], 6) + F.lit(0.0)).alias(f"f{k}") for k in (0, 5, 17, 18, 19)], F.size("f").alias("n"), F.size("g").alias("m"), (F.round(F.col("g")[1], 6) + F.lit(0.0)).alias("g1"))


SQL["q_obs_vector"] = f'WITH f AS ({O.SQL["q_feature_vector"]}) SELECT image_id, leaf, {FE.NAMES[0]} AS f0, {FE.NAMES[5]} AS f5, {FE.NAMES[17]} AS f17, CAST(0 AS DOUBLE) AS f18, CAST(0 AS DOUBLE) AS f19, 20 AS n, 2 AS m, {FE.NAMES[1]} AS g1 FROM f'


def q_soft_weights(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("value").cast("double").alias("v"))
    low, mid, high = RO.soft_weights(F.col("v"), F.lit(10.0), F.lit(40.0), F.lit(90.0))
    weight = lambda invert: RO.soft_weight(F.col("v"), F.lit(10.0), F.lit(40.0), F.lit(90.0), 2.0, 1.0, 0.5, invert)
    out = e.select("event_id", low.alias("low"), mid.alias("mid"), high.alias("high"), weight(False).alias("weight"), weight(True).alias("inverted"))
    return out.select("event_id", *[r6(c) for c in out.columns[1:]])


SQL["q_soft_weights"] = """WITH e AS (SELECT event_id, CAST(value AS DOUBLE) v FROM events),
s AS (SELECT event_id, CASE WHEN v <= 40 THEN greatest(0.0, (40 - v)/30) ELSE 0.0 END a, CASE WHEN v <= 40 THEN greatest(0.0, 1 - (40 - v)/30) ELSE greatest(0.0, 1 - (v - 40)/50) END b, CASE WHEN v > 40 THEN greatest(0.0, (v - 40)/50) ELSE 0.0 END c FROM e),
n AS (SELECT event_id, a/(a + b + c) a, b/(a + b + c) b, c/(a + b + c) c FROM s)
SELECT event_id, round(a, 6) + 0.0 AS low, round(b, 6) + 0.0 AS mid, round(c, 6) + 0.0 AS high, round(2*a + b + 0.5*c, 6) + 0.0 AS weight, round(2*c + b + 0.5*a, 6) + 0.0 AS inverted FROM n"""


def q_environments(spark: SparkSession, sf: str) -> DataFrame:
    few = LD.environments(table(spark, sf, "region"), "r_regionkey", 12)
    many = LD.environments(table(spark, sf, "nation"), "n_nationkey", 7)
    return few.withColumn("source", F.lit("region")).unionAll(many.withColumn("source", F.lit("nation")))


SQL["q_environments"] = """WITH r AS (SELECT r_regionkey item, row_number() OVER (ORDER BY r_regionkey) - 1 n, count(*) OVER () c FROM region), n AS (SELECT n_nationkey item, row_number() OVER (ORDER BY n_nationkey) - 1 n FROM nation), e AS (SELECT unnest(range(12)) i)
SELECT CAST(i AS INT) AS env_id, item, 'region' AS source FROM e JOIN r ON i%c = n UNION ALL SELECT CAST(n AS INT), item, 'nation' FROM n WHERE n < 7"""


def q_batch_estimate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    n = LD.estimated_batches(d, "n_chars", 50_000, d.count(), order="doc_id")
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


SQL["q_batch_estimate"] = "WITH f AS (SELECT avg(n_chars) m FROM (SELECT n_chars FROM documents ORDER BY doc_id LIMIT 16)) SELECT CAST(greatest(1, ceil((SELECT count(*) FROM documents)/greatest(1, floor(50000/greatest(1, m))))) AS BIGINT) AS n FROM f"


def q_memory_batches(spark: SparkSession, sf: str) -> DataFrame:
    return LD.memory_batches(table(spark, sf, "documents"), "doc_id", "n_chars", 50_000).select("doc_id", "batch")


SQL["q_memory_batches"] = """WITH RECURSIVE d AS (SELECT doc_id, CAST(coalesce(n_chars, 0) AS BIGINT) b, row_number() OVER (ORDER BY doc_id) n FROM documents),
s AS (SELECT n, doc_id, b held, CAST(0 AS BIGINT) batch FROM d WHERE n = 1
 UNION ALL SELECT d.n, d.doc_id, CASE WHEN held > 0 AND held + b > 50000 THEN b ELSE held + b END, CASE WHEN held > 0 AND held + b > 50000 THEN batch + 1 ELSE batch END FROM s JOIN d ON d.n = s.n + 1)
SELECT doc_id, batch FROM s"""


def q_column_pick(spark: SparkSession, sf: str) -> DataFrame:
    headers = [["id", "BPP", "psnr"], ["file", "jpeg_bpp", "PSNR_db"], ["Path", "bits_per_pixel", "x"], ["a", "mean_bpp_x", "b"], ["a", "b", "c"]]
    picked = [(k, *(RD.pick_column(h, n) for n in (RD.KEY_NAMES, RD.RATE_NAMES, RD.PSNR_NAMES))) for k, h in enumerate(headers)]
    return spark.createDataFrame(picked, "n int, key string, rate string, psnr string")


SQL["q_column_pick"] = "SELECT CAST(n AS INT) AS n, key, rate, psnr FROM (VALUES (0, 'id', 'BPP', 'psnr'), (1, 'file', 'jpeg_bpp', 'PSNR_db'), (2, 'Path', 'bits_per_pixel', NULL), (3, NULL, 'mean_bpp_x', NULL), (4, NULL, NULL, NULL)) v(n, key, rate, psnr)"


def q_interp_ungrouped(spark: SparkSession, sf: str) -> DataFrame:
    p = rdpts(spark, sf).groupBy("x").agg(F.avg("y").alias("y"))
    return RD.interpolate(p, "x", "y", 0.41, name="psnr").unionAll(RD.interpolate(p, "x", "y", 99.0)).select(r6("psnr"))


_ALONE = f"WITH p AS (SELECT x, avg(y) y FROM ({RDPTS}) GROUP BY x), lo AS (SELECT x, y FROM p WHERE x <= 0.41 ORDER BY x DESC LIMIT 1), hi AS (SELECT x, y FROM p WHERE x >= 0.41 ORDER BY x LIMIT 1)"
SQL["q_interp_ungrouped"] = f"{_ALONE} SELECT round(CASE WHEN hi.x = lo.x THEN lo.y ELSE lo.y + (hi.y - lo.y)*(0.41 - lo.x)/(hi.x - lo.x) END, 6) + 0.0 AS psnr FROM lo, hi UNION ALL SELECT NULL"


def q_median_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = RD.median_summary(rdpts(spark, sf).selectExpr("k AS image", "x AS Bpp", "y AS psnr"), "sweep", 0.41, 27.3)
    names = ["source", "key_col", "bpp_col", "psnr_col", "a_median", "a_std", "a_n", "b_median", "b_std", "b_n"]
    return d.toDF(*names).select(*[r6(c) if c.endswith(("median", "std")) else F.col(c) for c in names])


SQL["q_median_summary"] = f"""SELECT 'sweep' AS source, 'image' AS key_col, 'Bpp' AS bpp_col, 'psnr' AS psnr_col, a.*, b.* FROM
(SELECT round(median(psnr), 6) + 0.0 AS a_median, round(stddev_pop(psnr), 6) + 0.0 AS a_std, count(psnr) AS a_n FROM (WITH {O._RD}, {O._interp("x", "y", 0.41)} SELECT v AS psnr FROM it)) a,
(SELECT round(median(bpp), 6) + 0.0 AS b_median, round(stddev_pop(bpp), 6) + 0.0 AS b_std, count(bpp) AS b_n FROM (WITH {O._RD}, {O._interp("y", "x", 27.3)} SELECT v AS bpp FROM it)) b"""


def q_bit_budget(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("user_id") % 7).cast("int").alias("run"), "event_id", (F.floor("value") % 97 + 1).cast("long").alias("bits"))
    return LD.within_budget(e, "run", "event_id", "bits", 2000)


SQL["q_bit_budget"] = """WITH RECURSIVE e AS (SELECT CAST(user_id%7 AS INT) run, event_id, CAST(floor(value) AS BIGINT)%97 + 1 bits, row_number() OVER (PARTITION BY user_id%7 ORDER BY event_id) n FROM events),
s AS (SELECT run, event_id, bits, n, bits <= 2000 took, CASE WHEN bits <= 2000 THEN 2000 - bits ELSE 2000 END room FROM e WHERE n = 1
 UNION ALL SELECT e.run, e.event_id, e.bits, e.n, e.bits <= s.room, CASE WHEN e.bits <= s.room THEN s.room - e.bits ELSE s.room END FROM s JOIN e ON e.run = s.run AND e.n = s.n + 1)
SELECT run, event_id, CAST(bits AS BIGINT) AS bits, CAST(room AS BIGINT) AS "left" FROM s WHERE took"""


def q_progress_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return LD.progress_ticks(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 12.5)


SQL["q_progress_ticks"] = "SELECT c_custkey, k*12.5::DOUBLE AS pct, CAST(ceil(c_custkey*(k*12.5::DOUBLE)/100) AS BIGINT) AS done FROM customer, range(1, 9) r(k)"


def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_dir(spark)}/customer-csv"
    IM.write_csv(table(spark, sf, "customer").withColumn("name", F.concat(F.lit('a, "'), "c_name")), path, ["c_custkey", "name", "nothing", "c_acctbal"])
    return IM.read_csv(spark, path, {"c_custkey": "bigint", "nothing": "double", "c_acctbal": "double", "name": "string"}).select("c_custkey", "name", "nothing", r6("c_acctbal"))


SQL["q_csv_roundtrip"] = "SELECT c_custkey, concat('a, \"', c_name) AS name, CAST(NULL AS DOUBLE) AS nothing, round(CAST(c_acctbal AS DOUBLE), 6) + 0.0 AS c_acctbal FROM customer"


def q_header_bytes(spark: SparkSession, sf: str) -> DataFrame:
    def made(batches):
        for b in batches:
            rows = []
            for k in b.column(0).to_pylist():
                w, h, block = k * 37 % 5000 + 300, k * 91 % 3000 + 300, 8 << k % 3
                data = CT.header_bytes(1 + k % 3, w, h, block, k + 1)
                back = CT.header_fields(data + b"rest")
                rows.append((k, data.hex().upper(), back["version"], back["w"], back["h"], back["block"], back["n"], back["start"]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), *[pa.int64()] * 6)], ["s_suppkey", "head", "version", "w", "h", "block", "n", "start"])

    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long")).mapInArrow(made, "s_suppkey long, head string, version long, w long, h long, block long, n long, start long")


SQL["q_header_bytes"] = f"""WITH s AS (SELECT CAST(s_suppkey AS BIGINT) k, s_suppkey*37%5000 + 300 w, s_suppkey*91%3000 + 300 h, 8*CAST(power(2, s_suppkey%3) AS BIGINT) b FROM supplier)
SELECT k AS s_suppkey, concat('414D4249', printf('%04X', 1 + k%3), printf('%08X', w), printf('%08X', h), printf('%04X', b), {O._hex("(k + 1)")}) AS head, 1 + k%3 AS version, w, h, b AS block, k + 1 AS n, 16 + CAST(ceil(length(bin(k + 1))/7.0) AS BIGINT) AS start FROM s"""


def q_index_bytes(spark: SparkSession, sf: str) -> DataFrame:
    def made(batches):
        for b in batches:
            rows = []
            for k in b.column(0).to_pylist():
                body = bytes(k % 900 + 10)
                got = CT.read_index(body + CT.index_bytes([(3, 4), (len(body) // 2 + 3, k)], 1 + k % 2, k))
                (a, m, n), (c, d, e) = got["ranges"]
                rows.append((k, a, m, n, c, d, e, got["payload_end"], got["crc"], CT.read_index(body) is None))
            kinds = (*[pa.int64()] * 9, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], ["o_orderkey", "a", "b", "n", "c", "d", "m", "payload_end", "crc", "no_index"])

    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("long")).mapInArrow(made, "o_orderkey long, a long, b long, n long, c long, d long, m long, payload_end long, crc long, no_index boolean")


SQL["q_index_bytes"] = "WITH o AS (SELECT CAST(o_orderkey AS BIGINT) k, CAST(o_orderkey AS BIGINT)%900 + 10 size FROM orders) SELECT k AS o_orderkey, CAST(3 AS BIGINT) AS a, size//2 + 3 AS b, CAST(4 AS BIGINT) AS n, size//2 + 3 AS c, size AS d, k AS m, size AS payload_end, CASE WHEN k%2 = 1 THEN k END AS crc, TRUE AS no_index FROM o"


def _images(spark: SparkSession, sf: str) -> DataFrame:
    g = vpix(spark, sf).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "c", "v"))), lambda s: s["v"]).alias("px"))
    return g.select("image_id", F.lit(32).alias("w"), F.lit(32).alias("h"), "px")


def q_root_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return E.episodes(_images(spark, sf), lambda f, w, h: (False, 12, 1, 0), 12, 4).select("image_id", "t", "x", "y", "w", "h", "split")


SQL["q_root_tiles"] = f"WITH {O.VPIX}, i AS (SELECT DISTINCT image_id FROM vpix) SELECT image_id, CAST(r*3 + c AS INT) AS t, CAST(c*12 AS INT) AS x, CAST(r*12 AS INT) AS y, CAST(least(12, 32 - c*12) AS INT) AS w, CAST(least(12, 32 - r*12) AS INT) AS h, 0 AS split FROM i, range(3) a(r), range(3) b(c)"


def q_agent_splits(spark: SparkSession, sf: str) -> DataFrame:
    e = E.episodes(_images(spark, sf), lambda f, w, h: (True, 12, 1, 0), 16, 8)
    return e.select("image_id", "t", "x", "y", "w", "h", "split", (F.round(F.when(F.col("split") == 1, F.col("reward")), 6) + F.lit(0.0)).alias("split_reward"))


SQL["q_agent_splits"] = f"""WITH {O.VPIX}, i AS (SELECT DISTINCT image_id FROM vpix)
SELECT image_id, CAST(((r*2 + c)*5 + k) AS INT) AS t, CAST(c*16 + CASE WHEN k IN (2, 4) THEN 8 ELSE 0 END AS INT) AS x, CAST(r*16 + CASE WHEN k IN (3, 4) THEN 8 ELSE 0 END AS INT) AS y, CAST(CASE WHEN k = 0 THEN 16 ELSE 8 END AS INT) AS w, CAST(CASE WHEN k = 0 THEN 16 ELSE 8 END AS INT) AS h, CAST(k = 0 AS INT) AS split, CASE WHEN k = 0 THEN round(-1.0::DOUBLE/256, 6) END AS split_reward FROM i, range(2) a(r), range(2) b(c), range(5) d(k)"""


def q_area_resize(spark: SparkSession, sf: str) -> DataFrame:
    def shrunk(t: pa.Table) -> pa.Table:
        small = M.area_resize(ME.cube(t, "v").astype("float64"), 12, 20)
        y, x, c = (k.ravel() for k in np.indices(small.shape))
        return pa.table({"image_id": pa.array([t["image_id"][0].as_py()] * small.size, pa.int32()), "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "c": pa.array(c, pa.int32()), "v": small.ravel()})

    return vpix(spark, sf).groupBy("image_id").applyInArrow(shrunk, "image_id int, y int, x int, c int, v double").select("image_id", "y", "x", "c", r6("v"))


SQL["q_area_resize"] = f"""WITH {O.VPIX}, k AS (SELECT i x, i*32//20 a, ((i + 1)*32 + 19)//20 b FROM range(20) t(i)),
rr AS (SELECT i y, i*32//12 a, ((i + 1)*32 + 11)//12 b FROM range(12) t(i))
SELECT image_id, CAST(rr.y AS INT) AS y, CAST(k.x AS INT) AS x, c, round(avg(CAST(v AS DOUBLE)), 6) + 0.0 AS v FROM vpix p JOIN rr ON p.y >= rr.a AND p.y < rr.b JOIN k ON p.x >= k.a AND p.x < k.b GROUP BY image_id, rr.y, k.x, c"""


def q_log_rrel_epoch(spark: SparkSession, sf: str) -> DataFrame:
    lines = tlog(spark, sf)
    return L.reward_classes(L.per_batch(lines), blue_above=0.5, epochs=L.per_epoch(lines)).select("epoch", "phase", "batch", r6("r_rel"), "class")


SQL["q_log_rrel_epoch"] = f"""WITH e AS ({O.SQL["q_log_per_epoch"]}), m AS (SELECT * FROM ({O.SQL["q_log_per_batch"]})), a AS (SELECT epoch, phase, avg(R) a FROM m GROUP BY ALL),
z AS (SELECT m.epoch, m.phase, m.batch, R, coalesce(nullif(CASE WHEN m.phase = 'train' THEN train_Wtotal ELSE val_Wtotal END, 0), a) b FROM m JOIN a USING (epoch, phase) LEFT JOIN e ON e.epoch = m.epoch),
y AS (SELECT *, CASE WHEN b = 0 THEN 0.0 ELSE (R - b)/abs(b) END rel FROM z)
SELECT epoch, phase, batch, round(rel, 6) + 0.0 AS r_rel, CASE WHEN rel > 0.5 THEN 'BLUE' WHEN R > b THEN 'GREEN' ELSE 'RED' END AS class FROM y"""

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
#: The twins of all registered queries of the library's first half.
ALL_SQL = O.SQL | SQL
