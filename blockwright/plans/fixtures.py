"""Derived views over the test tables: images, rate-distortion points and a training log.

The tables hold no image and no log, so deterministic views stand in. Each is given once, with the
few places where Spark and DuckDB differ as parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VPIX = """
SELECT CAST(floor(vec_id/48) AS INT) image_id,
       CAST(floor((CAST(floor(vec_id/3) AS INT)%16)/4)*8 + floor(pos/8) AS INT) y,
       CAST(((CAST(floor(vec_id/3) AS INT)%16)%4)*8 + pos%8 AS INT) x,
       CAST(vec_id%3 AS INT) c,
       CAST(greatest(least(e + CAST(0.5 AS FLOAT), CAST(1 AS FLOAT)), CAST(0 AS FLOAT)) AS FLOAT) v
FROM ({source}) s
WHERE vec_id < 48*CAST(floor((SELECT count(*) FROM embeddings)/48) AS BIGINT)
"""
VPIX_SPARK = _VPIX.format(source="SELECT vec_id, pos, e FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, e")
VPIX_DUCK = _VPIX.format(source="SELECT vec_id, generate_subscripts(embedding,1)-1 AS pos, unnest(embedding) AS e FROM embeddings")

#: The divisor 4999 avoids values that are exact decimal ties at six digits.
RDPTS = "SELECT l_suppkey k, l_quantity/25 x, 20 + avg(l_extendedprice)/4999 y FROM lineitem GROUP BY l_suppkey, l_quantity"

_FIVE = "(min=0.',lpad(CAST(n%100 AS {s}),2,'0'),', q1=0.3, q3=0.8, max=2.5)"
_FIVE_DB = "(min=2',CAST(n%10 AS {s}),'.5, q1=27.5, q3=35, max=41)"
_TLOG = (
    """
SELECT event_id line_no,
 CASE WHEN k=0 AND b<=50 THEN concat('[Epoch ',ep,'/10] Batch ',b,'/50')
      WHEN k=0 THEN concat('[Epoch ',ep,'/10] VAL ',b-50,'/50')
      WHEN k<=6 THEN concat('[PROGRESS] rollout ',k*15,'% (',k*15,'/100) elapsed=',k,'.',lpad(CAST(n%100 AS {s}),2,'0'),'s')
      WHEN k=7 THEN concat('[Epoch ',ep,'/10] ',CASE WHEN b<=50 THEN b ELSE b-50 END,'/50  ',
           CASE WHEN b<=50 THEN 'BATCH' ELSE 'VAL-BATCH' END,
           '  bpp=[0.',lpad(CAST(n%1000 AS {s}),3,'0'),', 0.5, 0.7, 1.1, 2.0]  PSNR=[20, 25.',lpad(CAST(n%100 AS {s}),2,'0'),
           ', 30, 35, 40]  MS=0.9  R~=-',CAST(n%10 AS {s}),'.',lpad(CAST(n%1000 AS {s}),3,'0'))
      WHEN k=8 THEN concat('[Epoch ',ep,'/10] ',CASE WHEN b<=50 THEN 'TRAIN-BATCH ' ELSE 'VAL-BATCH ' END,
           CASE WHEN b<=50 THEN b ELSE b-50 END,' elapsed=',n%100,'.5s')
      WHEN b=50 THEN concat('[RL] iter ',ep,'/10 bpp_med=0.',lpad(CAST(n%1000 AS {s}),3,'0'),' """
    + _FIVE
    + """ PSNR_med=30.',CAST(n%10 AS {s}),' dB """
    + _FIVE_DB
    + """ MS-SSIM_avg=0.95 Wtotal=-1.',lpad(CAST(n%100 AS {s}),2,'0'),' TRAIN_epoch_elapsed=1m',n%60,'s alpha_bpp=0.5 alpha_psnr=0.25')
      WHEN b=96 THEN concat('[VAL] iter ',ep,'/10 bpp_med=0.',lpad(CAST((n+7)%1000 AS {s}),3,'0'),' """
    + _FIVE
    + """ PSNR_med=31.',CAST(n%10 AS {s}),' dB """
    + _FIVE_DB
    + """ MS-SSIM_avg=0.93 Wtotal=-2.',lpad(CAST(n%100 AS {s}),2,'0'),' VAL_epoch_elapsed=1h2m',n%60,'s')
      WHEN b=97 THEN concat('[RL] (val-based) improved: val_bpp_med=',CASE WHEN n%2=0 THEN 'True' ELSE 'False' END,', val_psnr_med=',CASE WHEN n%3=0 THEN 'True' ELSE 'False' END,', wait=',ep%4,'/5')
      WHEN b=98 THEN concat('[RL] saved epoch checkpoint -> runs/epoch_',ep,'.pt')
      WHEN b=99 THEN concat('[Epoch ',ep,'/10] 49/50 TIME elapsed=',n%60,'s avg/batch=1.5s est_epoch=1m15s eta_epoch=0s')
      ELSE 'noise' END line
FROM (SELECT event_id, event_id%10 k,
             CAST(floor((event_id%1000)/10) AS INT)+1 b,
             CAST(floor(event_id/1000) AS INT)+1 ep,
             CAST(floor(value*100) AS BIGINT) n FROM events) t
"""
)
TLOG_SPARK = _TLOG.format(s="STRING")
TLOG_DUCK = _TLOG.format(s="VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vpix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels(image_id, y, x, c, v): 32 x 32 RGB mosaics of embedding vectors."""
    return spark.sql(VPIX_SPARK.replace("embeddings", "{embeddings}"), embeddings=table(spark, sf_dir, "embeddings"))


def rdpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rd points (k, x, y): one curve for each supplier."""
    return spark.sql(RDPTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def tlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines(file, file_no, line_no, line) in the trainer's grammar."""
    return spark.sql(TLOG_SPARK.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")).selectExpr("'train.log' AS file", "0 AS file_no", "line_no", "line")
