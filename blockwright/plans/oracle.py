"""DuckDB twins of the registered queries, written against the tables."""

from __future__ import annotations

from blockwright.plans.fixtures import RDPTS, TLOG_DUCK, VPIX_DUCK

VPIX = f"vpix AS ({VPIX_DUCK})"
PLANES = f"""{VPIX},
p AS (SELECT image_id, y, x, max(CASE WHEN c=0 THEN CAST(v AS DOUBLE) END) r, max(CASE WHEN c=1 THEN CAST(v AS DOUBLE) END) g,
             max(CASE WHEN c=2 THEN CAST(v AS DOUBLE) END) b FROM vpix GROUP BY image_id, y, x)"""
YCC = f"""{PLANES},
ycc AS (SELECT image_id, y, x, 0.299*r+0.587*g+0.114*b luma, -0.168736*r-0.331264*g+0.5*b+0.5 cb, 0.5*r-0.418688*g-0.081312*b+0.5 cr FROM p)"""
LEAF = "CAST((y//8)*4 + x//8 AS INT)"
BLOCKS = f"{YCC},\nb AS (SELECT image_id, y, x, {LEAF} leaf, least(greatest(luma, 0.0), 1.0) v FROM ycc)"
COARSE = """{v},
q AS (SELECT image_id, y, x, c, v, CAST(round_even(CAST(CAST(v*CAST(255 AS FLOAT) AS DOUBLE)/{s} AS FLOAT), 0) AS INT) AS level FROM vpix),
k AS (SELECT *, {leaf} leaf, CAST(CAST(CAST(level AS DOUBLE)*{s}/255.0 AS FLOAT) AS DOUBLE) AS coarse, CAST(v AS DOUBLE) t FROM q)"""


def coarse(step: int) -> str:
    return COARSE.format(v=VPIX, s=step, leaf=LEAF)


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


MSE = "avg(power(least(greatest({a},0.0),1.0) - least(greatest({b},0.0),1.0), 2))"
_EDGES = "WINDOW wx AS (PARTITION BY image_id, leaf, y ORDER BY x), wy AS (PARTITION BY image_id, leaf, x ORDER BY y)"
_SLOPES = f"""g AS (SELECT *,
  CASE WHEN lag(v) OVER wx IS NULL THEN lead(v) OVER wx - v WHEN lead(v) OVER wx IS NULL THEN v - lag(v) OVER wx ELSE (lead(v) OVER wx - lag(v) OVER wx)/2 END gx,
  CASE WHEN lag(v) OVER wy IS NULL THEN lead(v) OVER wy - v WHEN lead(v) OVER wy IS NULL THEN v - lag(v) OVER wy ELSE (lead(v) OVER wy - lag(v) OVER wy)/2 END gy,
  coalesce(lag(v) OVER wx, v) + coalesce(lead(v) OVER wx, v) + coalesce(lag(v) OVER wy, v) + coalesce(lead(v) OVER wy, v) - 4*v l
  FROM b {_EDGES})"""
_QUADRANT = "avg(v*v) FILTER (y%8 {y} 4 AND x%8 {x} 4)"
QUADRANTS = {"e_ll": _QUADRANT.format(y="<", x="<"), "e_lh": _QUADRANT.format(y="<", x=">="), "e_hl": _QUADRANT.format(y=">=", x="<"), "e_hh": _QUADRANT.format(y=">=", x=">=")}
_BIN = "CAST(least(floor(v*255), 255) AS INT)"
_ENTROPY = f"""e AS (SELECT image_id, leaf, -sum(n*1.0/64*log2(n*1.0/64)) entropy FROM (SELECT image_id, leaf, {_BIN} bin, count(*) n FROM b GROUP BY ALL) GROUP BY ALL)"""
FEATURES = f"""{BLOCKS}, {_SLOPES}, {_ENTROPY},
f AS (SELECT image_id, leaf, avg(v) mean, var_pop(v) var, avg(sqrt(gx*gx+gy*gy)) grad_mean, var_pop(sqrt(gx*gx+gy*gy)) grad_var, var_pop(l) lap_var,
      {", ".join(f"{x} {n}" for n, x in QUADRANTS.items())} FROM g GROUP BY image_id, leaf),
v18 AS (SELECT image_id, leaf, mean, var, grad_mean, grad_var, lap_var, entropy, e_ll, e_lh, e_hl, e_hh,
        CAST(0 AS DOUBLE) q_left, CAST(0 AS DOUBLE) q_top, CAST(0 AS DOUBLE) berr, CAST(1 AS DOUBLE) n, CAST(1 AS DOUBLE) s1, CAST(0 AS DOUBLE) s1_s2, CAST(1 AS DOUBLE) p_margin, CAST(0 AS DOUBLE) topk_var
        FROM f JOIN e USING (image_id, leaf))"""
NAMES = "mean var grad_mean grad_var lap_var entropy e_ll e_lh e_hl e_hh q_left q_top berr n s1 s1_s2 p_margin topk_var".split()
#: Splits by the activity of a square node, two levels: 32 -> 16 -> 8.
_STEPS = """s AS (SELECT image_id, y, x, luma v, abs(lead(luma) OVER (PARTITION BY image_id, y ORDER BY x) - luma) dx, abs(lead(luma) OVER (PARTITION BY image_id, x ORDER BY y) - luma) dy FROM ycc)"""


def _activity(block: int) -> str:
    return f"""SELECT image_id, CAST(x//{block}*{block} AS INT) bx, CAST(y//{block}*{block} AS INT) by_, var_pop(v) var,
  avg(dx+dy) FILTER (x%{block} < {block - 1} AND y%{block} < {block - 1}) grad FROM s GROUP BY ALL"""


_BANK = """n AS (SELECT *, (v0 + coalesce(lag(v0) OVER wy, last_value(v0) OVER fy) + coalesce(lead(v0) OVER wy, first_value(v0) OVER fy)
       + coalesce(lag(v0) OVER wx, last_value(v0) OVER fx) + coalesce(lead(v0) OVER wx, first_value(v0) OVER fx))/5.0 bl, avg(v0) OVER (PARTITION BY image_id, leaf, c) m
  FROM {source}
  WINDOW wy AS (PARTITION BY image_id, leaf, c, x ORDER BY y), wx AS (PARTITION BY image_id, leaf, c, y ORDER BY x),
         fy AS (PARTITION BY image_id, leaf, c, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
         fx AS (PARTITION BY image_id, leaf, c, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
bank AS (SELECT *, v0 same, bl blur, least(greatest(v0 + 0.5*(v0-bl), 0.0), 1.0) sharpen, least(greatest((v0-m)*1.08+m, 0.0), 1.0) contrast_up,
         least(greatest((v0-m)*0.92+m, 0.0), 1.0) contrast_down, least(greatest(v0+0.35*(v0-bl), 0.0), 1.0) edge_boost FROM n)"""
_KINDS = ("same", "blur", "sharpen", "contrast_up", "contrast_down", "edge_boost")


def _candidates(step: int, k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT image_id, leaf, {i} bank_no, '{n}' kind, -avg(power({n} - v0, 2)) score, {MSE.format(a=n, b='t')} mse FROM bank GROUP BY image_id, leaf" for i, n in enumerate(_KINDS[:k]))
    source = "(SELECT *, coarse v0 FROM k)"
    return f"""{coarse(step)}, {_BANK.format(source=source)},
cand AS ({parts}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id, leaf ORDER BY round(score, 12) DESC, bank_no) - 1 AS INT) "rank" FROM cand)"""


_RAW = "(SELECT *, {leaf} leaf, CAST(v AS DOUBLE) v0 FROM vpix)".format(leaf=LEAF)
_QUANTILE = "quantile_cont(a, {q})"
#: The cell of a place in 8 when split into 3: sizes 3, 3, 2.
_CELL = "CAST(CASE WHEN {a}%8 < 3 THEN 0 WHEN {a}%8 < 6 THEN 1 ELSE 2 END AS INT)"
_RESIDUAL = f"""{coarse(64)},
z AS (SELECT *, {_CELL.format(a="y")} cy, {_CELL.format(a="x")} cx FROM k),
l AS (SELECT image_id, leaf, CAST(3 AS INT) g, cy, cx, c, CAST(least(greatest(round_even(avg(t - coarse)/0.02, 0), -4), 4) AS INT) AS level FROM z GROUP BY ALL),
lv AS (SELECT * FROM l WHERE (image_id, leaf) IN (SELECT (image_id, leaf) FROM l WHERE level <> 0))"""


def _hex(value: str) -> str:
    """Upper-case hex of the LEB128 form."""
    n = f"greatest(1, CAST(ceil(length(bin({value}))/7.0) AS INT))"
    return f"list_aggregate(list_transform(range(0, {n}), lambda i: printf('%02X', (({value} >> CAST(7*i AS INT)) & 127) | (CASE WHEN i < {n} - 1 THEN 128 ELSE 0 END))), 'string_agg', '')"


SQL: dict[str, str] = {
    "q_rgb_to_ycc": f"WITH {YCC} SELECT image_id, y, x, {r6('luma')}, {r6('cb')}, {r6('cr')} FROM ycc",
    "q_ycc_roundtrip": f"""WITH {YCC}, back AS (SELECT ycc.image_id, r, g, b, luma + 1.402*(cr-0.5) r2, luma - 0.344136*(cb-0.5) - 0.714136*(cr-0.5) g2, luma + 1.772*(cb-0.5) b2 FROM ycc JOIN p USING (image_id, y, x))
SELECT image_id, {r6('max(abs(r2-r))', 'err_r')}, {r6('max(abs(g2-g))', 'err_g')}, {r6('max(abs(b2-b))', 'err_b')}, {r6('avg(r2)', 'mean_r')} FROM back GROUP BY image_id""",
    "q_save_bytes": f"""WITH {VPIX}, i AS (SELECT image_id, c, CAST(floor(least(greatest(v*255 + 0.5, 0), 255)) AS INT) u FROM vpix)
SELECT image_id, c, CAST(sum(u) AS BIGINT) AS total, min(u) AS low, max(u) AS high FROM i GROUP BY ALL""",
    "q_quantize_hist": f"WITH {coarse(12)} SELECT image_id, c, level, count(*) AS n FROM k GROUP BY ALL",
    "q_quant_psnr": f"WITH {coarse(12)}, m AS (SELECT image_id, {MSE.format(a='coarse', b='t')} e FROM k GROUP BY ALL) SELECT image_id, round(e, 9) AS mse, {r6('-10*log10(greatest(e, 1e-12))', 'psnr')} FROM m",
    "q_fixed_leaves": f"""WITH {VPIX}, i AS (SELECT DISTINCT image_id FROM vpix), g AS (SELECT unnest(range(0, 32, 12)) a), h AS (SELECT unnest(range(0, 32, 12)) b)
SELECT image_id, CAST(b//12*3 + a//12 AS INT) AS leaf_no, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(least(12, 32-a) AS INT) AS w, CAST(least(12, 32-b) AS INT) AS h FROM i, g, h""",
    "q_leaf_size_hist": f"""WITH {VPIX}, i AS (SELECT DISTINCT image_id FROM vpix), g AS (SELECT least(12, 32-unnest(range(0, 32, 12))) a), h AS (SELECT least(12, 32-unnest(range(0, 32, 12))) b)
SELECT concat(a, 'x', b) AS size, count(*) AS n FROM i, g, h GROUP BY ALL""",
    "q_chunks": f"WITH {VPIX}, i AS (SELECT DISTINCT image_id FROM vpix) SELECT image_id, CAST(k AS INT) AS chunk_no, CAST(k*32 AS INT) AS first_leaf, CAST(32 AS INT) AS cnt FROM i, (SELECT unnest([0, 1]) k)",
    "q_chunk_offsets": f"""WITH {VPIX}, i AS (SELECT DISTINCT image_id FROM vpix)
SELECT image_id, CAST(k AS INT) AS chunk_no, CAST(16 + k*32*100 AS BIGINT) AS start, CAST(16 + (k+1)*32*100 AS BIGINT) AS "end", CAST(32 AS INT) AS cnt FROM i, (SELECT unnest([0, 1]) k)""",
    "q_block_moments": f"WITH {BLOCKS} SELECT image_id, leaf, {r6('avg(v)', 'mean')}, {r6('var_pop(v)', 'var')} FROM b GROUP BY ALL",
    "q_block_entropy": f"WITH {BLOCKS}, {_ENTROPY} SELECT image_id, leaf, {r6('entropy')} FROM e",
    "q_block_gradient": f"WITH {BLOCKS}, {_SLOPES} SELECT image_id, leaf, {r6('avg(sqrt(gx*gx+gy*gy))', 'grad_mean')}, {r6('var_pop(sqrt(gx*gx+gy*gy))', 'grad_var')} FROM g GROUP BY ALL",
    "q_block_laplacian": f"WITH {BLOCKS}, {_SLOPES} SELECT image_id, leaf, {r6('var_pop(l)', 'lap_var')} FROM g GROUP BY ALL",
    "q_quadrant_energy": f"WITH {BLOCKS} SELECT image_id, leaf, {', '.join(r6(x, n) for n, x in QUADRANTS.items())} FROM b GROUP BY ALL",
    "q_feature_vector": f"WITH {FEATURES} SELECT image_id, leaf, {', '.join(r6(n) for n in NAMES)} FROM v18",
    "q_split_predicate": f"""WITH {YCC}, {_STEPS}, a AS ({_activity(16)})
SELECT image_id, bx, by_ AS "by", CAST(16 AS INT) AS bw, CAST(16 AS INT) AS bh, {r6('var')}, {r6('grad')}, var >= 0.0052 OR grad >= 0.16 AS split FROM a""",
    "q_quadtree_leaves": f"""WITH {YCC}, {_STEPS}, a32 AS ({_activity(32)}), a16 AS ({_activity(16)}),
t AS (SELECT image_id, var >= 0.0052 OR grad >= 0.16 AS cut FROM a32),
m AS (SELECT a16.image_id, bx, by_, var >= 0.0052 OR grad >= 0.16 AS cut FROM a16 JOIN t USING (image_id) WHERE t.cut),
l AS (SELECT image_id, 0 x, 0 y, 32 w FROM t WHERE NOT cut UNION ALL SELECT image_id, bx, by_, 16 FROM m WHERE NOT cut
      UNION ALL SELECT image_id, bx + d.x, by_ + d.y, 8 FROM m, (VALUES (0, 0), (8, 0), (0, 8), (8, 8)) d(x, y) WHERE cut)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y//16, x//16, y%16, x%16) - 1 AS INT) AS leaf_no, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(w AS INT) AS h FROM l""",
    "q_augment": f"""WITH {VPIX}, a AS (SELECT image_id, c, CAST(v AS DOUBLE) v, 'hflip' kind, y, 31-x x FROM vpix UNION ALL SELECT image_id, c, v, 'vflip', 31-y, x FROM vpix
 UNION ALL SELECT image_id, c, v, 'rot90', 31-x, y FROM vpix UNION ALL SELECT image_id, c, v, 'rot180', 31-y, 31-x FROM vpix UNION ALL SELECT image_id, c, v, 'rot270', x, 31-y FROM vpix)
SELECT image_id, kind, {r6('sum(v*(x+1))', 'mx')}, {r6('sum(v*(y+1)*(c+1))', 'my')}, count(*) AS n FROM a GROUP BY ALL""",
    "q_downsample2": f"WITH {YCC} SELECT image_id, CAST(y//2 AS INT) AS y, CAST(x//2 AS INT) AS x, {r6('avg(luma)', 'v')} FROM ycc GROUP BY image_id, y//2, x//2",
    "q_blur": f"WITH {VPIX}, {_BANK.format(source=_RAW)} SELECT image_id, leaf, c, {r6('avg(bl*bl)', 'energy')}, {r6('max(bl)', 'high')} FROM n GROUP BY ALL",
    "q_contrast": f"WITH {VPIX}, {_BANK.format(source=_RAW)} SELECT image_id, leaf, c, {r6('var_pop(contrast_up)', 'up')}, {r6('var_pop(contrast_down)', 'down')}, {r6('avg(sharpen)', 'sharp')}, {r6('avg(edge_boost)', 'edge')} FROM bank GROUP BY ALL",
    "q_candidate_rank": f'WITH {_candidates(12, 5)} SELECT image_id, leaf, kind, "rank", round(score, 9) AS score FROM ranked',
    "q_best_candidate": f'WITH {_candidates(48, 6)}, w AS (SELECT *, row_number() OVER (PARTITION BY image_id, leaf ORDER BY round(mse, 12), "rank") o FROM ranked) SELECT image_id, leaf, kind, "rank", round(mse, 9) AS mse FROM w WHERE o = 1',
    "q_margin_policy": f"""WITH {_candidates(12, 5)}, m AS (SELECT a.image_id, a.leaf, a.score - b.score d FROM ranked a JOIN ranked b USING (image_id, leaf) WHERE a."rank" = 0 AND b."rank" = 1)
SELECT image_id, leaf, round(d, 9) AS margin, CAST(CASE WHEN d >= 0.00003 THEN 0 ELSE 8 END AS INT) AS h_bits FROM m""",
    "q_budget_policy": f"""WITH {FEATURES}, u AS (SELECT image_id, leaf, abs(unnest([{', '.join(NAMES)}])) a FROM v18),
z AS (SELECT image_id, leaf, least(greatest(1 - exp(-3*(0.7*quantile_cont(a, 0.9) + 0.3*quantile_cont(a, 0.5))), 0.0), 1.0) complexity FROM u GROUP BY ALL)
SELECT image_id, leaf, {r6('complexity')}, CAST(least(greatest(round_even(20 - complexity*10, 0), 10), 20) AS INT) AS q, CAST(least(greatest(round_even(3 + complexity*3, 0), 3), 6) AS INT) AS k FROM z""",
    "q_residual_grid": f"WITH {_RESIDUAL} SELECT * FROM lv",
    "q_residual_apply": f"""WITH {_RESIDUAL}, o AS (SELECT z.image_id, z.t, z.coarse, CASE WHEN lv.level IS NULL THEN z.coarse ELSE least(greatest(z.coarse + lv.level*0.02, 0.0), 1.0) END refined FROM z LEFT JOIN lv USING (image_id, leaf, cy, cx, c))
SELECT image_id, round({MSE.format(a='coarse', b='t')}, 9) AS before, round({MSE.format(a='refined', b='t')}, 9) AS after FROM o GROUP BY ALL""",
    "q_varint": f"""SELECT o_orderkey, CAST(greatest(1, ceil(length(bin(o_orderkey*o_custkey))/7.0)) AS INT) AS n_bytes, {_hex('o_orderkey')} AS key_hex,
 {_hex('(o_orderkey*o_custkey)')} AS product_hex, o_orderkey*o_custkey AS back FROM orders""",
    "q_hash_prefix": """SELECT doc_id, CAST(concat('0x', substr(sha256(coalesce(text, '')), 1, 2)) AS BIGINT) AS h8,
 CAST(concat('0x', substr(sha256(coalesce(text, '')), 1, 4)) AS BIGINT) >> 3 AS h13 FROM documents""",
}

# ---- training log ----

_NUM = r"[-+]?[\d\.eE]+"
_HEADER = r"^\[Epoch\s+(\d+)/(\d+)\]\s+Batch\s+(\d+)/(~?\d+)\s*$"
_VAL = r"^\[Epoch\s+(\d+)/(\d+)\]\s+VAL\s+(\d+)/(~?\d+)"
_PROGRESS = r"^\[PROGRESS\]\s+(.+?)\s+(\d+)%\s+\((\d+)/(\d+)\)\s+elapsed=([\d\.]+)s"
_METRICS = r"^\[Epoch\s+(\d+)/(\d+)\]\s+(\d+)/(~?\d+)\s+(BATCH|VAL-BATCH|TOTAL)\s+bpp=\[([^\]]+)\]\s+PSNR=\[([^\]]+)\]\s+MS=(\S+)\s+R~=([-+]?[\d\.eE]+)"
_ELAPSED = r"^\[Epoch\s+(\d+)/(\d+)\]\s+(TRAIN-BATCH|VAL-BATCH)\s+(\d+)\s+elapsed=([\dhms\.]+)\s*$"
_TIME = r"TIME\s+elapsed="


def _x(pattern: str, group: int, kind: str = "INT") -> str:
    return f"TRY_CAST(regexp_extract(line, '{pattern}', {group}) AS {kind})"


_KINDED = f"""tlog AS ({TLOG_DUCK}),
kd AS (SELECT line_no, line, CASE WHEN regexp_matches(line, '{_HEADER}') THEN 'batch' WHEN regexp_matches(line, '{_VAL}') THEN 'val' WHEN regexp_matches(line, '{_PROGRESS}') THEN 'progress'
  WHEN regexp_matches(line, '{_METRICS}') THEN 'metrics' WHEN regexp_matches(line, '{_ELAPSED}') THEN 'elapsed' WHEN regexp_matches(line, '{_TIME}') THEN 'time'
  WHEN line LIKE '[RL] iter%' THEN 'train_summary' WHEN line LIKE '[VAL] iter%' THEN 'val_summary' WHEN line LIKE '[RL] (val-based)%' THEN 'early' WHEN line LIKE '[RL] saved epoch%' THEN 'saved' ELSE 'other' END kind FROM tlog)"""
_CONTEXT = f"""{_KINDED},
cx AS (SELECT *, CASE WHEN kind = 'batch' THEN concat({_x(_HEADER, 1)}, ':train:', {_x(_HEADER, 3)}) WHEN kind = 'val' THEN concat({_x(_VAL, 1)}, ':val:', {_x(_VAL, 3)}) END ctx FROM kd),
cf AS (SELECT *, last_value(ctx IGNORE NULLS) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) cur FROM cx),
pr AS (SELECT line_no, CAST(split_part(cur, ':', 1) AS INT) epoch, split_part(cur, ':', 2) phase, CAST(split_part(cur, ':', 3) AS INT) batch,
  regexp_extract(line, '{_PROGRESS}', 1) AS label, {_x(_PROGRESS, 2)} pct, {_x(_PROGRESS, 3)} done, {_x(_PROGRESS, 4)} total, {_x(_PROGRESS, 5, "DOUBLE")} elapsed_s FROM cf WHERE kind = 'progress' AND cur IS NOT NULL)"""
_PHASE = "CASE WHEN {x} IN ('BATCH', 'TOTAL', 'TRAIN-BATCH') THEN 'train' ELSE 'val' END"


def _five(group: int, name: str) -> str:
    parts = f"string_split(regexp_extract(line, '{_METRICS}', {group}), ',')"
    return ", ".join(f"TRY_CAST(trim({parts}[{i + 1}]) AS DOUBLE) {name}_{n}" for i, n in enumerate(("min", "q1", "med", "q3", "max")))


_SECONDS = """CASE WHEN {t} LIKE '%ms' THEN TRY_CAST(left({t}, length({t})-2) AS DOUBLE)/1000 WHEN {t} LIKE '%s' AND {t} NOT LIKE '%m%' AND {t} NOT LIKE '%h%' THEN TRY_CAST(left({t}, length({t})-1) AS DOUBLE)
 ELSE coalesce(TRY_CAST(regexp_extract({t}, '(\\d+)h', 1) AS DOUBLE), 0)*3600 + coalesce(TRY_CAST(regexp_extract({t}, '(\\d+)m', 1) AS DOUBLE), 0)*60 + coalesce(TRY_CAST(regexp_extract({t}, '([\\d\\.]+)s', 1) AS DOUBLE), 0) END"""
_BATCH = f"""{_KINDED},
mt AS (SELECT line_no, {_x(_METRICS, 1)} epoch, {_x(_METRICS, 2)} epochs_total, {_PHASE.format(x=f"regexp_extract(line, '{_METRICS}', 5)")} phase, {_x(_METRICS, 3)} batch, regexp_extract(line, '{_METRICS}', 4) nbatch,
  {_five(6, "bpp")}, {_five(7, "psnr")}, {_x(_METRICS, 8, "DOUBLE")} ms, {_x(_METRICS, 9, "DOUBLE")} R FROM kd WHERE kind = 'metrics'),
el AS (SELECT line_no eline, {_x(_ELAPSED, 1)} epoch, {_PHASE.format(x=f"regexp_extract(line, '{_ELAPSED}', 3)")} phase, {_x(_ELAPSED, 4)} batch, {_SECONDS.format(t=f"regexp_extract(line, '{_ELAPSED}', 5)")} t FROM kd WHERE kind = 'elapsed'),
pb AS (SELECT mt.*, (SELECT min_by(t, eline) FROM el WHERE el.epoch = mt.epoch AND el.phase = mt.phase AND el.batch = mt.batch AND eline > mt.line_no) batch_elapsed_s FROM mt)"""
_LIST = ", ".join(f"{k}_{n}" for k in ("bpp", "psnr") for n in ("min", "q1", "med", "q3", "max"))


def _summary(prefix: str, name: str, last: str, extra: str = "") -> str:
    n = _NUM
    pat = f"bpp_med=({n})\\s+\\(min=({n}),\\s+q1=({n}),\\s+q3=({n}),\\s+max=({n})\\)\\s+PSNR_med=({n})\\s+dB\\s+\\(min=({n}),\\s+q1=({n}),\\s+q3=({n}),\\s+max=({n})\\)\\s+MS-SSIM_avg=({n})\\s+Wtotal=({n})\\s+{last}=([\\dhms\\.]+)"
    cols = ", ".join(f"{_x(pat, i + 1, 'DOUBLE')} {prefix}_{c}" for i, c in enumerate("bpp_med bpp_min bpp_q1 bpp_q3".split()))
    # only nine groups can be named in one pattern
    rest = f"PSNR_med=({n})\\s+dB\\s+\\(min=({n}),\\s+q1=({n}),\\s+q3=({n}),\\s+max=({n})\\)"
    tail = f"MS-SSIM_avg=({n})\\s+Wtotal=({n})\\s+{last}=([\\dhms\\.]+)"
    top = f"q3={n},\\s+max=({n})\\)\\s+PSNR"
    cols += f", {_x(top, 1, 'DOUBLE')} {prefix}_bpp_max, " + ", ".join(f"{_x(rest, i + 1, 'DOUBLE')} {prefix}_{c}" for i, c in enumerate("psnr_med psnr_min psnr_q1 psnr_q3 psnr_max".split()))
    took = f"regexp_extract(line, '{tail}', 3)"
    cols += f", {_x(tail, 1, 'DOUBLE')} {prefix}_ms_avg, {_x(tail, 2, 'DOUBLE')} {prefix}_Wtotal, {_SECONDS.format(t=took)} {prefix}_epoch_elapsed_s"
    return f"SELECT CAST(regexp_extract(line, 'iter\\s+(\\d+)/', 1) AS INT) epoch, {cols}{extra} FROM kd WHERE kind = '{name}'"


_EPOCH = f"""{_BATCH},
tr AS ({_summary("train", "train_summary", "TRAIN_epoch_elapsed", r", CAST(regexp_extract(line, 'iter\s+\d+/(\d+)', 1) AS INT) epochs_total, TRY_CAST(regexp_extract(line, 'alpha_bpp=(\S+)', 1) AS DOUBLE) alpha_bpp, TRY_CAST(regexp_extract(line, 'alpha_psnr=(\S+)', 1) AS DOUBLE) alpha_psnr")}),
va AS ({_summary("val", "val_summary", "VAL_epoch_elapsed")}),
att AS (SELECT line, kind, line_no, last_value(CASE WHEN kind = 'metrics' THEN {_x(_METRICS, 1)} END IGNORE NULLS) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) epoch FROM kd),
es AS (SELECT epoch, max_by(regexp_extract(line, 'val_bpp_med=(\\w+)', 1) = 'True', line_no) improved_bpp, max_by(regexp_extract(line, 'val_psnr_med=(\\w+)', 1) = 'True', line_no) improved_psnr,
  max_by(CAST(regexp_extract(line, 'wait=(\\d+)/', 1) AS INT), line_no) early_wait, max_by(CAST(regexp_extract(line, 'wait=\\d+/(\\d+)', 1) AS INT), line_no) early_patience FROM att WHERE kind = 'early' GROUP BY epoch),
sv AS (SELECT epoch, max_by(trim(regexp_extract(line, '-> (.+)$', 1)), line_no) checkpoint FROM att WHERE kind = 'saved' GROUP BY epoch)"""

# ---- curves ----

_RD = f"rd AS ({RDPTS})"


def _interp(x: str, y: str, at: float) -> str:
    return f"""lo AS (SELECT k, max_by(struct_pack(x := {x}, y := {y}), {x}) p FROM rd WHERE {x} <= {at} GROUP BY k), hi AS (SELECT k, min_by(struct_pack(x := {x}, y := {y}), {x}) p FROM rd WHERE {x} >= {at} GROUP BY k),
ks AS (SELECT k, count(*) n FROM rd GROUP BY k),
it AS (SELECT ks.k, CASE WHEN n < 2 OR lo.p IS NULL OR hi.p IS NULL THEN NULL WHEN hi.p.x = lo.p.x THEN lo.p.y ELSE lo.p.y + (hi.p.y - lo.p.y)*({at} - lo.p.x)/(hi.p.x - lo.p.x) END v FROM ks LEFT JOIN lo USING (k) LEFT JOIN hi USING (k))"""


_Q = "quantile_cont(CAST({x} AS DOUBLE), {q})"


def _quart(x: str, name: str) -> str:
    return ", ".join(f"{r6(_Q.format(x=x, q=q), f'{name}_{n}')}" for q, n in ((0, "min"), (0.25, "q1"), (0.5, "med"), (0.75, "q3"), (1, "max")))


_ROLL = "roll AS (SELECT CAST(user_id % 7 AS INT) env_id, event_id t, CAST(value AS DOUBLE)/3 rew, CAST(value AS DOUBLE)/7 val, event_id % 50 = 49 AS done FROM events)"

SQL |= {
    "q_log_kinds": f"WITH {_KINDED} SELECT kind, count(*) AS n, min(line_no) AS first_line FROM kd GROUP BY kind",
    "q_log_progress": f"WITH {_CONTEXT} SELECT line_no, epoch, phase, batch, label, pct, done, total, elapsed_s FROM pr",
    "q_log_progress_latest": f"""WITH {_CONTEXT}, w AS (SELECT *, row_number() OVER (PARTITION BY phase, epoch, batch, label ORDER BY pct DESC, CASE WHEN elapsed_s = 0 THEN -1 ELSE elapsed_s END DESC, line_no DESC) o FROM pr)
SELECT epoch, phase, batch, label, pct, done, total, elapsed_s FROM w WHERE o = 1""",
    "q_log_per_batch": f"WITH {_BATCH} SELECT 'train.log' AS file, epoch, epochs_total, phase, batch, nbatch, {_LIST}, ms, R, batch_elapsed_s FROM pb",
    "q_log_per_epoch": f"""WITH {_EPOCH}, ids AS (SELECT epoch FROM tr UNION SELECT epoch FROM va UNION SELECT epoch FROM es WHERE epoch IS NOT NULL)
SELECT ids.epoch, tr.* EXCLUDE (epoch), va.* EXCLUDE (epoch), improved_bpp, improved_psnr, early_wait, early_patience, checkpoint FROM ids LEFT JOIN tr USING (epoch) LEFT JOIN va USING (epoch) LEFT JOIN es USING (epoch) LEFT JOIN sv USING (epoch)""",
    "q_log_totals": f"""WITH {_BATCH} SELECT epoch, phase, {', '.join(r6(f'avg({c})', c) for c in _LIST.split(', '))}, {r6('avg(ms)', 'ms')}, {r6('coalesce(avg(R), 0)', 'R')}, {r6('avg(batch_elapsed_s)', 'dt_avg')}, {r6('sum(batch_elapsed_s)', 'dt_total')}, count(*) AS n
FROM pb GROUP BY epoch, phase""",
    "q_log_rrel_class": f"""WITH {_BATCH}, base AS (SELECT epoch, phase, avg(R) a FROM pb GROUP BY ALL), z AS (SELECT pb.epoch, pb.phase, pb.batch, R, CASE WHEN a = 0 THEN 0.0 ELSE (R - a)/abs(a) END rel, a FROM pb JOIN base USING (epoch, phase))
SELECT epoch, phase, batch, {r6('rel', 'r_rel')}, CASE WHEN rel > 0.5 THEN 'BLUE' WHEN R > a THEN 'GREEN' ELSE 'RED' END AS class FROM z""",
    "q_duration_parse": f"""WITH t AS (SELECT event_id, CASE event_id%4 WHEN 0 THEN concat(event_id%900, 'ms') WHEN 1 THEN concat(event_id%60, '.25s') WHEN 2 THEN concat(event_id%50, 'm', event_id%60, 's') ELSE concat(event_id%9, 'h', event_id%60, 'm', event_id%59, '.5s') END t FROM events)
SELECT event_id, t AS text, {r6(_SECONDS.format(t='t'), 'seconds')} FROM t""",
    "q_duration_format": """WITH s AS (SELECT event_id, CAST(event_id*37 % 100000 AS DOUBLE)/4 s FROM events), n AS (SELECT *, CAST(round_even(s, 0) AS BIGINT) n FROM s)
SELECT event_id, CASE WHEN n//3600 > 0 THEN concat(n//3600, 'h', n%3600//60, 'm', n%60, 's') WHEN n%3600//60 > 0 THEN concat(n%3600//60, 'm', n%60, 's') ELSE concat(n%60, 's') END AS text FROM n""",
    "q_interp_psnr_at_bpp": f"WITH {_RD}, {_interp('x', 'y', 0.41)} SELECT k, {r6('v', 'psnr')} FROM it",
    "q_interp_bpp_at_psnr": f"WITH {_RD}, {_interp('y', 'x', 27.3)} SELECT k, {r6('v', 'bpp')} FROM it",
    "q_interp_summary": f"WITH {_RD}, {_interp('x', 'y', 0.41)} SELECT {r6('median(v)', 'psnr_median')}, {r6('stddev_pop(v)', 'psnr_std')}, count(v) AS psnr_n FROM it",
    "q_quality_sweep": f"WITH {_RD} SELECT CAST(k%13 AS INT) AS quality, {_quart('x', 'bpp')}, {_quart('y', 'psnr')} FROM rd GROUP BY ALL",
    "q_axis_limits": f"""WITH {_RD}, s AS (SELECT 'bpp' series, x v FROM rd UNION ALL SELECT 'log2_bpp', log2(greatest(x, 1e-9)) FROM rd UNION ALL SELECT 'psnr', y FROM rd)
SELECT series, {r6('min(v) - 0.05*(max(v) - min(v))', 'low')}, {r6('max(v) + 0.05*(max(v) - min(v))', 'high')} FROM s GROUP BY series""",
    "q_minmax_norm": f"WITH {_RD} SELECT k, {r6('x')}, {r6('(y - min(y) OVER ())/(max(y) OVER () - min(y) OVER ())', 'norm')}, {r6('log2(greatest(x, 1e-9))', 'log2_x')} FROM rd",
    "q_five_number": f"SELECT l_returnflag, {_quart('l_extendedprice', 'price')}, {_quart('l_quantity', 'qty')} FROM lineitem GROUP BY l_returnflag",
    "q_means": f"SELECT l_returnflag, count(*) AS n, {r6('sum(l_quantity)', 'total')}, {r6('avg(l_quantity)', 'mean')}, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag",
    "q_gae": f"""WITH RECURSIVE {_ROLL}, o AS (SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY t DESC) i, lead(val) OVER (PARTITION BY env_id ORDER BY t) nv FROM roll),
d AS (SELECT env_id, i, t, val, CASE WHEN done THEN 0 ELSE 1 END nt, rew + 0.99*coalesce(nv, 0)*(CASE WHEN done THEN 0 ELSE 1 END) - val AS delta FROM o),
g AS (SELECT env_id, i, t, val, CAST(delta AS DOUBLE) adv FROM d WHERE i = 1 UNION ALL SELECT d.env_id, d.i, d.t, d.val, CAST(d.delta + 0.99*0.95*d.nt*g.adv AS DOUBLE) FROM g JOIN d ON d.env_id = g.env_id AND d.i = g.i + 1)
SELECT env_id, t, {r6('adv', 'advantage')}, {r6('adv + val', 'ret')} FROM g""",
    "q_adv_norm": f"WITH {_ROLL} SELECT env_id, t, {r6('(rew - avg(rew) OVER ())/(stddev_samp(rew) OVER () + 1e-8)', 'norm')} FROM roll",
    "q_early_stop": """WITH RECURSIVE e AS (SELECT CAST(event_id%100 AS INT) run, CAST(event_id//100 AS INT) epoch, value/100 bpp, 30 + value/50 db FROM events),
s AS (SELECT run, epoch, bpp best_bpp, db best_db, 0 wait, FALSE stop FROM e WHERE epoch = 0
 UNION ALL SELECT e.run, e.epoch, CASE WHEN (CASE WHEN e.epoch < 2 THEN bpp < best_bpp ELSE best_bpp - bpp >= 0.01 END) THEN bpp ELSE best_bpp END, CASE WHEN (CASE WHEN e.epoch < 2 THEN db > best_db ELSE db - best_db >= 0.05 END) THEN db ELSE best_db END,
 CASE WHEN e.epoch < 2 OR best_bpp - bpp >= 0.01 OR db - best_db >= 0.05 THEN 0 ELSE wait + 1 END, e.epoch >= 2 AND NOT (best_bpp - bpp >= 0.01 OR db - best_db >= 0.05) AND wait + 1 >= 3 FROM s JOIN e ON e.run = s.run AND e.epoch = s.epoch + 1)
SELECT run, epoch, round(best_bpp, 6) AS best_bpp, round(best_db, 6) AS best_db, CAST(wait AS INT) AS wait, stop FROM s""",
    "q_batch_reward": f"""WITH {coarse(12)}, m AS (SELECT image_id, leaf, {MSE.format(a='coarse', b='t')} e, count(*)*2*8.0/64 bpp FROM k GROUP BY ALL),
z AS (SELECT image_id, avg(bpp) bpp, avg(-10*log10(greatest(e, 1e-12))) psnr, median(-10*log10(greatest(e, 1e-12))) med, avg(1 - e) ms FROM m GROUP BY ALL)
SELECT image_id, {r6('-(0.5*bpp + 0.25*greatest(0, med - 0.5 - psnr) + 1.0*greatest(0, 0.99 - ms))', 'reward')} FROM z""",
    "q_image_batches": """WITH b AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) s FROM documents) SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1)//16 AS INT) AS batch_no, CAST(s AS BIGINT) AS running_bytes FROM b""",
}
SQL["q_log_report"] = f"""WITH {_CONTEXT},
lp AS (SELECT *, row_number() OVER (PARTITION BY phase, epoch, batch, label ORDER BY pct DESC, CASE WHEN elapsed_s = 0 THEN -1 ELSE elapsed_s END DESC, line_no DESC) o FROM pr),
mt AS (SELECT {_x(_METRICS, 1)} epoch, {_PHASE.format(x=f"regexp_extract(line, '{_METRICS}', 5)")} phase, {_x(_METRICS, 3)} batch, {_x(_METRICS, 9, "DOUBLE")} R FROM kd WHERE kind = 'metrics')
SELECT epoch, phase, CAST(0 AS INT) AS section, batch, 'ROW' AS label, {r6('R', 'value')} FROM mt
UNION ALL SELECT lp.epoch, lp.phase, CAST(1 AS INT), lp.batch, concat('PROG ', label), {r6('CAST(pct AS DOUBLE)', 'value')} FROM lp SEMI JOIN mt ON lp.epoch = mt.epoch AND lp.phase = mt.phase AND lp.batch = mt.batch WHERE o = 1
UNION ALL SELECT epoch, phase, CAST(2 AS INT), CAST(NULL AS INT), 'TOTAL', {r6('coalesce(avg(R), 0)', 'value')} FROM mt GROUP BY epoch, phase"""
SQL["q_split_reward"] = f"""WITH {VPIX}, l AS (SELECT DISTINCT image_id, {LEAF} leaf_no FROM vpix)
SELECT image_id, leaf_no, CAST(1 AS INT) AS split, {r6('1.0/64', 'bpp')}, CAST(120 AS DOUBLE) AS psnr, {r6('-1.0/64', 'reward')} FROM l"""

