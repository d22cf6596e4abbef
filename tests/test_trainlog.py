import pytest

from blockwright.operators import trainlog as L


def lines(spark, *text, files=1):
    return spark.createDataFrame([("log", n * files // max(1, len(text)), n, t) for n, t in enumerate(text)], "file string, file_no int, line_no long, line string")


def metrics(e, b, r=-1.0, label="BATCH"):
    return f"[Epoch {e}/9] {b}/~5  {label}  bpp=[0.1, 0.2 , x, 0.4]  PSNR=[20 dB, 21, 22, 23, 24]  MS=0.9  R~={r}"


def test_progress_before_a_header_is_dropped_and_context_carries_over_files(spark):
    p = "[PROGRESS] rollout 50% (5/10) elapsed=1.50s (memory)"
    got = L.progress(lines(spark, p, "[Epoch 2/9] Batch 3/5", p, "noise", p, "[Epoch 2/9] VAL 1/~4", p, files=2)).orderBy("line_no").collect()
    assert [(r["line_no"], r["epoch"], r["phase"], r["batch"], r["pct"]) for r in got] == [(2, 2, "train", 3, 50), (4, 2, "train", 3, 50), (6, 2, "val", 1, 50)]


def test_elapsed_fills_the_latest_open_row(spark):
    t = lambda s: f"[Epoch 1/9] TRAIN-BATCH 1 elapsed={s}"
    got = L.per_batch(lines(spark, t("9s"), metrics(1, 1, -1), metrics(1, 1, -2), t("1m5s"), t("2s"), t("3s"), metrics(1, 1, -3), t("4s"), metrics(1, 1, -4))).orderBy("line_no").collect()
    assert [(r["R"], r["batch_elapsed_s"]) for r in got] == [(-1, 2), (-2, 65), (-3, 4), (-4, None)]
    assert got[0]["bpp_min"] == 0.1 and str(got[0]["bpp_med"]) == "nan" and str(got[0]["bpp_max"]) == "nan" and got[0]["psnr_min"] == 20 and got[0]["nbatch"] == "~5"


def test_epochs_merge_and_attach(spark):
    mid = "(min=0.1, q1=0.2, q3=0.4, max=0.5)"
    train = lambda e, m: f"[RL] iter {e}/9  bpp_med={m} {mid} PSNR_med=30 dB {mid} MS-SSIM_avg=0.9 Wtotal=-1 TRAIN_epoch_elapsed=1m1s alpha_bpp=0.5 alpha_psnr=0.1"
    val = f"[VAL] iter 3/9  bpp_med=0.7 {mid} PSNR_med=31 dB {mid} MS-SSIM_avg=0.8 Wtotal=-2 VAL_epoch_elapsed=5s"
    early, saved = "[RL] (val-based) improved: val_bpp_med=True, val_psnr_med=False, wait=2/5", "[RL] saved epoch checkpoint -> a/b.pt "
    got = {r["epoch"]: r for r in L.per_epoch(lines(spark, saved, train(1, 0.3), early, saved, metrics(2, 1), train(2, 0.4), train(2, 0.6), saved, val, "[RL] (VAL missing; using train) improved: bpp_med=True")).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1]["early_wait"] == 2 and got[1]["improved_bpp"] is True and got[1]["improved_psnr"] is False and got[1]["checkpoint"] == "a/b.pt" and got[1]["train_epoch_elapsed_s"] == 61
    assert got[2]["train_bpp_med"] == 0.6 and got[2]["checkpoint"] == "a/b.pt" and got[2]["val_ms_avg"] is None
    assert got[3]["val_Wtotal"] == -2 and got[3]["epochs_total"] is None


def test_latest_progress_ties(spark):
    p = lambda pct, s, n: f"[PROGRESS] x {pct}% ({n}/10) elapsed={s}s"
    f = L.progress(lines(spark, "[Epoch 1/9] Batch 1/5", p(50, "2.0", 1), p(50, "1.0", 2), p(50, "2.0", 3), p(40, "9.0", 4)))
    assert L.latest_progress(f).first()["done"] == 3


def test_totals_and_classes(spark):
    b = L.per_batch(lines(spark, metrics(1, 1, -1), metrics(1, 2, -3), metrics(1, 1, -2, "VAL-BATCH")))
    t = {r["phase"]: r for r in L.totals(b).collect()}
    assert t["train"]["R"] == -2 and t["train"]["bpp_med"] is None and t["val"]["n"] == 1
    assert {(r["batch"], r["class"]) for r in L.reward_classes(b).filter("phase = 'train'").collect()} == {(1, "GREEN"), (2, "RED")}
    epochs = spark.createDataFrame([(1, -3.0, 0.0)], "epoch int, train_Wtotal double, val_Wtotal double")
    assert {r["class"] for r in L.reward_classes(b, epochs=epochs).filter("phase = 'train' AND batch = 2").collect()} == {"RED"}


@pytest.mark.parametrize("run", [None, ["run"]])
def test_carried_values_do_not_depend_on_blocks(spark, monkeypatch, run):
    lines = []
    for file_no in range(3):
        for n in range(60):
            line = "noise"
            if n in (7, 31) and file_no != 1:
                line = f"[Epoch {file_no + 1}/9] Batch {n}/50" if n == 7 else f"[Epoch {file_no + 1}/9] VAL {n}/50"
            elif n % 5 == 0:
                line = f"[PROGRESS] roll {n}% ({n}/100) elapsed=1.0s"
            elif n == 33 and file_no != 1:
                line = f"[Epoch {file_no + 5}/9] 1/50  BATCH  bpp=[0.1, 0.2, 0.3, 0.4, 0.5]  PSNR=[20, 21, 22, 23, 24]  MS=0.9  R~=-1.5"
            elif n == 1 and file_no == 0:
                line = "[RL] iter 3/9  bpp_med=0.3 (min=0.1, q1=0.2, q3=0.4, max=0.5) PSNR_med=30 dB (min=0.1, q1=0.2, q3=0.4, max=0.5) MS-SSIM_avg=0.9 Wtotal=-1 TRAIN_epoch_elapsed=1m1s alpha_bpp=0.5 alpha_psnr=0.1"
            elif n in (3, 44):
                line = f"[RL] saved epoch checkpoint -> c{file_no}-{n}"
            lines += [(r, f"f{file_no}", file_no, n, line) for r in ("a", "b")[: 2 if run else 1]]
    df = spark.createDataFrame(lines, "run string, file string, file_no int, line_no long, line string").repartition(4)
    results = []
    for bits in (16, 2, 0):
        monkeypatch.setattr(L, "BLOCK_BITS", bits)
        results.append([sorted(map(tuple, f(df, run).collect()), key=repr) for f in (L.progress, L.per_epoch)])
    assert results[0] == results[1] == results[2]
    assert {x[-1] for x in results[0][1]} == {"c0-3"}  # later ones belong to the epochs of metrics rows, which make no row
    runs, seen = (2, {}) if run else (1, {})
    for r, _, file_no, n, line in sorted(lines):
        if line.startswith("[Epoch") and "bpp" not in line:
            seen[r] = (file_no + 1, "train" if "Batch" in line else "val", n)
        elif line.startswith("[PROG") and r in seen:
            seen.setdefault("rows", []).append(seen[r])
    k = len(run or [])
    assert sorted(x[k + 3 : k + 6] for x in results[0][0]) == sorted(seen["rows"]) and len(seen["rows"]) % runs == 0
