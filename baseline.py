"""

One JSON line like that of bench.py; compare with the queries of the same names there.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import numpy as np
import pandas as pd

D = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def pairs(columns: list[str]) -> pd.DataFrame:
    df = pd.read_parquet(f"{D}/generic_samples.parquet", columns=["dataset_id", "measurement", "reference", *columns])
    df = df[np.isfinite(df["measurement"]) & np.isfinite(df["reference"])]
    return df.assign(e=df["measurement"] - df["reference"])


def accuracy() -> pd.DataFrame:
    df = pairs([])
    df["a"], df["s"] = df["e"].abs(), df["e"] ** 2
    return df.groupby("dataset_id").agg(n=("e", "size"), bias=("e", "mean"), mae=("a", "mean"), mse=("s", "mean"), median=("a", "median"), most=("a", "max"))


def outliers() -> pd.Series:
    df = pairs([])
    off = df["e"] - df.groupby("dataset_id")["e"].transform("median")
    mad = off.abs().groupby(df["dataset_id"]).transform("median")
    return (np.abs(0.6744897501960817 * off / mad) > 3.5).groupby(df["dataset_id"]).sum()


def repeatability() -> pd.DataFrame:
    levels = pairs([]).groupby(["dataset_id", "reference"])["measurement"].agg(["size", "var"])
    levels = levels[levels["size"] >= 3]
    weight = levels["size"] - 1
    return np.sqrt((weight * levels["var"]).groupby(level=0).sum() / weight.groupby(level=0).sum())


def sampling() -> pd.DataFrame:
    df = pd.read_parquet(f"{D}/generic_samples.parquet", columns=["dataset_id", "row_ord", "timestamp"])
    df = df[np.isfinite(df["timestamp"])].sort_values(["dataset_id", "row_ord"])
    dt = df.groupby("dataset_id")["timestamp"].diff()
    return dt[dt > 0].groupby(df["dataset_id"]).agg(["median", "mean", "std", "max"])


def calibration() -> dict:
    out = {}
    for k, g in pairs(["row_ord"]).sort_values(["dataset_id", "row_ord"]).groupby("dataset_id"):
        n = len(g)
        held = max(1, min(n - 3, int(np.rint(n * 0.2))))
        if n >= 4 and g["measurement"].iloc[:-held].std() > 0:
            gain, offset = np.polyfit(g["measurement"].iloc[:-held], g["reference"].iloc[:-held], 1)
            e = gain * g["measurement"].iloc[-held:] + offset - g["reference"].iloc[-held:]
            out[k] = np.sqrt(np.mean(e**2))
    return out


def psd() -> dict:
    out = {}
    for k, g in pairs(["timestamp", "row_ord"]).sort_values(["dataset_id", "timestamp", "row_ord"]).groupby("dataset_id"):
        x = g["e"].to_numpy()[:1024]
        if len(x) >= 32:
            taper = np.hanning(len(x))
            out[k] = np.abs(np.fft.rfft((x - x.mean()) * taper)) ** 2 / np.sum(taper**2)
    return out


def main() -> None:
    seconds = {}
    for name, fn in {"generic_accuracy": accuracy, "generic_outlier_detection": outliers, "generic_repeatability": repeatability, "sampling_summary": sampling, "calibration_evaluation": calibration, "generic_psd": psd}.items():
        took = []
        for _ in range(6):
            began = time.perf_counter()
            fn()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "own_baseline", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(D.rstrip("/"))}))


if __name__ == "__main__":
    main()
