"""Georeferencing of many jobs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fewest control points of each transform.
LEAST = {"affine": 3, "projective": 4, "poly2": 6, "poly3": 10, "tps": 3}
MODEL = "job_id, a, b, c, d, e, f"


def fit_affine(gcps: DataFrame) -> DataFrame:
    """gcps(job_id, gcp_id, px, py, mx, my, enabled) -> job_id and mx = a px + b py + c, my = d px + e py + f.

    Least squares by sums around the means, which need one aggregation; jobs with fewer than three points or points on
    a line give none."""
    g = gcps.where("enabled").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.avg("px").alias("px0"), F.avg("py").alias("py0"), F.avg("mx").alias("mx0"), F.avg("my").alias("my0"), *[F.covar_pop(u, v).alias(f"{u}{v}") for u, v in (("px", "px"), ("px", "py"), ("py", "py"), ("px", "mx"), ("py", "mx"), ("px", "my"), ("py", "my"))])
    det = F.col("pxpx") * F.col("pypy") - F.col("pxpy") ** 2
    g = g.withColumn("det", det).where((F.col("n") >= LEAST["affine"]) & (F.col("det") > 1e-9 * F.col("pxpx") * F.col("pypy")))
    solve = lambda m: ((F.col("pypy") * F.col(f"px{m}") - F.col("pxpy") * F.col(f"py{m}")) / F.col("det"), (F.col("pxpx") * F.col(f"py{m}") - F.col("pxpy") * F.col(f"px{m}")) / F.col("det"))
    (a, b), (d, e) = solve("mx"), solve("my")
    return g.select("job_id", a.alias("a"), b.alias("b"), d.alias("d"), e.alias("e"), "px0", "py0", "mx0", "my0").select("job_id", "a", "b", (F.col("mx0") - F.col("a") * F.col("px0") - F.col("b") * F.col("py0")).alias("c"), "d", "e", (F.col("my0") - F.col("d") * F.col("px0") - F.col("e") * F.col("py0")).alias("f"))


def apply_affine(rows: DataFrame) -> DataFrame:
    """Adds x, y of px, py by the row's model."""
    return rows.withColumn("x", F.expr("a * px + b * py + c")).withColumn("y", F.expr("d * px + e * py + f"))


def residuals(gcps: DataFrame, models: DataFrame) -> DataFrame:
    """job_id, rmse, residuals (map of control point to error), status."""
    r = apply_affine(gcps.where("enabled").join(models, "job_id")).withColumn("r", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    return r.groupBy("job_id").agg(F.sqrt(F.avg(F.col("r") ** 2)).alias("rmse"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("gcp_id").cast("string"), F.round("r", 9))))).alias("residuals")).withColumn("status", F.lit("computed"))


def consensus(gcps: DataFrame) -> DataFrame:
    """job_id, inliers, error, rejected: of the affines through three points of a job, the one with the most inliers, the
    smaller error sum breaking ties; points on a line are skipped. A job's points are few (a person set them)."""
    g = gcps.where("enabled")
    three = lambda s: g.select("job_id", *[F.col(c).alias(f"{c}{s}") for c in ("gcp_id", "px", "py", "mx", "my")])
    t = three(1).join(three(2), "job_id").where("gcp_id1 < gcp_id2").join(three(3), "job_id").where("gcp_id2 < gcp_id3")
    t = t.withColumn("det", F.expr("(px2 - px1) * (py3 - py1) - (px3 - px1) * (py2 - py1)")).where("abs(det) > 1e-9")
    for m, (p, q, c) in {"mx": ("a", "b", "c"), "my": ("d", "e", "f")}.items():
        t = t.withColumn(p, F.expr(f"(({m}2 - {m}1) * (py3 - py1) - ({m}3 - {m}1) * (py2 - py1)) / det")).withColumn(q, F.expr(f"((px2 - px1) * ({m}3 - {m}1) - (px3 - px1) * ({m}2 - {m}1)) / det")).withColumn(c, F.expr(f"{m}1 - {p} * px1 - {q} * py1"))
    span = g.groupBy("job_id").agg(F.greatest(F.lit(1e-9), 2 * F.greatest(F.max("mx") - F.min("mx"), F.max("my") - F.min("my")) / F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py"), F.lit(1e-12))).alias("limit"))
    models = t.select("job_id", F.struct("gcp_id1", "gcp_id2", "gcp_id3").alias("by"), *"abcdef").join(span, "job_id")
    e = apply_affine(models.join(g, "job_id")).withColumn("r", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    scored = e.groupBy("job_id", "by").agg(F.count_if(F.col("r") <= F.col("limit")).alias("inliers"), F.sum(F.when(F.col("r") <= F.col("limit"), F.col("r")).otherwise(0.0)).alias("error"), F.sort_array(F.array_compact(F.collect_list(F.when(F.col("r") > F.col("limit"), F.col("gcp_id"))))).alias("rejected"))
    return scored.groupBy("job_id").agg(F.max(F.struct("inliers", (-F.col("error")).alias("e"), "rejected")).alias("best")).select("job_id", "best.inliers", (-F.col("best.e")).alias("error"), "best.rejected")


def _basis(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    degree = {"affine": 1, "poly2": 2, "poly3": 3}[kind]
    return np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], axis=1)


def fit_other(gcps: DataFrame, kind: str) -> DataFrame:
    """job_id, kind, coefficients, rmse of polynomial, projective and thin-plate fits, one job in a group; too few points
    or a singular system give a status instead of coefficients. Points are scaled to the unit square first."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[pdf["enabled"]].sort_values("gcp_id")
        job = pdf["job_id"].iloc[0]
        if len(p) < LEAST[kind]:
            return pd.DataFrame({"job_id": [job], "kind": [kind], "coefficients": [[]], "rmse": [None], "status": ["too_few_points"]})
        x, y, m = p["px"].to_numpy(float), p["py"].to_numpy(float), p[["mx", "my"]].to_numpy(float)
        sx, sy = max(float(np.ptp(x)), 1e-12), max(float(np.ptp(y)), 1e-12)
        u, v = (x - x.min()) / sx, (y - y.min()) / sy
        try:
            if kind == "projective":
                zero, one = np.zeros_like(u), np.ones_like(u)
                rows = np.concatenate([np.stack([u, v, one, zero, zero, zero, -u * m[:, 0], -v * m[:, 0]], 1), np.stack([zero, zero, zero, u, v, one, -u * m[:, 1], -v * m[:, 1]], 1)])
                c = np.linalg.lstsq(rows, m.T.ravel(), rcond=None)[0]
                w = c[6] * u + c[7] * v + 1
                got = np.stack([(c[0] * u + c[1] * v + c[2]) / w, (c[3] * u + c[4] * v + c[5]) / w], 1)
            elif kind == "tps":
                d = np.hypot(u[:, None] - u, v[:, None] - v)
                kernel = np.where(d > 0, d**2 * np.log(np.where(d > 0, d, 1)), 0)
                flat = np.stack([np.ones_like(u), u, v], 1)
                system = np.block([[kernel, flat], [flat.T, np.zeros((3, 3))]])
                c = np.linalg.solve(system, np.vstack([m, np.zeros((3, 2))]))
                got = kernel @ c[:-3] + flat @ c[-3:]
            else:
                b = _basis(kind, u, v)
                c = np.linalg.lstsq(b, m, rcond=None)[0]
                got = b @ c
        except np.linalg.LinAlgError:
            return pd.DataFrame({"job_id": [job], "kind": [kind], "coefficients": [[]], "rmse": [None], "status": ["singular"]})
        rmse = float(np.sqrt(((got - m) ** 2).sum(1).mean()))
        return pd.DataFrame({"job_id": [job], "kind": [kind], "coefficients": [np.round(np.asarray(c).ravel(), 9).tolist()], "rmse": [round(rmse, 9)], "status": ["computed"]})

    return gcps.groupBy("job_id").applyInPandas(fit, f"job_id {dict(gcps.dtypes)['job_id']}, kind string, coefficients array<double>, rmse double, status string")


def projective_x(c: list[Column], u: Column, v: Column) -> tuple[Column, Column]:
    """Place of u, v by eight projective coefficients; null at the horizon."""
    w = c[6] * u + c[7] * v + 1
    at = lambda i: F.when(F.abs(w) > 1e-12, (c[i] * u + c[i + 1] * v + c[i + 2]) / w)
    return at(0), at(3)


def review(datasets: DataFrame, jobs: DataFrame) -> DataFrame:
    """A computed job's decision becomes its dataset's review status."""
    d = jobs.where("status = 'computed'").select("dataset_id", "decision")
    return datasets.join(d, "dataset_id", "left").select("dataset_id", F.coalesce("decision", "review_status").alias("review_status"))


def apply_other(gcps: DataFrame, points: DataFrame, kind: str) -> DataFrame:
    """points(job_id, point_id, px, py) -> x, y by the job's transform, fitted from its control points; null where the job
    has too few, or at a projective horizon. A job's points go to their control points by a co-group."""

    def predict(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"job_id": p["job_id"], "point_id": p["point_id"], "x": np.nan, "y": np.nan})
        g = g[g["enabled"]].sort_values("gcp_id") if len(g) else g
        if len(g) < LEAST[kind] or not len(p):
            return out
        x0, y0 = g["px"].min(), g["py"].min()
        sx, sy = max(float(np.ptp(g["px"])), 1e-12), max(float(np.ptp(g["py"])), 1e-12)
        scaled = lambda d: ((d["px"].to_numpy(float) - x0) / sx, (d["py"].to_numpy(float) - y0) / sy)
        (u, v), (s, t), m = scaled(g), scaled(p), g[["mx", "my"]].to_numpy(float)
        if kind == "projective":
            zero, one = np.zeros_like(u), np.ones_like(u)
            rows = np.concatenate([np.stack([u, v, one, zero, zero, zero, -u * m[:, 0], -v * m[:, 0]], 1), np.stack([zero, zero, zero, u, v, one, -u * m[:, 1], -v * m[:, 1]], 1)])
            c = np.linalg.lstsq(rows, m.T.ravel(), rcond=None)[0]
            w = c[6] * s + c[7] * t + 1
            w = np.where(np.abs(w) > 1e-12, w, np.nan)
            got = np.stack([(c[0] * s + c[1] * t + c[2]) / w, (c[3] * s + c[4] * t + c[5]) / w], 1)
        elif kind == "tps":
            bend = lambda d: np.where(d > 0, d**2 * np.log(np.where(d > 0, d, 1)), 0)
            flat = np.stack([np.ones_like(u), u, v], 1)
            system = np.block([[bend(np.hypot(u[:, None] - u, v[:, None] - v)), flat], [flat.T, np.zeros((3, 3))]])
            c = np.linalg.lstsq(system, np.vstack([m, np.zeros((3, 2))]), rcond=None)[0]
            got = bend(np.hypot(s[:, None] - u, t[:, None] - v)) @ c[:-3] + np.stack([np.ones_like(s), s, t], 1) @ c[-3:]
        else:
            got = _basis(kind, s, t) @ np.linalg.lstsq(_basis(kind, u, v), m, rcond=None)[0]
        out["x"], out["y"] = got[:, 0], got[:, 1]
        return out

    schema = f"job_id {dict(points.dtypes)['job_id']}, point_id {dict(points.dtypes)['point_id']}, x double, y double"
    out = gcps.groupBy("job_id").cogroup(points.groupBy("job_id")).applyInPandas(predict, schema)
    return out.select("job_id", "point_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xy"])


def job_status(jobs: DataFrame, computed: DataFrame) -> DataFrame:
    """jobs(job_id, status), computed(job_id, rmse) -> status: drafts with a fit are computed, approved jobs are locked."""
    j = jobs.join(computed.select("job_id", F.lit(True).alias("_fit")), "job_id", "left")
    locked = F.col("status") == "approved"
    return j.select("job_id", F.when(locked, "approved").when(F.col("_fit"), "computed").otherwise(F.col("status")).alias("status"), locked.alias("locked"))
