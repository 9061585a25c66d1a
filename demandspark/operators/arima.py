"""Per-city seasonal ARIMA(1,1,1)(1,1,1,24) by exact Gaussian likelihood (FC11).

``w_t = (1 - B)(1 - B^24) y_t`` is a stationary ARMA process, whose likelihood
is that of a Kalman filter of 26 states.  The filter's covariances do not
depend on the data, so given the parameters the state's recursion is linear,
and a chunk of a series has a *summary* that holds for any state it may start
from: the quadratic form of its innovations in that state, the affine map to
the state it ends in, and the sum of its log variances.  Summaries compose
associatively, so chunks of one city are filtered by different tasks and
composed in groups of bounded size, level by level; no task walks a city.

The four parameters are fitted for all cities together: every pass over the
chunks evaluates all candidates of a pattern search (two on each axis and the
vertex of the parabolas through the last ones), with the innovations' variance
concentrated out.  The driver holds a few numbers a city.

Rows with a null or NaN value are left out of a series; a city with too few training
rows (less than 26 and one difference) has no model and null predictions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.operators import seasonal
from demandspark.session import cut_lineage

SEASON = 24
STATES = SEASON + 2
SHORTEST = 8               # differenced rows needed for a fit
CHUNK_ROWS = 2_000
CHUNKS_PER_GROUP = 64
MAX_PASSES = 40
FIRST_STEP, LAST_STEP = 0.5, 0.02
_W = STATES + 1


def coefficients(params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """AR and MA coefficients 1..26 (the MA ones from 0) of (phi, Phi, theta, Theta) rows."""
    phi, seasonal_phi, theta, seasonal_theta = params.T
    ar, ma = np.zeros((len(params), STATES)), np.zeros((len(params), STATES))
    ar[:, 0], ar[:, SEASON - 1], ar[:, SEASON] = phi, seasonal_phi, -phi * seasonal_phi
    ma[:, 0], ma[:, 1], ma[:, SEASON], ma[:, SEASON + 1] = 1.0, theta, seasonal_theta, theta * seasonal_theta
    return ar, ma


def _moved(ar: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The state map applied to (candidates, states, columns)."""
    out = ar[:, :, None] * x[:, :1, :]
    out[:, :-1] += x[:, 1:]
    return out


class Gains:
    """Filter gains and innovation variances (in units of the noise) by time, until they settle."""

    def __init__(self, params: np.ndarray):
        self.ar, ma = coefficients(params)
        self.noise = ma[:, :, None] * ma[:, None, :]
        # stationary covariance by doubling: each turn adds as many terms of the series as there are
        step = np.zeros((len(params), STATES, STATES))
        step[:, :, 0] = self.ar
        step[:, np.arange(STATES - 1), np.arange(1, STATES)] += 1.0
        p = self.noise.copy()
        for _ in range(60):
            more = step @ p @ step.transpose(0, 2, 1)
            p = p + more
            if np.abs(more).max() <= 1e-15 * np.abs(p).max():
                break
            step = step @ step
        self.p, self.settled = p, False
        self.k: list[np.ndarray] = []
        self.f: list[np.ndarray] = []

    def at(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.f) <= t and not self.settled:
            p = self.p
            f = p[:, 0, 0].copy()
            k = _moved(self.ar, p[:, :, :1])[:, :, 0] / f[:, None]
            nxt = _moved(self.ar, _moved(self.ar, p).transpose(0, 2, 1)) + self.noise - f[:, None, None] * k[:, :, None] * k[:, None, :]
            self.k.append(k)
            self.f.append(f)
            self.settled = np.abs(nxt - p).max() <= 1e-14 * np.abs(p).max()
            self.p = (nxt + nxt.transpose(0, 2, 1)) / 2
        i = min(t, len(self.f) - 1)
        return self.k[i], self.f[i]


def summary(gains: Gains, start: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quadratic form, end map, log variances) of values ``w`` from time ``start`` on, per candidate.

    Both matrices act on (1, state at the start).
    """
    c = len(gains.ar)
    x = np.zeros((c, STATES, _W))
    x[:, :, 1:] = np.eye(STATES)
    quad, logs = np.zeros((c, _W, _W)), np.zeros(c)
    for i, value in enumerate(w):
        k, f = gains.at(start + i)
        v = -x[:, 0, :]
        v[:, 0] += value
        quad += v[:, :, None] * v[:, None, :] / f[:, None, None]
        logs += np.log(f)
        x = _moved(gains.ar, x) + k[:, :, None] * v[:, None, :]
    ends = np.zeros((c, _W, _W))
    ends[:, 0, 0] = 1.0
    ends[:, 1:, :] = x
    return quad, ends, logs


def composed(first: tuple, then: tuple) -> tuple:
    """The summary of two consecutive stretches."""
    quad, ends, logs = first
    return quad + ends.transpose(0, 2, 1) @ then[0] @ ends, then[1] @ ends, logs + then[2]


def log_likelihood(quad: float, logs: float, n: int) -> float:
    """With the innovations' variance at its best value."""
    return -0.5 * (n * (np.log(2 * np.pi) + 1 + np.log(max(quad, 1e-300) / n)) + logs)


def differenced(series: DataFrame, by: str = "city", order: Sequence[str] = ("local_time", "row_id"),
                value: str = "demand", train_share: float = 0.8) -> DataFrame:
    """Positions within each city, the training mark and ``w`` (null in the first 25 rows)."""
    known = series.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("row_id", by, *[o for o in order if o != "row_id"], value)
    pos = seasonal._positions(known, by, order, train_share)
    y = seasonal._lagged(pos, by, value, (1, SEASON, SEASON + 1), "_y")
    w = F.col(value) - F.col("_y1") - F.col(f"_y{SEASON}") + F.col(f"_y{SEASON + 1}")
    return cut_lineage(y.withColumn("w", w).drop("_y1", f"_y{SEASON}", f"_y{SEASON + 1}"))


def chunks(frame: DataFrame, by: str = "city", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(city, chunk, w): the training values of ``w`` in arrays of ``chunk_rows``."""
    t = F.col("pos") - (SEASON + 1)
    rows = frame.filter(F.col("is_train") & F.col("w").isNotNull()).select(by, t.alias("t"), "w")
    packed = rows.groupBy(by, F.floor(F.col("t") / chunk_rows).cast("long").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("t", "w"))).alias("s"))
    return cut_lineage(packed.select(by, "chunk", F.col("s.w").alias("w")))


_SUMMARY = "chunk long, n long, quad binary, ends binary, logs binary"


def evaluate(packed: DataFrame, candidates: dict[str, np.ndarray], by: str = "city", chunk_rows: int = CHUNK_ROWS) -> dict:
    """city -> (n, innovation squares, log variances, end states), each per candidate, in one pass and its compositions."""
    shared = packed.sparkSession.sparkContext.broadcast(candidates)

    def row(city: str, chunk: int, n: int, s: tuple) -> tuple:
        return (city, chunk, n, *[np.ascontiguousarray(x).tobytes() for x in s])

    columns = [by, "chunk", "n", "quad", "ends", "logs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains: dict[str, Gains] = {}
        for pdf in batches:
            out = []
            for city, chunk, w in zip(pdf[by], pdf["chunk"], pdf["w"]):
                if city in shared.value:
                    if city not in gains:
                        gains = {city: Gains(shared.value[city])}    # one city's at a time
                    w = np.asarray(w, float)
                    out.append(row(city, chunk, len(w), summary(gains[city], int(chunk) * chunk_rows, w)))
            yield pd.DataFrame(out, columns=columns)

    def unpacked(r) -> tuple:
        logs = np.frombuffer(r.logs)
        c = len(logs)
        return np.frombuffer(r.quad).reshape(c, _W, _W), np.frombuffer(r.ends).reshape(c, _W, _W), logs

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        total, n = None, 0
        for r in pdf.itertuples():
            s = unpacked(r)
            total = s if total is None else composed(total, s)
            n += r.n
        return pd.DataFrame([row(pdf[by].iloc[0], int(pdf["chunk"].iloc[0]) // CHUNKS_PER_GROUP, n, total)], columns=columns)

    schema = f"{by} string, {_SUMMARY}"
    level = packed.mapInPandas(run, schema)
    most = packed.agg(F.max("chunk").alias("m")).first()["m"]
    most = 0 if most is None else most
    while True:
        level = level.groupBy(by, F.floor(F.col("chunk") / CHUNKS_PER_GROUP)).applyInPandas(lambda k, p: join(p), schema)
        most //= CHUNKS_PER_GROUP
        if not most:
            break
    out = {}
    for r in level.collect():     # one row a city
        quad, ends, logs = unpacked(r)
        # a series starts from the stationary mean, 0
        out[r[by]] = (r["n"], quad[:, 0, 0], logs, ends[:, 1:, 0])
    return out


def fit(packed: DataFrame, by: str = "city", max_passes: int = MAX_PASSES, chunk_rows: int = CHUNK_ROWS) -> dict[str, dict]:
    """city -> params (phi, Phi, theta, Theta), sigma2, loglik, n and the state after the training rows."""
    sizes = {r[by]: r["n"] for r in packed.groupBy(by).agg(F.sum(F.size("w")).alias("n")).collect()}
    centre = {c: np.array([0.1, 0.1, -0.1, -0.5]) for c, n in sizes.items() if n >= SHORTEST}
    step = {c: FIRST_STEP for c in centre}
    best: dict[str, dict] = {}
    guess = dict(centre)

    def learn(city: str, z: np.ndarray, found: tuple, i: int) -> float:
        n, quad, logs, state = found
        value = log_likelihood(quad[i], logs[i], n)
        if city not in best or value > best[city]["loglik"]:
            best[city] = {"z": z, "params": np.tanh(z), "sigma2": float(quad[i] / n), "loglik": value, "n": int(n), "state": state[i]}
        return value

    for turn in range(max_passes):
        active = [c for c in centre if step[c] >= LAST_STEP]
        if not active:
            break
        tried = {c: np.vstack([guess[c]] + [centre[c] + s * step[c] * e for e in np.eye(4) for s in (-1, 1)]) for c in active}
        found = evaluate(packed, {c: np.tanh(z) for c, z in tried.items()}, by, chunk_rows)
        for c in active:
            before = best[c]["loglik"] if c in best else None
            values = [learn(c, z, found[c], i) for i, z in enumerate(tried[c])]
            if before is None:
                before = values[0]
            down, up = np.array(values[1::2]), np.array(values[2::2])
            bend = down + up - 2 * before
            with np.errstate(divide="ignore", invalid="ignore"):
                move = np.where(bend < 0, 0.5 * step[c] * (down - up) / bend, 0.0)
            guess[c] = np.clip(centre[c] + np.clip(np.nan_to_num(move), -2 * step[c], 2 * step[c]), -4, 4)
            if best[c]["loglik"] > before + 1e-6:
                centre[c] = np.clip(best[c]["z"], -4, 4)
            else:
                step[c] /= 2
    return best


def forecast(frame: DataFrame, models: dict[str, dict], by: str = "city", value: str = "demand") -> DataFrame:
    """(row_id, model, actual, prediction) of every test row, each from the state after its city's training rows."""
    tail = frame.filter(F.col("is_train") & (F.col("pos") >= F.col("n_train") - (SEASON + 1)))
    tails = {r[by]: [x["y"] for x in r["s"]] for r in tail.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("pos")).alias("p"), F.col(value).alias("y")))).alias("s")).collect()}
    known = {c: (m["params"], np.concatenate([m["state"], tails[c]])) for c, m in models.items()}
    shared = frame.sparkSession.sparkContext.broadcast(known)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values([by, "k"])
            out = np.full(len(pdf), np.nan)
            for city, at in pdf.groupby(by, sort=False).indices.items():
                if city not in shared.value:
                    continue
                params, z = shared.value[city]
                m, done = state_map(params), 0
                for i, k in zip(at, pdf["k"].to_numpy()[at].tolist()):
                    z = np.linalg.matrix_power(m, k - done) @ z if k - done > 1 else m @ z if k > done else z
                    out[i], done = z[STATES], k
            yield pd.DataFrame({"row_id": pdf["row_id"], "model": "seasonal_arima", "actual": pdf[value],
                                "prediction": [None if np.isnan(x) else x for x in out]})

    test = frame.filter(~F.col("is_train")).select("row_id", by, value, (F.col("pos") - F.col("n_train") + 1).alias("k"))
    return test.mapInPandas(score, f"row_id {frame.schema['row_id'].dataType.simpleString()}, model string, "
                                   "actual double, prediction double")


def state_map(params: np.ndarray) -> np.ndarray:
    """One step of (ARMA state, y_t .. y_{t-24}) without innovations."""
    m = np.zeros((STATES + SEASON + 1,) * 2)
    m[:STATES, 0] = coefficients(params[None])[0][0]
    m[np.arange(STATES - 1), np.arange(1, STATES)] += 1.0
    y = STATES
    m[y, 0], m[y, y], m[y, y + SEASON - 1], m[y, y + SEASON] = 1.0, 1.0, 1.0, -1.0
    m[np.arange(y + 1, len(m)), np.arange(y, len(m) - 1)] = 1.0
    return m


def predictions(series: DataFrame, by: str = "city", value: str = "demand", train_share: float = 0.8) -> DataFrame:
    """FC11: every city's test span, forecast by its maximum-likelihood model."""
    frame = differenced(series, by, value=value, train_share=train_share)
    return forecast(frame, fit(chunks(frame, by), by), by, value)
