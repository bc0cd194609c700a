"""Recovery of a four-variable system from one simulated series: seconds, RMSE, correlation and coverage of 90 % intervals
over drift, diffusion and intercepts; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np

from tideline.lineage import cut
from tideline.operators import gibbs, inference, statespace
from tideline.session import build

# Fixed values of the published problem. NOISE and START are variances, DIFFUSION standard deviations.
NAMES = ["Stress", "Fatigue", "Focus", "Perf"]
DRIFT = [[-0.8, 0.0, 0.0, 0.0], [0.3, -0.5, 0.0, 0.0], [-0.2, -0.3, -0.6, 0.0], [0.0, 0.0, 0.4, -0.7]]
DIFFUSION, CINT = [0.4, 0.3, 0.3, 0.25], [0.5, 0.0, 0.3, 0.0]
LOADING = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0], [0.6, 0.5, 0.0, 0.0], [0.0, 0.0, 0.4, 0.7]]
MEANS, NOISE = [0.0, 0.0, 0.0, 0.0, 1.0, 2.0], [0.1, 0.1, 0.1, 0.1, 0.15, 0.15]
START, DT = 0.5, 0.5

SETTINGS = {
    "laplace": {}, "hmc": {"chains": 16, "steps": 90, "leaps": 6}, "nuts": {"chains": 12, "steps": 25, "warm": 20, "depth": 4},
    "tempered_smc": {"particles": 128, "moves": 8, "leaps": 3, "rounds": 8, "share": 0.5}, "svi": {"steps": 300, "batch": 16}, "hess_mc2": {"particles": 48, "steps": 6}, "pgas": {"chains": 4, "particles": 40, "rounds": 60, "moves": 1, "leaps": 6},
}


def main(method: str = "laplace", times: int = 80) -> None:
    cores = os.environ.get("RECOVERY_CORES", "4")
    spark = build("recovery", f"local[{cores}]", **{"spark.sql.shuffle.partitions": "1", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    a = np.array(DRIFT)
    system = statespace.System.one(a=a, q=np.diag(np.square(DIFFUSION)), c=CINT, h=LOADING, d=MEANS, r=np.diag(NOISE), m0=np.zeros(4), p0=START * np.eye(4))
    panel = statespace.simulate(spark, system, 1, times, DT, seed=42).coalesce(1)
    channels = [c for c in panel.columns if c not in ("series", "t")]
    # the first four rows of the loadings are the unit matrix; the eight entries of the others are free: 52 parameters
    free = {(channels[i], NAMES[i]): 1.0 for i in range(4)} | {(channels[i], x): None for i in (4, 5) for x in NAMES}
    model = inference.structural(NAMES, [(c, e) for e in NAMES for c in NAMES if c != e], channels, free, means=tuple(channels), starts=True)
    held = cut(statespace.sort_panel(panel, "series", "t"))
    target = inference.Target(held, model, "series", "t", channels, spread=int(cores))
    began = time.time()
    fit = gibbs.pgas if method == "pgas" else inference.METHODS[method]
    rows = fit(target, **SETTINGS[method]).toPandas()
    took = time.time() - began
    truth = {f"drift_{n}": DRIFT[i][i] for i, n in enumerate(NAMES)} | {f"effect_{e}_{c}": DRIFT[i][j] for i, e in enumerate(NAMES) for j, c in enumerate(NAMES) if i != j}
    truth |= {f"diffusion_{n}": DIFFUSION[i] for i, n in enumerate(NAMES)} | {f"cint_{n}": CINT[i] for i, n in enumerate(NAMES)}
    own = {k: rows.value[rows.param == k] for k in truth}
    got, want = np.array([own[k].mean() for k in truth]), np.array(list(truth.values()))
    inside = sum(own[k].quantile(0.05) <= v <= own[k].quantile(0.95) for k, v in truth.items())
    out = {
        "method": method, "times": times, "cores": int(cores), "parameters": len(model.names), "draws": int(rows.draw.nunique()), "seconds": round(took, 1),
        "rmse": round(float(np.sqrt(((got - want) ** 2).mean())), 3), "corr": round(float(np.corrcoef(got, want)[0, 1]), 3), "covered": f"{inside}/{len(want)}",
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "laplace", int(sys.argv[2]) if len(sys.argv) > 2 else 80)
