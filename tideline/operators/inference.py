"""Bayesian fits of state-space models. The driver moves a small array of parameter particles; each round evaluates all of
them in one pass of Spark over all series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import families as fam
from tideline.functions.families import Emissions
from tideline.lineage import cut
from tideline.operators import lockstep, mixed, modes, slopes, statespace
from tideline.operators.mixed import Settings
from tideline.operators.statespace import System

#: What an unsettled system costs, and how fast it must settle at least; drift and diffusion of a latent
#: variable that does not change; falls of a profile likelihood that leave a value out at 95 % and 99 %, and the range
#: below which a profile is flat.
INSTABILITY, MARGIN, STILL = 1e4, 1e-9, 1e-6
#: Prior deviations beyond which a parameter has no likelihood.
FAR = 10.0
#: Of differences in parameters; and the gain in log-density below which a search for the mode ends.
EPS, LITTLE = 1e-4, 1e-3
DROPS, FLAT = {0.95: 1.92, 0.99: 3.32}, 0.5


@dataclass
class Model:
    """names: of the unconstrained parameters; mean, sd: their normal prior; build: systems of a batch of them; natural:
    the batch on its natural scale; emissions: families of the channels with the shapes that a batch has, None if all are
    normal."""

    names: list[str]
    mean: np.ndarray
    sd: np.ndarray
    build: Callable[[np.ndarray], System]
    natural: Callable[[np.ndarray], np.ndarray]
    emissions: Callable[[np.ndarray], Emissions] | None = None

    def log_prior(self, theta: np.ndarray) -> np.ndarray:
        """Normal density, less a penalty on systems that do not settle."""
        z = (theta - self.mean) / self.sd
        near = np.clip(theta, self.mean - FAR * self.sd, self.mean + FAR * self.sd)
        fastest = np.linalg.eigvals(self.build(near).a).real.max(axis=1)
        return (-0.5 * z**2 - np.log(self.sd) - 0.5 * np.log(2 * np.pi)).sum(axis=1) - INSTABILITY * np.maximum(fastest + MARGIN, 0)


    def slope_of_prior(self, theta: np.ndarray) -> np.ndarray:
        """Of its normal part: the penalty falls on systems that are given up anyway."""
        return -(theta - self.mean) / self.sd**2


def one_latent(m0: float = 0.0, p0: float = 1.0) -> Model:
    """One latent process measured once: drift -exp, diffusion sd exp, intercept, measurement sd exp."""

    def build(t: np.ndarray) -> System:
        k = len(t)
        full = lambda v, *shape: np.broadcast_to(np.asarray(v, float), (k,)).reshape(k, *shape)
        return System(
            a=full(-np.exp(t[:, 0]), 1, 1), q=full(np.exp(2 * t[:, 1]), 1, 1), c=full(t[:, 2], 1), h=full(1, 1, 1),
            d=full(0, 1), r=full(np.exp(2 * t[:, 3]), 1, 1), m0=full(m0, 1), p0=full(p0, 1, 1),
        )

    natural = lambda t: np.stack([-np.exp(t[:, 0]), np.exp(t[:, 1]), t[:, 2], np.exp(t[:, 3])], axis=1)
    return Model(["drift", "diffusion_sd", "cint", "measurement_sd"], np.array([-0.7, -0.7, 0.0, -0.7]), np.array([0.7, 0.7, 1.0, 0.7]), build, natural)


def log_gamma_prior(shape: float, rate: float) -> tuple[float, float]:
    """Mean and sd of the log of a gamma variable."""
    _, mean, var = fam.gammas(np.array(shape))
    return float(mean - np.log(rate)), float(np.sqrt(var))


#: Prior mean and sd of each kind of parameter, positive ones on the log scale; the last four from gamma priors on degrees of
#: freedom, shape, dispersion and precision (fixed values).
KINDS = {
    "drift": (-0.7, 0.7), "effect": (0.0, 0.5), "diffusion": (-1.0, 0.7), "cint": (0.0, 1.0), "loading": (0.5, 0.5), "mean": (0.0, 2.0), "noise": (-1.0, 0.7),
    "start": (0.0, 1.0), "spread": (-0.35, 0.5), "df": log_gamma_prior(5, 1), "shape": log_gamma_prior(2, 1), "r": log_gamma_prior(2, 0.5), "phi": log_gamma_prior(5, 0.5),
}
POSITIVE = ("drift", "diffusion", "noise", "spread", "df", "shape", "r", "phi")
#: What shapes a family beside its predictor.
SHAPES = {"student_t": "df", "gamma": "shape", "neg_binomial": "r", "beta": "phi"}


def structural(
    latents: list[str], edges: list[tuple[str, str]], channels: list[str], loadings: dict[tuple[str, str], float | None], still: tuple[str, ...] = (),
    means: tuple[str, ...] = (), priors: dict[str, tuple[float, float]] | None = None, families: list[str] | None = None, starts: bool = False,
) -> Model:
    """Several latent variables with the given effects (cause, effect) on each other's drift, measured by channels.

    loadings: (channel, latent) with its value, or None where it is free; others are zero. still: latent variables that do
    not change over time, whose drift and diffusion are fixed. means: channels with a mean of their own. priors: mean and sd
    of a parameter by name, or else of its kind. families: of the channels, normal if not given; the shape of a family is a
    parameter as well. The system starts as a normal of variance one about zero, or with starts has both as parameters."""
    families = families or ["gaussian"] * len(channels)
    n, p = len(latents), len(channels)
    moving = [x for x in latents if x not in still]
    slots = [("drift", x, x) for x in moving] + [("effect", e, c) for c, e in edges] + [("diffusion", x, x) for x in moving] + [("cint", x, x) for x in moving]
    slots += [("loading", ch, x) for (ch, x), v in loadings.items() if v is None] + [("mean", ch, ch) for ch in means] + [("noise", ch, ch) for ch, f in zip(channels, families) if f in ("gaussian", "student_t")]
    slots += [(SHAPES[f], ch, ch) for ch, f in zip(channels, families) if f in SHAPES] + [(kind, x, x) for kind in ("start", "spread") for x in latents if starts]
    names = [f"{kind}_{a}" if a == b else f"{kind}_{a}_{b}" for kind, a, b in slots]
    at = {x: i for i, x in enumerate(latents)} | {("channel", ch): i for i, ch in enumerate(channels)}
    known = priors or {}
    mean, sd = (np.array([known.get(name, KINDS[kind])[k] for name, (kind, _, _) in zip(names, slots)]) for k in (0, 1))
    positive = np.array([kind in POSITIVE for kind, _, _ in slots])
    down = np.array([kind == "drift" for kind, _, _ in slots])

    def natural(t: np.ndarray) -> np.ndarray:
        return np.where(positive, np.exp(np.where(positive, t, 0)), t) * np.where(down, -1, 1)

    def build(t: np.ndarray) -> System:
        k, value = len(t), natural(t)
        a, g, c = np.zeros((k, n, n)), np.zeros((k, n)), np.zeros((k, n))
        h, d, r = np.zeros((k, p, n)), np.zeros((k, p)), np.ones((k, p))
        m0, spread = np.zeros((k, n)), np.ones((k, n))
        for x in still:
            a[:, at[x], at[x]], g[:, at[x]] = -STILL, STILL
        for (ch, x), v in loadings.items():
            h[:, at["channel", ch], at[x]] = 0.0 if v is None else v
        for j, (kind, one, two) in enumerate(slots):
            if kind in ("drift", "effect"):
                a[:, at[one], at[two]] = value[:, j]
            elif kind == "loading":
                h[:, at["channel", one], at[two]] = value[:, j]
            elif kind not in SHAPES.values():
                target, place = {
                    "diffusion": (g, one), "cint": (c, one), "mean": (d, ("channel", one)), "noise": (r, ("channel", one)), "start": (m0, one), "spread": (spread, one)
                }[kind]
                target[:, at[place]] = value[:, j]
        eye = lambda v, size: (v**2)[:, :, None] * np.eye(size)
        return System(a=a, q=eye(g, n), c=c, h=h, d=d, r=eye(r, p), m0=m0, p0=eye(spread, n))

    def emissions(t: np.ndarray) -> Emissions:
        value, shapes = natural(t), {}
        for j, (kind, one, _) in enumerate(slots):
            if kind in SHAPES.values():
                shapes.setdefault(kind, np.full((len(t), p), fam.DEFAULTS[kind]))[:, at["channel", one]] = value[:, j]
        return Emissions(list(families), shapes)

    return Model(names, mean, sd, build, natural, None if set(families) == {"gaussian"} else emissions)


class Target:
    """Log-likelihood of batches of parameters over one panel (from sort_panel, best written down before).

    likelihood: kalman, composed, mixed (see `mixed`), laplace or bound (see `modes`); if not given, the first of them that serves the
    model's channels. how: settings of the mixed filter. spread: in how many parts a batch is dealt out, each with a pass of
    its own over the panel, side by side; of use where there are fewer series than cores."""

    def __init__(self, panel: DataFrame, model: Model, key: str, time: str, ys: list[str], likelihood: str | None = None, how: Settings | None = None, spread: int = 1):
        self.panel, self.model, self.on, self.how, self.spread = panel, model, (key, time, ys), how or Settings(), spread
        emissions = model.emissions(model.mean[None]) if model.emissions else Emissions(["gaussian"] * len(ys))
        near = model.build(model.mean + 0.3 * model.sd * np.random.default_rng(0).standard_normal((3, len(model.names))))
        self.split = mixed.blocks(((near.a != 0) | (near.q != 0) | (near.p0 != 0)).any(axis=0), (near.h != 0).any(axis=0), emissions.families, self.how.df)
        self.likelihood = likelihood or mixed.backend(emissions.families, self.split, self.how.df)
        if self.likelihood not in ("kalman", "composed", "mixed", "laplace", "bound"):
            raise ValueError(f"unknown likelihood: {self.likelihood}")
        if self.likelihood == "kalman" and not emissions.normal.all():
            raise ValueError("the Kalman filter serves normal channels only")
        self._packed = None

    @property
    def packed(self) -> DataFrame:
        """The panel as passes over it read it, written down once."""
        if self._packed is None:
            self._packed = cut(lockstep.packed(self.panel, *self.on))
        return self._packed

    def part(self, condition: Column) -> Target:
        """The same over the series that meet a condition."""
        return Target(self.panel.where(condition), self.model, *self.on, self.likelihood, self.how, self.spread)

    def per_series(self, theta: np.ndarray) -> DataFrame:
        """(key, system, n, loglik) of a batch."""
        system = self.model.build(theta)
        if self.likelihood == "kalman":
            return statespace.loglik(self.panel, system, *self.on)
        emissions = self.model.emissions(theta) if self.model.emissions else Emissions(["gaussian"] * len(self.on[2]))
        if self.likelihood == "composed":
            return mixed.composed_loglik(self.panel, system, emissions, self.split, *self.on, self.how)
        if self.likelihood == "mixed":
            return mixed.rb_loglik(self.panel, system, emissions, *self.on, self.how)
        total = modes.laplace_loglik if self.likelihood == "laplace" else modes.bound_loglik
        return total(self.panel, system, emissions, *self.on)

    def totals(self, theta: np.ndarray) -> DataFrame:
        """(system, loglik) of a batch, to be added up."""
        if self.likelihood == "kalman":
            return statespace.total_loglik(self.packed, self.model.build(theta), *self.on)
        emissions = self.model.emissions(theta) if self.model.emissions else Emissions(["gaussian"] * len(self.on[2]))
        if self.likelihood == "composed":
            return mixed.composed_loglik(self.packed, self.model.build(theta), emissions, self.split, *self.on, self.how, totals=True)
        if self.likelihood == "mixed":
            return mixed.rb_loglik(self.packed, self.model.build(theta), emissions, *self.on, self.how, totals=True)
        return self.per_series(theta).select("system", "loglik")

    def dealt(self, theta: np.ndarray, one: Callable[[np.ndarray], DataFrame]) -> DataFrame:
        """What `one` gives for a batch, or for the parts of it, with numbers of systems in the whole batch."""
        parts = np.array_split(np.arange(len(theta)), min(self.spread, len(theta)))
        made = [one(theta[p]).withColumn("system", F.col("system") + int(p[0])) for p in parts]
        return reduce(DataFrame.unionByName, made)

    def held(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which parameters a prior could give, and the batch with the others replaced: nothing is computed for those."""
        inside = (np.abs(theta - self.model.mean) <= FAR * self.model.sd).all(axis=1)
        return inside, np.where(inside[:, None], theta, self.model.mean)

    def __call__(self, theta: np.ndarray) -> np.ndarray:
        inside, held = self.held(theta)
        rows = self.dealt(held, self.totals).groupBy("system").agg(F.sum("loglik").alias("ll")).collect()  # one row for each particle
        out = np.zeros(len(theta))
        for r in rows:
            out[r.system] = r.ll
        return np.where(np.isfinite(out) & inside, out, -1e30)

    def value_and_slope(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods and their slopes: with the Kalman filter from one walk there and back, else by differences."""
        b, dim = theta.shape
        if self.likelihood != "kalman":
            eye = np.concatenate([np.zeros((1, dim)), np.eye(dim), -np.eye(dim)]) * EPS
            f = self((theta[:, None] + eye).reshape(-1, dim)).reshape(b, -1)
            return f[:, 0], (f[:, 1 : dim + 1] - f[:, dim + 1 :]) / (2 * EPS)
        inside, held = self.held(theta)
        rows = self.dealt(held, lambda t: slopes.value_and_slopes(self.packed, self.model.build(t), *self.on, apart=True)).toArrow()
        if not rows.num_rows:
            return np.where(inside, 0.0, -1e30), np.zeros((b, dim))
        table = np.zeros((b, int(np.max(rows.column("entry").to_numpy())) + 1))
        table[rows.column("system").to_numpy(), rows.column("entry").to_numpy()] = rows.column("value").to_numpy()
        slope = slopes.chained(self.model.build(held), table[:, 1:], self.model.build, held)
        fine = inside & np.isfinite(table).all(axis=1)
        return np.where(fine, table[:, 0], -1e30), np.where(fine[:, None], np.nan_to_num(slope), 0.0)


def draws(df_of: DataFrame, model: Model, theta: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(draw, param, value, weight) on the natural scale."""
    values = model.natural(theta)
    rows = [(i, name, float(values[i, j]), float(weights[i])) for i in range(len(values)) for j, name in enumerate(model.names)]
    return df_of.sparkSession.createDataFrame(rows, "draw int, param string, value double, weight double")


def _next_beta(ll: np.ndarray, beta: float, share: float) -> float:
    """The largest step for which the effective number of particles stays at `share` of all."""
    ess = lambda step: (w := np.exp(step * (ll - ll.max()))).sum() ** 2 / (w**2).sum() / len(ll)
    low, high = 0.0, 1 - beta
    if ess(high) >= share:
        return 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if ess(mid) >= share else (low, mid)
    return beta + low


def _posterior(target: Target, theta: np.ndarray, beta: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, log-density with the likelihood's exponent beta, its slope)."""
    ll, slope = target.value_and_slope(theta)
    model = target.model
    return ll, beta * ll + model.log_prior(theta), beta * slope + model.slope_of_prior(theta)


def _hmc_move(target: Target, theta, ll, value, slope, root: np.ndarray, size: float, leaps: int, beta: float, rng: np.random.Generator):
    """One step of each chain, in coordinates in which the precision of `root root'` is the mass; one leap makes it a Langevin
    step. Returns the chains as they are after it, and how likely each was to be taken."""
    p = rng.standard_normal(theta.shape)
    x, q = theta, p
    ll1, v1, g1 = ll, value, slope
    for _ in range(leaps):
        q = q + size / 2 * g1 @ root
        x = x + size * q @ root.T
        ll1, v1, g1 = _posterior(target, x, beta)
        q = q + size / 2 * g1 @ root
    gain = np.nan_to_num(v1 - value + 0.5 * ((p**2).sum(axis=1) - (q**2).sum(axis=1)), nan=-np.inf)
    taken = np.log(rng.random(len(theta))) < gain
    pick = lambda new, old: np.where(taken.reshape(-1, *[1] * (new.ndim - 1)), new, old)
    return pick(x, theta), pick(ll1, ll), pick(v1, value), pick(g1, slope), np.exp(np.minimum(gain, 0))


def tempered_smc(target: Target, particles: int = 128, moves: int = 4, leaps: int = 1, share: float = 0.5, rounds: int = 3, wanted: float | None = None, seed: int = 0, waste_free: bool = True) -> DataFrame:
    """Particles from the prior, moved towards the posterior: each level raises the likelihood's exponent as far as the
    effective sample size allows. Waste-free: particles // moves of them are drawn and moved, and all states that their chains
    go through are the next particles; else all are drawn and moved, and the last states count. Moves are Hamiltonian with
    the particles' precision as mass and a step size tuned towards the acceptance that is wanted. At the full likelihood
    there are `rounds` such rounds, of which all states but those of the first are kept."""
    model, rng = target.model, np.random.default_rng(seed)
    dim, wanted = len(model.names), wanted or (0.57 if leaps == 1 else 0.65)
    if waste_free and particles % moves:
        raise ValueError("waste-free moves need a number of particles that the moves divide")
    theta = model.mean + model.sd * rng.standard_normal((particles, dim))
    ll, _, slope = _posterior(target, theta)
    slope = slope - model.slope_of_prior(theta)
    beta, size, kept, done = 0.0, 1.0 / dim**0.25, [], 0
    while done < max(rounds, 1):
        after = _next_beta(ll, beta, share) if beta < 1 else 1.0
        w = np.exp((after - beta) * (ll - ll.max()))
        w /= w.sum()
        beta, n = after, particles // moves if waste_free else particles
        spread = np.cov(theta.T, aweights=w).reshape(dim, dim)
        # few particles say little about many correlations: these are drawn towards none
        spread = spread * 0.9 + np.diag(np.diag(spread)) * 0.1 if particles < 10 * dim else spread
        root = np.linalg.cholesky(spread + 1e-9 * np.eye(dim))
        take = np.minimum(np.searchsorted(np.cumsum(w), (rng.random() + np.arange(n)) / n), particles - 1)
        x, x_ll, x_slope = theta[take], ll[take], slope[take]
        value, grad = beta * x_ll + model.log_prior(x), beta * x_slope + model.slope_of_prior(x)
        seen = []
        for _ in range(moves):
            x, x_ll, value, grad, likely = _hmc_move(target, x, x_ll, value, grad, root, size, leaps, beta, rng)
            size = float(np.clip(size * np.exp(0.5 * (likely.mean() - wanted)), 1e-3, 2.0))
            seen.append((x, x_ll, (grad - model.slope_of_prior(x)) / beta))
        seen = seen if waste_free else seen[-1:]
        theta, ll, slope = (np.concatenate([row[i] for row in seen]) for i in range(3))
        if beta == 1:
            done += 1
            if done > 1 or rounds <= 1:
                kept.append(theta)
    made = np.concatenate(kept)
    return draws(target.panel, model, made, np.full(len(made), 1 / len(made)))


def _curvature(target: Target, theta: np.ndarray, eps: float = 1e-3) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-density, slope, second derivatives) of the posterior at one point, from one batch: of slopes around it where they
    come with the density, else of densities."""
    dim, eye = len(theta), np.eye(len(theta)) * eps
    if target.likelihood == "kalman":
        _, f, g = _posterior(target, theta + np.concatenate([np.zeros((1, dim)), eye, -eye]))
        hess = (g[1 : dim + 1] - g[dim + 1 :]) / (2 * eps)
        return f[0], g[0], (hess + hess.T) / 2
    pairs = [(i, j) for i in range(dim) for j in range(i)]
    both = [sign * (eye[i] + eye[j]) for i, j in pairs for sign in (1, -1)]
    points = theta + np.concatenate([np.zeros((1, dim)), eye, -eye, np.array(both).reshape(-1, dim)])
    f = target(points) + target.model.log_prior(points)
    up, down, mid = f[1 : dim + 1], f[dim + 1 : 2 * dim + 1], f[0]
    hess = np.diag((up - 2 * mid + down) / eps**2)
    for k, (i, j) in enumerate(pairs):
        two = f[2 * dim + 1 + 2 * k] + f[2 * dim + 2 + 2 * k]
        hess[i, j] = hess[j, i] = (two - up[i] - down[i] - up[j] - down[j] + 2 * mid) / (2 * eps**2)
    return mid, (up - down) / (2 * eps), hess


def mode(target: Target, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mode and the negative Hessian there, by Newton steps. Where it is flat or not concave yet, a step goes too far
    in some directions: steps with several amounts of damping are tried in one batch."""
    model = target.model
    theta = model.mean.copy()
    for n in range(rounds):
        value, grad, hess = _curvature(target, theta)
        values, vectors = np.linalg.eigh(-hess)
        sizes = np.maximum(np.abs(values), 1e-3)
        curve = (vectors * sizes) @ vectors.T
        along = vectors.T @ grad
        if np.abs(vectors @ (along / sizes)).max() < 2e-3 or n == rounds - 1:
            break
        damped = [0.0, *(sizes.max() * 10.0 ** np.arange(-4, 3))]
        steps = np.array([vectors @ (along / (sizes + x)) for x in damped])
        tried = theta + np.concatenate([np.clip(steps, -1, 1), np.clip(steps / 4, -1, 1)])
        best = target(tried) + model.log_prior(tried)
        if best.max() <= value:
            break
        theta = tried[int(best.argmax())]
        if best.max() < value + LITTLE:
            break
    return theta, curve


def laplace(target: Target, n: int = 200, seed: int = 0) -> DataFrame:
    """Draws from the normal approximation at the mode."""
    theta, curve = mode(target)
    made = np.random.default_rng(seed).multivariate_normal(theta, np.linalg.inv(curve), n)
    return draws(target.panel, target.model, made, np.full(n, 1 / n))


class StepSize:
    """Dual averaging of the log step size towards a wanted acceptance."""

    def __init__(self, size: float, wanted: float):
        self.size, self.wanted, self.centre, self.error, self.smooth, self.n = size, wanted, np.log(10 * size), 0.0, 0.0, 0

    def learn(self, accepted: float) -> None:
        self.n += 1
        self.error += (self.wanted - accepted - self.error) / (self.n + 10)
        log_size = self.centre - np.sqrt(self.n) / 0.05 * self.error
        self.smooth += self.n**-0.75 * (log_size - self.smooth)
        self.size = float(np.clip(np.exp(log_size), 1e-4, 3.0))

    def settle(self) -> None:
        if self.n:
            self.size = float(np.clip(np.exp(self.smooth), 1e-4, 3.0))


def hmc(target: Target, chains: int = 16, steps: int = 60, leaps: int = 4, seed: int = 0) -> DataFrame:
    """Chains started around the mode, with its curvature as mass, all in one batch. During the first third, which is not
    kept, the step size is tuned to accept four of five."""
    rng = np.random.default_rng(seed)
    centre, curve = mode(target)
    root = np.linalg.cholesky(np.linalg.inv(curve))
    theta = centre + rng.standard_normal((chains, len(centre))) @ root.T
    ll, value, slope = _posterior(target, theta)
    step, kept, warm = StepSize(0.5, 0.8), [], steps // 3
    for n in range(steps):
        theta, ll, value, slope, likely = _hmc_move(target, theta, ll, value, slope, root, step.size, leaps, 1.0, rng)
        if n < warm:
            step.learn(likely.mean())
        if n == warm - 1:
            step.settle()
        if n >= warm:
            kept.append(theta)
    made = np.concatenate(kept)
    return draws(target.panel, target.model, made, np.full(len(made), 1 / len(made)))


def nuts_chains(density: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], z: np.ndarray, steps: int, warm: int, depth: int = 8, wanted: float = 0.8, seed: int = 0, size: float = 0.5) -> tuple[np.ndarray, dict]:
    """Hamiltonian chains without a set length: each doubles its path, forwards or backwards, until its ends come towards each
    other, and draws one of the states on it by weight. All chains grow level by level, so that each leap of all of them is
    one call of `density` (values and slopes of a batch). Returns (steps, chains, dim) after `warm` steps in which the step
    size is tuned, and counts: the mean depth, the share of kept steps whose path diverged, and the step size."""
    rng = np.random.default_rng(seed)
    chains, dim = z.shape
    value, slope = density(z)
    step, kept, depths, lost = StepSize(size, wanted), [], [], 0
    for n in range(warm + steps):
        p0 = rng.standard_normal(z.shape)
        start = value - 0.5 * (p0**2).sum(axis=1)
        # the two ends of each path, the sum of momenta on it, its weight, and the state drawn so far
        ends = {s: (z.copy(), p0.copy(), slope.copy()) for s in (1, -1)}
        total, weight = p0.copy(), np.zeros(chains)
        drawn, drawn_v, drawn_g = z.copy(), value.copy(), slope.copy()
        going, accepted, counted, reached = np.ones(chains, bool), np.zeros(chains), np.zeros(chains), np.zeros(chains)
        for level in range(depth):
            live = np.flatnonzero(going)
            if not len(live):
                break
            way = np.where(rng.random(len(live)) < 0.5, 1, -1)
            x, p, g = (np.where((way == 1)[:, None], ends[1][i][live], ends[-1][i][live]) for i in range(3))
            k = len(live)
            sub_w, sub_sum = np.full(k, -np.inf), np.zeros((k, dim))
            sub_x, sub_v, sub_g = x.copy(), np.zeros(k), g.copy()
            fine, marks = np.ones(k, bool), {}
            for leaf in range(2**level):
                act = np.flatnonzero(fine)
                if not len(act):
                    break
                h = step.size * way[act][:, None]
                q = p[act] + h / 2 * g[act]
                at = x[act] + h * q
                v, gr = density(at)
                q = q + h / 2 * gr
                x[act], p[act], g[act] = at, q, gr
                w = np.nan_to_num(v - 0.5 * (q**2).sum(axis=1) - start[live[act]], nan=-np.inf)
                accepted[live[act]] += np.exp(np.minimum(w, 0))
                counted[live[act]] += 1
                fine[act[w < -1000]] = False
                lost += int((w < -1000).sum()) if n >= warm else 0
                both = np.logaddexp(sub_w[act], w)
                pick = np.log(rng.random(len(act))) < w - both
                sub_w[act] = both
                sub_x[act[pick]], sub_v[act[pick]], sub_g[act[pick]] = at[pick], v[pick], gr[pick]
                before = sub_sum.copy()
                sub_sum[act] += q
                # ends of the balanced subtrees that this leaf closes
                if leaf % 2 == 0:
                    marks[bin(leaf >> 1).count("1")] = (p.copy(), before)
                else:
                    low = bin(leaf >> 1).count("1")
                    closes = len(bin(leaf)) - len(bin(leaf).rstrip("1"))
                    for m in range(low, low - closes, -1):
                        first, base = marks[m]
                        inside = sub_sum - base
                        turned = ((inside * first).sum(axis=1) <= 0) | ((inside * p).sum(axis=1) <= 0)
                        fine &= ~turned
            # momenta point forwards in time on both ways; a path that turned within is not joined
            good = np.flatnonzero(fine)
            who = live[good]
            pick = np.log(rng.random(len(good))) < sub_w[good] - weight[who]
            drawn[who[pick]], drawn_v[who[pick]], drawn_g[who[pick]] = sub_x[good[pick]], sub_v[good[pick]], sub_g[good[pick]]
            weight[who] = np.logaddexp(weight[who], sub_w[good])
            total[who] += sub_sum[good]
            for s in (1, -1):
                mine = way[good] == s
                for i, new in enumerate((x, p, g)):
                    ends[s][i][who[mine]] = new[good[mine]]
            reached[who] = level + 1
            going[live[~fine]] = False
            whole = total[who]
            going[who] = ((whole * ends[1][1][who]).sum(axis=1) > 0) & ((whole * ends[-1][1][who]).sum(axis=1) > 0)
        z, value, slope = drawn, drawn_v, drawn_g
        if n < warm:
            step.learn(float((accepted / np.maximum(counted, 1)).mean()))
        if n == warm - 1:
            step.settle()
        if n >= warm:
            kept.append(z)
            depths.append(reached.mean())
    return np.array(kept), {"depth": float(np.mean(depths)), "diverged": lost / max(1, steps * chains), "size": step.size}


def nuts(target: Target, chains: int = 8, steps: int = 60, warm: int = 40, depth: int = 7, seed: int = 0) -> DataFrame:
    """`nuts_chains` from around the mode, with its curvature as mass."""
    centre, curve = mode(target)
    root = np.linalg.cholesky(np.linalg.inv(curve))

    def density(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, value, slope = _posterior(target, centre + z @ root.T)
        return value, slope @ root

    z = np.random.default_rng(seed).standard_normal((chains, len(centre)))
    made, _ = nuts_chains(density, z, steps, warm, depth, seed=seed)
    made = centre + made.reshape(-1, len(centre)) @ root.T
    return draws(target.panel, target.model, made, np.full(len(made), 1 / len(made)))


def svi(target: Target, guide: str = "mvn", steps: int = 150, batch: int = 8, parts: int = 1, rate: float = 0.05, n: int = 200, seed: int = 0) -> DataFrame:
    """Draws from a normal guide that is fitted by Adam to make the bound on the evidence greatest. Each step takes `batch`
    points of the guide and, with parts > 1, the series whose key hashes into one of that many parts, for all of them. guide:
    mvn (any covariance), normal (none) or delta (the mode alone). The mean of the last quarter of the steps is used."""
    if guide not in ("mvn", "normal", "delta"):
        raise ValueError(f"unknown guide: {guide}")
    model, rng = target.model, np.random.default_rng(seed)
    dim = len(model.names)
    mean, low = model.mean.copy(), np.zeros((dim, dim))
    spread = np.log(0.1 * model.sd)
    moment = [np.zeros(dim * (2 + dim)), np.zeros(dim * (2 + dim))]
    flat = np.concatenate([mean, spread, low.ravel()])
    late = []
    which = F.pmod(F.xxhash64(F.col(target.on[0]), F.lit(seed)), F.lit(parts))
    owns = [target.part(which == k) for k in range(parts)] if parts > 1 else []
    for k in range(1, steps + 1):
        mean, spread, low = flat[:dim], flat[dim : 2 * dim], np.tril(flat[2 * dim :].reshape(dim, dim), -1)
        root = np.diag(np.exp(spread)) + (low if guide == "mvn" else 0)
        e = np.zeros((1, dim)) if guide == "delta" else rng.standard_normal((batch, dim))
        e = e if guide == "delta" else np.concatenate([e, -e])
        theta = mean + e @ root.T
        own = owns[int(rng.integers(parts))] if parts > 1 else target
        ll, slope = own.value_and_slope(theta)
        g = parts * slope + model.slope_of_prior(theta)
        g = np.clip(g, -1e4, 1e4)
        down = np.concatenate([-g.mean(axis=0), -((g * e).mean(axis=0) * np.exp(spread) + 1), -np.tril(g.T @ e / len(e), -1).ravel()])
        if guide == "delta":
            down[dim:] = 0
        moment = [0.9 * moment[0] + 0.1 * down, 0.99 * moment[1] + 0.01 * down**2]
        now = rate * min(1.0, 3 * (1 - (k - 1) / steps))
        flat = flat - now * (moment[0] / (1 - 0.9**k)) / (np.sqrt(moment[1] / (1 - 0.99**k)) + 1e-8)
        if k > 3 * steps // 4:
            late.append(flat)
    flat = np.mean(late, axis=0)
    mean, spread, low = flat[:dim], flat[dim : 2 * dim], np.tril(flat[2 * dim :].reshape(dim, dim), -1)
    root = np.diag(np.exp(spread)) + (low if guide == "mvn" else 0)
    made = np.repeat(mean[None], n, axis=0) if guide == "delta" else mean + rng.standard_normal((n, dim)) @ root.T
    return draws(target.panel, model, made, np.full(n, 1 / n))


def _metric(target: Target, theta: np.ndarray, kind: str, eps: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-density, where the next proposal is centred over half its squared size, root of its covariance) of each particle.
    hessian: the inverse of minus the second derivatives, from slopes around each particle; mala: the prior's spread and the
    slope; rw: the prior's spread alone."""
    b, dim = theta.shape
    if kind != "hessian":
        _, value, slope = _posterior(target, theta)
        low = np.broadcast_to(np.diag(target.model.sd), (b, dim, dim))
        return value, slope * target.model.sd**2 if kind == "mala" else np.zeros_like(theta), low
    around = np.concatenate([np.zeros((1, dim)), np.eye(dim), -np.eye(dim)]) * eps
    _, value, slope = (x.reshape(b, 2 * dim + 1, *x.shape[1:]) for x in _posterior(target, (theta[:, None] + around).reshape(-1, dim)))
    hess = (slope[:, dim + 1 :] - slope[:, 1 : dim + 1]) / (2 * eps)
    values, vectors = np.linalg.eigh((hess + np.swapaxes(hess, 1, 2)) / 2)
    values = np.maximum(np.abs(values), 1 / (FAR * target.model.sd.max()) ** 2)
    cov = (vectors / values[:, None]) @ np.swapaxes(vectors, 1, 2)
    return value[:, 0], (cov @ slope[:, 0, :, None])[..., 0], np.linalg.cholesky(cov + 1e-12 * np.eye(dim))


def hess_steps(target: Target, kind: str = "hessian", particles: int = 64, steps: int = 10, size: float = 0.9, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """[(particles, normed weights, effective number)] of a sampler of fixed length that starts at the prior and proposes by
    slopes and second derivatives; nothing is rejected. The backward kernel is the proposal from the new place, so weights
    change by the ratio of both; particles are drawn anew when fewer than half count. In many dimensions all weight comes
    to lie on few of them, which the effective numbers show."""
    if kind not in ("hessian", "mala", "rw"):
        raise ValueError(f"unknown proposal: {kind}")
    model, rng = target.model, np.random.default_rng(seed)
    theta = model.mean + model.sd * rng.standard_normal((particles, len(model.names)))
    start = (-0.5 * ((theta - model.mean) / model.sd) ** 2 - np.log(model.sd) - 0.5 * np.log(2 * np.pi)).sum(axis=1)
    value, centre, low = _metric(target, theta, kind)
    logw, out = value - start, []

    def density(to, at, centre, low):
        z = np.linalg.solve(low, (to - at - size**2 / 2 * centre)[..., None])[..., 0] / size
        return -0.5 * (z**2).sum(axis=1) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1)

    for n in range(steps + 1):
        w = np.exp(logw - logw.max())
        w /= w.sum()
        ess = float(1 / (w**2).sum())
        out.append((theta, w, ess))
        if n == steps:
            return out
        if ess < particles / 2:
            take = np.minimum(np.searchsorted(np.cumsum(w), (rng.random() + np.arange(particles)) / particles), particles - 1)
            theta, value, centre, low, logw = theta[take], value[take], centre[take], low[take], np.zeros(particles)
        made = theta + size**2 / 2 * centre + size * (low @ rng.standard_normal(theta.shape)[..., None])[..., 0]
        value1, centre1, low1 = _metric(target, made, kind)
        logw = logw + value1 - value + density(theta, made, centre1, low1) - density(made, theta, centre, low)
        logw = np.nan_to_num(logw, nan=-np.inf)
        theta, value, centre, low = made, value1, centre1, low1


def hess_mc2(target: Target, kind: str = "hessian", particles: int = 64, steps: int = 10, size: float = 0.9, seed: int = 0) -> DataFrame:
    """Draws of all steps of `hess_steps` but the first half, each step weighed by its effective number."""
    found = hess_steps(target, kind, particles, steps, size, seed)[steps // 2 :]
    whole = sum(ess for _, _, ess in found)
    return draws(target.panel, target.model, np.concatenate([t for t, _, _ in found]), np.concatenate([w * ess / whole for _, w, ess in found]))


def profile(target: Target, params: list[str] | None = None, points: int = 20, reach: float = 3.0, rounds: int = 4) -> DataFrame:
    """(param, at, value, log_post): the posterior along each parameter (at: unconstrained, value: on its natural scale),
    the others set to their best for each point. The grid spans `reach` prior deviations around the mode; all points of all
    parameters move together, by Newton steps with the mode's curvature, and each step is one batch of differences."""
    model = target.model
    chosen = [model.names.index(x) for x in params or model.names]
    centre, curve = mode(target)
    dim = len(centre)
    post = lambda t: target(t) + model.log_prior(t)
    grid = [centre[j] + reach * model.sd[j] * np.linspace(-1, 1, points) for j in chosen]
    theta = np.repeat(centre[None], len(chosen) * points, axis=0)
    owner, free = np.repeat(chosen, points), []
    for k, j in enumerate(chosen):
        rest = np.delete(np.arange(dim), j)
        free.append((rest, np.linalg.inv(curve[np.ix_(rest, rest)])))
        theta[k * points : (k + 1) * points, j] = grid[k]
        # where the normal approximation has the others, given this one
        theta[k * points : (k + 1) * points, rest] -= np.outer(grid[k] - centre[j], free[k][1] @ curve[rest, j])
    value = post(theta)
    for _ in range(rounds):
        grad = _posterior(target, theta)[2]
        step = np.zeros_like(theta)
        for k in range(len(chosen)):
            rows, (rest, inverse) = slice(k * points, (k + 1) * points), free[k]
            step[rows, rest] = np.clip(grad[rows][:, rest] @ inverse.T, -1, 1)
        sizes = 0.5 ** np.arange(4)
        tried = theta[:, None] + sizes[:, None] * step[:, None]
        found = post(tried.reshape(-1, dim)).reshape(len(theta), len(sizes))
        best = found.argmax(axis=1)
        better = found.max(axis=1) > value
        theta = np.where(better[:, None], tried[np.arange(len(theta)), best], theta)
        value = np.maximum(value, found.max(axis=1))
        if not better.any():
            break
    natural = model.natural(theta)
    rows = [(model.names[j], float(theta[i, j]), float(natural[i, j]), float(value[i])) for i, j in enumerate(owner)]
    return target.panel.sparkSession.createDataFrame(rows, "param string, at double, value double, log_post double")


def identified(profiles: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(param, range, verdict): a profile below FLAT in range is structurally unidentifiable; one that falls far enough from
    its peak on both sides is identified, else it is practically unidentifiable."""
    drop = DROPS[confidence]
    peak = profiles.groupBy("param").agg(F.max("log_post").alias("top"), F.min("log_post").alias("low"), F.max_by("at", "log_post").alias("peak"))
    fallen = F.col("log_post") < F.col("top") - drop
    sides = profiles.join(peak, "param").groupBy("param", (F.col("top") - F.col("low")).alias("range")).agg(
        F.max(fallen & (F.col("at") < F.col("peak"))).alias("left"), F.max(fallen & (F.col("at") > F.col("peak"))).alias("right")
    )
    verdict = F.when(F.col("range") < FLAT, "structurally_unidentifiable").when(F.col("left") & F.col("right"), "identified").otherwise("practically_unidentifiable")
    return sides.select("param", "range", verdict.alias("verdict"))


METHODS = {"tempered_smc": tempered_smc, "laplace": laplace, "hmc": hmc, "nuts": nuts, "svi": svi, "hess_mc2": hess_mc2}


def fit(target: Target, method: str = "tempered_smc", **how) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}; there are {', '.join(METHODS)}")
    return METHODS[method](target, **how)
