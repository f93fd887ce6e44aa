"""Recursions over one ordered series, in NumPy. Batch runs them per key, streaming step by step."""

from __future__ import annotations

import math

import numpy as np


def ewm(x: np.ndarray, alpha: float, warm: int) -> np.ndarray:
    """Exponentially weighted mean that starts at the first value; NaN before `warm` values."""
    out, y = np.full(len(x), np.nan), math.nan
    for i, v in enumerate(x):
        y = v if math.isnan(y) else (1 - alpha) * y + alpha * v
        if i + 1 >= warm:
            out[i] = y
    return out


def rsi(price: np.ndarray, rows: int = 14) -> np.ndarray:
    """Wilder's index; NaN in the warm-up and where there was no loss."""
    out = np.full(len(price), np.nan)
    if len(price) > 1:
        step = np.diff(price)
        up, down = (ewm(np.maximum(s, 0), 1 / rows, rows) for s in (step, -step))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[1:] = np.where(down > 0, 100 - 100 / (1 + up / down), np.nan)
    return out


def garch_path(r: np.ndarray, mu: float, omega: float, alpha: float, beta: float, var: float, shock: float) -> np.ndarray:
    """Annualised volatility before each return is seen; parameters are on returns times 100."""
    out = np.empty(len(r))
    for i, x in enumerate(r):
        var = omega + alpha * shock**2 + beta * var
        out[i] = math.sqrt(var * 252) / 100
        shock = 100 * x - mu
    return out


def log_gauss(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log densities, T x K."""
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, k] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)  # a sum of nothing but impossible terms is impossible
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def hmm_filter(dens: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state | observations so far), row by row."""
    with np.errstate(divide="ignore"):
        move, now = np.log(trans), np.log(start)
    out = np.empty_like(dens)
    for t, d in enumerate(dens):
        now = d + (now if t == 0 else _logsum(now[:, None] + move, 0))
        now = now - _logsum(now, 0)
        out[t] = np.exp(now)
    return out


def hmm_smooth(dens: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state | all observations)."""
    with np.errstate(divide="ignore"):
        move, forward = np.log(trans), np.log(hmm_filter(dens, start, trans))
    back, out = np.zeros(dens.shape[1]), np.empty_like(dens)
    for t in range(len(dens) - 1, -1, -1):
        both = forward[t] + back
        out[t] = np.exp(both - _logsum(both, 0))
        back = _logsum(move + dens[t] + back, 1)
        back -= back.max()
    return out


def viterbi_ends(dens: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The state that the likeliest path over the rows so far ends in, for each row: later rows have no say."""
    with np.errstate(divide="ignore"):
        move, best = np.log(trans), np.log(start)
    out = np.empty(len(dens), dtype=int)
    for t, d in enumerate(dens):
        best = d + (best if t == 0 else (best[:, None] + move).max(axis=0))
        out[t] = int(np.argmax(best))
    return out


def viterbi(dens: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        move, best = np.log(trans), np.log(start)
    came = np.zeros(dens.shape, dtype=int)
    for t, d in enumerate(dens):
        if t:
            ways = best[:, None] + move
            came[t] = ways.argmax(axis=0)
            best = ways.max(axis=0)
        best = best + d
    path = [int(np.argmax(best))] if len(dens) else []
    for t in range(len(dens) - 1, 0, -1):
        path.append(int(came[t, path[-1]]))
    return np.array(path[::-1], dtype=int)


def _chain(first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors first, first @ moves[0], first @ moves[0] @ moves[1], ... of several series at once (S x T + 1 x K), each scaled to sum 1,
    and the log of the last one's sum. Blocks of the square root of the length are multiplied side by side."""
    size, rows, k = moves.shape[:3]
    step = max(1, math.isqrt(rows))
    blocks = -(-rows // step) if rows else 0
    m = np.concatenate([moves, np.broadcast_to(np.eye(k), (size, blocks * step - rows, k, k))], axis=1).reshape(size, blocks, step, k, k)
    within, logs = np.empty_like(m), np.zeros((size, blocks))
    for j in range(step):
        now = m[:, :, j] if j == 0 else now @ m[:, :, j]
        top = now.max(axis=(2, 3), keepdims=True)
        now = now / top
        logs += np.log(top[:, :, 0, 0])
        within[:, :, j] = now
    total = first.sum(axis=1)
    entry, scale = first / total[:, None], np.log(total)
    out = np.empty((size, blocks * step + 1, k))
    out[:, 0] = entry
    for i in range(blocks):
        got = (entry[:, None, None, :] @ within[:, i])[:, :, 0]
        sums = got.sum(axis=2, keepdims=True)
        out[:, 1 + i * step : 1 + (i + 1) * step] = got / sums
        entry = got[:, -1] / sums[:, -1]
        scale = scale + logs[:, i] + np.log(sums[:, -1, 0])
    return out[:, : rows + 1], scale


def hmm_loglik(dens: np.ndarray, start: np.ndarray, trans: np.ndarray) -> float:
    """Log-likelihood of a series under its log densities."""
    top = dens.max(axis=1, keepdims=True)
    b = np.exp(dens - top)[None]
    return float(_chain(start * b[:, 0], trans * b[:, 1:, None, :])[1][0] + top.sum())


def spread_means(z: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """Means by k-means from k-means++ seeds (Arthur and Vassilvitskii, 2007): each next one drawn by its squared distance."""
    rng = np.random.default_rng(seed)
    means = z[rng.integers(len(z))][None]
    while len(means) < k:
        far = ((z[:, None] - means) ** 2).sum(axis=2).min(axis=1)
        means = np.vstack([means, z[rng.choice(len(z), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(z))]])
    for _ in range(rounds):
        own = ((z[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)
        after = np.stack([z[own == c].mean(axis=0) if (own == c).any() else means[c] for c in range(k)])
        if np.array_equal(after, means):
            break
        means = after
    return means


def hmm_fits(x: np.ndarray, k: int, seeds: list[int], rounds: int = 1000, tolerance: float = 1e-2, spread_out: bool = False) -> list[dict]:
    """Gaussian hidden Markov models by EM on standardised columns, one a start, all starts at once; starts that fail are
    left out. Means start from rows drawn at random, or (spread_out) from k-means. States are ordered by the mean of the second raw column
    under Viterbi labels."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    z, d = (x - centre) / spread, x.shape[1]
    floor = 1e-3 * np.eye(d)
    means = np.stack([spread_means(z, k, s) if spread_out else z[np.random.default_rng(s).choice(len(z), k, replace=False)] for s in seeds])
    covs = np.broadcast_to(np.cov(z.T) + floor, (len(seeds), k, d, d)).copy()
    start, trans = np.full((len(seeds), k), 1 / k), np.broadcast_to(np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), (len(seeds), k, k)).copy()
    last, live = np.full(len(seeds), -np.inf), np.arange(len(seeds))
    done = np.zeros(len(seeds), dtype=bool)
    for _ in range(rounds):
        gap = z - means[live][:, :, None]
        far = ((gap @ np.linalg.inv(covs[live])) * gap).sum(axis=3).transpose(0, 2, 1)
        dens = -0.5 * (far + np.linalg.slogdet(covs[live])[1][:, None] + d * math.log(2 * math.pi))
        top = dens.max(axis=2, keepdims=True)
        b = np.exp(dens - top)
        moves = trans[live][:, None] * b[:, 1:, None, :]
        f, scale = _chain(start[live] * b[:, 0], moves)
        back, _ = _chain(np.ones(b.shape[::2]), moves[:, ::-1].swapaxes(2, 3))
        back = back[:, ::-1]
        loglik = scale + top.sum(axis=(1, 2))
        failed = ~np.isfinite(loglik)
        settled = loglik - last[live] < tolerance
        last[live] = np.where(failed, -np.inf, loglik)
        done[live[settled & ~failed]] = True
        go = ~settled & ~failed
        if not go.any():
            break
        g = (f * back)[go]
        g /= g.sum(axis=2, keepdims=True)
        both = f[go][:, :-1, :, None] * moves[go] * back[go][:, 1:, None, :]
        pair = (both / both.sum(axis=(2, 3), keepdims=True)).sum(axis=1)
        live = live[go]
        start[live], trans[live] = g[:, 0] / g[:, 0].sum(axis=1, keepdims=True), pair / pair.sum(axis=2, keepdims=True)
        weight = g.sum(axis=1)
        means[live] = (g.transpose(0, 2, 1) @ z) / weight[:, :, None]
        gap = z - means[live][:, :, None]
        covs[live] = (gap * g.transpose(0, 2, 1)[..., None]).transpose(0, 1, 3, 2) @ gap / weight[:, :, None, None] + floor
    out = []
    for i, seed in enumerate(seeds):
        if not np.isfinite(last[i]):
            continue
        path = viterbi(log_gauss(z, means[i], covs[i]), start[i], trans[i])
        second = [x[path == s, 1].mean() if (path == s).any() else np.inf for s in range(k)]
        o = np.argsort(second, kind="stable")
        out.append({"seed": seed, "loglik": float(last[i]), "start": start[i][o], "trans": trans[i][np.ix_(o, o)], "means": means[i][o], "covs": covs[i][o], "centre": centre, "spread": spread})
    return out


def hmm_fit(x: np.ndarray, k: int, seeds: range | list = range(10), rounds: int = 1000) -> dict:
    """The best of several starts."""
    found = hmm_fits(x, k, list(seeds), rounds)
    if not found:
        raise ValueError("no start of the fit succeeded")
    return max(found, key=lambda m: m["loglik"])


def _garch_loss(free: np.ndarray, x: np.ndarray, first: float) -> float:
    """Negative log-likelihood under standardised t errors; free: mean, log variance scale, and three squashed numbers."""
    mu, log_scale, a, b, c = free
    both, nu = 0.9999 / (1 + math.exp(-a)), 2.05 + math.exp(min(c, 6.0))
    alpha = both / (1 + math.exp(-b))
    beta, omega = both - alpha, math.exp(min(log_scale, 50.0)) * (1 - both)
    shocks = ((x - mu) ** 2).tolist()
    out, var = np.empty(len(x)), first
    out[0] = var
    for i in range(1, len(x)):
        var = omega + alpha * shocks[i - 1] + beta * var
        out[i] = var
    if not np.isfinite(out).all() or out.min() <= 0:
        return 1e12
    each = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2)) - 0.5 * np.log(out) - (nu + 1) / 2 * np.log1p(np.array(shocks) / (out * (nu - 2)))
    return -float(each.sum())


def nelder_mead(f, x0: np.ndarray, step: float = 0.5, rounds: int = 1500, tolerance: float = 1e-7) -> np.ndarray:
    """Minimum of f by the downhill simplex."""
    simplex = np.vstack([x0, x0 + step * np.eye(len(x0))])
    value = np.array([f(v) for v in simplex])
    for _ in range(rounds):
        order = np.argsort(value, kind="stable")
        simplex, value = simplex[order], value[order]
        if value[-1] - value[0] < tolerance:
            break
        middle = simplex[:-1].mean(axis=0)
        far = middle + (middle - simplex[-1])
        got = f(far)
        if got < value[0]:
            beyond = middle + 2 * (middle - simplex[-1])
            more = f(beyond)
            simplex[-1], value[-1] = (beyond, more) if more < got else (far, got)
        elif got < value[-2]:
            simplex[-1], value[-1] = far, got
        else:
            near = middle + 0.5 * ((far if got < value[-1] else simplex[-1]) - middle)
            less = f(near)
            if less < min(got, value[-1]):
                simplex[-1], value[-1] = near, less
            else:
                simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
                value[1:] = [f(v) for v in simplex[1:]]
    return simplex[np.argmin(value)]


def garch_fit(r: np.ndarray) -> dict:
    """Constant mean, variance of order (1, 1), t errors, by maximum likelihood on returns times 100; alpha + beta stays under 1.

    var and shock are the last variance and the last error, from which a path goes on."""
    x = 100 * np.asarray(r, dtype=float)
    first = float(x.var()) or 1e-12
    best = nelder_mead(lambda v: _garch_loss(v, x, first), np.array([x.mean(), math.log(first), 2.5, -2.0, 1.5]))
    mu, log_scale, a, b, c = best
    both = 0.9999 / (1 + math.exp(-a))
    alpha = both / (1 + math.exp(-b))
    out = {"mu": float(mu), "omega": math.exp(log_scale) * (1 - both), "alpha": alpha, "beta": both - alpha, "nu": 2.05 + math.exp(min(c, 6.0)), "loglik": -_garch_loss(best, x, first)}
    var = first
    for shock in ((x - mu) ** 2)[:-1]:
        var = out["omega"] + alpha * shock + out["beta"] * var
    return out | {"var": float(var), "shock": float(x[-1] - mu)}


def bocpd(x: np.ndarray, hazard: float, window: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Most probable run length and P(run length <= window) after each value: constant hazard, Normal-Gamma(0, 1, 1, 1)."""
    x = np.asarray(x, dtype=float)
    if x.ndim != 1:
        raise ValueError("one series is needed")
    n = len(x)
    df = 2.0 + np.arange(n + 1)
    gap = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in df])
    log_r, mean, beta = np.zeros(1), np.zeros(1), np.ones(1)
    best, near = np.empty(n, dtype=np.int64), np.empty(n)
    for t, v in enumerate(x):
        k = np.arange(t + 1)
        kappa, alpha = 1.0 + k, 1.0 + k / 2
        scale = beta * (kappa + 1) / (alpha * kappa)
        d = df[: t + 1]
        pred = gap[: t + 1] - 0.5 * np.log(d * math.pi * scale) - (d + 1) / 2 * np.log1p((v - mean) ** 2 / (d * scale))
        joint = log_r + pred
        grown = np.append(_logsum(joint, 0) + math.log(hazard), joint + math.log1p(-hazard))
        log_r = grown - _logsum(grown, 0)
        beta = np.append(1.0, beta + kappa * (v - mean) ** 2 / (2 * (kappa + 1)))
        mean = np.append(0.0, (kappa * mean + v) / (kappa + 1))
        best[t], near[t] = int(np.argmax(log_r)), float(np.exp(log_r[: window + 1]).sum())
    return best, near


class RunLengths:
    """bocpd() row by row, without the runs that have become impossible.

    Before a row, runs longer than the window whose share of the posterior is under `drop` leave; `lost` adds up the shares. A
    fresh run opens at every row with the hazard's share, so the rows after that point are never predicted worse, by what
    is kept, than the hazard times a fresh run's prediction of all of them: a run that left can win back at most the ratio of its
    own prediction of those rows to that. For runs that know mean and spread, this ratio grows as a power of the number
    of rows, not exponentially, so what is lost stays about `drop` times that power. With drop = 0 nothing leaves: the exact way.
    Runs inside one regime never become impossible; the work is rows times the length of a regime."""

    def __init__(self, hazard: float, window: int = 5, drop: float = 0.0):
        self.hazard, self.window, self.drop, self.lost, self.rows = hazard, window, drop, 0.0, 0
        self.length, self.log_r, self.mean, self.beta = np.zeros(1, dtype=np.int64), np.zeros(1), np.zeros(1), np.ones(1)
        self._gap = np.zeros(0)

    def _gaps(self, most: int) -> np.ndarray:
        if len(self._gap) <= most:
            size = max(256, 2 * (most + 1))
            self._gap = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in 2.0 + np.arange(size)])
        return self._gap

    def step(self, v: float) -> tuple[int, float]:
        """Most probable run length and P(run length <= window) after the next value."""
        if self.drop and self.rows % 16 == 0 and len(self.length) > self.window + 1:
            share = np.exp(self.log_r)
            gone = (self.length > self.window) & (share < self.drop)
            if gone.any():
                self.lost += float(share[gone].sum())
                self.length, self.log_r, self.mean, self.beta = (a[~gone] for a in (self.length, self.log_r, self.mean, self.beta))
        k = self.length
        kappa, alpha, df = 1.0 + k, 1.0 + k / 2, 2.0 + k
        scale = self.beta * (kappa + 1) / (alpha * kappa)
        pred = self._gaps(int(k[-1]))[k] - 0.5 * np.log(df * math.pi * scale) - (df + 1) / 2 * np.log1p((v - self.mean) ** 2 / (df * scale))
        joint = self.log_r + pred
        grown = np.append(_logsum(joint, 0) + math.log(self.hazard), joint + math.log1p(-self.hazard))
        self.log_r = grown - _logsum(grown, 0)
        self.beta = np.append(1.0, self.beta + kappa * (v - self.mean) ** 2 / (2 * (kappa + 1)))
        self.mean = np.append(0.0, (kappa * self.mean + v) / (kappa + 1))
        self.length = np.append(0, k + 1)
        self.rows += 1
        return int(self.length[np.argmax(self.log_r)]), float(np.exp(self.log_r[self.length <= self.window]).sum())


def bocpd_pruned(x: np.ndarray, hazard: float, window: int = 5, drop: float = 1e-20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What bocpd() gives, with the share lost so far and the number of runs held after each value."""
    runs, n = RunLengths(hazard, window, drop), len(x)
    best, near, lost, held = np.empty(n, dtype=np.int64), np.empty(n), np.empty(n), np.empty(n, dtype=np.int64)
    for t, v in enumerate(np.asarray(x, dtype=float)):
        best[t], near[t] = runs.step(float(v))
        lost[t], held[t] = runs.lost, len(runs.length)
    return best, near, lost, held


def generator(seed: int, number: int) -> np.random.Generator:
    """The generator of one replicate: that of the seed, jumped ahead `number` times. No two share a number, whoever draws them."""
    return np.random.Generator(np.random.PCG64(seed).jumped(number))


def stationary_bootstrap(n: int, rng: np.random.Generator, block: float) -> np.ndarray:
    """Indices of one resample: blocks of geometric length (block on average) around the circle.

    A block runs on from its first index; the draws are one index, n - 1 uniforms and n - 1 indices, in this order."""
    firsts = np.array([rng.integers(0, n)])
    opens = np.concatenate([[True], rng.random(n - 1) < 1 / block])
    firsts = np.concatenate([firsts, rng.integers(0, n, n - 1)])
    at = np.arange(n)
    opened = np.maximum.accumulate(np.where(opens, at, 0))
    return (firsts[opened] + at - opened) % n


def mean_block(n: int) -> int:
    return max(2, round(math.sqrt(n)))
