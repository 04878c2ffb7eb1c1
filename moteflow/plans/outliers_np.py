"""Rows that stand out from the rows around them, for all rows of a batch at once (NaN is absent)."""

from __future__ import annotations

import numpy as np

from moteflow.settings import Settings


def row_median(a: np.ndarray) -> np.ndarray:
    """Median of what each row of a matrix holds; NaN where it holds nothing."""
    if not a.shape[1]:
        return np.full(len(a), np.nan)
    s, n = np.sort(a, 1), (~np.isnan(a)).sum(1)
    pick = lambda i: np.take_along_axis(s, np.maximum(i, 0)[:, None], 1)[:, 0]
    return (pick((n - 1) // 2) + pick(n // 2)) / 2


def fold(d: np.ndarray) -> np.ndarray:
    """Axial differences in [-90, 90)."""
    return np.mod(d + 90, 180) - 90


def crosses_origin(t: np.ndarray, v: np.ndarray, reach: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Per row of (n, m) matrices: do its points, taken relative to a point of interest, lie on a straight line that passes
    the origin within ``reach``? The median of the pairwise slopes is refined by three least-squares fits on the points
    near the line; two thirds of the points (4 at least) must stay near it, and scatter no more than the noise allows."""
    n, m = v.shape
    reach, noise = (np.broadcast_to(np.asarray(x, float), (n,)) for x in (reach, noise))
    held = ~np.isnan(v)
    scatter = np.maximum(np.where(np.isfinite(noise), 3 * noise, 0.0), reach / 3)
    wide = np.maximum(reach, 3 * scatter)[:, None]
    least = np.maximum(4, np.ceil(2 * held.sum(1) / 3))
    a, b = np.triu_indices(m, 1)
    run = np.where(t[:, a] == t[:, b], np.nan, t[:, a] - t[:, b])
    slope = row_median((v[:, a] - v[:, b]) / run)
    level = row_median(v - slope[:, None] * t)
    t0, v0 = np.where(held, t, 0.0), np.where(held, v, 0.0)
    good = ~np.isnan(slope)
    slope, level = np.nan_to_num(slope), np.nan_to_num(level)
    off = lambda: v0 - level[:, None] - slope[:, None] * t0
    for _ in range(3):
        w = (held & (np.abs(off()) <= wide)).astype(float)
        k = np.maximum(w.sum(1), 1)
        tm, vm = (w * t0).sum(1) / k, (w * v0).sum(1) / k
        dt = w * (t0 - tm[:, None])
        power = (dt * dt).sum(1)
        good &= (w.sum(1) >= least) & (power > 0)
        slope = (dt * (v0 - vm[:, None])).sum(1) / np.where(power > 0, power, 1.0)
        level = vm - slope * tm
    rms = np.sqrt((w * off() ** 2).sum(1) / np.maximum(w.sum(1) - 2, 1))
    return good & (rms <= scatter) & (np.abs(level) <= reach)


def around(frame: np.ndarray, reach: float) -> np.ndarray:
    """(n, m) positions of the other rows within ``reach`` frames, -1 beyond them; frames are sorted."""
    lo, hi = np.searchsorted(frame, frame - reach), np.searchsorted(frame, frame + reach, "right")
    at = lo[:, None] + np.arange((hi - lo).max())
    return np.where((at < hi[:, None]) & (at != np.arange(len(frame))[:, None]), at, -1)


def excess(frame: np.ndarray, x: np.ndarray, y: np.ndarray, angle: np.ndarray, z: np.ndarray, cfg: Settings) -> np.ndarray:
    """How many times its cut each row of a track lies from the rows around it, in place, turn or depth, whichever is most;
    0 within the cuts and on steady motion."""
    at = around(frame, cfg.jump_window)
    of = lambda c, i=at: np.where(i >= 0, c[i], np.nan)
    crowd = (at >= 0).sum(1) >= 2
    dx, dy = of(x) - x[:, None], of(y) - y[:, None]
    mx, my = row_median(dx), row_median(dy)
    place, place_cut = np.hypot(mx, my), cfg.jump_px + 2 * row_median(np.hypot(dx - mx[:, None], dy - my[:, None]))
    turn = np.abs(row_median(fold(of(angle) - angle[:, None])))
    step = np.diff(z)
    step = step[~np.isnan(step)]
    noise = 1.4826 * np.median(np.abs(step - np.median(step))) / np.sqrt(2) if len(step) >= 6 else np.nan
    dz = of(z) - z[:, None]
    mz = row_median(dz)
    local = noise * cfg.jump_z_sigma if np.isfinite(noise) else 3 * 1.4826 * row_median(np.abs(dz - mz[:, None]))
    known = (~np.isnan(dz)).sum(1) >= 2
    depth, depth_cut = np.where(known, np.abs(mz), 0.0), np.where(known, np.maximum(cfg.jump_z_um, local), cfg.jump_z_um)

    cuts = np.stack([place_cut, np.full(len(x), cfg.jump_angle_deg), depth_cut], 1)
    over = np.nan_to_num(np.stack([place, turn, depth], 1) / cuts)
    over[(over <= 1) | ~crowd[:, None]] = 0.0
    r = np.flatnonzero(over.any(1))
    if not len(r):
        return over.max(1)
    far = around(frame, 3 * cfg.jump_window)[r]
    t = of(frame, far) - frame[r, None]
    six = np.argsort(np.where(np.isnan(t), np.inf, np.abs(t)), 1, kind="stable")[:, :6]
    t, far = (np.take_along_axis(q, six, 1) for q in (t, far))
    rel = lambda c: of(c, far) - c[r, None]
    steady = np.stack([crosses_origin(t, rel(x), cfg.jump_px, 0.1) & crosses_origin(t, rel(y), cfg.jump_px, 0.1),
                       crosses_origin(t, fold(rel(angle)), cfg.jump_angle_deg, 1.0), crosses_origin(t, rel(z), depth_cut[r], noise)], 1)
    over[r] = np.where(steady, 0.0, over[r])
    return over.max(1)


def worst_first(frame: np.ndarray, x: np.ndarray, y: np.ndarray, angle: np.ndarray, z: np.ndarray, cfg: Settings) -> np.ndarray:
    """Positions of a track's rows that go: the one with the largest excess, then again among the rest."""
    left, gone = np.arange(len(frame)), []
    while len(left) >= 4:
        e = excess(*(c[left] for c in (frame, x, y, angle, z)), cfg)
        k = int(e.argmax())
        if not e[k] > 1:
            break
        gone.append(left[k])
        left = np.delete(left, k)
    return np.array(gone, int)
