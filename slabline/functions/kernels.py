"""NumPy helpers for work that is sequential along a track or two-dimensional. No Spark here."""

from __future__ import annotations

import math

import numpy as np


def shrink(image: np.ndarray, n: int = 1) -> np.ndarray:
    """Keeps pixels whose up, down, left and right neighbours inside the image are set, n times."""
    for _ in range(n):
        padded = np.pad(image, 1, constant_values=True)
        image = image & padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    return image


def grow(image: np.ndarray, n: int = 1) -> np.ndarray:
    """Sets pixels with a set neighbour up, down, left or right, n times."""
    for _ in range(n):
        padded = np.pad(image, 1, constant_values=False)
        image = image | padded[:-2, 1:-1] | padded[2:, 1:-1] | padded[1:-1, :-2] | padded[1:-1, 2:]
    return image


#: Steps (shrink or grow, times) of each cleaning variant.
VARIANTS = {
    "orig": (),
    "S1": ((shrink, 1),),
    "S2": ((shrink, 2),),
    "SG1": ((shrink, 1), (grow, 2), (shrink, 1)),
    "SG2": ((shrink, 2), (grow, 4), (shrink, 2)),
}


def cleaned(image: np.ndarray, variant: str = "SG1") -> np.ndarray:
    for step, n in VARIANTS[variant]:
        image = step(image, n)
    return image


def label4(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels 4-connected components from 1 and gives the size of each label, 0 being background.

    Runs of set pixels in each row are the units; runs that touch in neighbouring rows are joined. All rows
    are done at once: each label falls to the least one that it touches, in a logarithmic number of rounds.
    """
    rows, columns = image.shape
    padded = np.zeros((rows, columns + 2), np.int8)
    padded[:, 1:-1] = image
    steps = np.diff(padded, axis=1)
    row, start = np.nonzero(steps == 1)
    stop = np.nonzero(steps == -1)[1]
    # the runs of the row above that a run touches are neighbours: from the first that ends behind its start
    above, wide = (row - 1) * (columns + 2), row * (columns + 2)
    first = np.searchsorted(wide + stop, above + start, side="right")
    touched = np.maximum(np.searchsorted(wide + start, above + stop, side="left") - first, 0)
    lower = np.repeat(np.arange(len(row)), touched)
    upper = np.repeat(first - np.cumsum(touched) + touched, touched) + np.arange(len(lower))
    roots = np.arange(len(row))
    while len(lower):
        x, y = roots[lower], roots[upper]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while (roots != (up := roots[roots])).any():
            roots = up
        apart = roots[lower] != roots[upper]
        lower, upper = lower[apart], upper[apart]
    names, number = np.unique(roots, return_inverse=True)
    sizes = np.bincount(number, weights=stop - start, minlength=len(names)).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    labels = np.zeros(image.shape, np.int64)
    labels[padded[:, 1:-1] != 0] = np.repeat(number + 1, stop - start)
    return labels, np.concatenate([[rows * columns - sizes.sum()], sizes])


def keep_large(image: np.ndarray, least: int) -> np.ndarray:
    """The components of at least ``least`` pixels."""
    labels, sizes = label4(image)
    large = sizes >= least
    large[0] = False
    return large[labels]


def ice_count(values: np.ndarray, cutoffs: np.ndarray, variant: str = "SG1", least: int = 350, skip: int = 2) -> np.ndarray:
    """How many cutoffs call each cell (depth x trace) ice after cleaning and the size filter; the
    first ``skip`` depths are never ice. Missing values are not ice."""
    out = np.zeros(values.shape, np.int32)
    for cutoff in cutoffs:
        out += keep_large(below(values, cutoff, variant, skip), least)
    return out


def below(values: np.ndarray, cutoff: float, variant: str = "SG1", skip: int = 2) -> np.ndarray:
    """The cleaned image of values at or below a cutoff, without the first ``skip`` depths."""
    image = values <= cutoff
    image[:skip] = False
    return cleaned(image, variant)


def step_kernel(radius: int = 50) -> np.ndarray:
    """Weights of a dark-to-bright step: -1 above, +3 below, under a Gaussian around just above the middle."""
    steps = np.repeat([-1.0, 3.0], radius)
    sigma = radius / 3
    at = np.arange(2 * radius) - (radius - 5)
    return steps * np.exp(-(at**2) / (2 * sigma**2))


def surface_steps(traces: np.ndarray, radius: int = 50, search: int = 150) -> np.ndarray:
    """Per trace and sample, where the surface goes to if it was at that sample in the trace before
    (trace x depth): follow_surface's step from every place at once."""
    depth = len(traces)
    padded = np.pad(traces, ((radius + search, radius + search), (0, 0)), mode="edge")
    scores = np.lib.stride_tricks.sliding_window_view(padded, 2 * radius, axis=0) @ step_kernel(radius)
    near = np.lib.stride_tricks.sliding_window_view(scores, 2 * search, axis=0)[:depth]
    best = np.stack([near[:, i].argmax(axis=1) for i in range(traces.shape[1])]) if traces.shape[1] else np.zeros((0, depth), int)
    return np.clip(np.arange(depth) - search + best, 0, depth - 1).astype(np.int32)


def follow_surface(traces: np.ndarray, start: int, radius: int = 50, search: int = 150) -> np.ndarray:
    """Sample index of the surface in each trace (depth x trace), followed from ``start``: the place
    within ``search`` samples of the last one where the step kernel fits best. Places beyond an end
    count as the end."""
    depth = traces.shape[0]
    kernel, spread = step_kernel(radius), np.arange(-radius, radius)
    out, at = np.empty(traces.shape[1], np.int64), int(start)
    for i in range(traces.shape[1]):
        places = at + np.arange(-search, search)
        window = np.clip(places[None, :] + spread[:, None], 0, depth - 1)
        at = int(np.clip(places[np.argmax(kernel @ traces[:, i][window])], 0, depth - 1))
        out[i] = at
    return out


#: Fixed values of false jumps: steps of the recent slope; steps within which the line must return, or
#: jump back; least excess of a jump over the slope, in samples and as a share of the slope; share of the
#: slope at which the line counts as returned, and of the jump that must be undone.
RECENT, RETURN, UNDO = 10, 20, 50
LEAST_JUMP, STEEPER, RETURNED, UNDONE = 5, 1.5, 1.1, 0.5


def _jump_starts(line: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places from low to high (not included) after which the line leaves its recent slope upwards."""
    i = np.arange(max(low, RECENT), min(high, len(line) - 1))
    slope = (line[i] - line[i - RECENT]) / RECENT
    excess = line[i + 1] - line[i] - slope
    return i[(excess >= LEAST_JUMP) & (excess >= STEEPER * slope)]


def _jump_end(line: np.ndarray, i: int) -> int | None:
    """Where the line is back after the jump from i: on its recent slope, else behind a jump that undoes it."""
    slope = (line[i] - line[i - RECENT]) / RECENT
    off = line[i + 1 : i + 1 + RETURN] - line[i]
    back = np.flatnonzero(off / np.arange(1, len(off) + 1) <= RETURNED * slope)
    jump = off[0]
    if not len(back) and abs(jump) >= LEAST_JUMP:
        steps = np.diff(line[i : i + UNDO + 1])
        back = np.flatnonzero(steps * -np.sign(jump) > UNDONE * abs(jump))
    return i + int(back[0]) + 1 if len(back) and back[0] else None


def without_jumps(surface: np.ndarray) -> np.ndarray:
    """The surface with false jumps bridged by straight lines, from the start of each to its end.

    The starts are found once; a bridge moves only those inside it and shortly after it, so only these
    are looked for again, and long lines take linear time.
    """
    line = surface.astype(np.int64).copy()
    far, at, near = _jump_starts(line, 0, len(line)), 0, []
    while near or at < len(far):
        if near:
            i = near.pop(0)
        else:
            i, at = int(far[at]), at + 1
        if (end := _jump_end(line, i)) is None:
            continue
        line[i + 1 : end] = np.round(line[i] + (line[end] - line[i]) * np.arange(1, end - i) / (end - i))
        upto = end + RECENT
        near = [*_jump_starts(line, i + 1, upto).tolist(), *(x for x in near if x >= upto)]
        at = max(at, int(np.searchsorted(far, upto)))
    return line


def _linear(n: np.ndarray, s: np.ndarray, g: np.ndarray, a_max: float, c_max: float, c_min: float = -np.inf, a_min: float = -np.inf) -> tuple[float, float, float]:
    """a, c and loss of the weighted least squares z = a g + c within bounds, from counts n and sums s.
    The loss leaves out the constant sum of squares."""
    gg, g1, n1, zg, z1 = (n * g * g).sum(), (n * g).sum(), n.sum(), (s * g).sum(), s.sum()

    def loss(a: float, c: float) -> float:
        return a * a * gg + 2 * a * c * g1 + c * c * n1 - 2 * a * zg - 2 * c * z1

    clip_a, clip_c = (lambda v: min(max(v, a_min), a_max)), (lambda v: min(max(v, c_min), c_max))
    tries, det = [], gg * n1 - g1 * g1
    if det > 1e-12 * max(gg * n1, 1e-300):
        a, c = (zg * n1 - z1 * g1) / det, (z1 * gg - zg * g1) / det
        if clip_a(a) == a and clip_c(c) == c:
            return a, c, loss(a, c)
    for c in {b for b in (c_max, c_min) if np.isfinite(b)}:
        a = clip_a((zg - c * g1) / gg) if gg > 0 else 0.0
        tries.append((loss(a, c), a, c))
    for a in {b for b in (a_max, a_min) if np.isfinite(b)} | ({0.0} if det <= 1e-12 * max(gg * n1, 1e-300) else set()):
        c = clip_c((z1 - a * g1) / n1)
        tries.append((loss(a, c), a, c))
    best = min(tries)
    return best[1], best[2], best[0]


def fit_decay(depth: np.ndarray, n: np.ndarray, s: np.ndarray, a_bounds: tuple[float, float] = (-np.inf, np.inf), c_bounds: tuple[float, float] = (-np.inf, 0.0), rates: np.ndarray | None = None) -> tuple[float, float, float]:
    """A, B, C of z = A exp(B depth) + C with B <= 0, from counts and sums of z at each depth.

    For a given B the rest is linear; B is searched on a logarithmic grid and then refined.
    """
    span = max(float(depth.max() - depth.min()), 1e-9)
    grid = -np.concatenate([[0.0], np.logspace(-4, 2.5, 120)]) / span if rates is None else rates

    def at(b: float) -> tuple[float, float, float]:
        return _linear(n, s, np.exp(b * depth), a_bounds[1], c_bounds[1], c_bounds[0], a_bounds[0])

    losses = [at(b)[2] for b in grid]
    k = int(np.argmin(losses))
    lo, hi = sorted((grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]))
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        p, q = hi - golden * (hi - lo), lo + golden * (hi - lo)
        if at(p)[2] <= at(q)[2]:
            hi = q
        else:
            lo = p
    b = min((grid[k], (lo + hi) / 2), key=lambda v: at(v)[2])
    a, c, _ = at(b)
    return a, float(b), c


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction evaluated from the end."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    tail = 1.0
    for i in range(300, 0, -1):
        m = i // 2
        top = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1 + top * x / tail
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / (a * tail)


def regress_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation r of n pairs (Student t with n - 2 degrees)."""
    if n < 3 or not np.isfinite(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return beta_tail(df / (df + t2), df / 2, 0.5)


def triangles(points: np.ndarray, sweep: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Delaunay triangles (index triples) of distinct points, their circumcentres and circumradii.

    Points are inserted from left to right. A triangle whose circle ends left of the next point is
    final and is put aside every ``sweep`` points, so a step only looks at those near the front.
    """
    centre, reach = points.mean(axis=0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    p = np.vstack([(points - centre) / reach, [[-400, -300], [400, -300], [0, 600]]])
    n = len(points)

    def circles(t: np.ndarray) -> np.ndarray:
        """Centre and squared radius; infinite for flat triangles."""
        origin = p[t[:, 0]]
        b, c = p[t[:, 1]] - origin, p[t[:, 2]] - origin
        bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        flat = d == 0
        d[flat] = 1.0
        ux, uy = (c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d
        return np.column_stack([origin[:, 0] + ux, origin[:, 1] + uy, np.where(flat, np.inf, ux * ux + uy * uy)])

    px, py = p[:, 0].tolist(), p[:, 1].tolist()

    def circle(x: int, y: int, i: int) -> tuple[float, float, float]:
        """As circles, for one triangle: a step makes too few for arrays to pay."""
        ox, oy = px[x], py[x]
        bx, by, cx, cy = px[y] - ox, py[y] - oy, px[i] - ox, py[i] - oy
        bb, cc, d = bx * bx + by * by, cx * cx + cy * cy, 2 * (bx * cy - by * cx)
        if d == 0:
            return ox, oy, math.inf
        ux, uy = (cy * bb - by * cc) / d, (bx * cc - cx * bb) / d
        return ox + ux, oy + uy, ux * ux + uy * uy

    front, around = np.zeros((256, 3), np.int64), np.zeros((3, 256))
    front[0] = n, n + 1, n + 2
    around[:, :1] = circles(front[:1]).T
    used, final, final_around = 1, [], []
    for step, i in enumerate(np.argsort(p[:n, 0], kind="stable").tolist()):
        if step % sweep == 0:
            live = around[2, :used] >= 0
            left = live & (around[0, :used] + np.sqrt(np.maximum(around[2, :used], 0)) < px[i] - 1e-9)
            final.append(front[:used][left])
            final_around.append(around[:, :used][:, left].T)
            keep = np.flatnonzero(live & ~left)
            front[: len(keep)], around[:, : len(keep)] = front[keep], around[:, keep]
            used = len(keep)
        dx, dy = around[0, :used] - px[i], around[1, :used] - py[i]
        hit = (dx * dx + dy * dy < around[2, :used] * (1 + 1e-12)).nonzero()[0]
        rim: set[tuple[int, int]] = set()
        for x, y, z in front[hit].tolist():
            for edge in ((x, y), (y, z), (z, x)):
                rim ^= {edge if edge[0] < edge[1] else edge[::-1]}  # edges of two triangles go
        # new triangles take the places of those that go, and further ones at the end
        at = hit.tolist()
        while used + max(0, len(rim) - len(at)) > len(front):
            front, around = np.concatenate([front, np.zeros_like(front)]), np.concatenate([around, np.zeros_like(around)], axis=1)
        at += range(used, used + max(0, len(rim) - len(at)))
        used = max(used, at[-1] + 1) if at else used
        if rim:
            front[at[: len(rim)]] = [(x, y, i) for x, y in rim]
            around[:, at[: len(rim)]] = np.array([circle(x, y, i) for x, y in rim]).T
        if len(at) > len(rim):
            around[2, at[len(rim) :]] = -1.0
    live = around[2, :used] >= 0
    t, a = np.concatenate([*final, front[:used][live]]), np.concatenate([*final_around, around[:, :used][:, live].T])
    own = (t < n).all(axis=1) & np.isfinite(a[:, 2])
    return t[own], a[own, :2] * reach + centre, np.sqrt(a[own, 2]) * reach


def triangle_areas(corners: np.ndarray) -> np.ndarray:
    """Areas of triangles given as (triangle, corner, coordinate)."""
    b, c = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    return np.abs(b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]) / 2


def convex_area(points: np.ndarray) -> float:
    """Area of the convex hull."""
    hull: list[np.ndarray] = []
    ordered = points[np.lexsort(points.T[::-1])]
    for side in (ordered, ordered[::-1]):
        part: list[np.ndarray] = []
        for q in side:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (q[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (q[0] - part[-2][0]):
                part.pop()
            part.append(q)
        hull += part[:-1]
    if len(hull) < 3:
        return 0.0
    x, y = (np.array(hull) - points.mean(axis=0)).T
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def alpha_area(points: np.ndarray, alpha: float, box: tuple[float, float, float, float] | None = None) -> float:
    """Area of the concave hull: the Delaunay triangles whose circumradius is under 1 / alpha; with alpha 0
    that of the convex hull. With a box (x0, y0, x1, y1) only triangles around a centre in it count."""
    points = np.unique(np.asarray(points, float), axis=0)
    if len(points) < 3:
        return 0.0
    if alpha <= 0 or (len(points) == 3 and box is None):
        return convex_area(points)
    t, centre, radius = triangles(points)
    picked = radius < 1 / alpha
    if box is not None:
        picked &= (centre >= box[:2]).all(axis=1) & (centre < box[2:]).all(axis=1)
    return float(triangle_areas(points[t[picked]]).sum())
