import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import array_shapes, arrays

from slabline.functions import kernels as k

IMAGES = arrays(bool, array_shapes(min_dims=2, max_dims=2, min_side=1, max_side=12))


def flooded(image):
    seen, sizes = np.zeros(image.shape, int), []
    for i, j in np.argwhere(image):
        if seen[i, j]:
            continue
        sizes.append(0)
        stack = [(i, j)]
        seen[i, j] = len(sizes)
        while stack:
            a, b = stack.pop()
            sizes[-1] += 1
            for x, y in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= x < image.shape[0] and 0 <= y < image.shape[1] and image[x, y] and not seen[x, y]:
                    seen[x, y] = len(sizes)
                    stack.append((x, y))
    return seen, sizes


@settings(max_examples=150, deadline=None)
@given(IMAGES)
def test_labels_like_flood_fill(image):
    labels, sizes = k.label4(image)
    seen, want = flooded(image)
    assert sorted(sizes[1:]) == sorted(want) and sizes.sum() == image.size
    assert (labels > 0).tolist() == image.tolist()
    pairs = {(a, b) for a, b in zip(labels.ravel(), seen.ravel(), strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@settings(max_examples=100, deadline=None)
@given(IMAGES)
def test_shrink_inside_grow_outside(image):
    assert not (k.shrink(image) & ~image).any()
    assert not (image & ~k.grow(image)).any()


def test_border_pixels_survive_shrinking():
    image = np.zeros((5, 6), bool)
    image[0:2, 0:3] = True
    small = k.shrink(image)
    assert small[0].tolist() == [True, True, False, False, False, False] and not small[1:].any()
    assert k.grow(small)[:2, :3].tolist() == [[True, True, True], [True, True, False]]


def test_diagonal_components_stay_apart():
    assert k.label4(np.eye(3, dtype=bool))[1].tolist() == [6, 1, 1, 1]


def test_components_beside_a_removed_column_join():
    image = np.array([[1, 1, 0, 1, 1]], bool)
    assert k.label4(np.delete(image, 2, axis=1))[1].tolist() == [0, 4]
    assert k.label4(image)[1].tolist() == [1, 2, 2]


def test_size_filter_and_skipped_depths():
    values = np.full((6, 4), -1.0)
    values[4, 1] = np.nan
    counts = k.ice_count(values, np.array([-2.0, 0.0]), "orig", least=1)
    assert counts[:2].sum() == 0 and counts[2:].sum() == 15
    assert k.ice_count(values, np.array([0.0]), "orig", least=16).sum() == 0


def test_surface_is_followed():
    rng = np.random.default_rng(0)
    want = (60 + 10 * np.sin(np.arange(80) / 10)).astype(int)
    traces = rng.random((200, 80))
    for i, s in enumerate(want):
        traces[s:, i] += 5
    got = k.follow_surface(traces, 60, radius=20, search=15)
    assert np.abs(got - want).max() <= 6
    assert (k.follow_surface(traces, 0, radius=20, search=15) >= 0).all()


def test_false_jump_is_bridged():
    line = np.full(100, 50)
    line[40:48] = 75
    assert (k.without_jumps(line) == 50).all()
    slope = np.arange(100)
    assert (k.without_jumps(slope) == slope).all()


def test_decay_fit():
    d = np.linspace(0, 20, 41)
    a, b, c = k.fit_decay(d, np.full(41, 3.0), 3 * (-2 * np.exp(-0.3 * d) - 1))
    assert (a, b, c) == pytest.approx((-2, -0.3, -1), rel=1e-5)
    a, b, c = k.fit_decay(d, np.ones(41), np.full(41, 2.0))
    assert c <= 0 and b <= 0 and a * np.exp(b * d) + c == pytest.approx(2.0, abs=1e-6)


def test_p_values():
    assert k.regress_p(0.5, 20) == pytest.approx(0.0247696, rel=1e-4)
    assert k.regress_p(0.0, 10) == pytest.approx(1.0)
    assert np.isnan(k.regress_p(0.3, 2)) and k.regress_p(1.0, 5) == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1000))
def test_hull_area_is_convex_area_without_alpha(seed):
    p = np.random.default_rng(seed).random((25, 2))
    hull, rest = [], sorted(map(tuple, p))
    for side in (rest, rest[::-1]):
        part = []
        for q in side:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (q[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (q[0] - part[-2][0]) <= 0:
                part.pop()
            part.append(q)
        hull += part[:-1]
    x, y = np.array(hull).T
    area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
    assert k.alpha_area(p, 0) == pytest.approx(area, rel=1e-9)
    assert k.alpha_area(p, 3) <= area + 1e-9


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 1000), st.sampled_from([2.0, 4.0, 8.0]))
def test_hull_area_by_all_triples(seed, alpha):
    from itertools import combinations

    p = np.random.default_rng(seed).random((24, 2))
    t = np.array(list(combinations(range(24), 3)))
    a, b, c = (p[t[:, i]] for i in range(3))
    d = 2 * ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
    bb, cc = ((b - a) ** 2).sum(axis=1), ((c - a) ** 2).sum(axis=1)
    u = np.stack([(c - a)[:, 1] * bb - (b - a)[:, 1] * cc, (b - a)[:, 0] * cc - (c - a)[:, 0] * bb], axis=1) / d[:, None]
    r, at = np.hypot(*u.T), a + u
    empty = (np.hypot(p[None, :, 0] - at[:, None, 0], p[None, :, 1] - at[:, None, 1]) < r[:, None] * (1 - 1e-9)).sum(axis=1) == 0
    want = (np.abs(d) / 4)[empty & (r < 1 / alpha)].sum()
    assert k.alpha_area(p, alpha) == pytest.approx(want, rel=1e-9)


def test_many_points_have_a_whole_triangulation():
    p = np.random.default_rng(1).random((3000, 2))
    t, _, _ = k.triangles(p)
    assert k.triangle_areas(p[t]).sum() == pytest.approx(k.convex_area(p), rel=1e-3)


def test_hull_of_few_points():
    assert k.alpha_area(np.array([[0, 0], [1, 1]]), 1) == 0
    assert k.alpha_area(np.array([[0, 0], [1, 0], [0, 1.0]]), 1000) == pytest.approx(0.5)


def rescanned(surface):
    """without_jumps as one pass that looks at every place with the line as it is then."""
    line = np.asarray(surface, np.int64).copy()
    for i in range(k.RECENT, len(line) - 1):
        if len(k._jump_starts(line, i, i + 1)) and (end := k._jump_end(line, i)):
            for j in range(i + 1, end):
                line[j] = round(line[i] + (line[end] - line[i]) * (j - i) / (end - i))
    return line


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(-60, 60)), min_size=1, max_size=12), st.integers(-2, 2))
def test_jumps_like_a_full_pass(parts, slope):
    line = np.concatenate([np.full(n, v) for n, v in parts])
    line = line + slope * np.arange(len(line))
    assert k.without_jumps(line).tolist() == rescanned(line).tolist()


def test_jump_rules_by_hand():
    up = np.full(60, 100)
    up[20:25] += 30  # returns within 20 steps
    assert (k.without_jumps(up) == 100).all()
    late = np.full(90, 100)
    late[20:55] += 30  # returns after 35 steps only: undone by the opposite jump
    assert (k.without_jumps(late) == 100).all()
    stays = np.full(120, 100)
    stays[20:] += 30
    assert (k.without_jumps(stays) == stays).all()
    small = np.full(60, 100)
    small[20:25] += 4
    assert (k.without_jumps(small) == small).all()


def test_long_lines_take_linear_time():
    import time

    line = np.append(np.tile([50] * 30 + [80] * 8, 8000), [50] * 30)
    began = time.process_time()
    assert (k.without_jumps(line) == 50).all()
    assert time.process_time() - began < 10


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 30), st.integers(1, 5))
def test_steps_from_everywhere(seed, depth, n):
    traces = np.random.default_rng(seed).standard_normal((depth, n))
    steps = k.surface_steps(traces, radius=4, search=6)
    for start in range(depth):
        at, line = start, []
        for step in steps:
            at = int(step[at])
            line.append(at)
        assert line == k.follow_surface(traces, start, radius=4, search=6).tolist()


def test_labels_of_long_winding_components():
    """Snakes whose ends meet only through every row, in both directions, and a comb."""
    snake = np.zeros((61, 61), bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    for image in (snake, snake.T, snake[::-1], snake[:, ::-1]):
        labels, sizes = k.label4(image)
        assert sizes.tolist() == [61 * 61 - image.sum(), image.sum()] and (labels == image).all()
    cut = snake.copy()
    cut[30, 30] = False
    labels, sizes = k.label4(cut)
    assert len(sizes) == 3 and (labels[:30][cut[:30]] == 1).all() and (labels[31:][cut[31:]] == 2).all() and sizes[1:].sum() == cut.sum()
    comb = np.zeros((40, 41), bool)
    comb[:, ::2] = True
    comb[-1] = True
    assert k.label4(comb)[1].tolist() == [40 * 41 - comb.sum(), comb.sum()]
