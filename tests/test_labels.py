"""The registered labels cover whole tracks."""

from collections import Counter

from slabline.plans import standins, trace_queries  # noqa: F401
from slabline.plans.registry import QUERIES


def flooded(ice):
    """Sizes of the 4-connected parts of a set of cells, by flood fill."""
    ice, sizes = set(ice), []
    while ice:
        todo, n = [ice.pop()], 0
        while todo:
            x, y = todo.pop()
            n += 1
            for at in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                if at in ice:
                    ice.remove(at)
                    todo.append(at)
        sizes.append(n)
    return sizes


def test_labels_of_whole_tracks(spark, data):
    cells = {}
    rows = standins.view(spark, data, "traces").select("track", "trace", "samples").orderBy("trace").collect()
    at = Counter()
    for r in rows:
        for i, v in enumerate(r["samples"]):
            if i >= 2 and v is not None and v <= 0:
                cells.setdefault(r["track"], []).append((at[r["track"]], i))
        at[r["track"]] += 1
    want = {(t, size): n for t, ice in cells.items() for size, n in Counter(flooded(ice)).items()}
    assert max(at.values()) > 12
    got = {(r["track"], r["size"]): r["n"] for r in QUERIES["i3_labels"](spark, data).collect()}
    assert got == want
