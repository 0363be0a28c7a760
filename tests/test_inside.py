"""Inside probabilities of whole pairs: closed forms of small trees, and which pairs fit."""

import math

import pytest

from parsewright.plans import registry

#: E and F words of each conversation's two turns.
SIZES = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (3, 4), (6, 8), (19, 20), (19, 28), (20, 20), (10, 29), (5, 40)]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("inside"))
    name = lambda k, n: " ".join(chr(97 + (k + j) % 26) for j in range(n))
    rows = [(k, t, "user", name(k, n)) for k, p in enumerate(SIZES) for t, n in enumerate(p)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return {SIZES[r["pair_id"] // 10**9]: r["log2"] for r in registry.QUERIES["inside_probabilities"](spark, path).collect() if r["pair_id"] % 10**9 == 0}


LEAF = {0: 0.01, 1: 0.01, 2: 0.03, 3: 0.03}  # no insertion, or one on either side; the band is 1 to 3


def two_leaves(m):
    """A node of two leaves under a unary root, by the number of foreign words."""
    deals = lambda n: sum(p * LEAF.get(n - a, 0) for a, p in LEAF.items())
    inner = lambda n: 0.02 * deals(n) + (0.04 * deals(n - 1) if n > 0 else 0) if 0 <= n <= 4 else 0
    return 0.01 * inner(m) + 0.02 * inner(m - 1)


def test_closed_forms(found):
    for m in (1, 2, 3):
        assert found[1, m] == pytest.approx(math.log2(LEAF[m]), abs=1e-6)
    for m in (1, 2, 3, 4):
        assert found[2, m] == pytest.approx(math.log2(two_leaves(m)), abs=1e-6)


def test_every_fitting_pair_is_there(found):
    """19 E and 29 F words at most, and the band of the whole sentence: no id or prefix decides."""
    assert set(found) == {(e, f) for e, f in SIZES if e <= 19 and f <= 29 and f <= int(1.4 * e + 2.001)}
    assert all(math.isfinite(p) for p in found.values())


def test_a_shape_takes_one_chart(monkeypatch):
    """Pairs of one shape and length share their chart, also over tasks of a worker."""
    import pandas as pd

    from parsewright.operators import em

    made = []
    build = em.build
    monkeypatch.setattr(em, "build", lambda *a: made.append(1) or build(*a))
    monkeypatch.setattr(em, "_shapes", {})
    nodes = {"node_id": [0, 1, 2], "parent_id": [-1, 0, 0], "child_idx": [0, 0, 1], "symbol": [2, 4, 5], "head": [0, 7, 8], "numc": [2, 0, 0], "epos": [0, 0, 1], "elen": [2, 1, 1], "is_leaf": [False, True, True]}
    lone = {"node_id": [0], "parent_id": [-1], "child_idx": [0], "symbol": [4], "head": [7], "numc": [0], "epos": [0], "elen": [1], "is_leaf": [True]}
    none = {f"{c}__{x}": None for c in ("t", "tw", "fert", "l1") for x in em.GATHERED[c]}

    def row(k, shape, n):
        import numpy as np

        return {"pair_id": k, "f": [20] * n, "n_e": 2 if shape is nodes else 1, "r": None, "n": None, "words": None} | {f"nodes__{x}": np.array(v) for x, v in shape.items()} | none

    frame = pd.DataFrame([row(k, nodes, m) for k, m in enumerate((1, 2, 3, 2, 2))] + [row(9, lone, 2)])
    out = pd.concat([*em.shape_events(iter([frame]), registry.EQUAL, 0.0), *em.shape_events(iter([frame]), registry.EQUAL, 0.0)])
    assert len(made) == 4
    want = [build(em.Row(x), registry.EQUAL, True, True, 0.0)[0].total for x in frame.itertuples(index=False)]
    assert out["cnt"].tolist() == want * 2 and want[-1] == pytest.approx(LEAF[2]) and len(set(want)) == 4
