"""Charts of many pairs at once give what a chart of each pair gives."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from parsewright.operators import em, estep, params, trees

TABLES = {t: em.GATHERED[t] for t in ("t", "tw", "fert", "l1")}
LISTS = {"prob": pa.float64(), "l1": pa.float64(), "is_leaf": pa.bool_()}
SCHEMA = pa.schema(
    [("pair_id", pa.int64()), ("f", pa.list_(pa.int32())), ("n_e", pa.int32()), ("r", pa.map_(pa.string(), pa.list_(pa.float64()))), ("n", pa.map_(pa.string(), pa.list_(pa.float64()))), ("words", pa.map_(pa.string(), pa.float64()))]
    + [(f"{t}__{x}", pa.list_(pa.string() if (t, x) == ("tw", "f") else LISTS.get(x, pa.int32()))) for t in ("nodes", *TABLES) for x in em.GATHERED[t]]
)
SHAPES = ["{}/4", "(2 {}/4)", "(2 {}/4 {}/5)", "(2 {}/4 {}/5 {}/6)", "(2 (3 {}/4 {}/5) {}/4 (3 (5 {}/6)) {}/4)", "(2 (3 (3 {}/4 {}/5)) (3 {}/6 {}/5 {}/4))", "(2 {}/4 {}/5 {}/6 {}/4 {}/5)"]


def made(config, equal, pairs=40):
    """Random rows as they are gathered; probabilities of rules, contexts and words are those of one model."""
    rng = random.Random(7)
    model = defaultdict(lambda: rng.random() if rng.random() < 0.9 else 0.0)
    rows = []
    for k in range(pairs):
        text = rng.choice(SHAPES)
        text = text.format(*[rng.randint(10, 13) for _ in range(text.count("{}"))])
        nodes = trees._read(pa.array([text])).to_pylist()[0]
        f = [rng.randint(20, 23) for _ in range(rng.randint(1, 6))]
        n = len(f)
        row = {"pair_id": k, "f": f, "n_e": sum(x["is_leaf"] for x in nodes), "r": None, "n": None, "words": None}
        for x in em.GATHERED["nodes"]:
            row[f"nodes__{x}"] = [v[x] for v in nodes]
        found = {t: [] for t in TABLES}
        spans = {(v["epos"], v["elen"]) for v in nodes}
        for a, e in sorted(spans):
            if e > 1 and rng.random() < 0.7:
                found["l1"].append((a, e, rng.random()))
            if config.fertility and not equal:
                found["tw"] += [(a, e, str(w), rng.random()) for w in sorted(set(f)) if rng.random() < 0.8]
                found["fert"] += [(a, e, m, rng.random()) for m in range(9) if rng.random() < 0.8]
            else:
                found["t"] += [(a, e, p, m, rng.random()) for m in range(1, n + 1) for p in range(n - m + 1) if rng.random() < 0.7 and (not equal or e > 1 or m > 1)]
                found["t"] += [(a, e, 0, 0, rng.random())] if e == 1 and not equal else []
        for t, names in TABLES.items():
            for j, x in enumerate(names):
                row[f"{t}__{x}"] = [v[j] for v in found[t]] or None
        if not equal:
            symbol, kids = [v["symbol"] for v in nodes], [[c["node_id"] for c in nodes if c["parent_id"] == v["node_id"]] for v in nodes]
            row["r"], row["n"], row["words"] = {}, {}, {str(w): model["w", w] for w in f}
            for v in nodes:
                own = kids[v["node_id"]]
                if own:
                    rule = f"{9999 if config.old_rules else v['symbol']} " + " ".join(str(symbol[c]) for c in own)
                    row["r"][rule] = [model["r", rule, j] for j in range(len(em.orders(len(own))))]
                up = v["parent_id"]
                ctx = f"0 {v['symbol']}|0" if up < 0 else f"{symbol[up]} {v['symbol']}|0" if config.old_rules else " ".join(str(symbol[c]) for c in [up, *kids[up]]) + f"|{v['child_idx']}"
                if config.shared_words:
                    row["n"][ctx] = [model["n", ctx, j] for j in range(3)]
                else:
                    row["n"] |= {f"{ctx}#{s}#{w}": [model["n", ctx, s, w]] for s in range(3) for w in (f if s else [0])}
            row["r"], row["n"], row["words"] = (list(row[x].items()) for x in ("r", "n", "words"))
        rows.append(row)
    return pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def by_pair(batch, config, model_free, equal, floor):
    """Sums of the counts of a chart of each pair."""
    out = defaultdict(float)
    for row in map(em.Row, batch.to_pandas().itertuples(index=False)):
        chart, rules, ctxs, sent = em.build(row, config, model_free, equal, floor)
        out["prob", "", "", row.n_e, row.pair_id] = chart.total
        c, f = chart.counts(), [str(x) for x in row.f]
        heads = [str(int(x["head"])) for x in row.nodes if x["is_leaf"]]
        weights = em.phrase_weights(row)
        for v, node in enumerate(chart.nodes):
            e = " ".join(heads[node.epos : node.epos + node.elen])
            for p, m in zip(*np.nonzero((c.t[v] > 0) & (sent.get((node.epos, node.elen), chart.t[v] * 0) > 0)), strict=True) if v in c.t else ():
                if config.fertility:
                    out["fert", e, "", m, None] += c.t[v][p, m]
                    for w in f[p : p + m]:
                        out["t", e, w, 0, None] += c.t[v][p, m]
                else:
                    out["t", e, " ".join(f[p : p + m]) if m else params.NULL, 0, None] += c.t[v][p, m]
            for k, cnt in enumerate(c.r[v]):
                out["r", rules[v], "", k, None] += cnt
            if config.lambda1 is None and node.children and weights.get((node.epos, node.elen), 0) > 0:
                out["lambda1", e, "", 0, None] += c.phrase[v]
                out["lambda1n", e, "", 0, None] += c.no_phrase[v]
            out["n", ctxs[v], params.SHARED_WORD, 0, None] += c.none[v]
            for side, cnt in ((1, c.right[v]), (2, c.left[v])):
                for p, w in enumerate(f):
                    out["n", ctxs[v], params.SHARED_WORD if config.shared_words else w, side, None] += cnt[p]
                    if config.shared_words:
                        out["insword", "", w, 0, None] += cnt[p]
    return {k: v for k, v in out.items() if v != 0}


DEFAULT = em.Config()
PLAIN = em.Config(chinese=False, cutoff=False, fertility=False, lambda1=0.0, shared_words=False, old_rules=False)


@pytest.mark.parametrize(("config", "equal", "floor"), [
    (DEFAULT, True, 0.0), (DEFAULT, False, 0.0), (DEFAULT, False, 1e-5), (DEFAULT.with_options(lambda2=0.5), False, 0.0), (PLAIN, True, 0.0), (PLAIN, False, 0.0),
    (PLAIN.with_options(lambda1=0.3, lambda1_scaled=True), False, 1e-5), (PLAIN.with_options(fertility=True, shared_words=True), False, 0.0), (DEFAULT.with_options(cutoff=False), True, 0.0)])
def test_as_pair_by_pair(config, equal, floor):
    batch = made(config, equal)
    free = equal and not config.cutoff
    got = defaultdict(float)
    for out in estep.events(iter([batch]), TABLES, config, free, equal, floor, True, 500):
        for kind, a, b, i, cnt, pair in zip(*[x.to_pylist() for x in out.columns], strict=True):
            got[kind, a, b, i, pair] += cnt
    got = {k: v for k, v in got.items() if v != 0}
    want = by_pair(batch, config, free, equal, floor)
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-300) for k in want)


def test_pairs_of_a_shape_share_their_chart(monkeypatch):
    """A chart takes a few calls for all pairs of a shape and length, not for each pair."""
    sizes = []
    charts = estep.Charts
    monkeypatch.setattr(estep, "Charts", lambda *a: sizes.append(a[3].shape[1]) or charts(*a))
    batch = made(DEFAULT, False, 400)
    probs = pd.concat([x.to_pandas() for x in estep.events(iter([batch]), TABLES, DEFAULT, False, False, 0.0, False, 500)])
    assert sum(sizes) == len(probs) == 400 and len(sizes) <= len(SHAPES) * 6


def test_blocks_hold_alike_pairs(spark):
    """Pairs go through the chart in blocks of one shape and length, whatever order they come in."""
    rows = [(k, "(2 10/4 11/5)" if k % 2 else "10/4", [20] * (1 + k % 3)) for k in range(600)]
    made = em.fitting(spark.createDataFrame(rows, "pair_id long, e_tree string, f array<int>"), DEFAULT, blocks=True).collect()
    blocks = defaultdict(list)
    for r in made:
        blocks[r.block].append((r.n_e, len(r.f)))
    assert len(made) == 600 and max(map(len, blocks.values())) <= em.BLOCK
    assert sum(len(set(x)) for x in blocks.values()) <= len(blocks) + 5


FREE = PLAIN.with_options(shared_words=True)


@pytest.mark.parametrize(("config", "equal"), [(FREE, True), (FREE, False), (DEFAULT, False)])
def test_sums_of_a_shape_are_those_of_its_pairs(monkeypatch, config, equal):
    """Orders and totals without rows of counts; where nothing is looked up, from one chart a shape and length."""
    batch = made(config, equal, 200)
    if equal:
        batch = pa.RecordBatch.from_pylist([{k: None if k.startswith("t__") else v for k, v in x.items()} for x in batch.to_pylist(maps_as_pydicts="strict")], schema=SCHEMA)
    want, totals = defaultdict(float), {}
    for k in range(len(batch)):
        one = by_pair(batch.slice(k, 1), config, equal, equal, 0.0)
        for (kind, a, _, i, _), cnt in one.items():
            if kind == "r":
                want[a, i] += cnt
        of = lambda *kinds: sum(v for x, v in one.items() if x[0] in kinds)  # noqa: E731, B023
        sides = sum(v for x, v in one.items() if x[0] == "n" and x[3] > 0)
        words = sum(v * x[3] for x, v in one.items() if x[0] == "fert") + sum(v * len(x[2].split()) for x, v in one.items() if x[0] == "t" and x[2] != params.NULL and not config.fertility)
        if of("prob") > 0:
            totals[k] = of("r"), of("n"), of("fert" if config.fertility else "t"), sides + words
    sizes = []
    charts = estep.Charts
    monkeypatch.setattr(estep, "Charts", lambda *a: sizes.append(a[3].shape[1]) or charts(*a))
    monkeypatch.setattr(estep, "_shapes", {})
    options = TABLES, config, equal, equal, 0.0
    got = defaultdict(float)
    for out in (*estep.order_counts(iter([batch]), *options),):
        for rule, perm, cnt in zip(*[x.to_pylist() for x in out.columns], strict=True):
            got[rule, perm] += cnt
    assert not equal or set(sizes) == {1} and len(sizes) < 200
    found = {x["pair_id"]: tuple(x.values())[1:] for out in estep.count_totals(iter([batch, batch.slice(0, 0)]), *options) for x in out.to_pylist()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert found.keys() == totals.keys() and all(found[k] == pytest.approx(totals[k], rel=1e-9, abs=1e-12) for k in totals)
