"""The lexical sweep's kernel against sums by hand, and what of its work is done cell by cell."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from attestor.operators import lexical as L, retrieval as R


@pytest.fixture(scope="module")
def made():
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    share = 1 / np.arange(1, 401)
    own = lambda n: sorted(set(r.choice(words, n, p=share / share.sum())))
    docs, asked = [own(60) for _ in range(300)], [own(25) for _ in range(90)] + [[]]
    tfs = [r.integers(1, 5, len(d)).tolist() for d in docs]
    idf = {w: float(r.uniform(0.01, 3)) for w in words}
    rows = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([sum(t) for t in tfs]), pa.array(docs), pa.array(tfs)], names=["ref", "dl", "terms", "tfs"])
    asks = pd.DataFrame({"query_id": range(91), "asked": asked, "weights": [[idf[w] for w in a] for a in asked]})
    want = {}
    for q, a in enumerate(asked):
        for ref, (d, t) in enumerate(zip(docs, tfs, strict=True)):
            parts = [idf[w] * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * sum(t) / 50.0)) for w, tf in zip(d, t, strict=True) if w in a]
            if parts:
                want.setdefault(q, []).append((-round(sum(parts), R.DIGITS), ref))
    return rows, asks, {q: sorted(s)[:7] for q, s in want.items()}


@pytest.mark.parametrize(("cells", "common"), [(R.CELLS, L.COMMON), (2000, 5), (100, 0)])
def test_best_passages_are_those_of_sums_by_hand(made, monkeypatch, cells, common):
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(L, "COMMON", common)
    rows, asks, want = made
    held = L.Scores(asks, 7, 50.0)
    for at in (0, 130):
        assert list(held.batch(rows.slice(at, 130 if not at else 170))) == []
    got = {}
    for q, ref, score in pd.concat(held.end())[["query_id", "ref", "score"]].itertuples(index=False):
        got.setdefault(q, []).append((-score, ref))
    assert {q: [ref for _, ref in sorted(s)] for q, s in got.items()} == {q: [ref for _, ref in s] for q, s in want.items()}
    assert all(np.allclose([s for s, _ in sorted(got[q])], [s for s, _ in want[q]], atol=2e-9) for q in want)


def test_common_terms_are_not_added_cell_by_cell(made, monkeypatch):
    """Each hit of a common term used to be written to the cell of every query that asks for it."""
    rows, asks, _ = made
    written = []

    class Add:
        @staticmethod
        def at(cells, index, values):
            written.append(len(index))
            np.add.at(cells, index, values)

    class Numpy:
        add = Add

        def __getattr__(self, name):
            return getattr(np, name)

    held = L.Scores(asks, 7, 50.0)
    hits = sum(held.many[c] for c in np.concatenate([held.names.index(w).as_py() * np.ones(1, int) for d in rows.column("terms").to_pylist() for w in d if held.names.index(w).as_py() >= 0]))
    monkeypatch.setattr(L, "np", Numpy())
    list(held.batch(rows))
    assert 0 < sum(written) < hits / 3


def test_other_terms_are_added_in_small_steps(made, monkeypatch):
    """As many cells at once as a matrix has took arrays of many times a core's cache."""
    rows, asks, _ = made
    steps = []

    class Add:
        @staticmethod
        def at(cells, index, values):
            steps.append(len(index))
            np.add.at(cells, index, values)

    class Numpy:
        add = Add

        def __getattr__(self, name):
            return getattr(np, name)

    held = L.Scores(asks, 7, 50.0)
    monkeypatch.setattr(L, "HITS", 1000, raising=False)
    monkeypatch.setattr(L, "np", Numpy())
    list(held.batch(rows))
    assert max(steps) <= 1000 < sum(steps)
