"""Candidates of references: one list a name, by broadcast and by shuffle."""

import random

import pytest

from quern.operators import surface


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_candidates_equal_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(surface, "BROADCAST_OWNERS", most)
    r = random.Random(3)
    names = [(r.choice(["a", "b", "c", "noSuchMethod", None]), f"o{r.randrange(12)}") for _ in range(40)] + [("a", None)]
    refs = [(k % 50 if k else None, r.choice(["a", "b", "x", "noSuchMethod", None]), r.choice([True, False, None])) for k in range(70)]
    want = {}
    for k, name, dispatch in refs:
        held = want.setdefault(k, set())
        if k is not None and name is not None:
            held |= {o for n, o in names if o and (n == name or dispatch and n == "noSuchMethod")}
    made = surface.reference_candidates(spark.createDataFrame(refs, "ref_id int, name string, can_dispatch boolean"), spark.createDataFrame(names, "name string, owner_id string"))
    got = sorted(((x.ref_id or -1, x.candidates, x.outcome) for x in made.collect()), key=str)
    assert got == sorted(((k or -1, sorted(want[k]), "namespace_blocker" if name is None else "id_blocker" if want[k] else "none") for k, name, _ in refs), key=str)
