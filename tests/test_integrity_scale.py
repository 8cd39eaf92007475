"""Only facts that dangle are dealt out over contexts to count them."""

from quern.model_queries import _model


def test_integrity_needs_no_edge_contexts(spark):
    m = _model(spark, "/root/testdata/sf0.001")
    rows = {r.context: r for r in m.integrity.collect()}
    assert "edge_contexts" not in m.__dict__ and "root_contexts" not in m.__dict__
    app = m.edge_contexts.where("applicability = 'unknown'").groupBy("context").count().collect()
    assert {c: n for c, n in app} == {c: r.unknown_edges for c, r in rows.items() if r.unknown_edges}
    assert rows["aux:test:1"].dangling_roots == 1 and all(rows[c].dangling_edges == 1 for c in rows if c != "unattributed")
