"""What the evidence queries make before they read."""

from __future__ import annotations

from matewise.plans import evidence_queries

SF = "/root/testdata/sf0.001"


def test_pairs_are_generated_once(spark, monkeypatch):
    """The default run and the one without validation share a pass over the pairs, and keep nothing in executors' memory."""
    asked, generated = [], evidence_queries.generated
    monkeypatch.setattr(evidence_queries, "generated", lambda *a: asked.append(a) or generated(*a))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert evidence_queries.evidence_replace(spark, f"{SF}/.").count() > 500
    assert len(asked) == 1 and spark.sparkContext._jsc.getPersistentRDDs().size() == held
