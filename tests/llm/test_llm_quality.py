"""Held-out quality of the two models over labelled documents, where the tables are there."""

import os

import pytest

SF_DIR = os.environ.get("TEST_QUALITY_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def test_classifier_on_held_out_rows(spark):
    from tessera.llm.queries import QUERIES

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    held = QUERIES["op4_quality_classifier"](spark, SF_DIR).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    accuracy = sum(r.predicted == r.quality for r in held) / len(held)
    print(f"op4: {len(held)} held-out rows, AUC {auc:.3f}, accuracy {accuracy:.3f}")
    assert auc >= 0.95 and accuracy >= 0.9


def test_rules_keep_good_rows(spark):
    from tessera.llm.queries import QUERIES

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    rows = QUERIES["op2_quality_rules"](spark, SF_DIR).join(labels, "doc_id").select("base_failed", "kept", "quality").collect()
    assert not any(r.kept for r in rows if r.base_failed)
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    print(f"op2: kept {sum(good)} of {len(good)} good rows that pass the base, dropped {len(bad) - sum(bad)} of {len(bad)} bad ones")
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
