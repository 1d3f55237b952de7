"""Outliers of tables and of groups too small for an estimate of their own."""

import pytest

from tessera.llm import quality


def prose(i):
    return " ".join(f"word{i}x{k}" for k in range(60 + i % 17))


def junk(i):
    return " ".join(f"#|{i}{k}|#$%&*<>" for k in range(3000))


def verdicts(spark, rows):
    return {r["doc_id"]: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


def test_outlier_of_a_small_table(spark):
    got = verdicts(spark, [(i, prose(i), "en", "a") for i in range(60)] + [(99, junk(1), "en", "a")])
    assert not got[99]["base_failed"] and not got[99]["kept"]
    assert all(got[i]["kept"] and got[i]["distance"] is not None for i in range(60))


def test_outlier_of_a_rare_group(spark):
    large, rare = [(i, prose(i), "en", "a") for i in range(300)], [(1000 + i, prose(i), "fr", "b") for i in range(8)]
    got = verdicts(spark, [*large, *rare, (2000, junk(2), "fr", "b")])
    assert not got[2000]["kept"] and len(got) == 309
    assert all(got[i]["kept"] for i in [*range(300), *range(1000, 1008)])
    alone = verdicts(spark, large)
    assert all(got[i]["distance"] == pytest.approx(alone[i]["distance"], abs=1e-6) for i in range(300))
