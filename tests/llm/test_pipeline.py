"""The corpus pipeline and its stages on small tables, repeated rows included."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"


def prose(i, n=40):
    return " ".join(f"w{i}x{k}" for k in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1) for i, t, s in rows], SCHEMA)


def test_mixing_of_repeated_rows(spark):
    hot = [(7, prose(7), "b")] * 30 + [(8, prose(8), "c"), (8, prose(80), "c"), (8, prose(8, 50), None), (8, None, "a")]
    rows = [(i, prose(i, 30 + i % 9), "abc"[i % 3]) for i in range(100, 160)] + hot
    table = docs(spark, rows)
    mixed = mixing.mix(table).collect()
    want = Counter()
    for r in mixed:
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    got = stages.mixing(spark, table, "").collect()
    assert Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in got) == +want
    have, taken = Counter(rows), Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    assert all(n <= 3 * have[k] for k, n in taken.items())
    for s, target in {(r["source"], r["target"]) for r in mixed}:
        size = max(len((t or "").split()) for _, t, src in rows if src == s)
        assert abs(sum(len((r["text"] or "").split()) for r in got if r["source"] == s) - target) <= size


def test_near_duplicates_keep_one_row_of_an_id(spark):
    rows = [(1, prose(1), "a")] * 5 + [(2, prose(2), "b"), (2, prose(2, 60), "b"), (2, prose(2, 60), "a"), (2, None, "a"), (3, prose(3), "a")]
    got = stages.near_duplicates(spark, docs(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in got) == [(1, prose(1), "a"), (2, prose(2, 60), "a"), (3, prose(3), "a")]


def test_pipeline_with_repeated_rows(spark, tmp_path):
    rows = [(i, prose(i), "abc"[i % 3]) for i in range(30)] + [(5, prose(5), "c")] * 12
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs(spark, rows[:30]).write.parquet(f"{tmp_path}/once/documents.parquet")
    assert got == Counter(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/once").collect())
    assert max(got.values()) <= 3


NAMES = ["__at", "__i", "__id", "__gone", "__many", "__n", "__size", "rest", "__row", "doc", "a.b", "n", "key", "h", "__one", "c0"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_any_name_stay(spark, name):
    """Each stage with every name that it, or another, uses within: the same rows as without, the extra columns unchanged."""
    rows = [(i, prose(i % 40, 30 + i % 9) + ("\n" + prose(900) if i % 4 == 0 else ""), "abc"[i % 3]) for i in range(60)] + [(7, prose(7, 37), "b"), (8, None, "c")]
    plain = docs(spark, rows)
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES], F.create_map(F.lit("k"), F.col("doc_id")).alias("map"))
    got, want = stage(spark, odd, ""), stage(spark, plain, "")
    assert got.columns == odd.columns
    same = [F.col(f"`{n}`") == F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES]
    told = got.select("doc_id", "text", "lang", "source", "n_chars", "size", *[c.alias(f"x{i}") for i, c in enumerate(same)]).collect()
    assert all(all(r[6:]) for r in told)
    assert Counter(r[:6] for r in told) == Counter(tuple(r) for r in want.collect())


def test_tokens_with_columns_of_any_name(spark):
    plain = docs(spark, [(i, prose(i), "a") for i in range(5)])
    odd = plain.select("*", *[F.lit(1).alias(n) for n in (*NAMES, "ids", "block", "bucket", "docs")])
    assert sorted(stages.tokens(spark, odd, "").collect()) == sorted(stages.tokens(spark, plain, "").collect())
