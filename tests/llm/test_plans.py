"""What the driver plans at once in near-duplicate removal: shuffles of the largest query."""

from tessera.llm import minhash


def largest_plan(spark, monkeypatch, module=minhash) -> int:
    seen, stored = [], module.stored

    def counted(df, name):
        seen.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange "), name))
        return stored(df, name)

    monkeypatch.setattr(module, "stored", counted)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i % 4] + [f"x{i // 4}"] * 3)) for i in range(24)] + [(100, None), (101, "")]
    got = module.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    return max(seen)[0]


def test_tables_read_more_than_once_are_stored(spark, monkeypatch):
    assert largest_plan(spark, monkeypatch) <= 8  # 13 when branches made them anew
