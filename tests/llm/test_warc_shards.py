"""Shards of the WARC writer when ids are far from evenly spread."""

import pytest

from tessera.llm import warc
from tessera.llm.common import new_path


@pytest.mark.parametrize("far", [[2**40], [-(2**63), 2**63 - 1], [-5, 10**6, 10**6 + 1, 10**12], []])
def test_far_ids_leave_the_others_in_many_shards(spark, monkeypatch, far):
    monkeypatch.setattr(warc, "SHARD_BYTES", 1000)
    ids = sorted([*range(200), *far])
    pages = spark.createDataFrame([(i, f"http://{i}", f"{i:050d}"[-50:]) for i in ids], "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    manifest = warc.write(pages, folder)
    records = {}
    for r in manifest.collect():
        records[r["file"][:11]] = records.get(r["file"][:11], 0) + r["records"]
    assert len(records) >= 9 and max(records.values()) <= 40
    assert sorted(r["page_id"] for r in warc.read(spark, folder, manifest).collect()) == ids
    starts = warc.shards(pages)
    assert starts == sorted(set(starts)) and starts[0] == ids[0]
