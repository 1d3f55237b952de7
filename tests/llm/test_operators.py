"""Corpus operators on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, lines, minhash, mixing, neighbours, pii, quality, tokens, toxicity, warc
from tessera.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w7 ", "other ")), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "ONE Two"),
    (9, LONG), (10, "mail a@b.example.com or +1 (555) 555-1234 at 10.0.0.1, 999.1.2.3; card 4111 1111 1111 1111"),
    (11, "don't <|endoftext|>, stop.\nthe same line is here again\nthe same line is here again\nthe same line is hare again"),
    (12, "éè 中文 \u0085x y é, ok."), (13, "q " * 400),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept boolean, size long, word string, key string"


def docs(spark, rows=TEXTS):
    made = [(i, t, None if i == 4 else "en", None if i == 7 else f"s{i % 2}", 7, False, 1, "w", "k") for i, t in rows]
    return spark.createDataFrame([*made, (None, "no id", "en", "s0", 1, True, 1, "w", "k")] if rows else [], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_equals_the_tokenizer_with_and_without_a_frequent_table(spark):
    made = Tokenizer.from_file(PATH)
    for most, seen in ((1 << 18, 2), (4, 1), (0, 1)):
        got = by_id(bpe.digests(bpe.encode_blocks(docs(spark), PATH, most_words=most, least_seen=seen), PATH))
        assert sorted(got) == [i for i, _ in TEXTS]
        for i, text in TEXTS:
            ids = made.encode(text or "", add_special_tokens=False).ids
            assert got[i]["n_tokens"] == len(ids)
            assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_near_duplicates_by_hand(spark):
    got = by_id(minhash.near_duplicates(docs(spark, [*TEXTS, (2, BASE)])))
    assert {i: r["component_id"] for i, r in got.items() if r["component_id"] != i} == {2: 1, 3: 1, 8: 7}
    assert got[4]["n_shingles"] == got[5]["n_shingles"] == got[6]["n_shingles"] == 0 and got[7]["n_shingles"] == 1


def test_lines(spark):
    got = by_id(lines.dropped_lines(docs(spark)))
    assert got[11]["exact"] == [2] and got[11]["near"] == [3]
    assert got[2]["exact"] == [0] and 3 not in got
    left = by_id(lines.without_lines(docs(spark), lines.dropped_lines(docs(spark))))
    assert left[11]["text"].count("\n") == 1 and left[4]["text"] is None and left[2]["text"] == ""


def test_quality_base(spark):
    got = by_id(quality.verdicts(docs(spark)))
    assert got[13]["n_repeat_words"] == 400 and got[13]["base_failed"] and not got[13]["kept"]
    assert got[9]["n_words"] == 20_000 and got[9]["kept"] and got[4]["n_words"] == 0 and got[11]["n_dup_lines"] == 1


def test_personal_data(spark):
    got = by_id(pii.personal_data(docs(spark)))
    row, text = got[10], dict(TEXTS)[10]
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    at = re.search(r"10\.0\.0\.1", text)
    assert f"ip:{at.start()}:{at.end()}" in row["spans"].split(",")
    assert got[4]["spans"] == "" and len(got) == len(TEXTS)


def test_mix(spark):
    got = by_id(mixing.mix(docs(spark)))
    assert len(got) == len(TEXTS) and all(r["taken"] <= 3 * r["size"] for r in got.values()) and got[4]["size"] == 0
    assert [r for r in got.values()] and by_id(mixing.mix(docs(spark))) == got


def test_token_counts(spark):
    want = {i: r["n_tokens"] for i, r in by_id(bpe.digests(bpe.encode_blocks(docs(spark), PATH, specials_are_text=True), PATH)).items()}
    folder = new_path(spark, "tokens")
    files, order = tokens.write(docs(spark), folder, PATH, 49407)
    got = tokens.scan(files, folder, 49407, block=1000).join(order, ["file", "at"])  # texts span blocks
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want


def test_toxicity_learns(spark):
    rows = [(i, f"some plain text number {i} " + ("you are a worthless idiot" if i % 4 == 0 else "have a nice day")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.scores(docs(spark, rows), labels).where("held_out").collect()
    assert got and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)


def test_nearest(spark):
    vec = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (100, [0.0, 1.0])]
    vectors = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors.where("vec_id % 100 = 0"), vectors).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 100), (100, 1), (100, 2), (100, 0)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\r\n", None), (9, "http://d", ""), (None, "e", "f")], "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    got = {r["page_id"]: r for r in warc.read(spark, folder, warc.write(pages, folder, roll_bytes=300)).collect()}
    assert {i: r["refers_to"] for i, r in got.items()} == {1: None, 2: 1, 3: None, 9: 3} and got[1]["payload_bytes"] == 8


@pytest.mark.parametrize("run", [lambda d: minhash.near_duplicates(d), lambda d: quality.verdicts(d), lambda d: pii.personal_data(d), lambda d: mixing.mix(d), lambda d: lines.dropped_lines(d), lambda d: bpe.encode(d, PATH)])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).count() == 0
