"""The word and token steps of op5_bpe work on Arrow arrays: the same words, ids and digests as word by word."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\t\n", "a, b.", " a,  b. ", "a,b x., y.. z., 1, 2.", "q.\x0bw,\x0ce,\rr.\x1ct,\x85u", "nul\x00, \x00.", "é, è.  x,  y", "é, ́x .", "a,", ",", ". , a.", "A.\nB,\n"]


def test_words_of_many_texts_are_those_of_each():
    texts = [*(t.encode() for t in ODD), b"cut \xe4\xb8, \xff. \xc3", b"x" * 70_000 + b", y"]
    for some in (texts, texts[3:9], []):
        words, lengths = bpe.split_words(pa.array(texts, pa.binary()).slice(3, 6) if len(some) == 6 else pa.array(some, pa.binary()))
        assert words.view(pa.binary()).to_pylist() == [w for t in some for w in bpe.words_of(t)]
        assert lengths.tolist() == [len(bpe.words_of(t)) for t in some]


@pytest.mark.parametrize("specials_are_text", [False, True])
def test_words_encoded_together_are_those_encoded_alone(specials_are_text):
    odd = ["|", "a|b", "||", "|x", "｜", "<|endoftext|>", "a<|endoftext|>b", " ", "́x", "İ", "can't", "'s", "…", "\U0001f600|"]
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = specials_are_text
    plain = [f"word{i}tion" for i in range(300)]
    for words in (plain, [*plain[:70], *odd, *plain[70:]], odd, ["|"], ["x"] * bpe.TOGETHER + ["|"], []):
        want = [made.encode(w, add_special_tokens=False).ids for w in words]
        assert [memoryview(b).cast("I").tolist() for b in bpe.encode_words([w.encode() for w in words], PATH, specials_are_text)] == want


def test_runs_have_their_bytes_across_batches():
    sizes = [0, 3, 5, 0, 9, 1, 1, 1, 0, 4, 0]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([b"x" * n for n in sizes], pa.binary())], ["i", "text"])
    for step in (1, 2, 4, 11):
        got = [r.column(0).to_pylist() for r in bpe._runs((rows.slice(i, step) for i in range(0, len(sizes), step)), 6)]
        assert got == [[0, 1, 2], [3, 4], [5, 6, 7, 8, 9], [10]]


@pytest.mark.parametrize("most", [0, 3, 1 << 18])
def test_small_blocks_and_a_full_counter(spark, monkeypatch, most):
    for name, value in (("BLOCK_BYTES", 300), ("COUNTED_BYTES", 100), ("MOST_COUNTED", 5), ("BUCKET_BYTES", 64)):
        monkeypatch.setattr(bpe, name, value)
    rows = [(i, t) for i, t in enumerate([*ODD, None, *(f"rare{i} word, the | a|b{i % 7} end. " * (1 + i % 5) for i in range(120))])]
    docs = spark.createDataFrame([*rows, rows[-1], (None, "no id")], "doc_id long, text string").repartition(3)
    made = Tokenizer.from_file(PATH)
    want = {i: made.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    encoded = bpe.encode_blocks(docs, PATH, most_words=most, least_seen=1)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = {i: made.decode(x, skip_special_tokens=False) for i, x in want.items()}
    got = bpe.digests(encoded, PATH).collect()
    assert len(got) == len(rows) + 1
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(x := want[r["doc_id"]]), sha(" ".join(map(str, x))), sha(text[r["doc_id"]])) for r in got)
    assert {r["doc_id"]: (r["ids"], r["text"]) for r in bpe.decode(encoded, PATH).collect()} == {i: (x, text[i]) for i, x in want.items()}
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs, PATH, most_words=most, least_seen=1).collect()} == want


def test_no_expression_runs_for_each_token(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    plan = bpe.digests(bpe.encode_blocks(docs, PATH), PATH)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan and "__pieces" in plan  # ids meet the table of pieces
    assert not [x for x in ("array_join", "sha2(", "lambda i#") if x in plan]
