"""The registered queries against plain Python on the smallest tables, and edge cases of every operator."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, lines, minhash, mixing, neighbours, pii, quality, queries, stages, tokens, toxicity, warc
from tessera.llm.common import new_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, word string, key string"


@pytest.fixture(scope="module")
def corpus():
    return {r.doc_id: r for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()}


def text_of(row):
    return row.text if isinstance(row.text, str) else ""


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "w", "k") for i, t, lang, s in rows], SCHEMA)


def statistics(text):
    words = WORD.findall(text)
    said = [x for x in text.split("\n") if WORD.search(x)]
    seen, at = Counter(), defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    dup = 0
    for x in said:
        dup += seen[x] > 0
        seen[x] += 1
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_op2_base_columns(spark, corpus):
    got = by_id(queries.op2_quality(spark, SF))
    assert got.keys() == corpus.keys()
    for i, row in corpus.items():
        r, (n, chars, symbols, dup, repeat) = got[i], statistics(text_of(row))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])


def test_covariances_reach_a_small_determinant(spark):
    rng = np.random.default_rng(5)
    clean = rng.normal(size=(300, 5)) @ np.triu(rng.normal(size=(5, 5)) + 2 * np.eye(5))
    rows = np.vstack([clean, 30 + rng.normal(size=(60, 5))])
    made = spark.createDataFrame([("g", *map(float, r)) for r in rows], "group string, f0 double, f1 double, f2 double, f3 double, f4 double")
    found = quality.covariances(made).first()
    ridge = np.diag(np.square(quality.FLOORS))
    inside = np.linalg.slogdet(np.cov(clean.T, bias=True) + ridge)[1]
    assert found["det"] < inside + 0.2 < np.linalg.slogdet(np.cov(rows.T, bias=True) + ridge)[1]
    assert all(abs(found[f"m{i}"]) < 2 * clean[:, i].std() for i in range(5))


def test_chi_squared_tail(spark):
    x = spark.range(1).select(quality.chi2_5_above(quality.F.lit(0.001)).alias("a"), quality.chi2_5_above(quality.F.lit(1e-6)).alias("b")).first()
    assert x["a"] == pytest.approx(20.515, abs=0.05) and x["b"] == pytest.approx(35.888, abs=0.01)


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text) if kind != "email" or "@" in text else ():
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15}[kind]():
                yield kind, m.start(), m.end()


def test_op4_base_spans_and_planted_secrets(spark):
    larger = SF.replace("0.001", "0.01")
    corpus = {r.doc_id: r for r in pd.read_parquet(f"{larger}/documents.parquet").itertuples()}
    got = by_id(queries.op4_pii(spark, larger))
    assert got.keys() == corpus.keys()
    planted = 0
    for i, row in corpus.items():
        text, r = text_of(row), got[i]
        if len(text) > 10_000:
            continue  # the plain pattern for mail takes quadratic time
        want = list(base_spans(text))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in want) for k in pii.BASE]
        found = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in want} <= set(found)
        for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text):
            planted += 1
            assert ("secret", str(m.start(1)), str(m.end(1))) in found
    assert planted


def test_op4_classifier_overrules_the_regex_labeler(spark):
    rows = [(i, f'login with password = "{hashlib.sha1(str(i).encode()).hexdigest()}" today', "en", "s") for i in range(60)]
    rows += [(100 + i, f'set password = "changeme_example_{i}x" first', "en", "s") for i in range(30)] + [(200 + i, f"see commit {hashlib.sha1(str(i).encode()).hexdigest()} for it", "en", "s") for i in range(60)]
    got = {r["doc_id"]: r for r in pii.judged(table(spark, rows)).where("kind = 'secret'").collect()}
    assert all(got[i]["p"] >= 0.5 for i in range(60)) and all(got[200 + i]["p"] < 0.5 for i in range(60))
    assert all(got[100 + i]["regex"] == 1 and got[100 + i]["p"] < 0.5 for i in range(30))  # the regex labeler says yes
    late = [(1, "ring (212) 555-0199 or phone 212-555-0188 now", "en", "s"), (2, "my ssn is 219-09-9999, iban GB82 WEST 1234 5698 7654 32", "en", "s")]
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(table(spark, rows + [(1000 + i, t, a, b) for i, t, a, b in late])).collect()}
    assert "ssn:" in spans[1002] and "iban:" in spans[1002]


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            having[x].add(i)
    for a, b in {p for ids in having.values() for p in itertools.combinations(sorted(ids), 2)}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in sets}


def test_op6_components(spark, corpus):
    sets = {i: shingles(text_of(r)) for i, r in corpus.items()}
    want, got = components(sets), by_id(queries.op6_near_duplicates(spark, SF))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_op6_similar_but_unlinked_texts_go_through_the_second_tables(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]

    def changed(words, k):
        words = list(words)
        for p in rng.choice(len(words), k, replace=False):
            words[p] = f"x{rng.integers(1 << 30)}"
        return words

    texts = {i: " ".join(changed(base, 9)) for i in range(40)}
    texts |= {100 + i: " ".join(changed(texts[i].split(), 3)) for i in range(20)}
    want = components({i: shingles(t) for i, t in texts.items()})
    assert len(set(want.values())) > 5
    got = by_id(minhash.near_duplicates(table(spark, [(i, t, "en", "s") for i, t in texts.items()])))
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_op6_repeated_ids_do_not_depend_on_the_order_of_rows(spark):
    b = " ".join(f"w{i}" for i in range(60))
    rows = [(1, b, "en", "s"), (3, b.replace("w7 ", "o "), "en", "s"), (3, " ".join(f"z{i}" for i in range(70)), "en", "s")]
    results = [{r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, p)).collect()} for p in itertools.permutations(rows)]
    assert all(r == results[0] for r in results)


def test_op7_round_trip(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    first, want = {}, {}
    for p in pages.sort_values("page_id").itertuples():
        body = (p.html if isinstance(p.html, str) else "").encode()
        of = first.setdefault(body, p.page_id)
        want[p.page_id] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if of == p.page_id else "revisit", None if of == p.page_id else of)
    got = by_id(queries.op7_warc(spark, SF), "page_id")
    assert {i: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for i, r in got.items()} == want
    folders = [new_path(spark, "warc") for _ in range(2)]
    manifests = [sorted(map(tuple, warc.write(queries.table(spark, SF, "pages").repartition(n), f).collect())) for n, f in zip((1, 7), folders, strict=True)]
    assert manifests[0] == manifests[1]


def test_op8_held_out_and_fold(spark, corpus):
    got = by_id(queries.op8_toxicity(spark, SF))
    assert got.keys() == corpus.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())


def test_op8_weights_against_plain_ftrl():
    """Indices and weights of the fit, and scores from them, against the update written out entry by entry."""
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(30)], 12)) + (" nasty vile" if i % 3 == 0 else "") for i in range(240)]
    labels = np.array([float(i % 3 == 0) for i in range(240)])
    with np.errstate(over="ignore"):
        sets = toxicity.feature_sets([t.encode() for t in texts])
    z, n = defaultdict(float), defaultdict(float)
    bias = 1 << toxicity.BITS

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for s, y in zip(sets, labels, strict=True):
            features = [*map(int, s), bias]
            w = [weight(i) for i in features]
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w))))) - y
            for i, wi in zip(features, w, strict=True):
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * wi
                n[i] += g * g
    index, value = toxicity.fit_ftrl(sets, labels)
    want = {i: weight(i) for i in z if weight(i) != 0}
    assert dict(zip(index.tolist(), value.tolist(), strict=True)) == pytest.approx(want) and len(want) > 1
    scores = [sum(want.get(int(i), 0.0) for i in s) + want.get(bias, 0.0) for s in sets]
    assert all((x > 0) == (y == 1) for x, y in zip(scores, labels, strict=True))


def test_op9_targets_and_taken(spark, corpus):
    rows = [(i, text_of(r), r.source if isinstance(r.source, str) else None) for i, r in corpus.items()]
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += len(WORD.findall(t))
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, open_, left, target = {s: 1 + k % 3 for k, s in enumerate(order)}, set(order), float(sum(total.values())), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= over
    got = mixing.mix(queries.table(spark, SF, "documents")).collect()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(rows)
    for s in order:
        sizes = sorted(len(WORD.findall(t)) for _, t, x in rows if x == s)
        part = target[s] / total[s] % 1  # what may be moved of each document
        settled = min(part, 1 - part) * (total[s] - sizes[-1]) >= sizes[-1]  # the others outweigh the largest
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], next(n for n in sizes if n)) if settled else largest[s] / 2 + 1


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op9_targets_are_met(spark, sf):
    """Within 1 % of every target, but where one document has more words than all others of its source can move."""
    docs = queries.table(spark, f"/root/testdata/{sf}", "documents")
    per = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("words"), F.max("size").alias("most"))
    free = 0
    for r in per.collect():
        part = r["target"] / r["words"] % 1
        if min(part, 1 - part) * (r["words"] - r["most"]) >= r["most"]:
            free += 1
            assert abs(r["taken"] / r["target"] - 1) < 0.01, r
    assert free > 5


def test_pooled_rounding_keeps_words_and_leaves_a_small_rest():
    rng = np.random.default_rng(1)
    hits = np.zeros(60)
    for k in range(400):
        size = np.sort(rng.permutation(np.arange(1, 61)))[::-1] ** 2 if k % 2 else np.arange(60, 0, -1)
        share = np.full(60, 0.3)
        out = mixing.pooled(share, size, np.random.default_rng(k).random(60))
        left = np.flatnonzero((out > 1e-9) & (out < 1 - 1e-9))
        assert (out * size).sum() == pytest.approx((share * size).sum()) and len(left) <= 1 and all(size[i] <= size.sum() / 25 for i in left)
        hits += out
    assert np.abs(hits / 400 - 0.3).max() < 0.1  # every expected share stays
    big = mixing.pooled(np.full(3, 0.5), np.array([1000, 3, 2]), np.array([0.9, 0.5, 0.5]))
    assert 0.49 < big[0] < 0.51 and set(big[1:]) <= {0.0, 1.0}


def test_op9_a_source_that_looks_like_null_stays_apart(spark):
    rows = [(i, "a b c " * (i + 1), "en", None if i % 2 else "\x00null") for i in range(8)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == 8 and {r["source"]: r["source_size"] for r in got} == {None: 3 * (2 + 4 + 6 + 8), "\x00null": 3 * (1 + 3 + 5 + 7)}


def test_pivot_keeps_words():
    rng = np.random.default_rng(1)
    share, size = rng.random(500), rng.integers(0, 300, 500)
    out = mixing.pivot(share, size, rng.random(500))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2 and (out * size).sum() == pytest.approx((share * size).sum())


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def dropped(docs):
    earlier, out = [], defaultdict(set)
    for i, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                if any(near(line, x) for x in earlier):
                    out[i].add(k)
                earlier.append(line)
    return dict(out)


def test_op10_brute_force(spark):
    rng = np.random.default_rng(7)
    words = ["alpha", "beta", "gamma", "delta", "a", "b", "an"]
    made = []
    for i in range(40):
        some = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(6)]
        made.append((i, "\n".join(x[:p] + rng.choice(["", "x"]) + x[p + 1 :] if rng.random() < 0.3 else x for x, p in ((x, int(rng.integers(0, len(x)))) for x in some))))
    got = {r["doc_id"]: set(r["exact"]) | set(r["near"]) for r in lines.dropped_lines(table(spark, [(i, t, "en", "s") for i, t in made])).collect()}
    assert got == dropped(made)


def test_op1_large_and_small_components(spark):
    vec = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [-1e200, 3.0]), (3, [1e308, 1e308]), (100, [1e-200, 0.0]), (5, [2e-200, 0.0]), (6, [1.0, 0.0])]
    vectors = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(vectors.where("vec_id % 100 = 0"), vectors).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    of = dict(vec)
    far = lambda a, b: math.hypot(*(x - y for x, y in zip(of[a], of[b], strict=True)))
    assert got == {q: sorted((c for c in of if c != q), key=lambda c: (far(q, c), c)) for q in (0, 100)}


def test_op3_counts_against_the_tokenizer(spark, corpus):
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, SF).collect()}
    assert got == {i: len(made.encode(text_of(r), add_special_tokens=False).ids) for i, r in corpus.items()}
    assert tokens.width(PATH, 49407) == "<u2" and tokens.width(PATH, 1 << 16) == "<u4"


def test_op5_against_the_tokenizer(spark, corpus):
    made = Tokenizer.from_file(PATH)
    for i, r in by_id(queries.op5_bpe(spark, SF)).items():
        ids = made.encode(text_of(corpus[i]), add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest()


EMPTY = SimpleNamespace(
    op1=lambda s, d, f: neighbours.nearest(*[s.createDataFrame([], "vec_id long, embedding array<double>")] * 2), op3=lambda s, d, f: tokens.counts(d, s, f, PATH, 49407),
    op7=lambda s, d, f: warc.read(s, f, warc.write(s.createDataFrame([], "page_id long, url string, html string"), f)), op8=lambda s, d, f: toxicity.scores(d, s.createDataFrame([], "doc_id long, toxic int")),
)


@pytest.mark.parametrize("name", sorted(vars(EMPTY)))
def test_empty_tables(spark, name):
    assert getattr(EMPTY, name)(spark, table(spark, []), new_path(spark, "empty")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_and_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, table(spark, []), "").count() == 0
    odd = table(spark, [(1, None, None, None), (2, "", "en", "s"), (2, "one two three", "en", "s"), (3, "\t\n \n", None, "s"), (None, "no id", "en", "s"), (4, "é \U0001f600 " * 30, "", "")])
    got = stage(spark, odd, "")
    assert name == "tokens" or got.columns == odd.columns
    assert {r["doc_id"] for r in got.collect()} <= {1, 2, 3, 4, None}


def test_stage_quality_and_lines_against_their_operators(spark, corpus):
    docs = queries.table(spark, SF, "documents")
    kept = {i for i, r in by_id(queries.op2_quality(spark, SF)).items() if r["kept"]}
    assert {r["doc_id"] for r in stages.quality_rules(spark, docs, SF).collect()} == kept
    some = [(i, text_of(r)) for i, r in corpus.items() if len(text_of(r)) < 600]
    want = dropped(some)
    left = {r["doc_id"]: r["text"] for r in stages.line_dedup(spark, table(spark, [(i, t, "en", "s") for i, t in some]), "").collect()}
    assert left == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())) for i, t in some}
