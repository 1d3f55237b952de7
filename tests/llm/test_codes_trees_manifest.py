"""Vector codes, the quality classifier and the Merkle manifest against plain Python, their SQL, and held-out labels."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.llm import boosting, codes, merkle, queries

SF = "/root/testdata/sf0.001"


def twin(name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(queries.oracle_sql()[name]).fetchdf()


def same(got, want, key):
    got, want = (x.sort_values(key).reset_index(drop=True)[sorted(x.columns)] for x in (got, want))
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert (got[c] == want[c]).all(), c


# ---- vector codes


def coded(vectors, rounds=codes.ROUNDS):
    """Codes, errors and codebooks of a list of (id, components), all of one dimension, by loops over Python's whole numbers."""
    parts = {i: [] for i, _ in vectors}
    for i, v in vectors:
        whole = [math.floor(x * 4096) if abs(x) < 2**40 else int(x) * 4096 for x in v]
        whole += [0] * (-len(whole) % 8)
        each = len(whole) // 8
        parts[i] = [whole[p * each : (p + 1) * each] for p in range(8)]
    ids = sorted(parts)
    books = [[parts[i][p] for i in ids[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            mine = [near(parts[i][p], book)[1] for i in ids]
            groups = [[parts[i][p] for i, m in zip(ids, mine, strict=True) if m == k] for k in range(len(book))]
            new.append([[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(groups, book, strict=True)])
        books = new
    found = {i: [near(parts[i][p], books[p]) for p in range(8)] for i in ids}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in f), min(sum(d for d, _ in f), 2**63 - 1), sha) for i, f in found.items()}


def test_codes_equal_their_sql(spark):
    same(queries.op11_codes(spark, SF).toPandas(), twin("op11_codes"), "vec_id")


@pytest.mark.parametrize("width,scale", [(16, 1.0), (8, 1e-3), (12, 1.0), (8, 1e30), (16, 1e307)])
def test_codes_against_loops(spark, width, scale):
    rng = np.random.default_rng(3)
    made = [(i, [float(x) for x in rng.normal(size=width) * scale]) for i in range(60)] + [(i, [float(x) for x in np.repeat(rng.integers(-1, 2, 2), width // 2)]) for i in range(60, 90)]
    vectors = spark.createDataFrame([(i, v, i % 3 or None) for i, v in made], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in codes.encode(vectors).collect()}
    want = coded(made)
    assert {i: (r["code"], r["error"], r["codebooks_sha256"]) for i, r in got.items()} == want
    for label in (None, 1, 2):
        total = min(sum(want[i][1] for i in got if got[i]["label"] == label), 2**63 - 1)
        assert {r["label_error"] for r in got.values() if r["label"] == label} == {total}


def test_equal_average_search_is_exact_and_takes_the_first_of_ties():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-9, 9, (400, 3)), rng.integers(-9, 9, (16, 3))
    book[7] = book[2]
    far = ((x[:, None] - book) ** 2).sum(axis=2)
    at, best = codes.nearest_entries(x, book)
    assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string, code int"
    assert codes.encode(spark.createDataFrame([], schema)).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8, "a", 0), (1, [0.5] * 8, "a", 0), (2, None, "a", 0), (3, [nan] * 8, None, 0), (4, [inf] + [0.0] * 7, None, 0), (5, [None] + [0.0] * 7, None, 0), (None, [0.0] * 8, None, 0), (6, [], None, 0), (7, [-0.25, 1.0, 3.0], "null", 0)]
    got = codes.encode(spark.createDataFrame(rows, schema)).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["error"], r["label"], r["label_error"]) for r in got] == [(1, 0, "a", 0), (1, 0, "a", 0), (6, 0, None, 0), (7, 0, "null", 0)]
    assert got[0]["code"] == "00" * 8 and len({r["codebooks_sha256"] for r in got}) == 3


# ---- quality classifier


def test_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    trees = boosting.fit(x, y)

    def walk(row):
        total = trees.start
        for feature, edge, value in zip(trees.feature, trees.edge, trees.value, strict=True):
            i = 0
            for _ in range(boosting.DEPTH):
                i = 2 * i + 1 + (row[feature[i]] > edge[i])
            total += value[i]
        return total

    fresh = rng.normal(size=(200, 5))
    assert np.allclose(trees.margins(fresh), [walk(r) for r in fresh])
    assert (((trees.scores(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 3] > -0.2))).mean()) > 0.95


def test_first_split_gains_most():
    """The root of the first tree splits where a scan over all columns and edges gains most."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=300) > 6).astype(float)
    trees = boosting.fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    best = (-1.0, 0, 0.0)
    for f in range(3):
        for e in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= e
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + boosting.RIDGE)  # noqa: B023, E731
            if min(h[left].sum(), h[~left].sum()) >= boosting.LEAST_HESSIAN:
                best = max(best, (part(left) + part(~left) - part(left | True), -f, -e))
    assert (trees.feature[0, 0], trees.edge[0, 0]) == (-best[1], -best[2])


def test_statistics_by_hand():
    at = dict(zip(boosting.FEATURES, boosting.statistics([b"One one TWO ###\n\nOne one TWO ###\nx1!"])[0].tolist(), strict=True))
    assert at["log_words"] == pytest.approx(math.log1p(9)) and at["word_length"] == pytest.approx((3 * 6 + 3 + 3 + 3) / 9)
    assert at["distinct_words"] == pytest.approx(4 / 9) and at["top_word"] == pytest.approx(4 / 9) and at["upper_words"] == pytest.approx(2 / 9)
    assert at["odd_words"] == pytest.approx(2 / 9) and at["distinct_lines"] == pytest.approx(2 / 3) and at["repeated_words"] == 0
    assert boosting.statistics([b"", b" \n"]).shape == (2, len(boosting.FEATURES)) and boosting.statistics([b" ".join([b"w%d" % (i % 8) for i in range(24)])])[0][boosting.FEATURES.index("repeated_words")] == pytest.approx(1 - 8 / 17)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op12_quality_classifier(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(r.quality, got[r.doc_id]["predicted"]) for r in pd.read_parquet(f"{sf}/labels.parquet").itertuples() if got[r.doc_id]["held_out"]]
    good, bad = [p for q, p in held if q], [p for q, p in held if not q]
    assert len(good) > 40 and sum(good) == len(good) and sum(bad) <= 0.2 * len(bad)
    again = queries.op12_quality_classifier(spark, sf)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {i: r["score"] for i, r in got.items()}


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    want = {r["doc_id"]: r["score"] for r in boosting.scores(docs, labels).collect()}
    changed = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "0 as toxic")
    other = docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source", "3 as score", "array(1.0) as x")
    assert {r["doc_id"]: r["score"] for r in boosting.scores(other, changed).collect()} == want


def test_classifier_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "a b"), (3, "word " * 20000), (None, "no id")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r["doc_id"], r["score"]) for r in boosting.scores(docs, none).orderBy("doc_id").collect()] == [(1, 0.5), (2, 0.5), (2, 0.5), (3, 0.5)]
    some = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (9, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert boosting.scores(docs, some).where("score between 0 and 1").count() == 4
    assert boosting.scores(docs.limit(0), some).count() == 0


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    count = None if row["n_chars"] is None else row["n_chars"] + more
    return sha(said(row["doc_id"]) + said(row["source"]) + said(row["lang"]) + said(count) + said(row["text"]))


def tree(nodes):
    """All levels, from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def climbed(digest, levels, i):
    others = []
    for level in levels[:-1]:
        run = level[i - i % 2 : i - i % 2 + 2]
        others += [x for k, x in enumerate(run) if k != i % 2]
        run[i % 2] = digest
        digest, i = sha("".join(run)), i // 2
    return digest, others


def manifest_of(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, placed = [], []
    for k, lang in enumerate(langs):
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append(tree([leaf_of(r) for r in mine]))
        placed += [(r, k, i) for i, r in enumerate(mine)]
    top = tree([t[-1][0] for t in trees])
    out = []
    for r, k, i in placed:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        a, first = climbed(leaf_of(r, int(bad)), trees[k], i)
        b, second = climbed(a, top, k)
        out.append((r["doc_id"], leaf_of(r), trees[k][-1][0], top[-1][0], sha("".join(first + second)), b, b == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_equals_its_sql(spark):
    same(queries.op13_manifest(spark, SF).toPandas(), twin("op13_manifest"), "doc_id")


@pytest.mark.parametrize("levels", [1, 2, 11])
def test_manifest_against_loops(spark, levels):
    """Small slot arrays make many tiers; ids are far apart, negative, repeated and null, and reach both ends of a word."""
    ids = [*range(60, 70), 0, 1, 63, 127, -1, -64, -65, 2**40, 2**62, -(2**63), 2**63 - 1, 7, 7, 7, 7, None, None]
    rows = [{"doc_id": d, "source": "s" if k % 3 else None, "lang": lang, "n_chars": k if k % 5 else None, "text": f"é{k % 4}" if k % 7 else None, "part": 1, "grp": "g"} for lang in ("en", None, "é", "", "z") for k, d in enumerate(ids if lang != "z" else [5])]
    rows += [dict(rows[21])] * 3  # equal rows
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, part int, grp string").repartition(3)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest(docs, levels).collect()), key=str)
    assert got == manifest_of(rows)


def test_manifest_of_no_rows_and_of_one_group(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = docs.where("lang = 'en'").orderBy("doc_id").limit(3)
    got = merkle.manifest(one).collect()
    assert len(got) == 3 and all(r["subroot"] == r["root"] for r in got)


def test_one_repeated_id_is_spread(spark):
    """A third of the rows have one id, in equal and in different texts."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 11, id) as doc_id", "'s' as source", "'en' as lang", "cast(1 as int) as n_chars", "if(id % 2 = 0, 'same', cast(id as string)) as text")
    rows = [r.asDict() for r in docs.collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest(docs).collect()), key=str) == manifest_of(rows)
