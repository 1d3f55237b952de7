"""The registered queries of the corpus operators: each applies one to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import boosting, bpe, codes, lines, merkle, minhash, mixing, neighbours, pii, quality, tokens, toxicity, warc
from tessera.llm.common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100; candidates: all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "cutoff")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; see /opt/tokenizers/README.md."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    return tokens.counts(table(spark, sf_dir, "documents"), spark, folder, vocabulary("word_bpe_49k.json"), 49407).drop("ordinal")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    return bpe.digests(bpe.encode_blocks(table(spark, sf_dir, "documents"), path), path)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, manifest).drop("url")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of lines dropped and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dropped = lines.dropped_lines(docs)
    left = lines.without_lines(docs, dropped).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    counts = dropped.select("doc_id", F.size("exact").alias("n_exact"), F.size("near").alias("n_near"))
    return left.join(counts, "doc_id", "left").na.fill(0, ["n_exact", "n_near"])


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_nearest": op1_nearest, "op2_quality": op2_quality, "op3_token_counts": op3_token_counts, "op4_pii": op4_pii, "op5_bpe": op5_bpe, "op6_near_duplicates": op6_near_duplicates, "op7_warc": op7_warc, "op8_toxicity": op8_toxicity, "op9_mix": op9_mix, "op10_lines": op10_lines, "op11_codes": op11_codes, "op12_quality_classifier": op12_quality_classifier, "op13_manifest": op13_manifest}


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """Each round assigns and averages in a table of its own."""
    assign = lambda c: f"""(SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
          SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN {c} c USING (part, place) GROUP BY ALL) GROUP BY ALL)"""  # noqa: E731
    steps = "".join(f""",
        a{r} AS MATERIALIZED {assign(f"c{r - 1}")},
        c{r} AS MATERIALIZED (SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, c.v)::BIGINT AS v FROM c{r - 1} c
          LEFT JOIN (SELECT part, entry, place, sum(x.v)::BIGINT AS s, count(*)::BIGINT AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL) USING (part, entry, place))""" for r in range(1, rounds + 1))
    return f"""WITH e AS (SELECT vec_id, label, embedding, len(embedding) // 8 AS each FROM embeddings WHERE embedding IS NOT NULL),
        u AS (SELECT vec_id, label, each, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM e),
        k AS (SELECT vec_id FROM u GROUP BY 1 HAVING count(*) = count(x) AND bool_and(isfinite(x))),
        x AS MATERIALIZED (SELECT vec_id, label, i // each AS part, i % each AS place, floor(4096 * x)::BIGINT AS v FROM u WHERE vec_id IN (SELECT vec_id FROM k)),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 16),
        c0 AS MATERIALIZED (SELECT part, entry, place, v FROM x JOIN s USING (vec_id)){steps},
        z AS {assign(f"c{rounds}")},
        h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{rounds}),
        f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY 1)
        SELECT vec_id, code, error, label, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM f JOIN (SELECT vec_id, label FROM e) USING (vec_id), h"""


#: The checksum of an id comes bit by bit (3988292384 is the fixed polynomial of crc32); levels, paths and folds are recursive.
_MANIFEST_SQL = """WITH RECURSIVE h AS (SELECT *, row_number() OVER () AS row FROM documents),
  d AS (SELECT row, doc_id, lang, n_chars,
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
      CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g FROM h),
  crc AS (SELECT row, doc_id::VARCHAR AS s, 1 AS i, 0 AS bit, xor(4294967295::BIGINT, ascii(doc_id::VARCHAR)::BIGINT) AS c FROM d WHERE doc_id IS NOT NULL
    UNION ALL SELECT row, s, CASE WHEN bit = 7 THEN i + 1 ELSE i END, (bit + 1) % 8,
      xor(xor(c >> 1, (c & 1) * 3988292384), CASE WHEN bit = 7 AND i < length(s) THEN ascii(substr(s, i + 1, 1))::BIGINT ELSE 0 END) FROM crc WHERE i <= length(s)),
  t AS (SELECT row FROM crc WHERE i > length(s) AND xor(c, 4294967295) % 7 = 0),
  lv AS (SELECT row, doc_id, g, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
      CASE WHEN row IN (FROM t) AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS shown FROM d),
  l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM lv),
  a AS (SELECT 0 AS level, g, pos, leaf AS hash, count(*) OVER (PARTITION BY g) AS n FROM l
    UNION ALL SELECT level + 1, g, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (min(n) + 1) // 2 FROM a WHERE n > 1 GROUP BY level, g, pos // 2),
  sub AS MATERIALIZED (SELECT g, hash AS subroot, level AS top, row_number() OVER (ORDER BY g) - 1 AS place FROM a WHERE n = 1),
  b AS (SELECT 0 AS level, place AS pos, subroot AS hash, count(*) OVER () AS n FROM sub
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (min(n) + 1) // 2 FROM b WHERE n > 1 GROUP BY level, pos // 2),
  r AS (SELECT hash AS root FROM b WHERE n = 1),
  steps AS (SELECT l.row, a.level AS step, a.pos % 2 AS side, s.hash FROM l JOIN a ON a.g = l.g AND a.n > 1 AND a.pos = l.pos // (1 << a.level)
      LEFT JOIN a s ON s.g = a.g AND s.level = a.level AND s.pos = xor(a.pos, 1)
    UNION ALL SELECT l.row, sub.top + b.level, b.pos % 2, s.hash FROM l JOIN sub USING (g) JOIN b ON b.n > 1 AND b.pos = sub.place // (1 << b.level)
      LEFT JOIN b s ON s.level = b.level AND s.pos = xor(b.pos, 1)),
  f AS (SELECT row, 0 AS step, coalesce(shown, leaf) AS x FROM l
    UNION ALL SELECT f.row, f.step + 1, sha256(CASE WHEN hash IS NULL THEN x WHEN side = 1 THEN hash || x ELSE x || hash END) FROM f JOIN steps USING (row, step)),
  e AS (SELECT row, arg_max(x, step) AS folded_root FROM f GROUP BY 1),
  p AS (SELECT row, sha256(coalesce(string_agg(hash, '' ORDER BY step), '')) AS proof_sha256 FROM (SELECT l.row, step, hash FROM l LEFT JOIN steps USING (row)) GROUP BY 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM l JOIN sub USING (g) JOIN e USING (row) JOIN p USING (row), r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest": """
            WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, e -> e IS NULL OR isnan(e) OR isinf(e))) = 0
                         AND len(list_filter(embedding, e -> e <> 0)) > 0),
            d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.x, c.x) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
            SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
        "op11_codes": _codes_sql(),
        "op13_manifest": _MANIFEST_SQL,
    }
