"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

from ridgeline.llm.exact_dedup import exact_dedup
from ridgeline.llm.minhash import near_dedup
from ridgeline.llm.packing import pack
from ridgeline.llm.language_id import identify
from ridgeline.llm.quality import classify
from ridgeline.llm.ppm import score_corpus
from ridgeline.llm.forest import nearest
from ridgeline.llm.suffix_dedup import remove_repeats
from ridgeline.llm.piece_bpe import encode
from ridgeline.llm.token_counts import TokenTrees, sample_edits
from ridgeline.llm.vector_codes import label_errors, lloyd_codes
from ridgeline.llm.periodic_runs import looped, periodic_runs, strongest
from ridgeline.llm.impact_search import top_products
from ridgeline.llm.shared import held_out, scan


def op1_forest_search(spark, sf_dir):
    return nearest(scan(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_best_fit_packing(spark, sf_dir):
    return pack(scan(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(scan(spark, sf_dir, "documents"))


def op4_sentencepiece_dropout(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode(scan(spark, sf_dir, "documents"), model, dropout=0.1, seed=17, digest=True, variants=None)


def op5_ppm_score(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents")
    return score_corpus(docs, held_out(F.col("doc_id"), 5))


def op6_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(scan(spark, sf_dir, "documents")).drop("kept_text")


def op7_quality_classifier(spark, sf_dir):
    return classify(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup(scan(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents")
    return identify(docs, held_out(F.col("doc_id"), 3))


def op10_edit_token_counts(spark, sf_dir):
    trees = TokenTrees.build(scan(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return trees.edit(sample_edits(F.col("doc_id"), F.col("chars")[1])).drop("row")


def op11_lloyd_codes(spark, sf_dir):
    codes, books = lloyd_codes(scan(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return label_errors(codes).select("vec_id", digits.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_periodic_runs(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_impact_search(spark, sf_dir):
    return top_products(scan(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def queries():
    return {
        "op1_forest_search": op1_forest_search,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_sentencepiece_dropout": op4_sentencepiece_dropout,
        "op5_ppm_score": op5_ppm_score,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_language_id": op9_language_id,
        "op10_edit_token_counts": op10_edit_token_counts,
        "op11_lloyd_codes": op11_lloyd_codes,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_impact_search": op13_impact_search,
    }


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""


#: Every 200-byte window of every text, on hexadecimal text since SQL cuts characters, not bytes.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS p FROM d)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
runs AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g
         FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT r, min(p) AS lo, max(p) + 200 AS hi FROM runs GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS b, hi - lo AS gone FROM spans),
cut AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept, max(b + gone) AS tail, sum(gone) AS gone, count(*) AS n FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) END AS x FROM t),
e AS (SELECT doc_id, md5_number(unnest(x)) AS k FROM s),
n AS (SELECT doc_id, len(x) AS n FROM s),
links AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM e p JOIN e q ON p.k = q.k AND p.doc_id <> q.doc_id GROUP BY ALL)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id
"""


#: The usable vectors as whole numbers; {scale} is filled in.
_INTEGERS = """
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding))"""

_ROUND = """
a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, far * 16 + entry) AS entry, min(far) AS far
                      FROM (SELECT vec_id, part, entry, list_sum(list_transform(range(1, len(y) + 1), lambda i: (y[i] - c[i]) * (y[i] - c[i]))) AS far FROM p JOIN b{r} USING (part))
                      GROUP BY ALL)"""
_UPDATE = """,
m{r} AS MATERIALIZED (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c
                      FROM (SELECT part, entry, i, sum(y[i]) AS s, count(*) AS n FROM a{r} JOIN p USING (vec_id, part), range(1, 1 + (SELECT max(len(y)) FROM p)) AS t(i) WHERE i <= len(y) GROUP BY ALL)
                      GROUP BY ALL),
b{q} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry)),"""


def _op11_sql(rounds: int = 6) -> str:
    steps = "".join(_ROUND.format(r=r) + (_UPDATE.format(r=r, q=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""WITH {_INTEGERS.format(scale=4096)},
p AS MATERIALIZED (SELECT vec_id, k AS part, x[k * (len(x) // 8) + 1 : (k + 1) * (len(x) // 8)] AS y FROM v, range(8) AS t(k)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS c FROM p QUALIFY entry < 16),
{steps},
e AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e JOIN v USING (vec_id), books"""


OP13_SQL = f"""WITH {_INTEGERS.format(scale=256)},
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i])) AS score FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql():
    return {"op3_exact_dedup": OP3_SQL, "op6_suffix_array_dedup": OP6_SQL, "op8_minhash_near_dedup": OP8_SQL, "op11_lloyd_codes": _op11_sql(), "op13_impact_search": OP13_SQL}
