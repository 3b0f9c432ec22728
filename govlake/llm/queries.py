"""The registered queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, language_id, merkle, mixing, parity_join, spelling, substring_rlz, suffix_dedup, topk_search, toxicity, url_filter
from .common import LETTERS_LOW, LETTERS_UP, held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of op1: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND list_inner_product(v, v) > 0 AND isfinite(list_inner_product(v, v))),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id, vec_id AS o FROM e UNION SELECT r.vec_id, y FROM r JOIN l ON o = x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT r.vec_id, coalesce(max(n), 0) AS n_links, min(o) AS component_id, min(o) = r.vec_id AS kept FROM r LEFT JOIN n ON x = r.vec_id GROUP BY r.vec_id
"""


MIX_ROUNDS, MIX_FRACTION = 8, 0.5


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), rounds=MIX_ROUNDS, tolerance=-1.0, fraction=MIX_FRACTION)
    return out.select("doc_id", "n_tokens", F.round("probability", 7).alias("probability"), "kept")


def _mixing_sql() -> str:
    """The same raking with one window sum for each step, then the search for the scale, unrolled."""
    steps = [
        r"""rows AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
  coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'Licensed under') THEN 'licence'
       WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS topic FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS n FROM rows GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for key in ("source", "lang", "topic"):
        steps.append(f"aim_{key} AS (SELECT {key}, sqrt(sum(n)) / sum(sqrt(sum(n))) OVER () AS aim FROM cells GROUP BY {key})")
    steps.append("w0 AS (SELECT *, n AS w FROM cells JOIN aim_source s USING (source))".replace("*", "cells.*"))
    order = ["source", "lang", "source", "topic"] * MIX_ROUNDS + ["source"]
    for k, key in enumerate(order):
        steps.append(f"w{k + 1} AS (SELECT w{k}.source, w{k}.lang, w{k}.topic, n, w * aim / sum(w) OVER (PARTITION BY w{k}.{key}) AS w FROM w{k} JOIN aim_{key} USING ({key}))")
    steps.append(f"final AS MATERIALIZED (SELECT source, lang, topic, n, w / n AS weight FROM w{len(order)})")
    steps.append("s0 AS (SELECT CAST(0 AS DOUBLE) AS scale)")
    for k in range(15):
        steps.append(
            f"s{k + 1} AS MATERIALIZED (SELECT greatest(max(scale), coalesce(({MIX_FRACTION} * sum(n) - coalesce(sum(n) FILTER (weight * scale >= 1), 0)) / sum(n * weight) FILTER (weight * scale < 1), max(scale))) AS scale FROM final, s{k})"
        )
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, n AS n_tokens, round(p, 7) AS probability, n > 0 AND draw < p AS kept
FROM (SELECT doc_id, rows.n, least(1.0, coalesce(weight, 0) * scale) AS p,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 AS draw
      FROM rows LEFT JOIN final USING (source, lang, topic), s15)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    return language_id.classify(docs, model).withColumn("held_out", held_out())


def op5_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_rlz.digests(_table(spark, sf_dir, "documents")).drop("spans")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS win, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM dup)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.judge(docs, labels.where(~held_out())).withColumn("held_out", held_out())


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.components(_table(spark, sf_dir, "documents"), words=4, similarity=85)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS v FROM documents UNION SELECT r.doc_id, y FROM r JOIN l ON v = x)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(v) AS component_id FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents")).drop("spans")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM dup)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p <> before + 1 OR before IS NULL) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, p, substr(h, 2 * p - 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM runs))),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS kept FROM bytes ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes: for each byte eight steps of the polynomial."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(0, length({digits}) // 2), lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT))"
    one = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce({octets}, lambda c, x: {one}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: One run in 199 of op11 loses a letter.
SLIP_EVERY = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(_table(spark, sf_dir, "documents"))
    words = spelling.counted(runs.select(spelling.slipped(F.col("run"), F.col("id"), SLIP_EVERY).alias("word")))
    return spelling.variants(words)


#: The edit distance of DuckDB is one of bytes: letters of two bytes become capitals and signs that no word has.
_ONE_BYTE = "".join(map(chr, range(0xC0, 0x100))), (LETTERS_UP + "0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}~")[:64]
OP11_SQL = rf"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{LETTERS_UP}', '{LETTERS_LOW}'), '{spelling.RUN}')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS c FROM runs GROUP BY ALL),
h AS (SELECT run, c, {_crc32_sql("id || ':' || run")} AS h FROM c),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % {SLIP_EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
v AS (SELECT DISTINCT word, n, unnest(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)))) AS v FROM w),
p AS (SELECT DISTINCT a.word AS a, a.n AS n, b.word AS b, b.n AS m FROM v a JOIN v b ON a.v = b.v AND a.word <> b.word
      WHERE levenshtein(translate(a.word, '{_ONE_BYTE[0]}', '{_ONE_BYTE[1]}'), translate(b.word, '{_ONE_BYTE[0]}', '{_ONE_BYTE[1]}')) = 1),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY m DESC, b) AS b, max(m) AS m, first(n) AS n FROM p GROUP BY a),
f AS MATERIALIZED (SELECT word, CASE WHEN m >= 5 * best.n THEN b END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * best.n THEN m END AS form_n FROM w LEFT JOIN best ON a = word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word JOIN f AS e ON e.word = r.root WHERE e.form IS NULL
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    altered = F.translate("text", LETTERS_UP, LETTERS_LOW)
    tampered = merkle.leaf([altered if c == "text" else F.col(c) for c in merkle.FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    manifest = merkle.build(docs, carried={"tampered": F.when(hit & (F.col("text") != altered), F.unhex(tampered))})
    proofs = merkle.proofs(manifest, ["tampered"])
    shown = F.coalesce(F.lower(F.hex("tampered")), "leaf")
    out = proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(shown, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int = 8, over: int = 3) -> str:
    """Trees of up to 8 ** levels leaves and 8 ** over groups, level by level: runs are joined strings, which the node's place cuts."""
    shown = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(shown(text if c == "text" else c) for c in merkle.FIELDS) + ")"
    low = f"translate(text, '{LETTERS_UP}', '{LETTERS_LOW}')"
    steps = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS shown FROM documents)",
        "o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "t0 AS (SELECT lang, i, leaf AS h, n FROM o)",
    ]

    def climb(t: str, key: str, depth: int) -> None:
        for k in range(depth):
            steps.append(f"{t}r{k} AS MATERIALIZED (SELECT {key}, i // 8 AS run, string_agg(h, '' ORDER BY i) AS s, any_value(n) AS n FROM {t}{k} GROUP BY {key}, i // 8)")
            steps.append(f"{t}{k + 1} AS MATERIALIZED (SELECT {key}, run AS i, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h, (n + 7) // 8 AS n FROM {t}r{k})")

    climb("t", "lang", levels)
    steps.append(f"u0 AS MATERIALIZED (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM t{levels})")
    climb("u", "one", over)
    steps.append(f"p0 AS (SELECT o.*, shown AS now_, '' AS proof, u0.h AS subroot, u0.i AS g, u{over}.h AS root FROM o JOIN u0 ON o.lang IS NOT DISTINCT FROM u0.lang, u{over})")
    joins = [(f"tr{k}", "r.lang IS NOT DISTINCT FROM p.lang", f"p.i // {8**k}") for k in range(levels)] + [(f"ur{k}", "true", f"p.g // {8**k}") for k in range(over)]
    for k, (runs, same, place) in enumerate(joins):
        left, right = f"left(r.s, 64 * (({place}) % 8))", f"substr(r.s, 64 * (({place}) % 8) + 65)"
        steps.append(
            f"p{k + 1} AS (SELECT p.* REPLACE (CASE WHEN r.n > 1 THEN sha256({left} || now_ || {right}) ELSE now_ END AS now_, CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM p{k} p JOIN {runs} r ON {same} AND r.run = ({place}) // 8)"
        )
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now_ AS folded_root, now_ = root AS verified FROM p{len(joins)}"


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk_search.top_k(rows, rows.where("vec_id % 100 = 0"))


OP13_SQL = """
WITH e AS (SELECT vec_id, row_number() OVER () AS r, CAST(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 10
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_substring_rlz": op5_substring_rlz,
    "op6_toxicity": op6_toxicity,
    "op7_parity_join": op7_parity_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_topk_search": op13_topk_search,
}
ORACLES = {
    "op2_embedding_dedup": OP2_SQL,
    "op3_mixing": _mixing_sql(),
    "op5_substring_rlz": OP5_SQL,
    "op7_parity_join": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_merkle_manifest": _merkle_sql(),
    "op13_topk_search": OP13_SQL,
}
