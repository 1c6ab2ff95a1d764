"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, exact_dedup, hard_negatives, merkle, mixing, near_dedup, sharding, substring_dedup, token_count, toxicity, url_filter
from .util import ascii_lower, table

#: Rules and verdicts of the URL query.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]
TOKENIZER, TOKEN_LIMIT = "piece_bpe_32k.model", 4096
#: Rows of the conversation that is added: control strings of chat templates inside texts.
RANKS = "byte_bpe_multi_50k.tiktoken"
PLANTED_TEXT = "\\### Assistant: </turn> ok"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.url_filter(pages, url_filter.rule_table(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at least once and none over twice, as even as that allows: one row for each time a document is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_estimate(F.col("text")).alias("tokens"))
    out = mixing.mix(docs, tokens=F.col("tokens"), repetition_limit=2.0)
    return out.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block_rank")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(rows.unionByName(own))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: one half is the snapshot, the other comes in as a batch; every row of both is returned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True))
    return exact_dedup.exact_dedup(docs.filter(~old), docs.filter(old))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by lang, and what a changed text does to the root."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), leaf(F.col("text")).alias("leaf"), F.when(changed, leaf(ascii_lower(F.col("text")))).alias("tampered"))
    out = merkle.manifest(rows)
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("above")), 256).alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("above")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    rows = rows.select("vec_id", label.cast("long").alias("label"), vector.alias("vector"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("is_anchor"))
    return hard_negatives.mine(rows, positives=5, negatives=10, low=30, high=90)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    back = bpe.decode(ids, path, pattern)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_token_counts, op4_decontaminate, op5_mixing, op6_sharding, op7_chat_format, op8_toxicity, op9_near_dedup, op10_exact_dedup, op11_merkle_manifest, op12_hard_negatives, op13_byte_bpe, pipeline)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{r}', '{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for r, v in URL_RULES)
_ESC = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '#', '\h')"

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
#: crc32 of the decimal digits, bit by bit: a digit enters with its code, then eight shifts (-1) follow.
_CRC = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
#: Levels of a tree: enough for 8 ** 9 leaves.
_HEIGHT = 9


def _tree(name: str, leaves: str) -> str:
    """CTEs name0, name1, ... from leaves (g, idx, h): the nodes of each level with the digests beside them, in groups g."""
    level = "SELECT g, idx, h, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({})"
    out = [f"{name}0 AS MATERIALIZED ({level.format(leaves)})"]
    for k in range(_HEIGHT):
        made = f"SELECT g, idx // 8 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k} GROUP BY g, idx // 8"
        out.append(f"{name}{k + 1} AS MATERIALIZED ({level.format(made)})")
    return ", ".join(out)


def _climb(tree: str, rows: str) -> str:
    """rows (..., g, idx, h, beside) with h folded to the last node of its tree and beside lengthened."""
    for k in range(_HEIGHT):
        rows = f"SELECT x.* REPLACE (x.beside || t.l || t.r AS beside, CASE WHEN t.n = 1 THEN x.h ELSE sha256(t.l || x.h || t.r) END AS h) FROM ({rows}) x JOIN {tree}{k} t ON t.g = x.g AND t.idx = x.idx // {8**k}"
    return rows


ORACLE = {
    "op11_merkle_manifest": f"""
        WITH d AS (SELECT doc_id, lang,
                sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
                CASE WHEN {_CRC} % 3 = 0 THEN sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", _LOWER.format("text")))}) END AS tampered FROM documents),
        p AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
        {_tree("a", "SELECT g, idx, leaf AS h FROM p")},
        {_tree("b", f"SELECT 0 AS g, g AS idx, h FROM a{_HEIGHT}")},
        low AS ({_climb("a", "SELECT doc_id, leaf, g, idx, coalesce(tampered, leaf) AS h, '' AS beside FROM p")}),
        high AS ({_climb("b", "SELECT doc_id, leaf, g AS own, 0 AS g, g AS idx, h, beside FROM low")}),
        root AS (SELECT h AS root FROM b{_HEIGHT})
        SELECT doc_id, leaf, s.h AS subroot, root, sha256(beside) AS proof_sha256, high.h AS folded_root, high.h = root AS verified
        FROM high JOIN a{_HEIGHT} s ON s.g = high.own CROSS JOIN root""",
    "op12_hard_negatives": """
        WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS (SELECT vec_id, label, unnest(v) AS c, generate_subscripts(v, 1) AS k FROM e),
        s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, sum(a.c * b.c)::BIGINT AS score
            FROM x a JOIN x b ON a.k = b.k WHERE a.vec_id % 100 = 0 GROUP BY ALL),
        p AS (SELECT a, b, score FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank,
            s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        QUALIFY rank <= 10""",
    "op1_url_filter": f"""
        WITH rules(rule, verdict, rhost, rpath) AS (VALUES {_RULES}),
        p AS (SELECT page_id,
                coalesce({_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
        SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict
        FROM p LEFT JOIN LATERAL (SELECT rule, verdict FROM rules
            WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
            ORDER BY length(rule) DESC LIMIT 1) r ON true""",
    "op7_chat_format": rf"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + 14)::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
        w AS (SELECT *, count(*) OVER (PARTITION BY sha) AS n,
                first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS keep FROM d)
        SELECT doc_id, keep AS keep_id, n AS group_size, doc_id = keep AS kept, sha AS text_sha256 FROM w""",
}
