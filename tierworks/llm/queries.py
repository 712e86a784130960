"""The operators on the given tables, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.llm import (
    bpe, collocations, decontaminate, langid, license_scan, merkle, quality, secret_scan, simhash, suffix_dedup, token_ids, topk, toxicity,
)
from tierworks.llm.batches import on_workers
from tierworks.session import new_work_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_work_path(spark, "token-ids")
    token_ids.write_ids(table(spark, sf_dir, "documents"), target, BYTE_BPE, END_ID, new_work_path(spark, "tokens"))
    return token_ids.read_digests(spark, target)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents")).drop("scores")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents")).drop("findings")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=2)
    return found.select("doc_id", simhash.hexadecimal(found["fp"]).alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~langid.held_out(documents["doc_id"])))
    found = langid.identify(documents, model)
    return found.select("doc_id", langid.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "rejected")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(~toxicity.held_out(labels["doc_id"])))
    found = toxicity.score(documents, model, matches=False)
    return found.select("doc_id", toxicity.held_out(found["doc_id"]).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, columns = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.row_digest([F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in columns])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    proofs = merkle.manifest(documents, columns, tampered=tampered).proofs("id", "tampered")
    proofs = proofs.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels.where(~quality.held_out(labels["doc_id"])))
    found = quality.score(documents, model)
    return found.select("doc_id", quality.held_out(found["doc_id"]).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_decontaminate": op2_decontaminate,
    "op3_top_k": op3_top_k,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secrets": op5_secrets,
    "op6_licenses": op6_licenses,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_merkle": op12_merkle,
    "op13_quality": op13_quality,
}

ORACLE: dict[str, str] = {
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS c
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, s.vec_id, CAST(list_sum(list_transform(list_zip(q.c, s.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v s ON q.vec_id % 50 = 0 AND s.vec_id <> q.vec_id AND len(q.c) = len(s.c)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), split AS (
            SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
        ), placed AS (
            SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM split
        ), followed AS (
            SELECT lang, w1, lead(w1) OVER part AS w2, lead(w1, 2) OVER part AS w3 FROM placed WINDOW part AS (PARTITION BY piece ORDER BY i)
        ), grams AS MATERIALIZED (
            SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM followed GROUP BY lang, w1
            UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM followed WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
            UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM followed WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
        ), parted AS MATERIALIZED (
            SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10
        ), halves AS MATERIALIZED (
            SELECT lang, phrase, f AS a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM parted
            UNION ALL SELECT lang, phrase, f, 2, array_to_string(w[1:2], ' '), w[3] FROM parted WHERE k = 3
        ), cuts AS (
            SELECT h.lang, h.phrase, h.cut, h.a, l.f AS l, r.f AS r, CAST((h.a::HUGEINT * h.a * 1000000) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
            FROM halves h JOIN grams l ON l.lang = h.lang AND l.phrase = h.head JOIN grams r ON r.lang = h.lang AND r.phrase = h.tail
        ), candidates AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), longer AS (
            SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM parted WHERE k = 3
            UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM parted WHERE k = 3
        ), kept AS (
            SELECT * FROM candidates c
            WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.f >= 50 * c.a)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op12_merkle": """
        WITH RECURSIVE rows AS (
            SELECT doc_id, coalesce('=' || lang, '') AS grp,
                   'L' AS x, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS own,
                   [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] AS altered,
                   list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT),
                       lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))) AS state
            FROM documents
        ), digested AS (
            SELECT doc_id, grp, xor(state, 4294967295) % 7 = 0 AS changed,
                   sha256(array_to_string(list_transform(own, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS leaf,
                   sha256(array_to_string(list_transform(altered, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS other
            FROM rows
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM digested
        ), tree AS (
            SELECT grp, 0 AS level, pos, leaf AS node, size FROM leaves
            UNION ALL
            SELECT grp, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(size) + 1) // 2 FROM tree WHERE size > 1 GROUP BY grp, level, pos // 2
        ), subroots AS (
            SELECT grp, node, level, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS size FROM tree WHERE size = 1
        ), crown AS (
            SELECT 0 AS level, pos, node, size FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(size) + 1) // 2 FROM crown WHERE size > 1 GROUP BY level, pos // 2
        ), proved AS (
            SELECT l.doc_id, l.grp, l.pos, l.leaf, CASE WHEN l.changed THEN l.other ELSE l.leaf END AS start, s.node AS subroot, s.level AS height, s.pos AS place,
                   (SELECT node FROM crown WHERE size = 1) AS root
            FROM leaves l JOIN subroots s ON s.grp = l.grp
        ), steps AS (
            SELECT p.grp, p.pos, t.level AS k, (p.pos >> t.level) & 1 AS side, t.node AS sibling
            FROM proved p JOIN tree t ON t.grp = p.grp AND t.pos = xor(p.pos >> t.level, 1) AND t.level < p.height
            UNION ALL
            SELECT p.grp, p.pos, p.height + c.level, (p.place >> c.level) & 1, c.node
            FROM proved p JOIN crown c ON c.pos = xor(p.place >> c.level, 1) AND c.size > 1
        ), depths AS (
            SELECT p.*, p.height + (SELECT max(level) FROM crown) AS depth FROM proved p
        ), folding AS (
            SELECT grp, pos, 0 AS k, depth, start AS node FROM depths
            UNION ALL
            SELECT f.grp, f.pos, f.k + 1, f.depth,
                   sha256(CASE WHEN s.side = 1 THEN s.sibling || f.node ELSE f.node || coalesce(s.sibling, '') END)
            FROM folding f LEFT JOIN steps s ON s.grp = f.grp AND s.pos = f.pos AND s.k = f.k WHERE f.k < f.depth
        ), proofs AS (
            SELECT d.grp, d.pos, sha256(coalesce(string_agg(s.sibling, '' ORDER BY s.k), '')) AS proof_sha256
            FROM depths d LEFT JOIN steps s ON s.grp = d.grp AND s.pos = d.pos GROUP BY d.grp, d.pos
        )
        SELECT d.doc_id, d.leaf, d.subroot, d.root, p.proof_sha256, f.node AS folded_root, f.node = d.root AS verified
        FROM depths d JOIN proofs p USING (grp, pos) JOIN folding f ON f.grp = d.grp AND f.pos = d.pos AND f.k = d.depth
    """,
}
