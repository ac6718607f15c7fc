"""One query for each operator, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerbench.llm.compression_bands import compression_bands
from peerbench.llm.multi_index import nearest
from peerbench.llm.nb_svm import quality_scores
from peerbench.llm.order_minhash import near_duplicates
from peerbench.llm.packing import pack, token_pieces
from peerbench.llm.phrases import collocations
from peerbench.llm.pii import digest, personal_data
from peerbench.llm.sentence_pieces import encode_documents
from peerbench.llm.substring_dedup import substring_dedup
from peerbench.llm.tables import read_table, settle
from peerbench.llm.token_rollups import TokenRollups, deleted, inserted, revised
from peerbench.llm.tokens import count_tokens
from peerbench.llm.toxicity import toxicity_scores
from peerbench.llm.warc import page_records, read_warc, write_warc
from peerbench.llm.whitening import whiten
from peerbench.operators.joins import SHARE, left_join
from peerbench.staging import shared_folder


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to."""
    docs = read_table(spark, sf_dir, "documents")
    out = encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", "n_bytes", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(read_table(spark, sf_dir, "documents")))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read_table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(read_table(spark, sf_dir, "documents"))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, copies (equal texts but one, that with the least id) were
    deleted and texts with repeated lines were counted anew without them. The delete is sent twice. Both counts
    of a text come from one look at its row."""
    version = "word_bpe_49k"
    keys = ["doc_id", "source", "lang", "version"]
    docs = read_table(spark, sf_dir, "documents").withColumn("version", F.lit(version))
    lines = F.split("text", "\n", -1)
    kept = F.array_distinct(lines)
    revision = F.when(F.size(kept) < F.size(lines), F.array_join(kept, "\n"))
    counted = count_tokens(docs, tokenizer_path(f"{version}.json"), keep=[*keys[1:], "digest"], derive={"digest": F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)}, revised=revision)
    # rows that are equal in all that counts are one row with their number
    counted = settle(counted.groupBy(*keys, "digest", "n_tokens", "new_tokens").agg(F.count("*").alias("times")), "counted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *keys))
    same = settle(counted.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1"), "same_text")
    often = same.where(F.col("n") > counted.count() * SHARE).select("digest")
    counted = left_join(counted, same.drop("n"), ["digest"], frequent=often)
    own = F.col("first").isNull() | F.struct(F.col("doc_id").isNull().alias("last"), *keys).eqNullSafe(F.col("first"))
    counted = settle(counted.withColumn("stays", own.cast("int")).drop("first"), "counted_first")

    rollups = TokenRollups(spark, f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}")
    rollups.commit("load", inserted(counted))
    copies = deleted(counted.withColumn("times", F.col("times") - F.col("stays")))
    rollups.commit("copies", copies)
    rollups.commit("recount", revised(counted.where("stays = 1 and new_tokens is not null").withColumn("times", F.lit(1))))
    rollups.commit("copies", copies)
    return rollups.totals()


def op10_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_multi_index": op4_multi_index,
    "op5_order_minhash": op5_order_minhash,
    "op6_deobfuscation": op6_deobfuscation,
    "op7_best_fit": op7_best_fit,
    "op8_compression_bands": op8_compression_bands,
    "op9_token_rollups": op9_token_rollups,
    "op10_nb_svm": op10_nb_svm,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_phrases": op13_phrases,
}

#: SQL of the queries that it can express; the others are compared with plain versions in the tests.
ORACLES: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
             runs AS (SELECT doc_id, p AS s, concat_ws(' ', word, NEXT_WORDS) AS run, lead(p, 19) OVER o AS stop
                      FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
             placed AS (SELECT doc_id, s, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM runs WHERE stop IS NOT NULL),
             gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM placed WHERE nth > 1),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""".replace("NEXT_WORDS", ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 20))),
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             f AS (SELECT *, CASE WHEN strlen(body) >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM p)
        SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f""",
    "op13_phrases": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
             places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
             f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM places, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
             n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
             c AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE m > 1),
             spans AS (SELECT lang, a, p, m, unnest(range(1, m)) AS i FROM c WHERE m > 2),
             parts AS (SELECT lang, a, array_to_string(p[i:i + k - 1], ' ') AS phrase FROM spans, (SELECT unnest(range(2, 5)) AS k) WHERE k < m AND i + k - 1 <= m),
             held AS (SELECT lang, phrase, max(a) AS held FROM parts GROUP BY ALL),
             free AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE held IS NULL OR 100 * held < 100 * a),
             cuts AS (SELECT lang, phrase, a, k, array_to_string(p[1:k], ' ') AS head, array_to_string(p[k + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM free)),
             scored AS (SELECT lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, n, ((1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
                        FROM cuts JOIN n USING (lang) JOIN f l USING (lang) JOIN f r USING (lang) WHERE l.phrase = head AND r.phrase = tail),
             best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
