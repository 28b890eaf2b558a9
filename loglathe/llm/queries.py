"""The registered queries of this subpackage and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.alignment import Vocabularies, alignments
from loglathe.llm.bpe import round_trips
from loglathe.llm.divergence import divergences
from loglathe.llm.html import extract
from loglathe.llm.langid import languages
from loglathe.llm.mixing import scores
from loglathe.llm.neardup import near_duplicates
from loglathe.llm.neighbours import nearest
from loglathe.llm.packing import pack, pieces
from loglathe.llm.quality import assessed
from loglathe.llm.repeats import repeated_spans
from loglathe.llm.sampling import labelled_sample, remainder
from loglathe.llm.toxicity import Shape, scored, train_on
from loglathe.llm.winnow import edited_fingerprints

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxic(docs.select("doc_id", "text"), labels).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def toxic(docs: DataFrame, labels: DataFrame, into: str = "score") -> DataFrame:
    """``docs`` with (``into``, held_out); labels of held-out ids (remainder 1 by 3) are not read."""
    model = train_on(labelled_sample(docs, labels, "toxic", Shape().sample, remainder("doc_id", 3) != 1))
    return scored(docs, model, into=into).withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))


def op4_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select(
        F.col("id").alias("doc_id"), F.col("start").alias("first_word"), (F.col("end") - F.col("start")).alias("n_words"),
        F.col("source_id").alias("source_doc_id"), F.col("source_start").alias("source_first_word"),
    )


def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def packed(docs: DataFrame) -> DataFrame:
    """The documents as sequences of 2048 tokens of a public vocabulary."""
    found = pieces(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )
    return pack(found)


def op7_bpe_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = round_trips(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality(docs, table(spark, sf_dir, "labels")).drop("text")


def quality(docs: DataFrame, labels: DataFrame, how=assessed) -> DataFrame:
    """``docs`` with their posterior quality; a source is a host, its languages are its paths."""
    return how(docs, labels, F.col("source"), F.col("lang"), where=remainder("doc_id", 3) != 1)


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Vocabularies(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    return alignments(table(spark, sf_dir, "documents"), files).withColumnRenamed("id", "doc_id")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, remainder("doc_id", 4) == 2).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_html_blocks": op2_html_blocks,
    "op3_toxicity_cnn": op3_toxicity_cnn,
    "op4_sparse_suffix_array": op4_sparse_suffix_array,
    "op5_collision_ann": op5_collision_ann,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_bpe_monoid": op7_bpe_monoid,
    "op8_quality_bayes": op8_quality_bayes,
    "op9_context_mixing": op9_context_mixing,
    "op10_minhash_neardup": op10_minhash_neardup,
    "op11_source_divergence": op11_source_divergence,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_language_id": op13_language_id,
}

ORACLES = {
    "op10_minhash_neardup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
            FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (
            SELECT doc_id AS id, doc_id AS c FROM documents
            UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.c)
        SELECT s.doc_id, len(g) AS n_shingles, c AS component_id, s.doc_id = c AS kept
        FROM s JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) ON id = s.doc_id""",
    "op11_source_divergence": f"""
        WITH t AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
                regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found
            FROM documents),
        o AS (SELECT lang, source, row, translate(unnest(found), '{_UPPER}', '{_LOWER}') AS term FROM t),
        k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
        l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM t),
        c AS (SELECT o.lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY o.lang, source, term),
        s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p,
                1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
            FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        d AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source),
        f AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
            FROM f)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
