"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.llm import exact_dedup as grace
from folio.llm import decontaminate, jaccard_join, language, licenses, piece_transducer, quality, repeats, sharding, token_files, url_filter, vector_codes, whitening
from folio.tables import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark, sf_dir):
    return token_files.read_token_files(spark, token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op2_suffix_dedup(spark, sf_dir):
    return repeats.removed_repeats(table(spark, sf_dir, "documents")).drop("spans")


def site_of(docs):
    """Where a document comes from, host and path: the testbed has a source for a site and a language for its section."""
    return {"host": docs["source"], "path": F.concat_ws("/", docs["source"], docs["lang"])}


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), **site_of(docs))


def op4_piece_transducer(spark, sf_dir):
    model = vocabulary("piece_bpe_32k.model")
    found = piece_transducer.decode(piece_transducer.encode(table(spark, sf_dir, "documents"), model), model)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return found.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def op5_exact_dedup(spark, sf_dir):
    found = grace.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)"""


def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard_join.joined(table(spark, sf_dir, "documents"), count_links=False)


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))), vocabulary("piece_bpe_32k.model"))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vector_codes.compress(rows, vec_id=rows["vec_id"], vector=rows["embedding"], label=rows["label"])


def op12_whitening(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, vec_id=rows["vec_id"], vector=rows["embedding"])


def op13_url_filter(spark, sf_dir):
    """Word counts come from the texts of documents."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.unigrams(table(spark, sf_dir, "documents")), page_id=pages["page_id"], url=pages["url"])


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_piece_transducer": op4_piece_transducer,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_url_filter": op13_url_filter,
}
ORACLES = {"op5_exact_dedup": OP5_SQL, "op6_license_scan": licenses.oracle(), "op10_sharding": sharding.oracle(), "op11_vector_codes": vector_codes.oracle()}
