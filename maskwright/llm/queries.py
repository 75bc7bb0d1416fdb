"""The queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, chat_format, exact_dedup, html_extract, language_id, packing, periodic_runs, piece_bpe, pii, resampling, simhash, substring_dedup, topk
from .common import table


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_conversations(rows))


def op2_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op3_packing(spark, sf_dir):
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), _public("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op5_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    vocabulary, pattern = _public("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary, pattern)
    decoded = byte_bpe.decode_documents(encoded, vocabulary, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_pii(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    # a second parameter of the function would be the place in the array
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark, sf_dir):
    model = _public("piece_bpe_32k.model")
    decoded = piece_bpe.decode_documents(piece_bpe.encode_documents(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def _with_planted_runs(docs):
    """``docs`` where, by a hash of the id, one text in ten goes on from some word with one stretch of its words again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    p = F.struct(words.alias("w"), F.floor(h / 10).alias("g"), F.size(words).cast("long").alias("n"))
    a, n = F.expr("p.g % p.n"), F.col("p.n")
    period = 1 + F.floor((n - a) / (3 + F.expr("p.g % 8")))
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("p.w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("period")).cast("int")))
    text = F.when((F.col("planted")) & (n > 0), F.array_join(again, " ")).otherwise(F.col("text"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", chosen.alias("planted"), F.when(chosen, p).alias("p"))
    return rows.withColumn("a", F.when(n > 0, a)).withColumn("period", F.when(n > 0, period)).select("doc_id", text.alias("text"))


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("least"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.withColumn("m", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.back")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.least")).alias("period"),
        F.expr("1000 * m.length div -m.least").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries():
    return {
        "op1_chat_format": op1_chat_format,
        "op2_top_k": op2_top_k,
        "op3_packing": op3_packing,
        "op4_language_id": op4_language_id,
        "op5_simhash": op5_simhash,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_html_extract": op8_html_extract,
        "op9_pii": op9_pii,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_resampling": op12_resampling,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql():
    return {
        "op1_chat_format": chat_format.ORACLE_SQL,
        "op2_top_k": topk.ORACLE_SQL,
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_resampling": resampling.ORACLE_SQL,
    }
