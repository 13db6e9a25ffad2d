"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, lines, oracle, packing, phrases, pieces, quality, rules, sharding, substrings, tokens, turntrie, wavelet


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs, lambda: tokens.byte_bpe(tokenizer_file("byte_bpe_50k.json")), end_id=0, capacity=2048)
    return packing.pack(pieces, 2048)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=10)
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.classify(docs, model, threshold=0.7)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    return sharding.shard_rows(rows, "doc_id", [1.0] * 8, grown=1.0)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_read(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    manifest = wavelet.write_tokens(docs, lambda: tokens.word_bpe(tokenizer_file("word_bpe_49k.json")), wavelet.token_folder(spark), width=16, end_id=2)
    return wavelet.read_tokens(manifest, digest=True)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_read(spark, sf_dir, "documents"), min_documents=10, min_chars=1, digest=True)


#: The conversation that every run formats besides the table's, to show that control strings survive.
PLANTED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("select * from values " + ", ".join(f"({c}L, {t}L, '{r}', r'{x}')" for c, t, r, x in PLANTED) + " as t(conv_id, turn, role, text)")
    back = chat.read_back(*chat.write(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(_read(spark, sf_dir, "documents"))
    failed = ~rules.kept("base")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), rules.kept("v1").alias("kept"), "failed"
    )


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    def model() -> pieces.PieceBpe:
        return pieces.piece_bpe(tokenizer_file("piece_bpe_32k.model"))

    encoded = pieces.encode_texts(_read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return pieces.digests(pieces.decode_ids(encoded.select("doc_id", "ids"), model))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"), least=30, top=2000)


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turntrie.prefix_trie(turntrie.rebuilt(turntrie.turn_arrays(turns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pack, op2_jaccard, op3_decontaminate, op4_quality, op5_shard, op6_passages, op7_tokens, op8_lines, op9_chat, op10_rules, op11_pieces, op12_phrases, op13_turn_trie)
}
#: The others have no SQL form: tests compare them with brute force, a round trip or held-out labels.
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
