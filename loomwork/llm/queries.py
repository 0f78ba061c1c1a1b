"""The opN_ queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import ann, chat, counting, decontamination, langid, packing, pii, pitman_yor, simhash, tokenfile
from loomwork.llm.common import crc_of_id, documents
from loomwork.registry import Registry
from loomwork.session import ship

registry = Registry()


@registry.query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack_documents(documents(spark, sf_dir), capacity=1024, end_id=2)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


@registry.query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every document, then after three edits of each: a head line with its source, a cut in the middle, an end mark."""
    docs = documents(spark, sf_dir)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    edit = lambda seq, start, stop, put: F.struct(F.lit(seq).alias("seq"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), put.alias("put"))
    n = F.length(text)
    edits = F.array(edit(1, n, n, F.lit("\n-- end --")), edit(2, half, half + 12, F.lit(" [...] ")), edit(3, F.lit(0), F.lit(0), F.concat(F.lit("# "), F.coalesce(F.col("source").cast("string"), F.lit("?")), F.lit("\n"))))
    got = counting.recount(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), edits.alias("edits")))
    return got.select("doc_id", "n_tokens", "n_edited", "n_encoded", "n_chars", F.size("leaf_tokens").cast("long").alias("n_leaves"))


@registry.query()
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenfile.write(documents(spark, sf_dir), end_id=0)
    return tokenfile.read(spark, out)


@registry.query()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(documents(spark, sf_dir), words=4, radius=4)
    return got.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@registry.query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = crc_of_id("doc_id") % 5
    model = langid.train(docs, fold != 0)
    got = langid.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@registry.query()
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@registry.query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    n = {f"n_{k}": of(i) for i, k in enumerate(pii.KINDS[:4])}
    return got.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(pii.spell("base").cast("binary"), 256).alias("base_sha256"), pii.spell("spans").alias("spans"))


_OP9 = """WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY n)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(t, '' ORDER BY n) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256, CAST(sum(18 + length(replace(replace(replace(r, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) + length(replace(replace(t, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id"""


@registry.query(oracle=_OP9)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    got = chat.conversations(chat.chain(rows)).select(F.col("tree").alias("conv_id"), "formatted", "mask").withColumn("turns", chat.read_back(F.col("formatted")))
    loss = F.array_join(chat.under(F.col("formatted"), F.col("mask")), "")
    got = got.withColumns({"loss": loss, "all": F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")})
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha("all").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@registry.query()
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.neighbours(rows, lambda i: i % 20 == 0, k=20)


@registry.query()
def op5_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir), crc_of_id("doc_id") % 10 == 0)


@registry.query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(ship(spark), sf_dir)
