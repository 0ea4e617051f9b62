"""Registered queries of the operators, with their DuckDB twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import ann, bm25, chat, filter_audit, langid, mixing, packing, quality, resampling, sharding, simhash, token_counts, warc
from kinetable.llm.common import id_crc, store, table
from kinetable.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT 0 AS round, source, source_size, weight, FALSE AS full_, 0.0::DOUBLE AS target FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
    full_ OR 2 * source_size <= level * weight,
    CASE WHEN full_ OR 2 * source_size <= level * weight THEN 2 * source_size ELSE level * weight END
  FROM (
    SELECT *, (1.5 * sum(source_size) OVER () - sum(CASE WHEN full_ THEN 2 * source_size ELSE 0 END) OVER ())
      / nullif(sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (), 0) AS level FROM filled
  ) WHERE round < (SELECT count(*) FROM sources)
), last_round AS (
  SELECT * FROM filled WHERE round = (SELECT count(*) FROM sources)
), stepped AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 1048576)::BIGINT ELSE 0 END AS step,
    ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 5))::BIGINT AS shift_
  FROM last_round
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS place FROM sized
)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
  ((((step * (place + 1) + shift_) >> 20) - ((step * place + shift_) >> 20)) * size)::BIGINT AS taken
FROM placed JOIN stepped ON placed.source IS NOT DISTINCT FROM stepped.source
"""


@query(MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.mix(docs).select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


@query()
def op3_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal counts; rows are numbered by id, then text."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = [F.col(c).asc() for c in ("doc_id", "text_crc32", "size")]
    return sharding.shard_rows(docs, order).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


CHAT_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\]|/?<?/?SYS>>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|/?bos>|/?eos>|start_of_turn>|end_of_turn>)', '\1\\\2\3', 'g') AS body
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(role) + length(body) + 32)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query(CHAT_SQL)
def op7_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as marked text; the digests are read back from that text and its mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(control).alias("text"),
    )
    records = chat.conversations(rows.unionByName(extra))
    texts = chat.formatted(chat.canonical_turns(records)).select("conv_id", "formatted", "loss_mask")
    back = texts.withColumn("_turns", chat.read_turns(F.col("formatted"))).withColumn(
        "_loss", chat.read_loss(F.col("formatted"), F.col("loss_mask"))
    )
    line = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = store(simhash.with_fingerprint(docs, name="fp").select("doc_id", "fp"), "prints")
    return simhash.near_classes(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query()
def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 4096 ids, each with its place in a sequence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(store(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


@query()
def op2_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(id_crc() % 4 == 2, F.lit(False)))
    calibrates = langid.for_calibration(id_crc())
    model = langid.train(docs.where(~F.col("held_out") & ~calibrates))
    known = F.when(~F.col("held_out") & calibrates, F.col("lang")).alias("lang")
    rows = docs.select("doc_id", "held_out", known, langid.measured(spark, F.col("text"), model).alias("m"))
    rows = store(rows, "measured")
    calibration = langid.calibrate(rows, model)
    return langid.identified(rows, model, calibration).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query()
def op5_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their quality score, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(False))
    stats = quality.document_statistics(spark, F.col("text"))
    rows = store(docs.select("doc_id", held_out.alias("held_out"), stats.alias("stats")), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(rows.where(~F.col("held_out")), labels)
    scored = rows.select("doc_id", "held_out", quality.score(spark, F.col("stats"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.KEEP).cast("int"))


@query()
def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.nearest(rows, F.col("vec_id") % 20 == 0)


BM25_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents
), stats AS (
  SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM documents)::DOUBLE AS average
), postings AS (
  SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT doc_id, count(*)::DOUBLE AS dl FROM words GROUP BY doc_id
), weights AS (
  SELECT term, ln(1.0 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, stats GROUP BY term, n
), asked AS (
  SELECT doc_id AS query_id, term, tf * idf AS weight FROM postings JOIN weights USING (term) WHERE doc_id % 20 = 0
), scored AS (
  SELECT query_id, doc_id, sum(weight * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / average)) ORDER BY term) AS score
  FROM asked JOIN postings USING (term) JOIN sizes USING (doc_id), stats GROUP BY query_id, doc_id
)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored)
WHERE rank <= 20
"""


@query(BM25_SQL)
def op6_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every document whose id is divisible by 20, out of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    found = bm25.top_k(bm25.index(docs), queries)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


#: What the query's edits take out: addresses, links and long numbers.
PERSONAL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|https?://[^\s)>\]]+|\+?\d[\d .-]{5,}\d"


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents before and after addresses, links and long numbers are masked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = token_counts.matches(F.col("text"), PERSONAL, "[masked]")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counts = token_counts.recounted(spark, F.col("text"), F.col("edits"), vocabulary, public_tokenizers.PATTERN)
    return docs.withColumn("edits", edits).select("doc_id", counts.alias("c")).select("doc_id", "c.*")


AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), measured AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), failing AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' ELSE '' END AS failed
  FROM measured
), marks AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, failed, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS letter, substr(filter_order, 1, step::INT - 1) AS earlier
  FROM orders, range(1, 6) AS s(step)
), met AS (
  SELECT *, contains(failed, letter) AS fails, length(translate(earlier, failed, '')) < length(earlier) AS gone FROM counted, steps
), audited AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audited
"""


@query(AUDIT_SQL)
def op11_audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


RESAMPLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), spelled AS (
  SELECT word, list_transform(range(0, strlen(word)), lambda p: ('0x' || substr(hex(word), (2 * p + 1)::INT, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) % 10000 AS bucket FROM spelled, crc
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), weighted AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weighted USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


@query(RESAMPLE_SQL)
def op12_resample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight for the benchmark's distribution, and the drawn tenth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark"))


WARC_SQL = r"""
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), met AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM met
"""


@query(WARC_SQL)
def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back from them."""
    name = "urn:page:"
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("place"),
        F.concat(F.lit(name), F.col("page_id").cast("string")).alias("record_id"),
        F.col("url").alias("uri"),
        F.col("html").alias("payload"),
    )
    path = scratch_path(spark, "llm-warc")
    warc.write(pages, path, name)
    found = warc.records(warc.read(spark, path, data=False))

    def number(column: str):
        return F.nullif(F.replace(F.col(column), F.lit(name), F.lit("")), F.lit("")).cast("long")

    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")
    )
