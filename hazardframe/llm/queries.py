"""The queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardframe.llm import backoff, bwt, decontaminate, mixing, ordermin, periods, pii, quality, rtree, speculate, storage, tokenfile, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    storage.bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 over the sources, every source within three times its size."""
    sized = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized, "size").select("doc_id", "size", "source_size", "target", "taken", "epochs", "part")


ORACLES["op1_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER by_name - 1) % 3 + 1)::INT]::DOUBLE AS weight, row_number() OVER by_name AS rank,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM per_source WINDOW by_name AS (ORDER BY source NULLS LAST)),
levels AS (
  SELECT *, greatest(total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, rank
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 0)
            / sum(weight) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
chosen AS (
  SELECT level AS water FROM levels WHERE level * weight <= 3 * source_size ORDER BY 3 * source_size / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(weight * (SELECT water FROM chosen), (3 * source_size)::DOUBLE),
         (3 * source_size)::DOUBLE) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed),
parts AS (SELECT *, greatest(0, least(size, budget - epochs * source_size - before))::BIGINT AS part FROM cut)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, epochs::BIGINT AS epochs, part FROM parts
"""


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows outside the held-out third."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = table(spark, folder, "labels").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit_toxicity(documents, labels)
    scored = toxicity.score_toxicity(documents, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and verdict of the quality rules for every document."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(table(spark, folder, "documents")).select(*columns)


ORACLES["op9_quality"] = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS win FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
gaps AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS n FROM again),
repeated AS (SELECT rid, sum(n)::BIGINT AS n FROM gaps GROUP BY rid),
figures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(words, lambda x: list_contains({quality.STOP_WORDS!r}, x)))::BIGINT AS n_stop_words,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       NOT ({quality.verdict_sql(quality.BASE_RULES)}) AS base_failed,
       ({quality.verdict_sql(quality.BASE_RULES)}) AND ({quality.verdict_sql(quality.RULES)}) AS kept
FROM figures
"""


@query
def op2_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, written in the packed format in order of doc_id and read back."""
    path = storage.shared_folder(spark, "token-ids")
    tokenfile.write_texts(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257)
    return tokenfile.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, repeated payloads as revisits, read back from the archives."""
    path = storage.shared_folder(spark, "warc")
    warc.write_warc(warc.with_revisits(table(spark, folder, "pages")), path)
    records = warc.read_warc(spark, path)
    stored = F.col("record_type") == "response"
    return records.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
d AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d
"""


@query
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: the base patterns and what the field adds."""
    documents = table(spark, folder, "documents")
    found = pii.personal_data(documents, pii.fit_field(documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, literally or edited, with the alignment's score and place."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return ordermin.near_duplicate_classes(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "class_id")


@query
def op7_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every document under all other documents."""
    scores = backoff.backoff_scores(table(spark, folder, "documents"))
    return scores.select(F.col("id").alias("doc_id"), "n_words", "log_score", "mean_log_score")


@query
def op6_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes that 100-byte strings with an earlier copy cover."""
    cut = bwt.remove_repeats(table(spark, folder, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """For every fiftieth row and each of its five best rows of the same label, the three best rows of other labels that score
    half to 95 per cent of it."""
    rows = table(spark, folder, "embeddings")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"),
    )
    found = rtree.hard_negatives(rows, F.col("vec_id") % 50 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLES["op11_hard_negatives"] = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.rid <> b.rid),
positive AS (
  SELECT anchor, rid, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT s.anchor_id, positive_id, row_number() OVER best::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.anchor = s.anchor AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id NULLS LAST)
QUALIFY row_number() OVER best <= 3
"""


@query
def op12_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids, and the text that they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = speculate.decode(speculate.encode(table(spark, folder, "documents"), path), path)
    return coded.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


def with_repeated_part(documents: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by the checksum h of the id, the words from some word on are replaced by
    repetitions of the first of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    g, n = F.floor(F.col("_h") / 10), F.size("_words")
    rows = documents.select("doc_id", "text", h.alias("_h"), words.alias("_words"))
    rows = rows.select("doc_id", "text", "_words", g.alias("_g"), F.when(n > 0, g % n).cast("int").alias("_a"))
    p = (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    rows = rows.select("doc_id", "text", "_words", "_a", p.alias("_p"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), times)), F.lit(1), n - F.col("_a"))
    changed = F.concat_ws(" ", F.concat(F.slice("_words", F.lit(1), F.col("_a")), again))
    return rows.select("doc_id", F.when(F.col("_a").isNull(), F.col("text")).otherwise(changed).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of words of every document, and a digest of its text without their repetitions."""
    found = periods.periodic_runs(with_repeated_part(table(spark, folder, "documents"))).withColumn("best", periods.longest_run("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


ORACLES["op13_periodic_runs"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         -- CRC-32 bit by bit: a byte is mixed in, then eight steps (-1) shift the register
         xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda r, x: CASE WHEN x < 0 THEN xor(r >> 1, 3988292384 * (r & 1)) ELSE xor(r, x) END), 4294967295) AS h
  FROM documents),
s AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
planted AS (SELECT rid, doc_id, n, w, a, 1 + (n - a) // (3 + g % 8) AS p FROM s),
word AS (SELECT rid, n, i, w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM planted, unnest(range(n)) AS u(i)),
same AS (SELECT x.rid, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.rid = y.rid AND x.word = y.word AND x.i < y.i AND y.i - x.i <= x.n // 2),
stretch AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same) GROUP BY rid, q, island
  HAVING count(*) + q >= greatest(12, 2 * q)),
run AS (SELECT rid, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period FROM stretch GROUP BY rid, start, length),
best AS (
  SELECT rid, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, [-length, start, period]) AS b,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM run GROUP BY rid),
dropped AS (SELECT DISTINCT rid, i FROM run, unnest(range(start + period, start + length)) AS u(i)),
rest AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (rid) LEFT JOIN rest USING (rid)
"""
