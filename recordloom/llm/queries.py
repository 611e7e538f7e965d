"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontam, exact, interaction, langid, lexical, lines, ngram_join, packing, pieces, secret_scan, sharding, suffix, toxicity
from recordloom.tables import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their length bucket, shard, batch and slot."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed as boilerplate of many sources, and a digest of the text that stays."""
    out = lines.strip_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item, the similarity and the place."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document under the byte limit."""
    return sharding.shards(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its shingle set and the component of its Jaccard links."""
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes and runs removed as repeated 400-byte strings, a digest of the rest, and the number of repeated passages of over 50 words."""
    out = suffix.strip_repeats(table(spark, sf_dir, "documents"), passage=suffix.PASSAGE_LENGTH)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.size("passages").cast("long").alias("n_passages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out, its predicted language and the score."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the secrets that patterns find, a digest of them, and all spans with those of the Markov models."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the row of its group of equal texts that stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out, its toxicity score, the prediction, and the byte spans of offending sentences with their scores."""
    out = toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    span = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), F.format_number(s["score"], 3))
    return out.withColumn("offending", F.array_join(F.transform("sentences", span), ",")).drop("sentences")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of its pieces, and digests of their ids and of the decoded text."""
    import public_tokenizers

    model = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, order of the five filters and step: what is kept, removed, redundant and lost."""
    counts = interaction.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interaction.audit(counts, "ABCD" + interaction.COPY)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_line_dedup,
        op3_decontamination,
        op4_sharding,
        op5_ngram_join,
        op6_suffix_dedup,
        op7_language_id,
        op8_secret_scan,
        op9_exact_dedup,
        op10_toxicity,
        op11_sentencepiece,
        op12_lexical_search,
        op13_filter_audit,
    )
}

SQL = {
    "op2_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, coalesce(source, '') AS site, pos, line, length(trim(line)) >= {lines.MIN_CHARS} AS counts
            FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
        ), b AS (
            SELECT trim(line) AS line FROM l WHERE counts GROUP BY 1 HAVING count(DISTINCT site) >= {lines.MIN_SITES}
        ), m AS (
            SELECT l.doc_id, l.pos, l.line, l.counts AND b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON trim(l.line) = b.line
        ), k AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
            FROM m GROUP BY doc_id
        )
        SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM k
    """,
    "op4_sharding": f"""
        WITH d AS (
            SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
        ), p AS (
            SELECT d.*, r.depth, d.h >> (60 - r.depth) AS prefix FROM d, (SELECT unnest(range(0, 49)) AS depth) r
        ), f AS (
            SELECT depth, prefix FROM p GROUP BY 1, 2 HAVING sum(n_bytes) <= {sharding.BYTE_LIMIT} OR count(*) = 1
        ), a AS (
            SELECT doc_id, n_bytes, min(depth) AS depth, any_value(h) AS h FROM p JOIN f USING (depth, prefix) GROUP BY 1, 2
        )
        SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, depth::INT) AS shard, depth::INT AS depth, n_bytes,
               n_bytes > {sharding.BYTE_LIMIT} AS oversize FROM a
    """,
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op12_lexical_search": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), i AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1
        ), s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d
        ), p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY 1, 2
        ), w AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs
        ), r AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY 1, 2
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
        QUALIFY rank <= 50
    """,
    "op13_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), g AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
        ), m AS (
            SELECT part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
                          regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM t LEFT JOIN g USING (doc_id)
        ), c AS (
            SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2
        ), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), z AS (
            SELECT p.part, o.filter_order, s.step::INT AS step, strpos('ABCDE', substr(filter_order, s.step::INT, 1)) AS f
            FROM (SELECT DISTINCT part FROM c) p, o, (SELECT unnest(range(1, 6)) AS step) s
        ), e AS (
            SELECT part, filter_order, n, good, toxic, fails, list_aggregate(list_transform(range(1, 6), lambda k: CASE WHEN fails[strpos('ABCDE', substr(filter_order, k::INT, 1))] THEN k ELSE 6 END), 'min') AS goes
            FROM c, o
        ), r AS (
            SELECT z.part, z.filter_order, z.step, z.f,
                   sum(n) FILTER (goes > step) AS kept, sum(n) FILTER (goes = step) AS removed, sum(n) FILTER (goes < step AND fails[f]) AS redundant,
                   sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda v: v)) = 1) AS unique_fails, sum(good) FILTER (goes = step) AS good_lost, sum(toxic) FILTER (goes = step) AS toxic_lost
            FROM z JOIN e USING (part, filter_order) GROUP BY ALL
        )
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
               coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
        FROM r
    """,
}
