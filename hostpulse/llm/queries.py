"""One registered query per operator, with production parameters over its whole table, and the SQL where there is one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.llm import chat, decontamination, fim, jaccard, mixing, pii, quality, runs, sharding, simhash, suffixes, tokens, warc
from hostpulse.llm.common import table, text_bytes
from hostpulse.session import materialised, shared_dir

#: Shards of the sharding query.
SHARDS = 40


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.apply_rules(docs, model).drop("text")


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_similar(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


#: Target weights of the mix, as fixed by its design: per domain, and per language within each domain.
DOMAINS = {"web": (0, 10), "reference": (10, 15), "forum": (15, 20)}
DOMAIN_WEIGHTS = {"web": 0.5, "reference": 0.3, "forum": 0.15, "other": 0.05}
LANGUAGE_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
OTHER_LANGUAGE = 0.02


def domain() -> Column:
    """The domain of a source by its number; sources without one are ``other``."""
    n = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d{1,9})$", 1).try_cast("int")
    out = F.lit("other")
    for name, (low, high) in DOMAINS.items():
        out = F.when((n >= low) & (n < high), name).otherwise(out)
    return out


def weight(node: tuple) -> float:
    if len(node) == 1:
        return DOMAIN_WEIGHTS.get(node[0], 0.0)
    return LANGUAGE_WEIGHTS.get(node[1], OTHER_LANGUAGE) if len(node) == 2 else 1.0


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = materialised(table(spark, folder, "documents").select(
        "doc_id", domain().alias("domain"), "lang", "source", mixing.word_tokens().alias("n_tokens")
    ), "mixing")  # counted once, used in several passes
    return mixing.mix(docs, ["domain", "lang", "source"], "n_tokens", weight)


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    archives = shared_dir(spark, "warc")
    warc.write_archives(pages, archives)
    return warc.read_archives(spark, archives, payloads=False).filter("gap_reason IS NULL").select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        F.col("refers_to_page_id").cast("long").alias("refers_to"),
    )


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("cuts")


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rendered(table(spark, folder, "conversations"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.with_token_counts(table(spark, folder, "documents").select("doc_id", "text"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id", (text_bytes() + 16).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    return sharding.assign_shards(rows, "doc_id", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by their id, with an end that repeats itself."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, folder, "documents").select("doc_id", "text"), edit=planted)
    def line(r: Column) -> Column:
        return F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))

    text = F.array_join(F.transform("runs", line), "")
    # Structs are ordered by their fields: the longest, then the earliest, then that of the smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), text.alias("text"), "collapsed").select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-best.less * 1000 div best.period").alias("exponent_milli"),
        F.sha2("text", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_ngram_jaccard_join, op3_mix_sources, op4_decontaminate, op5_suffix_dedup, op6_chat_format, op7_token_counts, op8_warc, op9_personal_data, op10_shards,
        op11_simhash, op12_fill_in_middle, op13_periodic_runs,
    )
}

_OP6_SQL = """
WITH told AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place,
           coalesce(role, '~null') AS r, coalesce(text, '~null') AS t, role, text
    FROM conversations WHERE conv_id IS NOT NULL
),
whole AS (
    SELECT conv_id, count(*) AS n, list(struct_pack(r := r, t := t) ORDER BY place) AS turns, min(r || t) FILTER (place = 0) AS opening
    FROM told GROUP BY conv_id
),
kept AS (
    SELECT a.conv_id, a.n FROM whole a WHERE NOT EXISTS (
        SELECT 1 FROM whole b WHERE b.opening = a.opening AND b.conv_id <> a.conv_id AND b.n >= a.n
           AND (b.n > a.n OR b.conv_id < a.conv_id) AND list_slice(b.turns, 1, a.n) = a.turns)
)
SELECT conv_id, CAST(floor(place / 512) AS BIGINT) AS part, CAST(any_value(n) AS BIGINT) AS n_turns,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY place) AS chat
FROM told JOIN kept USING (conv_id) GROUP BY conv_id, CAST(floor(place / 512) AS BIGINT)
"""

_OP2_SQL = """
WITH RECURSIVE told AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s
    FROM told
),
parts AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y FROM parts a JOIN parts b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""

_OP8_SQL = """
WITH told AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
        CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits
    FROM pages
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum([
        CASE WHEN substr(bits, 5 * i + k, 1) = '1' THEN 1 << (5 - k) ELSE 0 END for k in range(1, 6)]) AS INTEGER), 1) for i in range(0, 32)], '')
        AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM told
"""

_OP12_SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents
),
numbers AS (
    SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS y,
        CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4
    FROM drawn
),
formed AS (
    SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
            WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form, substring(t, 1, least(x, y)) AS p,
        substring(t, least(x, y) + 1, abs(x - y)) AS m, substring(t, greatest(x, y) + 1) AS s
    FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
        AS output_sha256, sha256(t) AS restored_sha256
FROM formed
"""

SQL: dict[str, str] = {"op12_fill_in_middle": _OP12_SQL, "op2_ngram_jaccard_join": _OP2_SQL, "op6_chat_format": _OP6_SQL, "op8_warc": _OP8_SQL}
