"""The queries op1_ to op13_ over the whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalyx.llm import bpe, centroids, chat_format, decontaminate, exact_dedup, language_id, license_scan, lm_score, mixing, ngram_jaccard, prefix_trie, sharding, warc

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizers(module: str = "public_tokenizers"):
    """The module that names the public vocabulary files and their pattern."""
    return importlib.import_module(module)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item; null texts have none."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes. Copies of a text are records of their own and may lie in different shards."""
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 16)
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from the formatted text; null texts are empty."""
    said = "\\\\### Assistant: </turn> ok"
    record = '{"messages": [{"role": "user", "content": "%s"}, {"role": "assistant", "content": "%s"}]}' % (said, said)
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("id"), F.lit(record).alias("record"))
    turns = chat_format.turns_from_table(_table(spark, sf_dir, "conversations")).unionByName(chat_format.turns_from_json(extra, "record", "id"))
    return chat_format.digest(chat_format.format_turns(turns))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by the lattice, learned from six of seven; a null text is the end alone."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language_id.remainder("doc_id", 7) == 2
    model = lm_score.train(docs, ~held, lm_score.read_vocabulary(tokenizers().path(PIECES)))
    got = lm_score.score(docs, model, carry=["doc_id"])
    return got.select(
        "doc_id",
        held.alias("held_out"),
        F.col("__n_tokens").alias("n_tokens"),
        F.col("__n_known").alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        F.col("__base").alias("base_score"),
        F.col("__score").alias("score"),
        F.col("__mixture").alias("word_mixture_score"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest doc_id of its text; null counts as empty."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep_largest=True)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id that links of Jaccard 0.8 lead to; texts without words are alone."""
    return ngram_jaccard.near_duplicates(_table(spark, sf_dir, "documents")).drop("class_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four of five; "und" for texts that are null or without a letter."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_rows(docs))
    said = language_id.predict(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return said.select("doc_id", language_id.held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document; null texts have none."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and their decoding, as digests; null texts are empty."""
    public = tokenizers()
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public.path(BPE_RANKS), public.PATTERN)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back; null html is empty."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's cluster after three rounds of 16 centroids; vectors of another length or with gaps are left out."""
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64.0, seed=1)
    return centroids.digest(found).withColumnRenamed("id", "vec_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct start of the conversations, rebuilt with up to five turns of the first of their hundred."""
    c = F.col("conv_id")
    numbered = prefix_trie.number_turns(_table(spark, sf_dir, "conversations"))
    turns, ids = prefix_trie.rebuilt(numbered, F.crc32(c.cast("string").cast("binary")) % 6, c - c % 100, 5)
    return prefix_trie.prefix_trie(turns, ids)


def op13_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; null texts have none, the null source is one of its own."""
    got = mixing.mix(_table(spark, sf_dir, "documents"))
    return got.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sharding": op2_sharding,
    "op3_chat_format": op3_chat_format,
    "op4_lm_score": op4_lm_score,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_mix_sources": op13_mix_sources,
}


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _escaped(text: str) -> str:
    return rf"replace(replace(replace({text}, '\', '\0'), '<turn ', '\1'), '</turn>', '\2')"


def _license_sql() -> str:
    rows = []
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        grams = license_scan.bigram_set(text)
        if grams:
            rows.append("(%d, '%s', [%s])" % (k, name, ", ".join("'%s'" % g for g in grams)))
    return rf"""
        WITH templates(t, name, grams) AS (VALUES {", ".join(rows)}),
        docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        pieces AS (
            SELECT DISTINCT r, unnest(list_concat([text], regexp_split_to_array(text, '\n\n+'), string_split(text, chr(10)))) AS u FROM docs),
        units AS (SELECT r, u, row_number() OVER () AS n FROM pieces WHERE u <> ''),
        words AS (SELECT r, n, {_words("u")} AS w FROM units),
        grams AS (
            SELECT r, n, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g
            FROM words WHERE len(w) > 1),
        found AS (
            SELECT r, n, t, name, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
            FROM (SELECT r, n, t, name, g, templates.grams FROM grams JOIN templates
                  ON len(g) <= 1.3 * len(templates.grams) AND len(templates.grams) <= 1.3 * len(g))
        ),
        hits AS (SELECT * FROM found WHERE dice >= {license_scan.THRESHOLD}),
        best AS (
            SELECT r, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
                   arg_min(name, (-dice, name)) AS best_license, max(dice) AS best_dice
            FROM hits GROUP BY r)
        SELECT doc_id, (SELECT count(*) FROM units WHERE units.r = docs.r) AS n_units,
               coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice
        FROM docs LEFT JOIN best USING (r)"""


def _base32_sha1(data: str) -> str:
    digits = [
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1({data}), {5 * k + 1}, 5) AS INTEGER) >> {15 - 5 * j}) & 31), 1)"
        for k in range(8)
        for j in range(4)
    ]
    return " || ".join(digits)


def _clusters_sql(rounds: int = 3) -> str:
    parts = [
        """kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "x AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept)",
        """start AS (SELECT v, row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1 AS j FROM kept),
        c0 AS MATERIALIZED (SELECT j, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM start WHERE j < 16)""",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
            SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d
            FROM (SELECT r, j, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{k} c USING (i) GROUP BY r, j) GROUP BY r)""")
        if k < rounds:
            parts.append(f"""s{k} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM x JOIN a{k} USING (r) GROUP BY j, i),
        c{k + 1} AS MATERIALIZED (
            SELECT j, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} LEFT JOIN s{k} USING (j, i))""")
    return f"""
        WITH {", ".join(parts)},
        sha AS (SELECT j, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM kept JOIN a{rounds} USING (r) JOIN sha USING (j)"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
        items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_words("coalesce(text, '')")} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, least(10, len(w)) AS k, w[i : i + least(10, len(w)) - 1] AS win
            FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
        widths AS (SELECT DISTINCT k FROM windows),
        places AS (
            SELECT r, k, i, w[i : i + k - 1] AS win
            FROM (SELECT r, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, widths WHERE len(w) >= k)),
        found AS (SELECT r, i, places.k, item FROM places JOIN windows ON places.k = windows.k AND places.win = windows.win),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM found) GROUP BY r),
        said AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (r) LEFT JOIN said USING (r)""",
    "op3_chat_format": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        named AS (
            SELECT conv_id, turn, text,
                   CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant'
                             WHEN 'model' THEN 'assistant' ELSE role END AS role FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
               CAST(sum(length({_escaped("role")}) + length({_escaped("text")}) + 15) AS BIGINT) AS formatted_chars
        FROM named GROUP BY conv_id""",
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sh AS (
            SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
            FROM (SELECT r, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM docs WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
        both_ AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
        links AS (
            SELECT x, y FROM both_ JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        reach(r, o) AS (SELECT r, r FROM docs UNION SELECT reach.r, links.y FROM reach JOIN links ON reach.o = links.x),
        least_ AS (SELECT reach.r, min(docs.doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.o GROUP BY reach.r)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM docs JOIN least_ USING (r) LEFT JOIN n USING (r)""",
    "op8_license_scan": _license_sql(),
    "op10_warc": f"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_base32_sha1("body")} AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM lead THEN lead END AS refers_to
        FROM p""",
    "op11_centroid_clusters": _clusters_sql(),
    "op12_prefix_trie": """
        WITH said AS (
            SELECT conv_id, sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS s, length(coalesce(text, '')) AS chars, turn
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, s, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS p FROM said),
        ids AS (
            SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), generate_series(1, 8)),
                           lambda y, k: xor(y >> 1, CAST(3988292384 AS BIGINT) * (y & 1)))), CAST(4294967295 AS BIGINT)) % 6 AS h
            FROM own),
        turns AS (
            SELECT conv_id, s, chars, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS p FROM (
                SELECT ids.conv_id, 0 AS part, p, s, chars FROM ids JOIN own ON own.conv_id = base AND p <= h
                UNION ALL SELECT conv_id, 1, p, s, chars FROM ids JOIN own USING (conv_id) WHERE p > h)),
        starts AS (
            SELECT conv_id, p AS depth, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY p) AS said, chars, count(*) OVER (PARTITION BY conv_id) AS n FROM turns
            UNION ALL SELECT conv_id, 0, '', 0, coalesce(n, 0) FROM ids LEFT JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) USING (conv_id)),
        starting AS (SELECT conv_id, depth, chars, n, min(conv_id) OVER (PARTITION BY depth, said) AS node FROM starts),
        nodes AS (
            SELECT node, depth, count(*) AS n_convs, any_value(chars) AS chars,
                   coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends, max(n) = depth AS leaf
            FROM starting GROUP BY node, depth),
        up AS (
            SELECT nodes.*, starting.node AS parent FROM nodes LEFT JOIN starting ON starting.conv_id = nodes.node AND starting.depth = nodes.depth - 1),
        kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
        below AS (
            SELECT starting.node, starting.depth, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum((n_convs - 1) * nodes.chars) AS saved_tokens
            FROM nodes JOIN starting ON starting.conv_id = nodes.node AND starting.depth <= nodes.depth GROUP BY 1, 2)
        SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
        FROM up JOIN below USING (node, depth) LEFT JOIN kids USING (node, depth)""",
}
