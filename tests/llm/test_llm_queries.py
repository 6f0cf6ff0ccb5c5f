"""The registered queries: against their SQL on the smallest tables, and with columns of clashing names."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD
from tests.test_queries import SF, TABLES, canon
from zonalyx.llm import bpe, decontaminate, exact_dedup, language_id, license_scan, lm_score, ngram_jaccard, queries, sharding

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_shards_hold_every_document_in_near_equal_bytes(spark):
    """What SQL can say of op2: sizes, gapless slots, near equal shards, one shard for each row."""
    import zlib

    got = queries.QUERIES["op2_sharding"](spark, SF).toPandas()
    duck = duckdb.connect()
    duck.register("got", got)
    docs = f"(SELECT doc_id, coalesce(text, '') AS t FROM '{SF}/documents.parquet')"
    assert duck.sql(f"SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) FROM {docs} ORDER BY 1").fetchall() == duck.sql("SELECT doc_id, size FROM got ORDER BY 1").fetchall()
    crc = {k: zlib.crc32(t.encode()) for k, t in duck.sql(f"SELECT doc_id, t FROM {docs}").fetchall()}
    assert crc == dict(zip(got.doc_id, got.text_crc32, strict=True))
    held = duck.sql("SELECT shard, sum(size), min(slot), max(slot), count(DISTINCT slot), count(*) FROM got GROUP BY shard ORDER BY 1").fetchall()
    assert [h[0] for h in held] == list(range(16)) and all(low == 0 and high == n - 1 == m - 1 for _, _, low, high, n, m in held)
    assert max(h[1] for h in held) - min(h[1] for h in held) <= max(got["size"])


CLASHES = ("id", "cls", "th", "n", "rep", "word", "uid", "m0", "c0", "sh", "__c0", "__text", "__uid", "__rare", "__n_tokens", "__score", "__lang", "__ids", "__ids_sha256", "__decoded_sha256", "__items", "__n_words", "__spans", "size", "shard", "slot", "__rn", "__g")


def clashing(spark, texts):
    d = spark.createDataFrame([(k, t, "en" if k % 2 else "fr") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    return d.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])


TEXTS = [*ODD, None, "", "one", "x" * 300_000, "same text here for all"]


def test_clashing_columns_do_no_harm(spark):
    d = clashing(spark, TEXTS)
    mine = lambda df, but: [c for c in CLASHES if c not in but and df.where(F.col(c) != f"mine {c}").limit(1).count()]
    vocabulary = ([bytes([b]) for b in range(256)], None)
    import numpy as np

    model = lm_score.train(d, F.lit(True), (vocabulary[0], np.full(256, 1 / 256)), rounds=1)
    scored = lm_score.score(d, model)
    assert scored.count() == len(TEXTS) and not mine(scored, lm_score.MADE) and scored.columns.count("__score") == 1
    said = language_id.predict(d, language_id.train(d))
    assert said.count() == len(TEXTS) and not mine(said, language_id.MADE)
    kept = language_id.keep_languages(d, language_id.train(d), 0.0)
    assert kept.columns == d.columns and not mine(kept, ())
    items = spark.createDataFrame([(1, "same text here for all")], "item_id long, text string")
    for size in (1 << 20, 1):
        hit = decontaminate.scan(d, items, index_bytes=size)
        assert hit.count() == len(TEXTS) and not mine(hit, decontaminate.MADE) and hit.where(F.size("__spans") > 0).count() == 3
    left = decontaminate.decontaminate(d, items)
    assert left.columns == d.columns and left.count() == len(TEXTS) - 3 and not mine(left, ())
    near = ngram_jaccard.drop_near_duplicates(d)
    assert near.columns == d.columns and not mine(near, ())
    assert exact_dedup.drop_exact_duplicates(d, keep_largest=True).columns == d.columns
    assert ngram_jaccard.near_duplicates(d).count() == exact_dedup.exact_groups(d).count() == sharding.shard_by_bytes(d, 4).count() == license_scan.scan_licenses(d).count() == len(TEXTS)
    public = queries.tokenizers()
    got = bpe.tokenise(d, public.path(queries.BPE_RANKS), public.PATTERN)
    assert got.count() == len(TEXTS) and not mine(got, bpe.MADE)


def test_benchmark_index_of_a_real_size():
    """5 MB of items in a few seconds and in bounded memory, in several blocks."""
    import pickle
    import random
    import time

    r = random.Random(1)
    some = [f"word{k}" for k in range(20_000)]
    began, sizes = time.perf_counter(), []
    index = decontaminate.Index(10)
    for k in range(4000):
        index.add(str(k), " ".join(r.choices(some, k=180)).encode())
        if index.bytes > 8 << 20:
            sizes.append((index.bytes, len(pickle.dumps(index.finish()))))
            index = decontaminate.Index(10)
    assert len(sizes) >= 2 and all(0.4 < real / said < 1.3 for said, real in sizes)
    assert time.perf_counter() - began < 30


def test_chat_tables_with_clashing_columns(spark):
    from zonalyx.llm import chat_format

    mine = [F.lit("mine").alias(c) for c in ("__t", "__print", "__record", "layout", "formatted", "loss_spans", "position")]
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string").select("*", *mine)
    got = sorted(map(tuple, chat_format.turns_from_table(rows).select("conv_id", "turn", "role", "text").collect()), key=str)
    assert got == [(1, 0, "user", "a"), (1, 1, "assistant", ""), (None, 0, "user", "x")]
    assert chat_format.digest(chat_format.format_turns(chat_format.turns_from_table(rows))).count() == 2
    record = '{"messages": [{"role": "user", "content": "q"}]}'
    json = spark.createDataFrame([(1, record), (1, record), (2, None), (3, "{")], "id long, record string").select("*", *mine)
    said = chat_format.turns_from_json(json, "record", "id").where("text <> ''")
    assert [r.text for r in said.collect()] == ["q", "q"]
