import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.helpers import components, near_copies, words
from tests.llm.test_text_operators import brute_contamination


def fixture():
    r = random.Random(4)
    said = {"en": ["the", "and", "thing", "other", "with"], "de": ["der", "und", "schö", "ein", "nicht"]}
    texts, langs = [], []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        texts.append(" ".join(f"{r.choice(said[lang])}{r.choice(said[lang])}" for _ in range(60)))
        langs.append(lang)
    base = texts[0].split()
    for k in range(5):
        texts += [texts[2], " ".join(near_copies(base, 1, k))]
        langs += ["en", "en"]
    texts += [None, "", "12 34", texts[5] + " leaked item of ten words that nobody wrote before today"]
    langs += [None, "en", "en", "de"]
    return texts, langs, [(1, "Leaked item of ten words, that nobody wrote before today!")]


def test_stages_against_brute_force(spark, tmp_path):
    try:
        corpus_pipeline.tokenizers()
    except ImportError:
        pytest.skip("no vocabulary files")
    texts, langs, items = fixture()
    d = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {k: t for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    last = {}
    for k, t in left.items():
        last[t] = max(k, last.get(t, -1))
    left = {k: t for k, t in left.items() if last[t] == k}
    ids = sorted(left)
    c = components([left[k] for k in ids])
    left = {k: left[k] for n, k in enumerate(ids) if c[n] == n}
    left = {k: t for k, t in left.items() if not brute_contamination(t, items)[4]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(left) and len(left) == 60
    for k, r in got.items():
        assert r.decoded_sha256 == hashlib.sha256(left[k].encode()).hexdigest() and r.n_tokens * 4 == len(r.token_ids)
    assert words(3, 1)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and out.count() == 0
