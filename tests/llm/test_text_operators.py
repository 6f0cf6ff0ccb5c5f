import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, components, near_copies, shingle_set, table, words
from zonalyx.llm import bpe, chat_format, decontaminate, exact_dedup, language_id, lattice, license_scan, lm_score, ngram_jaccard, queries, sharding, warc
from zonalyx.llm import components as cc


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# -- exact dedup --------------------------------------------------------------------------------


def test_exact_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MIN_HOT_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 10)
    texts = [*ODD, *["hot copy"] * 60, *[" ".join(words(5, k % 7)) for k in range(40)]]
    for largest in (True, False):
        got = rows(exact_dedup.exact_groups(table(spark, texts).repartition(5), keep_largest=largest), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        groups = {}
        for k, t in enumerate(texts):
            groups.setdefault(t or "", []).append(k)
        want = [(k, (max if largest else min)(groups[t or ""]), len(groups[t or ""]), k == (max if largest else min)(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in enumerate(texts)]
        assert sorted(got) == want


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    d = table(spark, ["a", "a", "b"]).union(table(spark, ["a"], 1))
    got = exact_dedup.drop_exact_duplicates(d, keep_largest=True)
    assert got.columns == d.columns and sorted(rows(got, "doc_id", "text")) == [(1, "a"), (2, "b")]
    assert exact_dedup.exact_groups(d.where("false")).count() == 0
    nulls = d.withColumn("doc_id", F.when(F.col("text") == "b", F.col("doc_id")))
    assert sorted(rows(exact_dedup.exact_groups(nulls), "kept")) == [(False,), (False,), (True,), (True,)]


# -- sharding -----------------------------------------------------------------------------------


def test_shards_are_balanced_and_gapless(spark):
    texts = [*ODD, *[" ".join(words(3 + k % 50, k)) for k in range(600)]]
    got = rows(sharding.shard_by_bytes(table(spark, texts), 4), "id", "size", "text_crc32", "shard", "position")
    assert len(got) == len(texts)
    for i, size, crc, _, _ in got:
        raw = (texts[i] or "").encode()
        assert size == len(raw) + 1 and crc == zlib.crc32(raw)
    held = [sum(r[1] for r in got if r[3] == s) for s in range(4)]
    assert max(held) - min(held) < 0.02 * sum(held)
    for s in range(4):
        at = sorted(r[4] for r in got if r[3] == s)
        assert at == list(range(len(at)))


def test_hot_key_is_split_and_growth_moves_rows_into_the_new_shard_only(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MIN_SPLIT_ROWS", 10)
    d = table(spark, ["x" * 20] * 400).withColumn("doc_id", F.when(F.col("doc_id") < 200, 7).otherwise(F.col("doc_id")))
    r = sharding.slot_rows(d)
    assert r.where("id = 7").select("part").distinct().count() > 5
    first = sharding.assign(sharding.slot_sums(r), 4)
    grown = sharding.grow(first, 5)
    moved = [(a, b) for a, b in zip(first, grown, strict=True) if a[5] != b[5]]
    assert moved and all(b[5] == 4 for _, b in moved) and all(b[0] == 1 for b in grown)
    assert sharding.spread(grown) < 1.2
    path = sharding.store_map(spark, first)
    sharding.store_map(spark, grown, path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 0) == first
    assert sharding.shard_by_bytes(d.where("false")).count() == 0


# -- chat ---------------------------------------------------------------------------------------


def test_layouts_become_the_same_turns(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"extra":1}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"instruction":"q","output":"a"}',
        '{"instruction":"q","input":"","output":"a"}',
        '{"prompt":"q","completion":"a"}',
        '{"prompt":"q","response":"a"}',
        '{"question":"q","answer":"a","meta":{"x":1}}',
    ]
    d = spark.createDataFrame([(k, r) for k, r in enumerate([*records, "broken", None, '{"odd":1}'])], "id long, r string")
    got = rows(chat_format.turns_from_json(d, "r", "id").orderBy("conv_id", "turn"), "conv_id", "turn", "role", "text")
    for k in range(len(records)):
        assert [g[1:] for g in got if g[0] == k] == [(0, "user", "q"), (1, "assistant", "a")]
    assert [g for g in got if g[0] >= len(records)] == [(k, None, None, None) for k in range(len(records), len(records) + 3)]
    typed = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "id long, messages array<struct<role:string,content:string>>")
    assert rows(chat_format.turns_from_table(typed), "role", "text") == [("user", "q"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat_format.turns_from_table(d)


def test_format_reads_back_whatever_the_text(spark):
    hard = ["", None, "\\", "\\0\\1", "</turn>", "<turn user>", "a </turn>\n<turn assistant>b", "é😀\\2", "</tu</turn>rn>", "\\### Assistant: </turn> ok"]
    roles = ["user", "assistant", "odd>role\\3", None, "assistant", "assistant", "system", "assistant", "user", "assistant"]
    d = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(zip(roles, hard, strict=True))] + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    f = chat_format.format_turns(d)
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in f.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back[1] == [(r or "", t or "") for r, t in zip(roles, hard, strict=True)] and back[2] == [("user", "x")]
    loss = {r.conv_id: r.l for r in f.select("conv_id", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert loss[1] == [t or "" for r, t in zip(roles, hard, strict=True) if r == "assistant"] and loss[2] == []
    assert chat_format.digest(chat_format.format_turns(d.where("false"))).count() == 0


# -- decontamination ----------------------------------------------------------------------------


def brute_contamination(text, items, window=10):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        iw = cut(t)
        k = min(window, len(iw))
        for i in range(len(iw) - k + 1) if iw else ():
            for j in range(len(w) - k + 1):
                if w[j : j + k] == iw[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark):
    item = words(25, 1)
    items = [(1, " ".join(item)), (2, "Short ITEM, here"), (3, None), (4, ""), (5, " ".join(words(12, 2))), (5, "other text of five")]
    texts = [*ODD, " ".join([*words(30, 3), *item[4:16], *words(9, 4)]), "a short-item; HERE and there", " ".join(words(200, 5)), " ".join(item).upper(), "other text of five other text of five", "short item"]
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 30):
        got = decontaminate.contamination(table(spark, texts), b, index_bytes=size)
        assert dict((r[0], r[1:]) for r in rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == {k: brute_contamination(t, items) for k, t in enumerate(texts)}
    left = decontaminate.decontaminate(table(spark, texts), b)
    assert left.columns == table(spark, texts).columns
    assert sorted(r[0] for r in rows(left, "doc_id")) == [k for k, t in enumerate(texts) if not brute_contamination(t, items)[4]]
    cut = dict(rows(decontaminate.decontaminate(table(spark, texts), b, mode="spans"), "doc_id", "text"))
    assert cut[0] is None and cut[len(ODD) + 1] == "a  and there"
    assert not any(brute_contamination(t, items[:1])[4] for t in cut.values())
    assert decontaminate.contamination(table(spark, texts), b.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(table(spark, texts).where("false"), b).count() == 0


# -- LM -----------------------------------------------------------------------------------------


def brute_probability(word, p):
    return 1.0 if not word else sum(q * brute_probability(word[len(x) :], p) for x, q in p.items() if word.startswith(x))


def test_lattice_against_enumeration(monkeypatch):
    p = {b" a": 0.1, b"a": 0.2, b"b": 0.15, b"ab": 0.2, b" ab": 0.1, b"ba": 0.15, b" ": 0.1}
    pieces = lattice.Pieces(list(p), np.log(list(p.values())))
    ws = [b" abab", b" a", b" bbb", b" aabbabab", b"", b" c"]
    for keep in (1 << 16, 0):
        monkeypatch.setattr(lattice, "_KEEP_EDGES", keep)
        got = lattice.log_probabilities(ws, pieces)
        assert np.allclose(np.exp(got), [brute_probability(w, p) for w in ws])
        counts = lattice.expected_counts(ws, [1, 2, 1, 1, 5, 3], pieces)
        assert math.isclose(sum(c * len(x) for c, x in zip(counts, p, strict=True)), 5 + 2 * 2 + 4 + 9)


def test_scores_by_broadcast_and_by_join_are_the_same(spark):
    vocabulary = ([b" a", b" b", b"a", b"b", *[bytes([x]) for x in range(256) if x not in b"ab"]], None)
    vocabulary = (vocabulary[0], np.full(len(vocabulary[0]), 1 / len(vocabulary[0])))
    texts = [*ODD, *[" ".join(words(30, k, 40)) for k in range(30)]]
    d = table(spark, texts)
    model = lm_score.train(d, F.col("doc_id") % 3 != 0, vocabulary, rounds=1)
    seen = {}
    for k, t in enumerate(texts):
        for w in [*(t or "").encode().lower().split(), b""]:
            seen[w] = seen.get(w, 0) + (k % 3 != 0)
    n, v = sum(seen.values()), sum(c > 0 for c in seen.values())
    assert (model.n_tokens, model.n_types) == (n, v)
    found = lm_score.word_scores(model).collect()
    scores, mixed = ({bytes(r.word): r[c] for r in found} for c in ("log_p", "log_mix"))
    pieces = dict(zip(model.pieces, np.exp(model.log_p), strict=True))
    whole = n / (n + v)
    for w in (b"w1", b"one", b"a"):
        assert math.isclose(math.exp(scores[w]), brute_probability(b" " + w, pieces), rel_tol=1e-9)
        assert math.isclose(math.exp(mixed[w]), whole * seen[w] / n + (1 - whole) * brute_probability(b" " + w, pieces), rel_tol=1e-9)
    for hot in (0, 3, 10**6):
        got = lm_score.score(d, model, hot_words=hot)
        assert got.columns[: len(d.columns)] == d.columns
        for r in got.collect():
            found = [*(r.text or "").encode().lower().split(), b""]
            assert r["__n_tokens"] == len(found) and r["__n_known"] == sum(seen[w] > 0 for w in found)
            assert math.isclose(r["__base"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in found), rel_tol=1e-9)
            assert math.isclose(r["__score"], sum(scores[w] for w in found) / math.log(10), rel_tol=1e-9)
            assert math.isclose(r["__mixture"], sum(mixed[w] for w in found) / math.log(10), rel_tol=1e-9)
    assert lm_score.score(d.where("false"), model).count() == 0
    empty = lm_score.train(d, F.lit(False), vocabulary, rounds=1)
    assert empty.n_tokens == 0 and lm_score.score(d, empty).count() == len(texts)


def test_score_is_the_forward_recursion_over_the_whole_text(spark):
    vocabulary = ([b" a", b"ab", b" ab", *[bytes([x]) for x in range(256)]], None)
    vocabulary = (vocabulary[0], np.full(len(vocabulary[0]), 1 / len(vocabulary[0])))
    d = spark.createDataFrame([(1, "abab a"), (2, "aab  ab\tb"), (3, "ba")], "doc_id long, text string")
    model = lm_score.train(d, F.lit(True), vocabulary, rounds=2)
    pieces = dict(zip(model.pieces, np.exp(model.log_p), strict=True))
    for text, got in rows(lm_score.score(d, model), "text", "__score"):
        # one lattice for the whole text; pieces hold a blank at their start only
        whole = b"".join(b" " + w for w in text.encode().split())
        assert math.isclose(10**got, brute_probability(whole, pieces) * model.end, rel_tol=1e-9)


def test_probabilities_of_all_short_texts_sum_to_at_most_one(spark):
    vocabulary = ([b" x", b"x", b" y"], np.array([0.5, 0.2, 0.3]))
    d = spark.createDataFrame([(1, "x y"), (2, "x"), (3, "xx x")], "doc_id long, text string")
    model = lm_score.train(d, F.lit(True), vocabulary, rounds=2)
    every = [""]
    level = ["x", "y", "xx", "yx", "xxx", "yxx"]
    every += level + [f"{a} {b}" for a in level for b in level] + [f"{a} {b} {c}" for a in level for b in level for c in level]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(every)], "doc_id long, text string")
    known = lm_score.train(d.union(t), F.lit(False), vocabulary, rounds=0)
    total = sum(10 ** r["__score"] for r in lm_score.score(t, lm_score.Model(lm_score.count_words(d.select("text", F.lit(True).alias("is_train")).union(t.select("text", F.lit(False)))), model.pieces, model.log_p, model.end, model.n_tokens, model.n_types)).collect())
    assert known.n_tokens == 0 and 0.3 < total <= 1 + 1e-9


# -- near duplicates ----------------------------------------------------------------------------


def test_near_duplicates_against_brute_force(spark):
    base, chain = words(60, 11), [words(80, 12)]
    for k in range(12):
        chain.append(near_copies(chain[-1], 1, k))
    texts = [*ODD, *[" ".join(near_copies(base, k % 4, k)) for k in range(40)], *[" ".join(c) for c in chain], *[" ".join(words(40, 100 + k)) for k in range(30)]]
    passage = words(30, 13)
    texts += [" ".join([*words(25, 200 + k), *passage]) for k in range(20)]
    texts += ["A b C d", "a b c d", "a b c d e"]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    texts = [texts[k] for k in order]
    for rounds in (2, 0):
        got = ngram_jaccard.near_duplicates(table(spark, texts).repartition(3), star_rounds=rounds)
        found = sorted(rows(got, "doc_id", "n_shingles", "component_id"))
        assert found == [(k, len(shingle_set(t)), c) for k, (t, c) in enumerate(zip(texts, components(texts), strict=True))]
    assert ngram_jaccard.near_duplicates(table(spark, texts).where("false")).count() == 0


def test_near_duplicates_in_many_blocks_with_hot_shingles(spark, monkeypatch):
    for name, value in (("ENTRIES", 64), ("MIN_HOT", 6), ("HOT_SHARE", 20), ("HOT_PARTS", 3), ("_PACK", 500)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    base = words(60, 11)
    texts = [*ODD, *[" ".join(near_copies(base, k % 5, k)) for k in range(40)], *[" ".join([*words(9, 300 + k), *words(40, 9)]) for k in range(12)]]
    got = ngram_jaccard.near_duplicates(table(spark, texts).repartition(3))
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id")) == [(k, len(shingle_set(t)), c) for k, (t, c) in enumerate(zip(texts, components(texts), strict=True))]


def test_near_copies_go_row_by_row(spark):
    a, b = words(80, 1), words(80, 2)
    copy = " ".join(near_copies(a, 1, 3))
    data = [(1, " ".join(a)), (2, copy), (2, " ".join(b)), (None, " ".join(words(80, 4))), (None, " ".join(near_copies(words(80, 4), 1, 5))), (7, "same"), (7, "same"), (None, None), (None, None)]
    d = spark.createDataFrame([(k, t, "clash", "clash", "clash") for k, t in data], "doc_id long, text string, th string, __rid string, cls string")
    got = ngram_jaccard.drop_near_duplicates(d)
    assert got.columns == d.columns
    left = sorted(rows(got, "doc_id", "text"), key=str)
    assert (1, " ".join(a)) in left and (2, " ".join(b)) in left and (2, copy) not in left
    assert [k for k, _ in left].count(7) == 1 and left.count((None, None)) == 2 and len(left) == 6
    assert ngram_jaccard.drop_near_duplicates(d.where("false")).count() == 0


def test_sketch_and_prefix_lengths():
    for n in range(1, 200):
        probe, index = ngram_jaccard.prefix_lengths(n, 80)
        assert probe == n - math.ceil(0.8 * n - 1e-9) + 1 and index == n - math.ceil(160 * n / 180 - 1e-9) + 1


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 12), (20, 21), (7, 7), (None, 1), (5, 4)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 201 + k) for k in range(50)]
    got = dict(rows(cc.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {**{k: 3 for k in (3, 4, 5, 9, 12)}, 20: 20, 21: 20, **{100 + k: 100 for k in range(41)}, **{200 + k: 200 for k in range(51)}}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- language -----------------------------------------------------------------------------------


def test_language_accuracy_and_odd_texts(spark):
    r = random.Random(2)
    said = {"aa": ["bato", "keli", "monu", "zaki"], "bb": ["strh", "grmf", "plsk", "thrz"], "cc": ["éoui", "àuèe", "ïoëa", "ùaéi"]}
    data = [(k, " ".join(r.choice(said[lang]) for _ in range(3 + k % 20)), lang) for k, lang in enumerate(list(said) * 80)]
    d = spark.createDataFrame([*data, (900, None, "aa"), (901, "unlabelled", None)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(d), max_train=150)
    assert model.languages == ["aa", "bb", "cc"] and 0.2 < model.temperature <= 20
    got = language_id.predict(d.where("doc_id < 900"), model).where(language_id.held_out())
    assert all(x == y for x, y in rows(got, "lang", "__lang")) and all(0 <= s <= 1 for (s,) in rows(got, "__score"))
    odd = language_id.predict(table(spark, [None, "", "123 --", "x" * 200_000]), model)
    assert [x for (x,) in rows(odd.orderBy("doc_id"), "__lang")][:3] == ["und"] * 3
    none = language_id.train(d.where("false"))
    assert rows(language_id.predict(d, none).select("__lang").distinct(), "__lang") == [("und",)]


def test_temperature_and_ftrl():
    z = np.array([[2.0, 0.0], [2.0, 0.0], [2.0, 0.0], [0.0, 2.0]])
    t = language_id.fit_temperature(z, np.array([0, 0, 1, 1]))
    loss = lambda t: float(np.mean(np.log(np.exp(z / t).sum(1)) - (z / t)[range(4), [0, 0, 1, 1]]))
    assert loss(t) <= min(loss(x) for x in (0.5, 1.0, 3.0, 10.0)) + 1e-9
    w, _ = language_id.fit_ftrl([(k % 2, np.array([k % 2]), np.array([1.0])) for k in range(200)], 2, l1=0.01)
    assert w[0, 0] > 0 > w[0, 1] and (w[2:] == 0).all()


# -- licences -----------------------------------------------------------------------------------


def test_license_scan_against_brute_force(spark):
    full = dict((n, t) for n, t in license_scan.TEMPLATES if len(t) > 400)
    texts = [*ODD, "some words\nLicensed under the Apache License, Version 2.0.\nmore", full["MIT"], "intro\n\n" + full["ISC"] + "\n\nend", "this is under no license at all", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "RELEASED UNDER THE MIT LICENSE"]

    def brute(text):
        units = [u for u in dict.fromkeys([text or "", *((text or "").split("\n\n") if "\n\n" in (text or "") else []), *(text or "").split("\n")]) if u]
        hits = []
        for u in units:
            a = set(license_scan.bigram_set(u))
            for name, t in license_scan.TEMPLATES:
                b = set(license_scan.bigram_set(t))
                if a and b and 2 * len(a & b) / (len(a) + len(b)) >= license_scan.THRESHOLD:
                    hits.append(name)
        return len(units), len(hits), ",".join(sorted(set(hits)))

    got = rows(license_scan.scan_licenses(table(spark, texts)).orderBy("doc_id"), "n_units", "n_matches", "licenses")
    assert got == [brute(t) for t in texts] and sum(bool(g[2]) for g in got) == 5
    assert license_scan.scan_licenses(table(spark, texts).where("false")).count() == 0


# -- BPE ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def public():
    try:
        return queries.tokenizers()
    except OSError:
        pytest.skip("no vocabulary files")


def test_bpe_is_the_library_s(spark, public):
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path(queries.BPE_RANKS)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = [*ODD, "I'll we've 1234 \n\n  x\t\r\n", "<|endoftext|>", "a" * 20000, "ẞ🏽‍👩 中文字", "\U00012bb1\U0003aaffA", *["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x400, 0xD000), r.randrange(0x10000, 0x20000)])) for _ in range(80)) for _ in range(60)]]
    got = bpe.token_digests(table(spark, texts), path, public.PATTERN)
    for i, n, ids, back in rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"):
        want = np.array(library.encode_ordinary(texts[i] or ""), "<u4")
        assert n == len(want) and ids == hashlib.sha256(want.tobytes()).hexdigest() and back == hashlib.sha256((texts[i] or "").encode()).hexdigest()
    assert bpe.token_digests(table(spark, texts).where("false"), path, public.PATTERN).count() == 0


def test_perfect_hash_and_cache(monkeypatch):
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h.place, keys)) == list(range(3000))
    v = bpe.Vocabulary({**{bytes([b]): b for b in range(256)}, b"ab": 256, b"abc": 257, b"bc": 258})
    monkeypatch.setattr(bpe, "CACHE_BYTES", 300)
    e = bpe.Encoder(v, r"\S+|\s+")
    for t in ("abc abcd bcab", "x", ""):
        assert e.decode(e.encode(t)) == t.encode() and len(e) <= 2
    assert v.merge(b"abcd") == [257, 100] and v.rank(b"zz") == -1


# -- WARC ---------------------------------------------------------------------------------------


def test_warc_round_trip_rejects_magic_in_payloads(spark, monkeypatch):
    fake = "text\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [None, "", "plain", fake, "é" * 50, "plain", "WARC/1.1\r\n", "x" * 3000, fake + "y", "plain"]
    d = spark.createDataFrame([(k, f"http://x/{k}\n" if k % 2 else None, b, "clash") for k, b in enumerate(bodies)], "page_id long, url string, html string, digest string")
    for block in (4 << 20, 300, 64):
        monkeypatch.setattr(warc, "BLOCK", block)
        plan = warc.plan_records(d)
        path = warc.write_warc(plan, warc.new_path(spark, "t"))
        got = sorted(rows(warc.read_warc(spark, path, block), "page_id", "record_type", "refers_to", "payload_bytes", "digest", "declared"))
        want = []
        for k, b in enumerate(bodies):
            raw = (b or "").encode()
            first = min(j for j, c in enumerate(bodies) if (c or "") == (b or ""))
            sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            want.append((str(k), "response" if first == k else "revisit", None if first == k else str(first), len(raw), sha, sha))
        assert got == sorted(want)
    out = warc.round_trip(d)
    assert out.count() == len(bodies) and dict(out.dtypes)["refers_to"] == "bigint"
    assert warc.round_trip(d.where("false")).count() == 0
    assert rows(warc.round_trip(d.where("page_id in (2, 5)"), min_bytes=100), "record_type") == [("response",)] * 2


def test_damaged_archive_ends_at_the_damage():
    one = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    found = warc.candidates(one + one + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nab")
    assert [(c[0], c[1]) for c in found] == [(0, len(one)), (len(one), 2 * len(one))]


def test_contamination_of_one_short_document(spark):
    item = words(12, 7)
    index = decontaminate.Index(10)
    index.add("i", " ".join(item).encode())
    index.finish()
    for k in range(13):
        ids = np.array([index.vocabulary[w.encode()] for w in item[:k]], np.int32)
        hit, docs, items = index.scan(ids, np.array([k]))
        assert hit.sum() == (k if k >= 10 else 0) and len(docs) == len(items) == (k >= 10)
    b = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    for k in (0, 6, 8, 10):
        got = decontaminate.contamination(table(spark, [" ".join(item[:k])]).coalesce(1), b)
        assert rows(got, "n_words", "n_hit") == [(k, k if k >= 10 else 0)]


def test_license_scan_of_notices_inside_other_text(spark):
    full = dict((n, t) for n, t in license_scan.TEMPLATES if len(t) > 400)
    code = [f"def f{k}(x):\n    return x + {k}" for k in range(30)]

    def paragraphs(name, size=45, gap="\n\n"):
        w = full[name].split(" ")
        return gap.join(" ".join(w[k : k + size]) for k in range(0, len(w), size))

    texts = [
        *ODD,
        "\n".join([*code, paragraphs("MIT"), *code]),
        "\r\n".join([*code, paragraphs("Apache-2.0", gap="\r\n\r\n"), *code]),
        "# " + paragraphs("ISC", 9, "\n# ") + "\n" + "\n".join(code),
        "\n".join([*code, "This work is licensed under a Creative Commons", "Attribution 4.0 International License. And more."]),
        "prose before, released under the MIT License, prose after it",
        "\n".join([*code, paragraphs("MIT")[:500], *code]),
        "released under, released under, released under the MIT, the MIT",
        "\n\n".join([paragraphs("BSD-3-Clause"), *code, paragraphs("Zlib"), *code]),
        "the gnu " * 40 + "this work is licensed under " + "the gnu " * 60 + "the gnu general public license version 3 " + "end " * 9,
    ]

    def brute(text):
        t_ = text or ""
        units = [u for u in dict.fromkeys([t_, *(t_.split("\n\n") if "\n\n" in t_ else []), *t_.split("\n")]) if u]
        sets = [set(license_scan.bigram_set(u)) for u in units]
        low = [w.lower() for w in license_scan.re.findall(license_scan.WORD, t_)]
        grams = [f"{a} {b}" for a, b in zip(low, low[1:], strict=False)]
        hits = []
        for name, t in license_scan.TEMPLATES:
            b = set(license_scan.bigram_set(t))
            found = [d for d in (2 * len(a & b) / (len(a) + len(b)) for a in sets) if d >= license_scan.THRESHOLD]
            if not found and len(b & set(grams)) >= 0.8 * len(b):
                best = 0.0
                for i in range(len(grams)):
                    seen, same = set(), 0
                    for gram in grams[i:]:
                        same += gram in b and gram not in seen
                        seen.add(gram)
                        best = max(best, 2 * same / (len(seen) + len(b)))
                found = [best] if best >= license_scan.THRESHOLD else []
            hits += [(-d, name) for d in found]
        best = min(hits, default=(None, None))
        return len(units), len(hits), ",".join(sorted({n for _, n in hits})), best[1], best[0] and round(-best[0], 9)

    got = rows(license_scan.scan_licenses(table(spark, texts)).orderBy("doc_id"), "n_units", "n_matches", "licenses", "best_license", "best_dice")
    assert [(*g[:4], g[4] and round(g[4], 9)) for g in got] == [brute(t) for t in texts]
    said = [g[2] for g in got[len(ODD) :]]
    assert said[:7] == ["MIT", "Apache-2.0", "ISC", "CC-BY-4.0", "MIT", "", ""] and "Zlib" in said[7] and "GPL-3.0" in said[8]


def test_lm_score_of_documents_that_training_did_not_see(spark):
    vocabulary = ([bytes([b]) for b in range(256)] + [b" " + bytes([b]) for b in range(97, 123)], np.full(282, 1 / 282))
    d = table(spark, ["alpha beta beta", "beta gamma", "delta epsilon alpha", "zeta zeta eta", "", None])
    old, new = d.where("doc_id < 2"), d.where("doc_id >= 2")
    both = lm_score.train(d, F.col("doc_id") < 2, vocabulary, rounds=1)
    alone = lm_score.train(old, F.lit(True), vocabulary, rounds=1)
    columns = ("doc_id", "__n_tokens", "__n_known", "__base", "__score", "__mixture")
    want = sorted(rows(lm_score.score(new, both), *columns))
    for hot in (1, 500_000):
        got = sorted(rows(lm_score.score(new, alone, hot_words=hot), *columns))
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want])
    assert [w[1:3] for w in want] == [(4, 2), (4, 1), (1, 1), (1, 1)]
