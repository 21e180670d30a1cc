"""The corpus operators against brute force, round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harborlight.llm import common, labelled, textscan
from harborlight.llm import op01_token_counts as op1
from harborlight.llm import op02_byte_bpe as op2
from harborlight.llm import op03_token_files as op3
from harborlight.llm import op04_toxicity_chain as op4
from harborlight.llm import op05_url_filters as op5
from harborlight.llm import op06_ngram_jaccard as op6
from harborlight.llm import op07_best_fit_packing as op7
from harborlight.llm import op08_avi_mjpeg as op8
from harborlight.llm import op09_embedding_dedup as op9
from harborlight.llm import op10_quality_nbsvm as op10

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids int, n int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD_TEXTS = [None, "", " ", "\n\t", "a", "a b", "a  b \n c's", "one two three four five", "One TWO three four five", LONG, "é漢😀  x", "<|endoftext|> x", "tail ", " head", "x\x85y"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names clash."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 7, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[7], (None, "one two three four five", None, None, None, None, 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 1)]
    parent = list(range(2000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_word_scan():
    texts = ["Ab  c\nd", "", None, "xé", " lead", "tail "]
    for lo, hi, buf, off in textscan.blocks(pa.array(texts)):
        start, end, row = textscan.words(buf, off)
        got = [[bytes(buf[a:b]) for a, b, r in zip(start, end, row, strict=True) if r == i] for i in range(hi - lo)]
        assert got == [(t or "").encode().split() for t in texts]


# ---- 1 ------------------------------------------------------------------------------------------------------


def test_rollup_is_idempotent(spark):
    roll = op1.TokenRollup(spark, common.fresh_path(spark, "t"))
    rows = spark.createDataFrame([("a", "en", "v1", 3), (None, "en", "v1", 4), ("a", "en", "v1", 3)], "source string, lang string, tokenizer string, n_tokens long")
    new = rows.withColumn("tokenizer", F.lit("v2")).withColumn("n_tokens", F.col("n_tokens") + 1)
    assert roll.totals().count() == 0
    assert roll.apply("b1", op1.insert(rows)) and not roll.apply("b1", op1.insert(rows))
    assert roll.apply("b2", op1.revise(rows, new)) and roll.apply("b3", op1.delete(new.limit(0)))
    want = {("a", "v2", 2, 8), (None, "v2", 1, 5)}
    see = lambda: {(r.source, r.tokenizer, r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert see() == want
    roll.compact()
    assert see() == want and not roll.apply("b2", op1.insert(rows))
    roll.apply("b4", op1.delete(new))
    roll.compact()
    assert see() == set()


def test_cut_off_batch_is_written_anew(spark):
    roll = op1.TokenRollup(spark, common.fresh_path(spark, "t"))
    rows = spark.createDataFrame([("a", "en", "v1", 3)], "source string, lang string, tokenizer string, n_tokens long")
    roll.apply("b1", op1.insert(rows))
    common.delete_path(spark, f"{roll.folder}/batch-b1/_SUCCESS")
    assert roll.totals().count() == 0
    assert roll.apply("b1", op1.insert(rows)) and roll.totals().first().n_docs == 1


def test_rollup_ledger(spark):
    """Names outlive totals of nothing, and totals read before a compaction can still be read after it."""
    rows = spark.createDataFrame([("s", "en", "v1", 3), (None, None, "v1", 0)], "source string, lang string, tokenizer string, n_tokens long")
    roll = op1.TokenRollup(spark, common.fresh_path(spark, "t"))
    for b in ("b1", "b2"):
        assert roll.apply(b, op1.insert(rows.limit(0)))
    roll.compact()
    assert not roll.apply("b1", op1.insert(rows)) and not roll.apply("b2", op1.insert(rows)) and roll.totals().count() == 0
    assert roll.apply("b3", op1.insert(rows))
    before = roll.totals()
    roll.compact()
    roll.compact()
    assert sorted(map(tuple, before.collect()), key=str) == sorted(map(tuple, roll.totals().collect()), key=str) and before.count() == 2
    assert roll.apply("b4", op1.delete(rows))
    roll.compact()
    assert roll.totals().count() == 0 and not any(roll.apply(f"b{i}", op1.insert(rows)) for i in range(1, 5))
    assert sorted(r.batch for r in roll.ledger(3).collect()) == ["b1", "b2", "b3", "b4"]



# ---- 2, 3 ---------------------------------------------------------------------------------------------------


def library():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=op2.load_ranks(path), special_tokens={})


def test_bpe_equals_library():
    path, pattern, enc = library()
    words = op2.word_table(path, pattern)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "'s", "'ll", "é", "漢", "😀", "0", ".", "the", "THE", "\t"]) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["a" * k for k in range(60)] + [" " * k + "x" + " " * k for k in range(9)] + [t or "" for t in ODD_TEXTS]
    flat, count = words.encode(pa.array(texts))
    got = [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]
    assert got == [enc.encode_ordinary(t) for t in texts]


def test_bpe_query(spark, docs, odd, none):
    path, pattern, enc = library()
    for df in (docs, odd):
        out = op2.decode(op2.encode(df, path, pattern), path)
        assert out.columns[:1] == ["doc_id"] and "ids" in out.columns
        texts = sorted((r.text or "") for r in df.select("text").collect())
        rows = out.collect()
        assert sorted(bytes(r.decoded).decode() for r in rows) == texts
        assert sorted(r.ids for r in rows) == sorted(enc.encode_ordinary(t) for t in texts)
    assert op2.decode(op2.encode(none, path, pattern), path).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 20_000))
    tree = op3.PerfectHash.build(keys)
    assert sorted(tree.slots(keys)) == list(range(len(keys))) and len(tree.to_bytes()) * 8 < 4 * len(keys)
    index = op3.Index(op3.index_bytes(keys, keys % 5, keys % 1000, keys % 70))
    found, shard, offset, count = index.lookup(keys)
    assert found.all() and (shard == keys % 5).all() and (offset == keys % 1000).all() and (count == keys % 70).all()
    assert index.lookup(keys + 1)[0].mean() < 1e-3
    assert not op3.Index(op3.index_bytes(keys[:0], keys[:0], keys[:0], keys[:0])).lookup(keys[:3])[0].any()


def test_token_files(spark, docs, odd, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(docs.select("doc_id", "text").collect())
    ids = [e.ids + [0] for e in tok.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    start = np.cumsum([0, *map(len, ids)])
    want = {(r.doc_id, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x, s in zip(rows, ids, start, strict=False)}
    assert set(map(tuple, op3.op3_token_files(spark, DIR).collect())) == want
    for df, n in ((odd, len(ODD_TEXTS)), (none, 0)):
        folder = common.fresh_path(spark, "f")
        manifest = op3.write_files(df, folder, lambda: op3.library_table(P.path("byte_bpe_50k.json")))
        index = op3.write_index(manifest, folder)
        got = op3.digests(op3.read_keys(df.select("doc_id").distinct(), manifest, index, folder)).collect()
        assert len({r.doc_id for r in got}) == n == len(got)
    strange = spark.createDataFrame([(10**9,)], "doc_id long")
    assert not op3.read_keys(strange, manifest, index, folder).where("found").count()
    with pytest.raises(Exception, match="KeyError"):
        op3.read_keys(strange, manifest, index, folder, strict=True).collect()


def test_token_files_of_repeated_keys(spark, monkeypatch):
    """Few keys over many buckets: every key is found and leads to its first text."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(op3, "BUCKET_KEYS", 2)
    rows = [(7, "same text")] * 9 + [(None, f"none {i}") for i in range(9)] + [(8, "another one"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = common.fresh_path(spark, "f")
    manifest = op3.write_files(df, folder, lambda: op3.library_table(P.path("byte_bpe_50k.json")))
    index = op3.write_index(manifest, folder)
    assert index.first().buckets == 10 > index.count()
    got = op3.digests(op3.read_keys(df.select("doc_id").distinct(), manifest, index, folder, strict=True)).collect()
    plain = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows if k}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == {(k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in plain.items()}


def test_token_files_refuse_wide_ids(spark):
    class Wide:
        def encode(self, texts):
            return np.full(len(texts), 70_000, np.int64), np.ones(len(texts), np.int64)

    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit 2 bytes"):
        op3.write_files(df, common.fresh_path(spark, "f"), Wide)
    assert op3.write_files(df, common.fresh_path(spark, "f"), Wide, width=4).first().n_ids == 2


# ---- 4, 10 --------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, docs, odd, none):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    got = op4.op4_toxicity_chain(spark, DIR).withColumnRenamed("toxic", "said").join(labels, "doc_id").where("held_out")
    n, right = got.count(), got.where("said = toxic").count()
    assert right / n > 0.93
    assert op4.toxicity(odd, labels).count() == odd.count() and op4.toxicity(none, labels).count() == 0
    assert {r.p_toxic for r in op4.toxicity(odd, labels.limit(0)).collect()} == {0.5}


def test_chain_feeds_later_models():
    rng = np.random.default_rng(0)
    n = 600
    first = rng.integers(0, 2, n)
    x = op4.Rows(np.concatenate([np.flatnonzero(first), np.arange(n)]), np.concatenate([np.zeros(int(first.sum()), int), 1 + rng.integers(0, 5, n)]), (n, 6))
    y, folds, dense, models = first.astype(float), np.arange(n) % 5, np.zeros((n, 0)), []
    for _ in range(2):
        models.append(op4.fit_one(x, dense, y, folds, -1)[0])
        odds = np.zeros(n)
        for f in range(5):
            _, own, odds[own] = op4.fit_one(x, dense, y, folds, f)
        dense = np.column_stack([dense, odds])
    assert len(models[0]) == 7 and len(models[1]) == 8 and models[1][6] > 0


@pytest.mark.parametrize("seed", range(3))
def test_logistic_against_dense_newton(seed):
    """The sparse solver against plain Newton steps on dense matrices."""
    rng = np.random.default_rng(seed)
    n, d = 120, 9
    on, extra = rng.random((n, d)) < 0.3, rng.normal(size=(n, 1))
    y = (rng.random(n) < 1 / (1 + np.exp(-(on @ rng.normal(size=d) + extra[:, 0])))).astype(float)
    got = op4.logistic(op4.Rows(*np.nonzero(on), (n, d)), extra, y)
    full = np.column_stack([on.astype(float), extra, np.ones(n)])
    push = np.array([op4.RIDGE] * d + [1e-3, 1e-3])
    w = np.zeros(d + 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(full @ w)))
        w = w - np.linalg.solve(full.T * (p * (1 - p)) @ full + np.diag(push), full.T @ (p - y) + push * w)
    assert np.abs(got - w).max() < 0.02
    assert np.abs(op4.log_odds(op4.Rows(*np.nonzero(on), (n, d)), extra, got) - full @ w).max() < 0.05


def test_byte_runs():
    text = "Ab\tcdef g"
    got = [(k, r) for _, _, keys, rows in op4.byte_runs(pa.array([text, None, "abc"])) for k, r in zip(keys.tolist(), rows.tolist(), strict=True)]
    plain = text.lower().replace("\t", " ").encode()
    want = [(int.from_bytes(plain[i : i + m], "little") | m << 56, 0) for m in op4.SIZES for i in range(len(plain) - m + 1)]
    assert sorted(got) == sorted(want)


def toxic_corpus(spark, words):
    """300 clean and 100 toxic documents; every toxic one has two words of one of the lists in turn."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text = [f"wort{rng.randrange(300)}x" for _ in range(20)]
        if i < 100 and words:
            text[3:5] = rng.sample(words[i % len(words)], 2)
        rows.append((i, " ".join(text), int(i < 100), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, half int")
    return docs, docs.select("doc_id", "toxic")


def test_themes_come_from_the_labels(spark):
    docs, labels = toxic_corpus(spark, [["blödkopf", "trottel", "depp"], ["cretino", "scemo", "buffone"]])
    got = op4.toxicity(docs, labels).where(~labelled.held_out() | (F.col("doc_id") < 100)).collect()
    mean = lambda c, toxic, half: np.mean([r[f"p_{c}"] for r in got if r.toxic == toxic and r.half == half])
    first = 0 if mean("theme_1", 1, 0) > 0.5 else 1
    for c, half in (("theme_1", first), ("theme_2", 1 - first)):
        assert mean(c, 1, half) > 0.7 and mean(c, 1, 1 - half) < 0.2 and mean(c, 0, half) < 0.2
    sample = labelled.labelled_sample(docs, labels, "toxic", 1000).selectExpr("doc_id", "text", "cast(label as double) toxic")
    models = op4.fit(sample)[1]
    assert len(models) == 3 and (models[2][-3:-1] > 0).all()


def test_toxicity_without_themes(spark):
    docs, labels = toxic_corpus(spark, [])
    assert len({r.p_theme_1 for r in op4.toxicity(docs, labels).collect()} | {r.p_theme_2 for r in op4.toxicity(docs, labels).collect()}) == 1
    x = op4.Rows(np.repeat(np.arange(20), 2), np.tile([0, 1], 20), (60, 2))
    toxic = (np.arange(60) < 25).astype(float)
    got = op4.themes(x, toxic)
    assert (got[:20, 0] == 1).all() and (got[:20, 1] == 0).all() and np.isnan(got[20:25]).all() and (got[25:] == 0).all()


def test_quality_held_out(spark, docs, odd, none):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    got = op10.op10_quality_nbsvm(spark, DIR).join(labels, "doc_id").where("held_out")
    good, poor = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("predicted = 1").count() / good.count() > 0.93 and poor.where("predicted = 0").count() / max(1, poor.count()) > 0.7
    out = op10.quality_scores(odd, labels)
    assert out.columns == odd.columns + ["score"] and out.where("score between 0 and 1").count() == odd.count()
    assert op10.quality_scores(none, labels).count() == 0
    assert {r.score for r in op10.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    f = [np.unique(np.concatenate([[int(v)], rng.integers(2, 50, 8)])) for v in y]
    w, bias, a, b = op10.fit_nbsvm(f, y, 64)
    p = [labelled.sigmoid(a * (w[x].sum() / np.sqrt(len(x)) + bias) + b) for x in f]
    assert ((np.array(p) > 0.5) == (y == 1)).mean() > 0.97


def test_words_are_learnt_many_to_a_text():
    import public_tokenizers

    words = [" alpha", "beta", " \u00fcber", " it's", " 12,5", " \u65e5\u672c", " x", "gamma", " alpha!"] + [f" w{i}" for i in range(1200)]
    calls = []
    table = op3.library_table(public_tokenizers.path("byte_bpe_50k.json"))
    names = {w: table.learn([w])[0] for w in words}
    learn = lambda texts: calls.append(len(texts)) or table.learn(texts)
    assert table.words(words) == [names[w] for w in words]
    spelt = table.words.__closure__ and next(c.cell_contents for c in table.words.__closure__ if hasattr(c.cell_contents, "dtype"))
    assert op3.joined(words, learn, spelt) == [names[w] for w in words] and sum(calls) < 10
    assert op3.joined([], table.learn, spelt) == []
    assert op3.joined(words, table.learn, spelt + 1) == [names[w] for w in words]  # bytes that don't fit: each by itself


# ---- 5 ------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.com/en/1", None), (2, "https://EXAMPLE.com/en/7x?q", None), (3, "http://www.a.com/en/1.html", None), (4, "https://b.xyz/page", link.format("https://a.com/en/1")),
        (5, "https://c.xyz/p", link.format("https://b.xyz/page")), (6, None, None), (7, "no address", None), (8, "https://x.example.com/en/7", link.format("https://d.xyz/")), (9, "https://d.xyz", '<meta http-equiv="refresh" content="0; url=https://a.com/en/1">'),
        (10, "https://e.xyz/?://com/en/", ""), (11, "https://n.net/de/8", None), (11, "https://n.net/de/8", None), (12, "https://m.example.net/de/80", None), (13, "https://com/en/", None), (14, "https://xcom/en/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op5.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), op5.RULES).collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block") and got[3][3] == "block"
    assert got[2] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[8][3] == "allow" and got[9][3] == "allow" and got[4][3] == "allow" and got[5][3] == "allow"  # one component with an allowed page
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[10][0] == "e.xyz"
    assert got[11][2] == "net/de/" and got[12][2] == "example.net/de/8" and got[13][2] == "com/en/" and got[14][2] is None


def test_rule_words_are_those_of_the_contract(spark):
    urls = ["https://a.com/en/1", "https://example.com/en/7", "https://a.net/de/1", "https://example.net/de/7", "https://example.net/de/8", "https://a.org/es/"]
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = [(r.rule, r.verdict) for r in sorted(op5.judge(rows, op5.RULES).collect())]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def test_block_reaches_aliases(spark):
    rows = [(1, "https://bad.com/en/1", None), (2, "https://x.xyz/a", '<link href="https://bad.com/en/1" rel="canonical">'), (3, "https://y.xyz/b", None), (4, "https://z.xyz", None)]
    redirects = spark.createDataFrame([("https://y.xyz/b", "https://x.xyz/a")], "source string, target string")
    got = {r.page_id: r.verdict for r in op5.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), op5.RULES, redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}
    assert op5.judge(spark.createDataFrame([], "page_id long, url string, html string"), op5.RULES).count() == 0


def test_every_link_joins(spark):
    bad, canon = "https://bad.com/en/1", '<link rel="canonical" href="{}">'
    blocked = [
        canon.format("https://o.xyz/1") + canon.format(bad),  # the second canonical link
        '<meta http-equiv="refresh" content="0; url=https://o.xyz/2"><META content="5;URL=\'https://bad.com/en/1\'" http-equiv=Refresh>',
        '<meta content="0;url=https://bad.com/en/1" http-equiv="refresh">',
        "<meta http-equiv=refresh content='3, https://bad.com/en/1'>",
        '<link href="https://bad.com/en/1" data-x="1" rel="alternate canonical">',
        canon.format("//BAD.com/en/1?x=http://o.xyz"),
        '<base href="https://bad.com/en/"><link rel=canonical href=1>',
        canon.format("https://bad.com/en/2/../1"),
        '<meta http-equiv="refresh" content="0; url="https://bad.com/en/1"">',
    ]
    rows = [(0, bad, None), *((i, f"https://x{i}.xyz/p", h) for i, h in enumerate(blocked, 1))]
    rows += [(50, "https://n.com/en/a/b.html", None), (51, "https://shop.org/q/r/s", canon.format("next.html") + canon.format("../t")), (52, "https://shop.org/q/r/next", canon.format("//n.com/en/a/b")), (53, "https://shop.org/q/t", None)]
    rows += [(60, "https://q.xyz", '<link rel="canonical" href="..">'), (61, "https://w.xyz/p", canon.format("/r?u=https://bad.com/en/1") + canon.format("mailto:x@bad.com") + canon.format("#a") + '<meta http-equiv="refresh" content="5"><link rel="next" href="https://bad.com/en/1">')]
    got = {r.page_id: r.verdict for r in op5.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), op5.RULES).collect()}
    assert {i for i, v in got.items() if v == "block"} == {*range(len(blocked) + 1), 50, 51, 52, 53}


# ---- 6 ------------------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n, words=300):
    rng = random.Random(seed)
    base = [[f"t{rng.randrange(5000)}" for _ in range(rng.randint(3, words))] for _ in range(n)]
    shared = [f"p{i}" for i in range(60)]
    out = []
    for i, b in enumerate(base):
        out.append(list(b))
        for _ in range(rng.choice([0, 0, 1, 6])):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(c) // 25))):
                c[rng.randrange(len(c))] = f"e{rng.randrange(10**6)}"
            out.append(c)
        if i % 3 == 0:
            out[-1] = shared + out[-1]
        if i % 7 == 0:
            out.append(shared + [f"z{i}"] * rng.randint(0, 9))
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(spark, seed):
    rows = near_copies(seed, 60)
    got = op6.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(map(tuple, got.collect())) == brute_classes(rows)


def test_no_leaders(spark, monkeypatch):
    monkeypatch.setattr(op6, "LEADERS", 0)
    rows = near_copies(9, 50, 80)
    assert set(map(tuple, op6.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_classes(rows)


def test_jaccard_odd(spark, odd, none):
    got = {tuple(r) for r in op6.similar_classes(odd).collect()}
    assert got == brute_classes([(i, t) for i, t in enumerate(ODD_TEXTS)])
    assert op6.similar_classes(none).count() == 0
    kept = op6.one_of_each(spark, odd, DIR)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id is null").count() == 1


def test_texts_of_one_id(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (5, text("b").upper()), (1, text("a") + " more"), (2, text("b") + " more"), (6, text("c")), (6, text("d")), (6, text("d")), (7, ""), (7, " "), (8, text("e")), (8, text("e") + " more"), (None, "x")]
    kept = op6.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept if r.doc_id not in (7, 8)) == [(0, "x"), (1, "a"), (2, "b"), (6, "c"), (6, "d")]
    assert [r.doc_id for r in kept].count(7) == [r.doc_id for r in kept].count(8) == 1


# ---- 7 ------------------------------------------------------------------------------------------------------


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: (r.bin_offset, r.length))
        at = 0
        for r in b:
            assert r.bin_offset == at
            at += r.length
        assert at <= capacity
        assert len({r.source for r in b}) == len(b)


def test_packing(spark, docs, odd, none):
    for df in (docs, odd):
        rows = op7.packed(df, op7.text_length(), op7.text_cluster(), 2048, 300).collect()
        check_bins(rows, 2048)
        want = sorted(len((r.text or "").encode()) for r in df.collect())
        assert sum(r.length for r in rows) == sum(want)
    assert op7.packed(none, op7.text_length(), op7.text_cluster()).count() == 0


def test_tightest_compatible_bin():
    rng = random.Random(4)
    n = 400
    length, source, cluster = np.array([rng.randint(1, 60) for _ in range(n)]), np.array([rng.randrange(6) for _ in range(n)]), np.array([rng.randrange(200) for _ in range(n)])
    order = np.lexsort((np.arange(n), -length))
    got, _ = op7.pack(length, source, cluster, order, 100)
    open_, want = [], np.zeros(n, int)
    for i in order:
        fits = [(b["left"], b["made"]) for b in open_ if b["left"] >= length[i] and source[i] not in b["s"] and cluster[i] not in b["c"]]
        left = min(fits)[0] if fits else None
        b = next(b for b in open_ if b["made"] == got[i]) if fits else {"left": 100, "s": set(), "c": set(), "made": len(open_)}
        if fits:
            assert b["left"] == left and (b["left"], b["made"]) in fits
        else:
            assert got[i] == len(open_)
            open_.append(b)
        b["left"] -= length[i]
        b["s"].add(source[i])
        b["c"].add(cluster[i])
        want[i] = b["made"]
    assert (got == want).all()


@pytest.mark.parametrize("sources, same", [(1, False), (1, True), (2, True), (5, False), (20_000, False)])
def test_packing_of_hot_shards(sources, same):
    """A shard of 20,000 pieces of one source, of equal lengths or with an empty piece is packed without long scans."""
    rng = np.random.default_rng(sources)
    n = 20_000
    length = np.full(n, 900) if same else rng.integers(1, 8000, n)
    length[0] = 0
    began = time.perf_counter()
    bins, at = op7.pack(length, np.arange(n) % sources, rng.integers(0, 3000, n) if sources < 20_000 else np.zeros(n, int), np.argsort(-length, kind="stable"), 8192)
    assert time.perf_counter() - began < 20
    pairs = set(zip(bins.tolist(), (np.arange(n) % sources).tolist(), strict=True))
    assert len(pairs) == n and (at + length <= 8192).all()



# ---- 8 ------------------------------------------------------------------------------------------------------


def test_films_round_trip():
    rng = np.random.default_rng(3)
    for text in [b"", b"a", b"x" * 64, b"\xff\x00" * 900, b"\xff" * 3000, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()]:
        payload = op8.payload_of(text)
        assert len(payload) % 64 == 0 and payload and payload.startswith(text)
        raw = op8.store(payload)
        got, film, levels = op8.restore(raw)
        assert got == payload and film["width"] == 512
        walked = op8.read_avi(raw[: raw.index(b"idx1")])
        assert walked["frames"] == film["frames"]
    a, b = film["frames"][0]
    grey = op8.decode_frame(raw[a:b])
    assert (grey[::8, ::8].ravel() == levels[0]).all() and (grey == np.kron(grey[::8, ::8], np.ones((8, 8), np.uint8))).all()
    assert op8.read_avi(b"RIFF....WAVE") is None and op8.read_avi(b"") is None


def jpeg(grid, quant, high, wide, sampling=0x11, restart=0, tables=False):
    """A baseline frame written by the standard's text alone: grid[mcu] lists (component, 64 quantised zig-zag terms)."""
    std = op8.standard_tables()
    book = {}
    for k, (sizes, symbols) in std.items():
        code, at = 0, 0
        for n, count in enumerate(sizes, 1):
            for _ in range(count):
                book[k, symbols[at]] = format(code, f"0{n}b")
                code, at = code + 1, at + 1
            code <<= 1
    parts = 3 if sampling != 0x11 else 1
    number = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    body, bits, last = b"", "", [0, 0, 0]
    pack = lambda bits: int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\x00")
    for m, mcu in enumerate(grid):
        if restart and m and m % restart == 0:
            body, bits, last = body + pack(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8]), "", [0, 0, 0]
        for c, terms in mcu:
            d, last[c] = terms[0] - last[c], terms[0]
            bits += book[min(c, 1), abs(d).bit_length()] + number(d)
            run = 0
            top = max([k for k in range(64) if terms[k]], default=0)
            for v in terms[1 : top + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + book[16 | min(c, 1), 0xF0], run - 16
                bits, run = bits + book[16 | min(c, 1), run << 4 | abs(v).bit_length()] + number(v), 0
            if top < 63:
                bits += book[16 | min(c, 1), 0]
    body += pack(bits)
    seg = lambda m, x: bytes([0xFF, m]) + (len(x) + 2).to_bytes(2, "big") + x
    dht = b"".join(seg(0xC4, bytes([k]) + a + b) for k, (a, b) in std.items()) if tables else b""
    sof = bytes([8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([parts]) + b"".join(bytes([i + 1, sampling if i == 0 else 0x11, 0]) for i in range(parts))
    sos = bytes([parts]) + b"".join(bytes([i + 1, 0x11 if i else 0]) for i in range(parts)) + bytes([0, 63, 0])
    dri = seg(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes(quant)) + dht + dri + seg(0xC0, sof) + seg(0xDA, sos) + body + b"\xff\xd9"


@pytest.mark.parametrize("sampling, restart, tables", [(0x11, 0, True), (0x11, 2, False), (0x22, 0, False), (0x22, 1, True), (0x21, 3, False)])
def test_jpeg_frames(sampling, restart, tables):
    """Terms beyond the first, 4:2:0 and 4:2:2 sampling, restart markers and frames without Huffman tables, against the sums
    of cosines that the standard defines."""
    rng = np.random.default_rng(sampling + restart)
    h, v = sampling >> 4, sampling & 15
    across, down = 3, 2
    quant = rng.integers(1, 9, 64)
    zig = [(i, d - i) if d % 2 else (d - i, i) for d in range(15) for i in range(d + 1) if i < 8 and d - i < 8]
    luma, grid = np.zeros((down * v * 8, across * h * 8)), []
    u = np.arange(8)
    wave = np.where(u[:, None] == 0, 1 / np.sqrt(2), 1) * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    for m in range(across * down):
        mcu = []
        for c in range(3 if sampling != 0x11 else 1):
            for b in range(h * v if c == 0 else 1):
                terms = np.where(rng.random(64) < 0.15, rng.integers(-6, 7, 64), 0)
                terms[0] = rng.integers(-40, 41)
                terms[63] = 3 if b % 2 else 0
                mcu.append((c, terms.tolist()))
                if c == 0:
                    freq = np.zeros((8, 8))
                    for (y, x), t, q in zip(zig, terms, quant, strict=True):
                        freq[y, x] = t * q
                    y, x = (m // across * v + b // h) * 8, (m % across * h + b % h) * 8
                    luma[y : y + 8, x : x + 8] = wave.T @ freq @ wave
        grid.append(mcu)
    high, wide = down * v * 8 - 3, across * h * 8 - 5
    got = op8.decode_frame(jpeg(grid, quant.tolist(), high, wide, sampling, restart, tables))
    assert np.abs(got.astype(int) - np.clip(np.rint(luma + 128), 0, 255)[:high, :wide]).max() <= 1


def test_damaged_films(spark):
    """A cut, an empty and a table-less frame: the frame before is shown, and the clip says how many are bad."""
    flat = [[(0, [level] + [0] * 63)] * 1 for level in (-60, -60, 50)]
    frames = [jpeg([f] * 4, [8] * 64, 16, 16) for f in flat]
    film = op8.write_avi([frames[0], frames[1][:60], b"", frames[2], b"\xff\xd8\xff"], 16, 16)
    broken = op8.write_avi([b"", b"no frame"], 16, 16)
    cut = film[: film.index(b"idx1") - 40]
    df = spark.createDataFrame([(1, bytearray(film)), (2, bytearray(broken)), (3, bytearray(cut)), (4, None)], "doc_id long, film binary")
    rows = sorted(op8.film_clips(df).collect())
    assert [(r.doc_id, r.clip, r.frames, r.bad_frames) for r in rows if r.doc_id < 3] == [(1, 0, 3, 2), (1, 1, 2, 1), (2, 0, 2, 2)]
    assert rows[0].mean_level < rows[1].mean_level and rows[2].mean_level is None and {r.doc_id for r in rows} <= {1, 2, 3}


def test_long_frames_decode_in_linear_time():
    rng = np.random.default_rng(1)
    terms = lambda: [(0, [int(rng.integers(-40, 41)), *rng.integers(-3, 4, 63).tolist()])]
    one = terms()
    took = []
    for n in (16, 64):
        raw = jpeg([one] * (n * n), [4] * 64, 8 * n, 8 * n)
        began = time.perf_counter()
        op8.decode_frame(raw)
        took.append((time.perf_counter() - began) / len(raw))
    assert took[1] < 4 * took[0]



def test_shots():
    dark, light = np.full(4096, 20, np.uint8), np.full(4096, 220, np.uint8)
    frames = [dark] * 10 + [light] * 15
    raw = op8.write_avi([op8.encode_frame(f[:1024]) for f in frames], 512, 128)
    film = op8.read_avi(raw)
    got = op8.clips(film, [op8.frame_levels(raw[a:b]) for a, b in film["frames"]])
    assert [(c["start"], c["end"], c["frames"]) for c in got] == [(0.0, 0.4, 10), (0.4, 1.0, 15)]


@pytest.mark.parametrize("lengths", [[1, 1], [1, 1, 1], [2, 3], [5, 6], [1, 9], [1, 1, 1, 1, 1, 1], [2] * 30, [3] * 20, [4, 1, 2, 7] * 9, [100, 3, 2, 2, 100]])
def test_shots_of_short_films_and_frequent_cuts(lengths):
    levels = [np.full(1024, 220 if k % 2 else 20, np.uint8) for k, n in enumerate(lengths) for _ in range(n)]
    film = op8.read_avi(op8.write_avi([op8.encode_frame(x) for x in levels], 512, 128))
    assert [c["frames"] for c in op8.clips(film, levels)] == lengths


def test_shots_amid_motion():
    rng = np.random.default_rng(4)
    for n in (9, 80):
        moving = [np.concatenate([rng.integers(0, 128, 512), rng.integers(lo, lo + 16, 512)]) for lo in rng.integers(0, 100, n)]  # each frame differs from the last by about a half
        histograms = np.array([np.bincount(x >> 3, minlength=32) for x in moving])
        assert np.median(np.abs(np.diff(histograms, axis=0)).sum(1) / 2048) > 0.3 and op8.cuts(histograms) == [0]
        other = np.array([np.bincount((x + 128) >> 3, minlength=32) for x in moving])
        assert op8.cuts(np.concatenate([histograms, other])) == [0, n]


def test_film_columns(spark, odd, none):
    rows = op8.film_digests(odd).collect()
    texts = {r.doc_id: (r.text or "") for r in odd.collect()}
    for r in rows:
        payload = op8.payload_of(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert op8.film_digests(none).count() == 0
    films = op8.with_film(odd)
    assert "text" not in films.columns and op8.film_clips(films).count() >= odd.count()
    assert op8.film_clips(films.withColumn("film", F.lit(b"junk"))).count() == 0


# ---- 9 ------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 16))
    rows = []
    for i, b in enumerate(base):
        for _ in range(int(rng.integers(1, 5))):
            rows.append((len(rows), (b + rng.normal(size=16) * 0.06 * rng.random()).tolist(), int(i % 3)))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(3)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [], 0), (n + 6, [1.0], 0), (n + 7, [1e300] * 16, 2), (n + 7, [1e300] * 16, 2)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, label int, weight string")
    ok = {r[0]: (np.array(r[1], float), r[2]) for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and len(r[1]) == 16}
    ids = sorted(ok)
    unit = {i: ok[i][0] / np.abs(ok[i][0]).max() for i in ids}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: {j for j in ids if j != i and ok[i][1] == ok[j][1] and unit[i] @ unit[j] >= 0.98} for i in ids}
    comp = {}
    for i in ids:
        if i not in comp:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in comp:
                    comp[x] = i
                    stack += links[x]
    want = {(r[0], len(links.get(r[0], ())), comp.get(r[0], r[0]), comp.get(r[0], r[0]) == r[0]) for r in rows}
    assert {tuple(r) for r in op9.near_duplicates(df).collect()} == want
    assert op9.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell,block", [(8, 8), (16, 1024)])
def test_many_cells_lose_nothing(spark, monkeypatch, cell, block):
    monkeypatch.setattr(op9, "CELL", cell)
    monkeypatch.setattr(op9, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 6))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.08 for _ in range(4)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    count = (u @ u.T >= 0.98).sum(1) - 1
    assert {r.vec_id: r.n_links for r in op9.near_duplicates(df).collect()} == dict(enumerate(count.tolist()))


@pytest.mark.parametrize("cell", [8, 1024])
def test_every_length_is_compared(spark, monkeypatch, cell):
    monkeypatch.setattr(op9, "CELL", cell)
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for dim, label, n in ((6, 0, 40), (5, 0, 12), (5, 1, 30), (1, 0, 3), (6, 2, 2)):
        base = rng.normal(size=(n, dim))
        x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base[:1]])
        u = x / np.linalg.norm(x, axis=1)[:, None]
        want |= dict(enumerate(((u @ u.T >= 0.98).sum(1) - 1).tolist(), len(rows)))
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate(x)]
    got = op9.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == want


# ---- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    kept = docs
    for _, stage in pipeline.STAGES[:3]:
        before, kept = kept, common.materialize(stage(spark, kept, DIR), "stage")
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute_classes(rows)}
    seen = kept.join(labels, "doc_id")
    of = lambda df, test: df.where(test).count()
    known = docs.join(labels, "doc_id")
    assert of(seen, "toxic = 1") < 0.2 * of(known, "toxic = 1") and of(seen, "quality = 0") < 0.2 * of(known, "quality = 0")
    placed = pipeline.run(spark, DIR)
    assert {r.doc_id for r in placed.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}
    check_bins(placed.collect(), op7.CAPACITY)


@pytest.mark.parametrize("place", range(4))
def test_stages_take_odd_documents(spark, odd, none, place):
    """Every stage takes nulls, empty and very long texts, repeated rows and clashing columns, and empty tables; all but
    the last return the columns that they got."""
    import corpus_pipeline as pipeline

    name, stage = pipeline.STAGES[place]
    out = stage(spark, odd, DIR)
    if name != "packing":
        assert out.columns == odd.columns and out.count() <= odd.count()
    else:
        assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in odd.select("doc_id").collect()}
    assert stage(spark, none, DIR).count() == 0
