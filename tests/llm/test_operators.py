"""Operators against brute force, round trips and held-out accuracy."""

import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm._common import scratch


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "src", 0, "mine") for i, t in rows], "doc_id long, text string, lang string, source string, n_shingles long, kept string")


# packing


def test_least_slack_is_the_best_sum():
    from tarn.llm.packing import least_slack

    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        capacity = rng.randrange(1, 60)
        best, chosen = least_slack(counts, capacity)
        each = [[n * k for k in range(c + 1)] for n, c in counts.items()]
        assert best == max(s for x in itertools.product(*each) if (s := sum(x)) <= capacity)
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


ODD = [(0, None), (1, ""), (2, "a\x1cb c"), (3, "Don't STOP 's it's 12,3.'s (x) ''"), (4, "ΣΑΣ ΣΑΣ. İx é É ½. ²"), (5, "x<|endoftext|>y"), (6, "word " * 5000), (6, "word " * 5000), (None, "tail")]


def check_pieces(pieces, texts):
    from tokenizers import Tokenizer

    from tarn.llm.queries import tokenizer_file

    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.token_ids, "<u4").tolist(), p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        copies = len(want[i])
        assert sorted(x for _, ids, _ in own for x in ids) == sorted(x for w in want[i] for x in w)
        if copies == 1:
            own.sort()
            assert [x for _, ids, _ in own for x in ids] == want[i][0]
            at = 0
            for start, ids, total in own:
                assert start == at and total == len(want[i][0])
                at += len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark, sf_dir):
    from tarn.llm.packing import pack
    from tarn.llm.queries import tokenizer_file

    assert check_pieces(pack(documents(spark, ODD), tokenizer_file()).collect(), ODD) == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert check_pieces(pack(docs, tokenizer_file()).collect(), [(r.doc_id, r.text) for r in docs.collect()]) == 0
    assert pack(docs.limit(0), tokenizer_file()).count() == 0


# top k


def test_top_k(spark):
    from tarn.llm.topk import top_k

    rng = random.Random(2)
    same = [0.5, 0.25, -0.5]
    rows = [(k, same if k % 3 == 0 else [rng.uniform(-1, 1) for _ in range(3)]) for k in range(300)] + [(7, None), (8, [None, 1.0, 1.0]), (9, [float("nan"), 1.0, 1.0]), (None, same), (21, same), (50, same)]
    vectors = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()}
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in range(0, 300, 50):
        e = min(v for i, v in fine if i == q)
        want = sorted((-sum(a * b for a, b in zip(e, v)), i) for i, v in fine if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in want]
    few = vectors.where("vec_id in (0, 1, 2)")
    assert top_k(few, few.where("vec_id = 0")).count() == 2
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# archive


def test_archive(spark):
    from tarn.llm import warc

    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 3000), (5, "u", "é" * 3000), (None, "n", "own"), (6, "v", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "warc-test")
    warc.write(pages, path)
    got = {r.page_id: r for r in warc.report(spark, path).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[2].refers_to) == ("revisit", 2, "response", None)
    assert (got[3].refers_to, got[4].record_type, got[3].payload_digest) == (4, "response", "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ")
    assert spark.read.parquet(f"{path}/payloads").count() == 5 and len(warc.report(spark, path).collect()) == len(rows)
    records = warc.parse(warc.raw(spark, path)).collect()
    for r in records:
        length = int(re.search(r"Content-Length: (\d+)\r\n", r.header)[1])
        assert length == len(r.block) and r.header.endswith("\r\n\r\n")
    assert bytes(next(r.block for r in records if r.page_id == 6)) == b"a\r\n\r\nb"
    empty = scratch(spark, "warc-test")
    warc.write(pages.limit(0), empty)
    assert warc.report(spark, empty).count() == 0


# decontamination


def test_decontamination(spark):
    from tarn.llm.decontaminate import matches, split_item, tokens

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 40))) + ".\n" + " ".join(word() for _ in range(rng.randrange(6, 20)))) for k in range(30)] + [(90, None), (91, " "), (92, "tiny one")]
    docs = []
    for k in range(80):
        text = [word() for _ in range(rng.randrange(0, 400))]
        if k % 2:
            own = items[rng.randrange(30)][1].split()
            if k % 4 == 1:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((k, " ".join(text).upper() if k % 3 else " ".join(text)))
    docs += [(200, None), (201, ""), (202, "a tiny one here"), (202, "a tiny one here")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in matches(documents(spark, docs), tests).collect())
    def parts(t):
        w, q = split_item(t)
        sh = lambda x: {tuple(x[j : j + 5]) for j in range(len(x) - 4)} if len(x) > 4 else {tuple(x)} - {()}
        return sh(w[:q]), sh(w) - sh(w[:q])
    want = []
    for i, t in docs:
        w = tokens((t or "").encode())
        held = {tuple(w[j : j + n]) for n in range(1, 6) for j in range(len(w) - n + 1)}
        for k, x in items[:30]:
            if all(len(p & held) >= 0.7 * len(p) - 1e-9 for p in parts(x)):
                want.append((i, k))
    assert [g for g in got if g[1] < 90] == sorted(want) and len(want) > 20
    assert matches(documents(spark, docs).limit(0), tests).count() == 0


def test_short_questions_are_found(spark):
    from tarn.llm.decontaminate import matches

    items = [(1, "Inou on. On aned haat bele kima sodu."), (2, "Tiny one here"), (3, "Who am.\nNo."), (4, "Elsewhere now. On aned haat bele kima sodu.")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, "some words stand before " + t + " and others after it") for k, t in items] + [(9, "tiny Inou one on here who no am")]
    assert sorted((r.doc_id, r.item_id) for r in matches(documents(spark, docs), tests).collect()) == [(k, k) for k, _ in items]


def test_answers_apart_from_their_questions_are_found(spark):
    from tarn.llm.decontaminate import matches

    items = [(1, "What is the name of the capital of France?\nParis"), (2, "Which of these five do not swim at all?\nthe old red hen and the cat"), (3, "Go on.\nNo more"), (4, " ".join(f"q{k}" for k in range(60)) + "\nyes")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    between = {1: "Answer:", 2: "A the fish B the frog C the duck D the eel Answer", 3: "then say", 4: " ".join(f"x{k}" for k in range(50))}
    docs = [(100 * k + n, "before " * n + t.replace("\n", f" {between[k]} ") + " and after") for k, t in items for n in range(0, 100, 9)]
    docs += [(900, "What is the name of the capital of Spain? Paris"), (901, "What is the name of the capital of France? It is large"), (902, "the old red hen and the cat do not swim")]
    got = sorted((r.doc_id, r.item_id) for r in matches(documents(spark, docs), tests).collect())
    assert got == sorted((100 * k + n, k) for k in (1, 2, 4) for n in range(0, 100, 9))


def test_each_benchmark_item_is_found_verbatim(spark, sf_dir):
    from tarn.llm.decontaminate import matches

    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = [(r.item_id, "some words stand before " + r.text + " and others after it") for r in tests.collect()]
    got = {(r.doc_id, r.item_id) for r in matches(documents(spark, docs), tests).collect()}
    assert {(k, k) for k, _ in docs} <= got
    assert matches(documents(spark, docs), tests.limit(0)).count() == 0


# near duplicates


def components_of(sets, percent=80):
    parent = list(range(len(sets)))
    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in itertools.combinations(range(len(sets)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(len(sets))]


def word_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    return out


def test_near_duplicates(spark):
    from tarn.llm.neardup import near_duplicates

    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, passage, texts = fresh(150), fresh(60), []
    for k in range(120):  # one large group whose members differ more and more, some too much
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = fresh(1)[0]
        texts.append(" ".join(w))
    for k in range(60):  # documents that share most of a passage and little else
        texts.append(" ".join(passage + fresh(rng.randrange(1, 60))))
    chain = fresh(100)
    for k in range(12):  # a chain: neighbours are linked, ends are not
        texts.append(" ".join(chain[3 * k :] + fresh(3 * k)))
    texts += ["one two", "ONE two", "one\ttwo", "", None, " ", "É x y z", "é x y z", texts[0], texts[0]]
    got = near_duplicates(documents(spark, list(enumerate(texts))), words=4).collect()
    sets = word_sets(texts, 4)
    want = components_of(sets)
    assert len(set(want[:120])) > 3
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    again = near_duplicates(documents(spark, [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "lone one here now"), (5, "other words are in here")]), words=4).collect()
    assert len(again) == 5 and sorted(str(r.component_id) for r in again) == ["5", "5", "5", "5", "None"]
    assert near_duplicates(documents(spark, []), words=4).count() == 0


# sharding


def test_sharding(spark, tmp_path):
    from tarn.llm.sharding import Conflict, Store

    store = Store(spark, str(tmp_path / "store"), target_bytes=1 << 20, fanout=3, smallest_bytes=1 << 10)
    with pytest.raises(ValueError):
        store.read()
    rows = []
    for k in range(7):
        part = [(k * 100 + j, None if j == 3 else "t" * j) for j in range(40)]
        rows += part
        store.append(spark.createDataFrame(part, "doc_id long, text string").coalesce(1))
    before = store.manifest()
    assert len(before["shards"]) == 7
    assert store.compact()
    after = store.manifest()
    assert len(after["shards"]) < 7 and after["version"] > 7
    assert sorted((r.doc_id, r.text) for r in store.read().collect()) == sorted(rows, key=lambda r: r[0])
    assert store.read(7).count() == len(rows)  # older versions can be read until vacuum
    with pytest.raises(Conflict):
        store._commit(before, [], "late")
    gone = store.vacuum()
    assert len(gone) == 7 and store.read().count() == len(rows) and store.versions() == [after["version"]]
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert store.read().count() == len(rows)
    json.dumps(store.manifest())


# language


def test_language(spark, sf_dir):
    from tarn.llm.langid import identify, marginals

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = docs.select("doc_id", "text", "lang").unionAll(documents(spark, [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 34 ..."), (10**6 + 3, "x"), (None, "the and of")]).select("doc_id", "text", F.lit(None).cast("string")))
    got = {r.doc_id: r for r in identify(extra).collect()}
    told = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, lang in told.items() if got[i].held_out and lang]
    assert len(held) > 150 and np.mean([got[i].lang_pred == told[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[10**6 + k].lang_pred for k in range(3)] == ["und"] * 3 and got[10**6 + 3].lang_pred != "und"
    assert identify(extra.limit(0)).count() == 0
    # Forward-backward in blocks agrees with the plain one.
    rng = np.random.default_rng(1)
    e, moves, begin = rng.normal(size=(200, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.zeros(200, bool)
    first[[0, 1, 90, 150]] = True
    p, _, _ = marginals(e, first, moves, begin)
    cuts = [0, 1, 90, 150, 200]
    for s, t in zip(cuts, cuts[1:]):
        a = [np.exp(begin + e[s])]
        for k in range(s + 1, t):
            a.append((a[-1] @ np.exp(moves)) * np.exp(e[k]))
            a[-1] /= a[-1].sum()
        b = [np.ones(3)]
        for k in range(t - 1, s, -1):
            b.append(np.exp(moves) @ (np.exp(e[k]) * b[-1]))
            b[-1] /= b[-1].sum()
        q = np.array(a) * np.array(b[::-1])
        assert np.allclose(q / q.sum(1, keepdims=True), p[s:t])


# urls


def test_language_sample_is_that_of_one_ranking(spark):
    from tarn.llm.langid import fold, training_rows

    rows = [(k % 700, f"w{k % 5} v{k % 3} text", ("a", "b", None)[k % 10 % 3]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(70)
    hashed = docs.where((fold(docs.doc_id) != 2) & docs.lang.isNotNull()).selectExpr("xxhash64('train', doc_id) as o", "doc_id", "text", "lang").collect()
    want = [(r.text, r.lang) for lang in "ab" for r in sorted(x for x in hashed if x.lang == lang)[:40]]
    assert training_rows(docs, 80, 60) == sorted(want)


def test_long_runs_are_labelled_whole(spark):
    from tarn.llm.langid import identify, words_of

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang is not null").orderBy("doc_id").limit(400)
    more = [(10**6 + r.doc_id, "0/" * 40 + "/".join(words_of(r.text))) for r in docs.limit(40).collect()]
    got = {r.doc_id: r.lang_pred for r in identify(docs.unionAll(spark.createDataFrame([(*m, None) for m in more], "doc_id long, text string, lang string"))).collect()}
    assert len({got[k] for k, _ in more}) > 1
    assert sum(got[k] == got[k - 10**6] for k, _ in more) >= 38
    for text in ("漢" * 1000, "नमस्ते" * 100, "a," * 90 + "b" * 150):
        assert "".join(words_of(text)) == text.replace(",", "") and max(map(len, words_of(text))) <= 64
    assert words_of("1," * 90) == [] and words_of("x" * 64) == ["x" * 64]


def test_urls(spark):
    from tarn.llm.urls import judge

    html = "<p>" + "casino win spam farm news daily sun flower " * 20 + "</p>"
    rows = [(1, "http://www.casinowin.org/a?x", html), (2, "https://dailynews.com/en/5", html), (3, "http://a.example.com/en/71", html), (4, "x://example.com/en/8", html), (5, None, html), (6, "no scheme", None), (7, "http://B.Net/de/1#t", html), (8, "http://example.net/de/81", html), (9, "http://notexample.com", ""), (10, "http://sunflower.org/es/9", html), (11, "http://" + "q" * 300 + ".io/p", html), (1, "http://www.casinowin.org/a?x", html)]
    got = {r.page_id: r for r in judge(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")).collect()}
    told = {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert told[3] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and told[4] == ("example.com", "/en/8", "com/en/", "block")
    assert told[5] == ("", "", None, "allow") and told[6] == told[5]
    assert told[7] == ("b.net", "/de/1", "net/de/", "allow") and told[8][2:] == ("example.net/de/8", "block") and told[10][2:] == ("org/es/", "block")
    assert told[9][2] is None and told[1][3] == "block" and got[1].words == ["casino", "win"] and got[2].words == ["daily", "news"]
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_masks(spark):
    from tarn.llm import secrets

    text = "é token = \"abcdef123456\" and AKIA" + "A" * 16 + " end"
    docs = documents(spark, [(1, text), (2, "plain")])
    found = secrets.scan(docs)
    got = {r.doc_id: r.m for r in found.select("doc_id", secrets.masked("text", "found").alias("m")).collect()}
    assert got == {1: "é [assign]\" and [access] end", 2: "plain"}


def test_large_vectors_keep_exact_scores(spark):
    from tarn.llm.topk import top_k

    rng = random.Random(8)
    rows = [(k, [rng.choice([1e6, -1e6, 3.5, 1e300, 2e17]) * rng.random() for _ in range(4)]) for k in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()}
    whole = [(i, [int(np.floor(min(256 * x, 1.7976931348623157e308))) for x in v]) for i, v in rows]
    for q in (0, 50, 100):
        score = lambda v: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q][1], v))))  # noqa: E731, B023
        want = sorted((-score(v), i) for i, v in whole if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in want]
    million = vectors.selectExpr("vec_id", "transform(embedding, x -> 1e5 * (vec_id + 1)) as embedding")
    assert top_k(million, million.where("vec_id = 0")).orderBy("rank").first().vec_id == 119


def test_queries_in_several_blocks(spark, monkeypatch):
    from tarn.llm import topk

    vectors = spark.createDataFrame([(k, [float(k % 7), float(k % 11)]) for k in range(90)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk.top_k(vectors, vectors).collect()))
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 2 * 7)
    assert sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id < 30")).collect())) == [r for r in whole if r[0] < 30]


def test_repeated_and_nameless_items(spark):
    from tarn.llm.decontaminate import matches, without

    text = "who was the first to cross the wide river?\nit was old king harald of the north"
    items = spark.createDataFrame([(k, text) for k in range(50)] + [(None, text), (7, "some other item that nobody has ever\nread in any book at all")], "item_id long, text string")
    docs = documents(spark, [(1, "so " + text + " indeed"), (1, "clean"), (None, text), (2, None)])
    got = [(r.doc_id, r.item_id) for r in matches(docs, items, shard_items=20).collect()]
    assert sorted(map(str, got)) == sorted(str((d, k)) for d in (1, None) for k in [*range(50), None])
    assert sorted(str(r.doc_id) for r in without(docs, items).collect()) == ["1", "2"] and without(docs, items.limit(0)).count() == 4


def test_a_long_item_is_found_if_most_of_it_is(spark):
    from tarn.llm.decontaminate import matches

    words = [f"w{k}" for k in range(600)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join(words[:200])), (3, " ".join(words[:500])), (4, " ".join(words[100:450]))])
    assert sorted(r.doc_id for r in matches(docs, items, most_words=100).collect()) == [1, 3]


def test_very_long_texts_take_bounded_memory():
    import tracemalloc

    from tarn.llm.decontaminate import Index

    rng = random.Random(3)
    items = [(str(k), " ".join(f"w{rng.randrange(5000)}" for _ in range(40))) for k in range(5000)]
    index = Index(items, 5, 0.7, 512)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(100_000)) + " " + items[77][1] + " end"
    tracemalloc.start()
    found = index.matches(text.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(found) == ["77"] and peak < 200 << 20


def test_an_empty_store_is_an_empty_table(spark, tmp_path):
    from tarn.llm.sharding import Store, shard_documents

    clash = "doc_id long, arrival_batch_of_store string, text string"
    store = shard_documents(spark.createDataFrame([], clash), str(tmp_path / "none"))
    assert store.read().count() == 0 and store.read().columns == ["doc_id", "arrival_batch_of_store", "text"]
    rows = [(k % 5 or None, "mine", "é" * 100_000 if k == 3 else None) for k in range(20)]
    store = shard_documents(spark.createDataFrame(rows, clash), str(tmp_path / "some"))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, spark.createDataFrame(rows, clash).collect()))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1,)], "doc_id long"))
    # A file of a commit that failed goes once it is old enough.
    (tmp_path / "some/data/lost").mkdir()
    (tmp_path / "some/data/lost/part-0.parquet").write_bytes(b"x")
    assert store.vacuum() == [] and "data/lost/part-0.parquet" in store.vacuum(orphan_hours=-1) and store.read().count() == 20
    assert isinstance(Store(spark, str(tmp_path / "some")).compact(), list)


def test_records_have_the_fields_that_the_format_demands(spark):
    from tarn.llm import warc

    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (2, "v", "y"), (3, "w", "x"), (3, "w", "x")], "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write(pages, path)
    headers = [r.header for r in spark.read.parquet(f"{path}/headers").collect()]
    assert all(f"\r\n{x}: " in h for h in headers for x in ("WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Type"))
    revisits = [h for h in headers if "WARC-Type: revisit" in h]
    ids = {re.search("WARC-Record-ID: (.*)\r", h)[1] for h in headers}
    assert len(revisits) == 2 and all("WARC-Profile: " in h and re.search("WARC-Refers-To: (.*)\r", h)[1] in ids for h in revisits) and len(ids) == 4


def test_rare_languages_are_learned_and_columns_kept(spark):
    from tarn.llm.langid import identify

    rows = [(k, "the cat and the dog sat there", "en", "a", 1) for k in range(400)] + [(1000 + k, "tämä on suomea ja kissa istuu", "fi", "b", 2) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    got = {r.doc_id: r for r in identify(docs, sample_documents=20, keep=("lang_pred", "score")).collect()}
    assert {got[1000 + k].lang_pred for k in range(4)} == {"fi"} and got[5].lang_pred == "en" and tuple(got[5].row) == ("a", 1)


def test_urls_as_written_again(spark, sf_dir):
    from tarn.llm.urls import judge
    from tests.llm.brute import urls

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = judge(pages).collect()
    want = urls([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert len(got) == len(want) and len({r.verdict for r in got if r.rule is None}) == 2
    for r in got:
        words, verdict, score = want[r.page_id]
        assert list(r.words) == words and (r.rule or r.verdict == verdict) and abs((r.score or 0) - (score or 0)) < 1e-3


def test_naive_bayes_decides_and_not_the_lexicon(spark):
    from tarn.llm.urls import LEXICON, judge
    from tests.llm.brute import urls

    text = "<p>" + "lucky spin garden flower news daily seeds roses paper lamps chairs tables " * 9 + "</p>"
    pages = [(k, f"http://www.{('casino', 'poker', 'slots')[k % 3]}luckyspin.org/play/{k}", text) for k in range(60)]
    pages += [(100 + k, f"http://www.{('garden', 'flower', 'daily')[k % 3]}news{('roses', 'paper', 'seeds')[k // 3 % 3]}.org/read/{k}", text) for k in range(200)]
    pages += [(500, "http://luckyspin.org/play/1", text), (501, "http://cheap-garden-flower-news-daily-roses.org/read/5", text), (502, "http://bet365.org/play/5", text), (503, "http://velvet.org/x/1", text), (504, "http://ünïlamps.org/x", None)]
    # Pages teach the words of their hosts by what they say.
    pages += [(600 + k, f"http://velvet.org/x/{k}", "<b>" + "casino poker velvet " * 30 + "</b>") for k in range(30)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    told = {k: got[k].verdict for k in range(500, 504)}
    assert told == {500: "block", 501: "allow", 502: "block", 503: "block"}
    assert not set(got[500].words) & set(LEXICON) and set(got[501].words) & set(LEXICON) and list(got[502].words) == ["bet", "0"]
    want = urls(pages)
    assert all((list(got[i].words), got[i].verdict) == want[i][:2] for i in got)


def test_small_caches_change_nothing():
    from tarn.llm import queries
    from tarn.llm.langid import Emissions, Model
    from tarn.llm.packing import ChunkTokenizer

    words = [f"{a}{b}" for a in ("the", "don't", "éa", "x1", "(so)") for b in ("", "ing", "!", "zz", "7")]
    order = [int(k) for k in np.random.default_rng(5).integers(0, len(words), 300)]
    small, large = (ChunkTokenizer(queries.tokenizer_file(), most) for most in (8, 10**6))
    for k in order:
        assert small.ids(words[k] + " " + words[-k]) == large.ids(words[k] + " " + words[-k])
    assert len(small) + len(small.older) < 16
    model = Model(["a", "b"], {})
    model.weights[:] = np.random.default_rng(6).normal(size=model.weights.shape)
    rows = Emissions(model, 10)
    used = np.array([rows[words[k]] for k in order])
    rows.shrink(used[-6:])
    assert len(rows) == len(set(order[-6:]))
    for w in words:
        assert np.allclose(rows.table[rows[w]], model.emission(w), atol=1e-4)


def test_words_of_letters_are_merged_in_few_calls():
    import pyarrow as pa

    from tarn.llm import queries
    from tarn.llm.packing import ChunkTokenizer, _groups

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgéßΣ", k=rng.randrange(1, 9))) for _ in range(3000)]
    mixed = ["Don't", "(so)", "'tis", "x1", "\u0958a", "İx", "a\xa0b\u3000c", "a\x1cb", "e\u0301", "\0"]
    texts = ["", " ", *(" ".join(rng.choices(words, k=50)) + rng.choice([".", ",\n", "\t"]) + rng.choice(mixed) for _ in range(200)), "Ab " * 5000]
    tokenizer = ChunkTokenizer(queries.tokenizer_file())
    merge, calls = tokenizer.letters, []
    tokenizer.letters = lambda piece: calls.append(piece) or merge(piece)
    for kind in (pa.string(), pa.large_string()):
        assert tokenizer.many(pa.array(texts, kind)) == [tokenizer.whole(t) for t in texts]
    assert tokenizer.many(pa.array([], pa.string())) == []
    assert len(calls) < 2 * (len(words) // 100 + 2)
    assert _groups(pa.array(["a" * 6, "", "b" * 5, "c" * 40, "d"]), 10) == [(0, 2), (2, 3), (3, 5)]


def test_added_tokens_between_spaces_and_marks():
    import pyarrow as pa

    from tarn.llm import queries
    from tarn.llm.packing import ChunkTokenizer

    tokenizer = ChunkTokenizer(queries.tokenizer_file())
    texts = ["<|endoftext|>", "a <|endoftext|> b", "(<|startoftext|>)", "x<|endoftext|>y.", "<|ENDOFTEXT|> endoftext"]
    assert tokenizer.many(pa.array(texts)) == [tokenizer.whole(t) for t in texts]
    assert tokenizer.ids(texts[0]) == (49407).to_bytes(4, "little")
