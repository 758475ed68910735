"""The stages against plain versions, each on its own input, over the smallest documents."""

import re

import pytest

import corpus_pipeline
from tests.llm.brute import secrets
from tests.llm.test_operators import check_pieces, components_of, word_sets


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_keeps_what_has_letters(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text)}
    assert all(after[i] == before[i] for i in after)


def test_one_document_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    ids = sorted(before)
    top = components_of(word_sets([before[i].text for i in ids], 5))
    assert set(after) == {ids[k] for k in set(top)}


def test_leaks_go_and_clean_documents_stay(spark, sf_dir, stages):
    before, after = rows(stages[2]), rows(stages[3])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(t.lower().split())
    leaked = {i for i, r in before.items() if any(plain(x) in plain(r.text) for x in items)}
    assert leaked and set(after) == set(before) - leaked


def test_secrets_are_masked(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) == set(before)
    for i, r in before.items():
        if secrets(r.text):
            assert not secrets(after[i].text) and after[i].n_chars == len(after[i].text)
        else:
            assert after[i] == r


def test_secrets_beside_noncharacters_are_masked(spark, sf_dir):
    key = "password = hunter2hunter2"
    texts = [f"\uffff {key} \uffff\ufffe", f"{key} \ufffe", "\uffff no secret", None, "", f"\uffff{key}"]
    docs = spark.createDataFrame([(k if k < 5 else None, t, "en", "web", len(t) if t is not None else 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.secret_masks(spark, docs, sf_dir).collect()}
    assert [got[k if k < 5 else None].text for k in range(6)] == ["\uffff [assign] \uffff\ufffe", "[assign] \ufffe", "\uffff no secret", None, "", "\uffff[assign]"]
    assert got[0].n_chars == len(got[0].text) and got[2] == docs.where("doc_id = 2").first() and got[0].source == "web"


def test_packing_loses_nothing(stages):
    assert check_pieces(stages[5].collect(), [(r.doc_id, r.text) for r in stages[4].collect()]) == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, odd string, row string"


def odd_rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), 5, "mine", "mine") for i, t in rows], SCHEMA)


def texts(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_stages_decide_by_row(spark, sf_dir):
    leak = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect())
    a, b, c = "one text of seven words for you", "another text that has seven words here", "a third text with seven words indeed"
    docs = odd_rows(spark, [(None, a), (3, a), (3, b), (None, b), (9, c), (9, c), (None, leak), (4, "x " + leak), (None, None), (5, ""), (6, "1 2 3")])
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert texts(kept) == texts(docs.where("text rlike '[a-z]'").select(*corpus_pipeline.COLUMNS))
    once = corpus_pipeline.near_duplicates(spark, odd_rows(spark, [(None, a), (2, a), (3, b), (3, c), (9, c), (9, c), (None, b), (None, b), (8, ""), (8, "")]), sf_dir)
    assert [t for _, t in texts(once)].count(a) == 1 and ("2", a) in texts(once)
    assert sorted(t for _, t in texts(once)) == sorted(["", a, b, c])
    clean = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert sorted(str(t) for _, t in texts(clean.na.fill("none"))) == sorted(str(r.text or ("none" if r.text is None else "")) for r in docs.where("text is null or not contains(text, '%s')" % leak.replace("'", "\\'")).collect())


def test_stages_of_empty_tables(spark, sf_dir):
    docs = odd_rows(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)


def test_without_labels_documents_with_letters_stay(spark, sf_dir):
    docs = odd_rows(spark, [(1, "some words"), (2, "12"), (3, "w" * 50_000)]).selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert [i for i, _ in texts(corpus_pipeline.language(spark, docs, sf_dir))] == ["1", "3"]
