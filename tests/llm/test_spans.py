import random

from tests.llm.brute import digest, pii, pii_spans, secrets

ODD = [
    None, "", "é😀 a@b.c_x@d.e, ..@-.x a@b", "x" * 30000, "a@b." * 50, "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.0.01 1..2", "4111 1111 1111 1111 4111-1111-1111-1112 " * 3,
    "+1 (249) 555-6835, +12 ((((( +1234567 +123456789012345678", "￿ a@b.cc ￿", "TOKEN = \"abcdef\" token:'' passwd==xx api_key: 123456 apikey=\"abc\"", "AKIA" + "Z" * 16 + "é" + "AKIAabc",
    "ab" * 12 + "g" + "0" * 23 + " password=" + "f" * 40, "😀token=abcdefg" * 400, "Ktoken = 1234567",
]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(0, texts[1], "again", 2), (None, "mail a@b.cc token=abcdef", "null", 3)], "doc_id long, text string, spans string, rules int")


def rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs, docs.collect()


def test_pii_base_spans(spark, sf_dir):
    from tarn.llm import pii as op

    for docs in (frame(spark, ODD), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, set()).add(digest(pii(r.text)))
        got = op.report(op.find(docs)).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r.base_sha256 in texts[r.doc_id], r


def test_pii_adds_supported_candidates_alone(spark):
    from tarn.llm import pii as op

    texts = [f"please call my phone (212) 555-01{k:02d} or write e-mail jo{k}(at)site.com, isbn 978.555.01{k:02d}" for k in range(30)] + [f"the card 4111 1111 1111 1111 and mail x{k}@y.com" for k in range(30)]
    got = op.report(op.find(frame(spark, texts))).collect()
    assert any("phone:" in r.spans and r.n_phone == 0 for r in got)
    assert all("email:" in r.spans for r in got if r.doc_id is not None and r.doc_id > 29)


def test_secrets_base_spans(spark, sf_dir):
    from tarn.llm import secrets as op

    for docs in (frame(spark, ODD), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, set()).add(digest(secrets(r.text)))
        got = op.report(op.scan(docs)).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r.base_sha256 in texts[r.doc_id], r


def test_trigram_queries_are_necessary():
    from tarn.llm.secrets import BASE, MORE, trigram_query

    q = {r.kind: trigram_query(r.pattern) for r in BASE + MORE}
    assert q["hex"] == [] and q["access"] == [frozenset({"aki", "kia"})]
    for sample in ("apikey=", "API_KEY'=", "Passwd :"):
        assert any(all(t in sample.lower() for t in c) for c in q["assign"])
    assert frozenset({"sec", "ecr", "cre", "ret"}) in q["assign"]


def test_empty_tables(spark):
    from tarn.llm import pii, secrets

    none = frame(spark, ODD).limit(0)
    assert pii.report(pii.find(none)).count() == 0
    assert secrets.report(secrets.scan(none)).count() == 0


def loose_texts():
    """Texts with loose personal data and numbers that look like it: (text, the spans that are personal data)."""
    rng, out = random.Random(12), []
    filler = lambda: " ".join(rng.choice(["alder", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak"]) for _ in range(rng.randrange(3, 9)))
    number = lambda: f"({rng.randrange(2, 10)}{rng.randrange(10, 99)}) {rng.randrange(2, 10)}{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
    for _ in range(400):
        text, true = filler(), []
        kind = rng.randrange(8)
        before, value, is_true = [
            ("please call ", number(), True), ("phone: ", number(), True), ("order ", f"{rng.randrange(100, 199)}-{rng.randrange(100, 199)}-{rng.randrange(1000, 9999)}", False),
            ("write to ", f"{rng.choice(['ann', 'bob', 'cy'])}{rng.randrange(99)} [at] {rng.choice(['mail', 'post'])}.example.com", True), ("ssn ", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", True),
            ("item ", f"000-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", False), ("mail ", f"dan{rng.randrange(99)}@{rng.choice(['mail', 'post'])}.example.com", True), ("call ", f"+1 {number()}", True),
        ][kind]
        text += " " + before
        if is_true:
            true.append((len(text), len(text) + len(value)))
        out.append((text + value + " " + filler(), true))
    return out


def test_pii_added_spans_are_personal_data(spark):
    from tarn.llm import pii as op

    cases = loose_texts()
    texts = [t for t, _ in cases]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in op.report(op.find(docs)).collect()}
    assert [got[k] for k in range(len(texts))] == pii_spans(texts)
    added = {(k, int(s), int(e)) for k, x in got.items() for _, s, e in (y.split(":") for y in x.split(",") if y)} - {(k, s, e) for k, t in enumerate(texts) for _, s, e in pii(t)}
    want = {(k, s, e) for k, (t, own) in enumerate(cases) for s, e in own} - {(k, s, e) for k, t in enumerate(texts) for _, s, e in pii(t)}
    assert len(want) > 150 and len(added & want) > 0.9 * len(want) and len(added & want) > 0.95 * len(added)


def test_pii_of_documents_as_written_again(spark, sf_dir):
    from tarn.llm import pii as op

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = docs.collect()
    got = {r.doc_id: r.spans for r in op.report(op.find(docs)).collect()}
    assert [got[r.doc_id] for r in rows] == pii_spans([r.text or "" for r in rows])
