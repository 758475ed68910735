import gzip
import io
import subprocess
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tarn.operators import history
from tarn.sources import archives, files, git, state
from tarn.streaming.files import scan_stream

TOKEN = b"ghp_aB3dE5gH7jK9mN1pQ3sT5vW7xY9zA2cD4fG6"


def tar_of(entries, fmt=tarfile.GNU_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zip_of(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def rows(path, data, **budgets):
    return list(archives.Expander(archives.Budgets(**budgets)).expand(path, archives.detect(path, data), data))


def test_archives():
    assert rows("a.gz", gzip.compress(b"hello"))[0][1:3] == (b"hello", "scanned")
    assert rows("a.gz", gzip.compress(b"hello" * 100)[:-20])[-1][3] == "gzip_corrupt"
    for fmt in (tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        out = rows("a.tar", tar_of([("d/x", b"1"), ("n" * 150, b"2")], fmt))
        assert [r[1] for r in out] == [b"1", b"2"] and "n" * 150 in out[1][0]
    nested = rows("a.tar.gz", gzip.compress(tar_of([("in.gz", gzip.compress(b"deep")), ("z.zip", zip_of([("q", b"1")]))])))
    assert b"deep" in [r[1] for r in nested] and "needs_random_access_no_spill" in [r[3] for r in nested]
    out = rows("a.zip", zip_of([("../../x", b"1"), ("dir/", b""), ("x", b"2")]))
    assert [(r[1], r[3]) for r in out] == [(b"1", None), (None, "non_regular"), (b"2", None)]
    assert len({r[0] for r in out}) == 3 and ".." not in out[0][0]
    assert rows("a.zip", b"PK\x03\x04 nothing")[0][3] == "malformed_zip"
    assert rows("a.tar", tar_of([("x", b"1"), ("y", b"2")]), entries=1)[-1][3] == "entry_count_exceeded"
    assert rows("a.gz", gzip.compress(b"\0" * 1_000_000), ratio=1000)[0][2] == "scanned"
    broken = bytearray(tar_of([("x", b"1")]))
    broken[0] ^= 1
    assert rows("a.tar", bytes(broken))[0][3] == "malformed_tar"
    inner = b"x"
    for _ in range(5):
        inner = gzip.compress(inner)
    assert archives.virtual_path("r", b"a\\.\\..\\b%\xff", "t0") == "r::b%25%FF@t0"


def test_files_and_scan(spark, tmp_path):
    (tmp_path / ".hidden").write_bytes(b"k " + TOKEN)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "_a.gz").write_bytes(gzip.compress(TOKEN))
    (tmp_path / "skip.log").write_bytes(TOKEN)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / ".gitignore").write_text("*.log\n")
    got = {r.object_id.rsplit("/", 1)[-1].split("::")[0] for r in files.scan_path(spark, str(tmp_path)).collect()}
    assert got == {".hidden", "_a.gz", "skip.log"}
    got = {r.path.rsplit("/", 1)[-1] for r in files.files(spark, str(tmp_path), skipHidden=True, respectGitignore=True).collect()}
    assert got == {"_a.gz"}
    with pytest.raises(FileNotFoundError):
        list(files.walk(str(tmp_path / "none")))
    e = archives.outcomes(archives.expand(files.files(spark, str(tmp_path)))).collect()
    assert {(r.outcome, r.n) for r in e} == {("scanned", 4)}


def make_repo(path):
    def run(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=path, check=True, capture_output=True)

    path.mkdir()
    run("init", "-q", "-b", "main")
    (path / "a").mkdir()
    for n in range(4):
        (path / "a" / "long.txt").write_text("".join(f"line {k}\n" for k in range(300)) + f"version {n}\n")
        (path / f"f{n}").write_bytes(b"token %d " % n + (TOKEN if n == 2 else b""))
        run("add", "-A")
        run("commit", "-qm", f"c{n}")
    run("gc", "-q")
    (path / "late").write_bytes(b"late")
    run("add", "-A")
    run("commit", "-qm", "late")
    return run


def test_git(spark, tmp_path):
    make_repo(tmp_path / "r")
    repo = str(tmp_path / "r")
    objects = git.objects(spark, repo).collect()
    for r in objects:
        assert git.object_id(r.type, bytes(r.content)) == r.oid
    want = subprocess.run(["git", "rev-list", "--objects", "--all"], cwd=repo, capture_output=True, text=True, check=True).stdout
    assert {r.oid for r in objects} == {line.split()[0] for line in want.splitlines()}
    contexts, found = git.scan_repository(spark, repo)
    hits = found.collect()
    assert [h.rule for h in hits] == ["github-pat"]
    ctx = {r.oid: r for r in contexts.collect()}
    assert ctx[hits[0].oid].path == "f2"
    blobs = {r.oid for r in objects if r.type == "blob"}
    assert set(ctx) == blobs
    seen = spark.createDataFrame([(hits[0].oid,)], "oid string")
    assert git.scan_repository(spark, repo, seen=seen)[1].count() == 0


def test_deltas():
    assert git.apply_delta(b"hello world", bytes([11, 8, 0x91, 6, 5, 3]) + b"abc") == b"worldabc"
    with pytest.raises(ValueError):
        git.apply_delta(b"x", bytes([2, 1, 1, 65]))


def test_state_and_stream(spark, tmp_path):
    st = state.State(spark, str(tmp_path / "state"))
    assert st.read("finding").count() == 0
    src = tmp_path / "in"
    schema = "path string, content binary"
    spark.createDataFrame([("a", bytearray(TOKEN)), ("b", bytearray(b"none"))], schema).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    for _ in range(2):
        scan_stream(stream(), st, str(tmp_path / "ck")).awaitTermination()
        assert st.read("finding").count() == 1 and st.read("seen_blob").count() == 2
    spark.createDataFrame([("c", bytearray(TOKEN))], schema).write.mode("append").parquet(str(src))
    scan_stream(stream(), st, str(tmp_path / "ck")).awaitTermination()
    assert st.read("seen_blob").count() == 2
    marks = spark.createDataFrame([("r", "p", "s", "main", "t1")], state.TABLES["ref_watermark"])
    st.persist({"ref_watermark": marks}, complete=False)
    assert st.watermarks().count() == 0
    st.persist({"ref_watermark": marks}, complete=True)
    st.persist({"ref_watermark": marks.withColumn("tip", F.lit("t2"))}, complete=True)
    assert st.watermarks().first().tip == "t2"


def test_policy_hash():
    from tarn.functions.rules import built_in
    from tarn.operators.scan import Tuning

    rules = built_in()
    assert state.policy_hash(rules, Tuning()) == state.policy_hash(rules[::-1], Tuning())
    assert state.policy_hash(rules, Tuning()) != state.policy_hash(rules[1:], Tuning())


def pax(body):
    head = bytearray(512)
    head[:4], head[124:136], head[156:157], head[257:263] = b"name", b"%011o\0" % len(body), b"x", b"ustar\0"
    head[148:156] = b"%06o\0 " % (sum(head) + 8 * 32)
    return bytes(head) + body.ljust(-(-len(body) // 512) * 512, b"\0")


def test_no_archive_hangs_or_fails():
    after = tar_of([("x", b"1")])
    for body in (b"0 path=zz\n", b"3 path=zz\n", b"99999999999999999999 path=a\n", b"12 path=abc\n0 path=d\n", b" ", b""):
        out = rows("a.tar", pax(body) + after)
        assert [r[1] for r in out] == [b"1"] and ("abc" in out[0][0]) == (b"abc" in body)
    two = gzip.compress(b"first ") + gzip.compress(b"second") + b"\0" * 20
    assert [r[1:] for r in rows("a.gz", two)] == [(b"first second", "scanned", None)]
    assert [r[3] for r in rows("a.gz", gzip.compress(b"\0" * 10**6))] == [None, "inflation_ratio_exceeded"]
    assert [r[3] for r in rows("a.gz", gzip.compress(b"abc" * 100), entry_bytes=10)] == [None, "entry_output_budget_exceeded"]
    assert rows("a.gz", two[:-30])[-1][3] == "gzip_corrupt" and rows("a.gz", b"")[0][3] == "gzip_corrupt"
    assert rows("a.tgz", gzip.compress(tar_of([("x", b"\0" * 10**6)])))[-1][3] in ("inflation_ratio_exceeded", "malformed_tar")
    whole = zip_of([("a", b"1"), ("b", b"2")])
    moved = bytearray(whole)
    at = moved.rfind(b"PK\x01\x02")
    moved[at + 42 : at + 46] = (len(whole) - 3).to_bytes(4, "little")
    assert [r[3] for r in rows("a.zip", bytes(moved))] == [None, "corrupt_entry"]
    for k in range(len(whole)):
        for data in (whole[:k], whole[:k] + bytes([whole[k] ^ 0xFF]) + whole[k + 1 :]):
            list(archives.Expander(archives.Budgets()).expand("a.zip", "zip", data))
    for k in range(0, len(after), 7):
        list(archives.Expander(archives.Budgets()).expand("a.tar", "tar", after[:k] + b"\xff" + after[k + 1 :]))


def test_odd_files(spark, tmp_path):
    import os

    odd = os.fsencode(tmp_path) + b"/\xff\xfe.txt"
    with open(odd, "wb") as f:
        f.write(b"k " + TOKEN)
    (tmp_path / "large.bin").write_bytes(b"x" * 5000)
    (tmp_path / "large.gz").write_bytes(gzip.compress(os.urandom(3000) + b" " + TOKEN))
    (tmp_path / "loop").symlink_to(tmp_path)
    found = files.files(spark, str(tmp_path), maxFileSize=2000, followSymlinks=True).collect()
    by = {bytes(r.path_bytes): r for r in found}
    assert by[odd].path.endswith("\\xff\\xfe.txt") and by[odd].length == 42 and len(found) == 3
    assert by[os.fsencode(tmp_path / "large.bin")].reason == "over_size_cap"
    hits = files.scan_path(spark, str(tmp_path), maxFileSize=2000).collect()
    assert len(hits) == 2 and any("large.gz::" in h.object_id for h in hits)


@pytest.mark.parametrize("rule,path,is_dir,gone", [("*.log", "a/b.log", False, True), ("a/*.log", "a/b/c.log", False, False), ("a/**/c", "a/x/y/c", False, True), ("**/c", "c", False, True), ("/x", "a/x", False, False), ("d/", "d", False, False), ("d/", "q/d", True, True), ("x/**", "x/y/z", False, True), ("[ab]?", "q/ac", False, True), ("\\#x", "#x", False, True), ("a*b*c", "a1b2c", False, True), ("a*b*c", "a1b/2c", False, False)])
def test_ignore_rules(rule, path, is_dir, gone):
    assert files.ignored([("", [files._ignore_rule(rule + "\n")])], path, is_dir) is gone


def test_ignore_files_of_folders(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".gitignore").write_text("*.log\n# none\n\n")
    (tmp_path / "sub" / ".gitignore").write_text("!keep.log\n/here\n")
    for n in ("a.log", "here", "sub/keep.log", "sub/b.log", "sub/here"):
        (tmp_path / n).write_text("x")
    got = {p[len(str(tmp_path)) + 1 :] for p, _ in files.walk(str(tmp_path), respect_gitignore=True)}
    assert got == {".gitignore", "here", "sub/.gitignore", "sub/keep.log"}


def test_incremental_history(spark, tmp_path):
    run = make_repo(tmp_path / "r")
    repo, store = str(tmp_path / "r"), state.State(spark, str(tmp_path / "state"))
    first = git.scan_changes(spark, repo, store)
    assert first.complete and [f.rule for f in first.findings.collect()] == ["github-pat"]
    rows = {r.path: r for r in first.contexts.where("path like 'f%'").collect()}
    assert set(rows) == {"f0", "f1", "f2", "f3"} and {(r.parent_idx, r.change) for r in rows.values()} == {(0, "Add")}
    assert sorted(r.change for r in first.contexts.where("path = 'a/long.txt'").collect()) == ["Add", "Modify", "Modify", "Modify"]
    assert store.read("blob_ctx").count() == store.read("seen_blob").count() == 9 and store.read("finding").count() == 1
    again = git.scan_changes(spark, repo, store)
    assert again.contexts.count() == 0 and again.findings.count() == 0
    # A side branch adds a file of a known content and a new one; the merge shows both against its first parent.
    run("checkout", "-q", "-b", "side", "HEAD~1")
    (tmp_path / "r" / "copy").write_bytes(b"late")
    (tmp_path / "r" / "vendor").mkdir()
    (tmp_path / "r" / "vendor" / "new.py").write_bytes(b"x = 1 " + TOKEN)
    run("add", "-A")
    run("commit", "-qm", "side")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "merged", "side")
    third = git.scan_changes(spark, repo, store)
    assert {(r.path, r.parent_idx, r.change, r.mode, r.path_class) for r in third.contexts.collect()} == {("vendor/new.py", 0, "Add", "100644", 5)}
    assert third.contexts.count() == 2 and third.findings.count() == 1  # of the side commit and of the merge
    assert store.read("blob_ctx").where("path = 'vendor/new.py'").count() == 1
    # A run of another policy sees everything again; the tips alone have no history.
    snapshot = git.scan_changes(spark, repo, state.State(spark, str(tmp_path / "other")), mode="snapshot")
    assert snapshot.contexts.where("path = 'a/long.txt'").count() == 1 and snapshot.complete


def test_incomplete_runs_leave_watermarks(spark, tmp_path):
    make_repo(tmp_path / "r")
    repo, store = tmp_path / "r", state.State(spark, str(tmp_path / "state"))
    oid = subprocess.run(["git", "rev-parse", "HEAD:late"], cwd=repo, capture_output=True, text=True, check=True).stdout.strip()
    lost = repo / ".git" / "objects" / oid[:2] / oid[2:]
    whole = lost.read_bytes()
    lost.chmod(0o644)
    lost.write_bytes(whole[:5])
    run = git.scan_changes(spark, str(repo), store)
    assert (run.complete, run.skipped) == (False, 1) and store.watermarks().count() == 0 and store.read("finding").count() == 1
    lost.write_bytes(whole)
    run = git.scan_changes(spark, str(repo), store)
    assert run.complete and [r.path for r in run.contexts.collect()] == ["late"] and store.watermarks().count() == 1


def test_sha256_tags_and_alternates(spark, tmp_path):
    def call(*a, cwd):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=cwd, check=True, capture_output=True)

    path = tmp_path / "r"
    path.mkdir()
    call("init", "-q", "-b", "main", "--object-format=sha256", cwd=path)
    (path / "f").write_bytes(TOKEN)
    call("add", "-A", cwd=path)
    call("commit", "-qm", "one", cwd=path)
    call("tag", "-a", "v1", "-m", "tagged", cwd=path)
    call("tag", "-a", "v2", "-m", "a tag of a tag", "v1", cwd=path)
    for _ in range(2):  # loose, then packed
        assert git.id_bytes(str(path)) == 32
        for r in git.objects(spark, str(path)).collect():
            assert git.object_id(r.type, bytes(r.content), 32) == r.oid
        assert git.scan_repository(spark, str(path), "branches_and_tags")[1].count() == 1
        call("gc", "-q", cwd=path)
    call("clone", "-q", "--shared", str(path), str(tmp_path / "c"), cwd=tmp_path)
    assert git.scan_repository(spark, str(tmp_path / "c"))[1].count() == 1
    told = git.preflight(str(tmp_path / "c"))
    assert told["packs"] == 1 and told["packs_without_index"] == 0 and told["locked"] == []
    with pytest.raises(ValueError):
        git.preflight(str(path), most_packs=0)


def test_shallow_clone(spark, tmp_path):
    make_repo(tmp_path / "r")
    subprocess.run(["git", "clone", "-q", "--depth", "2", f"file://{tmp_path / 'r'}", str(tmp_path / "c")], check=True, capture_output=True)
    assert git.scan_repository(spark, str(tmp_path / "c"))[0].count() == 6


def test_multi_pack_index(spark, tmp_path):
    run = make_repo(tmp_path / "r")
    repo = tmp_path / "r"
    run("repack", "-q")  # a second pack, of the late objects
    run("multi-pack-index", "write")
    (repo / "later").write_bytes(b"later")
    run("add", "-A")
    run("commit", "-qm", "later")
    run("repack", "-q")  # a third one, which the index of many doesn't cover
    want = set()
    for p in (repo / ".git" / "objects" / "pack").glob("*.idx"):
        told = subprocess.run(["git", "show-index"], stdin=p.open("rb"), capture_output=True, text=True, check=True).stdout
        want |= {(x.split()[1], p.stem + ".pack", int(x.split()[0])) for x in told.splitlines()}
    got = {tuple(r) for r in git.object_index(spark, str(repo)).collect()}
    assert got == want and len({r[1] for r in got}) == 3
    # Trees that git wrote are in the order of ``tree_order``.
    rows = git.tree_entries(git.objects(spark, str(repo))).withColumn("key", history.tree_order(F.col("name"), F.col("kind"))).orderBy("tree", "ord").collect()
    assert [(r.tree, r.key) for r in rows] == sorted((r.tree, r.key) for r in rows)
