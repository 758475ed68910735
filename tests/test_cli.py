import json
import subprocess

import pytest

from tarn.__main__ import main, parser


def test_arguments():
    assert parser().parse_args(["scan", "git", "--repo=x"]).start_set == "default"
    with pytest.raises(SystemExit):
        parser().parse_args(["scan", "fs"])


def test_scan_prints_events(spark, tmp_path, capsys):
    (tmp_path / ".env").write_bytes(b"token ghp_aB3dE5gH7jK9mN1pQ3sT5vW7xY9zA2cD4fG6\n")
    assert main(["scan", "fs", f"--path={tmp_path}"]) == 0
    out = capsys.readouterr()
    event = json.loads(out.out.splitlines()[-1])
    assert event["rule"] == "github-pat" and (event["start"], event["end"]) == (6, 46) and event["path"].endswith(".env")
    progress, summary = (json.loads(x) for x in out.err.strip().splitlines()[-2:])
    assert progress == {"type": "progress", "source": "fs", "stage": "scan", "objects": 1, "bytes": 47, "findings": 1}
    assert (summary["findings"], summary["bytes"], summary["status"]) == (1, 47, "complete")


def test_skipped_files_are_told(spark, tmp_path, capsys):
    (tmp_path / "large").write_bytes(b"x" * 100)
    (tmp_path / "small").write_bytes(b"y" * 9)
    assert main(["scan", "fs", f"--path={tmp_path}", "--max-file-size=50"]) == 0
    progress, diagnostic, summary = (json.loads(x) for x in capsys.readouterr().err.strip().splitlines()[-3:])
    assert (progress["objects"], progress["bytes"]) == (1, 9)
    assert diagnostic == {"type": "diagnostic", "level": "warn", "message": "1 objects skipped"}
    assert (summary["status"], summary["errors"]) == ("partial", 1)


def test_repository_with_state(spark, tmp_path, capsys):
    path = tmp_path / "r"
    path.mkdir()
    (path / "f").write_bytes(b"token ghp_aB3dE5gH7jK9mN1pQ3sT5vW7xY9zA2cD4fG6\n")
    for a in (["init", "-q", "-b", "main"], ["add", "-A"], ["commit", "-qm", "one"]):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=path, check=True, capture_output=True)
    call = ["scan", "git", f"--repo={path}", f"--state={tmp_path / 'state'}"]
    for want in (1, 0):
        assert main(call) == 0
        summary = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
        assert (summary["findings"], summary["status"], summary["bytes"]) == (want, "complete", 47 * want)
