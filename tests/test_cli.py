"""The command line on a small book, and its exit codes."""

import json

import pytest
from test_convert import book

from quire.__main__ import main


def test_commands_and_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.epub").write_bytes(book([("c", "c.xhtml", '<h1>Hi</h1><p><a href="gone.xhtml">x</a></p>')], [("Hi", "c.xhtml")]))
    out = str(tmp_path / "out")
    assert main(["convert", str(tmp_path / "in"), "-o", out], spark) == 0
    said = capsys.readouterr()
    assert "1 books" in said.out and "LINK_UNRESOLVED" not in said.err
    assert main(["convert", str(tmp_path / "in"), "-o", out, "--strict", "-v"], spark) == 1
    assert "LINK_UNRESOLVED" in capsys.readouterr().err
    assert main(["validate", out], spark) == 0
    (tmp_path / "out" / "good.epub" / "index.md").unlink()
    assert main(["validate", out, "--json"], spark) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["code"] == "VALIDATE_MISSING_FILE"
    assert main(["report", out], spark) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "completed_with_errors"
    assert main(["inspect", str(tmp_path / "in"), "--json"], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["title"] == "A Book" and [x["title"] for x in told["nav_toc"]] == ["Hi"] and told["resources"] == 2
    (tmp_path / "in" / "bad.epub").write_bytes(b"x")
    assert main(["inspect", str(tmp_path / "in")], spark) == 2
    assert main(["convert", str(tmp_path / "in"), "-o", out], spark) == 2
    assert main(["validate", str(tmp_path / "nothing")], spark) == 3
    assert main(["version"]) == 0
    with pytest.raises(SystemExit) as e:
        main(["convert"])
    assert e.value.code == 3
