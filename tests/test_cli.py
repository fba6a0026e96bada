import json

import pytest

from kindred import cli

from .mails import box, contents, make


def test_runs_and_exit_codes(spark, tmp_path, capsys):
    path = box(tmp_path / "b", "eml", [make(), make(), make(message_id="<b>")])
    assert cli.main([path, "-s", "select-one", "-a", "delete-discarded"], spark) == 0
    assert "deleted" in capsys.readouterr().out and len(contents(path, "eml")) == 2
    assert cli.main(["-H", path], spark) == 0
    assert capsys.readouterr().out.count("Hash: ") == 2
    assert cli.main([], spark) == 0 and "usage" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "nowhere"), "-a", "delete-discarded"], spark) == 1
    for bad in ([path, "-s", "select-matching-path", "-a", "delete-discarded"], [path], [path, "-k", "a b", "-a", "delete-discarded"], [path, "-S", "-2", "-a", "delete-discarded"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad, spark)
        assert e.value.code == 2


def test_precedence(tmp_path):
    for name, text in (("c.toml", '[kindred]\nsize-threshold = 7\nstrategies = ["select-one"]\n'), ("c.json", json.dumps({"kindred": {"size_threshold": 7, "strategies": ["select-one"]}})), ("c.ini", '[kindred]\nsize_threshold = 7\nstrategies = ["select-one"]\n')):
        (tmp_path / name).write_text(text)
        args = ["--config", str(tmp_path / name)]
        assert cli.options(args, {})[1].size_threshold == 7 and cli.options(args, {})[1].strategies == ("select-one",)
        assert cli.options(args, {"KINDRED_SIZE_THRESHOLD": "8"})[1].size_threshold == 8
        assert cli.options([*args, "-S", "9"], {"KINDRED_SIZE_THRESHOLD": "8", "KINDRED_DRY_RUN": "yes"})[1].size_threshold == 9
    (tmp_path / "bad.toml").write_text("nonsense = 1\n")
    with pytest.raises(SystemExit):
        cli.options(["--config", str(tmp_path / "bad.toml")], {})
