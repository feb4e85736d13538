import json

import pytest

from kinespark import cli
from kinespark.cli.demos import HandsDemo, RewardsDemo
from kinespark.cli.notebooks import notebook, script, walkthrough


@pytest.mark.parametrize("method", ["mediapipe", "wilor", "both"])
@pytest.mark.parametrize("runtime", ["local", "cluster"])
def test_all_forms_compile_and_agree(method, runtime):
    cells = HandsDemo(method, runtime, None if method == "mediapipe" else "/m.pkl", with_eval=runtime == "local").cells()
    compile(script(cells), "demo.py", "exec")
    told = json.loads(notebook(cells))
    assert ["".join(c["source"]) for c in told["cells"]] == [t for _, t in cells]
    text = walkthrough(cells)
    assert all(t in text for _, t in cells)


def test_walkthrough_outputs():
    got = walkthrough([(True, "a"), (False, "b"), (True, "c"), (True, "d")], ["1", "| x |"])
    assert "```\n1\n```" in got and "\n| x |" in got and "```\n| x" not in got


@pytest.mark.parametrize("bad", [{"method": "x"}, {"runtime": "x"}, {"method": "wilor"}, {"limit": 0}, {"runtime": "cluster", "with_eval": True}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        HandsDemo(**bad).validate()


def test_commands(tmp_path, capsys, monkeypatch):
    assert cli.main([]) == 0 and "hands" in capsys.readouterr().out
    go = lambda *a: cli.main([*a, f"--output-dir={tmp_path}/d"])
    assert go("hands", "--no-input") == 0 and sorted(p.name for p in (tmp_path / "d").iterdir()) == ["demo.ipynb", "demo.md", "demo.py"]
    assert "match_hands" in (tmp_path / "d/demo.py").read_text()
    assert go("hands", "--no-input") == 1 and go("hands", "--no-input", "--force", "--no-with-eval") == 0
    assert "match_hands" not in (tmp_path / "d/demo.py").read_text()
    assert go("hands", "--no-input", "--force", "--dataset", "other") == 0 and "match_hands" not in (tmp_path / "d/demo.py").read_text()
    assert go("hands", "--no-input", "--method", "wilor") == 2 and go("hands", "--no-input", "--limit", "0") == 2
    assert go("hands", "--no-input", "-f", "--runtime", "cluster") == 0 and "local[*]" in (tmp_path / "d/demo.py").read_text()
    monkeypatch.setattr("sys.stdin.isatty", lambda: False, raising=False)
    assert go("rewards") == 2
    assert go("rewards", "--no-input", "--force", *"--dataset=my/dataset --split=sp --video-key=cam --episodes=3 --max-frames=4".split()) == 0
    text = (tmp_path / "d/demo.py").read_text()
    assert "'my/dataset', 'sp', 'cam'" in text and "EPISODES, MAX_FRAMES = 3, 4" in text


def test_questions(tmp_path, monkeypatch):
    monkeypatch.setattr("sys.stdin.isatty", lambda: True, raising=False)
    said = iter(["nope", "both", "", "/m.pkl", "", "", "x", "7", "n", str(tmp_path / "q")])
    monkeypatch.setattr("builtins.input", lambda *_: next(said))
    assert cli.main(["hands"]) == 0
    text = (tmp_path / "q/demo.py").read_text()
    assert "hands_wilor" in text and ", 7" in text and "match_hands" not in text


def test_rewards_settings():
    compile(script(RewardsDemo().cells()), "demo.py", "exec")
    with pytest.raises(ValueError):
        RewardsDemo(episodes=0).cells()


def test_pictures():
    import struct
    import zlib
    from xml.etree import ElementTree

    import numpy as np

    from kinespark.cli import drawing as D

    image = {"height": 20, "width": 30, "nChannels": 3, "mode": "RGB", "data": bytes(20 * 30 * 3)}
    points = [[2.0, 3.0]] + [[10.0 + k, 12.0] for k in range(18)] + [[float("nan"), 1.0], [900.0, -900.0]]
    black = D.pixels(image)
    drawn = D.with_hands(black, [{"handedness": "left", "kp2d": points}, {"handedness": "?", "kp2d": points[:2]}])
    assert not black.any() and (drawn[3, 2] == D.COLOURS["unknown"]).all() and (drawn[12, 25] == D.COLOURS["left"]).all()
    assert (D.with_hands(black, None) == black).all() and len(D.BONES) == 20 and (0, 5) in D.BONES and (7, 8) in D.BONES
    truth = D.with_truth(black, np.array([[[5.0, 5], [9, 9], [9, 5], [5, 9], [1, 1], [np.nan, 2]]]))
    assert (truth[7, 7] == D.COLOURS["truth"]).all() and (truth[9, 9] == D.COLOURS["truth"]).all()
    whole = D.montage([black, truth[:5, :5], drawn], columns=2)
    assert whole.shape == (42, 62, 3) and (whole[21, 5] == 255).all() and (whole[22:42, :30] == drawn).all() and D.montage([]).shape == (1, 1, 3)
    file = D.png(whole)
    assert file[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", file[16:24]) == (62, 42)
    at = file.index(b"IDAT")
    size = struct.unpack(">I", file[at - 4 : at])[0]
    raw = np.frombuffer(zlib.decompress(file[at + 4 : at + 4 + size]), np.uint8).reshape(42, -1)
    assert (raw[:, 1:].reshape(whole.shape) == whole).all()
    tree = ElementTree.fromstring(D.curves_svg({"a < b": [(0.0, 0.1), (1.0, 2.0)], "c": []}))
    assert len(tree.findall("{http://www.w3.org/2000/svg}polyline")) == 2 and ElementTree.fromstring(D.curves_svg({})) is not None
