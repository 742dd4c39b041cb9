from slatecast.__main__ import main


def test_command(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    cube, out = tmp_path / "a.cube", tmp_path / "out.csv"
    cube.write_text("LUT_3D_SIZE 2\n" + "".join(f"{r} {g} {b}\n" for b in (0, 1) for g in (0, 1) for r in (0, 1)))
    decoder = "decoder=slatecast.sources.synthetic.SyntheticDecoder"
    assert main(["-v", "made up", "-l", str(cube), "-s", "0", "-e", "16", "-o", str(out), decoder]) == 0
    lines = out.read_text(encoding="utf-8-sig").splitlines()
    assert len(lines) > 1 and all(":" in line for line in lines[1:])
    assert main(["-v", str(tmp_path / "none.raw"), "-o", str(out), "width=2", "height=2"]) == 1
    assert main(["-v", "dir/made.up", "-s", "0", "-e", "16", "--sequential", decoder]) == 0
    again = (tmp_path / "made_detected_frames_paddle_refactored.csv").read_text(encoding="utf-8-sig").splitlines()
    assert len(again) > 1
    assert main(["-v", "dir/made.up", "-e", "16", "--legacy", decoder]) == 0
    assert len((tmp_path / "made_detected_frames_paddle.csv").read_text(encoding="utf-8-sig").splitlines()) > 1
