"""Roots and files behind links."""

import pytest

from capsieve.plans import flows
from capsieve.sources import files


@pytest.fixture
def linked(tmp_path):
    for folder in ("one", "two", "far"):
        (tmp_path / folder).mkdir()
    (tmp_path / "far" / "v.mp4").write_bytes(b"1")
    (tmp_path / "far" / "t.txt").write_text("text")
    (tmp_path / "one" / "b.mp4").symlink_to(tmp_path / "far" / "v.mp4")
    (tmp_path / "one" / "A.mp4").symlink_to(tmp_path / "far" / "v.mp4")
    (tmp_path / "one" / "A.txt").symlink_to(tmp_path / "far" / "t.txt")
    (tmp_path / "one" / "lost.mp4").symlink_to(tmp_path / "nowhere.mp4")
    (tmp_path / "two" / "own.mp4").write_bytes(b"2")
    (tmp_path / "alias").symlink_to(tmp_path / "two", target_is_directory=True)
    return tmp_path


def test_roots(linked):
    names = [f"{linked}/two/", f"{linked}/alias", f"{linked}/one/../one", f"file://{linked}/two"]
    assert files.normalize_roots(names) == [f"{linked}/two", f"{linked}/one", f"file://{linked}/two"]
    for bad in ([f"{linked}/none"], [f"{linked}/two/own.mp4"]):
        with pytest.raises(ValueError, match="no such folder"):
            files.normalize_roots(bad)
    with pytest.raises(ValueError, match="at least one"):
        files.normalize_roots([])


def test_scan_takes_files_behind_links(spark, linked):
    found = flows.scan(spark, [f"{linked}/alias", f"{linked}/one", f"{linked}/two"])
    got = {r["video_path"]: r["target_path"] for r in found["candidates"].collect()}
    # Of two names of the video the first counts, and its text is the file behind the link beside it.
    assert got == {f"{linked}/two/own.mp4": f"{linked}/two/own.txt", f"{linked}/far/v.mp4": f"{linked}/far/t.txt"}
    assert found["conflicts"].isEmpty() and found["protected"].isEmpty()
    assert found["summary"].first()["matched_text_count"] == 1
