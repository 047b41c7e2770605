"""Taking files in, against the rules one by one."""

import hashlib
import re
from pathlib import Path

from rivalscope.sources.ingest import SUFFIXES, ingest

FILES = {
    "a/shot one.png": b"1", "a/copy.PNG": b"1", "b/deep/er/tab view.JPG": b"22", "b/notes.txt": b"3", "b/none": b"4", "c/empty.bmp": b"", "c/large.webp": b"x" * 101, "c/held.jpeg": b"held", "c/held too.jpeg": b"held",
    "d/" + "n" * 60 + ".png": b"6", "d/***.png": b"7", "d/two.dots.png": b"8", "d/bad.png.exe": b"9",
}


def brute(held, most):
    taken, out = {}, {}
    for path in sorted(FILES):
        data, p = FILES[path], Path(path)
        sha = hashlib.sha256(data).hexdigest()
        if p.suffix.lower() not in SUFFIXES:
            out[path] = "unsupported type"
        elif not data:
            continue
        elif len(data) > most:
            out[path] = "too large"
        elif sha in held:
            out[path] = "already in a match"
        elif sha in taken:
            out[path] = "copy of another file"
        else:
            taken[sha] = path
            stem = re.sub(r"[^\w\-]", "", p.stem[:40].replace(" ", "_")) or "shot"
            out[path] = (f"{stem}-{sha[:12]}{p.suffix.lower()}", "in_game_scoreboard" if "tab" in p.name else "endgame_report", len(data), sha)
    return out


def test_ingest(spark, tmp_path):
    for path, data in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    held = spark.createDataFrame([(hashlib.sha256(b"held").hexdigest(),), (None,)], "file_sha256 string")
    got = ingest(spark, str(tmp_path), held, most=100)
    local = lambda path: re.sub(r"%20", " ", path).split(str(tmp_path) + "/")[1]
    found = {local(x.path): x.reason for x in got.rejected.collect()} | {local(x.path): (x.name, x.kind, x.bytes, x.file_sha256) for x in got.accepted.collect()}
    assert found == brute({hashlib.sha256(b"held").hexdigest()}, 100)
