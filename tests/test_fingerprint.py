"""SHA-256 of files that tasks read by pieces."""

import hashlib
import random

from sigevents.operators import fingerprint


def test_pieces_give_the_hash_of_the_whole_file(spark, tmp_path):
    """Any bytes: line feeds at the end or not, byte order marks; no task has more than a piece and a line of a file."""
    r = random.Random(1)
    made = {"a": r.randbytes(300_000), "b c%20": b"\xef\xbb\xbf" + r.randbytes(70_000) + b"\n\n", "mark": b"\xef\xbb\xbf", "mark2": b"\xef\xbb\xbfx\ny", "feed": b"\n", "cr": b"a\r\nb\rc\r\n", "no": b"\xff\x00\xfe"}
    (tmp_path / "in").mkdir()
    for name, raw in made.items():
        (tmp_path / ("in/" if name == "a" else "") / f"{name}.bin").write_bytes(raw)
    (tmp_path / "other.txt").write_bytes(b"x")
    want = {name: hashlib.sha256(raw).hexdigest() for name, raw in made.items()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        got = {row.path.rsplit("/", 1)[-1][:-4]: row.sha256 for row in fingerprint.content_fingerprint(spark, str(tmp_path), "*.bin", 100_000).collect()}
        assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_the_state_is_carried_on():
    raw = random.Random(2).randbytes(1000)
    sha = fingerprint.Sha256()
    sha.update(raw[:333])
    more = fingerprint.Sha256(sha.state())
    more.update(raw[333:])
    assert more.hexdigest() == hashlib.sha256(raw).hexdigest()
