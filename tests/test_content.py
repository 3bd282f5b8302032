"""Content fingerprints do not depend on splits and see every byte."""

import os
import random

import pytest

from sparkloom.session import new_scratch_path
from sparkloom.sources import content


def test_hash_of_pieces():
    rng = random.Random(1)
    data, powers = rng.randbytes(200_000), content._powers()
    whole = content.extend([0, 0, 0], data, powers)
    assert whole == [sum((b + 1) * pow(p, len(data) - 1 - i, content.PRIME) for i, b in enumerate(data)) % content.PRIME for p in content.POINTS[:1]] + whole[1:]
    for cut in (0, 1, 65_536, 199_999):
        a, b = data[:cut], data[cut:]
        assert content.joined((len(a), content.extend([0] * 3, a, powers)), (len(b), content.extend([0] * 3, b, powers))) == (len(data), whole)


def test_files(spark):
    folder = new_scratch_path(spark, "content").removeprefix("file://")
    os.makedirs(f"{folder}/deep")
    rng = random.Random(2)
    files = {"a.bin": rng.randbytes(300_000), "b.txt": b"one\ntwo\n", "c.txt": b"one\ntwo", "deep/d.txt": b"one\ntwo\n", "e.txt": b"", "f.txt": b"\n", "g.txt": "ä\r\nö\n".encode() * 1000, "h.bin": b"\0" * 5000, "i.bin": b"\0" * 5001}
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    del files["e.txt"]  # empty: Spark's readers pass over it
    found = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "10k", "333b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = content.content_fingerprints(spark, folder).collect()
            found.append({r["path"].split(folder.rsplit("/", 1)[-1] + "/")[1]: (r["length"], r["fingerprint"]) for r in rows})
            assert len(rows) == len(files)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] == found[2] and {k: v[0] for k, v in found[0].items()} == {k: len(v) for k, v in files.items()}
    prints = {k: v[1] for k, v in found[0].items()}
    assert prints["b.txt"] == prints["deep/d.txt"] and len(set(prints.values())) == len(files) - 1
    changed = bytearray(files["a.bin"])
    changed[150_000] ^= 1
    with open(f"{folder}/a.bin", "wb") as f:
        f.write(changed)
    assert {r["fingerprint"] for r in content.content_fingerprints(spark, folder, "a.bin").collect()} != {prints["a.bin"]}
    with pytest.raises(Exception):
        content.content_fingerprints(spark, f"{folder}/nothing-here").collect()
