"""Folders with good, cut, damaged and alien files."""

from __future__ import annotations

import random
import struct

import pytest

from cadentia.sources import fit, imports
from tests.test_fit import RECORD, definition


def ride(n: int = 50, seal: bool = True) -> bytes:
    record = lambda i: bytes([0]) + struct.pack("<IBHIH", 1000 + i, 100 + i % 50, 200 + i, 100 * i, 3000)
    # definitions come again, as devices write them after a pause
    body = b"".join((definition(0, fit.RECORD, RECORD) if i % 10 == 0 else b"") + record(i) for i in range(n))
    file = bytes([14, 32]) + struct.pack("<H", 2132) + struct.pack("<I", len(body)) + b".FIT" + b"\0\0" + body
    return file + struct.pack("<H", fit.crc16(file)) if seal else file + b"\0\0"


def bitwise(data: bytes) -> int:
    value = 0
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (0xA001 if value & 1 else 0)
    return value


def test_checksum():
    assert fit.crc16(b"123456789") == 0xBB3D == bitwise(b"123456789")
    rng = random.Random(2)
    for _ in range(20):
        data = rng.randbytes(rng.randint(0, 60))
        assert fit.crc16(data) == bitwise(data)
        assert fit.crc16(data + struct.pack("<H", fit.crc16(data))) == 0


def read(data: bytes, salvage: bool = False):
    told = fit.End()
    return [int(m.values[253]) - 1000 for m in fit.messages(data, told, salvage) if 253 in m.values], told


def test_reasons():
    whole = ride()
    assert read(whole)[0] == list(range(50)) and read(whole)[1].reason is None
    assert read(ride(seal=False))[1].reason is None
    cut, told = read(whole[:200])
    assert cut == list(range(len(cut))) and told.reason == "breaks off" and told.bytes_lost < 14
    assert read(b"plain text that is no such file")[1].reason == "not a FIT file" and read(b"")[1].reason == "not a FIT file"
    flipped = bytearray(whole)
    flipped[60] ^= 1
    assert read(bytes(flipped))[1].reason == "checksum"


@pytest.mark.parametrize("seed", range(30))
def test_what_lies_outside_the_damage_is_salvaged(seed):
    """Bytes overwritten between two definitions lose at most the samples up to the next one."""
    rng = random.Random(seed)
    whole = bytearray(ride())
    block = 6 + 3 * len(RECORD) + 10 * 14  # a definition and ten records
    first = rng.randint(0, 4)
    begin = 14 + first * block + rng.randint(0, block - 1)
    size = rng.randint(1, min(40, 14 + (first + 1) * block - begin))
    whole[begin : begin + size] = bytes([0x0B] * size)  # messages of a number that nothing defines
    found, told = read(bytes(whole), salvage=True)
    outside = {i for i in range(50) if i // 10 != first}
    assert outside <= set(found) and told.reason == "checksum"


def test_salvage_past_a_lost_head():
    whole = bytearray(ride())
    whole[:14] = b"\xff" * 14
    assert read(bytes(whole), salvage=True)[0] == list(range(50))
    assert read(bytes(whole))[0] == []


def test_import_of_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "below").mkdir(parents=True)
    files = {"good.fit": ride(), "cut.fit": ride()[:300], "alien.fit": b"nothing of the kind", "empty.fit": b"", "bare.fit": ride(0), "CAPS.FIT": ride(), "notes.txt": b"x", "below/deep.fit": ride(), "ok.csv": b"time,hr\n0,100\n1,101\n", "head.csv": b"time,hr\n", "odd.csv": b"a,b\n1,2\n", "a b+c.csv": b""}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    name = lambda r: r.path.rsplit("/", 1)[1]
    out = imports.import_fit(spark, str(folder), str(tmp_path / "out"))
    assert {name(r): (r.state, r.reason, r.points) for r in out.results.collect()} == {
        "good.fit": ("imported", None, 50), "cut.fit": ("failed", "breaks off", 0), "alien.fit": ("failed", "not a FIT file", 0), "empty.fit": ("failed", "empty file", 0), "bare.fit": ("failed", "no samples", 0),
    }
    assert out.points.count() == 50 and all((r.millis is None) == (r.reason == "empty file") for r in out.results.collect())
    assert {k: out.counted[k] for k in ("files", "imported", "failed", "points")} == {"files": 4, "imported": 1, "failed": 3, "points": 50}
    plain = {(r.seq, r.ts_s, r.heart_rate, r.power) for r in fit.read_fit(spark, str(folder / "good.fit")).collect()}
    assert {(r.seq, r.ts_s, r.heart_rate, r.power) for r in out.points.collect()} == plain
    kept = imports.import_fit(spark, str(folder), str(tmp_path / "salvaged"), salvage=True)
    assert {name(r): (r.state, r.reason) for r in kept.results.collect() if r.points} == {"good.fit": ("imported", None), "cut.fit": ("imported", "breaks off")}
    points, results = imports.import_csv(spark, str(folder))
    assert {name(r): (r.state, r.reason, r.points) for r in results.collect()} == {"ok.csv": ("imported", None, 2), "head.csv": ("failed", "no rows", 0), "odd.csv": ("failed", "no known column has a value", 0), "a b+c.csv": ("failed", "no rows", 0)}
    assert points.count() == 2
    others = imports.skipped(spark, str(folder))
    assert {name(r) for r in others.collect()} == {"notes.txt", "CAPS.FIT"}
    told = imports.report(out.results.unionByName(results).unionByName(others), seconds=2.0).first()
    assert (told.files, told.imported, told.failed, told.skipped, told.success_pct, told.points, told.files_per_second) == (11, 2, 7, 2, 200 / 9, 52, 1.0)
    assert {(r.state, r.reason): r.files for r in imports.failures_by_reason(out.results).collect()} == {("failed", "breaks off"): 1, ("failed", "not a FIT file"): 1, ("failed", "empty file"): 1, ("failed", "no samples"): 1}
    assert imports.report(out.results.limit(0)).first().success_pct == 0
