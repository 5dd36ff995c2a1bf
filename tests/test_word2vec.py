"""Binary word vectors cut at any byte, beside plain parsing."""

from __future__ import annotations

import random
import struct

import pytest

from pairloom.sources.word2vec import read_word2vec, write_word2vec


def binary(rows, newline):
    out = f"{len(rows)} {len(rows[0][1])}\n".encode()
    for word, vec in rows:
        out += word.encode() + b" " + struct.pack(f"<{len(vec)}f", *vec) + (b"\n" if newline else b"")
    return out


def made(rng, n, width):
    """Words of many lengths, numbers whose bytes look like spaces, line feeds and letters."""
    odd = [struct.unpack("<f", bytes(x))[0] for x in (b"   =", b"\n\n\n=", b"abc=", b"a b<", b"\x00\x00\x00\x00")]
    words = [f"{'wé中'[k % 3] * rng.randrange(1, 12)}{k}" for k in range(n)]
    return [(w, [rng.choice(odd) if rng.random() < 0.4 else struct.unpack("<f", struct.pack("<f", rng.gauss(0, 0.3)))[0] for _ in range(width)]) for w in words]


def rows_of(df):
    return sorted((r.token, r.vec) for r in df.collect())


@pytest.mark.parametrize("newline", [False, True])
@pytest.mark.parametrize("width, step", [(1, 700), (3, 911), (64, 5000), (64, 1 << 26)])
def test_ranges_give_every_record_once(spark, tmp_path, newline, width, step):
    rows = made(random.Random(width), 400, width)
    (tmp_path / "x.bin").write_bytes(binary(rows, newline))
    df = read_word2vec(spark, str(tmp_path / "x.bin"), step)
    assert df.dtypes == [("token", "string"), ("vec", "array<float>")]
    assert rows_of(df) == sorted(rows)
    assert df.rdd.getNumPartitions() == 1 if step > 1 << 20 else df.rdd.getNumPartitions() > 3


def test_folders_are_written_and_read(spark, tmp_path):
    rows = made(random.Random(2), 300, 8)
    df = spark.createDataFrame(rows, "token string, vec array<float>")
    write_word2vec(df.repartition(3), str(tmp_path / "v"))
    write_word2vec(df.where("token like 'w%'").coalesce(1), f"file:{tmp_path}/v")
    assert rows_of(read_word2vec(spark, str(tmp_path / "v"), 2000)) == sorted(rows + [r for r in rows if r[0].startswith("w")])
    assert len([x for x in (tmp_path / "v").iterdir()]) == 4 and not any(x.is_dir() for x in (tmp_path / "v").iterdir())
    write_word2vec(df.limit(0), str(tmp_path / "v"))
    for bad in ([("a b", [1.0])], [("", [1.0])], [("a", [float("nan")])], [("a", [])], [("a", [1.0]), ("b", [1.0, 2.0])]):
        with pytest.raises(Exception):
            write_word2vec(spark.createDataFrame(bad, "token string, vec array<float>").coalesce(1), str(tmp_path / "w"))
    assert not (tmp_path / "w").exists() or not list((tmp_path / "w").glob("*.bin"))


def test_files_in_another_layout_are_errors(spark, tmp_path):
    good = binary(made(random.Random(1), 50, 4), True)
    for name, raw in (("a", b"no header\n123"), ("b", good[:8] + b"\x00" * 500), ("c", good[:-3])):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception):
            read_word2vec(spark, str(tmp_path / name), 200).collect()
