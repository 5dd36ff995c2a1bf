"""Records with quoted line breaks, in as many ranges as there are, beside plain readers."""

from __future__ import annotations

import csv
import io
import random

import pytest

from pairloom.sources.csv_pairs import read_test_pairs, read_train_pairs
from pairloom.sources.csv_records import ends_inside, read_records

LINES = ["is_duplicate,id,question2,question1", '1,7,"a, ""quoted"" text","line one', 'line two"', "0,3,NaN,back\\slash", '0,5,"nan?",']


@pytest.fixture(params=[30, 1 << 20])
def ranges(spark, request):
    """Bytes that one range has at most."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(df):
    return [tuple(r)[:-1] for r in sorted(df.collect(), key=lambda r: r._position)]


def plain(text):
    return [tuple(x or None for x in r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r]


def random_file(rng, rows):
    out = ["a,b,c"]
    for k in range(rows):
        fields = []
        for _ in range(3):
            kind = rng.random()
            if kind < 0.4:
                fields.append("".join(rng.choice("xyz é") for _ in range(rng.randrange(1, 9))).strip() or "w")
            elif kind < 0.5:
                fields.append(f'5{chr(34)} disk')  # a quote inside an open field is text
            elif kind < 0.6:
                fields.append("")
            else:
                inner = "".join(rng.choice(['""', ",", "\n", "x", "yy ", "\r\n"]) for _ in range(rng.randrange(1, 25)))
                fields.append(f'"{inner}"')
        out.append(",".join(fields))
        if rng.random() < 0.05:
            out.append("")
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(2))
def test_random_files(spark, tmp_path, ranges, seed):
    rng = random.Random(seed)
    text = random_file(rng, 30)
    (tmp_path / "x.csv").write_text(text, newline="")
    df = read_records(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["a", "b", "c", "_position"] and rows_of(df) == plain(text)
    if ranges == 30:
        assert spark.read.text(str(tmp_path / "x.csv"), lineSep="\n").rdd.getNumPartitions() > 10


def test_many_files_in_order(spark, tmp_path, ranges):
    rng = random.Random(9)
    texts = {f"part-{k}.csv": random_file(rng, 8) for k in range(4)} | {"part-9.csv": "a,b,c\n", "part-8.csv": "a,b,c"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    assert rows_of(read_records(spark, str(tmp_path))) == [r for name in sorted(texts) for r in plain(texts[name])]


def test_default_reader_equals_the_multi_line_reader(spark, tmp_path, ranges):
    path = str(tmp_path / "train.csv")
    (tmp_path / "train.csv").write_text("\n".join(LINES) + "\n")
    key = ("id", "question1", "question2", "is_duplicate")
    both = [sorted(tuple(r[c] for c in key) for r in read_train_pairs(spark, path, multiline=m).collect()) for m in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 3
    assert {r[0]: r[1] for r in both[0]}[7] == "line one\nline two"


def test_undecodable_bytes_and_carriage_returns_stay(spark, tmp_path, ranges):
    raw = b'\xef\xbb\xbfid,question1,question2,is_duplicate\r\n1,"caf\xe9, one\r\ntwo",x,1\r\n2,\xff\xfe,"y ""z""",0\r\n\r\n3,ok,"\xc3\xa9",1'
    (tmp_path / "x.csv").write_bytes(raw)
    df = read_records(spark, str(tmp_path / "x.csv"))
    got = [tuple(map(bytes, r)) for r in df.orderBy("_position").selectExpr("cast(id as binary)", "cast(question1 as binary)", "cast(question2 as binary)", "cast(is_duplicate as binary)").collect()]
    assert got == [(b"1", b"caf\xe9, one\r\ntwo", b"x", b"1"), (b"2", b"\xff\xfe", b'y "z"', b"0"), (b"3", b"ok", b"\xc3\xa9", b"1")]
    assert read_train_pairs(spark, str(tmp_path / "x.csv")).count() == 3


def test_a_field_over_many_ranges_and_one_that_never_ends(spark, tmp_path, ranges):
    long = "\n".join(f"line {k}" for k in range(60))
    (tmp_path / "x.csv").write_text(f'test_id,question1,question2\n1,"{long}",b\n1,c,"d\n\ne"\n4,f,"open\nto the end')
    df = read_test_pairs(spark, str(tmp_path / "x.csv"))
    got = [(r.test_id, r.question1, r.question2) for r in df.orderBy("position").collect()]
    assert got == [(1, long, "b"), (1, "c", "d\n\ne"), (4, "f", "open\nto the end")]


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="b.csv"):
        read_records(spark, str(tmp_path))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.csv").write_text('a,"b\nc"\n1,2\n')
    with pytest.raises(ValueError, match="one line"):
        read_records(spark, str(tmp_path / "c"))
    (tmp_path / "d.csv").write_text('"x, y",z\n1\n1,2,3\n')
    df = read_records(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["x, y", "z", "_position"] and rows_of(df) == [("1", None), ("1", "2")]


def test_only_crossing_records_are_shuffled(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "1,2\n" * 50)
    plan = read_records(spark, str(tmp_path / "x.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_quotes_open_fields_at_their_start_only():
    assert not ends_inside(b'a,5" disk,b', False) and ends_inside(b'a,"5', False) and not ends_inside(b'5",b', True)
    assert ends_inside(b'a","b', True) and not ends_inside(b'"a""",""', False) and ends_inside(b'""', True)
