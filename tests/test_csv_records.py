"""Splittable CSV against the whole-file reader, over ranges of a few bytes."""

import random

import pytest

from raretab.sources import io as IO
from raretab.sources.records import inside_after, read_csv_text


@pytest.fixture(params=[7, 64, 1 << 27])
def ranges(spark, request):
    """Byte ranges of the given size."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", str(request.param))
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def whole_file(spark, path):
    return spark.read.options(**IO.CSV_OPTIONS, inferSchema=False).csv(path)


def same(spark, path):
    got, want = read_csv_text(spark, path, IO.CSV_OPTIONS), whole_file(spark, path)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    return got


CASES = {
    "plain": "a,b\n1,2\n3,4\n",
    "no last newline": "a,b\n1,2\n3,4",
    "quoted newlines": 'a,b\n1,"x\ny\n\nz"\n"p ""q""\n,r",4\n',
    "stray quotes": 'a,b\n5" pipe,2\nx"y"z,"ok\nstill"\n1,3"\n7,8\n',
    "text behind a quote": 'a,b\n"x"y,2\n"p" ,"q\nr"\n',
    "windows lines": 'a,b\r\n1,"x\ny"\r\n\r\n3,4\r\n',
    "short and long records": "a,b\n1\n1,2,3\n\n,\n",
    "quoted header": '"a\nx","b, c"\n1,"2\n"\n',
    "one long field": 'a,b\n1,"' + "line\n" * 60 + '"\n2,3\n',
    "header only": "a,b\n",
    "letters of many bytes": 'a,b\n"é\nß","日\n本"\n',
}


@pytest.mark.parametrize("name", CASES)
def test_equal_to_whole_file_reader(spark, tmp_path, ranges, name):
    path = tmp_path / "t.csv"
    path.write_bytes(CASES[name].encode())
    same(spark, str(path))


def test_many_tasks_and_random_text(spark, tmp_path, ranges):
    """Two files of random cells; with small ranges one file is read by many tasks."""
    rng = random.Random(7)
    cell = lambda: "".join(rng.choice('ab",\n é') for _ in range(rng.randint(0, 12)))
    for part in range(2):
        rows = [("id", "text")] + [(f"{part}-{i}", cell()) for i in range(60)]
        body = "".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\n" for r in rows)
        (tmp_path / f"{part}.csv").write_text(body, newline="")
    got = same(spark, str(tmp_path))
    assert got.count() == 120
    if ranges < 100:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_unfinished_quote_takes_the_rest(spark, tmp_path, ranges):
    (tmp_path / "t.csv").write_text('a,b\n1,2\n3,"open\nmore\n')
    got = {tuple(r) for r in read_csv_text(spark, str(tmp_path / "t.csv"), IO.CSV_OPTIONS).collect()}
    assert ("1", "2") in got and len(got) == 2
    assert next(r for r in got if r[0] == "3")[1].rstrip("\n") in ("open\nmore", '"open\nmore')


def test_typed_reader(spark, tmp_path, ranges):
    (tmp_path / "t.csv").write_text('Unnamed: 0,n,x,s\n0,1,2.5,"a\nb"\n1,NA,bad,\n2,3,,c\n')
    df = IO.read_csv(spark, str(tmp_path / "t.csv"), {"n": "bigint", "x": "double"})
    assert df.columns == ["n", "x", "s"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(1, 2.5, "a\nb"), (None, None, None), (3, None, "c")], key=repr)


def test_quoted_text_stays_as_written(spark, tmp_path, ranges):
    (tmp_path / "t.csv").write_bytes(b'a,b\r\n1,"x\r\ny\r"\r\n3,4\r\n')
    assert sorted(map(tuple, read_csv_text(spark, str(tmp_path / "t.csv"), IO.CSV_OPTIONS).collect())) == [("1", "x\r\ny\r"), ("3", "4")]


def test_line_states():
    assert inside_after('1,"x', False) and not inside_after('x",2', True)
    assert not inside_after('5" pipe', False) and inside_after("no quote", True)
    assert inside_after('"a"" b', False) and not inside_after('"a"" b"', False)
    assert inside_after('a","b', True) and not inside_after("", False) and inside_after("", True)
