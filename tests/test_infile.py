"""List input against a plain reader, with files cut into many small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.errors import NonConvertible
from quarry.sources import infile


@pytest.fixture
def small_blocks(spark):
    """Blocks of about 64 bytes, so that records, and single lines, reach over several."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(lines, n, hold):
    out, held = [], []
    for line in lines:
        held += line.split()
        while len(held) >= n:
            out.append(tuple(held[:n]))
            held = held[n:] if hold else []
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("hold", [False, True])
@pytest.mark.parametrize("n", [1, 3, 7])
def test_flowover_in_blocks(small_blocks, tmp_path, hold, n):
    rng, want = random.Random(n), []
    for f in range(3):
        lines = [" ".join(f"{f}-{i}-{j}" for j in range(rng.choice([0, 0, 1, 2, 3, 5, 9]))) for i in range(120)]
        lines[40:60] = [""] * 20  # blocks without any value
        lines[70] = " ".join(f"long{j}" for j in range(60))  # one line over several blocks
        (tmp_path / f"{f}.txt").write_text("\n".join(lines) + "\n" * (f % 2))
        want += plain(lines, n, hold)
    got = infile.read_list(small_blocks, str(tmp_path), ", ".join(f"c{i} string" for i in range(n)), hold=hold)
    assert rows(got) == sorted(want)


def test_first_and_last_lines(small_blocks, tmp_path):
    lines = [f"{i} {i * i} some words that fill the line" for i in range(200)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    got = infile.read_list(small_blocks, str(tmp_path), "a int, b int", first_line=51, last_line=150)
    assert rows(got) == [(i, i * i) for i in range(50, 150)]
    got = infile.read_list(small_blocks, str(tmp_path), "a int, b int", short="MISSOVER", first_line=200)
    assert rows(got) == [(199, 199 * 199)]


def test_short_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 a\n2\n\n3 c extra\nx .\n")
    for short in ("MISSOVER", "TRUNCOVER"):
        got = infile.read_list(spark, str(tmp_path), "n int, s string", short=short)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "a"), (2, None), (None, None), (3, "c"), (None, None)]))
    flow = infile.read_list(spark, str(tmp_path), "n int, s string").orderBy(F.col("n").asc_nulls_last()).collect()
    assert [tuple(r) for r in flow] == [(1, "a"), (2, "3"), (None, None)]
    held = infile.read_list(spark, str(tmp_path), "n int, s string", hold=True)  # 1 a|2 3|c extra|x .
    assert sorted(map(str, map(tuple, held.collect()))) == sorted(map(str, [(1, "a"), (2, "3"), (None, "extra"), (None, None)]))
    stop = infile.read_list(spark, str(tmp_path), "n int, s string", short="STOPOVER")
    for act in (lambda: stop.collect(), lambda: stop.count(), lambda: stop.select("n").collect()):
        with pytest.raises(Exception, match="STOPOVER"):
            act()
    with pytest.raises(NonConvertible):
        infile.read_list(spark, str(tmp_path), "n int", short="MISSOVER", hold=True)
    with pytest.raises(NonConvertible):
        infile.read_list(spark, str(tmp_path), "n int", short="OTHER")


def test_quotes_and_delimiters(spark, tmp_path):
    (tmp_path / "a.txt").write_text(',"a, b",2\n"say ""hi""", x ,\nx"y,,3\n"",z,.\n')
    got = infile.read_list(spark, str(tmp_path), "s string, t string, n int", ",", dsd=True, short="TRUNCOVER").collect()
    want = [(None, "a, b", 2), ('say "hi"', "x", None), ('x"y', None, 3), (None, "z", None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.txt").write_text("a|b||c|\n|d|e\n")
    got = infile.read_list(spark, str(tmp_path / "b"), "s string, t string, u string", "|")
    assert rows(got) == [("a", "b", "c")]  # d and e are left open at the end


def test_no_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    for short in infile.SHORT:
        assert infile.read_list(spark, str(tmp_path), "a int, b string", short=short).collect() == []
