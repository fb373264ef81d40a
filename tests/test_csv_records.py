import random
from contextlib import contextmanager

import pyarrow as pa

from rosterlake.sources import intake
from rosterlake.sources.csv_records import open_ends, read_csv_records

HEADER = "email,first_name,row_no\n"


@contextmanager
def splits_of(spark, size):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, [size, 1]):
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def whole_files(spark, *paths):
    """Rows of the reader that takes a file in one task, file after file."""
    rows = []
    for path in paths:
        read = spark.read.csv(str(path), header=True, multiLine=True, escape='"')
        rows += [tuple(r) for r in read.collect()]
    return rows


def in_splits(spark, path):
    read = read_csv_records(spark, str(path)).orderBy("row_no").collect()
    assert [r.row_no for r in read] == list(range(1, len(read) + 1))
    return [tuple(r.fields) for r in read]


def random_file(seed, n):
    rng = random.Random(seed)

    def field():
        kind = rng.random()
        word = "".join(rng.choice("abcя ") for _ in range(rng.randint(1, 9))).strip() or "x"
        if kind < 0.4:
            return word
        if kind < 0.5:
            return ""
        if kind < 0.6:
            return word + '"' + word  # a quote within an unquoted field
        inner = "".join(rng.choice(["\n", "\n\n", '""', ",", word, "\r\n"]) for _ in range(rng.randint(1, 7)))
        return f'"{word}{inner}{word}"'

    end = rng.choice(["\n", "\r\n"])
    lines = []
    for i in range(n):
        lines.append(",".join([f"u{i}@x.org", field(), field()][: rng.choice([1, 2, 3, 3, 3])]))
        if rng.random() < 0.05:
            lines.append("")
    return HEADER.strip() + end + end.join(lines) + rng.choice(["", end])


def test_quotes_open_and_close():
    for line, outside, within in [
        ("a,b", False, True),
        ("", False, True),
        ('"a', True, False),
        ('a"b,c', False, False),
        ('a,"b""', True, False),
        ('a,"b"",",c', False, True),
        ('5" pipe,"x', True, True),
        ('","', False, True),
        ('""', False, True),
        ('"a"b"c,d', False, False),
    ]:
        assert [bool(case[0]) for case in open_ends(pa.array([line]))] == [outside, within], line


def test_splits_give_the_rows_of_the_whole_file(spark, tmp_path):
    for seed in range(6):
        folder = tmp_path / str(seed)
        folder.mkdir()
        files = [folder / f"{name}.csv" for name in "abc"]
        for k, file in enumerate(files):
            file.write_bytes(random_file(seed * 10 + k, [200, 0, 60][k]).encode())
        with splits_of(spark, [150, 400, 1000][seed % 3]):
            read = in_splits(spark, folder)
        assert read == whole_files(spark, *files)


def test_a_field_longer_than_many_splits(spark, tmp_path):
    long = "line\n" * 500
    (tmp_path / "in.csv").write_text(f'{HEADER}a,"{long}",1\nb,"x""\n",2\n', newline="")
    with splits_of(spark, 100):
        assert in_splits(spark, tmp_path) == [("a", long, "1"), ("b", 'x"\n', "2")]


def test_a_header_over_lines_and_a_column_named_row_no(spark, tmp_path):
    (tmp_path / "a.csv").write_text('email,"first\nname",row_no\na,b,c\n\n\n', newline="")
    (tmp_path / "b.csv").write_text('email,"first\nname",row_no\nd,,"f\ng"', newline="")
    with splits_of(spark, 10):
        assert in_splits(spark, tmp_path) == [("a", "b", "c"), ("d", None, "f\ng")]
        rows = intake.read_numbered_csv(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r.row_no, r.email, r.first_name) for r in rows] == [(1, "a", None), (2, "d", None)]


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "in.csv").write_text(random_file(1, 4000), newline="")
    with splits_of(spark, 10_000):
        read = read_csv_records(spark, str(tmp_path)).select("row_no", "fields.email")
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        assert tasks > 10 and read.count() == 4000
        plan = read._jdf.queryExecution().executedPlan().toString()
    # Only lines of records over several lines are shuffled.
    assert plan.count("Exchange hashpartitioning(row_no") == 1
