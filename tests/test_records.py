"""Records with line breaks inside quotes, cut by many tasks, against a plain CSV reader."""

from __future__ import annotations

import csv
import random

import pytest

from shelfline.sources import io
from shelfline.sources.records import broken_records, inside_after

NAMES = ["invoice", "stock_code", "description", "quantity", "invoice_date", "unit_price", "customer_id", "country"]


def records(count, seed=1):
    pick = random.Random(seed)
    texts = ["plain", "two\nlines", 'say ""no""', "a,b", "\n\nlong" + " x" * 300, '5" nail', "", "é\n日本", "cr\r\nlf", '"']
    return [
        [str(n), f"S{n % 7}", pick.choice(texts), "1", "2024-01-05 10:00:00", "2.5", f"c{n % 5}", "UK"]
        for n in range(count)
    ]


def write(path, rows, quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator="\n", quoting=quoting)
        out.writerows([NAMES, *rows])


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=lambda r: int(r[0]))


def expected(rows):
    return [tuple(v if v else None for v in r) for r in rows]


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_breaks_are_kept_whatever_the_splits(spark, tmp_path, split):
    rows = records(300)
    write(tmp_path / "t.csv", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        df = io.read_transactions(spark, str(tmp_path / "t.csv"))
        found = got(df)
        if split < 1000:
            assert broken_records(spark, str(tmp_path / "t.csv")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == expected(rows)


def test_folder_of_files_and_files_without_breaks(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    rows = records(60)
    write(folder / "a.csv", rows[:20])
    write(folder / "b.csv", rows[20:], csv.QUOTE_ALL)
    assert got(io.read_transactions(spark, str(folder))) == expected(rows)
    flat = [[v.replace("\n", " ").replace("\r", " ") for v in r] for r in rows]
    write(tmp_path / "flat.csv", flat)
    assert broken_records(spark, str(tmp_path / "flat.csv")) is None
    assert got(io.read_transactions(spark, str(tmp_path / "flat.csv"))) == expected(flat)


def test_line_states():
    cases = [
        ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False),
        ('"a ""x"" b",c', False, False), ('5" nail,3', False, False), ('x,"5"" nail', False, True),
        ('""', True, True), ('"', True, False), ('"', False, True), ('""', False, False), ('a"",b"', True, False),
        ('"a"b,c', False, False), ('"a",\r', False, False), ('"a"\r', False, False), ('end" x,"y', True, True),
    ]
    for line, before, after in cases:
        assert inside_after(line, before) == after, line


def test_empty_file_and_header_alone(spark, tmp_path):
    write(tmp_path / "none.csv", [])
    assert io.read_transactions(spark, str(tmp_path / "none.csv")).count() == 0
