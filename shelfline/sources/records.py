"""Records of delimited files whose quoted fields may hold line breaks, read by many tasks per file.

Whether a line begins inside quotes depends on all lines before it.  A first pass sums each split of
a file up to one step of two states: outside or inside at its end, for either beginning.  Composed in
order these give the true state at every split's begin.  A second pass cuts each split into whole
records by itself; only what a record has in several splits is put together afterwards.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import hand_over

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A field from its begin on: quoted and closed, quoted and open at the end of the line, or plain.
_FIELD = re.compile(r'"(?:[^"]|"")*"(?=,|\r?$)|(?P<open>"(?:[^"]|"")*$)|[^,]*')
# The rest of a quoted field that began on an earlier line.
_REST = re.compile(r'(?:[^"]|"")*"(?=,|\r?$)|(?P<open>(?:[^"]|"")*$)|[^,]*')
SPLIT = ["file", "start"]


def inside_after(line: str, inside: bool) -> bool:
    """Whether the line ends inside quotes.  A quote inside a plain field is a character, and a
    quoted field with text behind its closing quote ends with the next comma."""
    if '"' not in line:
        return inside
    at, field = 0, _REST if inside else _FIELD
    while at <= len(line):
        found = field.match(line, at)
        if found.group("open") is not None:
            return True
        at, field = found.end() + 1, _FIELD
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """((file, start), first row, end) of each split's rows in a batch."""
    ends = pc.run_end_encode(
        pc.binary_join_element_wise(
            batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string()), "\n"
        )
    )
    first = 0
    for end in ends.run_ends.to_pylist():
        yield (batch.column(1)[first].as_py(), batch.column(2)[first].as_py()), first, end
        first = end


def _split_steps(lines: DataFrame) -> DataFrame:
    """(file, start, from_outside, from_inside, breaks): the state after each split for both states
    before it, and whether any of its lines ends inside quotes when it begins outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict[tuple, list[bool]] = {}
        for batch in batches:
            for split, first, end in _runs(batch) if batch.num_rows else ():
                step = steps.setdefault(split, [False, True, False])
                values = batch.column(0).slice(first, end - first)
                # Lines without a quote change nothing.
                for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                    step[:2] = [inside_after(line, state) for state in step[:2]]
                    step[2] |= step[0]
        names = [*SPLIT, "from_outside", "from_inside", "breaks"]
        rows = [dict(zip(names, (*split, *step))) for split, step in steps.items()]
        kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 3]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds))))

    return hand_over(
        lines.mapInArrow(
            run, "file string, start bigint, from_outside boolean, from_inside boolean, breaks boolean"
        ),
        "splits",
    )


def _split_begins(steps: DataFrame) -> DataFrame:
    """(file, start, inside): the true state at each split's begin, one file's splits at a time."""

    def compose(table: pa.Table) -> pa.Table:
        table, inside, states = table.sort_by("start"), False, []
        for row in table.to_pylist():
            states.append(inside)
            inside = row["from_inside"] if inside else row["from_outside"]
        return table.select(SPLIT).append_column("inside", pa.array(states, pa.bool_()))

    return steps.groupBy("file").applyInArrow(compose, "file string, start bigint, inside boolean")


def _cut(lines: DataFrame) -> DataFrame:
    """(record, file, start, part): whole records, and with a part those that lack a begin
    (0 their end, 1 their middle) or an end (2).  A file's first record, its header, is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, kept, begun, state, header = None, [], True, False, False

        def close() -> list[tuple]:
            """What the split before leaves open."""
            if split is None or not kept:
                return []
            return [("\n".join(kept), *split, 2 if begun else 1)]

        for batch in batches:
            out = []
            for own, first, end in _runs(batch) if batch.num_rows else ():
                if own != split:
                    out += close()
                    split, kept = own, []
                    state = batch.column(3)[first].as_py()
                    begun, header = not state, own[1] == 0
                for line in batch.column(0).slice(first, end - first).to_pylist():
                    kept.append(line)
                    state = inside_after(line, state)
                    if state:
                        continue
                    if not header or not begun:
                        out.append(("\n".join(kept), *split, None if begun else 0))
                    header = header and not begun
                    kept, begun = [], True
            yield _fragments(out)
        yield _fragments(close())

    return lines.mapInArrow(run, "record string, file string, start bigint, part int")


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = zip(("record", "file", "start", "part"), (pa.string(), pa.string(), pa.int64(), pa.int32()))
    schema = pa.schema(list(kinds))
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


def _joined(fragments: DataFrame) -> DataFrame:
    """Records from the parts that several splits hold, one file's at a time: two per split."""

    def join(table: pa.Table) -> pa.Table:
        order = [("start", "ascending"), ("part", "ascending")]
        out, kept = [], []
        for row in table.sort_by(order).to_pylist():
            kept.append(row["record"])
            if row["part"] == 0:
                out.append("\n".join(kept))
                kept = []
        # The last record may lack its closing quote.
        return pa.table({"record": pa.array(out + (["\n".join(kept)] if kept else []), pa.string())})

    return fragments.groupBy("file").applyInArrow(join, "record string")


def broken_records(spark: SparkSession, path: str) -> DataFrame | None:
    """(record) of every row of the delimited files but their headers; None where no record holds a
    line break, so that any reader of lines will do.  Blank lines are no records."""
    lines = _lines(spark, path)
    steps = _split_steps(lines)
    if steps.where("breaks OR from_outside").isEmpty():
        return None
    begins = hand_over(_split_begins(steps), "begins")
    # One row per split of a file, so the table is bounded by bytes / split size; a shuffled join
    # would lose the order of lines.
    cut = _cut(lines.join(F.broadcast(begins), SPLIT).select("value", *SPLIT, "inside"))
    whole = cut.where("part IS NULL").select("record")
    if begins.where("inside").isEmpty():
        parts = cut.where("part IS NOT NULL")  # at most a file's unclosed end
    else:
        parts = hand_over(cut.where("part IS NOT NULL"), "parts")
    records = whole.unionByName(_joined(parts))
    return records.select(F.regexp_replace("record", r"\r$", "").alias("record")).where(
        F.trim("record") != ""
    )
