"""List input: values read one after another, over the ends of lines where the rule for short lines says so.

A file is read in blocks, as Spark splits it; a block's lines keep their order. How a line is read depends on how many values of
a record the lines before it have given, a number below the count of fields. So a first pass makes of each block a table from
that number before it to that after it, and keeps the values that its first lines would give to a record begun earlier; the tables are
chained by file (a row for each block); the second pass reads every block by itself, from the number it starts with, and
completes its last record with what the next blocks give. Lines are never shuffled, so no task reads more than Spark gives one to scan; of the
text only what completes a record passes the driver, a row for each block.

Cases: a single period and an empty value are missing; a value that isn't of its field's type is missing; a line without values
gives none (a record of missing values under MISSOVER and TRUNCOVER); a record left open at the end of a file is dropped and does
not go on in the next file; values after a record's last are dropped with their line, unless lines are held; no files' lines: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.errors import NonConvertible
from quarry.operators.graph import _cut

SHORT = ("FLOWOVER", "MISSOVER", "TRUNCOVER", "STOPOVER")
BLOCK = ["file", "start"]


def values(line: Column, delimiter: str = " ", dsd: bool = False) -> Column:
    """A line's values. Delimiters in a row count as one; under dsd each counts, and quotes hide delimiters and are taken off."""
    if not dsd:
        return F.filter(F.split(line, rf"\Q{delimiter}\E+"), lambda v: v != "")
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'\Q{delimiter}\E(\s*"(?:[^"]|"")*"\s*(?=\Q{delimiter}\E|$)|[^\Q{delimiter}\E]*)'), F.lit(1))
    plain = lambda v: F.when(v.rlike(r'^".*"$'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.transform(found, lambda v: plain(F.trim(v))))


def _lines(spark: SparkSession, path: str, first: int, last: int | None) -> DataFrame:
    """file, start (of the block), at (ascending in a block), value."""
    text = spark.read.text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    if first <= 1 and last is None:
        return lines
    counted = lines.groupBy(*BLOCK).agg(F.min("at").alias("_from"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("at") - F.col("_from") + F.col("_before") + 1
    kept = _with(lines, counted.select(*BLOCK, "_from", before.alias("_before"))).where(number.between(first, last or 1 << 62))
    return kept.select(*lines.columns)


def _with(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with what is known of their block. A row for each block is written, then broadcast, so lines stay in the tasks that scan them, and in order."""
    return lines.join(F.broadcast(_cut(blocks)), BLOCK)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[pa.RecordBatch]]]:
    """Each block's file and start with the stretches of its lines."""

    def stretches() -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
        for batch in batches:
            file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
            codes = file.indices.to_numpy()
            cut = (np.flatnonzero((codes[1:] != codes[:-1]) | (start[1:] != start[:-1])) + 1).tolist()
            for i, j in zip([0, *cut], [*cut, len(start)], strict=True):
                if j > i:
                    yield (file.dictionary[codes[i]].as_py(), int(start[i])), batch.slice(i, j - i)

    for block, group in groupby(stretches(), lambda x: x[0]):
        yield block, (stretch for _, stretch in group)


def _moved(after: np.ndarray, counts: np.ndarray, fields: int, hold: bool) -> np.ndarray:
    """Values read of a record after lines with so many values, for each number before them."""
    if hold:
        return (after + counts.sum()) % fields
    whole = np.flatnonzero(counts >= fields)  # ends a record whatever came before
    if len(whole):
        after, counts = np.zeros_like(after), counts[whole[-1] + 1 :]
    rest = iter(counts[counts > 0].tolist())
    while (after != after[0]).any() and (n := next(rest, None)) is not None:
        after = np.where(after + n >= fields, 0, after + n)
    one = int(after[0])
    for n in rest:  # from here on it's the same from all
        one = 0 if one + n >= fields else one + n
    return after if (after != after[0]).any() else np.full_like(after, one)


def _summaries(fields: int, hold: bool):
    """Each block's table of values read before to values read after, and the values its first lines would give to an open record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), stretches in _by_block(batches):
            after, heads, given = np.arange(fields), [], 0
            for lines in stretches:
                counts = lines.column("n").to_numpy()
                for i in np.flatnonzero(counts).tolist():
                    if given >= fields:
                        break
                    heads.append(lines.column("found")[i].as_py())
                    given += int(counts[i])
                after = _moved(after, counts, fields, hold)
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "after": after.tolist(), "heads": heads}], pa.schema([("file", pa.string()), ("start", pa.int64()), ("after", pa.list_(pa.int32())), ("heads", pa.list_(pa.list_(pa.string())))]))

    return run


def _chained(fields: int):
    """Of one file's blocks: the values read before each, and those that complete its last record (null: the file ends first)."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("start", ignore_index=True)
        before, rest, state = [], [], 0
        for after in blocks["after"]:
            before.append(state)
            state = int(after[state])
        ends = [*before[1:], state]
        for i, end in enumerate(ends):
            taken: list[str] = []
            heads = (line for later in blocks["heads"][i + 1 :] for line in later) if end else iter(())
            while end and end + len(taken) < fields and (line := next(heads, None)) is not None:
                taken += list(line)[: fields - end - len(taken)]
            rest.append(taken if not end or end + len(taken) == fields else None)
        return pd.DataFrame({"file": blocks["file"], "start": blocks["start"], "before": before, "rest": rest})

    return run


def _records(fields: int, hold: bool):
    """From blocks in order, with what chained() says of them: the records that begin in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[str]] = []
        for _, stretches in _by_block(batches):
            first = next(stretches)
            held, owed, rest = [], (fields - first.column("before")[0].as_py()) % fields, first.column("rest")[0].as_py()
            for found in (line for lines in chain([first], stretches) for line in lines.column("found").to_pylist()):
                if owed:  # these belong to a record that began in an earlier block
                    taken = min(owed, len(found))
                    owed -= taken
                    found = found[taken:] if hold else []
                held += found
                while len(held) >= fields:
                    out.append(held[:fields])
                    held = held[fields:] if hold else []
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pydict({"found": out}, pa.schema([("found", pa.list_(pa.string()))]))
                    out = []
            if held and rest is not None:
                out.append(held + rest)
        if out:
            yield pa.RecordBatch.from_pydict({"found": out}, pa.schema([("found", pa.list_(pa.string()))]))

    return run


def read_list(spark: SparkSession, path: str, schema: StructType | str, delimiter: str = " ", dsd: bool = False, short: str = "FLOWOVER", hold: bool = False, first_line: int = 1, last_line: int | None = None) -> DataFrame:
    """Records of the schema's fields, read as list input.

    short: what a line with too few values means. FLOWOVER: the record goes on in the next line; MISSOVER, TRUNCOVER: the other values are
    missing; STOPOVER: an error, in any action on the result. hold (@@): a line's further values begin the next record.
    first_line, last_line: line numbers, from 1, in each file.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if short not in SHORT:
        raise NonConvertible(f"{short}: one of {', '.join(SHORT)}")
    if hold and short != "FLOWOVER":
        raise NonConvertible(f"@@ with {short}: a held line has no end")
    n = len(schema)
    lines = _lines(spark, path, first_line, last_line).select(*BLOCK, "at", values(F.col("value"), delimiter, dsd).alias("found"))
    if short == "FLOWOVER":
        blocks = lines.select(*BLOCK, F.size("found").alias("n"), F.slice("found", 1, n).alias("found")).mapInArrow(_summaries(n, hold), "file string, start long, after array<int>, heads array<array<string>>")
        chained = blocks.groupBy("file").applyInPandas(_chained(n), "file string, start long, before int, rest array<string>")
        records = _with(lines, chained).mapInArrow(_records(n, hold), "found array<string>")
    else:
        records = lines
        if short == "STOPOVER":
            said = F.concat(F.lit("STOPOVER: a line holds "), F.size("found").cast("string"), F.lit(f" of {n} values"))
            records = lines.where(F.when(F.size("found") < n, F.raise_error(said).cast("boolean")).otherwise(True))
    raw = [F.nullif(F.nullif(F.get("found", F.lit(i)), F.lit("")), F.lit(".")) for i in range(n)]
    return records.select(*[value.try_cast(field.dataType).alias(field.name) for value, field in zip(raw, schema, strict=True)])
