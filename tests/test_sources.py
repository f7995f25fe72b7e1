"""CSV exports with lines that cannot be read."""

from pathlib import Path

from gaugeflow.config import CSV_COLUMNS, READING_TIME
from gaugeflow.session import shared_folder
from gaugeflow.sources.telemetry import csv_schema, scan_csv, scan_csv_checked


def export(spark, lines):
    folder = Path(shared_folder(spark, "csv"))
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("\n".join([",".join(CSV_COLUMNS), *lines]) + "\n")
    return str(folder)


def test_lines_that_do_not_fit_are_kept_apart(spark):
    width, order = len(CSV_COLUMNS), list(CSV_COLUMNS)
    plain = ["2022-04-01 00:00:01" if c == READING_TIME else "1" for c in order]

    def line(**changes):
        return ",".join(changes.get(c, v) for c, v in zip(order, plain))

    number = next(c for c in order if c != READING_TIME)
    good = [line(), line(**{number: ""}), line(**{READING_TIME: "2022-04-01 00:00:02.5"})]
    bad = [line(**{number: "n/a"}), line(**{READING_TIME: "soon"}), ",".join(plain[:width - 3]),
           ",".join([*plain, "9"])]
    path = export(spark, [good[0], bad[0], good[1], *bad[1:], good[2]])
    rows, rejected = scan_csv_checked(spark, path)
    assert rows.schema.fieldNames() == order and rows.count() == 3
    assert {r.line for r in rejected.collect()} == set(bad) and rejected.count() == 4
    assert rejected.select("source_file").distinct().first()[0].endswith("a.csv")
    # good rows are what the plain scan gives for a clean file
    clean = scan_csv(spark, export(spark, good))
    assert rows.exceptAll(clean).count() == 0 == clean.exceptAll(rows).count()
    assert rows.select(number).distinct().count() == 2  # an empty field is a NULL
    assert csv_schema()[READING_TIME].dataType == rows.schema[READING_TIME].dataType
    # reading a few columns judges the same lines
    assert rows.select(READING_TIME).count() == 3 and rejected.select("line").count() == 4
