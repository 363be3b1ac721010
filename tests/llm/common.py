"""Awkward rows that every operator has to take."""

from __future__ import annotations

LONG = "lorem ipsum dolor " * 8000 + "x" * 40_000 + " tail"
EXTRA = "id long, text string, lang string, source string, n_chars long, size long, kept string, c string, label int, row string, gone long, score double"
SCHEMA = EXTRA.replace("id long", "doc_id long", 1).replace("row string", "id string, `row` string")


def awkward(texts: list[str | None] | None = None) -> list[tuple]:
    """Rows with nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names are in use elsewhere."""
    texts = texts or []
    base = [None, "", " \t\n", "a", "a  b", "a\tb", "A b", LONG, "one two three four five six seven", "one two three four five six seven", "ünïcödé 中文 \U0001f600 'll", "x\x00y"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 1, "k", "c", 0, "i", "r", 1, 0.5) for i, t in enumerate([*base, *texts])]
    rows.append(rows[3])
    rows.append((100_000, "a", None, None, None, None, None, None, None, None, None, None, None))
    return rows


def frame(spark, rows: list[tuple], partitions: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)
