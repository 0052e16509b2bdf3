"""Export of a DataFrame: Arrow, pandas, CSV, Markdown, text."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row


class Result:
    """A lazy result. Exports to the driver pull all rows; ``write_csv`` stays distributed."""

    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def row_count(self) -> int:
        return self.df.count()

    def rows(self) -> Iterator[Row]:
        """Rows one partition at a time."""
        return self.df.toLocalIterator()

    def batches(self) -> list[pa.RecordBatch]:
        return self.to_arrow().to_batches()

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def to_pandas(self) -> pd.DataFrame:
        return self.df.toPandas()

    def to_csv(self, path: str) -> None:
        """One local file with a header, streamed partition by partition."""
        with open(path, "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(self.df.columns)
            writer.writerows(self.rows())

    def write_csv(self, path: str, mode: str = "errorifexists", delimiter: str = ",") -> None:
        """A folder of part files."""
        self.df.write.mode(mode).option("header", True).option("sep", delimiter).csv(path)

    def to_markdown(self, max_rows: int | None = None) -> str:
        """A table in Markdown, of all rows or with a last line that says where it was cut."""
        got = (self.df if max_rows is None else self.df.limit(max_rows + 1)).collect()
        shown = got if max_rows is None else got[:max_rows]
        line = lambda cells: f"| {' | '.join(cells)} |"
        out = [line(map(_cell, self.df.columns)), line("---" for _ in self.df.columns), *(line(map(_cell, r)) for r in shown)]
        return "\n".join([*out, *([f"\nonly the first {max_rows} rows"] if len(got) > len(shown) else [])])

    def show(self, max_rows: int = 20) -> None:
        """Prints the first rows; the query runs once, and no further than to see whether there are more."""
        print(self.to_markdown(max_rows))

    def __repr__(self) -> str:
        return f"Result({', '.join(self.df.columns)})"


def _cell(value: object) -> str:
    return "NULL" if value is None else str(value).replace("|", "\\|").replace("\n", " ")
