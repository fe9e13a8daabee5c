"""Runs a document reader over a column, as one Arrow map."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quire.schema import ELEMENT, numbered


def read_elements(docs: DataFrame, content: str, doc_id: str, parse: Callable[[str], list[dict]], origin: str, flush: int = 4096, keep_empty: bool = False) -> DataFrame:
    """Elements of every document: doc_id, error, and the columns of ELEMENT.

    Permissive: a document that can't be read gives one row with `error` set and no type;
    one without content or elements gives such a row without `error` if `keep_empty` is set.
    Only the key and the content column are read; nothing is shuffled.
    """
    schema = f"doc_id long, error string, {ELEMENT}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    got = numbered(parse(value), origin) if value is not None else []
                    rows += [e | {"doc_id": key} for e in got]
                    if keep_empty and not got:
                        rows.append({"doc_id": key})
                except Exception as problem:  # noqa: BLE001 - told in the row
                    rows.append({"doc_id": key, "error": f"{type(problem).__name__}: {problem}"})
                if len(rows) >= flush:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select(F.col(doc_id).cast("long"), F.col(content)).mapInArrow(run, schema)
