"""What models say of pictures: any model can be plugged in, and is loaded once for each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: A model takes the contents of some files and gives one dict of columns for each, or None where it can't.
Model = Callable[[list[bytes]], list[dict[str, Any] | None]]


def enriched(files: DataFrame, load: Callable[[], Model], schema: T.StructType, batch: int = 16, key: str = "path") -> DataFrame:
    """(key, the columns of ``schema``, _error): what a model says of each file (key, content).

    ``load`` makes the model in the worker. A file that the model can't read, or a batch in which it fails, has NULLs
    and the reason in ``_error``, so that it can be tried again; the other files of a failed batch are tried one by one.
    """
    names = schema.fieldNames()
    out = T.StructType([files.schema[key], *schema.fields, T.StructField("_error", T.StringType())])

    def one_by_one(model: Model, contents: list[bytes]) -> Iterator[tuple[dict | None, str | None]]:
        for content in contents:
            try:
                found = model([content])[0]
                yield found, None if found is not None else "unreadable"
            except Exception as e:  # noqa: BLE001
                yield None, f"{type(e).__name__}: {e}"[:500]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                contents = list(part["content"])
                try:
                    said = [(x, None if x is not None else "unreadable") for x in model(contents)]
                except Exception:  # noqa: BLE001
                    said = list(one_by_one(model, contents))
                rows = [(k, *[(x or {}).get(n) for n in names], error) for k, (x, error) in zip(part[key], said)]
                yield pd.DataFrame(rows, columns=[key, *names, "_error"], dtype=object)

    return files.select(key, "content").mapInPandas(run, out)


def gated(photos: DataFrame, gate: Column, files: DataFrame, load: Callable[[], Model], schema: T.StructType) -> DataFrame:
    """``photos`` with the columns of an expensive model, which only sees the photos that pass ``gate``."""
    asked = files.join(photos.where(gate).select("path"), "path", "left_semi")
    return photos.join(enriched(asked, load, schema).drop("_error"), "path", "left")
