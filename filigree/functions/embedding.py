"""The embedder interface, and one that needs no model."""
from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    """Turns texts into vectors of a fixed dimension; created once per task."""

    dim: int

    def embed(self, texts: list[str]): ...


class HashingEmbedder:
    """Signed feature hashing of lower-cased words, scaled to unit length."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str]):
        import re
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                code = zlib.crc32(word.encode())
                out[row, code % self.dim] += 1.0 if code & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def embed_column(
    rows: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding", batch: int = 256
) -> DataFrame:
    """Add the vector of `text_col`, calling the embedder with batches of texts."""
    names = rows.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                found = np.asarray(embedder.embed(part.column(text_col).to_pylist()), dtype=np.float32)
                if found.shape != (part.num_rows, embedder.dim):
                    raise ValueError(f"embedder gave shape {found.shape}")
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * embedder.dim
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*names, out_col])

    added = T.StructField(out_col, T.ArrayType(T.FloatType()))
    return rows.mapInArrow(run, T.StructType([*rows.schema, added]))
