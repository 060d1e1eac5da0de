"""Exact substring removal by distributed prefix doubling over sparse positions.

Ranks of byte strings of 25, 50 and 100 bytes: the rank of a longer string is that of the pair of
two shorter ones, the second further on by the length so far. Pairs are sorted and ranked anew until a
position is unique or its string has reached the threshold, 100 bytes. Ranking every byte of the corpus in Spark rows at
each length would move many times the input, so positions are sparse: at 50 bytes one position
stands for a run of neighbouring 100-byte strings (see ``repeats``), and single bytes are ranked,
at 100, only where neighbourhoods recur in part. Pairs are formed where the text is; Spark deals and ranks them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import batches
from tickloom.llm.names import Named, byte_values, doubled, mix
from tickloom.llm.repeats import Sequence, column_places, remove_repeats, with_identity


class ByteStrings(Sequence):
    """Texts as bytes; strings of ``window`` bytes that also start earlier are removed."""

    keep_first = True

    def __init__(self, window: int = 100) -> None:
        self.window = window
        self.seed = max(1, window // 2)
        self.table = byte_values()

    def values(self, text: bytes) -> np.ndarray:
        return self.table[np.frombuffer(text, np.uint8)]

    def values_of_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.values(b"".join(texts)), np.cumsum([0, *map(len, texts)])

    def size(self, text: bytes) -> int:
        return len(text)

    def kept(self, text: bytes, keep: np.ndarray) -> bytes:
        return np.frombuffer(text, np.uint8)[keep].tobytes()

    def _ranks(self, named: Named, size: int) -> np.ndarray:
        """Ranks by doubling, from an odd length up."""
        if size % 2:
            return mix(named.every(size))
        if len(named.sums) <= size:
            return np.zeros(0, np.uint64)
        return doubled(self._ranks(named, size // 2), size // 2)

    def seed_names(self, named: Named) -> np.ndarray:
        return self._ranks(named, self.seed)

    def window_names(self, named: Named) -> np.ndarray:
        return self._ranks(named, self.window)


def cut_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Null and empty texts have no bytes; texts shorter than the window stay whole. Repeated rows of one id and text are
    not earlier than each other. Null ids come first; two texts under one id are ordered by a hash.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    done = remove_repeats(with_identity(slim, "doc_id", "text"), ByteStrings(window))
    return done.select(F.col("__rest.c0").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100) -> DataFrame:
    """``docs`` with the bytes that occur earlier cut out of the text; a character that lost a byte goes. Null texts stay null."""
    done = remove_repeats(with_identity(docs, id_col, text_col), ByteStrings(window), with_text=True)
    held = done.select("__rest", "kept")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("__rest"), pa.array(texts, pa.string())], names=["__rest", "text"])

    made = batches(held, step, T.StructType([held.schema["__rest"], T.StructField("text", T.StringType())]))
    text = F.when(~F.col("__rest.void"), F.col("text"))
    return made.select(*((text if c == text_col else F.col(f"__rest.{place}")).alias(c) for place, c in column_places(docs)))
