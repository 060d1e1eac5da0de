"""Language of a text by a string kernel, landmarks and ridge regression.

The blended-spectrum presence kernel of two texts counts the byte n-grams of one to three bytes
that occur in both, divided by the root of the product of their numbers. It is taken over
the n-grams that the landmark texts hold. Nyström: with ``m`` landmark texts the kernel is
replaced by products with these, whitened by the inverse root of the landmarks' own kernel
matrix. Ridge regression of 0/1 targets, one language against the rest, is solved in closed form.

Learning takes a bounded sample: at most ``per_class`` distinct texts for each language (the
smallest text hashes) and ``landmarks`` of them as landmarks. Only their n-gram sets reach the
driver. Prediction runs over every whole text in batched matrix products.

The values of a text sum to 1 over the languages, so the largest says nothing of a text in none of them. A text
is unfamiliar if fewer of its distinct n-grams are known from landmarks than ``SLACK`` times what all but
``RARE`` of the learned rows reach, each of them held out: a landmark's own n-grams count if another one has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tickloom.llm.common import as_bytes, batches, with_columns

UNKNOWN = "und"
CODES = 256 + (1 << 16) + (1 << 24)
RARE, SLACK = 0.01, 0.9
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def gram_codes(text: bytes) -> Iterator[np.ndarray]:
    """Codes of all n-grams of one, two and three bytes of the text in small letters, in slices."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.int32)
    for lo in range(0, len(b), 1 << 20):
        part = b[lo : lo + (1 << 20) + 2]
        yield part
        if len(part) > 1:
            pair = (part[:-1] << 8) | part[1:]
            yield pair + 256
            if len(part) > 2:
                yield ((pair[:-1] << 8) | part[2:]) + (256 + (1 << 16))


def gram_set(text: bytes) -> np.ndarray:
    parts = [np.unique(c) for c in gram_codes(text)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


@dataclass
class LanguageModel:
    """``grams``: codes of the landmarks' n-grams; ``marks``: landmark by n-gram, 0 or 1; ``weights``: to languages;
    ``least``: share of known n-grams under which a text is unfamiliar."""

    languages: list[str]
    grams: np.ndarray
    marks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    least: float = 0.0

    def lookup(self) -> np.ndarray:
        table = np.zeros(CODES, np.uint16)
        table[self.grams] = np.arange(1, len(self.grams) + 1)
        return table

    def presence(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        """Texts by n-grams, 0 or 1; column 0 takes what no landmark has."""
        made = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        for row, text in zip(made, texts):
            for codes in gram_codes(text):
                row[table[codes]] = 1
        return made[:, 1:]

    def scores(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        return self.values(self.presence(texts, table))

    def values(self, held: np.ndarray) -> np.ndarray:
        return kernel(held, self.marks.astype(np.float32)) @ self.weights + self.bias

    def familiar(self, texts: list[bytes], table: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Which texts, of presence ``held``, have a share of known n-grams of at least ``least``."""
        known = held.sum(axis=1, dtype=np.float64)
        new = [len(np.unique(np.concatenate([c[table[c] == 0] for c in gram_codes(t)]))) for t in texts]
        return known >= self.least * (known + new)


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.outer(left.sum(axis=1), right.sum(axis=1)))
    return (left @ right.T) / np.maximum(norm, 1)


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    per_class: int = 300,
    landmarks: int = 160,
    max_grams: int = 32_000,
    ridge: float = 0.1,
) -> LanguageModel | None:
    """A model from the rows of ``docs`` with a language and a text with letters; None without such rows.

    ``max_grams`` n-grams at most are kept, those of most landmarks first. Languages are at
    most 200, the most frequent first. Ties in the order of the sample go to the smaller hash, repeated texts count once.
    """
    held = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), as_bytes(text_col).alias("text"))
    held = held.where("lang is not null and length(text) > 0").withColumn("key", F.xxhash64("text"))
    common = [r["lang"] for r in held.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(200).collect()]
    first = held.select("lang", "key").where(F.col("lang").isin(common)).distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    chosen = first.withColumn("n", rank).where(F.col("n") <= per_class).select("lang", "key", "n")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lang, text, n = (batch.column(c).to_pylist() for c in ("lang", "text", "n"))
        rows = [(a, k, gram_set(t).astype("<i4").tobytes()) for a, t, k in zip(lang, text, n) if has_letter(t)]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], names=["lang", "n", "grams"]
        )

    # At most 200 * per_class short rows: a bounded broadcast.
    sample = held.join(F.broadcast(chosen), ["lang", "key"])
    found = batches(sample, sets, "lang string, n int, grams binary").dropDuplicates(["lang", "n"]).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["n"], r["lang"]))  # languages in turn
    languages = sorted({r["lang"] for r in found})
    texts = [np.frombuffer(r["grams"], "<i4") for r in found]
    codes, seen = np.unique(np.concatenate(texts[:landmarks]), return_counts=True)
    grams = np.sort(codes[np.lexsort((codes, -seen))][:max_grams])
    table = np.zeros(CODES, bool)
    table[grams] = True
    known = np.zeros((len(texts), len(grams)), np.float32)
    for row, text in zip(known, texts):
        row[np.searchsorted(grams, text[table[text]])] = 1
    marks = known[:landmarks]
    held_out = known.sum(axis=1)
    held_out[:landmarks] = (marks * (marks.sum(axis=0) > 1)).sum(axis=1)
    least = SLACK * float(np.quantile(held_out / np.array([len(t) for t in texts]), RARE))
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    white = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel(known, marks).astype(np.float64) @ white
    target = np.array([[r["lang"] == name for name in languages] for r in found], float)
    mean, level = mapped.mean(axis=0), target.mean(axis=0)
    centred = mapped - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * np.eye(centred.shape[1]), centred.T @ (target - level))
    return LanguageModel(
        languages, grams, marks.astype(np.uint8), (white @ solved).astype(np.float32), (level - mean @ solved).astype(np.float32), least
    )


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", block: int = 128, strict: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the winner's regression value within 0 and 1).

    A null text, one without a letter and any text under no model get ``und`` and 0, and so do
    unfamiliar texts where ``strict``. Equal scores go to the language that sorts first. All rows and columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks * max_grams bytes
    table: list[np.ndarray] = []

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        fitted = shared.value
        spots = [i for i, t in enumerate(texts) if has_letter(t)] if fitted else []
        if spots and not table:
            table.append(fitted.lookup())
        for lo in range(0, len(spots), block):
            part = spots[lo : lo + block]
            held = fitted.presence([texts[i] for i in part], table[0])
            made = fitted.values(held)
            fits = fitted.familiar([texts[i] for i in part], table[0], held) if strict else np.ones(len(part), bool)
            for i, best, value, fit_ in zip(part, made.argmax(axis=1), np.clip(made.max(axis=1), 0, 1), fits):
                if not fit_:
                    continue
                names[i], scores[i] = fitted.languages[best], float(value)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return with_columns(docs, text_col, compute, FIELDS)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; rows with crc32 of the id mod 3 equal to 1 are never learned from.

    A null id is in neither part: not held out, not learned from.
    """
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{lang_col}`").alias("lang"),
    )
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(slim.where(part != 1))
    done = predict(slim.select("doc_id", "text"), model)
    return done.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.2) -> DataFrame:
    """``docs`` without the rows whose language is unknown, whose text is unfamiliar or whose score is below ``least``."""
    done = predict(docs, fit(docs, text_col, lang_col), text_col, strict=True)
    kept = done.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
