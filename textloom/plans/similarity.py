"""Similarities: tf-idf with quantised norms, single-precision at every step, and one that delegates by field."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

f32 = np.float32


class Similarity:
    """tf-idf. Scalars are computed on the driver, once a query; columns per posting. Subclasses change single factors."""

    def idf(self, doc_freq: int, max_doc: int) -> np.float32:
        """max_doc counts all documents, those without the field and deleted ones too."""
        return f32(f32(np.log(max_doc / (doc_freq + 1))) + f32(1)) if max_doc > 0 else f32(1)

    def idf_column(self, doc_freq: Column, max_doc: int) -> Column:
        """``idf`` for a column of document frequencies; a subclass that changes one changes both."""
        if max_doc <= 0:
            return F.lit(1.0).cast("float")
        return (F.ln(F.lit(float(max_doc)) / (doc_freq + 1)).cast("float") + F.lit(1.0).cast("float")).cast("float")

    def query_norm(self, squares: np.float32) -> np.float32:
        with np.errstate(divide="ignore", invalid="ignore"):
            norm = f32(1 / np.sqrt(np.float64(squares)))
        return norm if np.isfinite(norm) else f32(1)

    def tf(self, freq: Column) -> Column:
        return F.sqrt(freq.cast("double")).cast("float")

    def coord(self, overlap: Column, most: int) -> Column:
        return (overlap.cast("float") / F.lit(float(most)).cast("float")).cast("float") if most > 1 else F.lit(1.0).cast("float")

    def score(self, freq: Column, norm: Column, value: Column) -> Column:
        """Without norms, norm is null and its factor is left out."""
        raw = (self.tf(freq) * value).cast("float")
        return F.when(norm.isNull(), raw).otherwise((raw * norm).cast("float"))


class PerField(Similarity):
    """Another similarity for some fields; coord and query norm are the base's."""

    def __init__(self, fields: dict[str, Similarity]):
        self.fields = fields

    def of(self, field: str) -> Similarity:
        return self.fields.get(field, self)


def of_field(similarity: Similarity, field: str) -> Similarity:
    return similarity.of(field) if isinstance(similarity, PerField) else similarity
