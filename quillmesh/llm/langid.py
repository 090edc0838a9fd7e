"""Language by compression: the language whose dictionary packs a text smallest.

A dictionary is raw text of one language. A text is cut into pieces that are packed one by one
with each dictionary; the sizes add up, and the smallest sum wins. Where the two best sums are
within a margin of each other, the text is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column_bytes, text_batches

_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def held_out(every: int, remainder: int):
    """Whether crc32 of the doc_id as text leaves this remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == remainder, F.lit(False))


def learn(docs: DataFrame, texts_per_lang: int = 64, lang_chars: int = 131_072, short: int = 4096, max_langs: int = 512) -> dict[str, bytes]:
    """A dictionary for each language, of at most ``texts_per_lang`` whole texts and about ``lang_chars`` characters.

    A bounded, documented sample: of the texts of up to ``short`` characters those whose hashed doc_id comes
    first, then longer ones by length, until the next would not fit; the first is always taken, so
    that each language has a dictionary. Rows that crc32 mod 3 holds out, or whose lang or text is null,
    are not used. More than ``max_langs`` languages are an error. No usable row: no dictionaries.
    """
    text_batches(docs.sparkSession)
    usable = docs.filter(~held_out(3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    size = F.length("text")
    order = Window.partitionBy("lang").orderBy("size", F.xxhash64("doc_id"), "doc_id")
    ranked = usable.select("lang", "doc_id", F.greatest(size, F.lit(short)).alias("size"), size.alias("chars"))
    first = ranked.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= texts_per_lang)
    fits = first.withColumn("sum", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("sum") <= lang_chars) | (F.col("at") == 1))
    chosen = Scratch(docs.sparkSession, "language").cut(fits.select("lang", "doc_id").distinct(), "chosen")
    if (n := chosen.select("lang").distinct().count()) > max_langs:
        raise ValueError(f"{n} languages, more than {max_langs}")
    # at most max_langs * texts_per_lang ids
    rows = usable.join(chosen.hint("broadcast"), ["lang", "doc_id"], "left_semi").select("lang", "doc_id", "text")
    found: dict[str, list[str]] = {}
    for row in sorted(rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect(), key=lambda r: (r.lang, r.doc_id)):
        found.setdefault(row.lang, []).append(row.text)
    return {lang: "\n".join(texts).encode() for lang, texts in found.items()}


class Classifier:
    """Sizes by language; ``piece`` bytes are packed at a time, so memory does not grow with a text."""

    def __init__(self, dictionaries: dict[str, bytes], piece: int = 8192, level: int = 3):
        self.langs, self.piece, self.packers = sorted(dictionaries), piece, []
        for lang in self.langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: bytes) -> tuple[str, float]:
        """(lang, score): score is how much smaller the best sum is than the next, from 0 to 1."""
        if not self.langs or not _LETTER.search(text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0
        pieces = [text[at : at + self.piece] for at in range(0, len(text), self.piece)]
        sizes = np.array([sum(len(p.compress(x)) for x in pieces) for p in self.packers])
        order = np.argsort(sizes, kind="stable")
        best = self.langs[order[0]]
        if len(order) == 1:
            return best, 1.0
        return best, float(1 - sizes[order[0]] / sizes[order[1]])


def _predicting(dictionaries: dict[str, bytes], margin: float, keep_only: bool):
    def predict(batches):
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.predict(x) for x in column_bytes(batch.column("text"))]
            rejected = pa.array([lang == UNKNOWN or score < margin for lang, score in found], pa.bool_())
            if keep_only:
                yield batch.filter(pa.compute.invert(rejected))
            else:
                own = {"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64()), "rejected": rejected}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *own.values()], names=["doc_id", "held_out", *own])

    return predict


def predict_language(docs: DataFrame, margin: float = 0.002) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every whole text.

    ``und`` (score 0, rejected) for a null text or one without a letter, or if nothing was
    learned. Rejected too: a score under ``margin``. Each row gets a result, repeated or not; ties
    go to the language first in order. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(3, 1).alias("held_out"), "text")
    return rows.mapInArrow(_predicting(learn(docs), margin, False), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known_languages(docs: DataFrame, margin: float = 0.002) -> DataFrame:
    """The documents whose language is not rejected, with all their columns, repeated rows included.

    Null texts and texts without a letter go. An empty table gives no rows.
    """
    return docs.mapInArrow(_predicting(learn(docs), margin, True), docs.schema)
