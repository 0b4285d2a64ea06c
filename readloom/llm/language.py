"""Language identification with bit-sliced Bloom filters over character n-grams.

Each language has a Bloom filter of its most frequent n-grams; the filters share one table in which a slot holds
a bitmask of languages, so one look-up per hash function returns all languages that contain an n-gram. A text's
hits per language are popcounts over its n-grams, corrected for the filter's false-positive rate f as
``(hits - n f) / (1 - f)``; the largest corrected count decides, and its share of all is the score.

Learning takes at most about ``max_train`` labelled texts (those with the smallest hashes of id and text); the
driver then sees ``per_language`` n-grams a language. A prediction sees nothing but the text.

Rules: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; ties go to the first language in order; a
text without any hit gets the language with most training texts and score 0; without training rows all is
``und``. Any number of languages is allowed: masks take as many 64-bit lanes as needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import id_fold, spread
from readloom.llm.textbatch import mix, tidy

ORDERS = (3, 4)
N_HASHES = 3
UNKNOWN = "und"
#: Letters, marks that belong to them, and nothing else: numerals such as a half or a superscript are none.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def ngrams(text: str | None, piece: int = 1 << 18) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the lower-cased text, in which anything but letters is one space; nothing if it has no letter."""
    if not text or not _LETTER.search(text):
        return
    words = _NOT_LETTERS.sub(" ", text).strip().lower()
    points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for low in range(0, len(points), piece):
        for n in ORDERS:
            part = points[low : low + piece + n - 1]
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, np.uint64)
                for j in range(n):
                    h = (h << np.uint64(16)) + h * np.uint64(31) + part[j : j + len(h)]
                yield mix(h)


def _slots(h: np.ndarray, n_slots: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(n_slots - 1)).astype(np.int64) for i in range(N_HASHES)]


class LanguageFilters:
    def __init__(self, languages: list[str], members: list[np.ndarray], prior: int):
        self.languages, self.prior = languages, prior
        total = sum(map(len, members))
        self.n_slots = 1 << max(10, (16 * max(total, 1) - 1).bit_length())
        self.lanes = -(-len(languages) // 64) or 1
        self.table = np.zeros((self.lanes, self.n_slots), np.uint64)
        for i, h in enumerate(members):
            for s in _slots(h, self.n_slots):
                self.table[i // 64, s] |= np.uint64(1) << np.uint64(i % 64)
        fill = np.array([(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false_rate = np.minimum(fill**N_HASHES, 0.999)

    def counts(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """Corrected number of the text's n-grams in each language, the number of n-grams, and of those in any language."""
        hits, n, known = np.zeros(len(self.languages)), 0, 0
        for h in ngrams(text):
            n += len(h)
            slots = _slots(h, self.n_slots)
            some = np.zeros(len(h), bool)
            for lane in range(self.lanes):
                masks = self.table[lane][slots[0]]
                for s in slots[1:]:
                    masks &= self.table[lane][s]
                some |= masks != 0
                here = min(64, len(self.languages) - 64 * lane)
                if here <= 12:
                    found = np.bincount(masks.astype(np.int64), minlength=1 << here)
                    values = np.arange(len(found), dtype=np.uint64)
                else:
                    values, found = np.unique(masks, return_counts=True)
                for i in range(here):
                    hits[64 * lane + i] += found[(values >> np.uint64(i) & np.uint64(1)).astype(bool)].sum()
            known += int(some.sum())
        return np.maximum(0, (hits - n * self.false_rate) / (1 - self.false_rate)), n, known

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the share of the text's n-grams that any language has."""
        if not self.languages:
            return UNKNOWN, 0.0, 0.0
        counts, n, known = self.counts(text)
        if not n:
            return UNKNOWN, 0.0, 0.0
        best, total = int(counts.argmax()), counts.sum()
        return (self.languages[best], float(counts[best] / total), known / n) if total > 0 else (self.languages[self.prior], 0.0, known / n)


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 20_000, per_language: int = 6_000) -> LanguageFilters:
    """Learns from rows with a language and a text."""
    named = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = named.select(lang_col).count()
    share = min(1.0, max_train / max(total, 1))
    u = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("train")), F.lit(1 << 30))
    sample = named.filter(u < int(share * (1 << 30))) if share < 1 else named

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lang in sorted(set(langs)):
                held = [h for i, x in enumerate(langs) if x == lang for h in ngrams(texts[i].as_py())]
                h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n), pa.array([sum(x == lang for x in langs)] + [0] * (len(h) - 1) if len(h) else [], pa.int64())], names=["lang", "h", "n", "docs"])

    grams = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(tidy(count), "lang string, h long, n long, docs long")
    sums = grams.groupBy("lang", "h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    docs_of = F.sum("docs").over(Window.partitionBy("lang"))
    top = sums.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h")).alias("rank"), docs_of.alias("lang_docs")).filter(F.col("rank") <= per_language)
    found = top.select("lang", "h", "lang_docs").toPandas()
    languages = sorted(found["lang"].unique().tolist())
    members = [found.loc[found["lang"] == x, "h"].to_numpy(np.int64).view(np.uint64) for x in languages]
    sizes = [int(found.loc[found["lang"] == x, "lang_docs"].iloc[0]) for x in languages]
    return LanguageFilters(languages, members, int(np.argmax(sizes)) if sizes else 0)


def predictor(spark: SparkSession, filters: LanguageFilters):
    """A column function: text to struct(lang_pred, score, hit_share). The table's size depends on languages, not on rows."""
    shared = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double, hit_share double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "hit_share"])

    return predict


def held_out(id_col: str) -> Column:
    return id_fold(F.col(id_col), 4) == 2


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), "doc_id")
    model = predictor(spark, fit(docs.filter(~held_out("doc_id"))))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), model("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
