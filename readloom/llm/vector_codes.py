"""Vector codes: product quantisation in whole numbers, with codebooks from exact k-means and partial-distance search.

Every component x becomes floor(4096 x); vectors are cut into equal consecutive parts; a code names for each part the
nearest entry of that part's codebook. Codebooks start as the parts of the vectors with the smallest ids and follow
``rounds`` rounds of assignment and componentwise floor(sum / count); entries that no part is nearest to stay.

Partial-distance search: the dimensions of a part are gone through in descending variance of its codebook. A first
complete distance, that to the entry nearest in the leading dimension, bounds all others; each entry's distances
grow dimension by dimension for all vectors of a batch at once, and a mask drops those vectors for which the sum
strictly exceeds their best complete distance. Sums are whole numbers, so the result is that of a full search.

Each round is one job over vectors written once: tasks add up their own parts, what travels is one row per task, part
and entry, and what reaches the driver, and goes to the tasks again, is the codebooks (parts x entries rows).

Rules: vectors that are null or hold a null or non-finite component are dropped, and so are those whose length is not
that of the smallest kept id's vector. Ids order as Spark orders them, null ids last, equal ids by their vectors.
With fewer vectors than entries the codebooks are shorter. A length that is no multiple of the number of parts gives
the first parts one component more; a part without components has distance 0 to entry 0. Repeated rows count as often
as they occur. Components of any size are exact (numbers beyond 64 bits are Python's); an error beyond the range of a
long is given as the largest long. Without vectors the result is empty. Columns other than id, vector and label are
not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import discard, materialise, spread
from readloom.llm.textbatch import tidy

SCALE = 4096
MOST = 2**63 - 1
#: Up to so many labels, their sums are broadcast.
MAX_BROADCAST_LABELS = 100_000


@dataclass
class Codebooks:
    """For each part its entries, each a tuple of whole numbers."""

    parts: list[list[tuple[int, ...]]]

    def edges(self) -> list[int]:
        return np.cumsum([0] + [len(p[0]) for p in self.parts]).tolist()

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.parts for entry in part for c in entry).encode()).hexdigest()


def cut(length: int, n_parts: int) -> list[int]:
    """Where parts begin and end; the first ones are longer if the length is no multiple."""
    size, more = divmod(length, n_parts)
    return [p * size + min(p, more) for p in range(n_parts + 1)]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(4096 x), as 64-bit numbers if they fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    numbers = [int(s) if np.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist(), strict=True)]
    return np.array(numbers, object).reshape(x.shape)


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as Python's numbers if most is beyond 64 bits."""
    return x.astype(object) if most >= 2**62 else x


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest entry of book and the squared distance, equal ones to the lower number."""
    n, width = x.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    reach = max(int(abs(a).max()) for a in (x, book))
    x, book = _exact(x, (2 * reach) ** 2 * width), _exact(book, (2 * reach) ** 2 * width)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    columns = [np.ascontiguousarray(x[:, d]) for d in order]
    lead = np.argsort(book[:, order[0]], kind="stable")
    steps = book[lead, order[0]]
    right = np.clip(np.searchsorted(steps, columns[0]), 1, len(steps) - 1) if len(steps) > 1 else np.zeros(n, np.int64)
    code = lead[np.where(abs(columns[0] - steps[right - 1]) <= abs(steps[right] - columns[0]), right - 1, right)] if len(steps) > 1 else np.zeros(n, np.int64)
    gap = x - book[code]
    best = (gap * gap).sum(axis=1)
    for e in range(len(book)):
        rows = np.flatnonzero(code != e)
        sums = np.zeros(len(rows), x.dtype)
        for column, d in zip(columns, order, strict=True):
            gap = column[rows] - book[e, d]
            sums = sums + gap * gap
            inside = sums <= best[rows]
            if not inside.all():
                rows, sums = rows[inside], sums[inside]
        won = (sums < best[rows]) | (e < code[rows])  # those left are as near at least
        code[rows[won]], best[rows[won]] = e, sums[won]
    return code, best


def _vectors(batch: pa.RecordBatch, at: int, length: int) -> np.ndarray:
    return whole_numbers(batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), length))


def _update(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over vectors (v)."""
    edges, arrays = books.edges(), [np.array(p, object) for p in books.parts]
    arrays = [a.astype(np.int64) if not a.size or abs(a).max() < 2**62 else a for a in arrays]

    @tidy
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            x = _vectors(batch, 0, edges[-1])
            for p, book in enumerate(arrays):
                part = x[:, edges[p] : edges[p + 1]]
                code, _ = nearest(part, book)
                order = np.argsort(code, kind="stable")
                entries, begin = np.unique(code[order], return_index=True)
                counts = np.diff(np.append(begin, len(order)))
                if part.size:
                    part = _exact(part, int(abs(part).max()) * len(part))
                    totals = np.add.reduceat(part[order], begin, axis=0) if len(order) else part
                else:
                    totals = np.zeros((len(entries), 0), np.int64)
                for e, n, total in zip(entries.tolist(), counts.tolist(), totals.astype(object), strict=True):
                    m, held = sums.get((p, e), (0, 0))
                    sums[p, e] = (m + n, held + total)
        rows = [(p, e, n, [str(v) for v in total]) for (p, e), (n, total) in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["part", "entry", "n", "total"])

    def merge(table: pa.Table) -> pa.Table:
        n = sum(table["n"].to_pylist())
        total = [sum(map(int, c)) // n for c in zip(*table["total"].to_pylist(), strict=True)]
        return pa.table({"part": table["part"][:1], "entry": table["entry"][:1], "mean": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    added = vectors.select("v").mapInArrow(add_up, "part int, entry int, n long, total array<string>")
    found = added.groupBy("part", "entry").applyInArrow(merge, "part int, entry int, mean array<string>").collect()
    parts = [list(p) for p in books.parts]
    for r in found:
        parts[r["part"]][r["entry"]] = tuple(map(int, r["mean"]))
    return Codebooks(parts)


def kept_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v of the vectors that are coded, written once."""
    kind = table.schema[vec_col].dataType.elementType
    v = F.col(vec_col) if isinstance(kind, T.FloatType) else F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = spread(table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).filter(v.isNotNull() & ~bad), "vec_id")
    kept = materialise(rows, "vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").first()
    return kept if first is None else kept.filter(F.size("v") == len(first["v"]))


def fit(vectors: DataFrame, n_parts: int = 8, n_entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of vectors (vec_id, v); None without any."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n_entries).select("v").collect()
    if not first:
        return None
    start = whole_numbers(np.array([r["v"] for r in first], np.float64).reshape(len(first), -1)).astype(object)
    edges = cut(start.shape[1], n_parts)
    books = Codebooks([[tuple(row) for row in start[:, low:high].tolist()] for low, high in zip(edges, edges[1:], strict=False)])
    for _ in range(rounds):
        books = _update(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error (squared distance to what the code stands for)."""
    edges, arrays = books.edges(), [np.array(p, object) for p in books.parts]
    arrays = [a.astype(np.int64) if not a.size or abs(a).max() < 2**62 else a for a in arrays]
    digits = np.array([f"{e:02x}" for e in range(max(len(p) for p in books.parts))], object)

    @tidy
    def code_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, 2, edges[-1])
            code, error = np.full(len(x), "", object), np.zeros(len(x), object)
            for p, book in enumerate(arrays):
                entry, far = nearest(x[:, edges[p] : edges[p + 1]], book)
                code, error = code + digits[entry], error + far.astype(object)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array([min(e, MOST) for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select("vec_id", "label", "v").mapInArrow(code_all, schema)


def decode(code: Column, books: Codebooks) -> Column:
    """The vector that a code stands for, as doubles."""
    one = lambda p: F.element_at(F.lit([[c / SCALE for c in entry] for entry in books.parts[p]]), F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1)
    return F.concat(*[one(p) for p in range(len(books.parts)) if books.parts[p][0]])


def label_errors(coded: DataFrame) -> DataFrame:
    """coded (vec_id, label, code, error) with label_error, the errors of all rows of its label; null is a label.

    Sums per label are added up in tasks first. Up to ``MAX_BROADCAST_LABELS`` of them are broadcast (counted before);
    beyond, no label with a large share of the rows can be in the way of a plain join but that which Spark's skew
    join splits.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = materialise(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    side = F.broadcast(sums) if sums.count() <= MAX_BROADCAST_LABELS else sums
    return coded.join(side, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = fit(vectors)
    if books is None:
        return spark.createDataFrame([], T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL("code string, error long, label_error long, codebooks_sha256 string")]))
    coded = materialise(encode(vectors, books), "codes")
    discard(vectors)
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql(n_parts: int = 8, n_entries: int = 16, rounds: int = 6) -> str:
    """Rounds one after the other; a codebook is a table of part, entry and the list of its components."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {n_parts}) + 1 : (p + 1) * (len(v) // {n_parts})] AS x FROM kept, range({n_parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS r FROM parts) WHERE r <= {n_entries})",
    ]
    near = "SELECT vec_id, parts.p, min({{d: list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT, e: e}}) AS b, any_value(x) AS x FROM parts JOIN book{r} ON parts.p = book{r}.p GROUP BY vec_id, parts.p"
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({near.format(r=r)})")
        mean = f"SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, b.e AS e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM (SELECT p, b, x, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY ALL) GROUP BY p, e"
        steps.append(f"book{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM book{r} o LEFT JOIN ({mean}) m ON m.p = o.p AND m.e = o.e)")
    steps.append(f"last AS MATERIALIZED ({near.format(r=rounds)})")
    steps.append("coded AS (SELECT vec_id, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM last GROUP BY vec_id)")
    sha = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {sha} AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"


SQL = {"op13_vector_codes": _sql()}
