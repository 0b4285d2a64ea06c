"""Reference sequences laid end to end: offsets, position look-up, chimera test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.ordered import earlier, later, number, of_ranges, ranges, running_sum
from readloom.tables import materialise


def concat_offsets(refs: DataFrame, spacer: int = 0, blocks: int | None = None) -> DataFrame:
    """refs (ref_ord, ref_id, seq) with start_off, end_off and next_off; every gap adds 2 * spacer."""
    size = F.length("seq") + 2 * spacer
    rows = running_sum(refs, size, "start_off", "ref_ord", n=blocks)
    return rows.withColumn("end_off", F.col("start_off") + F.length("seq")).withColumn("next_off", F.col("start_off") + size)


def drop_empty_headers(records: DataFrame) -> DataFrame:
    """Of headers without a sequence between them the first names the sequence that follows (ord, header, seq)."""
    rows = ranges(records, "ord").withColumn("own", F.when(F.col("seq") != "", F.col("ord")))
    rows = of_ranges(rows, F.min("own"), F.last("carried", ignorenulls=True).over(later()), "carried")
    down = Window.partitionBy("range").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("named", F.coalesce(F.last("own", ignorenulls=True).over(down), "carried"))
    found = rows.groupBy("named").agg(F.min("ord").alias("ord"), F.min_by("header", "ord").alias("header"), F.max_by("seq", "ord").alias("seq"))
    return found.drop("named").filter("seq <> ''")


def locate(positions: DataFrame, offsets: DataFrame, *more: str) -> DataFrame:
    """positions (pos) with ref_id and next_off (and more columns of offsets) of the last reference that starts at or before pos.

    The last reference's interval is open; positions before the first start, and all if there is no reference, go.
    Starts and positions are merged in one order, cut into ranges; the last start before a range is carried into it. A
    reference with most of the positions, or one position repeated, fills several ranges, as rows have numbers of their own.
    """
    found = F.struct("start_off", "ref_id", "next_off", *more)
    starts = offsets.filter("next_off > start_off").select(F.col("start_off").cast("long").alias("_p"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_at"), found.alias("_start"))
    rows = positions.select(F.col("pos").cast("long").alias("_p"), F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_at"), F.struct("*").alias("_row"))
    both = ranges(starts.unionByName(rows, allowMissingColumns=True), "_p", "_kind", "_at")
    both = of_ranges(both, F.max("_start"), F.last("_carried", ignorenulls=True).over(earlier()), "_carried")
    inside = Window.partitionBy("range").orderBy("_p", "_kind", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_found", F.coalesce(F.last("_start", ignorenulls=True).over(inside), "_carried"))
    return both.filter("_kind = 1 AND _found IS NOT NULL").select("_row.*", *[f"_found.{c}" for c in ("ref_id", "next_off", *more)])


def windows(places: DataFrame, refs: DataFrame) -> DataFrame:
    """places (pos, from 1, in all references end to end, len) with win, the text there; refs as concat_offsets has them.

    A window may run over borders: it then joins all consecutive references that it covers, and their parts are put
    together in order. Gaps are N; behind the last reference a window ends. Equal places are looked up once.
    """
    slots = materialise(number(refs.filter("next_off > start_off").select("start_off", "next_off", "seq", "ref_id"), "slot", "start_off"), "slots")
    at = materialise(places.select("pos", "len").distinct(), "windows")
    end = lambda df, shift, name: locate(df.withColumns({"_from": F.col("pos"), "pos": shift}), slots, "slot").withColumnsRenamed({"slot": name, "pos": "_shifted", "_from": "pos"}).drop("ref_id", "next_off", "_shifted")
    ends = end(end(at.filter("len > 0"), F.col("pos") - 1, "first"), F.col("pos") + F.col("len") - 2, "last")
    parts = ends.withColumn("slot", F.explode(F.sequence("first", "last"))).join(slots.drop("ref_id"), "slot")
    gap = F.repeat(F.lit("N"), ((F.col("next_off") - F.col("start_off") - F.length("seq")) / 2).cast("int"))
    low = F.greatest(F.col("pos") - 1, F.col("start_off"))
    high = F.least(F.col("pos") - 1 + F.col("len"), F.col("next_off"))
    part = F.substr(F.concat(gap, "seq", gap), (low - F.col("start_off") + 1).cast("int"), (high - low).cast("int"))
    parts = parts.select("pos", "len", "first", "last", "slot", part.alias("part"))
    whole = parts.filter(F.col("first") == F.col("last")).select("pos", "len", F.col("part").alias("win"))
    pieces = F.array_sort(F.collect_list(F.struct("slot", "part")))
    joined = parts.filter(F.col("first") < F.col("last")).groupBy("pos", "len").agg(F.array_join(F.transform(pieces, lambda x: x["part"]), "").alias("win"))
    found = whole.union(joined).select(F.col("pos").alias("_pos"), F.col("len").alias("_len"), "win")
    out = places.join(found, (F.col("pos") == F.col("_pos")) & (F.col("len") == F.col("_len")), "left")
    return out.select(*places.columns, F.coalesce("win", F.lit("")).alias("win"))


def chimera_flag(hits: DataFrame, tolerance: int = 0, flush_end: str = "reject") -> DataFrame:
    """Adds is_chimera: the hit runs over its reference's end. pos is 1-based; "reject" counts it as 0-based, so a hit flush with the end is one too."""
    room = F.col("next_off") - F.col("pos") + (0 if flush_end == "reject" else 1) + tolerance
    return hits.withColumn("is_chimera", F.col("len") > room)
