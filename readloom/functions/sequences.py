"""Column functions on headers and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_of(header: Column) -> Column:
    """The part before the first underscore, blank or line feed; a leading > is dropped."""
    return F.regexp_extract(F.regexp_replace(header, "^>", ""), "^([^_ \n]*)", 1)


def read_id_of(header: Column) -> Column:
    """The part before the first blank, carriage return or line feed."""
    return F.regexp_extract(F.regexp_replace(header, "^>", ""), "^([^ \r\n]*)", 1)


def trim_head(seq: Column, n: int | None) -> Column:
    """The first n bases; None or 0 keeps all."""
    return F.left(seq, F.lit(n)) if n else seq


def trim_tail(seq: Column, n: int | None) -> Column:
    """The last n bases; None or 0 keeps all."""
    return F.right(seq, F.lit(n)) if n else seq


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def is_ambiguous(seq: Column) -> Column:
    """Empty, or with a letter other than A, C, G, T."""
    return (seq == "") | seq.rlike("[^ACGT]")


def without_ambiguity(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "A")


def _in_longs(seq: Column, digits: str) -> Column:
    n = F.ceil(F.length(seq) / 32).cast("int")
    places = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    known = F.regexp_replace(seq, "[^ACGT]", "N")
    return F.transform(places, lambda i: F.conv(F.translate(F.substring(known, i * 32 + 1, F.lit(32)), "ACGTN", digits), 4, -10).cast("long"))


def packed(seq: Column) -> Column:
    """Two bits a base, 32 bases a long, the last long filled up in front; letters other than A, C, G, T as A."""
    return _in_longs(seq, "01230")


def wild_bits(seq: Column) -> Column:
    """The lower of the two bits is set for letters other than A, C, G, T."""
    return _in_longs(seq, "00001")


def wild_letters(seq: Column) -> Column:
    """How many letters are none of A, C, G, T."""
    return F.length(F.regexp_replace(seq, "[ACGT]+", ""))


def mismatches(a: Column, b: Column, wild: Column) -> Column:
    """In how many places two packed sequences of one length differ, those not counted that are set in wild (an array of longs)."""
    odd = F.lit(0x5555555555555555)

    def differ(i: Column) -> Column:
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd).bitwiseAND(F.bitwise_not(F.get(wild, i))))

    return F.when(F.size(a) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0), lambda acc, i: acc + differ(i)))


def _up_to(count: Column) -> Column:
    """0 .. count - 1."""
    return F.when(count >= 1, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _words(seq: Column, k: int, places: Column) -> Column:
    return F.transform(places, lambda i: F.substring(seq, i + 1, F.lit(k)))


def _kmer_places(seq: Column, k: int) -> Column:
    return _up_to((F.length(seq) - (k - 1)).cast("int"))


def kmers(seq: Column, k: int) -> Column:
    """All overlapping words of length k."""
    return _words(seq, k, _kmer_places(seq, k))


def _support_places(seq: Column, k: int, mode: str, head: Column | None) -> Column:
    if mode == "deep":
        return _kmer_places(seq, k)
    places = F.transform(_up_to(F.floor(F.length(seq) / k).cast("int")), lambda i: i * k)
    if head is not None:
        places = F.filter(places, lambda i: (i + k <= head) | (i >= head))
    if mode == "endpiece":
        last = (F.length(seq) - k).cast("int")
        places = F.when((last >= 0) & (F.length(seq) % k != 0), F.concat(places, F.array(last))).otherwise(places)
    return places


def support_words(seq: Column, k: int, mode: str = "aligned", head: Column | None = None) -> Column:
    """Words whose rarity decides: every k-th one; with the last k bases too ("endpiece"); or all ("deep").

    For mates joined end to end, head is the first one's length: the word across the joint is left out and the
    second mate's words keep the grid of the joined sequence.
    """
    return _words(seq, k, _support_places(seq, k, mode, head))


#: Bases of a word that fits a long.
MOST_PACKED = 32


def _numbers(seq: Column, k: int, places: Column) -> Column:
    """The words of k bases at the places as longs, two bits a base; null for a word with another letter than A, C, G, T."""
    shift = lambda name, x, n: F.call_function(name, x, n)
    whole = F.rpad(seq, F.ceil(F.length(seq) / 32).cast("int") * 32, F.lit("A"))
    wild = F.when(seq.rlike("[^ACGT]"), wild_bits(whole))

    def word(longs: Column, i: Column) -> Column:
        at, by = F.floor(i / 32).cast("int"), (i % 32 * 2).cast("int")
        rest = F.when(by > 0, shift("shiftrightunsigned", F.coalesce(F.get(longs, at + 1), F.lit(0).cast("long")), 64 - by)).otherwise(F.lit(0).cast("long"))
        found = shift("shiftleft", F.get(longs, at), by).bitwiseOR(rest)
        return F.shiftrightunsigned(found, 64 - 2 * k) if k < MOST_PACKED else found

    def of(longs: Column) -> Column:  # the packed bases and the wild bits, made once for all words
        return F.transform(places, lambda i: F.when(F.coalesce(word(longs["wild"], i), F.lit(0).cast("long")) == 0, word(longs["bases"], i)))

    return F.transform(F.array(F.struct(packed(whole).alias("bases"), wild.alias("wild"))), of)[0]


def kmer_numbers(seq: Column, k: int) -> Column:
    """kmers as longs, k at most MOST_PACKED."""
    return _numbers(seq, k, _kmer_places(seq, k))


def support_numbers(seq: Column, k: int, mode: str = "aligned", head: Column | None = None) -> Column:
    """support_words as longs, k at most MOST_PACKED; null for words with other letters."""
    return _numbers(seq, k, _support_places(seq, k, mode, head))


def spelt(number: Column, k: int) -> Column:
    """The k bases of a packed word."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def taxonomy_levels(taxonomy: Column) -> Column:
    """Split at semicolons; one leading blank goes from all but the first level."""
    return F.transform(F.split(taxonomy, ";"), lambda x, i: F.when(i > 0, F.regexp_replace(x, "^ ", "")).otherwise(x))
