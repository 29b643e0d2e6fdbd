"""Which strings are part of which others, without trying every pair.

Every string that may hold others is cut into its pieces of up to three characters; a needle is known by the one of its own pieces that fewest strings have (a needle shorter
than three is its own piece). Needles meet strings by equality of pieces, and what meets is compared in full. Expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.functions.tables import merged
from lodegrain.functions.text import free_name

#: Characters of a piece at most.
WIDTH = 3
#: Bytes of a row without its columns by, and of the pieces of all needles that are sent to the executors, at most; more are sorted and merged.
ROW_BYTES, SENT_BYTES = 64, 8 << 20


def _cut(text: Column, width: int) -> Column:
    """All pieces of a width; read in one pass, as a match that takes no characters goes on with the next."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def pieces(text: Column, widths: list[int]) -> Column:
    """The distinct pieces of a string that have one of the widths."""
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *(_cut(text, k) if k else F.array(F.lit("")) for k in widths)))


def own_pieces(needle: Column) -> Column:
    """The pieces a needle may be looked up by: those of WIDTH characters; the needle itself where it is shorter."""
    return F.when(F.length(needle) < WIDTH, F.array(needle)).otherwise(F.array_distinct(_cut(needle, WIDTH)))


def within(needles: DataFrame, strings: DataFrame, needle: str, string: str, *by: str) -> DataFrame:
    """Distinct (by, needle, string) with the needle part of the string and equal columns by, which both sides have. Null needles and strings are in none and hold none; an empty needle is part of all."""
    piece, count = free_name("_piece", needles, strings), free_name("_count", needles, strings)
    looked = needles.select(*by, needle).where(F.col(needle).isNotNull()).distinct()
    row = F.lit(ROW_BYTES)
    for c in by:
        row = row + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    sizes = looked.groupBy(F.least(F.length(needle), F.lit(WIDTH)).alias("w")).agg(F.sum((F.length(needle) + 1) * row).alias("n")).collect()  # at most WIDTH + 1 rows
    widths = [r.w for r in sizes]
    meet = merged if sum(r.n for r in sizes) > SENT_BYTES else lambda left, right, on, how="inner": left.join(F.broadcast(right), on, how)
    asked = looked.select("*", F.explode(own_pieces(F.col(needle))).alias(piece))
    on = [*by, piece]
    every = strings.select(*by, string).where(F.col(string).isNotNull()).distinct().select("*", F.explode(pieces(F.col(string), widths)).alias(piece))
    held = meet(every, asked.select(*on).distinct(), on, "left_semi")
    counts = held.groupBy(*on).agg(F.count(F.lit(1)).alias(count))
    # a needle with a piece that no string has is part of none
    rarest = meet(asked, counts, on, "left").groupBy(*by, needle).agg(F.min_by(piece, F.coalesce(count, F.lit(0))).alias(piece))
    return meet(held, rarest, on).where(F.contains(F.col(string), F.col(needle))).select(*by, needle, string)
