"""Text columns: accents, keys, lines, matches with code-point offsets. No user functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters they stand on; from the Unicode tables."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accents()
#: Unicode white space that texts have besides the ASCII kinds.
_SPACES = r"[\s   -     　]+"


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks; single marks go; ordinals like º stay."""
    return F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), _MARKED, _PLAIN)


def text_key(c: Column) -> Column:
    """Lower case, no accents, single blanks, trimmed; for comparing words."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), _SPACES, " "))


def tolerant_key(c: Column) -> Column:
    """A text key that also takes rn for m and anything but letters and digits for a blank."""
    return F.trim(F.regexp_replace(F.replace(text_key(c), F.lit("rn"), F.lit("m")), "[^a-z0-9]+", " "))


def level_of(c: Column) -> Column:
    """The level that an id names with _nK_; 1 by default."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?:^|_)n([1-9])(?:_|$)", 1), F.lit("")).cast("int"), F.lit(1))


def norm_id(c: Column) -> Column:
    """Digits without leading zeros; other ids as they are, trimmed."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t)


BLOCK = 128


def match_spans(c: Column, pattern: str) -> Column:
    """All matches of a Java pattern without empty matches: array of struct(first, last, piece), code points, end exclusive.

    The text is what stands between the matches and the matches; their lengths
    add up to the offsets. Null gives an empty array. Matches are added up in blocks
    of ``BLOCK``, because every step of a fold copies the array that it adds to.
    """
    text = F.coalesce(c, F.lit(""))
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # every match with what stands before it; the text's end comes last, without a match
    zipped = F.arrays_zip(found, gaps).cast("array<struct<m:string,g:string>>")
    one = "array<struct<first:int,last:int,piece:string>>"

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + F.length(x["g"])
        last = first + F.length(x["m"])
        return F.struct(last.alias("at"), F.array_append(a["out"], F.struct(first.alias("first"), last.alias("last"), x["m"].alias("piece"))).alias("out"))

    def block(a: Column, x: Column) -> Column:
        own = F.aggregate(F.filter(x, lambda y: y["m"].isNotNull()), F.struct(a["at"].alias("at"), F.array().cast(one).alias("out")), step)
        return _once(own, lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")))

    def whole(pairs: Column) -> Column:
        # the text's end makes an element even without a match, so there is a block
        last_block = F.floor((F.size(pairs) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last_block), lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out"))
        return F.flatten(F.aggregate(blocks, start, block, lambda a: a["out"]))

    return _once(zipped, whole)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no (from 0), first, last, line: lines at \\n with code-point offsets; carriage returns stay in the line."""
    d = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    d = d.withColumn("first", first.cast("bigint"))
    return d.select(id_col, "line_no", "first", (F.col("first") + F.length("line")).alias("last"), "line")


#: Characters of a prose line, strictly and more loosely; where a header ends at the latest.
PROSE, PROSE_LOOSE, HEADER, HEADER_FAR = 60, 30, 1500, 4000
_TWO_WORDS = r"(^|[^\p{L}])\p{Ll}{2,}[ \t]+\p{Ll}{2,}"
_LABEL = r"^[ \t]*\p{Lu}[\p{L} ]{0,30}:"


def is_prose(line: Column, least: int = PROSE) -> Column:
    """Long enough, two lower-case words side by side within its first 2000 characters, and no ``Label: value``."""
    return (F.length(line) >= least) & F.substring(line, 1, 2000).rlike(_TWO_WORDS) & ~line.rlike(_LABEL)


def header_end(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, header_end, tier: offset of the first prose line: within ``HEADER`` characters, else a looser one there, else one within ``HEADER_FAR``, else 0."""
    at = F.col("first")
    x = lines(docs, id_col, text_col).select(id_col, at, is_prose(F.col("line")).alias("p"), is_prose(F.col("line"), PROSE_LOOSE).alias("q"))
    tiers = [F.min(F.when(F.col("p") & (at <= HEADER), at)), F.min(F.when(F.col("q") & (at <= HEADER), at)), F.min(F.when(F.col("p") & (at <= HEADER_FAR), at))]
    a = x.groupBy(id_col).agg(*[t.alias(f"t{i}") for i, t in enumerate(tiers, 1)])
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3).otherwise(4)
    return a.select(id_col, F.coalesce("t1", "t2", "t3", F.lit(0)).alias("header_end"), tier.alias("tier"))


def iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Intersection over union of two spans; 0 where both are empty."""
    both = F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))
    union = (a2 - a1) + (b2 - b1) - both
    return F.when(union > 0, both.cast("double") / union).otherwise(F.lit(0.0))


def crop(context: Column, piece: Column, most: int = 900) -> Column:
    """At most ``most`` characters of a context, around the first place of ``piece``."""
    at = F.position(piece, context)
    start = F.greatest(F.lit(1), at - F.floor((F.lit(most) - F.length(piece)) / 2).cast("int"))
    start = F.least(start, F.greatest(F.lit(1), F.length(context) - most + 1))
    return F.when(F.length(context) <= most, context).otherwise(F.substr(context, start, F.lit(most)))


def mask(text: Column, spans: Column, opening: str = "⟦", closing: str = "⟧") -> Column:
    """The text with brackets around spans (sorted, apart); done from the right, so that offsets hold."""
    put = lambda a, s: F.concat(F.substr(a, F.lit(1), s["first"]), F.lit(opening), F.substr(a, s["first"] + 1, s["last"] - s["first"]), F.lit(closing), F.substr(a, s["last"] + 1))
    return F.aggregate(F.reverse(spans), text, put)
