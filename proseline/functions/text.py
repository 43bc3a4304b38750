"""Tokenisers, splitters and small column helpers.

Patterns run in Java with ``(?dU)``: Unicode classes and boundaries, and only a line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: The characters of SPACE.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def rx(pattern: str, flags: str = "") -> Column:
    return F.lit(f"(?dU{flags}){pattern}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, rx(pattern, flags)).cast("long")


def find_all(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(text, rx(pattern, flags), F.lit(group))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Runs between Unicode white space."""
    return F.filter(F.split(text, f"(?dU){SPACE}+"), lambda x: x != "")


def lower_words(text: Column) -> Column:
    """Lowered runs of word characters."""
    return find_all(F.lower(text), r"\b\w+\b")


def alpha_words(text: Column) -> Column:
    """Runs of ASCII letters."""
    return find_all(text, "[a-zA-Z]+")


def bare_words(text: Column) -> Column:
    """Words without outer punctuation, lowered."""
    outer = r"(?<![^\s\x1c-\x1f])[^\w\s\x1c-\x1f]+|[^\w\s\x1c-\x1f]+(?![^\s\x1c-\x1f])"
    return words(F.regexp_replace(F.lower(text), rx(outer), F.lit("")))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Stretches between full stops, exclamation and question marks."""
    return _parts(text, "[.!?]+")


def closed_sentences(text: Column) -> Column:
    """Stretches between sentence ends that white space or the text's end follows, with closing quotes and brackets."""
    return _parts(text, "(?dU)[.!?][\"'”’)\\]]*(?:\\s|$)")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines; the whole text if there is none."""
    return let(_parts(text, r"(?dU)\n\s*\n"), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def run_lengths(values: Column) -> Column:
    """How often each distinct value of an array occurs, in the values' order."""

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when(~F.get(s, i - 1).eqNullSafe(x), i)), lambda i: i.isNotNull())
        return let(starts, lambda b: F.transform(b, lambda x, k: F.coalesce(F.get(b, k + 1), F.size(s)) - x))

    return let(F.sort_array(values), of_sorted)


def spread(lengths: Column) -> Column:
    """Of an array of whole numbers: n, mean and cv (population deviation over mean; 0 where the mean is 0), from exact sums."""
    long = F.transform(lengths, lambda x: x.cast("long"))
    zero = F.lit(0).cast("long")

    def stats(v: Column) -> Column:
        n, total = F.size(v).cast("long"), F.aggregate(v, zero, lambda a, x: a + x)
        square = F.aggregate(v, zero, lambda a, x: a + x * x)
        cv = F.when(total > 0, F.sqrt((n * square - total * total).cast("double")) / total).otherwise(0.0)
        return F.struct(n.alias("n"), F.when(n > 0, total / n).otherwise(0.0).alias("mean"), cv.alias("cv"))

    return let(long, stats)


def preprocess(text: Column) -> Column:
    """Lowered, without ASCII punctuation, white space collapsed."""
    bare = F.regexp_replace(F.lower(text), F.lit(r"[!-/:-@\[-`{-~]"), F.lit(""))
    return strip(F.regexp_replace(bare, rx(f"{SPACE}+"), F.lit(" ")))


def strip_thinking(text: Column, brackets: bool = True) -> Column:
    """Without closed and then unclosed thinking blocks; brackets: those in square brackets too."""
    kinds = [("<think>", "</think>")] + [(r"\[THINK\]", r"\[/THINK\]")] * brackets
    for a, b in kinds:
        text = strip(F.regexp_replace(text, rx(rf"{a}.*?{b}\s*", "s"), F.lit("")))
    for a, _ in kinds:
        text = strip(F.regexp_replace(text, rx(f"{a}.*", "s"), F.lit("")))
    return text


def valid_response(text: Column, least: int = 20) -> Column:
    """Whether a stripped response is long enough to score (20 in sweeps, 10 in evaluations)."""
    return F.coalesce(F.length(strip(text)) >= least, F.lit(False))


def excerpt(text: Column, longest: int = 600, take: int = 500) -> Column:
    """Texts of over ``longest`` words cut to ``take`` words from a quarter on."""
    return let(words(text), lambda w: F.when(F.size(w) > longest, F.array_join(F.slice(w, (F.size(w) / 4).cast("int") + 1, take), " ")).otherwise(text))


def body_lines(text: Column) -> Column:
    """Without blank lines and lines that open with a hash."""
    return F.array_join(F.filter(lines(text), lambda x: ~x.startswith("#") & (strip(x) != "")), "\n")


def run_suffix(text: Column) -> Column:
    """A label made fit for file names."""
    return F.regexp_replace(F.regexp_replace(text, F.lit("[^a-zA-Z0-9._-]"), F.lit("_")), F.lit("_+"), F.lit("_"))


def truncate(text: Column, most: int, mark: str = "...") -> Column:
    """The first characters of a text, marked if it goes on."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
