"""Column builders for tokenizers, symbols, byte hashes and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

END_OF_WORD = "</w>"
OPEN, CLOSE = "\x01", "\x02"  # around each symbol of a wrapped word
NOT_SPACE = "[^ \\t\\n\\x0B\\f\\r]"


def whitespace_tokens(text: Column, max_len: int = 99) -> Column:
    """Runs of other than C white space, longer ones in pieces of max_len code points."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}{{1,{max_len}}}"), F.lit(0))


def alpha_lower_tokens(text: Column) -> Column:
    """Runs of ASCII letters, `<`, `>`, `_` and `-`, lower-cased after they are cut."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z<>_-]+"), F.lit(0)), F.lower)


def symbols(word: Column) -> Column:
    """Code points of a word and the end-of-word symbol."""
    return F.concat(F.split(word, ""), F.array(F.lit(END_OF_WORD)))


def wrapped(word: Column) -> Column:
    """The symbols as one string, each between OPEN and CLOSE; these two are dropped from the word."""
    clean = F.translate(word, OPEN + CLOSE, "")
    return F.concat(F.lit(OPEN), F.array_join(symbols(clean), CLOSE + OPEN), F.lit(CLOSE))


def unwrapped(word: Column) -> Column:
    return F.split(word.substr(F.lit(2), F.length(word) - 2), CLOSE + OPEN)


def symbol_count(word: Column) -> Column:
    return F.length(word) - F.length(F.replace(word, F.lit(OPEN), F.lit("")))


def merged(word: Column, left: Column, right: Column) -> Column:
    """A wrapped word with each (left, right), from the left and without overlap, as one symbol."""
    o, c = F.lit(OPEN), F.lit(CLOSE)
    return F.replace(word, F.concat(o, left, c, o, right, c), F.concat(o, left, right, c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def adjacent_pairs(word: Column) -> Column:
    """The (left, right) pairs of a wrapped word, overlaps counted."""
    return let(unwrapped(word), lambda a: F.transform(F.slice(a, 1, F.size(a) - 1), lambda x, i: F.struct(x.alias("left"), F.get(a, i + 1).alias("right"))))


def _bytes(text: Column) -> Column:
    """Unsigned UTF-8 bytes."""

    def split(raw: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest((F.length(raw) / 2 - 1).cast("int"), F.lit(0)))
        return F.when(F.length(raw) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.conv(raw.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")))

    return let(F.hex(F.encode(text, "UTF-8")), split)


def polynomial_hash(text: Column, factor: int, start: int, modulus: int) -> Column:
    """(h * factor + byte) in 64 unsigned bits, mod modulus; halves of 32 bits keep clear of overflow."""
    half = 1 << 32
    zero = F.struct(F.lit(start // half).cast("bigint").alias("hi"), F.lit(start % half).cast("bigint").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        low = s.lo * factor + b
        return F.struct(F.pmod(s.hi * factor + F.floor(low / half), F.lit(half)).cast("bigint").alias("hi"), F.pmod(low, F.lit(half)).cast("bigint").alias("lo"))

    return F.aggregate(_bytes(text), zero, step, lambda s: F.pmod(F.pmod(s.hi, F.lit(modulus)) * (half % modulus) + s.lo, F.lit(modulus)))


def djb2(text: Column, modulus: int = 100_003) -> Column:
    return polynomial_hash(text, 33, 5381, modulus)


def times31(text: Column, modulus: int) -> Column:
    return polynomial_hash(text, 31, 5381, modulus)


def pair_times31(left: Column, right: Column, modulus: int) -> Column:
    """times31 of a pair, parted by `#`."""
    return times31(F.concat(left, F.lit("#"), right), modulus)


def number_or_text(cell: Column) -> tuple[Column, Column]:
    """(number, text) of a trimmed cell: one of them is null; an empty cell is text."""
    cell = F.btrim(cell)
    number = F.when(cell.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), cell.try_cast("double"))
    return number, F.when(number.isNull(), cell)


def fnv1a(text: Column, mask: int = 0xFFFFFFFF) -> Column:
    """FNV-1a in 32 bits; the product is taken in two parts below 2**63."""
    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        return F.pmod(F.pmod(F.shiftright(x, 16) * 16777619, F.lit(1 << 16)) * (1 << 16) + x.bitwiseAND(F.lit(0xFFFF)) * 16777619, F.lit(1 << 32)).cast("bigint")

    return F.aggregate(_bytes(text), F.lit(2166136261).cast("bigint"), step).bitwiseAND(F.lit(mask))


def variant_label(file_name: Column) -> Column:
    """The variant that the name of a trace file, or of the folder of its part files, tells; the name without .csv if none.

    Fixed values: the families' names and marks, and their order.
    """
    name = F.regexp_extract(F.regexp_replace(file_name, "/part-[^/]*$", ""), "([^/]*)/*$", 1)
    low = F.lower(name)
    found = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
    return F.coalesce(
        F.when(low.contains("seq"), F.lit("Sequential")),
        F.when(low.contains("hybrid"), F.coalesce(F.concat(F.lit("Hybrid-"), found("([0-9]+)p"), F.lit("p")), F.lit("Hybrid"))),
        F.when(low.contains("cuda"), F.lit("CUDA")),
        F.concat(F.lit("OMP-"), found("omp.*?([0-9]+)t"), F.lit("t")),
        F.concat(F.lit("MPI-"), found("mpi.*?([0-9]+)p"), F.lit("p")),
        F.replace(name, F.lit(".csv"), F.lit("")),
    )


def variant_class(label: Column) -> Column:
    """The family that a label names, in this order; `seq` if none."""
    out = F.when(F.lower(label).contains("seq"), "seq")
    for family in ("omp", "hybrid", "cuda", "mpi"):
        out = out.when(F.lower(label).contains(family), family)
    return out.otherwise("seq")


def variant_number(label: Column) -> Column:
    return F.try_to_number(F.regexp_extract(label, "([0-9]+)", 1), F.lit("9999999999")).cast("int")


def short_number(x: Column) -> Column:
    """1.2M, 3.4k, 567 or 8.90."""
    return F.when(x >= 1e6, F.concat(F.format_string("%.1f", x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(F.format_string("%.1f", x / 1e3), F.lit("k"))).when(x >= 100, F.format_string("%.0f", x)).otherwise(F.format_string("%.2f", x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
