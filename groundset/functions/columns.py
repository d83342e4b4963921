"""Column expressions: hashes, token sets, text clean-up, gates, geometry, intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\r\f\x0B]"


def md5_int(key: Column) -> Column:
    """The first 32 bits of md5 as a number; replaces every random draw of the library."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def clean_whitespace(text: Column) -> Column:
    """Spaces and tabs to one space, three or more line ends to two, trimmed."""
    out = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(out, f"^{SPACES}+|{SPACES}+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACES}+", " "), "^ | $", "")


def normalize_surface(text: Column) -> Column:
    """Bullets become sentence ends or go, spaces collapse, the first letter is a capital, a final stop is there."""
    marked = F.regexp_replace(text, r"([^.?!:; \t\n\r\f])[ \t\n\r\f]*[•*-][ \t]+", "$1. ")
    out = collapse(F.regexp_replace(marked, r"(^|[ \t\n\r\f])[•*-][ \t]+", "$1"))
    out = F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))
    return F.when(out == "", out).when(out.rlike(r"[.?]$"), out).otherwise(F.concat(F.regexp_replace(out, "[,;:!]$", ""), F.lit(".")))


def split_claims(text: Column, least: int = 15) -> Column:
    """Pieces at bullets, line ends and after `.` or `;` before a space, of at least `least` characters."""
    pieces = F.split(F.regexp_replace(text, r"([.;])[ \t\r\f]+", "$1\n"), r"[•\n]")
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, f"^{SPACES}+|{SPACES}+$", "")), lambda p: F.length(p) >= least)


def prose_tests(text: Column) -> list[tuple[str, Column]]:
    """(name, passes) of the tests of running prose, in the order in which the first failure is reported."""
    n = F.greatest(F.length(text), F.lit(1))
    head = F.substring(text, 1, 120)
    return [
        ("short", F.length(text) >= 140),
        ("header", ~F.substring(text, 1, 170).rlike(r"(?i)table of contents|figure [0-9]|legend:")),
        ("running_head", ~text.rlike(r"^[0-9]+[ .][A-Z]")),
        ("digits", F.regexp_count(text, F.lit("[0-9]")) / n <= 0.12),
        ("citations", ~text.rlike(r"\[[0-9]+\]|et al\.")),
        ("capitals", F.regexp_count(head, F.lit(r"\p{Lu}")) / F.greatest(F.regexp_count(head, F.lit(r"\p{L}")), F.lit(1)) <= 0.5),
        ("periods", F.regexp_count(text, F.lit(r"\.")) >= 2),
        ("lower", F.regexp_count(text, F.lit(r"\p{Ll}")) / n >= 0.66),
    ]


def length_band(n: Column) -> tuple[Column, Column]:
    """Accepted lengths around a target: the wider of 20/25 % and 5 words, rounded half to even, 1 at least."""
    low = F.greatest(F.lit(1), F.bround(F.least(n * 0.8, n - 5.0)).cast("int"))
    return low, F.bround(F.greatest(n * 1.25, n + 5.0)).cast("int")


def yes_no(reply: Column) -> Column:
    """yes / no by the reply's start, else by its first 12 characters, else `parse`."""
    low = F.lower(F.regexp_replace(reply, f"^{SPACES}+", ""))
    near = F.substring(low, 1, 12)
    return F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no").when(near.contains("yes"), "yes").when(near.contains("no"), "no").otherwise("parse")


def choice_letter(reply: Column, n_options: Column | int) -> Column:
    """0-based option named by the first lone letter A to E, null if there is none or it is out of range."""
    letter = F.upper(F.regexp_extract(reply, r"(?:^|[^\p{L}\p{N}_])([A-Ea-e])(?:$|[^\p{L}\p{N}_])", 1))
    at = F.ascii(letter) - 65
    return F.when((letter != "") & (at < n_options), at)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; null if n is 0."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return tuple(F.when(n > 0, F.round(x, 6)) for x in (mid - half, mid + half))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Area shared by boxes whose columns are a_x0 ... and b_x0 ..."""
    c = lambda s, k: F.col(f"{s}_{k}")
    return area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))


def box_area(a: str) -> Column:
    return area(*[F.col(f"{a}_{k}") for k in ("x0", "y0", "x1", "y1")])


def iou(a: str, b: str) -> Column:
    both = overlap(a, b)
    return F.when(box_area(a) + box_area(b) - both > 0, both / (box_area(a) + box_area(b) - both)).otherwise(0.0)


def containment(a: str, b: str) -> Column:
    """Share of box a inside box b; 0 for an empty box."""
    return F.when(box_area(a) > 0, overlap(a, b) / box_area(a)).otherwise(0.0)


def ascii_bounds(pattern: str) -> str:
    r"""`pattern` with `\b` between an ASCII letter, digit or underscore and anything else, as in SQL: Java's own takes letters such as \u00f1 for parts of words."""
    word = "[0-9A-Za-z_]"
    bound = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return re.sub(r"\\(.)", lambda m: bound if m[1] == "b" else m[0], pattern, flags=re.S)
