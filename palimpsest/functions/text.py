"""Tokens, token estimates and previews as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no retrieval signal.
STOP_WORDS = """
a an the and or but in on at to for of with by from is are was were be been have has had do does did will would could
should may might shall can this that these those i we you he she they it its my our your his her their not no so if as
up out about into than then when where who which what how all any each also just more
""".split()

PREVIEW = 120


def _stem(t: Column) -> Column:
    """At most one suffix goes: ing of more than 5 letters, ed of more than 4, s (not ss) of more than 3."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n > 5) & F.endswith(t, F.lit("ing")), cut(3))
        .when((n > 4) & F.endswith(t, F.lit("ed")), cut(2))
        .when((n > 3) & F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")), cut(1))
        .otherwise(t)
    )


def tokens(text: Column) -> Column:
    """Array of tokens: ASCII letters and digits of the lower-cased text, stop words and single characters dropped, then stemmed."""
    return F.transform(_raw(F.lower(F.coalesce(text, F.lit("")))), _stem)


def _raw(low: Column) -> Column:
    return F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))


#: A token of a lower-cased text, before stemming.
_TOKEN = f"(?<![a-z0-9])(?!(?:{'|'.join(STOP_WORDS)})(?![a-z0-9]))[a-z0-9]{{2,}}"


def token_count(low: Column) -> Column:
    """How many tokens a lower-cased text has; stems don't matter."""
    return F.regexp_count(low, F.lit(_TOKEN))


def has_tokens(low: Column) -> Column:
    """Whether a lower-cased text has any token, by its first one."""
    return F.rlike(low, F.lit(_TOKEN))


def forms(stem: str) -> list[str]:
    """The whole words that have this stem."""
    return [f for f in (stem, f"{stem}ing", f"{stem}ed", f"{stem}s") if tokens_of(f) == [stem]]


def found(low: Column, stems: list[str]) -> Column:
    """Array of the words of a lower-cased text that have one of these stems, by one pass, or none if no stem is in it."""
    words = "|".join(f for s in stems for f in forms(s))
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in stems])
    return F.when(some, F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9])(?:{words})(?![a-z0-9])"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def tokens_of(text: str) -> list[str]:
    """The same for a query text on the driver, where tokens become literals of the plan."""
    import re

    out = []
    for t in re.findall("[a-z0-9]+", text.lower()):
        if len(t) >= 2 and t not in STOP_WORDS:
            for suffix, least in (("ing", 6), ("ed", 5), ("s", 4)):
                if len(t) >= least and t.endswith(suffix) and not (suffix == "s" and t.endswith("ss")):
                    t = t[: -len(suffix)]
                    break
            out.append(t)
    return out


def word_count(text: Column) -> Column:
    """Words between white space of any kind."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"(?U)\s+")))


def token_estimate(text: Column) -> Column:
    """Three quarters of the words, halves to even, one at least."""
    return F.greatest(F.lit(1), F.bround(word_count(text) * F.lit(0.75), 0).cast("int"))


def preview(text: Column, length: int = PREVIEW) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("…"))).otherwise(text)


def _folds() -> tuple[str, str]:
    """Letters of the Latin blocks that are an ASCII character with marks, and that character."""
    bare = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]}
    one = {c: b for c, b in bare.items() if len(b) == 1 and b != " "}
    return "".join(one), "".join(one.values())


def normalised(title: Column) -> Column:
    """A title in lower case, its letters without their marks, other characters beyond ASCII dropped, and trimmed; null for null."""
    plain = F.translate(F.lower(title), *_folds())
    return F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", ""), r"^\s+|\s+$", "")
