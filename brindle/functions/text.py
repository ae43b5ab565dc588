"""Column functions on text: tokens, word counts, shingles, slugs and answer normalisation. All stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no intent (fixed values).
STOP_WORDS = "i w na do z ze że o a to nie jak co czy jest sie się po od za przy dla lub albo oraz the of for to and in on a is".split()

def words(text: Column | str) -> Column:
    """Maximal runs of letters and numbers, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def content_tokens(text: Column | str) -> Column:
    """Words without stop words, duplicates kept."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w))


def word_count(text: Column | str) -> Column:
    """Tokens between white space that hold a letter or a number."""
    c = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def shingles(tokens: Column, k: int = 3) -> Column:
    """Sequences of ``k`` tokens, joined by a blank; empty for shorter texts."""
    n = F.size(tokens)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def unmarked(s: pd.Series) -> pd.Series:
    """Letters without their marks: canonical decomposition, combining marks dropped; ł has none and is a letter of its own."""
    decomposed = s.str.normalize("NFD").str.replace("[\u0300-\u036f]", "", regex=True)
    return decomposed.str.replace("ł", "l").str.replace("Ł", "L")


def slug(text: Column, longest: int = 60) -> Column:
    """Lower case, marks dropped, other runs as one hyphen, trimmed, cut. Only texts beyond ASCII leave the JVM."""
    t = F.coalesce(text, F.lit(""))
    s = F.lower(F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(unmarked(t)))
    return F.substring(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)


def normalize_answer(text: Column) -> Column:
    """Line ends as ``\\n``, blanks within a line collapsed, lines trimmed, at most one empty line between paragraphs."""
    s = F.regexp_replace(text, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"[\s&&[^\n] ]+", " ")
    s = F.regexp_replace(s, r"(?m)^ +| +$", "")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
