"""Expressions over text, and the stop-word list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split()


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case runs of a-z of `least` letters or more, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda t: F.length(t) >= least)


def lsa_word(word: Column) -> Column:
    """The first run of ASCII letters and digits, in lower case; what follows it is dropped."""
    return F.lower(F.regexp_extract(word, "^[^A-Za-z0-9]*([A-Za-z0-9]+)", 1))
