"""Quality rules, line first. DataFrame operations only.

Each line of a text is held against punctuation, navigation and boilerplate rules;
failing lines are removed, and a document that loses more than ``max_loss`` of its
non-white characters is rejected. Beside these, the counts that corpus filters
usually take: words, symbols, repeated lines and words in repeated five-word windows.

Nothing is shuffled: a text is judged by itself, in one pass.

Defined results: a null or empty text has no words and is rejected by the base rule;
lines without a word are neither kept nor counted as loss; repeated rows are judged
alike; columns other than the text are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Phrases of boilerplate lines in lower case, of English, German, French and Spanish pages.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "copyright ©",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "todos los derechos reservados",
    "política de privacidad",
    "términos de uso",
)
#: The limits of the line rules.
SYMBOLS_PER_WORD = 0.5
SHOUTS_PER_WORD = 0.5
SEPARATORS_PER_WORD = 0.2
LEAST_DISTINCT = 0.25
REPEAT_FROM = 12
BOILERPLATE_CHARS = 200
NO_PUNCTUATION_FROM = 30
MAX_LOSS = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule of the three kinds.

    Punctuation: symbols or exclamation marks for half of its words or more, or 30
    words and no punctuation mark. Navigation: a menu, that is separators between
    its words, or at least twelve words of which under a quarter are distinct.
    Boilerplate: a known phrase in a line of up to 200 characters.
    """
    words = _words(line)
    n = F.size(words)
    punctuation = (F.regexp_count(line, F.lit(r"[#*$%&<>]")) >= SYMBOLS_PER_WORD * n) | (F.regexp_count(line, F.lit("!")) >= SHOUTS_PER_WORD * n) | ((n >= NO_PUNCTUATION_FROM) & ~line.rlike(r"[.,;:!?]"))
    navigation = (F.regexp_count(line, F.lit(r"[|»›]")) >= F.greatest(F.lit(2.0), SEPARATORS_PER_WORD * n)) | ((n >= REPEAT_FROM) & (F.size(F.array_distinct(words)) < LEAST_DISTINCT * n))
    boilerplate = (F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike("|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def _non_white(c: Column) -> Column:
    return F.length(c) - F.regexp_count(c, F.lit(r"[\x20\x09-\x0D]"))


def judged(docs: DataFrame, text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with ``ox_*`` columns: the counts, ``ox_base_failed``, ``ox_kept`` and
    ``ox_text``: the text without failing lines, unchanged where none fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.withColumns({"ox_words": _words(text), "ox_lines": F.split(text, "\n", -1)})
    hashes = F.transform(F.col("ox_words"), lambda w: F.xxhash64(w))
    a = a.withColumn("ox_h", hashes)
    windows = F.when(
        F.size("ox_h") >= WINDOW,
        F.transform(F.slice("ox_h", F.lit(1), F.size("ox_h") - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(F.col("ox_h"), i + k) for k in range(1, WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumn("ox_windows", windows)
    # Sorted (hash, place): a window repeats if a neighbour has its hash. Then words covered, in order of place.
    ordered = F.array_sort(F.transform(F.col("ox_windows"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    a = a.withColumn("ox_sorted", F.when(F.size(F.array_distinct("ox_windows")) < F.size("ox_windows"), ordered))
    same = lambda x, i, d: F.coalesce(F.get(F.col("ox_sorted"), i + d)["h"] == x["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(F.col("ox_sorted"), lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1))), lambda x: x["i"]))
    a = a.withColumn("ox_places", places)
    covered = F.aggregate(
        F.transform(F.col("ox_places"), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("ox_places"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    worded = F.filter(F.col("ox_lines"), lambda x: x.rlike(WORD))
    a = a.withColumn("ox_worded", worded)
    good = F.filter(F.col("ox_worded"), lambda x: ~line_fails(x))
    a = a.withColumn("ox_good", good)
    n = F.size("ox_words").cast("long")
    chars = F.aggregate(F.col("ox_words"), F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))
    found = F.struct(
        n.alias("ox_n_words"),
        chars.alias("ox_word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("ox_n_symbols"),
        (F.size("ox_worded") - F.size(F.array_distinct("ox_worded"))).cast("long").alias("ox_n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("ox_n_repeat_words"),
        F.when(F.size("ox_good") == F.size("ox_worded"), text).otherwise(F.array_join("ox_good", "\n")).alias("ox_text"),
    )
    # Generated, not projected: a filter on the verdict would else be rewritten in terms of the text, all steps repeated.
    a = a.select(*[docs[c] for c in docs.columns], F.explode(F.array(found)).alias("ox_found")).select(*[docs[c] for c in docs.columns], "ox_found.*")
    failed = (F.col("ox_n_words") < MIN_WORDS) | (100 * F.col("ox_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("ox_n_words"))
    a = a.withColumn("ox_base_failed", failed)
    enough = _non_white(F.col("ox_text")) >= (1 - max_loss) * F.col("ox_word_chars")
    return a.withColumn("ox_kept", ~F.col("ox_base_failed") & enough)
