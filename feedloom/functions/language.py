"""Language detection by stop-word counts, one projection and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import as_column

# Frequent function words per language. Ties go to the language named first.
PROFILES: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with",
           "be", "by", "as", "this", "are", "at", "from"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est",
           "qui", "par", "dans", "sur", "au", "pas", "avec"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "auf", "des",
           "für", "ist", "nicht", "dem", "im", "ein", "als", "eine"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no",
           "con", "su", "una", "es", "para", "al", "lo"),
    "ru": ("и", "в", "не", "на", "что", "с", "по", "это", "как", "к", "из", "за", "от", "для",
           "но", "его", "или", "бы", "уже", "так"),
}
WORD_BREAK = r"[^\p{L}]+"


def detect_language(col: Column | str) -> Column:
    """Language with most stop words; NULL for blank text or when none occurs.

    ``transform`` over a one-element array serves as a local binding, so the
    text is split once and only its stop words are counted per language.
    """
    known = sorted({w for words in PROFILES.values() for w in words})

    def count(hits: Column, words: tuple[str, ...]) -> Column:
        return F.size(F.filter(hits, lambda w: w.isin(list(words))))

    def best(counts: Column) -> Column:
        place = F.array_position(counts, F.array_max(counts)).cast("int")
        return F.when(F.array_max(counts) > 0, F.element_at(F.array(*map(F.lit, PROFILES)), place))

    def pick(hits: Column) -> Column:
        counts = F.array(*[count(hits, words) for words in PROFILES.values()])
        return F.transform(F.array(counts), best)[0]

    words = F.split(F.lower(as_column(col)), WORD_BREAK)
    return F.transform(F.array(F.filter(words, lambda w: w.isin(known))), pick)[0]
