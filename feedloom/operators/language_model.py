"""A language detector learned from labelled texts: naive Bayes over the character n-grams of words.

Words are lower-cased runs of letters between two spaces; their runs of three characters are the features. The
profiles are counted in Spark on a bounded sample (``sample_rows`` texts of each language, those of the least hashes) and
hold the ``most_grams`` most frequent n-grams, so they are small enough to be broadcast. A text's score for a language is
the sum of its n-grams' log probabilities; a text is exploded, weighed and summed inside one task, and only one row for each
text is shuffled.

Defined results: null and blank texts and texts without letters have no language and no score; equal scores go to the
language named first in the alphabet; rows are told apart by ``key``, and the texts of rows with equal keys are one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.language import WORD_BREAK
from feedloom.functions.text import as_column
from feedloom.operators.ranking import top_k_per_group
from feedloom.session import staged

SIZES = (3,)
SAMPLE_ROWS = 2_000
MOST_GRAMS = 50_000


@dataclass(frozen=True)
class LanguageModel:
    """``profile`` (gram, weights): a log probability for each language; ``unseen``: those of any other n-gram."""

    languages: tuple[str, ...]
    profile: DataFrame
    unseen: tuple[float, ...]


def words(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(as_column(text), F.lit(""))), WORD_BREAK), lambda w: w != "")


def _grams(padded: Column, n: int) -> Column:
    last = F.length(padded) - n + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(last >= 1, each).otherwise(F.array().cast("array<string>"))


def exploded(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, gram): a row for each n-gram, and one without for a text that has none."""
    each = rows.select(*keep, F.explode_outer(words(text)).alias("_word")).withColumn("_word", F.concat(F.lit(" "), "_word", F.lit(" ")))
    grams = F.concat(*[_grams(F.col("_word"), n) for n in SIZES])
    return each.select(*keep, F.explode_outer(F.when(F.col("_word").isNotNull(), grams)).alias("gram"))


def fit_language_model(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, most_grams: int = MOST_GRAMS, least_count: int = 2
) -> LanguageModel:
    """A model of the languages of docs; rows without a language teach nothing."""
    order = [F.md5(F.col(key).cast("string")), F.col(key)]
    # The draw is by key alone; only the drawn rows' texts move.
    drawn = top_k_per_group(docs.filter(F.col(lang).isNotNull()).select(key, lang), [lang], order, sample_rows).select(key)
    sample = docs.filter(F.col(lang).isNotNull()).join(F.broadcast(drawn), key).select(lang, text)
    counts = staged(exploded(sample, text, lang).filter("gram IS NOT NULL").groupBy(F.col(lang).alias("lang"), "gram").agg(F.count("*").alias("n")), "grams")
    languages = tuple(sorted(r[0] for r in counts.select("lang").distinct().collect()))
    kept = counts.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count).orderBy(F.desc("n"), "gram").limit(most_grams)
    kept = staged(kept.select("gram"), "kept-grams")
    own = counts.join(F.broadcast(kept), "gram")
    size = kept.count()
    total = {r.lang: r.n for r in own.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    weights = [F.log((F.coalesce(F.max(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)) + 1) / F.lit(float(total.get(name, 0) + size))) for name in languages]
    profile = own.groupBy("gram").agg(F.array(*weights).alias("weights")) if languages else own.select("gram", F.array().cast("array<double>").alias("weights"))
    unseen = tuple(math.log(1 / (total.get(name, 0) + size)) if total.get(name, 0) + size else 0.0 for name in languages)
    return LanguageModel(languages, staged(profile, "profile"), unseen)


def detect_languages(docs: DataFrame, model: LanguageModel, key: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(key, detected, score): the likeliest language of each text, and the mean log probability of its n-grams in it."""
    keys = list(key)
    if not model.languages:
        return docs.select(*keys, F.lit(None).cast("string").alias("detected"), F.lit(None).cast("double").alias("score")).dropDuplicates(keys)
    # At most ``most_grams`` rows, whatever the corpus.
    weighed = exploded(docs, text, *keys).join(F.broadcast(model.profile), "gram", "left")
    sums = [F.sum(F.when(F.col("gram").isNotNull(), F.coalesce(F.col("weights")[i], F.lit(u)))).alias(f"_s{i}") for i, u in enumerate(model.unseen)]
    scored = weighed.groupBy(*keys).agg(F.count("gram").alias("_n"), *sums)
    all_scores = F.array(*[F.col(f"_s{i}") for i in range(len(sums))])
    best = F.array_max(all_scores)
    name = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position(all_scores, best).cast("int"))
    found = F.col("_n") > 0
    return scored.select(*keys, F.when(found, name).alias("detected"), F.when(found, best / F.col("_n")).alias("score"))
