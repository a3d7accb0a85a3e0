"""Prompts for the classifier and strict validation of its JSON answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import as_column
from feedloom.schemas import CLASSIFICATION, IMPACTS, SENTIMENTS, STANCES, STRINGS

# The wording of the conversation with the classifier.
SYSTEM_PROMPT = (
    "You are an analyst who labels crypto and macro news. Respond ONLY with JSON that strictly\n"
    "matches the provided schema. Do not add commentary."
)
USER_PROMPT_HEAD = 'Analyze the following post and classify it according to the schema:\n\nText:\n"""\n'
USER_PROMPT_TAIL = (
    '\n"""\n\n'
    'Return JSON with keys: topics (list of "crypto", "macro", "regulation", "markets" as applicable),\n'
    'sentiment (-1, 0, 1), stance ("bullish", "bearish", "neutral"), impact (0-2), tickers (list of symbols),\n'
    "and entities (list of objects with type/text)."
)
REPAIR_PROMPT = "Your previous response did not match the schema. Return valid JSON only."


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render_prompt(text: Column | str) -> Column:
    body = F.concat(F.lit(USER_PROMPT_HEAD), as_column(text), F.lit(USER_PROMPT_TAIL))
    return F.array(_message("system", F.lit(SYSTEM_PROMPT)), _message("user", body))


def render_repair_prompt(messages: Column | str) -> Column:
    return F.concat(as_column(messages), F.array(_message("user", F.lit(REPAIR_PROMPT))))


def _kind(v: Column, path: str) -> Column:
    """Type name of the value at ``path``; NULL when absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _typed(v: Column, path: str, wanted: str, allowed: tuple) -> Column:
    """Value at ``path`` if its JSON type is ``wanted`` and it is allowed, else NULL."""
    cast = "int" if wanted == "BIGINT" else "string"
    value = F.try_variant_get(v, path, cast)
    return F.when((_kind(v, path) == wanted) & value.isin(list(allowed)), value)


def _elements(v: Column, path: str) -> Column:
    """Elements of the array at ``path``; absent gives [], anything else but an array NULL."""
    found = F.try_variant_get(v, path, "array<variant>")
    return F.when(_kind(v, path).isNull(), F.array().cast("array<variant>")).otherwise(found)


def _is_string(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path) == "STRING", F.lit(False))


def _validate(v: Column, root: str) -> Column:
    topics, tickers, entities = (_elements(v, f"{root}.{k}") for k in ("topics", "tickers", "entities"))
    sentiment = _typed(v, f"{root}.sentiment", "BIGINT", SENTIMENTS)
    stance = _typed(v, f"{root}.stance", "STRING", STANCES)
    impact = _typed(v, f"{root}.impact", "BIGINT", IMPACTS)
    sound = (
        sentiment.isNotNull()
        & stance.isNotNull()
        & impact.isNotNull()
        & F.forall(topics, lambda e: _is_string(e, "$"))
        & F.forall(tickers, lambda e: _is_string(e, "$"))
        & F.forall(entities, lambda e: _is_string(e, "$.type") & _is_string(e, "$.text"))
    )

    def strings(values: Column) -> Column:
        return F.transform(values, lambda e: F.try_variant_get(e, "$", "string"))

    def entity(e: Column) -> Column:
        return F.struct(
            F.try_variant_get(e, "$.type", "string").alias("type"),
            F.try_variant_get(e, "$.text", "string").alias("text"),
        )

    return F.when(
        F.coalesce(sound, F.lit(False)),
        F.struct(
            strings(topics).alias("topics"),
            sentiment.alias("sentiment"),
            stance.alias("stance"),
            impact.alias("impact"),
            strings(tickers).alias("tickers"),
            F.transform(entities, entity).alias("entities"),
        ),
    )


def parse_classification(answer: Column | str) -> Column:
    """Answer text to a classification; any fault gives NULL for the whole record.

    The text must be one JSON value. The parser stops after the first value, so the
    text is read twice, as the element of an array and as the member of an object.
    Anything after the value would have to go on as an array and as an object.
    """
    c = as_column(answer)
    as_element = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    one_value = F.when(as_element.isNotNull(), as_member)
    return F.transform(F.array(one_value), lambda v: _validate(v, "$.v"))[0].cast(CLASSIFICATION)


def flatten_classification(classification: Column | str = "classification") -> list[Column]:
    """Item columns of a classification: lists become [], scalars NULL when it is missing."""
    c = as_column(classification)
    types = {f.name: f.dataType for f in CLASSIFICATION.fields}
    lists = [
        F.coalesce(c[k], F.array().cast(types[k])).alias(k) for k in ("tickers", "entities", "topics")
    ]
    return lists + [c[k].cast(types[k]).alias(k) for k in ("sentiment", "stance", "impact")]


def list_or_empty(col: Column | str) -> Column:
    return F.coalesce(as_column(col), F.array().cast(STRINGS))
