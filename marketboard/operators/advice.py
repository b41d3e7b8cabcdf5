"""Advice texts: prompt, template answer and language routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketboard.config import LANGUAGE_CODES, PROTECTED_TERMS, SPEECH_MAX_CHARS
from marketboard.functions.numbers import fixed
from marketboard.functions.text import masking, restore_terms, speech_text, template

# ---- fixed values: wording of the prompt and of the template answer ---------------------------
SYSTEM_PROMPT = (
    "You are {persona}, an agricultural advisor for Indian smallholder farmers. "
    "Give clear, concise advice based on the price data and government advisory provided. "
    "Cite the specific advisory source at the end. "
    "Keep the response under 100 words. Do not use markdown formatting."
)
USER_PROMPT = """Crop: {crop}
Mandi (home): {mandi}
Today's price: ₹{price}/quintal
7-day price change: {change}%
Price trend: {trend}
Weather forecast: {weather}
Verdict: {decision} (confidence: {confidence})
Reason: {reason}

Government Advisory Context:
{context}

Write a farmer-friendly recommendation in plain English (2-3 sentences). \
End with: "Source: [advisory name]\""""
ANSWER = (
    "{decision}: {reason} Today's price at {mandi} is ₹{price}/quintal ({change}% vs last week)."
)


def _fields() -> dict:
    return {
        "crop": F.col("crop"),
        "mandi": F.col("mandi"),
        "price": fixed(F.col("modal_price"), 0),
        "change": fixed(F.col("pct_change_7d"), 1, signed=True),
        "trend": F.col("trend"),
        "weather": F.col("description"),
        "decision": F.col("decision"),
        "confidence": F.col("confidence"),
        "reason": F.col("reason_en"),
        "context": F.coalesce("context", F.lit("")),
    }


def with_prompts(verdicts: DataFrame, persona: str = "Market Board") -> DataFrame:
    """Add system_prompt and user_prompt to flat verdict rows with a context column."""
    return verdicts.withColumns(
        {
            "system_prompt": F.lit(SYSTEM_PROMPT.replace("{persona}", persona)),
            "user_prompt": template(USER_PROMPT, _fields()),
        }
    )


def with_recommendation(verdicts: DataFrame) -> DataFrame:
    """Add the template answer to flat verdict rows."""
    fields = {k: v for k, v in _fields().items() if k != "context"}
    return verdicts.withColumn("recommendation", template(ANSWER, fields))


def language_table(spark, codes: Mapping[str, str] = LANGUAGE_CODES) -> DataFrame:
    return spark.createDataFrame(list(codes.items()), "language string, language_code string")


def with_mask(
    rows: DataFrame, text: str = "text", terms: Sequence[str] = PROTECTED_TERMS
) -> DataFrame:
    """Add the masking of a text column as struct column mask."""
    return rows.withColumn("mask", masking(F.col(text), terms))


def in_languages(rows: DataFrame, languages: Sequence[str]) -> DataFrame:
    """One row per wanted language, the list being the caller's literal."""
    return rows.withColumn("language", F.explode(F.array(*[F.lit(x) for x in languages])))


def route_language(
    rows: DataFrame,
    text: str = "text",
    language: str = "language",
    codes: Mapping[str, str] = LANGUAGE_CODES,
    terms: Sequence[str] = PROTECTED_TERMS,
    home: str = "English",
    speech_chars: int = SPEECH_MAX_CHARS,
) -> DataFrame:
    """Prepare texts for a translation service.

    Adds language_code, needs_translation, source_text (masked if it is to be translated), the map
    placeholders that restores it, and speech_source. The home language and unknown ones pass
    through unchanged. Mask a text before it is multiplied by languages (with_mask), and it is
    masked once; rows without a mask get one here. The language table is a literal of nine rows,
    hence the broadcast.
    """
    if "mask" not in rows.columns:
        rows = with_mask(rows, text, terms)
    table = language_table(rows.sparkSession, codes).withColumnRenamed("language", language)
    routed = rows.join(F.broadcast(table), language, "left")
    foreign = F.col("language_code").isNotNull() & (F.col(language) != home)
    original = F.col(text)
    return routed.withColumns(
        {
            "needs_translation": foreign,
            "source_text": F.when(foreign, F.col("mask.masked")).otherwise(original),
            "placeholders": F.when(foreign, F.map_from_entries("mask.found")),
            "speech_source": speech_text(original, speech_chars),
        }
    ).drop("mask")


# ---- several texts of a row through one route ---------------------------------------------------

# translate(texts, language_code) -> as many texts
Translator = Callable[[list[str], str], Sequence[str | None]]


def mask_texts(rows: DataFrame, texts: Sequence[str], terms: Sequence[str] = PROTECTED_TERMS) -> DataFrame:
    """Add the masking of several text columns as a map from column name to struct(masked, found)."""
    entries = [x for t in texts for x in (F.lit(t), masking(F.col(t), terms))]
    return rows.withColumn("masks", F.create_map(*entries))


def translated(text: Column, code: Column, make_translator: Callable[[], Translator], batch_texts: int = 64) -> Column:
    """Texts translated in batches of one language; NULL for a NULL text and for one whose translation failed.

    make_translator runs once in a task and may load a model or open a session there. If a batch fails (an exception,
    or another number of texts), its halves are tried, so that one bad text costs the others nothing. If no
    translator can be made, all fail. Nested, so tasks get it by value.
    """

    def attempt(translate: Translator, texts: list[str], language: str) -> list[str | None]:
        try:
            got = list(translate(texts, language))
            if len(got) == len(texts):
                return got
        except Exception:  # noqa: BLE001 - whatever a service raises, the original text stands
            pass
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return attempt(translate, texts[:half], language) + attempt(translate, texts[half:], language)

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            translate = make_translator()
        except Exception:  # noqa: BLE001
            translate = None
        for texts, codes in batches:
            out: list[str | None] = [None] * len(texts)
            asked: dict[str, list[int]] = {}
            for i, (t, c) in enumerate(zip(texts, codes, strict=True)):
                if translate is not None and t is not None and c is not None:
                    asked.setdefault(c, []).append(i)
            for language, places in asked.items():
                for begin in range(0, len(places), batch_texts):
                    some = places[begin : begin + batch_texts]
                    for i, got in zip(some, attempt(translate, [texts.iloc[j] for j in some], language), strict=True):
                        out[i] = got
            yield pd.Series(out, dtype=object)

    return run(text, code)


def route_texts(
    rows: DataFrame,
    texts: Sequence[str],
    language: str = "language",
    codes: Mapping[str, str] = LANGUAGE_CODES,
    terms: Sequence[str] = PROTECTED_TERMS,
    home: str = "English",
    make_translator: Callable[[], Translator] | None = None,
    batch_texts: int = 64,
) -> DataFrame:
    """Send several text columns of each row through translation, terms protected.

    Adds language_code, needs_translation and maps from column name: sources (what a translator gets: masked if it is to
    translate), placeholders (what restores it), texts (the final text) and translated (whether a translation
    came). The home language and unknown ones pass through. A translation that fails gives the original text. Without
    make_translator nothing is translated yet: texts holds NULL where it should be, and restored_texts finishes answers from
    elsewhere. Mask before a row is multiplied by languages (mask_texts), and it is done once.
    """
    if "masks" not in rows.columns:
        rows = mask_texts(rows, texts, terms)
    table = language_table(rows.sparkSession, codes).withColumnRenamed("language", language)
    routed = rows.join(F.broadcast(table), language, "left")
    foreign = F.col("language_code").isNotNull() & (F.col(language) != home)

    def each(value: Callable[[str], Column]) -> Column:
        return F.create_map(*[x for t in texts for x in (F.lit(t), value(t))])

    routed = routed.withColumns(
        {
            "needs_translation": foreign,
            "sources": each(lambda t: F.when(foreign, F.col("masks")[t]["masked"]).otherwise(F.col(t))),
            "placeholders": each(lambda t: F.when(foreign, F.map_from_entries(F.col("masks")[t]["found"]))),
        }
    ).drop("masks")
    if make_translator is None:
        answers = F.lit(None).cast("map<string,string>")
    else:
        asked = F.when(F.col("needs_translation"), F.col("language_code"))
        answers = each(lambda t: translated(F.col("sources")[t], asked, make_translator, batch_texts))
    return restored_texts(routed.withColumn("_answers", answers), texts, "_answers", terms, make_translator is not None)


def restored_texts(
    rows: DataFrame, texts: Sequence[str], answers: str, terms: Sequence[str] = PROTECTED_TERMS, finished: bool = True
) -> DataFrame:
    """Put the terms back into answers (a map from column name to translated text, consumed) of routed rows.

    A text that has no answer is the original, or NULL if it still waits for one (finished=False).
    """

    def final(t: str) -> Column:
        got = restore_terms(F.col(answers)[t], terms, F.col("placeholders")[t])
        waits = F.col("needs_translation") & ~F.lit(finished)
        return F.when(F.col("needs_translation") & got.isNotNull(), got).when(~waits, F.col(t))

    told = [x for t in texts for x in (F.lit(t), F.col("needs_translation") & F.coalesce(F.col(answers)[t].isNotNull(), F.lit(False)))]
    named = [x for t in texts for x in (F.lit(t), final(t))]
    return rows.withColumns({"texts": F.create_map(*named), "translated": F.create_map(*told)}).drop(answers)
