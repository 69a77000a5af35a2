"""What a question asks for: a language heuristic, and the parsing of a model's structured reply."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import blank_to_null, strip
from lodestone.schemas import UNDERSTANDING

#: Words that mark Urdu in Latin letters.
ROMAN_URDU = (
    "kya", "hai", "nahi", "kaise", "kahan", "mera", "apka", "problem", "masla", "theek", "nhi", "kr", "rha", "rhi", "gya", "gyi", "ho", "chahiye",
    "bataen", "btao", "krna", "kro", "krain", "kren", "kia", "kesy", "kesay", "kidhar", "kab", "q", "kyun", "kyon", "nhe", "nh", "ni", "mushkil",
    "kharab", "tut", "garmi", "sardi", "chalu", "band", "on", "off", "horha", "horhi",
)


def is_roman_urdu(text: Column) -> Column:
    """At least two different words of the list."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z]+\b"), F.lit(0)))
    return F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in ROMAN_URDU]))) >= 2


def strip_fence(reply: Column) -> Column:
    s = strip(reply)
    inner = F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(s, F.lit("```")), inner).otherwise(s)


def understanding(question: Column, reply: Column) -> Column:
    """A struct of the reply's fields, sanitised; the fallback row (language Unknown, confidence 1.0) if the reply is no object.

    A missing list and a null list are both empty; a blank translation is the question; codes lose all whitespace, models the outer; the
    heuristic overrides the reply where it fires.
    """
    cleaned = strip_fence(reply)
    d = F.from_json(cleaned, UNDERSTANDING)
    # an object that parses: otherwise no field can be read from it
    sound = F.coalesce(F.rlike(cleaned, F.lit(r"(?s)^\s*\{.*\}\s*$")) & F.get_json_object(cleaned, "$").isNotNull(), F.lit(False))
    roman = is_roman_urdu(question)
    told = F.coalesce(d["is_roman_urdu"], F.lit(False))
    override = roman & ~told
    language = F.coalesce(d["language"], F.lit("Unknown"))
    none = F.array().cast("array<string>")

    def cleaned_list(field: str, each: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(F.coalesce(d[field], none), each), lambda x: x != "")

    def value(given: Column, fallback: Column) -> Column:
        return F.when(sound, given).otherwise(fallback)

    return F.struct(
        question.alias("original_query"),
        value(F.when(blank_to_null(strip(d["translated_query"])).isNotNull(), d["translated_query"]).otherwise(question), question).alias("translated_query"),
        value(
            F.when(override & ~F.lower(F.coalesce(d["language"], F.lit(""))).isin("roman urdu", "urdu"), F.lit("Roman Urdu")).otherwise(language), F.lit("Unknown")
        ).alias("language"),
        value(told | roman, roman).alias("is_roman_urdu"),
        value(cleaned_list("error_codes", lambda x: F.upper(F.regexp_replace(x, r"(?U)\s+", ""))), none).alias("error_codes"),
        value(cleaned_list("model_names", lambda x: strip(F.upper(x))), none).alias("model_names"),
        value(F.coalesce(d["intent"], F.lit("general")), F.lit("general")).alias("intent"),
        F.when(sound, blank_to_null(d["product_category"])).alias("product_category"),
        value(F.coalesce(d["confidence"], F.lit(0.8)), F.lit(1.0)).alias("confidence"),
    )


# --- calls to models: on the driver, injected, never inside a plan ---------------------------------------------------------------


def moves_on(message: str) -> bool:
    """Whether an error says that another model should be tried rather than the same again."""
    low = message.lower()
    return any(mark in low for mark in ("429", "quota", "rate", "resource_exhausted", "404", "not found", "not_found"))


def call_with_fallback(
    models: Sequence[Callable[[str], str]], text: str, attempts: int = 2, delay: float = 1.0, grow: bool = False, sleep: Callable[[float], None] = time.sleep
) -> str:
    """The first reply that is not empty. Each model gets ``attempts``; a rate limit or a missing model goes to the next at once."""
    last: Exception | None = None
    for model in models:
        for attempt in range(1, attempts + 1):
            try:
                reply = model(text)
                if reply and reply.strip():
                    return reply
                raise ValueError("empty reply")
            except Exception as e:  # noqa: BLE001 - whatever a model raises
                last = e
                if moves_on(str(e)):
                    break
                if attempt < attempts:
                    sleep(delay * attempt if grow else delay)
    raise RuntimeError(f"all models failed: {last}")
