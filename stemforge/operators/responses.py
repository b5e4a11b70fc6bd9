"""From raw model replies to validated questions; built-in expressions on VARIANT values."""

from __future__ import annotations

import math
import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions.text import strip
from stemforge.operators.report import BLOOM_LEVELS, DIFFICULTIES, QTYPES

FIELDS = ("id", "chapter", "section", "qtype", "bloom_level", "difficulty", "stem", "options", "answer", "explanation", "source_ref")
_FENCE = "```"
#: The rules that an item must keep: least lengths of the texts that must be there, values of the enumerations, and fields that may be null or absent.
LEAST_LENGTH = {"stem": 10, "answer": 1, "explanation": 10, "source_ref": 0}
DOMAINS = {"qtype": QTYPES, "bloom_level": BLOOM_LEVELS, "difficulty": DIFFICULTIES}
MAY_BE_NULL, MAY_BE_ABSENT = ("section", "options"), ("id",)
#: Integers as text that count as a chapter: blanks around and a zero fraction are allowed.
_INTEGER = r"(?U)^\s*[+-]?\d+(\.0*)?\s*$"
_PYTHON_INTEGER = _INTEGER.removeprefix("(?U)")


def strip_fences(reply: Column) -> Column:
    """The reply without a leading fence line and without what follows the last fence."""
    bare = strip(reply)
    inner = F.when(F.contains(bare, F.lit("\n")), F.substr(bare, F.locate("\n", bare) + 1)).otherwise(F.substr(bare, F.lit(4)))
    tail = F.substring_index(inner, _FENCE, -1)
    kept = F.when(F.contains(inner, F.lit(_FENCE)), F.left(inner, F.length(inner) - F.length(tail) - 3)).otherwise(inner)
    return F.when(bare.startswith(_FENCE), strip(kept)).otherwise(bare)


def normalise(reply: Column) -> Column:
    """The items of a parsed reply as ``array<variant>``; null where an attempt fails.

    An object holds them under ``questions`` (none if that is missing), an array is them. Other payloads,
    and a ``questions`` that is no array, fail.
    """
    kind = F.schema_of_variant(reply)
    held = F.try_variant_get(reply, "$.questions", "array<variant>")
    absent = ~F.coalesce(F.array_contains(F.json_object_keys(F.to_json(reply)), "questions"), F.lit(False))
    none = F.array().cast("array<variant>")
    return F.when(kind.startswith("OBJECT"), F.when(absent, none).otherwise(held)).when(kind.startswith("ARRAY"), F.try_variant_get(reply, "$", "array<variant>"))


def _chapter(kind: Column, text: Column, number: Column) -> Column:
    """Lax integer: integers, whole decimals, such numbers as text, and true."""
    whole = F.when(number == F.floor(number), number.try_cast("int"))
    return (
        F.when(kind == "STRING", F.when(text.rlike(_INTEGER), strip(text).try_cast("double").try_cast("int")))
        .when(kind == "BOOLEAN", (text == "true").cast("int"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), whole)
    )


def whole_number(value: object) -> int | None:
    """The same for a value of Python: integers, whole finite decimals, such numbers as text, and true; within 32 bits."""
    if isinstance(value, str):
        value = float(value) if re.match(_PYTHON_INTEGER, value) else None
    if not isinstance(value, (int, float)) or not math.isfinite(value) or value != int(value):
        return None
    return int(value) if -(2**31) <= value < 2**31 else None


def is_valid(item: object, filled: Collection[str] = ()) -> bool:
    """Whether a parsed item would pass :func:`validate_items` where ``filled`` fields have sound defaults; by the same rules."""
    if not isinstance(item, dict):
        return False
    texts = all((f in filled and f not in item) or isinstance(item.get(f), str) and len(item[f]) >= n for f, n in LEAST_LENGTH.items())
    domains = all(isinstance(item.get(f), str) and item[f] in values for f, values in DOMAINS.items())
    options, section = item.get("options"), item.get("section")
    chapter = whole_number(item["chapter"]) if "chapter" in item else 1 if "chapter" in filled else None
    return (
        texts and domains and chapter is not None and chapter >= 1 and ("id" not in item or isinstance(item["id"], str))
        and (section is None or isinstance(section, str)) and (options is None or isinstance(options, list) and all(isinstance(o, str) for o in options))
    )


def parse_replies(replies: DataFrame, reply: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``is_parsed``, ``items`` (array<variant>, null if the attempt fails) and ``n_items``.

    Only an object or array is a payload, and the reply must begin and end as one: the parser itself
    would stop behind the first value. Of repeated keys in one object none is chosen, it does not parse.
    """
    rows = replies.select(*keep, strip_fences(F.col(reply)).alias("_b"))
    rows = rows.select(*keep, F.when(F.col("_b").rlike(r"(?s)^(\{.*\}|\[.*\])\z"), F.try_parse_json("_b")).alias("_v"))
    rows = rows.select(*keep, F.col("_v").isNotNull().alias("is_parsed"), normalise(F.col("_v")).alias("items"))
    return rows.withColumn("n_items", F.when(F.col("items").isNull(), F.lit(-1)).otherwise(F.size("items")))


def item_fields(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per item: ``keep``, ``pos``, its keys, and the kind and text of every field."""
    # outer, then filtered: else the optimizer repeats the whole parsing in a filter before the explode
    rows = parsed.select(*[F.col(c) for c in parsed.columns if c != "items"], F.posexplode_outer("items").alias("pos", "v")).where("pos is not null")
    rows = rows.withColumn("_keys", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.coalesce(F.json_object_keys(F.to_json("v")), F.array().cast("array<string>"))))
    # the kind and text of every field become columns first; the rules then are short
    v = F.col("v")
    kinds = [F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")).alias(f"_k_{f}") for f in FIELDS]
    texts = [F.try_variant_get(v, f"$.{f}", "string").alias(f"_t_{f}") for f in FIELDS if f != "options"]
    options = F.try_variant_get(v, "$.options", "array<variant>")
    listed = [F.try_variant_get(v, "$.options", "array<string>").alias("_t_options"), F.forall(options, lambda o: F.schema_of_variant(o) == "STRING").alias("_all_text"), F.try_variant_get(v, "$.chapter", "double").alias("_number")]
    return rows.select(*keep, "pos", "_keys", *kinds, *texts, *listed)


def validate_items(parsed: DataFrame, keep: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """One row per item: ``keep``, ``pos``, the fields, and ``reject_reasons`` (empty for a valid item).

    A default fills a key that is absent, not one that is null. Unknown keys are dropped, items that are
    no object are rejected as ``item``. Whitespace counts towards lengths.
    """
    return apply_rules(item_fields(parsed, keep), keep, defaults)


def apply_rules(rows: DataFrame, keep: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """What :func:`validate_items` gives, from the result of :func:`item_fields`."""
    defaults = defaults or {}
    kind, value = {f: F.col(f"_k_{f}") for f in FIELDS}, {f: F.col(f"_t_{f}") for f in FIELDS}
    value["chapter"] = _chapter(kind["chapter"], value["chapter"], F.col("_number"))
    rows = rows.withColumn("_chapter", value["chapter"])
    value["chapter"] = F.col("_chapter")
    absent = lambda f: ~F.array_contains("_keys", f)
    null = lambda f: kind[f].isNull() | (kind[f] == "VOID")
    sound = {f: kind[f] == "STRING" for f in FIELDS}
    sound |= {f: sound[f] & value[f].isin(*values) for f, values in DOMAINS.items()}
    sound |= {f: sound[f] & (F.length(value[f]) >= n) for f, n in LEAST_LENGTH.items()}
    sound |= {"options": F.col("_all_text"), "chapter": value["chapter"] >= 1}
    sound |= {f: null(f) | sound[f] for f in MAY_BE_NULL} | {f: absent(f) | sound[f] for f in MAY_BE_ABSENT}
    for f, default in defaults.items():
        value[f] = F.when(absent(f), default).otherwise(value[f])
        filled = F.coalesce(default >= 1, F.lit(False)) if f == "chapter" else default.isNotNull() | F.lit(f == "section")
        sound[f] = F.when(absent(f), filled).otherwise(sound[f])
    reasons = F.filter(F.array(*[F.when(~F.coalesce(sound[f], F.lit(False)), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    reasons = F.when(F.col("_keys").isNull(), F.array(F.lit("item"))).otherwise(reasons)
    return rows.select(*keep, "pos", *[value[f].alias(f) for f in FIELDS], reasons.alias("reject_reasons"))
