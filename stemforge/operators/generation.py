"""Calling a model for each prompt, with retries, through an injected transport."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.operators.responses import is_valid
from stemforge.session import written

#: transport(messages, json_mode) -> reply text
Transport = Callable[[list[dict], bool], str]


def bare_reply(reply: str) -> str:
    text = reply.strip()
    if text.startswith("```"):
        text = text.partition("\n")[2] if "\n" in text else text[3:]
        text = (text.rpartition("```")[0] if "```" in text else text).strip()
    return text


def ask(transport: Transport, messages: list[dict], attempts: int, filled: set[str], pause: float) -> tuple[str | None, int, str]:
    """(reply, attempts made, status) of one prompt: the first reply with a valid item, else ``failed``.

    Each attempt tries JSON mode first and plain text after any error. An error pauses before the next
    attempt; a reply without a valid item does not.
    """
    for attempt in range(1, attempts + 1):
        try:
            try:
                reply = transport(messages, True)
            except Exception:
                reply = transport(messages, False)
            payload = json.loads(bare_reply(reply or ""))
            items = payload.get("questions", []) if isinstance(payload, dict) else payload
            if isinstance(items, list) and any(is_valid(i, filled) for i in items):
                return reply, attempt, "ok"
        except Exception:
            if attempt < attempts:
                time.sleep(pause)
    return None, attempts, "failed"


def ask_structured(transport: Transport, messages: list[dict], sound: Callable[[object], bool]) -> object:
    """The parsed payload of one call, JSON mode first; an error if it is not ``sound`` as a whole."""
    try:
        reply = transport(messages, True)
    except Exception:
        reply = transport(messages, False)
    payload = json.loads(bare_reply(reply or ""))
    if not sound(payload):
        raise ValueError("the reply does not have the asked structure")
    return payload


def generate(prompts: DataFrame, key: str, transport: Transport, max_attempts: int = 2, filled: tuple[str, ...] = ("source_ref", "chapter", "section"), parallel: int | None = None, pause: float = 1.0) -> DataFrame:
    """``key``, ``reply`` (null if failed), ``attempts`` and ``status`` of every prompt (column ``messages``).

    The replies are written once to the shared folder before anything reads them: calls are costly and
    answer differently each time, so nothing downstream may repeat them. ``parallel`` is the number of
    tasks that call at the same time.
    """
    kind = dict(prompts.dtypes)[key]
    spread = prompts.select(key, "messages").repartition(parallel or prompts.sparkSession.sparkContext.defaultParallelism)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [ask(transport, [m.asDict() if hasattr(m, "asDict") else dict(m) for m in ms], max_attempts, set(filled), pause) for ms in frame["messages"]]
            yield pd.DataFrame({key: frame[key], "reply": [t[0] for t in told], "attempts": pd.Series([t[1] for t in told], dtype="int32"), "status": [t[2] for t in told]})

    return written(spread.mapInPandas(call, f"{key} {kind}, reply string, attempts int, status string"), "replies")


def run_counters(replies: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """One row: prompts, answered, failed, attempts; with ``questions`` also how many there are and are not grounded.

    Counted from the rows, so a repeated task counts once. Questions without a grounding check count as
    none that failed it.
    """
    counts = replies.agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(F.col("status") == "ok").alias("n_answered"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("n_attempts"))
    if questions is None:
        return counts
    failed = F.count_if(~F.col("is_grounded")) if "is_grounded" in questions.columns else F.lit(0).cast("long")
    # one row meets one row
    return counts.join(questions.agg(F.count(F.lit(1)).alias("n_questions"), failed.alias("n_not_grounded")), F.lit(True))
