"""An OpenAI-compatible endpoint: chat completions and embeddings over HTTP, called from the tasks."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from stemforge.config import Settings

#: Tokens of a reply: of a call by itself, and of a call that writes questions.
REPLY_TOKENS, QUESTION_TOKENS = 2048, 4096
#: Texts of one call for embeddings.
BATCH = 64


def _post(settings: Settings, path: str, body: dict) -> dict:
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {settings.api_key}"}
    request = urllib.request.Request(settings.base_url.rstrip("/") + path, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=600) as reply:
        return json.load(reply)


def chat(settings: Settings, messages: list[dict], json_mode: bool = False, temperature: float | None = None, max_tokens: int = REPLY_TOKENS, **more: object) -> str:
    """The reply to one conversation; a reply without content is empty, a missing temperature is that of the settings."""
    body = {"model": settings.model, "messages": messages, "temperature": settings.temperature if temperature is None else temperature, "max_tokens": max_tokens} | more
    body |= {"response_format": {"type": "json_object"}} if json_mode else {}
    return _post(settings, "/chat/completions", body)["choices"][0]["message"]["content"] or ""


def transport(settings: Settings, temperature: float | None = None, max_tokens: int = QUESTION_TOKENS) -> Callable[[list[dict], bool], str]:
    """:func:`chat` as the transport of :func:`stemforge.operators.generation.generate`."""
    return lambda messages, json_mode: chat(settings, messages, json_mode, temperature, max_tokens)


def embedder(settings: Settings) -> Callable[[list[str]], list[list[float]]]:
    """The endpoint's embedding model as the model of :func:`stemforge.operators.retrieval.embed`."""

    def vectors(texts: list[str]) -> list[list[float]]:
        held = [_post(settings, "/embeddings", {"model": settings.embedding_model, "input": texts[i : i + BATCH]})["data"] for i in range(0, len(texts), BATCH)]
        return [row["embedding"] for batch in held for row in sorted(batch, key=lambda r: r["index"])]

    return vectors
