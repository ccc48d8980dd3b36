"""A model endpoint behind the two usual HTTP interfaces, as a factory for `operators.generate`."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

DEFAULT_BASE = "https://api.openai.com/v1"
SYSTEM = "You write Python. Answer with one fenced code block and nothing else."


def endpoint(base_url: str | None) -> str:
    """The given address, else OPENAI_BASE_URL, else the default."""
    return (base_url or os.environ.get("OPENAI_BASE_URL") or DEFAULT_BASE).rstrip("/")


def http_client(model: str, api_kind: str = "chat", base_url: str | None = None, api_key_env: str = "OPENAI_API_KEY", temperature: float = 0.2, max_tokens: int = 2048, timeout: float = 120.0, system: str = SYSTEM) -> Callable[[], Callable[[str], str]]:
    """A factory of clients, one for each partition. A missing key counts as EMPTY; an empty answer is an error.

    The answer is the stripped text of the first choice (chat) or of all text parts (responses).
    """
    if api_kind not in ("chat", "responses"):
        raise ValueError(f"unknown interface: {api_kind}")

    def body(prompt: str) -> dict:
        if api_kind == "chat":
            return {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
        return {"model": model, "instructions": system, "input": prompt, "max_output_tokens": max_tokens}

    def text(answer: dict) -> str:
        if api_kind == "chat":
            return answer["choices"][0]["message"]["content"] or ""
        return "".join(p.get("text") or "" for item in answer.get("output") or [] for p in item.get("content") or [] if p.get("type") == "output_text")

    def factory() -> Callable[[str], str]:
        url = endpoint(base_url) + ("/chat/completions" if api_kind == "chat" else "/responses")
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(api_key_env) or 'EMPTY'}"}

        def client(prompt: str) -> str:
            request = urllib.request.Request(url, json.dumps(body(prompt)).encode(), headers)
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                found = text(json.load(reply)).strip()
            if not found:
                raise ValueError("empty model response")
            return found

        return client

    return factory
