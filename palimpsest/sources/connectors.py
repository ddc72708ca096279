"""Language models over HTTP as clients of the generation: a prompt in, a text out.

One turn, no streaming, no tools. The forms are those of public interfaces: chat
completions, responses, messages, and a llama server's completions. A client counts
the tokens that its server states.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field


class HttpError(RuntimeError):
    """An answer that isn't one; status_code tells whether another try is worth it."""

    def __init__(self, status: int, body: str):
        super().__init__(f"status {status}: {body[:200]}")
        self.status_code = status


@dataclass
class Provider:
    """How to reach a model. thinking is a budget of tokens, for servers that know it."""

    kind: str
    model: str
    base_url: str
    api_key: str = ""
    max_tokens: int = 4096
    temperature: float | None = None
    thinking: int | None = None
    timeout: float = 180.0
    cache_key: str = ""


@dataclass
class Client:
    provider: Provider
    tokens_in: int = 0
    tokens_out: int = 0
    headers: dict = field(default_factory=dict)

    def _post(self, path: str, body: dict) -> dict:
        given = {"Content-Type": "application/json", **self.headers}
        request = urllib.request.Request(self.provider.base_url.rstrip("/") + path, json.dumps({k: v for k, v in body.items() if v is not None}).encode(), given)
        try:
            with urllib.request.urlopen(request, timeout=self.provider.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            raise HttpError(e.code, e.read().decode("utf-8", "replace")) from e
        except urllib.error.URLError as e:
            raise ConnectionError(str(e.reason)) from e

    def _count(self, used: dict, name_in: str, name_out: str) -> None:
        self.tokens_in += int(used.get(name_in) or 0)
        self.tokens_out += int(used.get(name_out) or 0)

    def __call__(self, prompt: str) -> str:
        raise NotImplementedError


class Chat(Client):
    def __call__(self, prompt: str) -> str:
        p = self.provider
        got = self._post("/chat/completions", {"model": p.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": p.max_tokens, "temperature": p.temperature, "prompt_cache_key": p.cache_key or None})
        self._count(got.get("usage") or {}, "prompt_tokens", "completion_tokens")
        return got["choices"][0]["message"].get("content") or ""


class Responses(Client):
    def __call__(self, prompt: str) -> str:
        p = self.provider
        got = self._post("/responses", {"model": p.model, "input": prompt, "max_output_tokens": p.max_tokens, "temperature": p.temperature, "store": False})
        self._count(got.get("usage") or {}, "input_tokens", "output_tokens")
        return "".join(c.get("text", "") for o in got.get("output", []) for c in o.get("content") or [] if c.get("type") == "output_text")


class Messages(Client):
    def __call__(self, prompt: str) -> str:
        p = self.provider
        thinking = {"type": "enabled", "budget_tokens": p.thinking} if p.thinking else {"type": "disabled"}
        got = self._post("/messages", {"model": p.model, "max_tokens": p.max_tokens + (p.thinking or 0), "messages": [{"role": "user", "content": prompt}], "thinking": thinking, "temperature": None if p.thinking else p.temperature})
        self._count(got.get("usage") or {}, "input_tokens", "output_tokens")
        return "".join(c.get("text", "") for c in got.get("content", []) if c.get("type") == "text")


class Llama(Client):
    def __call__(self, prompt: str) -> str:
        p = self.provider
        got = self._post("/completion", {"prompt": prompt, "n_predict": p.max_tokens, "temperature": p.temperature})
        self._count(got, "tokens_evaluated", "tokens_predicted")
        return got.get("content") or ""


KINDS = {"chat": Chat, "responses": Responses, "messages": Messages, "llama": Llama}


def create(provider: Provider) -> Client:
    """The client of a provider's kind."""
    if provider.kind not in KINDS:
        raise ValueError(f"unknown kind of provider {provider.kind!r}, not one of {sorted(KINDS)}")
    headers = {} if not provider.api_key else {"x-api-key": provider.api_key, "anthropic-version": "2023-06-01"} if provider.kind == "messages" else {"Authorization": f"Bearer {provider.api_key}"}
    return KINDS[provider.kind](provider, headers=headers)
