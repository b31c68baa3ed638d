"""A translation backend over HTTP; tests use plain functions in its place."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class ChatBackend:
    """POSTs chat messages to an endpoint that answers {"message": {"content": ...}}."""

    url: str
    model: str
    key: str = ""
    temperature: float = 0.0
    timeout: float = 120.0

    def __call__(self, messages: list[dict[str, str]]) -> str:
        body = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": self.temperature}}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["message"]["content"].strip()
