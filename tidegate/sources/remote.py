"""A remote inspector behind a chat-completions address, as a plug-in for gate 3.

Each task makes its own client, so a token is fetched once a task and kept until shortly before it
ends. A call that fails blocks its text: ``gates.model_inspector`` turns a missing reply into that.
"""

from __future__ import annotations

import base64
import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd

from tidegate.operators.gates import Gate, model_inspector


@dataclass
class Client:
    """``auth`` is none, bearer, basic, header or oauth2."""

    url: str
    model: str
    prompt: str
    auth: str = "none"
    key: str = ""
    user: str = ""
    secret: str = ""
    header: str = "X-API-Key"
    token_url: str = ""
    scope: str = ""
    timeout: float = 120.0
    most_tokens: int = 256
    _token: str = field(default="", repr=False)
    _until: float = 0.0

    def _open(self, request: urllib.request.Request) -> dict:
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.loads(reply.read())

    def _basic(self, user: str, secret: str) -> str:
        return "Basic " + base64.b64encode(f"{user}:{secret}".encode()).decode()

    def token(self) -> str:
        """Client credentials, in the form first; a server that refuses that gets them in a header."""
        if self._token and time.time() < self._until:
            return self._token
        form = {"grant_type": "client_credentials"} | ({"scope": self.scope} if self.scope else {})
        own = {"client_id": self.user, "client_secret": self.secret}
        try:
            found = self._open(urllib.request.Request(self.token_url, urllib.parse.urlencode(form | own).encode()))
        except urllib.error.HTTPError as e:
            if e.code not in (400, 401):
                raise
            found = self._open(urllib.request.Request(self.token_url, urllib.parse.urlencode(form).encode(), {"Authorization": self._basic(self.user, self.secret)}))
        self._token, self._until = found["access_token"], time.time() + float(found.get("expires_in", 300)) - 30
        return self._token

    def headers(self) -> dict[str, str]:
        by_mode: dict[str, Callable[[], dict[str, str]]] = {
            "none": dict,
            "bearer": lambda: {"Authorization": f"Bearer {self.key}"},
            "basic": lambda: {"Authorization": self._basic(self.user, self.secret)},
            "header": lambda: {self.header: self.key},
            "oauth2": lambda: {"Authorization": f"Bearer {self.token()}"},
        }
        return {"Content-Type": "application/json"} | by_mode[self.auth]()

    def ask(self, text: str) -> str:
        content = f"<CONTENT>\n{text}\n</CONTENT>"
        body = {"model": self.model, "temperature": 0, "max_tokens": self.most_tokens, "messages": [{"role": "system", "content": self.prompt}, {"role": "user", "content": content}]}
        data = json.dumps(body).encode()
        try:
            found = self._open(urllib.request.Request(self.url, data, self.headers()))
        except urllib.error.HTTPError as e:
            if e.code != 401 or self.auth != "oauth2":
                raise
            self._token = ""  # the token may have ended early: once more with a fresh one
            found = self._open(urllib.request.Request(self.url, data, self.headers()))
        return found["choices"][0]["message"]["content"]


def remote_inspector(**settings: object) -> Gate:
    """Gate 3 by a remote model; a text whose call fails is blocked, the others of its batch are not."""
    made: list[Client] = []

    def replies(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Client(**settings))

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return made[0].ask(text)
            except (OSError, http.client.HTTPException, KeyError, IndexError, TypeError, ValueError):
                return None

        return texts.map(one)

    return model_inspector(replies)
