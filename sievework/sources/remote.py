"""Clients of remote encoders, rerankers and chat models over a transport that is injected.

A transport is a function of (path, payload, seconds) that returns the decoded
answer, or raises: ``Unavailable`` for what may go well later (also the standard
TimeoutError and ConnectionError), anything else for what will not. Clients are
plain objects that tasks can be sent; ``models.embed`` takes ``client.documents``
as its encoder.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field


class Unavailable(Exception):
    """An answer that is worth another try; ``after`` is the wait in seconds that the service asked for."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


class DeadlineExceeded(Exception):
    pass


@dataclass
class Client:
    """Calls with retries: waits double from ``wait`` on, and all tries of a call together end at ``deadline`` seconds."""

    transport: Callable[[str, dict, float], dict]
    model: str
    tries: int = 4
    wait: float = 0.5
    timeout: float = 60.0
    deadline: float = 180.0
    clock: Callable[[], float] = field(default=time.monotonic, repr=False)
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def call(self, path: str, payload: dict) -> dict:
        begin, wait = self.clock(), self.wait
        for attempt in range(1, self.tries + 1):
            left = self.deadline - (self.clock() - begin)
            if left <= 0:
                raise DeadlineExceeded(f"{path}: no answer within {self.deadline} seconds")
            try:
                return self.transport(path, {"model": self.model, **payload}, min(self.timeout, left))
            except (Unavailable, TimeoutError, ConnectionError) as e:
                if attempt == self.tries:
                    raise
                pause = max(wait, getattr(e, "after", None) or 0.0)
                if self.clock() - begin + pause >= self.deadline:
                    raise DeadlineExceeded(f"{path}: no answer within {self.deadline} seconds") from e
                self.sleep(pause)
                wait *= 2
        raise AssertionError("a try returns or raises")


@dataclass
class Encoder(Client):
    """Vectors of length 1 from requests of at most ``batch`` texts; answers may come in any order, with their index."""

    dimensions: int | None = None
    batch: int = 10
    instruction: str = ""

    def documents(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            size = {} if self.dimensions is None else {"dimensions": self.dimensions}
            data = sorted(self.call("embeddings", {"input": part, **size})["data"], key=lambda d: d["index"])
            if [d["index"] for d in data] != list(range(len(part))):
                raise ValueError("vectors with wrong indexes")
            out += [self._unit(d["embedding"]) for d in data]
        if len({len(v) for v in out}) > 1:
            raise ValueError("vectors of different sizes")
        return out

    def query(self, text: str) -> list[float]:
        return self.documents([f"Instruct: {self.instruction}\nQuery: {text}" if self.instruction else text])[0]

    def _unit(self, v: list[float]) -> list[float]:
        if self.dimensions is not None and len(v) != self.dimensions or not all(map(math.isfinite, v)):
            raise ValueError("a vector of wrong size or not finite")
        length = math.sqrt(math.fsum(x * x for x in v))
        if length == 0:
            raise ValueError("a vector of zeros")
        return [x / length for x in v]


@dataclass
class Reranker(Client):
    instruction: str = ""

    def rank(self, query: str, texts: list[str], k: int) -> list[tuple[int, float]]:
        """(index of the text, score) of the k best texts, the best first; equal scores in the service's order."""
        if not texts or k <= 0:
            return []
        n = min(k, len(texts))
        payload = {"query": query, "documents": texts, "top_n": n} | ({"instruct": self.instruction} if self.instruction else {})
        results = self.call("rerank", payload).get("results")
        if not isinstance(results, list) or len(results) != n:
            raise ValueError(f"{n} results are needed")
        found = [(r["index"], float(r["relevance_score"])) for r in results]
        if any(type(i) is not int or not 0 <= i < len(texts) or not math.isfinite(s) for i, s in found) or len({i for i, _ in found}) != n:
            raise ValueError("results with wrong indexes or scores")
        return sorted(found, key=lambda r: -r[1])


@dataclass
class Chat(Client):
    temperature: float = 0.0

    def answer(self, messages: list[dict]) -> str:
        choices = self.call("chat/completions", {"messages": messages, "temperature": self.temperature}).get("choices") or []
        content = choices[0].get("message", {}).get("content") if choices else None
        if not isinstance(content, str) or not content.strip():
            raise ValueError("an empty answer")
        return content
