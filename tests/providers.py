"""Stub models; importable by the Python workers."""

from __future__ import annotations

import json

GOOD = {
    "topics": ["regulation"], "sentiment": -1, "stance": "bearish", "impact": 1, "tickers": ["XAG", "XAU"],
    "entities": [{"type": "PLACE", "text": "Oslo"}],
}


class GoodChat:
    def chat(self, messages, max_tokens):
        assert messages[0]["role"] == "system" and max_tokens == 300
        return json.dumps(GOOD)


class MoodyChat:
    """Behaves as the text says."""

    def chat(self, messages, max_tokens):
        text = messages[1]["content"]
        if "down" in text:
            raise ConnectionError("down")
        if "silent" in text:
            return None
        if "never" in text or ("repair" in text and len(messages) == 2):
            return "no JSON"
        return json.dumps(GOOD)


class TripleEmbedder:
    def embed(self, texts):
        return [[0.25, -0.5, float(len(t))] for t in texts]


class ShortEmbedder:
    """Returns one vector whatever it is asked, unless it is asked for one."""

    def embed(self, texts):
        return [[1.0, 2.0]]


class SizedEmbedder:
    def embed(self, texts):
        if len(texts) > 10:
            raise ValueError(f"{len(texts)} texts at once")
        return [[float(len(texts))] for _ in texts]


class DownEmbedder:
    """Fails always and counts how often it was asked in this process."""

    asked = 0

    def embed(self, texts):
        DownEmbedder.asked += 1
        raise ConnectionError(f"down after {DownEmbedder.asked}")


class TiringEmbedder:
    """Answers five requests, then none."""

    def __init__(self):
        self.left = 5

    def embed(self, texts):
        self.left -= 1
        if self.left < 0:
            raise ConnectionError("gone")
        return [[1.0]] * len(texts)


class DownChat:
    def chat(self, messages, max_tokens):
        raise ConnectionError("down")


class ManyChat:
    """Answers lists of conversations; a list with a text of the word broken fails as a whole."""

    def chat(self, messages, max_tokens):
        if "broken" in messages[1]["content"]:
            raise ConnectionError("broken")
        return json.dumps(GOOD)

    def chat_many(self, conversations, max_tokens):
        assert len(conversations) <= 4
        return [self.chat(c, max_tokens) for c in conversations]


class SlowChat:
    """Notes how many conversations are under way at once."""

    def __init__(self):
        import threading

        self.lock, self.now, self.most = threading.Lock(), 0, 0

    def chat(self, messages, max_tokens):
        import time

        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(0.05)
        with self.lock:
            self.now -= 1
        return json.dumps(GOOD | {"tickers": [str(self.most)]})


class PickyEmbedder:
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t)), 1.0] for t in texts]


class NoNewTexts:
    """Fails when asked about anything: every vector must come from the cache."""

    def embed(self, texts):
        raise AssertionError(f"asked again: {texts}")


def no_pause(seconds):
    return None
