"""Replies of a rule of our own in place of models, for queries and tests. They prove the mechanics, not the grading.

The text model reads nothing into a prompt: a verdict is drawn from the prompt's MD5, and the concepts of a model answer are
its two ends.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np

OPENING, CLOSING = "<model_answer>\n", "\n</model_answer>"
#: Drawn by the first hexadecimal digit of a prompt's MD5.
DRAWN = ("MISSING", "COVERED", "PARTIAL")
END_CHARS = 20


def two_ends(answer: str) -> dict:
    """The first and the last END_CHARS characters, one weighing a quarter, the other the rest."""
    ends = ((answer[:END_CHARS], 0.25), (answer[-END_CHARS:], 0.75))
    return {"concepts": [{"text": t, "weight": w} for t, w in ends]}


def drawn_verdict(prompt: str) -> dict:
    return {"verdict": DRAWN[int(hashlib.md5(prompt.encode()).hexdigest()[0], 16) % len(DRAWN)]}


def drawing_model():
    """Text model for prompts of concepts and of coverage."""

    def reply(prompt: str) -> str:
        at = prompt.find(OPENING)
        if at < 0:
            return json.dumps(drawn_verdict(prompt))
        return json.dumps(two_ends(prompt[at + len(OPENING) : prompt.rindex(CLOSING)]))

    return reply


#: The draw in DuckDB.
def drawn_sql(prompt: str) -> str:
    names = ", ".join(f"'{v}'" for v in DRAWN)
    return f"[{names}][1 + ('0x' || md5({prompt})[1])::INTEGER % {len(DRAWN)}]"


def late_model():
    """Image model that can be used from attempt 1, 2 or 3 on, or never, by the number in the image; it raises on multiples of 10."""

    def reply(content: bytes, prompt: str) -> str:
        n = int(content)
        if n % 10 == 0:
            raise RuntimeError(f"no answer for {n}")
        attempt = next((k for k in (2, 3) if f"Attempt {k} of" in prompt), 1)
        if attempt > n % 4:
            block = {"question_number": "1", "bbox": {"x": 0, "y": 0, "w": 9, "h": 9}, "content_type": "TEXT", "raw_text": str(n), "reconstructed_text": str(n), "confidence": 1}
            return json.dumps({"blocks": [block]})
        return "no page" if n % 2 else json.dumps({"blocks": [{"content_type": "PHOTO"}, {"content_type": "TEXT"}]})

    return reply


def hash_model(dim: int = 16):
    """Embedding model with the same vectors as the `hash_embed` column expression."""

    def vector(text: str) -> list[float]:
        digests = b"".join(hashlib.sha256(f"{text.strip().lower()}#{b}".encode()).digest() for b in range(-(-dim // 16)))
        raw = np.frombuffer(digests, dtype=">u2")[:dim] / 32767.5 - 1
        return (raw / (np.linalg.norm(raw) or 1.0)).tolist()

    return lambda: lambda texts: list(map(vector, texts))
