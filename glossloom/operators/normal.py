"""The normal form of short Hebrew strings inside a grouped map; functions.text.normalized is the same for columns."""

from __future__ import annotations

import re
from functools import lru_cache

from glossloom.profiles import HEBREW_LETTERS, HEBREW_MARKS

_STEPS = [(re.compile(a), b) for a, b in (("<[^>]*>", " "), ("[׳'’‘´]{2}", '"'), ("[׳'’‘´]", "'"), ('[״"“”″‟„]', '"'), (f"[{HEBREW_MARKS}]", ""), (f"[^{HEBREW_LETTERS}0-9'\"]+", " "), ("(^| )[\"']+", r"\1"), ('"+( |$)', r"\1"))]


@lru_cache(100_000)
def normal(text: str) -> str:
    for pattern, new in _STEPS:
        text = pattern.sub(new, text)
    return " ".join(text.split())
