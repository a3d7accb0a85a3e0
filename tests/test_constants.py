"""The constants that the registered SQL takes from the library, pinned by value."""

from __future__ import annotations

import hashlib

from feedloom.functions import answers, language, lexicon
from feedloom.operators import constraints


def digest(value) -> str:
    return hashlib.sha256(repr(value).encode()).hexdigest()[:16]


def test_constants_have_not_changed():
    prompts = (answers.SYSTEM_PROMPT, answers.USER_PROMPT_HEAD, answers.USER_PROMPT_TAIL, answers.REPAIR_PROMPT)
    words = (lexicon.TOPIC_WORDS, lexicon.POSITIVE_WORDS, lexicon.NEGATIVE_WORDS, lexicon.ORGANISATIONS)
    assert digest(prompts) == "86283a5e85b7e82e"
    assert digest(language.PROFILES) == "e8749d13dd85c48d"
    assert digest(words) == "30279534969a661f"
    assert constraints.MAX_LENGTHS == {"source_id": 255, "author": 255, "lang": 5, "stance": 16}
