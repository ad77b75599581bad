"""Scripts by ranges of code points."""

from __future__ import annotations

import re

RANGES = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽἀ-῿", "arabic": "؀-ۿݐ-ݿ", "hebrew": "֐-׿", "devanagari": "ऀ-ॿ",
    "thai": "฀-๿", "hangul": "가-힣ᄀ-ᇿ", "kana": "぀-ヿ", "han": "㐀-䶿一-鿿",
}
_RUNS = {name: re.compile(f"[{r}]+") for name, r in RANGES.items()}


def script_of(text: str) -> str:
    """The script with most characters in text; "other" if none has any."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text[:64])) or _RUNS["latin"].search(text) else "other"
    sizes = {}
    rest = len(text)
    for name, run in _RUNS.items():
        sizes[name] = n = sum(map(len, run.findall(text)))
        rest -= n
        if n > rest:
            break
    best = max(sizes, key=sizes.get)
    return best if sizes[best] else "other"
