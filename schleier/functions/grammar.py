"""Small builders of regular expressions in Java's dialect, so that recognisers are put together from lists and ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable


def either(options: Iterable[str]) -> str:
    """The first option that fits."""
    return f"(?:{'|'.join(options)})"


def optional(part: str) -> str:
    return f"(?:{part})?"


def numbers(low: int, high: int, padded: bool = False) -> str:
    """The numbers from low to high, below 100, with or without a leading 0, or with two digits always; ten by ten."""
    out = []
    for tens in range(high // 10, low // 10 - 1, -1):
        units = f"[{max(low - 10 * tens, 0)}-{min(high - 10 * tens, 9)}]"
        out.append(f"{tens}{units}" if tens or padded else f"0?{units}")
    return either(out)


def spelled(label: str) -> str:
    """A label as it is written: a hyphen, a blank and a full stop may be missing; a doubled stop may not, and a doubled blank is any white space."""
    forms = {"-": "-?", " ": r"\s?", ".": r"\.?", "..": r"\.", "  ": r"\s+"}
    return "".join(forms.get(part, re.escape(part)) for part in re.findall(r"\.\.|  |.", label))


def chain(item: str, joint: str, low: int, high: int) -> str:
    """From low to high items with a joint between any two."""
    return f"{item}(?:{joint}{item}){{{low - 1},{high - 1}}}"


def enclosed(edge: str, inner: str, most: int) -> str:
    """Up to ``most`` characters: of the edge's set at both ends, of either set between."""
    return f"[{edge}](?:[{edge}{inner}]{{0,{most - 2}}}[{edge}])?"


def unless(words: Iterable[str]) -> str:
    """Nothing, where none of the words stands."""
    return rf"(?!{either(words)}\b)"


def whole(pattern: str) -> str:
    return rf"\b{pattern}\b"
