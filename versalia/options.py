"""Options of the recasing operators; they are literals of the plan, so unused branches fold away."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum


class CaseMode(Enum):
    SENTENCE = "sentence"
    TITLE = "title"
    SENTENCE_TITLE = "sentence-title"

    @property
    def flattens_lines(self) -> bool:
        return self is not CaseMode.SENTENCE


class SeparatorStyle(Enum):
    """What a subtitle separator becomes; None leaves it."""

    PRESERVE = None
    COLON_SPACE = ": "
    SPACE_DASH_SPACE = " - "
    EM_DASH_SPACE = " — "


class GermanMode(IntEnum):
    CONSERVATIVE = 0
    BALANCED = 1
    AGGRESSIVE = 2


@dataclass(frozen=True)
class CaseOptions:
    locale: str = "en"
    mode: CaseMode = CaseMode.SENTENCE
    separators: SeparatorStyle = SeparatorStyle.PRESERVE
    normalize_whitespace: bool = True
    capitalize_after_subtitle: bool = True
    preserve_acronyms: bool = True
    preserve_mixed_case: bool = True
    preserve_existing_capitals: bool = True
    preserve_known_proper_nouns: bool = True
    german_mode: GermanMode = GermanMode.CONSERVATIVE

    @property
    def language(self) -> str:
        return self.locale.replace("_", "-").split("-")[0].lower()
