"""Every constant of the cost model, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CostModel:
    # Search costs.
    inversion: int = 8_000
    unmatched_syllable: int = 10_000
    substring_offset: int = 12_000
    completion: int = 2_500
    fuzzy: int = 20_000
    english_base: int = 5_000
    english_non_ascii: int = 8_000
    english_offset: int = 100
    english_mid_word: int = 5_000
    # Static (build-time) costs.
    max_char_cost: int = 7_000
    romanised_base: int = 15_000
    romanised_per_syllable: int = 1_000
    missing_reading: int = 10_000


DEFAULT_COSTS = CostModel()

# Fixed values: (any of these substrings, whether they must be present or absent, cost).
HEURISTICS: tuple[tuple[tuple[str, ...], str, int], ...] = (
    (("abbr.",), "present", 5_000),
    (("M:", "CL:"), "absent", 5_000),
    (("Surname", "surname"), "present", 2_000),
    (("(Cantonese)",), "absent", 2_000),
    (("Confucius",), "present", 5_000),
    (("Dynasty", "Dynasties"), "present", 5_000),
    (("(Buddhism)",), "present", 5_000),
)

# Names used for the two lexicon sources and the three match kinds.
SOURCE_BILINGUAL = "CEDict"
SOURCE_ROMANISED = "CCanto"
MATCH_SYLLABLE = "Jyutping"
MATCH_HEADWORD = "Traditional"
MATCH_DEFINITION = "English"

# Largest tone that a stored syllable may carry.
MAX_TONE = 6
