"""Lexicon build and ranked lexicon search as Spark jobs."""

from glossa.costs import CostModel, DEFAULT_COSTS
from glossa.plans.build import build_lexicon
from glossa.plans.render import display, render, results_json
from glossa.plans.search import candidate_counts, search
from glossa.sources.tables import Lexicon

__all__ = [
    "CostModel",
    "DEFAULT_COSTS",
    "Lexicon",
    "build_lexicon",
    "candidate_counts",
    "display",
    "render",
    "results_json",
    "search",
]
