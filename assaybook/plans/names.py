"""The vocabulary of the sample tables."""

from __future__ import annotations

from ..vocabulary import Vocabulary

SAMPLE = Vocabulary(
    prefixes=(
        ("plant_potency", "plant_potency"), ("plant", "plant"), ("mill", "mill"),
        ("press1", "press_line"), ("press", "press_line"), ("gauge", "gauge"),
    ),
    datasets=("plant_potency", "plant", "mill", "lab", "press_line", "annex", "gauge", "dock"),
    dataset_names={"plant": "Plant", "plant_potency": "Plant", "press_line": "Press line", "gauge": "Lab"},
    endpoint_names={"LOG_rate_A": "rate A"},
    split_strategies={"plant": "predefined", "plant_potency": "predefined"},
    inline=("gauge", "dock"),
)
