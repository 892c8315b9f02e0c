"""What one project calls its datasets, endpoints and arms: given by the caller, empty by default."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Vocabulary:
    """Names and display rules of one project.

    ``prefixes`` map a recipe's prefix to its dataset and are tried in order; a recipe without one
    belongs to the dataset before its first underscore. ``datasets`` is the display order; others
    come after, together. ``inline`` datasets are named on the row instead of on its group.
    """

    prefixes: Sequence[tuple[str, str]] = ()
    datasets: Sequence[str] = ()
    dataset_names: dict[str, str] = field(default_factory=dict)
    endpoint_names: dict[str, str] = field(default_factory=dict)
    split_strategies: dict[str, str] = field(default_factory=dict)
    default_strategy: str = "cluster"
    inline: Sequence[str] = ()


PLAIN = Vocabulary()


@dataclass(frozen=True)
class Arm:
    """One feature set that experiments compare, and where its matrix comes from."""

    name: str
    kind: str = "continuous"
    source: str = "direct"
    width: int | None = None
    derived_from: str | None = None
    calculator: str | None = None
    corpus_from: str | None = None
    standalone: bool = False


def arm_names(arms: Sequence[Arm]) -> list[str]:
    """Arms of the sweep in display order; standalone ones are left out."""
    return [arm.name for arm in arms if not arm.standalone]


def find_arm(arms: Sequence[Arm], name: str) -> Arm:
    for arm in arms:
        if arm.name == name:
            return arm
    raise KeyError(f"no arm {name!r}; there are {', '.join(a.name for a in arms)}")
