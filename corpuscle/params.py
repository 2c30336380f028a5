"""Parameters of the pipeline's steps, with their defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class DictionaryParams:
    lowercase: bool = True
    category: bool = False
    disambi: bool = False
    min_word_count: int = 5
    min_entity_count: int = 5
    min_paragraph_len: int = 5


@dataclass(frozen=True)
class MentionParams:
    min_link_prob: float = 0.2
    min_prior_prob: float = 0.01
    max_mention_len: int = 20
    case_sensitive: bool = False


@dataclass(frozen=True)
class LinkerParams:
    min_link_count: int = 1
    min_link_prob: float = 0.01
    min_prior_prob: float = 0.03
    max_mention_len: int = 30


@dataclass(frozen=True)
class TrainParams:
    dim_size: int = 100
    window: int = 5
    iteration: int = 5
    negative: int = 5
    entities_per_page: int = 10
    init_alpha: float = 0.025
    min_alpha: float = 0.0001
    sample: float = 1e-4
    word_neg_power: float = 0.75
    entity_neg_power: float = 0.0
    #: 'fresh' draws the window anew for every centre; 'shrinking' lets each draw bound the next one of the page.
    window_mode: str = "fresh"
    min_paragraph_len: int = 5
    rounds: int = 1
    seed: int = 0


def as_dict(params: object) -> dict:
    return asdict(params)  # type: ignore[call-overload]
