"""Settings of the end-to-end jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from gradeloom.functions.stopwords import ENGLISH


@dataclass(frozen=True)
class Settings:
    # Defaults of split, features and sampling.
    test_size: float = 0.15
    val_size: float = 0.15
    seed: int = 42
    max_features: int = 3000
    ngram_range: tuple[int, int] = (1, 2)
    responder_sample: int = 103

    # Text and label of the merged cases that are modelled.
    text: str = "report_text_us"
    label: str = "severity_grade_us"
    row_key: tuple[str, ...] = ("report_id_us", "report_id_or")
    token_mode: str = "plain"
    stop_words: tuple[str, ...] = ENGLISH

    # Model sizes; None keeps the defaults of the classifiers.
    rounds: int | None = None
    trees: int | None = None
    forest_depth: int | None = None
    max_iter: int | None = None
    models: tuple[str, ...] = field(default=(
        "logistic_regression", "random_forest", "svm", "gradient_boosting", "leaf_boosting"))
