"""Default parameters, in one place.

The numbers are fixed values: they decide which rows are flagged or filled, so
a change here changes results.
"""

from __future__ import annotations

from dataclasses import dataclass

# Identifier columns that are not features.
IDENTIFIERS = ("isin", "esg_rating", "issuer_name.1")


@dataclass(frozen=True)
class Config:
    key: str
    group_col: str
    target_col: str | None = None

    imputation: str = "group_mean"
    iqr_multiplier: float = 1.5
    z_threshold: float = 3.0
    treatment: str = "mean"
    flag_prefix: str = "iqr_out_"
    drop_first: bool = True
    one_hot_output: str = "dense"
    # String columns of these names, and those with almost as many values as rows, are identifiers and no features.
    identifiers: tuple[str, ...] = IDENTIFIERS
    identifier_share: float | None = 0.9
    # Candidate lambdas of the power transform; None fits them freely.
    lambda_grid: tuple[float, ...] | None = None
    # Share of rows that a forest flags; None leaves the forest out.
    forest_contamination: float | None = None
    target_range: tuple[float, float] = (0.0, 10.0)
