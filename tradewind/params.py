"""Business parameters. The defaults are the values the published results were made with."""

from __future__ import annotations

from dataclasses import dataclass

NO_PURCHASE_SEGMENT = "No Purchase / No Valid Purchase"


@dataclass(frozen=True)
class Params:
    # Fixed values.
    analysis_cutoff: str = "2023-12-31"
    inventory_cutoff: str = "2024-01-17"
    partial_year: int = 2024
    spine_start: str = "2019-01-01"
    spine_end: str = "2024-01-17"
    recognized_statuses: tuple[str, ...] = ("Complete", "Shipped")
    valid_purchase_statuses: tuple[str, ...] = ("Complete", "Shipped", "Processing", "Returned")
    price_floor: float = 1.0
    default_age: int = 28
    min_age: int = 13
    max_age: int = 120
    carrying_rate: float = 0.25
    bot_threshold: int = 1000
    acquisition_cost: float = 40.0
    return_handling_cost: float = 20.0
    return_years: int = 5
    root_cause_min_items: int = 25
    sample_rows: int = 50

    @property
    def last_full_year(self) -> int:
        return self.partial_year - 1
