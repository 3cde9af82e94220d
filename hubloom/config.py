"""Network definition and planning parameters.

Everything here is small by construction (states x hubs x groups x weeks), and
is what bounds the size of the tables the engine broadcasts.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class NetworkConfig:
    """One planning network: its hubs, demand states, product groups and window."""

    # hub -> seller states it stands for; the order fixes the class index
    hub_members: tuple[tuple[str, tuple[str, ...]], ...]
    # customer states that are planned for
    states: tuple[str, ...]
    # product group -> English category names; anything else is `fallback_group`
    group_categories: tuple[tuple[str, tuple[str, ...]], ...]
    # inclusive bounds of the week column
    start: date
    end: date
    primary_hub: str
    fallback_group: str = "other"
    delivered_status: str = "delivered"

    # medians of state centroids: exact, or by a sketch that is off by at most n / accuracy ranks
    centroid_accuracy: int | None = None

    holdout_weeks: int = 8
    lags: int = 4
    ridge_alpha: float = 3.0

    test_every: int = 5
    inverse_l2: float = 1.0
    logistic_max_iter: int = 3000
    logistic_tol: float = 1e-10

    holding_cost: float = 1.0
    capacity_headroom: float = 1.5
    scenario_count: int = 200
    seed: int = 7
    sweep_steps: int = 10
    primary_multiplier: float = 10.0
    saving_bins: int = 25

    def __post_init__(self) -> None:
        if not self.hub_members or len(set(self.hubs)) != len(self.hubs):
            raise ValueError("hubs must be given, each once")
        if self.primary_hub not in self.hubs:
            raise ValueError(f"primary hub {self.primary_hub!r} is not one of {self.hubs}")

    @property
    def hubs(self) -> tuple[str, ...]:
        return tuple(hub for hub, _ in self.hub_members)

    @property
    def groups(self) -> tuple[str, ...]:
        return tuple(group for group, _ in self.group_categories) + (self.fallback_group,)

    @property
    def series(self) -> tuple[str, ...]:
        return tuple(f"{s}|{g}" for s in sorted(self.states) for g in sorted(self.groups))

    @property
    def first_day(self) -> date:
        """Monday of the first week whose start is not before `start`."""
        return self.start + timedelta(days=-self.start.weekday() % 7)

    @property
    def day_after_last(self) -> date:
        """Day after the last week whose start is not after `end`."""
        return self.end - timedelta(days=self.end.weekday()) + timedelta(days=7)


# Hubs and member states, planned states, category lists, window.
RETAIL_NETWORK = NetworkConfig(
    hub_members=(
        ("HUB_SaoPaulo", ("SP",)),
        ("HUB_South", ("PR", "SC", "RS")),
        ("HUB_MG_RJ", ("MG", "RJ", "ES")),
    ),
    states=("SP", "RJ", "MG", "RS", "PR", "SC", "BA", "DF"),
    group_categories=(
        ("home", (
            "bed_bath_table", "furniture_decor", "housewares", "home_confort",
            "home_construction", "furniture_living_room", "furniture_bedroom",
            "kitchen_dining_laundry_garden_furniture", "garden_tools",
            "home_appliances", "home_appliances_2", "small_appliances",
            "air_conditioning")),
        ("beauty_health", ("health_beauty", "perfumery", "diapers_and_hygiene", "baby")),
        ("tech", (
            "computers_accessories", "telephony", "electronics", "watches_gifts",
            "consoles_games", "audio", "tablets_printing_image", "computers",
            "fixed_telephony", "pc_gamer", "cine_photo")),
    ),
    start=date(2017, 1, 2),
    end=date(2018, 8, 19),
    primary_hub="HUB_SaoPaulo",
)

# The star-schema tables: nations stand for states, regions for hub territories.
STAR_NETWORK = NetworkConfig(
    hub_members=tuple(
        (hub, tuple(f"NATION_{k}" for k in range(25) if k % 5 in regions))
        for hub, regions in (("HUB_A", (1,)), ("HUB_E", (3,)), ("HUB_S", (0, 2)))
    ),
    states=tuple(f"NATION_{k}" for k in range(8)),
    group_categories=(
        ("home", ("standard", "small")),
        ("beauty_health", ("economy",)),
        ("tech", ("large", "medium")),
    ),
    start=date(1999, 12, 6),
    end=date(2001, 7, 22),
    primary_hub="HUB_S",
    delivered_status="F",
)
