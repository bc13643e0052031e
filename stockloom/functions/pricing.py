"""Column functions for price effects, factors, stock quantities and alert texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price elasticity and multiplier cap without an event, by cluster.
ELASTICITY = {0: -0.6, 1: -1.0, 2: -1.2, 3: -0.8}
CAP_WITHOUT_EVENT = {0: 1.8, 1: 2.2, 2: 2.8, 3: 2.0}
DEFAULT_ELASTICITY = -1.0
DEFAULT_CAP = 2.0
EVENT_BONUS = 1.5
FLOOR = 0.5

# Default lift by external factor.
FACTOR_LIFTS = {
    "inflacion_cpi": 0.97,
    "marketing_push": 1.10,
    "season_extra": 1.12,
    "agosto_nonprice": 0.95,
    "competition_high": 0.90,
}

# Noise sigma by cluster and the standard-normal quantile by service level.
NOISE_SIGMA = {0: 0.04, 1: 0.05, 2: 0.06, 3: 0.05}
DEFAULT_SIGMA = 0.05
SERVICE_Z = {"90": 1.2816, "95": 1.6449, "97.5": 1.9599, "99": 2.3263}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_cluster(cluster, values: dict[int, float], default: float) -> Column:
    chain = None
    for k, v in values.items():
        hit = _col(cluster) == k
        chain = F.when(hit, F.lit(v)) if chain is None else chain.when(hit, F.lit(v))
    return chain.otherwise(F.lit(default))


def elasticity(cluster) -> Column:
    return by_cluster(cluster, ELASTICITY, DEFAULT_ELASTICITY)


def multiplier_cap(cluster, on_event) -> Column:
    bonus = F.when(_col(on_event), F.lit(EVENT_BONUS)).otherwise(F.lit(1.0))
    return by_cluster(cluster, CAP_WITHOUT_EVENT, DEFAULT_CAP) * bonus


def elasticity_multiplier(discount, cluster, on_event) -> Column:
    """Demand multiplier of a price change, kept between the floor and the cluster's cap."""
    raw = F.pow(1 + _col(discount), elasticity(cluster))
    return F.greatest(F.lit(FLOOR), F.least(raw, multiplier_cap(cluster, on_event)))


def effective_price_factor(multiplier, cluster) -> Column:
    """Price factor that alone would explain the multiplier."""
    eps = elasticity(cluster)
    return F.when(eps == 0, F.lit(1.0)).otherwise(F.pow(_col(multiplier), 1 / eps))


def factor_product(cols: list[str]) -> Column:
    return reduce(lambda a, b: a * b, [F.col(c) for c in cols])


def factors_applied(cols: list[str], prefix: str = "M_") -> Column:
    """Sorted, pipe-joined names of the factors that differ from 1."""
    names = F.array(*[F.when(F.col(c) != 1.0, F.lit(c.removeprefix(prefix))) for c in sorted(cols)])
    joined = F.array_join(F.array_sort(F.array_compact(names)), "|")
    return F.when(joined == "", "None").otherwise(joined)


# Event keywords in the order they are tried, with the price class of each.
PRICE_CLASSES = [
    ("black|bf|cyber", "bf", -0.25, "1|2"),
    ("rebaj|sale", "rebajas", -0.15, "0|1|2|3"),
    ("navid|christ|xmas", "navidad", -0.10, "0"),
    ("verano|summer", "verano", -0.10, "0"),
    ("", "evento", -0.10, "0|1|2|3"),
]
# The same for external factors.
FACTOR_CLASSES = [
    ("black|bf|cyber", "season_extra", "black_friday"),
    ("rebaj", "season_extra", "rebajas"),
    ("navid|xmas|christ", "season_extra", "navidad"),
    ("agosto", "agosto_nonprice", "agosto_nonprice"),
    ("marketing", "marketing_push", "newsletter/display"),
    ("", "season_extra", "evento_general"),
]


def _classify(event, classes: list[tuple], field: int) -> Column:
    text = F.lower(F.coalesce(_col(event), F.lit("")))
    chain = None
    for row in classes:
        hit = text.rlike(row[0]) if row[0] else F.lit(True)
        chain = F.when(hit, F.lit(row[field])) if chain is None else chain.when(hit, F.lit(row[field]))
    return chain


def price_class(event) -> dict[str, Column]:
    return {
        "id_prefix": _classify(event, PRICE_CLASSES, 1),
        "discount": _classify(event, PRICE_CLASSES, 2),
        "scope_values": _classify(event, PRICE_CLASSES, 3),
    }


def factor_class(event) -> dict[str, Column]:
    kind = _classify(event, FACTOR_CLASSES, 1)
    lift = None
    for name, value in FACTOR_LIFTS.items():
        lift = F.when(kind == name, F.lit(value)) if lift is None else lift.when(kind == name, F.lit(value))
    return {"factor_type": kind, "notes": _classify(event, FACTOR_CLASSES, 2), "lift": lift.otherwise(F.lit(1.0))}


def ceil_to_multiple(x, multiple) -> Column:
    """Round up to a multiple; nothing for x <= 0; multiples 0, 1 and null are ignored."""
    v, m = _col(x), _col(multiple)
    plain = F.ceil(v).cast("long")
    return (
        F.when(v <= 0, F.lit(0).cast("long"))
        .when(m.isNull() | (m <= 1), plain)
        .otherwise((F.ceil(v / m) * m).cast("long"))
    )


def lead_time_bucket(days) -> Column:
    d = _col(days)
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when((d >= 2) & (d <= 4), "2-4")
        .when((d >= 5) & (d <= 7), "5-7")
        .otherwise("10-15")
    )


def alert_text(chips: list[tuple[Column, Column]]) -> Column:
    """Texts of the active chips in the given order."""
    return F.concat_ws(" · ", *[F.when(on, text) for on, text in chips])
