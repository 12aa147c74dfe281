from .dates import month_of, week_of_year_sunday
from .endings import (
    cent_fraction,
    ends_cent_nine,
    ends_nine,
    ends_unit_nine,
    unit_digit,
    with_endings,
)
from .labels import CHAINS, chain_format, chain_owner, owner_group_label
from .scalars import (
    decade,
    digit_count_in,
    digits_only,
    format_estimate,
    is_finite,
    is_multiple_of,
    planar_distance,
    price_grid,
    stars,
    to_long_or_null,
    unit_price,
)

__all__ = [
    "CHAINS",
    "cent_fraction",
    "chain_format",
    "chain_owner",
    "decade",
    "digit_count_in",
    "digits_only",
    "ends_cent_nine",
    "ends_nine",
    "ends_unit_nine",
    "format_estimate",
    "is_finite",
    "is_multiple_of",
    "month_of",
    "owner_group_label",
    "planar_distance",
    "price_grid",
    "stars",
    "to_long_or_null",
    "unit_digit",
    "unit_price",
    "week_of_year_sunday",
    "with_endings",
]
