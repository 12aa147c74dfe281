"""Chain labels: owner, store format and the anonymous owner name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chains of each owner and of each store format.
OWNER_CHAINS = {
    "Rema": ["Rema"],
    "NG": ["kiwi", "meny", "spar", "nærbutikken", "joker"],
    "Coop": ["Extra", "Marked", "Matkroken", "Mega", "Obs", "Prix"],
}
FORMAT_CHAINS = {
    "discounter": ["Extra", "Prix", "kiwi", "Rema"],
    "supermarket": ["meny", "spar", "Mega"],
    "hypermarket": ["Obs"],
    "convenience": ["joker", "Marked", "Matkroken", "nærbutikken"],
}
OWNER_GROUPS = {"Coop": "Group 1", "NG": "Group 2", "Rema": "Group 3"}

# Chains that the two store-id feeds are restricted to.
CHAINS = OWNER_CHAINS["NG"] + OWNER_CHAINS["Coop"]


def label_by_members(column: Column, members: dict[str, list]) -> Column:
    """The label whose member list holds the value; NULL for any other value."""
    label = F.lit(None).cast("string")
    for name, values in members.items():
        label = F.when(column.isin(values), F.lit(name)).otherwise(label)
    return label


def chain_owner(chain: Column, owners: dict[str, list] | None = None) -> Column:
    return label_by_members(chain, owners or OWNER_CHAINS)


def chain_format(
    chain: Column, discount_label: str = "discounter", formats: dict[str, list] | None = None
) -> Column:
    """Store format of a chain; analyses spell the discount format differently."""
    table = formats or FORMAT_CHAINS
    return label_by_members(
        chain, {discount_label if k == "discounter" else k: v for k, v in table.items()}
    )


def owner_group_label(owner: Column, groups: dict[str, str] | None = None) -> Column:
    return label_by_members(owner, {v: [k] for k, v in (groups or OWNER_GROUPS).items()})
