"""Fixed lookup values that results must agree with."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provinces of each island group. A province named twice takes the later group.
ISLAND_GROUPS = {
    "Sumatra": [
        "Aceh", "Bangka-Belitung", "Bengkulu", "Jambi", "Kepulauan Riau", "Lampung",
        "Sumatera Barat", "Sumatera Selatan", "Sumatera Utara",
    ],
    "Nusa Tenggara": ["Bali", "Nusa Tenggara Barat", "Nusa Tenggara Timur"],
    "Java": [
        "Banten", "Jawa Barat", "Jawa Tengah", "Jawa Timur", "Riau", "Yogyakarta",
        "Jakarta Raya",
    ],
    "Sulawesi": [
        "Gorontalo", "Bengkulu", "Sulawesi Barat", "Sulawesi Selatan",
        "Sulawesi Tengah", "Sulawesi Tenggara", "Sulawesi Utara",
    ],
    "Kalimantan": [
        "Kalimantan Barat", "Kalimantan Selatan", "Kalimantan Tengah",
        "Kalimantan Timur", "Kalimantan Utara",
    ],
    "Maluku Islands": ["Maluku Utara", "Maluku"],
    "Papua": ["Papua", "Irian Jaya Barat"],
}

# Colour of each death code and infection code pair (4 x 4 map).
COLOURS_4X4 = {
    "00": "#e8e8e8", "01": "#ace4e4", "02": "#5ac8c8", "03": "#218282",
    "10": "#e4acac", "11": "#a3a3a3", "12": "#5698a3", "13": "#176d81",
    "20": "#c85a5a", "21": "#a86464", "22": "#808080", "23": "#115f74",
    "30": "#930000", "31": "#6c0000", "32": "#4a0000", "33": "#320000",
}

# Colour by incidence tercile (row) and egg tercile (column).
COLOURS_3X3 = [
    ["#e8e8e8", "#ace4e4", "#5ac8c8"],
    ["#dfb0d6", "#a5add3", "#5698b9"],
    ["#be64ac", "#8c62aa", "#3b4994"],
]

# Land cover class codes.
LAND_COVER_CLASSES = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95]

# What a zonal statistic can be.
STATISTICS = ["MEAN", "MAXIMUM", "MINIMUM", "MEDIAN", "STD", "VARIANCE", "SUM"]


def province_regions() -> dict[str, str]:
    return {p: group for group, names in ISLAND_GROUPS.items() for p in names}


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])


def look_up(mapping: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed mapping, NULL when absent."""
    return F.try_element_at(literal_map(mapping), key)
