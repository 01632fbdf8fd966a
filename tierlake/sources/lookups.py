"""Inline lookup tables of the marts.

These are fixed business values; they are tiny and their size is known, so
callers may broadcast them without a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Currency -> rate to INR.
FX_RATES_TO_INR = {
    "INR": 1.00,
    "AED": 24.18,
    "AUD": 57.55,
    "CAD": 62.93,
    "GBP": 117.98,
    "SGD": 68.18,
    "USD": 88.29,
}

# Country -> state code -> sales region.
STATE_REGIONS = {
    "India": {
        "MH": "West", "GJ": "West", "RJ": "West",
        "KA": "South", "TN": "South", "TS": "South", "AP": "South", "KL": "South",
        "UP": "North", "WB": "North", "DL": "North",
    },
    "Australia": {"VIC": "SouthEast", "WA": "West", "NSW": "East", "QLD": "NorthEast"},
    "United Kingdom": {"ENG": "England", "WLS": "Wales", "NIR": "Northern Ireland", "SCT": "Scotland"},
    "United States": {
        "MA": "NorthEast", "FL": "South", "NJ": "NorthEast", "CA": "West",
        "NY": "NorthEast", "TX": "South",
    },
    "United Arab Emirates": {"AUH": "Abu Dhabi", "DU": "Dubai", "SHJ": "Sharjah"},
    "Singapore": {"SG": "Singapore"},
    "Canada": {"BC": "West", "AB": "West", "ON": "East", "QC": "East", "NS": "East", "IL": "Other"},
}

# Brand category code corrections and material spellings.
CATEGORY_CODE_FIXES = {"GROCERY": "GRCY", "BOOKS": "BKS", "TOYS": "TOY"}
MATERIAL_FIXES = {"Coton": "Cotton", "Alumium": "Aluminum", "Ruber": "Rubber"}
CHANNEL_NAMES = {"web": "Website", "app": "Mobile"}
WEEKEND_DAYS = ("Saturday", "Sunday")


def fx_rates(spark: SparkSession) -> DataFrame:
    """(currency string, inr_rate double), 7 rows."""
    rows = [(k, float(v)) for k, v in FX_RATES_TO_INR.items()]
    return spark.createDataFrame(rows, "currency string, inr_rate double")


def region_map(spark: SparkSession) -> DataFrame:
    """(country, state, region), 35 rows."""
    rows = [(country, state, region)
            for country, states in STATE_REGIONS.items()
            for state, region in states.items()]
    return spark.createDataFrame(rows, "country string, state string, region string")
