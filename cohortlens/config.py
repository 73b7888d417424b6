"""Run parameters.

The reference hard-codes these values in its SQL; here they are parameters with
the reference's values as defaults.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference's for identical results.
SERVICE_TYPES = (
    "Follow-up Appointment",
    "Medication Support",
    "Preventive Screening",
    "Subscription Benefit",
    "Telehealth Consultation",
    "Vaccination",
)
INCOME_BRACKET_ORDER = ("High", "Upper-middle", "Middle", "Lower-middle", "Low")
AGE_BRACKETS = (
    ("18-25", 18, 25),
    ("26-33", 26, 33),
    ("34-41", 34, 41),
    ("42-49", 42, 49),
    ("50-57", 50, 57),
    ("58-65", 58, 65),
)
AGE_TOP_BRACKET = "65+"  # ages above 65
STATUS_BOTH = "Service and App"
STATUS_INACTIVE = "Inactive"
# The segment reports spell two labels in lower case, the RFM and churn tables
# in title case.
REPORT_LABELS = {"services": "Services only", "app": "App only"}
TABLE_LABELS = {"services": "Services Only", "app": "App Only"}
MISSING_DATE = dt.date(1900, 1, 1)
TELEHEALTH = "Telehealth Consultation"


@dataclass(frozen=True)
class Params:
    """Knobs of the analyses.

    ``service_as_of`` judges service recency, ``app_as_of`` app recency; the
    reference uses one date (2025-08-31) for both.
    """

    service_as_of: dt.date = dt.date(2025, 8, 31)
    app_as_of: dt.date = dt.date(2025, 8, 31)
    app_high_days: int = 180  # App_Churn_Flag = 1 and level High above this
    app_medium_days: int = 90  # level Medium above this
    medium_factor: float = 1.25  # service level Medium up to factor * cutoff
    cutoff_quantile: float = 0.75
    cadence_quantile: float = 0.5
    score_buckets: int = 5
    attribution_days: int = 30  # inclusive window after the outreach date
    exact_quantiles: bool = True  # percentile_disc; False -> percentile_approx
    approx_accuracy: int = 10000
    pivot_service: str = TELEHEALTH
    history_chunk: int = 1000  # services in one row of the chunked history
    history_limit: int = 100_000  # most services of a user in the one-row history; beyond, it fails
    service_types: tuple = field(default=SERVICE_TYPES)
    # how intermediates read by several consumers are kept (a StorageLevel
    # name); DISK_ONLY suits the full-size service sequence on a cluster
    storage_level: str = "MEMORY_AND_DISK"

    def storage(self):
        from pyspark import StorageLevel
        return getattr(StorageLevel, self.storage_level)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()

# Parameters used against the driver's TESTDATA tables: orders end on
# 2001-08-01 and events cover January 2024, so both recency clocks and the app
# thresholds are rescaled.
TESTDATA = Params(
    service_as_of=dt.date(2001, 8, 1),
    app_as_of=dt.date(2024, 1, 31),
    app_high_days=4,
    app_medium_days=2,
)
