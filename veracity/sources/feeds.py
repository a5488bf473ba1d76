"""Declarative feed mappings: how each raw feed maps onto the unified record.

A mapping is data, not code: target column -> source column, constant
tags and defaults.  ``operators.unify`` turns a mapping into one
``select``, so every feed stays a plain projection over its scan and
Catalyst prunes the columns it does not use.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeedMapping:
    """How one raw feed becomes the unified record.

    ``columns``: target -> source column (absent source columns are
    treated as missing).  ``constants``: target -> literal that always
    wins (a source tag).  ``defaults``: target -> literal used where the
    value is null or the column is missing.  ``surrogate_user_id``: give
    the row a generated id instead of ``columns['user_id']``.
    ``match``: file-name substring that selects this mapping (directory
    scans).
    """

    name: str
    columns: dict = field(default_factory=dict)
    constants: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)
    surrogate_user_id: bool = False
    # Generated id only where the user_id column is absent, as prefix+id.
    surrogate_if_missing: str | None = None
    match: str | None = None
    file: str | None = None


# --- fixed values: column names and tags of the reference's raw feeds ---
# Loader mappings (one file per feed).
TRANSACTIONS = FeedMapping(
    "transactions",
    columns={"user_id": "user_id", "amount": "purchase_amount",
             "city": "city", "timestamp": "timestamp"},
    constants={"source_id": "transactions"},
    file="transactions.csv", match="transactions")
ECOMMERCE = FeedMapping(
    "ecommerce",
    columns={"user_id": "order_id", "amount": "order_value",
             "city": "location", "timestamp": "order_date"},
    constants={"source_id": "ecommerce"},
    file="multi_source/ecommerce_data.csv", match="ecommerce")
SUBSCRIPTION = FeedMapping(
    "subscription",
    columns={"user_id": "user_uuid", "amount": "monthly_billing",
             "city": "city_name", "timestamp": "created_at"},
    constants={"source_id": "subscription"},
    file="multi_source/subscription_data.csv", match="subscription")
TAXI = FeedMapping(
    "taxi",
    columns={"user_id": "passenger_id", "amount": "fare_amount",
             "city": "pickup_location", "timestamp": "trip_timestamp"},
    constants={"source_id": "taxi"},
    file="multi_source/taxi_data.csv", match="taxi")
LOADER_MAPPINGS = (TRANSACTIONS, ECOMMERCE, SUBSCRIPTION, TAXI)

# Strict preparation: city defaulted to "unknown" (ecommerce,
# subscription) or the constant "NYC" (taxi); ecommerce rows get a
# generated user id; transactions get one only when user_id is absent.
STRICT_MAPPINGS = (
    FeedMapping("transactions",
                columns={"user_id": "user_id", "amount": "purchase_amount",
                         "city": "city", "timestamp": "timestamp"},
                constants={"source_id": "transactions"},
                surrogate_if_missing="", match="transactions"),
    FeedMapping("ecommerce",
                columns={"amount": "order_value", "city": "location",
                         "timestamp": "order_date"},
                constants={"source_id": "ecommerce"},
                defaults={"city": "unknown"}, surrogate_user_id=True,
                match="ecommerce"),
    FeedMapping("subscription",
                columns={"user_id": "user_uuid", "amount": "monthly_billing",
                         "city": "city_name", "timestamp": "created_at"},
                constants={"source_id": "subscription"},
                defaults={"city": "unknown"}, match="subscription"),
    FeedMapping("taxi",
                columns={"user_id": "passenger_id", "amount": "fare_amount",
                         "timestamp": "trip_timestamp"},
                constants={"source_id": "taxi", "city": "NYC"},
                match="taxi"),
)

# Permissive preparation (lower-cased headers, picked by file name).
PERMISSIVE_MAPPINGS = (
    FeedMapping("ecommerce",
                columns={"user_id": "customer_id", "amount": "purchase_amount",
                         "timestamp": "purchase_time", "city": "location"},
                constants={"source_id": "ecommerce"}, match="ecommerce"),
    FeedMapping("subscription",
                columns={"user_id": "subscriber_id", "amount": "monthly_fee",
                         "timestamp": "signup_date"},
                constants={"source_id": "subscriptions", "city": "unknown"},
                match="subscription"),
    FeedMapping("taxi",
                columns={"user_id": "user_id", "amount": "fare_amount",
                         "timestamp": "pickup_time", "city": "pickup_location"},
                constants={"source_id": "taxi"},
                surrogate_if_missing="T", match="taxi"),
    FeedMapping("transactions",
                columns={"user_id": "user_id",
                         "amount": ("transaction_amount", "purchase_amount"),
                         "timestamp": ("transaction_time", "timestamp"),
                         "city": "city"},
                constants={"source_id": "transactions"},
                defaults={"city": "unknown"}, match="transactions"),
)
PERMISSIVE_UNKNOWN_TAG = "unknown"
PERMISSIVE_MISSING_PREFIX = "missing_"
# Ad-hoc uploads: default tag, default texts, the amount placeholder and
# the column names never taken as the amount.
ADHOC_SOURCE = "user_upload"
ADHOC_TEXT_DEFAULT = "unknown"
ADHOC_NO_AMOUNT = -999.0
ADHOC_ID_NAMES = ("id", "index", "idx")
# --- end of fixed values ---


def mapping_for_file(path: str, mappings=PERMISSIVE_MAPPINGS
                     ) -> FeedMapping | None:
    """The first mapping whose ``match`` occurs in the file name."""
    name = path.rsplit("/", 1)[-1]
    for m in mappings:
        if m.match and m.match in name:
            return m
    return None
