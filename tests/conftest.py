import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.schemas import CATALOG  # noqa: E402
from shelfspark.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

DEFAULTS = {
    "product_id": None, "product_name": "p", "category": "A", "brand": "b1", "city": "X", "seller": "s1",
    "packaging_type": "box", "offer_type": None, "price": 100.0, "final_price": 90.0, "discount_pct": 10.0,
    "profit_margin_pct": 20.0, "weight_g": 500.0, "shelf_life_days": 30,
    "date_added": dt.datetime(2023, 3, 1), "expiry_date": dt.datetime(2023, 4, 1),
    "delivery_status": "On-Time", "delivery_time_min": 20, "stock": 10, "sold_quantity": 5,
    "reorder_level": 5, "num_reviews": 10, "demand_index": 50.0, "is_organic": False, "rating": 4.0,
}


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=8, app="shelfspark-tests")
    yield s


@pytest.fixture(scope="session")
def make_catalog(spark):
    def _make(rows):
        full = []
        for i, r in enumerate(rows):
            row = dict(DEFAULTS)
            row["product_id"] = f"id{i:04d}"
            row.update(r)
            full.append(tuple(row[f.name] for f in CATALOG.fields))
        return spark.createDataFrame(full, CATALOG)
    return _make
