"""Choices a user would make on the report pages, shared by queries and SQL."""

from spendscope.functions.conditions import Condition
from spendscope.plans.pruning import Rules

BASE = ("2023-06-01", "2023-06-07")
OTHER = ("2023-06-08", "2023-06-14")
YEAR = ("2023-01-01", "2023-12-01")
SPUS = ("SPU-1", "SPU-7", "SPU-97", "SPU-DUP")
SKUS = tuple(f"SKU-{i}" for i in range(1, 121))
CATEGORIES = ("ECONOMY", "SMALL")
CAMPAIGNS = ("1-URGENT_BUILDING", "2-HIGH_AUTOMOBILE", "5-LOW_MACHINERY")
CONDITION = Condition(all_of=("low|high|urgent",), any_of=("build", "AUTO"), none_of=("^5-",))
# thresholds that divide the families of the given tables
PRUNING = Rules(cost_above=3600.0, gmv_below=2_500_000.0, return_below=680.0, least_skus=9, categories=("Economy",), left_out=("brand#4",))
