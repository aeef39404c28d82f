"""Spark-native monitoring of credit-risk scores.

Every operator is a plain ``DataFrame -> DataFrame`` function: calibration,
stability, discrimination, cohort projection, a reporting cube and the table
work around them.  Nothing here keeps global state and no operator collects
data-sized results to the driver.
"""

from scoremon.config import MonitorConfig

__all__ = ["MonitorConfig"]
