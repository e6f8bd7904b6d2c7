"""Small categorical labels derived from one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Devices with an app of their own, and the label of everything else.
APP_DEVICES = ("ios", "android")
WEB = "web"


def device_type(device: Column) -> Column:
    """``ios`` and ``android`` stay, anything else (NULL included) is ``web``."""
    return F.when(device.isin(*APP_DEVICES), device).otherwise(F.lit(WEB))


def user_agent_label(device_kind: Column) -> Column:
    """``<device type>_app`` for app devices, else ``web``."""
    return F.when(device_kind.isin(*APP_DEVICES), F.concat(device_kind, F.lit("_app"))).otherwise(F.lit(WEB))


def md5_bucket(column: Column, buckets: int) -> Column:
    """Stable bucket 0..buckets-1 from the first 32 bits of the MD5 digest; the same on every platform and run."""
    head = F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets)).cast("int")


def md5_advertiser(campaign: Column, advertisers: int = 50) -> Column:
    """Advertiser label ``adv_001`` .. of a campaign, by MD5 bucket."""
    number = md5_bucket(campaign, advertisers) + F.lit(1)
    return F.concat(F.lit("adv_"), F.lpad(number.cast("string"), 3, "0"))
