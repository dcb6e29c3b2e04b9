"""Addresses and networks as tables: first matching network in declared order, by range join.

Addresses are 32 hexadecimal digits (128 bits), so that text order is address order; IPv4 has 24 leading zeros in a table of its
own family.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Networks that must not be reached, in the order in which they are tried.
DENIED = (
    ("0.0.0.0/8", "ssrf.unspecified"), ("10.0.0.0/8", "ssrf.private"), ("100.64.0.0/10", "ssrf.cgnat"), ("127.0.0.0/8", "ssrf.loopback"),
    ("169.254.0.0/16", "ssrf.link_local"), ("172.16.0.0/12", "ssrf.private"), ("192.0.0.0/24", "ssrf.protocol_assignments"),
    ("192.0.2.0/24", "ssrf.documentation"), ("192.168.0.0/16", "ssrf.private"), ("198.18.0.0/15", "ssrf.benchmarking"),
    ("198.51.100.0/24", "ssrf.documentation"), ("203.0.113.0/24", "ssrf.documentation"), ("224.0.0.0/4", "ssrf.multicast"), ("240.0.0.0/4", "ssrf.reserved"),
    ("::/128", "ssrf.unspecified"), ("::1/128", "ssrf.loopback"), ("100::/64", "ssrf.discard"), ("2001:db8::/32", "ssrf.documentation"),
    ("fc00::/7", "ssrf.unique_local"), ("fe80::/10", "ssrf.link_local"), ("ff00::/8", "ssrf.multicast"),
)


NETWORKS = "ord int, family int, lo string, hi string, rule string"


def is_network(text: str) -> bool:
    """Whether a text is a network or an address."""
    try:
        ipaddress.ip_network(text, strict=False)
    except ValueError:
        return False
    return True


def network_rows(rules: list[tuple[str, str]]) -> list[tuple[int, int, str, str, str]]:
    """(ord, family, lo, hi, rule) of (network, rule), in order. A bare address is a network of one; bad ones raise."""
    rows = []
    for n, (text, rule) in enumerate(rules):
        net = ipaddress.ip_network(text, strict=False)
        rows.append((n, net.version, f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}", rule))
    return rows


def deny_rows(extra: tuple[str, ...] = ()) -> list[tuple[int, int, str, str, str]]:
    """The fixed networks, then configured ones."""
    return network_rows([*DENIED, *[(x, "ssrf.deny_extra") for x in extra]])


def deny_table(spark: SparkSession, extra: tuple[str, ...] = ()) -> DataFrame:
    return spark.createDataFrame(deny_rows(extra), NETWORKS)


def ipv4_hex(number: Column) -> Column:
    """An IPv4 address given as a number, as 32 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(number)), 32, "0")


def unwrapped(family: Column, digits: Column) -> tuple[Column, Column]:
    """(family, digits) of the IPv4 address that an IPv6 address carries (mapped, NAT64, 6to4), else of the address itself."""
    carried = (F.when(digits.startswith("00000000000000000000ffff"), F.substring(digits, 25, 8))
               .when(digits.startswith("0064ff9b0000000000000000"), F.substring(digits, 25, 8))
               .when(digits.startswith("2002"), F.substring(digits, 5, 8)))
    inside = (family == 6) & carried.isNotNull()
    return F.when(inside, F.lit(4)).otherwise(family), F.when(inside, F.lpad(carried, 32, "0")).otherwise(digits)


def classify(addresses: DataFrame, networks: DataFrame, key: str, family: str = "family", digits: str = "digits") -> DataFrame:
    """(key, rule) of the distinct ``key`` values whose address is in a network: the first in declared order.

    Networks are spread over the first 16 bits of their addresses, so this is a hash join whatever their number; Spark broadcasts the
    networks if they are small. ``key`` must determine the address.
    """
    own_family, own_digits = unwrapped(F.col(family), F.col(digits))
    rows = addresses.select(key, own_family.alias("_family"), own_digits.alias("_digits"))
    first = lambda family, digits: F.conv(F.when(family == 4, F.substring(digits, 25, 4)).otherwise(F.substring(digits, 1, 4)), 16, 10).cast("int")
    spread = networks.withColumn("_first", F.explode(F.sequence(first(F.col("family"), F.col("lo")), first(F.col("family"), F.col("hi")))))
    rows = rows.withColumn("_head", first(F.col("_family"), F.col("_digits")))
    hits = rows.join(spread, (F.col("_family") == F.col("family")) & (F.col("_head") == F.col("_first")) & F.col("_digits").between(F.col("lo"), F.col("hi")))
    return hits.groupBy(key).agg(F.min_by("rule", "ord").alias("rule"))
