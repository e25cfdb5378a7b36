"""What every source tells of a device in one shape: an observation is a row with addresses, identity and evidence, in the order of arrival (authority, file, record)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources in the order in which their word counts.
AUTHORITY = {"pcap": 0, "nmap": 1, "zeek": 2, "probe": 3}
ADDRESSES = ["ipv4", "ipv6", "mac", "hostname"]
IDENTITY = ["vendor_raw", "product_raw", "family", "model", "catalog_number", "firmware_raw", "hardware_rev", "serial"]
TEXTS = [*ADDRESSES, *IDENTITY, "role", "protocol", "endpoint"]
SERVICE = "authority int, file string, record long, source string, addr string, port int, transport string, protocol string, banner string, first_seen timestamp, last_seen timestamp"
FLOW = "authority int, file string, record long, source string, src_addr string, dst_addr string, port int, transport string, protocol string, packets long, bytes long, first_seen timestamp, last_seen timestamp"


def blank(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def with_address(c: Column) -> dict[str, Column]:
    """An IP as the columns ipv4 and ipv6."""
    return {"ipv4": F.when(~F.contains(c, F.lit(":")), c), "ipv6": F.when(F.contains(c, F.lit(":")), c)}


def observed(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """df (with file, record, seen) as observations of a source; columns not given are null. Rows without evidence (fields, notes, response) tell addresses and identity alone."""
    text = lambda c: blank(columns[c]) if c in columns else F.lit(None).cast("string")
    fields = F.map_filter(columns["fields"], lambda k, v: F.coalesce(v != "", F.lit(False))) if "fields" in columns else F.lit(None).cast("map<string,string>")
    return df.select(
        F.lit(AUTHORITY[source]).alias("authority"), "file", F.col("record_no").cast("long").alias("record"), F.lit(source).alias("source"), "seen", *(text(c).alias(c) for c in TEXTS),
        F.when(F.size(fields) > 0, fields).alias("fields"), columns.get("notes", F.array().cast("array<string>")).alias("notes"), columns.get("response", F.lit(None).cast("binary")).alias("response"),
    )


def shaped(df: DataFrame, shape: str, source: str) -> DataFrame:
    """df with the columns of SERVICE or FLOW; those it lacks are null."""
    given = set(df.columns)
    made = {"authority": F.lit(AUTHORITY[source]), "source": F.lit(source)}
    pick = lambda n, t: (made[n] if n in made else F.col(n) if n in given else F.lit(None)).cast(t).alias(n)
    return df.select(*(pick(*c.split()) for c in shape.split(", ")))
