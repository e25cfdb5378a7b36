"""What services tell, over streams: the state of each service lives in the state store, so a restart goes on where it was.

State of a service (file, server, port, transport): the bytes that a truncated response still needs, as one value, and
the names of fields that it has shown, as a map. Needs Spark's RocksDB state store (see `state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fenwatch.sources.captures import names_of, taken
from fenwatch.sources.decoders import BY_PORT, DECODED, as_row

KEYS = ["file", "server", "port", "transport"]
RESPONSES = "file string, server string, port int, transport string, packet long, ts timestamp, payload binary"
REASSEMBLED = f"file string, server string, port int, transport string, packet long, ts timestamp, by_content boolean, {DECODED}"


def state_store(spark: SparkSession) -> None:
    """Chooses the state store that arbitrary state needs, for streams that start later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Reassembly(StatefulProcessor):
    """Joins a service's payloads while a decoder calls them truncated, and tells what brings a new field's name, as the batch operator does."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "payload binary", self.ttl_ms)
        self.known = handle.getMapState("known", "name string", "packet long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values("packet", kind="stable")  # a service's payloads of one trigger
        held = self.held.get()[0] if self.held.exists() else b""
        known = {k[0] for k in self.known.keys()} if self.known.exists() else set()
        was, out = set(known), []
        for packet, ts, payload in zip(batch["packet"], batch["ts"], batch["payload"], strict=True):
            held, verdict, seen = taken(held, bytes(payload), int(key[2]))
            if seen is None:
                continue
            told = names_of(seen)
            if told <= known and known:
                continue
            for name in told - known:
                self.known.updateValue((name,), (int(packet),))
            known |= told
            row = dict.fromkeys(["verdict", "protocol", "error_code", "error", "role", "fields", "identity", "notes"]) | as_row(verdict, seen)
            out.append(dict(zip(KEYS, key, strict=True)) | {"packet": packet, "ts": ts, "by_content": int(key[2]) not in BY_PORT} | row | {c: dict(row[c]) for c in ("fields", "identity")})
        if held:
            self.held.update((held,))
        elif self.held.exists():
            self.held.clear()
        if out:
            yield pd.DataFrame(out).astype({"error_code": "Int32"})

    def close(self) -> None:
        pass


def reassembled(responses: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of responses (columns of RESPONSES) as REASSEMBLED, equal to reassemble_responses over all of it if a service's packets come in order over triggers.

    ttl_ms: how long a service's state may lie untouched, in processing time; None keeps it.
    """
    return responses.groupBy(*KEYS).transformWithStateInPandas(Reassembly(ttl_ms), REASSEMBLED, "append", "processingTime" if ttl_ms else "none")
