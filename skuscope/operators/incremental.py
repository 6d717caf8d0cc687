"""Change events fed day by day: a day costs a day, not the history.

The state is the last snapshot of each offer. A feed looks up the offers of its rows in the
state, takes the differences, and publishes the events and the new state as versions of a
warehouse; the state names the events that belong to it and is published last, so a feed
that fails halfway adds nothing. Rows no younger than the state of their offer are late: their
offers are judged anew over their whole history, and the events they had are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Warehouse
from .snapshots import KEY, WATCHED, change_events

STATE, DAYS, REDONE = "event_state", "event_days", "event_redone"


def last_rows(rows: DataFrame) -> DataFrame:
    """The last snapshot of each offer, by a map-side maximum."""
    held = [*WATCHED, "snapshot_date"]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*held), "snapshot_date").alias("x")).select(*KEY, *[f"x.{c}" for c in held])


def new_events(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Events of ``rows`` given the last snapshots before them; only the state of their offers is met."""
    held = [*KEY, *WATCHED, "snapshot_date"]
    before = state.select(*held).join(rows.select(*KEY).distinct(), KEY, "left_semi")
    return change_events(before.unionByName(rows.select(*held)))  # a state row is the first of its offer, so it has no event itself


def late_offers(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Offers with a row that is no younger than their state."""
    first = rows.groupBy(*KEY).agg(F.min("snapshot_date").alias("first"))
    return first.join(state.select(*KEY, F.col("snapshot_date").alias("seen")), KEY).filter("first <= seen").select(*KEY)


class EventFeed:
    """Events of a warehouse's feeds. ``history`` gives all rows fed so far and is read for late offers only."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse = warehouse

    def state(self) -> DataFrame | None:
        pin = self.warehouse.pin()
        return pin.read(STATE) if STATE in pin.versions else None

    def feed(self, rows: DataFrame, history: DataFrame | None = None) -> str:
        """Adds the rows of one or more days; returns the run that published the state."""
        state, feeds = self.state(), self._feeds()
        number = len(feeds)
        tell = F.lit(number).alias("feed")
        if state is None:
            days = self.warehouse.publish(DAYS, lambda pin: change_events(rows).select("*", tell))
            return self.warehouse.publish(STATE, lambda pin: last_rows(rows), "country_code", {"events": days, "redone": None})
        late = late_offers(state, rows)
        redone = None
        if not late.isEmpty():
            if history is None:
                raise ValueError("some rows are older than what their offers were fed before; their history is needed")
            redone = self.warehouse.publish(REDONE, lambda pin: late.select("*", tell))
            late = self.warehouse.spark.read.parquet(self.warehouse.path(REDONE, redone)).select(*KEY)
        held = [*KEY, *WATCHED, "snapshot_date"]

        def events(pin) -> DataFrame:
            if redone is None:
                return new_events(state, rows).select("*", tell)
            whole = history.select(*held).unionByName(rows.select(*held)).join(late, KEY, "left_semi")
            return new_events(state.join(late, KEY, "left_anti"), rows.join(late, KEY, "left_anti")).unionByName(change_events(whole)).select("*", tell)

        days = self.warehouse.publish(DAYS, events)
        return self.warehouse.publish(STATE, lambda pin: last_rows(state.unionByName(rows.select(*KEY, *WATCHED, "snapshot_date"))), "country_code", {"events": days, "redone": redone})

    def _feeds(self) -> list[dict]:
        """Each complete feed's runs, oldest first (a row a feed reaches the driver)."""
        done = self.warehouse.runs().filter((F.col("stage") == STATE) & (F.col("status") == "success"))
        return [json.loads(r["metadata"]) for r in done.orderBy("started_at", "run_id").select("metadata").collect()]

    def events(self) -> DataFrame:
        """All events, without those of offers that a later feed has judged anew."""
        feeds, spark = self._feeds(), self.warehouse.spark
        if not feeds:
            raise LookupError("nothing was fed")
        found = spark.read.parquet(*[self.warehouse.path(DAYS, f["events"]) for f in feeds])
        again = [self.warehouse.path(REDONE, f["redone"]) for f in feeds if f["redone"]]
        if again:
            last = spark.read.parquet(*again).groupBy(*KEY).agg(F.max("feed").alias("since"))
            found = found.join(last, KEY, "left").filter("since is null or feed >= since").drop("since")
        return found.drop("feed")
