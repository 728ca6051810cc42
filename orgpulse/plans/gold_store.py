"""Gold kept in versioned tables: states per person and day, folded again only for the days that new rows touch.

Dashboards read the tables, so a query costs what its own rows cost. States are sums and counts.
A refresh takes the rows of the touched days from the sources, folds them, and puts the result in
place of what the tables hold of these days; the other days' files stay as they are. Each table is
published in one step, so a dashboard reads a state before or after a refresh, never between.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.operators import gold
from orgpulse.sources import versioned

DAY_FIRST = ["metric_date", "tenant_id", "person_id"]


@dataclass(frozen=True)
class Inputs:
    """What the Gold tables are folded from."""

    employees: DataFrame
    issues: DataFrame
    comms: DataFrame
    participants: DataFrame
    teams: DataFrame
    onedrive: DataFrame
    sharepoint: DataFrame

    def states(self) -> dict[str, DataFrame]:
        comms = gold.comms_states(self.comms, self.participants, self.teams, self.onedrive, self.sharepoint)
        return {"closed": gold.closed_states(self.issues), "comms": comms}

    def days(self) -> DataFrame:
        """Days that these rows (for example those that have arrived since the last refresh) belong to."""
        found = [rows.select("metric_date") for rows in self.states().values()]
        return found[0].union(found[1]).distinct()


class GoldTables:
    """People, closed work and communication as tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        return all(versioned.version(self.spark, f"{self.path}/{name}") for name in ("people", "closed", "comms"))

    def build(self, inputs: Inputs) -> None:
        """Fold everything."""
        versioned.replace(gold.people(inputs.employees), f"{self.path}/people", gold.PERSON)
        for name, states in inputs.states().items():
            versioned.replace(states, f"{self.path}/{name}", DAY_FIRST)

    def refresh(self, inputs: Inputs, days: DataFrame) -> None:
        """Fold the given days (column metric_date) again, from all rows that the sources have of them, and people as a whole."""
        days = days.select(F.col("metric_date").cast("date").alias("metric_date")).distinct()
        touched = days.select(F.col("metric_date").alias("_day"))
        versioned.replace(gold.people(inputs.employees), f"{self.path}/people", gold.PERSON)
        for name, states in inputs.states().items():
            fresh = states.join(touched, states.metric_date.eqNullSafe(touched["_day"]), "left_semi")
            versioned.replace_groups(fresh, f"{self.path}/{name}", DAY_FIRST, days)

    def people(self) -> DataFrame:
        return versioned.read(self.spark, f"{self.path}/people")

    def closed(self) -> DataFrame:
        return gold.closed_of(versioned.read(self.spark, f"{self.path}/closed"))

    def comms(self) -> DataFrame:
        return gold.comms_of(versioned.read(self.spark, f"{self.path}/comms"))
