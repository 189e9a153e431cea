"""Reports composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.operators.summary import breakdowns, top_per_dimension
from dnslens.operators.threat import score_events
from dnslens.session import cut_lineage


def threat_report(events: DataFrame, top: int = 8) -> DataFrame:
    """Events per threat level and the most queried names: ``(section, value, events)``."""
    broken = cut_lineage(breakdowns(events, ("threat_level", "domain")))  # read twice below
    levels = broken.filter(F.col("dimension") == "threat_level")
    names = top_per_dimension(broken.filter(F.col("dimension") == "domain"), top)
    return levels.unionByName(names).select(F.col("dimension").alias("section"), "value", "events")


def host_threats(hosts: DataFrame) -> DataFrame:
    """Scores of bare host names, as if queried by ``A`` without an error."""
    asked = hosts.withColumns({"record_type": F.lit("A"), "rcode": F.lit("NOERROR")})
    return score_events(asked).drop("record_type", "rcode")
