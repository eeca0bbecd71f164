"""Triples of a stream of rows (an extension): each micro-batch's rows become triples as
they arrive; late duplicates within the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.functions.terms import RDF_TYPE, template


def event_triples(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(s, p, o, ts) of events: class by type, and the user link; works on streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    cells = F.array(
        F.struct(F.lit(RDF_TYPE).alias("p"), F.concat(F.lit(":"), "event_type").alias("o")),
        F.struct(F.lit(":byUser").alias("p"), template(":customer/{user_id}").alias("o")),
    )
    t = rows.select(template(":event/{event_id}").alias("s"), F.explode(cells).alias("t"), "ts").select("s", "t.*", "ts").where("o is not null")
    return t.dropDuplicatesWithinWatermark(["s", "p", "o"]) if events.isStreaming else t.dropDuplicates(["s", "p", "o"])
