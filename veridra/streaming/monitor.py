"""Rules over a stream: each micro-batch is counted against them and the counts are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import rule_violations


def monitor_rules(stream: DataFrame, rules: list[str], path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends (batch_id, rule, violations) as Parquet; a batch that is run again overwrites its own folder."""

    def check(batch: DataFrame, batch_id: int) -> None:
        rule_violations(batch, rules).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
