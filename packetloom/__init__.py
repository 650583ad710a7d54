"""Network-telemetry queries and sketch estimators as Spark DataFrame operators."""

EPOCH = "epoch_id"
SEQ = "seq"
