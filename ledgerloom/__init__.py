"""Bank-to-ledger reconciliation and corpus preparation on Apache Spark."""
