"""auditframe: ledger validation, input profiling, contract lifecycles and reconciliation on Spark DataFrames."""
