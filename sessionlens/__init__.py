"""sessionlens: agent-session event logs to facts, findings and rate comparisons, on Spark."""
