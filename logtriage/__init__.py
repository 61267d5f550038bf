"""logtriage: CI/CD log triage as Spark DataFrame operators."""

__version__ = '0.1.0'
