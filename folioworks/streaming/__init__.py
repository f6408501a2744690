from .corpus import run_corpus
from .telemetry import TelemetryTables, run_telemetry

__all__ = ["run_corpus", "TelemetryTables", "run_telemetry"]
