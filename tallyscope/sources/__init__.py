"""Reading CSV files and writing result tables."""

from tallyscope.sources.csv import file_info, read_csv
from tallyscope.sources.sinks import write_kpis, write_report, write_results

__all__ = ["file_info", "read_csv", "write_kpis", "write_report", "write_results"]
