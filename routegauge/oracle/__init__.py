"""DuckDB SQL for checking the registered queries; built on the raw views, sharing no code with the Spark side."""

from routegauge.oracle.builder import build

__all__ = ["build"]
