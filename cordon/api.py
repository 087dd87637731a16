"""The whole of it for callers: scan, report, filter, check_text and guard_stream from one configuration."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.plain import Detectors
from .operators import detectors, guard, report
from .plans.rules import Config, Policy, Rules
from .sources import text as sources
from .streaming.guard_stream import StreamGuard, guard_stream

#: The fingerprint key's environment variable, where none is passed.
KEY_VARIABLE = "CORDON_HMAC_KEY"
log = logging.getLogger(__name__)


@dataclass
class Guarded:
    """A configuration and an audience, ready to run over DataFrames with doc_id and text."""

    config: Config
    policy: Policy
    hmac_key: bytes | None = None
    corsica: str = "double"

    @classmethod
    def load(cls, config: str | Config | None = None, audience: str | None = None, rules: Rules | None = None, hmac_key: bytes | None = None, notice: bool = True) -> Guarded:
        own = config if isinstance(config, Config) else Config.load(config)
        key = hmac_key if hmac_key is not None else (os.environ[KEY_VARIABLE].encode() if KEY_VARIABLE in os.environ else None)
        if notice:
            log.warning("local rules only: categories that need a model are not checked")
        return cls(own, own.policy(audience, rules), key)

    def _options(self) -> dict:
        return {"sizes": self.config.sizes, "allow": self.config.allow, "custom": self.config.identifiers, "hmac_key": self.hmac_key, "corsica": self.corsica}

    def scan(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Detections in whole texts, without windows and policy."""
        return detectors.scan(df, text, None, self.config.allow, self.config.identifiers, self.corsica)

    def findings(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        return guard.findings(df, self.policy, text, key, **self._options())

    def report(self, df: DataFrame, text: str = "text", key: str = "doc_id", fail_on_warn: bool = False) -> tuple[DataFrame, DataFrame]:
        """(lines, summary) of all findings."""
        found = self.findings(df, text, key).persist()
        return report.lines(found, df, text, key), report.summary(found, df, self.policy.audience, key, fail_on_warn)

    def filter(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
        """(released, findings): what may pass on, and the findings up to where it stops."""
        found = self.findings(df, text, key).persist()
        return guard.released(df, found, text, key), guard.filter_findings(found, key)

    def stream(self, chunks: DataFrame, mode: str = "filter", format: str = "raw") -> DataFrame:
        sources.checked_format(format)
        return guard_stream(chunks, self.policy, mode, **self._options())

    def guard(self, mode: str = "filter") -> StreamGuard:
        """One stream's guard in this process, with push and finish."""
        return StreamGuard.of(self.policy, Detectors(self.config.allow, self.config.identifiers, self.corsica), sizes=self.config.sizes, mode=mode, hmac_key=self.hmac_key)

    def check_text(self, spark: SparkSession, text: str) -> tuple[str, int]:
        """The report of one string for people, and its exit code."""
        df = spark.createDataFrame([(0, text)], "doc_id long, text string")
        lines, summary = self.report(df)
        said = [r.line for r in lines.orderBy("start", "end", "ord").collect()]
        end = summary.first()
        return "\n".join([*said, end.summary]), end.exit_code
