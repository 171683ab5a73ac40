"""Row predicates with reasons, and checks of settings."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.columns import blank_to_null

LABELS = ("POSITIVE", "NEGATIVE", "NEUTRAL")
#: A rule is a name and what must be true of a row; null counts as false.
Rules = Mapping[str, Column]


def filled(*columns: str) -> dict[str, Column]:
    """Each column has something in it; of texts, more than blanks."""
    return {c: blank_to_null(F.col(c).cast("string")).isNotNull() for c in columns}


def numeric(*columns: str) -> dict[str, Column]:
    """Each column can be read as a number."""
    return {c: F.col(c).try_cast("double").isNotNull() & ~F.isnan(F.col(c).try_cast("double")) for c in columns}


def within_range(column: str, low: float, high: float) -> dict[str, Column]:
    return {column: F.col(column).try_cast("double").between(low, high)}


def one_of(column: str, values: Sequence[str]) -> dict[str, Column]:
    return {column: F.col(column).isin(*values)}


def article(headline: str = "headline", url: str = "url", at: str = "published_at") -> Rules:
    return filled(headline, url) | {at: F.col(at).isNotNull()}


def item(key: str = "news_id") -> Rules:
    """An article as it is handed to a scorer."""
    return {key: F.col(key).isNotNull(), **filled("ticker", "headline", "source"), "published_at": F.col("published_at").isNotNull()}


def scored_article() -> Rules:
    return filled("ticker") | one_of("sentiment", LABELS) | within_range("conviction", 0.0, 10.0)


def ticker_result() -> Rules:
    """What the articles of a ticker come to."""
    return filled("ticker") | one_of("sentiment", LABELS) | within_range("direction", -1.0, 1.0) | within_range("conviction", 0.0, 10.0) | {"articles": F.col("articles") >= 1}


def market_row() -> Rules:
    """A bar that can be traded on: all fields there, open and close numbers."""
    return filled("ticker") | {c: F.col(c).isNotNull() for c in ("timestamp", "high", "low", "volume")} | numeric("open", "close")


def snapshot(at: str = "published_at") -> Rules:
    """A signal at an instant."""
    return scored_article() | {at: F.col(at).isNotNull()}


def live_market(close: str = "close") -> Rules:
    return filled("ticker") | {"timestamp": F.col("timestamp").isNotNull(), close: F.col(close) > 0}


def message(column: str, values: Sequence[str], *, quantity: str | None = None) -> Rules:
    """A record for another system: a value out of a list, and a whole quantity above zero if there is one."""
    whole = {quantity: (F.col(quantity).try_cast("double") > 0) & (F.col(quantity).try_cast("double") == F.floor(F.col(quantity).try_cast("double")))} if quantity else {}
    return filled("ticker") | one_of(column, values) | whole


def broken(rules: Rules) -> Column:
    """Names of the rules that a row breaks, in their order; empty if none."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def parted(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and the others with `broken`, the names of those they break; nothing is lost and nothing raises."""
    marked = df.withColumn("broken", broken(rules))
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


@dataclass(frozen=True)
class Settings:
    """Settings of the jobs; from the environment where it has them."""

    data: str = ""
    out: str = ""
    tickers: tuple[str, ...] = ()
    benchmark: str = "QZAR"
    months: int = 12
    lookback_hours: int = 24
    period: int = 14
    start: str | None = None
    end: str | None = None
    capital: float = 100_000.0

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None, prefix: str = "QUOTEMILL_", **given) -> "Settings":
        """Values given outweigh those of the environment, and those the defaults; what can't be read raises with its name."""
        env = os.environ if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if given.get(f.name) is not None:
                values[f.name] = given[f.name]
            elif raw:
                default = f.default
                try:
                    values[f.name] = tuple(x.strip().upper() for x in raw.split(",") if x.strip()) if isinstance(default, tuple) else type(default)(raw) if default is not None else raw
                except ValueError as e:
                    raise ValueError(f"{prefix}{f.name.upper()}: {raw!r}") from e
        return cls(**values)

    def problems(self) -> list[str]:
        """Names of the settings that can't be used."""
        wrong = [n for n in ("data", "out") if not getattr(self, n)]
        wrong += [n for n in ("months", "lookback_hours", "period", "capital") if not getattr(self, n) > 0]
        if self.start and self.end and self.start >= self.end:
            wrong.append("start")
        return wrong


def run_settings(tickers: str = "tickers", capital: str = "capital", start: str = "start", end: str = "end") -> Rules:
    """The same for rows that each describe a run."""
    return {tickers: F.coalesce(F.size(tickers), F.lit(0)) > 0, capital: F.col(capital) > 0, start: F.col(start).isNotNull(), end: F.col(end).isNotNull(), "order": F.col(start) < F.col(end)}
