import os

import pytest

from quotemill.jobs import JOBS, main
from tests.helpers import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("job,table,columns", [("indicators", "indicators", {"sma_50", "rsi", "adx"}), ("signals", "signals", {"sentiment", "events"}), ("sentiment", "sentiment", {"conviction", "as_of"}), ("report", "report", {"sharpe", "benchmark_return"})])
def test_job(spark, tmp_path, job, table, columns):
    main([job, "--data", DATA, "--out", str(tmp_path)])
    path = str(tmp_path / table)
    df = spark.read.option("header", True).csv(path) if job == "report" else spark.read.json(path) if job == "sentiment" else spark.read.parquet(path)
    assert df.count() > 0 and columns <= set(df.columns)
    assert set(JOBS) == {"indicators", "signals", "sentiment", "report"}


def test_options(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("QUOTEMILL_DATA", DATA)
    main(["sentiment", "--out", str(tmp_path), "--tickers", "qzar", "--lookback-hours", "72"])
    assert [r.ticker for r in spark.read.json(str(tmp_path / "sentiment")).collect()] == ["QZAR"]
    assert all(line.startswith("QZAR ") for line in capsys.readouterr().out.splitlines())
    main(["report", "--out", str(tmp_path), "--months", "3", "--tickers", "QZAR"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert len(rows) == 1 and 30 < int(rows[0].bars) < 80
    with pytest.raises(SystemExit):
        main(["report", "--months", "0"])
