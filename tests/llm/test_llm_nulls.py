"""Rows of nothing but nulls go through every operator, and so do tables of only such rows."""

import pytest

from quotemill.llm.bpe import count_tokens, encode_column
from quotemill.llm.mixing import mix_sources
from quotemill.llm.nearest import nearest
from quotemill.llm.residue import residue_marks
from quotemill.llm.segment_index import SegmentIndex, repeats
from quotemill.llm.vptree import classes, expanded_pairs, near_duplicates

NEWS = "news_id long, batch_no int, ticker string, headline string, snippet string, published_at timestamp, url string, provider string, article_id string"
BARS = "bar_id long, ticker string, timestamp timestamp"
DOCS = "doc_id long, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def nulls(spark, kind, n):
    return spark.createDataFrame([(None,) * len(kind.split(","))] * n, kind)


@pytest.mark.parametrize("n", [0, 3])
def test_all_null(spark, tmp_path, n):
    news, bars, docs, targets = (nulls(spark, k, n) for k in (NEWS, BARS, DOCS, TARGETS))
    assert repeats(SegmentIndex.build(news, f"{tmp_path}/index"), news).count() == 0
    members, links = near_duplicates(news)
    assert classes(members, links).count() == 0 and expanded_pairs(members, links).count() == 0
    assert nearest(news, bars).count() == 0
    assert encode_column(docs).count() == n and count_tokens(docs).count() == n
    mix, report = mix_sources(docs, targets)
    assert mix.count() == 0 and report.count() == n
    marks = residue_marks(docs)
    assert marks.count() == n and marks.filter("residue").count() == 0
