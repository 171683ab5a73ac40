import os

import pytest

from quotemill.llm.queries import QUERIES, SQL
from tests.helpers import DATA, rows, views

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(views().sql(SQL[name]).df())


def test_the_mix_of_the_tables_has_its_shares(spark):
    """Every source that has documents comes to its share of what the present sources are due, to a document or two; none is used more often than it may."""
    got = [r for r in QUERIES["p9_shares"](spark, DATA).collect()]
    targets = {r.source: r for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}
    present = sum(r.target_share for r in got if r.source_tokens)
    total = sum(r.mixed_tokens for r in got)
    longest = QUERIES["p8_lengths"](spark, DATA).agg({"n_tokens": "max"}).first()[0]
    assert {r.source for r in got} == set(targets) and sum(r.sets_budget for r in got) == 1
    for r in got:
        if r.source_tokens:
            assert abs(r.mixed_tokens - total * r.target_share / present) <= 2 * longest and 1 <= r.most_uses <= targets[r.source].max_repeats
        else:
            assert r.mixed_tokens == 0
    mix = QUERIES["p9_mix"](spark, DATA)
    uses = mix.groupBy("doc_id", "source").count().collect()
    assert all(r["count"] <= targets[r.source].max_repeats for r in uses) and mix.agg({"n_tokens": "sum"}).first()[0] == total


def test_all_that_is_asked_for_is_mixed_or_used_up(spark):
    got = QUERIES["p9_all"](spark, DATA).collect()
    assert all(r.mixed_tokens <= r.source_tokens * r.max_repeats for r in got) and any(r.mixed_tokens > r.source_tokens for r in got)
    assert not any(r.sets_budget for r in got)


def test_lengths_are_those_of_the_ids(spark):
    ids = {r.doc_id: len(r.ids) for r in QUERIES["p8_ids"](spark, DATA).collect()}
    assert ids == {r.doc_id: r.n_tokens for r in QUERIES["p8_lengths"](spark, DATA).collect()}


def test_repeats_of_the_tables_against_one_after_the_other(spark):
    """p1 by its definition, over all rows."""
    import re

    words = lambda t: frozenset(re.findall(r"[^\W_]+", (t or "").lower()))
    there = lambda x: x is not None and x.strip() != ""

    def page(u):
        m = re.match(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#\s]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", u.strip())
        query = sorted(x for x in (m[3] or "").split("&") if re.match(r"(?:id|p)(?:=|$)", x))
        return re.sub(r"^www\.", "", m[1].lower()), re.sub("/$", "", m[2].strip()), tuple(query)

    columns = ["batch_no", "news_id", "headline", "url", "provider", "article_id"]
    old, new = (spark.read.parquet(f"{DATA}/{t}.parquet").select(*columns).collect() for t in ("news", "news_incoming"))
    keys, sets, found = set(), [], set()
    for k, r in enumerate([*old, *sorted(new, key=lambda r: (r.batch_no, r.news_id))]):
        mine = {("u", page(r.url))} if there(r.url) else set()
        mine |= {("a", r.provider, r.article_id)} if there(r.provider) and there(r.article_id) else set()
        w = words(r.headline)
        if k >= len(old) and (mine & keys or any(len(w & s) * 4 >= len(w | s) * 3 for s in sets if w)):
            found.add(r.news_id)
        else:
            keys |= mine
            sets += [w] if w else []
    assert {r.news_id for r in QUERIES["p1_found"](spark, DATA).collect()} == found and found


def test_every_document_is_kept_or_found(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert QUERIES["p10_found"](spark, DATA).count() + QUERIES["p10_kept"](spark, DATA).count() == docs == QUERIES["p8_ids"](spark, DATA).count()
