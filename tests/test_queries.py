import pytest

from tessera import library_queries, queries
from tests.oracle import same


assert library_queries  # registers its queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_greedy_dedup_against_a_plain_model(spark, sf):
    from tessera.functions.present import overlap
    from tessera.plans.search import drop_near_copies

    rows = queries.ranked_pages(spark, sf)
    want = []
    by_path = {}
    for r in sorted(rows.collect(), key=lambda r: (r["path"], -r["score"], r["unit_key"])):
        kept = by_path.setdefault(r["path"], [])
        flat = lambda x: "".join(x["snippet"].split()).lower()
        if not any(overlap(r["body"], k["body"]) >= 0.45 or (r["label"] and flat(r) and r["label"] == k["label"] and flat(r) == flat(k)) for k in kept):
            kept.append(r)
            want.append((r["path"], r["unit_key"]))
    got = drop_near_copies(rows).select("path", "unit_key").collect()
    assert sorted(map(tuple, got)) == sorted(want)
