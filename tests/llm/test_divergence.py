"""The divergence audit beside its SQL, and on odd rows."""

import random

import duckdb
import pytest

from prismloom.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def by_sql(docs, least):
    documents = docs.select("text", "lang", "source").toPandas()  # noqa: F841  read by name
    connection = duckdb.connect()
    connection.register("documents", documents)
    return sorted(map(tuple, connection.sql(divergence.ORACLE.replace(f">= {divergence.LEAST}", f">= {least}")).df()[COLUMNS].itertuples(index=False)))


def found(docs, least):
    return sorted(tuple(r) for r in divergence.audit(docs, least).select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def many(spark):
    draw = random.Random(12)
    words = ["the", "The", "été", "ÉTÉ", "a", "z9z", "x-y", "日本", "of", "quay"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(400):
        source = f"s{min(int(draw.expovariate(0.6)), 6)}"
        shift = int(source[1]) * 3
        text = " ".join(words[min(int(draw.expovariate(0.15)) + shift, 29)] for _ in range(draw.randrange(30)))
        rows.append((k, text, draw.choice(["en", "fr", None]), source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("least", [3, 30, 10_000])
def test_audit_equals_sql(many, least):
    assert found(many, least) == by_sql(many, least)


def test_counts_handed_over_early_combine(many, monkeypatch):
    before = found(many, 3)
    monkeypatch.setattr(divergence, "HELD", 1)
    assert found(many.repartition(5), 3) == before


def test_odd_rows(odd_docs, no_docs):
    rows = found(odd_docs, 1)
    assert rows == by_sql(odd_docs, 1)
    assert {r[0] for r in rows} == {"", "en"}
    assert found(no_docs, 1) == []


def test_a_language_without_terms_has_pairs_of_value_zero(spark):
    docs = spark.createDataFrame([(1, "12 34", "en", "a"), (2, None, "en", "b"), (3, "", None, None)], "doc_id long, text string, lang string, source string")
    assert found(docs, 1) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_ties_go_by_item_in_utf8(spark):
    docs = spark.createDataFrame([(1, "ﬀ 𐐀 b a", "en", "s"), (2, "c", "en", "t")], "doc_id long, text string, lang string, source string")
    assert [r[3] for r in sorted(found(docs, 1), key=lambda r: (r[1], r[2], r[5])) if r[1] == "s" and r[2] == "term"] == ["a", "b", "ﬀ", "𐐀"]


def test_counts_beyond_long_products(spark):
    row = spark.createDataFrame([(20_000_000_000, 90_000_000_000, 7)], "n long, total long, terms long")
    assert row.select(divergence._probability("n", "total", "terms")).first()[0] == 1 + 10**9 * 20_000_000_005 // (90_000_000_000 + 35)
