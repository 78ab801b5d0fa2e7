"""What the review of round 3 found: each would have failed before."""

import duckdb

from orrery.plans.registry import ORACLES, QUERIES
from tests.test_oracles import rows


def agrees(spark, folder, name, **tables):
    """A query and its SQL on tables given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLES[name]).df()
    assert len(want) and rows(got) == rows(want)
    return got


def test_all_directors(spark, tmp_path):
    lines = "select 1::bigint as l_orderkey, i::int as l_linenumber, (i % 17)::bigint as l_suppkey, (i % 7 + 0.5)::double as l_quantity, case when i % 4 < 3 then 'R' else 'A' end as l_returnflag from range(40) r(i)"
    got = agrees(spark, tmp_path, "o11_directors", lineitem=lines)
    assert len(got["directors"][0].split(",")) == 30


def test_plain_text_resolves_what_its_sql_resolves(spark, tmp_path):
    pages = """select row_number() over () as page_id, html from (values ('<p>a&&&amp</p> b&amp'), ('x &lt y &copy 2'), ('&amp;lt; &amp;amp;'), ('&eacute;&#233; &hellip;'), ('a&nbsp;b' || chr(160) || 'c' || chr(8195) || 'd'),
      ('e' || chr(11) || 'f' || chr(9) || chr(10) || 'g'), ('<br>'), (''), (null), ('1 &lt;b&gt; 2 < 3'), ('&middot;&quot;&#39;&apos;')) t(html)"""
    agrees(spark, tmp_path, "x7_plain_text", pages=pages)


def test_queries_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from orrery.operators import similarity

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    for measure in ("cosine", "euclid"):
        plan = similarity.nearest(rows, F.col("vec_id") % 5 == 0, 3, measure)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [cell" in plan


def test_medians_leave_their_histograms_in_spark(spark, monkeypatch):
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    from orrery.operators import kernels

    x = np.random.default_rng(3).normal(size=(90, 5))
    rows = spark.createDataFrame([("a", i, 90, 3, i % 3, 1.0, [float(v) for v in x[i]]) for i in range(90)], "axis string, i long, n long, folds long, fold long, value double, embedding array<double>")
    blocks, seen, collect = kernels._blocks(rows, 20), [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: 1 / 0)
    found = kernels._medians(blocks, {"a": 3})["a"]
    assert max(map(len, seen)) <= 6
    for f in range(3):
        rest = x[np.arange(90) % 3 != f]
        far = kernels.distances(rest, rest)
        np.fill_diagonal(far, 0)
        assert abs(found[f] - np.median(far[far > 0])) < 1e-12


def test_a_spelling_is_folded_once(spark):
    from pyspark.sql import functions as F

    from orrery.operators import diagnostics

    genres = spark.range(900).select(F.col("id").alias("work"), F.element_at(F.array(F.lit("Féerie"), F.lit("feerie"), F.lit("Noir"), F.lit("clair"), F.lit(None)), (F.col("id") % 5 + 1).cast("int")).alias("genre"))
    found = diagnostics.orphan_genres(genres, spark.createDataFrame([("a", "NOIR")], "axis string, genre string"))
    assert [tuple(r) for r in found.collect()] == [("feerie", 360), ("clair", 180)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("ArrowEvalPython [_folded", plan.index("Join Inner"))  # the fold of the works' genres stands over an aggregate of spellings
    assert plan[at:].split("\n")[1].strip(" :+-|").startswith("Aggregate [genre")


def test_words_of_many_texts_at_once():
    from orrery.sources import search_index

    texts = ["", "The the END", "Œuvre d'été, ÉTÉ été straße ﬁn ½ x²", "  ", "a", "a1 b2 a1", "日本 ǅ İstanbul ΑΣ", "x ý̈z" * 40, ""]
    rows, tokens, places = search_index.word_places([search_index._folded_bytes(t) for t in texts])
    got = sorted(zip(rows.tolist(), tokens.to_pylist(), places.to_pylist(), strict=True))
    want = {}
    for row, text in enumerate(texts):
        for place, word in enumerate(search_index.words(text)):
            want.setdefault((row, word), []).append(place)
    assert got == sorted((row, word, at) for (row, word), at in want.items())
    assert len(search_index.word_places([b"", b" "])[0]) == 0
