from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from potluck.llm.poisson_mix import poisson_mix, poisson_steps, rates


def unit(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson_inverse(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while u >= total:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_follow_the_inverted_distribution(make_docs):
    rows = [(i, f"t{i}", "en", "a" if i % 3 else "b") for i in range(600)]
    weights = {"a": 1.0, "b": 3.0, "unused": 9.0}
    spark_weights = make_docs([]).sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
    got = poisson_mix(make_docs(rows), weights=spark_weights, out_rows=1200, columns=["doc_id", "source"]).collect()
    copies = Counter(r.row.doc_id for r in got)
    per_source = Counter(r[3] for r in rows)
    for i, _, _, source in rows:
        rate = weights[source] / 4 * 1200 / per_source[source]
        assert copies[i] == poisson_inverse(unit("mix-1", i), rate)
    assert {(r.row.doc_id, r.copy) for r in got} == {(i, c) for i in copies for c in range(1, copies[i] + 1)}
    shares = Counter(r.row.source for r in got)
    assert abs(shares["b"] / len(got) - 0.75) < 0.08


def test_order_is_a_global_shuffle(make_docs):
    got = poisson_mix(make_docs([(i, "t", "en", "a") for i in range(300)]), columns=["doc_id"])
    for part in got.select(F.spark_partition_id().alias("p"), "order_key").groupBy("p").agg(
            F.collect_list("order_key").alias("keys")).collect():
        assert part.keys == sorted(part.keys)
    r = got.where("copy = 1").first()
    assert r.order_key == unit("mix-1", r.row.doc_id, 1)


def test_large_and_zero_rates(spark):
    steps = spark.sql("select explode(array(0.0D, 0.3D, 1000.0D)) as r").select("r", poisson_steps(F.col("r")).alias("s"))
    for r in steps.collect():
        assert abs(r.s[-1] - 1) < 1e-9 and r.s == sorted(r.s)
        assert abs(r.s[0] - math.exp(-r.r)) < 1e-12


def test_edge_cases(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    a, b = [Counter(tuple(r.row)[:1] + (r.copy, r.order_key) for r in poisson_mix(d, columns=["doc_id", "text"]).collect())
            for d in (docs, docs.repartition(7))]
    assert a == b and sum(a.values()) > 0
    assert {r.source for r in rates(docs).collect()} == {"a", "b", "c", None}
    nothing = make_docs([]).sparkSession.createDataFrame([("q", 1.0)], "source string, weight double")
    assert poisson_mix(docs, weights=nothing).collect() == []
    assert poisson_mix(make_docs([])).collect() == []
