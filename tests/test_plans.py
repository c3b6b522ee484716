"""Plan properties: SQL-only operators stay in the JVM, no single-partition
shuffles outside bounded tiny inputs, filters and columns reach the scan."""

import pytest

from conftest import SMALL
from labelforge.plans.explain import physical_plan, plan_summary
from labelforge.plans.registry import QUERIES, load_all

load_all()

# operators whose work is Python by design (plug-in teachers / encoders, per-batch
# matrix losses, file writers, ML); everything else must have no Python node
PYTHON_BY_DESIGN = ("t1_", "t2_", "t3_", "c1_consensus_from_teachers", "c2_consensus_from_teachers",
                    "v6_", "v7_", "v9_", "v10_", "v12_", "v13_", "j6_", "w3_", "t4_", "v11_", "s4_", "s5_", "s6_",
                    "s3_partition_glob", "a7_trained", "e5_trained", "s13_", "x1_", "j5_", "s19_", "s10_", "t5_", "p18_")
SQL_ONLY = sorted(n for n in QUERIES if not n.startswith(PYTHON_BY_DESIGN))


@pytest.fixture(scope="module")
def no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", SQL_ONLY)
def test_sql_only_operators_have_no_python(no_aqe, name):
    df = QUERIES[name](no_aqe, SMALL)
    s = plan_summary(df)
    assert s["python_nodes"] == 0, (name, s)


@pytest.mark.parametrize("name", ["c1_consensus", "c2_sentence_consensus", "e2_binary_metrics", "t5_explanation_confidence",
                                  "k4_full_token_plan", "p10_split_sentences"])
def test_no_global_single_partition(no_aqe, name):
    # global windows / sorts funnel everything into one task; none of the headline operators may do that
    assert plan_summary(QUERIES[name](no_aqe, SMALL))["unbounded_single_partition"] == 0


def test_running_total_is_not_a_global_window(no_aqe):
    from labelforge.operators.teacher import running_total

    df = no_aqe.range(1000).selectExpr("id % 7 AS f", "id AS r", "1 AS v")
    out = running_total(df, ["f", "r"], "v", partitions=4)
    s = plan_summary(out)
    # rows never meet in one task: the only single-partition step is the window
    # over the per-partition totals (one row per partition), broadcast back
    assert s["unbounded_single_partition"] <= 1 and s["broadcast_exchanges"] >= 1
    assert out.count() == 1000


def test_training_filter_pushed_to_scan(no_aqe, tmp_path):
    from labelforge.sources import sinks
    from labelforge.sources.fixtures import view
    from labelforge.operators.consensus import consensus

    path = str(tmp_path / "cons")
    consensus(view(no_aqe, SMALL, "votes")).write.parquet(path)
    df = no_aqe.read.parquet(path)
    from pyspark.sql import functions as F

    q = df.where(F.col("findings").isNotNull() & F.col("label").isin("Normal", "Abnormal")).select("study_id", "label")
    p = physical_plan(q)
    assert "PushedFilters: [IsNotNull(findings), In(label, [Abnormal,Normal])" in p or \
           "PushedFilters: [IsNotNull(findings), In(label" in p
    assert "ReadSchema: struct<study_id:string,findings:string,label:string>" in p
    assert sinks is not None


def test_consensus_text_join_is_hash_join_when_not_broadcast(spark):
    # at scale the decision cannot be broadcast; AQE then builds a hash table
    # on the narrow decision instead of sorting the votes' text
    from labelforge.operators.consensus import consensus
    from labelforge.sources.fixtures import view

    old = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        df = consensus(view(spark, SMALL, "votes"))
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString()
        final = p.split("Initial Plan")[0]
        assert "isFinalPlan=true" in p and "ShuffledHashJoin" in final and "SortMergeJoin" not in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_bucketed_votes_consensus_without_shuffles(no_aqe):
    from labelforge.operators.consensus import consensus
    from labelforge.session import scratch_path
    from labelforge.sources import sinks
    from labelforge.sources.fixtures import view

    spark = no_aqe
    name = "votes_bucketed_test"
    sinks.save_votes_bucketed(view(spark, SMALL, "votes"), name, 4, scratch_path(spark, name))
    old = (spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition"),
           spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = consensus(spark.table(name))
        assert plan_summary(df)["shuffle_exchanges"] == 0
        ref = consensus(view(spark, SMALL, "votes"))
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, ref.collect()))
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
