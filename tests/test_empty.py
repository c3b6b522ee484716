"""Empty inputs: every operator returns an empty result with its schema."""

from labelforge.operators import consensus as C
from labelforge.operators import metrics as M
from labelforge.operators import sentences as S
from labelforge.operators import teacher as TE
from labelforge.operators import vectors as V

VOTES = ("subject_id string, study_id string, findings string, impression string, label string, "
         "explanation string, confidence double, model string")


def test_empty_consensus(spark):
    v = spark.createDataFrame([], VOTES)
    out = C.consensus(v)
    assert out.count() == 0
    assert out.columns == ["subject_id", "study_id", "findings", "impression", "label", "explanation", "confidence"]
    assert C.consensus_with_text(v).count() == 0


def test_empty_sentence_consensus_and_audit(spark):
    sv = spark.createDataFrame([], "parquet_file string, row_index long, sentence_index int, pass int, "
                                   "Result string, confidence double")
    assert C.sentence_consensus(sv).count() == 0
    a = C.consensus_audit(sv).first()
    assert a.total == 0 and a.usable == 0


def test_empty_metrics(spark):
    df = spark.createDataFrame([], "label int, prediction int")
    r = M.binary_metrics(M.confusion(df)).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.accuracy, r.f1) == (0, 0, 0, 0, 0.0, 0.0)


def test_empty_running_total_and_split(spark):
    df = spark.createDataFrame([], "f string, r long, v int")
    assert TE.running_total(df, ["f", "r"], "v").count() == 0
    t = spark.createDataFrame([], "k int, t string")
    assert S.split_sentences(t, "t").count() == 0


def test_empty_losses(spark):
    b = spark.createDataFrame([], "batch_id long, vec_id long, label int, embedding array<double>")
    assert V.supcon_loss(b, "batch_id", "embedding").count() == 0
    assert V.ntxent_loss(b, "batch_id", "embedding", "label").count() == 0
