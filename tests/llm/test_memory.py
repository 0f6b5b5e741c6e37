"""What Python workers keep: one operator's tables at a time, and batches of bounded bytes."""

from rillflow.llm import bpe, common, secrets, toxicity


def test_one_operator_at_a_time():
    enc = bpe.encoder("byte_bpe_50k.json")
    assert bpe.encoder("byte_bpe_50k.json") is enc
    assert secrets.scan("token = abcdefghijkl") and list(common._held) == ["secrets"]
    toxicity.Scorer(toxicity.Model())
    assert not common._held and bpe.encoder("byte_bpe_50k.json") is not enc


def test_batches_are_bounded(spark, docs):
    """Larger batches are made smaller, smaller ones stay, and no row is lost."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        out = secrets.redact_secrets(docs)
        assert int(spark.conf.get(name).removesuffix("b")) == common.BATCH_BYTES and out.count() == docs.count()
        spark.conf.set(name, "1000")
        out = secrets.redact_secrets(docs)
        assert int(spark.conf.get(name).removesuffix("b")) == 1000
        assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r.doc_id or -1 for r in docs.collect())
    finally:
        spark.conf.set(name, before)
