import tempfile

from quire.operators import evaluate
from quire.sources import fixtures as fx
from quire.streaming import first_usable_replies

from conftest import SF01


def test_stream_matches_batch(spark):
    prompts = fx.eval_prompts(spark, SF01)
    resp = fx.eval_responses(spark, SF01)
    src = tempfile.mkdtemp(prefix="quire-stream-")
    resp.where("attempt = 1").write.mode("overwrite").parquet(f"{src}/a1")
    resp.where("attempt = 2").write.mode("overwrite").parquet(f"{src}/a2")
    stream = spark.readStream.schema(resp.schema).option("recursiveFileLookup", "true").parquet(src)
    q = first_usable_replies(stream, prompts).writeStream.outputMode("complete").format("memory") \
        .queryName("first_replies").option("checkpointLocation", f"{src}/_ckpt").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("first_replies")
    m_stream = evaluate.er_metrics(evaluate.er_counts(prompts, got)).first()
    m_batch = evaluate.eval_er(prompts, resp).first()
    assert m_stream.asDict() == m_batch.asDict()
