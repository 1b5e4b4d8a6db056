"""Windows over streams: any cut of the frames into batches gives what the whole gives."""

import numpy as np
import pytest

from phonoframe.operators import sequence
from phonoframe.streaming import windows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_stream_cut_anywhere(rocks, tmp_path):
    spark, rng = rocks, np.random.default_rng(0)
    rows = [(u, t, float(rng.normal())) for u, n in (("a", 23), ("b", 4), ("c", 9)) for t in range(n)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][1] + rng.normal() * 2))  # somewhat out of order
    cuts = np.array_split(np.array(order), 5)
    schema = "utt string, frame long, value double"
    whole = sequence.sliding(spark.createDataFrame(rows, schema), "value", 5, 2)
    want = sorted(map(tuple, whole.select("utt", "window", "offset", "value").collect()))

    def run():
        stream = windows.sliding(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "value", 5, 2)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    for k, cut in enumerate(cuts):
        some = [rows[i] for i in cut] + ([rows[cuts[0][0]]] if k == 3 else [])  # a frame comes again
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 2, 4):
            run()  # each run goes on from the checkpoint of the one before
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("utt", "window", "offset", "value").collect()))
    assert got == want and len(got) == 5 * (10 + 0 + 3)
    with pytest.raises(ValueError):
        windows.sliding(whole, "value", 2, 3)


@pytest.mark.parametrize("kind", ["string", "long", "double"])
def test_utterances_share_states(rocks, tmp_path, kind):
    """Many utterances of any type and a null one in few states, with gaps, repeats and frames out of order between runs."""
    spark, rng = rocks, np.random.default_rng(1)
    names = {"string": [*(f"u{i}" for i in range(40)), ""], "long": [*range(40), 2**60 + 1], "double": [i / 4 for i in range(41)]}[kind] + [None]
    rows = [(u, t, float(rng.normal())) for k, u in enumerate(names) for t in range(3 + k % 17)]
    cuts = np.array_split(rng.permutation(len(rows)), 4)
    schema = f"utt {kind}, frame long, value double"
    columns = ["utt", "window", "offset", "value"]
    order = lambda got: sorted(map(tuple, got.select(*columns).collect()), key=str)
    for k, cut in enumerate(cuts):
        again = [rows[i][:2] + (0.0,) for i in cuts[0][:20]] if k else []  # what came first counts
        spark.createDataFrame([rows[i] for i in cut] + again, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = windows.sliding(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "value", 5, 2, buckets=3)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) <= 4  # three states and the null utterance's
    want = order(sequence.sliding(spark.createDataFrame(rows, schema), "value", 5, 2))
    assert order(spark.read.parquet(f"{tmp_path}/out")) == want and len(want) > 500
    with pytest.raises(ValueError):
        windows.sliding(spark.createDataFrame(rows, schema), "value", 5, 2, buckets=0)
