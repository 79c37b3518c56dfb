import numpy as np
import pytest

from tidewater.llm import training_order as T


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    p = T.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    if n > 60:
        assert (p != T.permute(np.arange(n), n, key=1)).any()
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.5


def test_shards_hold_every_sequence_in_slot_order(spark, tmp_path):
    enc = T.tokenizer(open(T.TOKENIZER, "rb").read())
    texts = [None, "", "short", "é😀 unicode\n\nlines"] + [f"document {i} " * (i % 37 + 1) for i in range(150)]
    texts[20] = "long " * 3000
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)], "doc_id long, text string, slot int")
    df.repartition(3).write.parquet(str(tmp_path / "d"))
    docs, path = spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "shards")
    rows = T.materialise(docs, path, per_shard=40, record=64).collect()
    assert sorted(r.slot for r in rows) == list(range(len(texts) + 1))
    shards = {}
    for r in T.read_records(spark, path, record=64).collect():
        shards.setdefault(r.shard, {})[r.record] = np.frombuffer(r.tokens, "<u2")
    flat = {s: np.concatenate([x[i] for i in range(len(x))]).tolist() for s, x in shards.items()}
    for r in rows:
        want = enc.encode_ordinary((texts[r.doc_id] if r.doc_id else None) or "")
        assert r.shard == r.slot // 40
        assert flat[r.shard][r.start : r.start + r.n_tokens + 1] == [*want, T.END_ID]
    later = T.read_records(spark, path, shard=1, first_record=2, record=64).collect()
    assert {(r.shard, r.record) for r in later} == {(s, i) for s, x in shards.items() for i in x if s > 1 or (s == 1 and i >= 2)}
    again = T.materialise(docs, str(tmp_path / "again"), per_shard=40, record=64).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(again, key=key) == sorted(rows, key=key)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    assert T.materialise(spark.read.parquet(str(tmp_path / "e")), str(tmp_path / "s")).count() == 0
