import random

import numpy as np
import pytest
import sentencepiece

from tidewater.llm import sentencepiece_codec as C
from tidewater.llm.token_counts import count_tokens, document_counts

END = 2


def brute(tokens):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == END:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(tokens):
        out.append((start, len(tokens) - start, False))
    return out


@pytest.mark.parametrize("block_bytes", [2, 6, 17, 1 << 20])
def test_scan_matches_brute_force(spark, tmp_path, block_bytes):
    rng = random.Random(block_bytes)
    files = {"a": [], "b": [END] * 9, "c": [5] * 40, "d": [END, 5, 5], "e": [5, END]}
    for i in range(6):
        files[f"r{i}"] = [END if rng.random() < 0.2 else rng.randint(0, 65535) for _ in range(rng.randint(1, 60))]
        files[f"r{i}"] = [t if t != END or rng.random() < 0.8 else 7 for t in files[f"r{i}"]]
    for n, t in files.items():
        (tmp_path / n).write_bytes(np.array(t, "<u2").tobytes() + (b"\x01" if n == "c" else b""))
    got = {}
    for r in count_tokens(spark, str(tmp_path), END, 2, block_bytes).orderBy("file", "doc_no").collect():
        rows = got.setdefault(r.file, [])
        assert r.doc_no == len(rows)
        rows.append((r.start, r.n_tokens, r.closed))
    assert got == {n: brute(t) for n, t in files.items() if brute(t)}


def test_documents(spark, tmp_path):
    texts = [None, "", "one", "two words\nand a line", "", "é😀 " * 50]
    df = spark.createDataFrame([(i if i else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(2)
    df.write.parquet(str(tmp_path / "d"))
    sp = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    got = {r.doc_id: r.n_tokens for r in document_counts(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {(i or None): len(sp.encode(t or "")) for i, t in enumerate(texts)}
    df.limit(0).write.parquet(str(tmp_path / "e"))
    assert document_counts(spark.read.parquet(str(tmp_path / "e"))).count() == 0
