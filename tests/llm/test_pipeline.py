"""The pipeline's stages against what each promises, and run() against the stages one by one by brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages_and_run_agree(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    start = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    kept = cp.identify_language(spark, start, str(tmp_path / "sf"))
    assert kept.columns == start.columns
    want = Counter((r.doc_id, r.text) for r in start.collect() if any(map(str.isalpha, r.text or "")))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    single = cp.drop_near_duplicates(spark, kept, "")
    ids = [r.doc_id for r in single.collect() if r.doc_id is not None]
    assert single.columns == start.columns and len(ids) == len(set(ids)) and 200 in ids and not {*range(201, 240)} & set(ids)
    mixed = cp.mix_sources(spark, single, "")
    assert mixed.columns == start.columns
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in mixed.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        expected[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    got = cp.run(spark, str(tmp_path / "sf")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == expected


def test_run_on_odd_tables(spark, tmp_path):
    """An empty table, one without a document to keep, and one of nulls, repeats and columns whose names the stages use themselves."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __lang string, __key string, copies int, size string, fp int"
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    odd = [(None, None, None, None), (1, "", "en", "s"), (2, "one two three four", None, None), (2, "one two three four", None, None), (2, "five six seven eight", "en", "s"), (3, long, "en", "s"), (None, "nine ten eleven twelve", "en", None), (4, long, "en", "s")]
    for k, rows in enumerate(([], [(1, "12 34", "en", "s"), (2, None, None, None)], odd)):
        folder = str(tmp_path / str(k))
        spark.createDataFrame([(*r, 0, "x", "y", 1, "z", 2) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
        got = cp.run(spark, folder).collect()
        if k < 2:
            assert got == []
            continue
        single = cp.drop_near_duplicates(spark, cp.identify_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), folder)
        assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter([(2, "one two three four"), (2, "five six seven eight"), (3, long), (None, "nine ten eleven twelve")])
        assert {r.doc_id for r in got} <= {2, 3, None} and len(got) > 0
