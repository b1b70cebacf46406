from __future__ import annotations

import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.test_minhash import brute as near_brute  # noqa: E402
from tests.llm.test_suffixes import brute as repeats_brute  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"test-{name}")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
    rows = {name: {r.doc_id: r for r in x} for name, x in out.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and len(before[i].text.split()) >= 50]
    assert sum(i in rows["quality"] for i in good) >= 0.95 * len(good)
    assert all(r == before[i] for i, r in rows["quality"].items())
    first: dict[str, int] = {}
    for i in sorted(rows["quality"]):
        first.setdefault(rows["quality"][i].text, i)
    assert sorted(rows["exact"]) == sorted(first.values())
    kept = [i for i, _, _, k in near_brute([(i, r.text) for i, r in rows["exact"].items()], 5, 80) if k]
    assert sorted(rows["near"]) == kept
    for i, _, spans, whole in repeats_brute([(i, r.text) for i, r in rows["near"].items()], 50):
        if not spans:
            assert rows["repeats"][i] == rows["near"][i]
        elif i in rows["repeats"]:
            text = rows["repeats"][i].text
            assert len(whole) <= len(text.encode()) <= len(whole) + 6 * len(spans) and rows["repeats"][i].n_chars == len(text)
        else:
            assert not whole.decode("utf-8", "ignore").strip()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    total = 0
    for i, r in rows["repeats"].items():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = sorted((x for x in out["packing"] if x.doc_id == i), key=lambda x: x.piece)
        assert [zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in own] == [x.ids_crc32 for x in own]
        assert sum(x.length for x in own) == len(ids) and b"".join(bytes(x.ids) for x in own) == ids.tobytes()
    assert len({x.sequence_id for x in out["packing"]}) <= -(-total // 2048) + 1


def test_run_leaves_only_what_its_result_reads(spark, sf, tmp_path, monkeypatch):
    import os

    import __spark_entry__

    monkeypatch.setattr("cellmill.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    assert __spark_entry__.queries()["pipeline"](spark, sf).count() > 0
    left = {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path / "cellmill")}
    assert left == {"stage-repeats", "pieces", "piece-counts"}


def test_odd_rows(spark, sf):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(None, clean, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, clean, None, "s", 5), (3, clean, None, "s", 5), (4, "é " * 40, "fr", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            some = corpus_pipeline.written(stage(spark, some, sf), f"odd-{name}")
        assert some.count() == some.select("doc_id", "piece").count()
