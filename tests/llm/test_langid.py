from __future__ import annotations

import zlib

import numpy as np
import pytest

from cellmill.llm.langid import BiGRU, LangParams, predict_lang, train_langid


def test_gradient_is_the_numeric_one():
    r = np.random.default_rng(1)
    model = BiGRU(["a", "b", "c"], 3, 2)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    segments, labels = r.integers(0, 5, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grad = model.gradients(segments, labels)
    for name, w in model.w.items():
        for _ in range(5):
            at = tuple(r.integers(0, n) for n in w.shape) if name != "x" else (r.integers(0, 2), r.integers(0, 5), r.integers(0, 9))
            old, e = w[at], 1e-3
            w[at] = old + e
            up, _ = model.gradients(segments, labels)
            w[at] = old - e
            down, _ = model.gradients(segments, labels)
            w[at] = old
            assert (up - down) / (2 * e) == pytest.approx(grad[name][at], rel=0.05, abs=2e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = predict_lang(docs, train_langid(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    texts = [None, "", " 12 !? \n", "the and of the " * 9, "der die und nicht " * 20_000, "é", "the and of the " * 9]
    rows = [(i if i != 3 else None, t, None, "s", 0.5) for i, t in enumerate(texts)]
    rows += [(100 + i, "the and of with this " * 8, "en", "s", 0.1) for i in range(60)] + [(300 + i, "der die und nicht sich " * 8, "de", "s", 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    model = train_langid(df, params=LangParams(epochs=4))
    got = predict_lang(df, model, runs=True).collect()
    assert [r.lang_pred for r in got[:5]] == ["und", "und", "und", "en", "de"] and [r.score for r in got[:3]] == [0, 0, 0]
    assert got[3].lang_pred == got[6].lang_pred and got[3].score == got[6].score
    for r, (_, t, *_) in zip(got, rows, strict=True):
        assert [x.start for x in r.runs] == [0, *(x.end for x in r.runs[:-1])][: len(r.runs)]
        if r.lang_pred != "und":
            assert r.runs[-1].end == len(t.encode())
    assert predict_lang(df.where("false"), None).count() == 0
    assert train_langid(df.where("lang is null")) is None
    assert {r.lang_pred for r in predict_lang(df, None).collect()} == {"und"}


def test_prediction_by_plain_loops(spark, sf):
    """Each document byte by byte, segment by segment, with scalar gates."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    params = LangParams(epochs=2, per_language=40)
    model = train_langid(docs, params=params)
    got = {r.doc_id: r for r in predict_lang(docs, model, params=params, runs=True).collect()}
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    k = model.hidden
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def way(d, segment):
        h, out = np.zeros(k), []
        for byte in segment:
            x, u = w["x"][d, byte] + w["b"][d, 0], h @ w["h"][d]
            z, r = logistic(x[:k] + u[:k]), logistic(x[k : 2 * k] + u[k : 2 * k])
            c = np.tanh(x[2 * k :] + r * u[2 * k :])
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    for r in docs.where("length(text) < 900").limit(40).collect():
        raw = (r.text or "").encode()
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id].lang_pred == "und"
            continue
        total, marks = np.zeros(len(model.langs)), []
        for at in range(0, len(raw), params.segment):
            part = raw[at : at + params.segment]
            padded = part.ljust(params.segment, b" ")
            for f, b in list(zip(way(0, padded), way(1, padded[::-1])[::-1], strict=True))[: len(part)]:
                e = np.exp(np.concatenate([f, b]) @ w["o"] + w["c"])
                total += e / e.sum()
                marks.append(model.langs[int(e.argmax())])
        assert got[r.doc_id].score == pytest.approx((total / len(raw)).max(), abs=1e-4)
        assert got[r.doc_id].lang_pred == model.langs[int(total.argmax())]
        labelled = [x.lang for x in got[r.doc_id].runs for _ in range(x.end - x.start)]
        assert len(labelled) == len(raw) and np.mean([a == b for a, b in zip(labelled, marks, strict=True)]) > 0.99


def test_sample_is_bounded_when_rows_share_ids(spark, monkeypatch):
    """Null ids, one length, one text in half of the rows: no more than the bound comes, and every language does."""
    seen = {}
    own = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)
    monkeypatch.setattr(BiGRU, "fit", lambda self, segments, labels, params: seen.update(n=np.bincount(labels, minlength=len(self.langs)), segments=segments))
    rows = [(None, "the same text of all rows of it", "en")] * 900 + [(None, f"den text {i:04d} gibt es so nicht", "de") for i in range(900)] + [(own, "漢字" * 200, "zh")]
    train_langid(spark.createDataFrame(rows, "doc_id long, text string, lang string"), params=LangParams(per_language=50))
    de, en, zh = seen["n"]
    assert 20 <= de <= 50 and 1 <= en <= 50 and zh == 3  # 64 characters of three bytes each
