"""Words beyond the table have their own share of their class, by their own count."""

import math
import random

import pytest
from test_lmscore import naive

from fieldnotes.llm import lmscore


@pytest.mark.parametrize("table", [140, 127])
def test_rare_words_score_by_their_own_counts(spark, tmp_path, monkeypatch, table):
    rng = random.Random(4)
    vocab = [f"w{int(600 * rng.random() ** 3)}" for _ in range(2500)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(40)] + [(90, None), (91, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = lmscore.vocabulary(docs)
    kept = {}
    monkeypatch.setattr(lmscore, "TABLE", table)
    monkeypatch.setattr(lmscore, "train", lambda codes, f=lmscore.train: kept.setdefault("net", f(codes)))
    got = {r["doc_id"]: r for r in lmscore.op8_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(lmscore.vocabulary(docs).share) == table < len(whole.share) and len(got) == len(rows)
    for i, text in rows:
        words = (text or "").lower().split()
        assert got[i]["n_tokens"] == len(words) and math.isclose(got[i]["log_prob"], naive(kept["net"], whole, words), rel_tol=1e-4, abs_tol=1e-6)
