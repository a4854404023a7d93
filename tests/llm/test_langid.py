"""The pipeline's language stage without any label to learn from."""

import collections
import math
import zlib

import numpy as np
import pytest
from test_operators_llm import DOCS

from fieldnotes.llm import langid


def test_texts_with_a_letter_stay_without_labels(spark):
    rows = [(1, "a plain text", None, "a", 12), (2, "12 !", None, "a", 4), (3, None, None, "a", 0), (4, "", None, "a", 0)]
    kept = langid.keep_identified(spark.createDataFrame(rows, DOCS)).collect()
    assert [r["doc_id"] for r in kept] == [1]


class NaivePpm:
    """A language's prediction by partial matching with exclusion, symbol by symbol."""

    def __init__(self, texts, symbols):
        self.symbols, self.after = symbols, collections.defaultdict(collections.Counter)
        for t in texts:
            x = b"   " + langid.symbols_of(t)
            for i in range(3, len(x)):
                for k in range(4):
                    self.after[x[i - k : i]][x[i]] += 1

    def row(self, context):
        """The probability of every symbol after a context; None is the order below all."""
        if context is None:
            return {s: 1 / len(self.symbols) for s in self.symbols}
        low, seen = self.row(context[1:] if context else None), self.after[context]
        if not seen:
            return low
        rest = {s: p for s, p in low.items() if s not in seen}
        total = sum(seen.values()) + (len(seen) if rest else 0)
        return {s: seen[s] / total if s in seen else len(seen) / total * rest[s] / sum(rest.values()) for s in low}

    def bits(self, text):
        x = b"   " + bytes(c if c in self.symbols else 0 for c in langid.symbols_of(text))
        return -sum(math.log2(self.row(x[i - 3 : i])[x[i]]) for i in range(3, len(x)))


TRAINING = {
    "en": ["the cat sat on the mat", "a dog and the cat", "one day the rain came down"],
    "fr": ["le chat est sur la table", "une fenêtre ouverte", "il pleut sur la ville"],
    "de": ["die katze sitzt auf der matte", "ein schöner tag"],
}


@pytest.mark.parametrize("table_bytes", [0, 20_000, langid.TABLE_BYTES])
def test_query_equals_a_naive_model(spark, tmp_path, monkeypatch, table_bytes):
    monkeypatch.setattr(langid, "TABLE_BYTES", table_bytes)
    rows, n = [], 0
    for lang, texts in TRAINING.items():
        for t in texts:
            while zlib.crc32(str(n).encode()) % 4 == 2:
                n += 1
            rows.append((n, t, lang))
            n += 1
    asked = ["the table", "La Fenêtre est 12 ouverte!", "die matte", "xyz \U0001f600 q", "the cat sat", "ouvert tag rain"]
    rows += [(1000 + i, t, None) for i, t in enumerate(asked)] + [(2000, None, "en"), (2001, "", None), (2002, "12 !", None), (None, "un chat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    every = {c for texts in TRAINING.values() for t in texts for c in langid.symbols_of(t)} | {32, 0}
    models = {lang: NaivePpm(texts, every) for lang, texts in TRAINING.items()}
    trees = langid.train(docs)
    assert trees.langs == sorted(models)
    for t in asked:
        assert np.allclose(trees.lengths([langid.symbols_of(t)])[0], [models[x].bits(t) for x in trees.langs], rtol=1e-4)
    got = {r["doc_id"]: r for r in langid.op10_langid(spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        if not langid.has_letter(t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        bits = {x: m.bits(t) for x, m in models.items()}
        best = min(bits, key=lambda x: (bits[x], x))
        assert got[i]["lang_pred"] == best and math.isclose(got[i]["score"], 1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel_tol=1e-3)
        assert got[i]["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2)


def test_a_language_whose_rows_share_an_id_is_learned(spark):
    """All rows of English have one id or none, however many they are; whatever the ids are, it is known."""
    english = [f"the {w} of the house is here and number {i} too" for i, w in enumerate(["cat", "dog", "tree", "river"] * 375)]
    french = [f"la maison est ouverte et le chat {i} dort" for i in range(100)]
    for shared in (*(i for i in range(1, 12) if zlib.crc32(str(i).encode()) % 4 != 2), None):
        rows = [(shared, t, "en") for t in english] + [(10_000 + i, t, "fr") for i, t in enumerate(french)]
        trees = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert trees.langs == ["en", "fr"]
        bits = trees.lengths([langid.symbols_of("the dog is here"), langid.symbols_of("le chat dort")])
        assert bits.argmin(axis=1).tolist() == [0, 1]


def test_copies_of_one_row_and_many_languages(spark, monkeypatch):
    rows = [(1, "the same row again", "en")] * 2000 + [(2 + i, f"un texte {i}", "fr") for i in range(30)] + [(501, "ein text", "de"), (502, "ein text", "de"), (503, "ein text", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs).langs == ["de", "en", "fr"]
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert langid.train(docs).langs == ["en", "fr"]
