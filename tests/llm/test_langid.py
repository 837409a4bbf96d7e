import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import langid


def test_labels(spark):
    given = ["EN", "en-GB", "pt_BR", " German ", "fra", "dut", "unknown", "", None, "zh", "english_US"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "l string").select(langid.label_language(F.col("l"))).collect()]
    assert got == ["en", "en", "pt", "de", "fr", "nl", None, None, None, None, "en"]


def test_blocks():
    assert langid.blocks_of("\n\n a\nb\r\n \t\r\nc\n\n\n\nd") == [" a\nb\r", "c", "d"]
    assert not langid.is_prose_start("  | x") and langid.is_prose_start("'''x") and langid.blocks_of("") == []


def test_probabilities_sum_to_one():
    m = langid.fit_model({"abc": 3, "abd": 1, "bb": 2}, alphabet=10)
    # every character that can follow, the end and one of the unseen ones
    words = ["ab" + c for c in "abcd"] + ["ab"]
    p = []
    for w in words:
        hashes, at, _ = langid._grams([w])
        p.append(2 ** m.log2(hashes, at)[2])
    unseen, at, _ = langid._grams(["abz"])
    p += [2 ** m.log2(unseen, at)[2]] * 5
    assert sum(p) == pytest.approx(1, abs=1e-9)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet")


def test_held_out_accuracy(docs):
    """Blocks of documents that no model saw get the language their label names, save for the wrong labels."""
    sample = langid.labelled_sample(docs, 60, 20_000, "doc_id", "text", "lang")
    train = {c: t[len(t) // 3 :] for c, t in sample.items()}
    fitted = langid.fit_identifier(train)
    scorer = langid.Scorer(fitted.models)
    right = total = 0
    for c, texts in sample.items():
        for b in langid._texts_to_blocks(texts[: len(texts) // 3]):
            bits, letters, _ = scorer.score([b])
            if letters[0] >= langid.MIN_LETTERS:
                total += 1
                right += langid.LANGUAGES[int(bits[0].argmin())] == c
    assert total > 300 and right / total > 0.85
    text = "This old wooden bridge was sold by the parish after the flood and never came back to the village."
    bits, _, _ = scorer.score([text])
    assert langid.LANGUAGES[int(bits[0].argmin())] == "en"


def test_mixed_and_odd_documents(spark, docs):
    named = docs.select("doc_id", "text", "lang")
    long_of = lambda c: named.where(langid.label_language(F.col("lang")) == c).orderBy("doc_id").select("text").limit(40).collect()
    find = lambda c, word: next(b for r in long_of(c) if r.text for b in langid.blocks_of(r.text) if word in b and len(b) > 150 and langid.is_prose_start(b))
    en, de = find("en", " the "), find("de", " der ")
    extra = [(10**9, en + "\n\n" + en + "\n \n" + de, "en"), (10**9 + 1, "", "en"), (10**9 + 2, None, None), (10**9 + 3, "= head =\n\n| x", "de"), (10**9 + 4, en, "deu"), (10**9 + 4, en, "deu")]
    both = named.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string")).withColumn("seg_no", F.lit("clash")).withColumn("letters", F.lit(1))
    got = langid.identify(both, sample_docs=60)
    own = sorted(((r.doc_id - 10**9, r.seg_no, r.lang) for r in got.where("doc_id >= 1000000000").collect() if r.lang or r.seg_no == 0), key=str)
    assert own == [(0, 0, "en"), (0, 1, "en"), (0, 2, "en"), (0, 3, "de"), (1, 0, None), (2, 0, None), (3, 0, None), (4, 0, "en"), (4, 0, "en")]
    faults = {(r.doc_id, r.seg_no) for r in langid.label_faults(got).collect()}
    assert (10**9 + 4, 0) in faults and (10**9, 3) in faults and (10**9, 0) not in faults
    assert got.where("confidence < 0 or confidence > 1").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(df).count() == 0
    one = spark.createDataFrame([(1, "no label anywhere in here", None)], "doc_id long, text string, lang string")
    assert [(r.seg_no, r.lang, r.confidence) for r in langid.identify(one).collect()] == [(0, None, 0.0)]


def test_small_cache_changes_nothing(monkeypatch):
    words = {c: {f"{c}{i}word": i + 1 for i in range(20)} for c in ("a", "b")}
    models = [langid.fit_model(w, 100) for w in words.values()]
    parts = [f"a{i}word b{i}word, xx{i}" for i in range(50)]
    want = langid.Scorer(models).score(parts)[0]
    monkeypatch.setattr(langid, "_CACHE_ENTRIES", 5)
    small = langid.Scorer(models)
    assert np.allclose(np.concatenate([small.score([p])[0] for p in parts]), want, rtol=1e-5)
