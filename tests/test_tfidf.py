"""Vectorizers saved and loaded, names of features, stop words from files."""

import pytest

from graphloom.operators import tfidf


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(1, "b b, a the"), (2, "a c the"), (3, None), (4, ""), (5, " !! \t"), (6, "aa ab the b-c")], "doc_id long, text string")


def test_feature_names(docs):
    v = tfidf.TfIdf().vocabulary(docs)
    want = [r.term for r in sorted(v.collect(), key=lambda r: (-r.df, r.term))]
    assert [r.term for r in tfidf.feature_names(v).orderBy("index").collect()] == want
    assert sorted(r["index"] for r in tfidf.feature_names(v).collect()) == list(range(len(want)))


def test_saved_vectorizer(spark, docs, tmp_path):
    (tmp_path / "stop.txt").write_text("# words\nthe\n\n a \n")
    stop = tfidf.load_stop_words(spark, str(tmp_path / "stop.txt"))
    assert stop == ("a", "the")
    v = tfidf.TfIdf(norm="l1", min_df=1, stop_words=stop)
    words = v.vocabulary(docs)
    tfidf.save_vectorizer(v, words, str(tmp_path / "v"))
    again, loaded = tfidf.load_vectorizer(spark, str(tmp_path / "v"))
    assert again == v
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(again.transform(docs, loaded)) == order(v.transform(docs, words)) != []
    assert {r.term for r in loaded.collect()} == {"b", "c", "aa", "ab", "bc"}
