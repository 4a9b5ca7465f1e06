from lodestar.operators import languages


def test_frequent_words_are_summed_up_once(spark, monkeypatch):
    """The same languages whether no word, one or all of them are known as a whole."""
    taught = spark.createDataFrame([("en", "the lake the night"), ("en", "quiet place by the lake"), ("de", "der see die nacht"), ("de", "ruhiger platz am see"), (None, "x")], "lang string, text string")
    rows = spark.createDataFrame([(1, "The lake, der See see"), (2, "zzz 12"), (3, None), (4, "nacht nachts"), (1, "place"), (None, "the")], "id long, text string")
    found = []
    for most in (0, 1, languages.KNOWN_WORDS):
        monkeypatch.setattr(languages, "KNOWN_WORDS", most)
        fitted = languages.fit(taught)
        assert fitted.words.count() == min(most, 13)
        found.append(sorted(map(str, languages.detected(rows, fitted, "id").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 5 and "n_known=0" in "".join(found[0])
