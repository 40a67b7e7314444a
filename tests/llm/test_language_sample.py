"""Every language is learned."""

from pyspark.sql import functions as F

from palimpsest.llm import langid


def many(spark, n=70, each=12):
    """``n`` languages of two letters each; the last of one text, and one with many texts without an id."""
    rows = []
    for k in range(n):
        a, b = chr(0x4E00 + 2 * k), chr(0x4E01 + 2 * k)
        rows += [(1000 * k + i, f"{a}{b} {b}{a}{a} " * (1 + i % 3), f"l{k:02}") for i in range(each)]
    rows += [(None, "\u0416\u0429 " * (1 + i), "noid") for i in range(200)]
    one = next(i for i in range(90_000, 90_100) if not spark.range(1).select(langid.held_out(F.lit(i))).first()[0])
    rows += [(one, "\u05d0\u05d1 \u05d1\u05d0", "rare"), (one + 1, "12 34", "letterless")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_beyond_64(spark):
    docs = many(spark)
    model = langid.train(docs)
    assert model.languages == sorted([f"l{k:02}" for k in range(70)] + ["noid", "rare"])
    for few in (langid.train(docs, per_language=2), langid.train(docs, most=72)):
        assert few.languages == model.languages
    texts = [r for r in docs.collect() if r.lang != "letterless"]
    assert model.predict([r.text for r in texts])[0] == [r.lang for r in texts]
