from cofferlake.llm.toxicity import toxicity_scores


def test_class_shares_do_not_follow_the_sample(spark):
    """200 of the 500 documents with the word are toxic: below one half, also where most clean labels are left out."""
    rows = [(i, "bad thing here" if i < 500 else "good thing here", int(i < 200)) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for most in (3000, 300):
        scores = {r.doc_id: r.score for r in toxicity_scores(table.select("doc_id", "text"), table.select("doc_id", "toxic"), max_train=most).collect()}
        assert 0.25 < scores[0] < 0.5 and scores[1999] < 0.1, most
