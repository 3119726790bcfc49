"""Sentence statistics use every count, those met once too."""

from siltgrid.llm import sentences

TEXT = "doc_id long, text string, lang string"
NAMES = [f"{a}{b}son" for a in ("Al", "Ber", "Cor", "Dan", "Ed", "Fin") for b in ("ba", "de", "ki", "lo", "mu")]


def documents(spark):
    plain = ["The house is old. It stands by the river. We saw it in May.", "Do you know? They went home! It was late! It is. He left! He said so! We saw it? She stayed. Why not?"] * 20
    titled = [f"Yesterday we met Prof. {n} at the old house near the river. It was late." for n in NAMES]
    spoken = [f"It is no. {k} in the list, approx. {k} metres long, e.g. like this one. He said so." for k in range(1, 9)]
    return spark.createDataFrame([(k, t, "en") for k, t in enumerate(plain + titled + spoken)], TEXT)


def test_title_before_names_met_once(spark):
    docs = documents(spark)
    ends = {}
    for r in sentences.sentence_ends(docs).collect():
        ends.setdefault(r.doc_id, []).append(r.end_pos)
    for r in docs.where("text like '%Prof.%'").collect():
        assert not any(r.text[: e + 1].endswith("Prof.") or r.text[:e].endswith("Prof.") for e in ends[r.doc_id])
        assert len(ends[r.doc_id]) == 2


def test_decided_in_spark_is_the_model_of_all_counts(spark):
    counts = sentences.learn(documents(spark))
    want = sentences.Model(counts.toPandas().itertuples(index=False, name=None))
    got = sentences.Model.of(sentences.decided(counts).toPandas().itertuples(index=False, name=None))
    for name in ("abbreviations", "pairs", "reports"):
        a, b = getattr(want, name), getattr(got, name)
        assert {k: v for k, v in a.items() if v} == b, name
    assert "Prof" in got.abbreviations["en"]
