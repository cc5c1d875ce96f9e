"""Questions that find nothing are found out among all questions, without a filter on ids."""

from siltstone.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


def test_all_questions_are_asked(spark):
    asked = {r["item_id"]: r["text"] for r in fixtures.questions(spark, SF).collect()}
    found = {r["item_id"] for r in catalog.queries()["direct_fallback_top5"](spark, SF).collect()}
    grades = {r["item_id"]: (r["n"], r["grade"]) for r in catalog.queries()["grade_rows"](spark, SF).collect()}
    assert set(grades) == set(asked)
    for i, text in asked.items():
        assert (i in found) == (text != "?! …")  # unknown words are found by vectors only, no words by nothing
        assert (grades[i] == (0, "irrelevant")) == (text == "?! …")
