from pyspark.sql import functions as F

from churnlens.plans import narrative

DOC = {"score": 40, "band": "medium", "reasons": [{"points": 20, "label": "L", "detail": "d", "path": "p"}], "files": [{"path": "p", "score": 20, "lines_added": 1, "lines_deleted": 0}], "secret": "x"}
REPLIES = ['```json\n{"summary": " a ", "rollout": "b"}\n```', 'Sure: {"summary": "a", "monitoring": null} done', "just prose", "{broken"]


def test_replies(spark):
    want = [("a", "b", "", ""), ("a", "", "", ""), ("just prose", "", "", ""), ("{broken", "", "", "")]
    assert [tuple(narrative.parse_reply(r).values()) for r in REPLIES] == want
    rows = spark.createDataFrame([(r,) for r in REPLIES], "reply string").select(narrative.reply_sections(F.col("reply")).alias("s")).collect()
    assert [tuple(r["s"]) for r in rows] == want


def test_prose_never_changes_the_score():
    def fails(facts):
        assert "secret" not in facts
        raise RuntimeError("away")

    assert narrative.narrate(DOC, fails, "w")["ai_explanation"]["skipped_reason"] == "away"
    told = narrative.narrate(DOC, lambda facts: '{"summary": "s", "score": 99}', "w")
    assert told["score"] == 40 and told["ai_explanation"]["summary"] == "s"
    assert narrative.report(DOC).splitlines()[0].startswith(" 40/100  MEDIUM")
