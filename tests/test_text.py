import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import labels as lab
from loomtext.functions import prompts as pr
from loomtext.functions import text as tx
from loomtext.functions.tokens import char_ngrams, ngram_range, tokens
from loomtext.operators import corpus as c

GOLDEN = [
    (tx.normalise_unintelligible, "[聽不清楚]", "【聽不清楚】"),
    (tx.normalise_unintelligible, "【聽不清楚】 【 聽不清楚 】好", "【聽不清楚】 好"),
    (tx.sanitise, "a😀b", "a b"),
    (tx.sanitise, "甲　乙", "甲 乙"),
    (tx.sanitise, " x y ", "x y"),
    (tx.sanitise, None, ""),
    (tx.sanitise, "", ""),
    (tx.clean_asr, "ㄅㄆ好", "嗯好"),
    (tx.clean_asr, "嗯，嗯、嗯 好", "嗯 好"),
    (tx.clean_structured, "Doctor: 好", "好"),
    (tx.clean_structured, "我Doctor: 好", "我Doctor: 好"),
    (tx.clean_structured, "speaker 12：好 病人: 是", "好 是"),
    (tx.clean_structured, "12_345 看", "看"),
    (tx.clean_structured, "*PAR: 看 n:cat|dog", "看"),
    (tx.clean_structured, "他 < . . . > 說 [ // ] 了", "他 <...> 說 [//] 了"),
    (tx.clean_structured, "&-UH 我 &-ah 去", "&-uh 我 去"),
    (tx.clean_structured, "&嗯 好", "嗯 好"),
    (tx.clean_structured, "看 [註] (笑) 好", "看 好"),
    (tx.clean_structured, "看 <abc> +<x> ‡ 好", "看 + 好"),
    (tx.clean_structured, "我 +foo 去", "我 去"),
    (tx.clean_structured, "我 &abc 去", "我 去"),
    (tx.clean_structured, "【上海话】 好 【聽不清楚】", "好 【聽不清楚】"),
    (tx.clean_structured, "<...> <...> 好 [/] [/]", "<...> 好 [/] [/]"),
    (tx.clean_structured, "[+ GRAM] [+gram] 好 &-um &-um", "[+ gram] 好 &-um"),
    (tx.clean_structured_words, "&-uh 好", "FILLPAUSE_uh 好"),
    (tx.clean_structured_words, "&-uh x &-uh", "FILLPAUSE_uh x FILLPAUSE_uh"),
    (tx.clean_structured_words, "a [//] <...> [+ gram]，b", "a RETRACE PAUSE GRAM b"),
    (tx.clean_transcript, "%mor: 好 [聽不清楚]", "mor: 好 【聽不清楚】"),
]


def test_golden_rows(spark):
    df = spark.createDataFrame([(t,) for _, t, _ in GOLDEN], "t string")
    for k, (f, text, want) in enumerate(GOLDEN):
        got = spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
        assert got == want, (k, f.__name__, text, got)
    once = df.select(tx.sanitise(F.col("t")).alias("a")).select("a", tx.sanitise(F.col("a")).alias("b"))
    assert once.filter("a <> b").count() == 0


def run(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_prompts(spark):
    t = F.col("t")
    text = "好，看到什麼？我看到一隻貓。"
    assert run(spark, pr.drop_prompts(t, ["好", "看到什麼"], least_kept=0), text) == "我看到一隻貓。"
    assert run(spark, pr.drop_prompts(t, ["("], least_kept=20), "短") == "短"
    assert run(spark, pr.drop_prompts(t, ["長"], least_kept=20), "短。") == ""
    assert run(spark, pr.drop_prompts(t, ["看到"], mode="any", least_kept=0), text) == "好，"
    assert run(spark, pr.drop_prompts(t, ["."], most_leading=1, least_kept=0), text) == "看到什麼？ 我看到一隻貓。"
    assert run(spark, pr.drop_prompts(t, ["."], least_kept=0), text) == ""
    assert run(spark, pr.drop_prompts(t, ["x"], enabled=False), "　a  b ") == "a  b"
    twice = pr.drop_prompts_twice(t, F.lit(" D "), ["好"], ["貓"], apply_to=["D"], least_kept=0)
    assert run(spark, twice, text) == "看到什麼？"
    assert run(spark, pr.drop_prompts_twice(t, F.lit("E"), ["好"], apply_to=["D"]), text) == text


def test_labels(spark):
    t = F.col("t")
    for raw, want in (("Probable AD", "AD"), ("probable-ad", "AD"), (" nc ", "HC"), ("Mild Cognitive Impairment", "MCI"), ("XYZ", "Unknown"), (None, "Unknown"), ("healthy_control", "HC")):
        assert run(spark, lab.mapped(t, {"HEALTHY_CONTROL": "HC"}), raw) == want
    assert run(spark, lab.canonical(t), "healthy_control") is None
    with pytest.raises(Exception, match="unknown diagnosis label"):
        run(spark, lab.canonical_strict(t), "XYZ")
    assert [run(spark, lab.subject_id(t), x) for x in ("", "nan", "None", " null ", " a ", None)] == [None, None, None, None, "a", None]
    assert [run(spark, lab.speaker(t), x) for x in (" <B> ", "B", "< B>")] == ["B", "B", "B"]
    assert [run(spark, lab.binary(t), x) for x in ("HC ", "AD", "MCI")] == [0, 1, None]
    assert [run(spark, lab.sample_id(F.lit("AD"), t), x) for x in ("ad_1", "x")] == ["ad_1", "AD_x"]


def test_tokens(spark):
    t = F.col("t")
    assert run(spark, char_ngrams(t, 1, 3), "a😀b") == ["a", "😀", "b", "a😀", "😀b", "a😀b"]
    assert run(spark, char_ngrams(t, 2, 4), "a") == [] == run(spark, char_ngrams(t), None)
    assert run(spark, tokens(t, lowercase=True, stop_words=["the"]), " The　cat\nsat the ") == ["cat", "sat"]
    assert run(spark, tokens(t, "char"), "a b😀") == ["a", "b", "😀"]
    assert ngram_range("2,4") == ngram_range([2, 4]) == (2, 4)
    with pytest.raises(ValueError):
        ngram_range("4,2")


def test_cleaning_needs_no_python(spark):
    df = spark.createDataFrame([("a", "D", "nc")], "Text_interviewer_participant string, Dataset string, Diagnosis string")
    text = pr.drop_prompts_twice(tx.clean_transcript(F.col(c.TEXT)), F.col(c.DATASET), ["x"], ["y"])
    plan = df.select(text, lab.mapped(F.col(c.LABEL)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
