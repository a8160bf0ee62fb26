import random

from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators import quality as q

PIECES = [
    "a", "B", "uh", "-uh", "&", "&-", "&-UH", "&-um", "&-ah", " ", "  ", "\t", "\x1c", " ", " ", "\n", "<", ">", "...", "<...>", "< . . . >", "[", "]", "//", "/", "[/]", "[//]", "[+ gram]", "[+ GRAM]", "(", ")", "+", "+foo", "+<",
    "|", ":", "：", "_", "1", "12_3", "%x:", "*PAR:", "v:n|go", "Doctor :", "speaker 3:", "醫生：", "聽不清楚", "[聽不清楚]", "【 聽不清楚 】", "嗯", "嗯，嗯", "ㄅㄧ", "ㄦ", "語", "&語", "话】", "【上海话】", "【", "方言", "】", "‡", "·", "…", "é", "😀", ",", ".", "“", "PAUSE PAUSE",
    "GRAM", "fillpause_uh", "^", "&&", "~", "-", "'",
]
OLD = {
    "ZHUYIN": "[" + "".join(map(chr, range(0x3105, 0x312A))) + "]+", "RUN": f"{tx.WS}+",
    **{n: getattr(tx, n).replace(f"[[^{tx.PLAIN}]&&", "", 1).replace("]]", "]") for n in ("NOT_ALLOWED", "PUNCTUATION", "NOT_BASIC")},
}


def test_patterns_that_are_not_tried_would_have_found_nothing(spark, monkeypatch):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4).cache()
    cleaners = {"sanitise": tx.sanitise, "asr": tx.clean_asr, "structured": tx.clean_structured, "transcript": tx.clean_transcript, "words": tx.clean_structured_words}

    def run():
        return {r.id: r.asDict() for r in df.select("id", *[f(F.col("t")).alias(n) for n, f in cleaners.items()]).collect()}

    got = run()
    monkeypatch.setattr(tx, "where_any", lambda text, marks, change: change(text))
    monkeypatch.setattr(tx, "squeeze", lambda text: tx.strip(tx.sub(text, f"{tx.WS}+", " ")))
    for name, pattern in OLD.items():
        monkeypatch.setattr(tx, name, pattern)
    want = run()
    assert [(texts[k], got[k], want[k]) for k in got if got[k] != want[k]] == []


def test_texts_without_marks_pass_few_patterns(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = df.select(tx.clean_transcript(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("contains(") >= 15


def test_one_pass_blanks_what_three_steps_blanked(spark):
    draw = random.Random(6)
    odd = [*PIECES, "\x85", "\xa0", "\u1680", "\u2009", "\u2028", "\u202f", "\u3000", "\ufeff", "\u200b", "ñ", "_", "\u9fff", "\ua000", "\x1f", "\r\n", "𠀀"]
    texts = ["".join(draw.choice(odd) for _ in range(draw.randint(0, 12))) for _ in range(4000)]
    t, squeezed = F.col("t"), lambda x: tx.strip(tx.sub(x, f"{tx.WS}+", " "))
    steps = {
        "allowed": (tx.sanitise(t), squeezed(tx.sub(F.replace(t, F.lit("\xa0"), F.lit(" ")), OLD["NOT_ALLOWED"] + "+", " "))),
        "basic": (tx.blanked(t, tx.PUNCTUATION + tx.NOT_BASIC), squeezed(tx.chain(t, (OLD["PUNCTUATION"], " "), (OLD["NOT_BASIC"], " ")))),
    }
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for got, want in steps.values():
        assert [tuple(r) for r in df.select("t", got.alias("got"), want.alias("want")).filter("got <> want").collect()] == []


def test_plain_characters_are_looked_up_and_no_range_is_asked():
    assert "-" not in tx.PLAIN and set(tx.PLAIN) == {chr(c) for c in range(128) if chr(c).isalnum()} | {" "}


def test_strip_takes_what_the_pattern_takes(spark):
    every = spark.range(1, 0x3100).filter("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    texts = every.select(F.concat("c", F.lit(" \t"), "c", F.lit("a b"), "c", "c").alias("t"), "c")
    old = tx.sub(F.col("t"), rf"^{tx.WS}+|{tx.WS}+$", "")
    assert texts.filter(tx.strip(F.col("t")) != old).count() == 0
    assert texts.select(F.sum(F.length(tx.strip(F.col("c"))))).first()[0] == 0x3100 - 1 - len(tx.SPACES)


def test_metrics_strip_and_remove_markers_once(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice([*PIECES, tx.UNK, "&-um", "[+  gram]"]) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    measured = q.with_quality(df, "t")
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(coalesce(t") == 1 and plan.count(", (?U)" + q.MARKERS) == 1
    stripped = tx.strip(tx.sub(F.col("t"), rf"^{tx.WS}+|{tx.WS}+$", ""))
    lexical = tx.sub(stripped, q.MARKERS, "")
    want = {
        "total_len": F.length(stripped), "lex_len": F.length(tx.sub(lexical, f"{tx.WS}+", "")), "script_len": F.regexp_count(lexical, F.lit(tx.HAN)),
        "unk_ratio": F.regexp_count(stripped, F.lit(tx.UNK)) * 6.0 / F.greatest(F.length(stripped), F.lit(1)),
    }
    assert sorted(measured.collect()) == sorted(df.select("id", "t", *[e.alias(n) for n, e in want.items()]).collect())
